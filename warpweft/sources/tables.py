"""Readers and writers: declared schemas for delimited files and JSON lines, tolerant reading, text, optional tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from warpweft.functions.text import clean_markup, json_strings


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores.

    A table in few row groups is read by as few tasks; before costly work on its rows they are dealt out. Tables that are read by enough tasks, as all large ones, stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def optional_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A Parquet table, or an empty one with the declared schema where none is. Paths without a scheme are looked up locally."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.schema(schema).parquet(path) if files.exists(found) else spark.createDataFrame([], schema)


def delimited(spark: SparkSession, path: str, schema: StructType, sep: str = "\t") -> DataFrame:
    """A file with a header under a declared schema. A header with other names, or a row that doesn't fit, is an error."""
    return spark.read.csv(path, schema=schema, sep=sep, header=True, enforceSchema=False, mode="FAILFAST", quote='"', escape='"')


def write_delimited(df: DataFrame, path: str, sep: str = "\t") -> None:
    """Header and rows; arrays are joined by ``|``."""
    flat = df.select(*[F.array_join(c, "|").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])
    flat.write.mode("overwrite").csv(path, sep=sep, header=True, quote='"', escape='"')


def json_lines(spark: SparkSession, path: str, schema: StructType, tolerant: bool = False) -> DataFrame:
    """JSON lines with ``file_stem``, the name of each row's file without its ending; bad lines fail, or are left out if tolerant."""
    df = spark.read.schema(schema).json(path, mode="DROPMALFORMED" if tolerant else "FAILFAST")
    return df.withColumn("file_stem", F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", ""))


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that aren't blank, with the stem of their file."""
    df = spark.read.text(path).where(F.trim("value") != "")
    return df.withColumn("file_stem", F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", ""))


def loose_json(reply: Column) -> Column:
    """A JSON value out of a reply in free text: code fences stripped, cut to the outer braces; null if it isn't JSON.

    Where it isn't, a quote between two letters, as abbreviations have it, is taken for a sign and the value is tried again.
    """
    bare = F.regexp_replace(reply, r"```[a-z]*", "")
    inner = F.regexp_extract(bare, r"(?s)(\{.*\}|\[.*\])", 1)
    repaired = F.regexp_replace(inner, r'(?<=\p{L})"(?=\p{L})', "\u05f4")
    return F.coalesce(F.try_parse_json(inner), F.try_parse_json(repaired))


def reply_rows(replies: DataFrame, column: str, fields: list[str]) -> DataFrame:
    """Rows of a tab-separated reply: one per line with as many cells as ``fields``; other lines are left out."""
    lines = replies.select(*[c for c in replies.columns if c != column], F.explode(F.split(column, r"\r?\n")).alias("_line"))
    cells = F.split("_line", "\t")
    return lines.where(F.size(cells) == len(fields)).select(*[c for c in lines.columns if c != "_line"], *[F.trim(cells[k]).alias(f) for k, f in enumerate(fields)])


def aliased(df: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """Columns that a source calls by one of several names: the first that isn't null."""
    return df.select(*[F.coalesce(*[F.col(c) for c in own if c in df.columns]).alias(to) if any(c in df.columns for c in own) else F.lit(None).alias(to) for to, own in names.items()])


def swap_table(df: DataFrame, path: str, checked: Callable[[DataFrame], bool] | None = None) -> None:
    """Writes a table beside its old version and then puts it in its place, so a rebuild never reads its own output.

    If the new table fails ``checked``, it is deleted, the old one stays and an error is raised; if it can't be moved, the old one is put back. For file systems with an atomic rename.
    """
    fresh, kept = f"{path}.new", f"{path}.old"
    df.write.mode("overwrite").parquet(fresh)
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    to, new, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, fresh, kept))
    files = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if checked and not checked(spark.read.parquet(fresh)):
        files.delete(new, True)
        raise ValueError(f"the new table for {path} failed its check")
    files.delete(old, True)
    had = files.exists(to) and files.rename(to, old)
    if not files.rename(new, to):
        if had:
            files.rename(old, to)
        raise OSError(f"{path} could not be replaced")
    files.delete(old, True)


def fan_out(rows: DataFrame, path: str, tables: dict[str, Column]) -> None:
    """Several tables from one scan: each row goes to every table whose condition holds, in a folder ``table=name`` each."""
    named = F.array_compact(F.array(*[F.when(holds, name) for name, holds in tables.items()]))
    rows.withColumn("table", F.explode(named)).write.mode("overwrite").partitionBy("table").parquet(path)


def write_lexicon(entries: DataFrame, path: str, key: str, order: list[Column]) -> None:
    """A lexicon with one entry per key, in order, as a table; values need no quoting. Two entries of a key are an error."""
    twice = entries.groupBy(key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0][key]!r} has more than one entry")
    entries.orderBy(*order).write.mode("overwrite").parquet(path)


#: Rows of a section of a report at most; a longer one is an error, reports are summaries.
MOST_REPORT_ROWS = 1000


def markdown_table(df: DataFrame) -> str:
    """A small result as a Markdown table."""
    rows = df.limit(MOST_REPORT_ROWS + 1).collect()
    if len(rows) > MOST_REPORT_ROWS:
        raise ValueError(f"a report section has more than {MOST_REPORT_ROWS} rows")
    show = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [df.columns, ["---"] * len(df.columns), *[[show(v) for v in r] for r in rows]]
    return "\n".join(f"| {' | '.join(line)} |" for line in lines)


def markdown_report(title: str, sections: dict[str, DataFrame]) -> str:
    """A report of several small results."""
    return "\n\n".join([f"# {title}", *[f"## {name}\n\n{markdown_table(df)}" for name, df in sections.items()]]) + "\n"


def metric_report(spark: SparkSession, path: str, name: str, metrics: list[str]) -> DataFrame:
    """One row per JSON file of metrics, of its name and the metrics wanted, null where a file hasn't one."""
    df = spark.read.option("multiLine", True).json(path)
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    return df.select(stem.alias(name), *[F.col(m) if m in df.columns else F.lit(None).cast("double").alias(m) for m in metrics])


def matched_replies(replies: DataFrame, column: str, fields: list[str], asked: DataFrame, key: str) -> DataFrame:
    """Rows of tab-separated replies that answer what was asked, by ``key``; fences, other lines and unasked keys are left out. Of several answers the last line counts."""
    lines = replies.select(F.posexplode(F.split(column, r"\r?\n")).alias("_n", "_line"), F.xxhash64(column).alias("_r"))
    cells = F.split("_line", "\t")
    rows = lines.where((F.size(cells) == len(fields)) & ~F.col("_line").startswith("```")).select("_r", "_n", *[F.trim(cells[k]).alias(f) for k, f in enumerate(fields)])
    kept = rows.join(asked.select(key).distinct(), key, "left_semi")
    rest = [f for f in fields if f != key]
    return kept.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("_n", "_r")).alias("r")).select(key, *[F.col(f"r.{f}").alias(f) for f in rest])


def flagged(rows: DataFrame, cell: str, flag: str) -> DataFrame:
    """``rows`` with ``ambiguous`` and ``alt`` of a cell that may be a flag, in any case, and another value after a colon."""
    set_ = F.upper(F.coalesce(F.col(cell), F.lit(""))).startswith(flag)
    alt = F.when(set_ & F.contains(F.col(cell), F.lit(":")), F.trim(F.regexp_extract(cell, "(?s):(.*)$", 1)))
    return rows.withColumn("ambiguous", set_).withColumn("alt", alt)


def segments(rows: DataFrame, label: str, column: str) -> DataFrame:
    """``(label, segment)``: every string at any depth of a JSON column, with the label of its row."""
    return rows.select(label, F.explode(json_strings(F.col(column))).alias("segment"))


def markup_records(pages: DataFrame, column: str, block: str, parts: dict[str, str]) -> DataFrame:
    """``(id, parts...)``: records of blocks of markup that begin with ``block``, whose group is the id; each part is the first match inside the block, empty if there is none. Of blocks with one id the first on a page counts."""
    records = pages.withColumn("_b", F.regexp_replace(column, f"({block})", "\u0001$1")).select(F.posexplode(F.split("_b", "\u0001")).alias("_n", "_p"), F.xxhash64(column).alias("_r")).where("_n > 0")
    each = records.select("_r", "_n", F.regexp_extract("_p", block, 1).alias("id"), *[clean_markup(F.regexp_extract("_p", pattern, 1)).alias(name) for name, pattern in parts.items()])
    return each.groupBy("_r", "id").agg(F.min_by(F.struct(*parts), "_n").alias("r")).select("id", *[F.col(f"r.{name}").alias(name) for name in parts])


def self_validating(rows: DataFrame, key: str, value: str, strip: Callable[[Column], Column], excluded: DataFrame) -> DataFrame:
    """Rows of a map whose value strips back to its key, without the excluded keys."""
    return rows.where(strip(F.col(value)) == F.col(key)).join(excluded.select(key).distinct(), key, "left_anti")
