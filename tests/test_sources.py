import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from warpweft.sources import tables
from warpweft.streaming import pool


def test_delimited_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a\tb", 1, ["x", "y"]), ('q"q', None, [])], "w string, n int, v array<string>")
    tables.write_delimited(df, str(tmp_path / "t"))
    back = tables.delimited(spark, str(tmp_path / "t"), StructType.fromDDL("w string, n int, v string"))
    assert sorted((r["w"], r["n"], r["v"]) for r in back.collect()) == [("a\tb", 1, "x|y"), ('q"q', None, None)]
    with pytest.raises(Exception):
        tables.delimited(spark, str(tmp_path / "t"), StructType.fromDDL("other string, n int, v string")).collect()


def test_json_lines(spark, tmp_path):
    folder = tmp_path / "j"
    folder.mkdir()
    (folder / "123.jsonl").write_text('{"a": 1}\n{bad\n{"a": 2}\n')
    got = tables.json_lines(spark, str(folder), StructType.fromDDL("a int"), tolerant=True)
    assert sorted((r["a"], r["file_stem"]) for r in got.collect()) == [(1, "123"), (2, "123")]
    (folder / "t.txt").write_text("x\n\n y\n")
    assert tables.text_lines(spark, str(folder / "t.txt")).count() == 2


def test_replies(spark):
    df = spark.createDataFrame([(1, "a\tb\nbad line\nc\t d "), (2, 'see ```json {"k": [1]} ```')], "id int, reply string")
    assert [(r["id"], r["x"], r["y"]) for r in tables.reply_rows(df, "reply", ["x", "y"]).collect()] == [(1, "a", "b"), (1, "c", "d")]
    assert [r[0] for r in df.select(tables.loose_json(F.col("reply")).cast("string")).collect()] == [None, '{"k":[1]}']
    manifest = spark.createDataFrame([(None, "s", "p")], "id string, slug string, path string")
    assert tuple(tables.aliased(manifest, {"id": ["id", "slug"], "audio": ["mp3", "path"], "none": ["x"]}).first()) == ("s", "p", None)


def test_optional_and_swapped_tables(spark, tmp_path):
    path, schema = str(tmp_path / "p"), StructType.fromDDL("a int")
    assert tables.optional_table(spark, path, schema).count() == 0
    for n in (1, 2):
        old = tables.optional_table(spark, path, schema)
        tables.swap_table(old.unionByName(spark.createDataFrame([(n,)], schema)), path)
        spark.catalog.clearCache()
    assert sorted(r["a"] for r in tables.optional_table(spark, path, schema).collect()) == [1, 2]


def test_pool_resumes_and_keeps_each_key_once(spark, tmp_path):
    schema = StructType.fromDDL("k int, v string")
    source, out, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], schema).coalesce(1).write.parquet(source)
    stream = lambda: pool.read_pool(spark, source, schema)
    pool.append_new(stream(), ["k"], out, log)
    spark.createDataFrame([(2, "b"), (3, "c")], schema).coalesce(1).write.mode("append").parquet(source)
    pool.append_new(stream(), ["k"], out, log)
    pool.append_new(stream(), ["k"], out, log)
    assert sorted(r["k"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]
    pool.append_new(stream(), ["k"], out, f"{log}-again")
    assert sorted(r["k"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]
    pool.append_pool(pool.once_per_key(stream(), ["k"]), f"{out}-2", f"{log}-3")
    assert spark.read.parquet(f"{out}-2").count() == 3
    pool.running_counts(stream(), ["k"], f"{out}-3", f"{log}-2")
    assert {r["k"]: r["n"] for r in spark.read.parquet(f"{out}-3").collect()} == {1: 2, 2: 2, 3: 1}


def test_verdicts_change_as_votes_come(spark, tmp_path):
    schema = StructType.fromDDL("k int, e string, h string")
    source, out, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    for n, part in enumerate([[(1, "a", "a"), (2, "a", "b")], [(1, "a", "a"), (1, "a", "a")], [(1, "a", "b")] * 6]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        pool.running_verdicts(pool.read_pool(spark, source, schema), ["k"], "e", "h", out, log)
    spark.catalog.clearCache()
    got = sorted((r["batch"], r["k"], r["verdict"]) for r in spark.read.parquet(out).collect())
    assert got == [(0, 1, "thin"), (0, 2, "thin"), (1, 1, "CONFIRMED"), (2, 1, "FLIP")]


def test_fan_out_lexicon_and_reports(spark, tmp_path):
    df = spark.createDataFrame([("a'b", 2, "LOW"), ('c"d', 1, "HIGH"), ("e|f", 3, "LOW")], "w string, n int, c string")
    tables.fan_out(df, str(tmp_path / "f"), {"all": F.lit(True), "low": F.col("c") == "LOW", "many": F.col("n") > 2})
    assert {r["table"]: r["count"] for r in spark.read.parquet(str(tmp_path / "f")).groupBy("table").count().collect()} == {"all": 3, "low": 2, "many": 1}
    tables.write_lexicon(df, str(tmp_path / "lex"), "w", [F.desc("n"), F.col("w")])
    assert {r["w"] for r in spark.read.parquet(str(tmp_path / "lex")).collect()} == {"a'b", 'c"d', "e|f"}
    with pytest.raises(ValueError):
        tables.write_lexicon(df.unionByName(df), str(tmp_path / "lex2"), "w", [F.col("w")])
    text = tables.markdown_report("R", {"s": df.orderBy("n").limit(2)})
    assert text == "# R\n\n## s\n\n| w | n | c |\n| --- | --- | --- |\n| c\"d | 1 | HIGH |\n| a'b | 2 | LOW |\n" and "e\\|f" in tables.markdown_table(df)
    with pytest.raises(ValueError):
        tables.markdown_table(spark.range(1001))
    for name, body in (("m1", '{"acc": 0.5}'), ("m2", '{"acc": 0.7, "per": 0.1}')):
        (tmp_path / "j").mkdir(exist_ok=True)
        (tmp_path / "j" / f"{name}.json").write_text(body)
    assert [tuple(r) for r in tables.metric_report(spark, str(tmp_path / "j"), "model", ["acc", "per", "wer"]).orderBy("model").collect()] == [("m1", 0.5, None, None), ("m2", 0.7, 0.1, None)]


def test_a_failed_rebuild_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.swap_table(spark.range(3), path)
    with pytest.raises(ValueError):
        tables.swap_table(spark.range(0), path, lambda df: df.count() > 0)
    assert spark.read.parquet(path).count() == 3 and not (tmp_path / "t.new").exists()


def test_replies_are_matched_and_flagged(spark):
    replies = spark.createDataFrame([("```tsv\n1\ta\tAMBIG: b:c\n7\tx\ty\n```",), ("2\tc\tambig\n2\td\t-\n1 a b",)], "reply string")
    asked = spark.createDataFrame([("1",), ("2",), ("3",)], "id string")
    got = tables.flagged(tables.matched_replies(replies, "reply", ["id", "w", "f"], asked, "id"), "f", "AMBIG")
    assert sorted((r["id"], r["w"], r["ambiguous"], r["alt"]) for r in got.collect()) == [("1", "a", True, "b:c"), ("2", "d", False, None)]
    quoted = spark.createDataFrame([('{"a": "ד"ר"}',)], "reply string")
    assert quoted.select(tables.loose_json(F.col("reply")).cast("string")).first()[0] == '{"a":"ד״ר"}'
