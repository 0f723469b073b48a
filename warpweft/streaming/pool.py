"""An append-only pool of evidence, fed by streams: each key once, counts as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from warpweft.operators.evidence import slot_verdicts_of_cells


def read_pool(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def once_per_key(stream: DataFrame, key: list[str], time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """The first record of each key; with a time column, keys older than ``delay`` are forgotten."""
    if time:
        return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)
    return stream.dropDuplicates(key)


def append_pool(stream: DataFrame, path: str, checkpoint: str):
    """Appends what is there now and ends; the checkpoint makes a restart resume, each file written once."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def append_new(stream: DataFrame, key: list[str], path: str, checkpoint: str):
    """Appends the rows whose key the pool hasn't yet, one per key, and ends.

    The pool is its own memory: each batch is anti-joined with it, so no state grows and a batch that is run again after a failure adds nothing twice.
    """
    schema = stream.schema

    def add(batch: DataFrame, _: int) -> None:
        new = batch.dropDuplicates(key)
        if _exists(batch.sparkSession, path):
            new = new.join(batch.sparkSession.read.schema(schema).parquet(path).select(*key).distinct(), key, "left_anti")
        new.write.mode("append").parquet(path)

    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def running_counts(stream: DataFrame, key: list[str], path: str, checkpoint: str):
    """Counts per key, kept in the table ``path``, which is written anew after each batch. What is held grows with the keys, not with the rows."""
    counts = stream.groupBy(*key).agg(F.count("*").alias("n"))
    query = counts.writeStream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def running_verdicts(votes: DataFrame, key: list[str], expected: str, heard: str, path: str, checkpoint: str, least: int = 3, share: float = 2 / 3):
    """Verdicts on slots as votes come in: each batch appends ``(batch, key, expected, verdict)`` of slots whose verdict isn't the last one written.

    Only the counts of cells are held by the stream. A batch that is run again replaces its own folder.
    """
    cells = votes.groupBy(*key, expected, heard).agg(F.count("*").alias("n"))

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now = slot_verdicts_of_cells(batch, key, expected, heard, least, share).select(*key, expected, "verdict")
        if _exists(spark, path):
            written = spark.read.parquet(path).where(F.col("batch") < number)
            last = written.groupBy(*key, expected).agg(F.max_by("verdict", "batch").alias("_last"))
            now = now.join(last, [*key, expected], "left").where(~F.col("verdict").eqNullSafe(F.col("_last"))).drop("_last")
        now.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = cells.writeStream.foreachBatch(add).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def windowed_counts(stream: DataFrame, time: str, key: list[str], size: str, delay: str) -> DataFrame:
    """Counts per key and window of time; windows close ``delay`` after their end."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, size), *key).agg(F.count("*").alias("n"))
