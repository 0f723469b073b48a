"""Session helpers: where to checkpoint and to keep what queries write."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for ``checkpoint()``: the one the cluster names in ``spark.checkpoint.dir``.

    Only on a local master, as in tests on one machine, a temporary folder is made where it is unset; it is deleted when Python ends. On a cluster an unset
    folder is an error, since each worker would write to its own disk.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if named:
        if not current:
            sc.setCheckpointDir(named)
        return named
    if not current:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all workers share")
        current = tempfile.mkdtemp(prefix="warpweft-checkpoint-")
        atexit.register(shutil.rmtree, current, ignore_errors=True)
        sc.setCheckpointDir(current)
    return current


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder of its own beside the checkpoints."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, its lineage cut; survives lost executors. Its files go with the frame where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Spark's setting to delete a query's shuffle files when it ends, instead of when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, free_shuffles: bool = False) -> tuple[DataFrame, str]:
    """``df`` written as a table in the shared folder and read back, and where it is: cuts lineage like ``checkpointed``, but computes ``df`` once, takes less room, and can be given up by ``forgotten``.

    With ``free_shuffles`` the shuffle files of the writing go when it has ended.
    """
    spark = df.sparkSession
    path, before = work_folder(spark, "table"), spark.conf.get(CLEANUP, None)
    if free_shuffles:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if free_shuffles:
            spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def forgotten(spark: SparkSession, path: str) -> None:
    """Deletes a table that ``written`` wrote and nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def sent_whole(df: DataFrame, most: int = 10_000) -> DataFrame:
    """A list made by hand, marked to be sent whole to every task; one with more than ``most`` rows is an error."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"a list that is sent whole has more than {most} rows")
    return F.broadcast(df)
