"""Tables that cut lineage: Parquet in the folder every executor shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.  Where it is unset: a temporary one if all runs in this process, else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + os.path.join(tempfile.gettempdir(), "sieveyard-stage")
    return at.rstrip("/")


def _delete(spark: SparkSession, path: str, now: bool) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if now:
        files.delete(at, True)
    else:
        files.deleteOnExit(at)


def stage(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    A lost executor then costs the tasks it was running and nothing before this table.
    The folder goes when the application ends, or with ``drop``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.options(compression="zstd", **options).parquet(path)
    _delete(spark, path, now=False)
    out = spark.read.schema(df.schema).parquet(path)
    out._sieveyard_path = path
    return out


def drop(staged: DataFrame) -> None:
    """Delete a table from ``stage`` that nothing will read again."""
    _delete(staged.sparkSession, staged._sieveyard_path, now=True)
