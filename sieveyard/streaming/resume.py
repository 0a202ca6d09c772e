"""Append and resume: files as they come, each row worked on once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def append_new(spark: SparkSession, rows: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, id_col: str = "id") -> int:
    """Works on rows whose ids the output lacks and appends the result; a second call adds nothing."""
    try:
        done = spark.read.parquet(out).select(id_col).distinct()
        rows = rows.join(done, id_col, "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    made = work(rows)
    made.write.mode("append").parquet(out)
    return spark.read.parquet(out).count()


def resumable(spark: SparkSession, source: str, schema: StructType, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, id_col: str = "id") -> StreamingQuery:
    """A file stream that takes all that is new and stops.

    Ids that an earlier batch has written are left out; a replayed batch writes the same rows to its own folder.
    """

    def batch(rows: DataFrame, number: int) -> None:
        new = rows.dropDuplicates([id_col])
        try:
            done = spark.read.parquet(out).where(F.col("batch") != number).select(id_col)
            new = new.join(done.distinct(), id_col, "left_anti")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        new = work(new)
        new.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    return spark.readStream.schema(schema).json(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
