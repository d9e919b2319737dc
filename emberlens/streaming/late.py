"""Rows that come later than a stream's watermark, kept aside and counted instead of dropped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def late_kept(path: str, t: str, delay_ms: int) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that writes each batch's rows under path/rows, and under path/late those more than delay_ms older than the latest time of all batches before it.

    The latest time so far is written with each batch, under path/marks, after its rows. A batch that runs again overwrites what it wrote, so each row is kept once, and a restarted query goes on where it was. The first batch has no late
    rows, and rows without a time are never late. path is a folder that all executors share.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = None
        if batch_id > 0:
            before = spark.read.schema("mark timestamp").parquet(f"{path}/marks/batch={batch_id - 1}").agg(F.max("mark").alias("mark")).first()["mark"]
        limit = F.lit(before).cast("timestamp") - F.make_dt_interval(secs=F.lit(delay_ms / 1000))
        is_late = F.coalesce(F.col(t) < limit, F.lit(False)) if before is not None else F.lit(False)
        rows = batch.withColumn("_late", is_late).persist()
        try:
            rows.filter(~F.col("_late")).drop("_late").write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
            rows.filter("_late").drop("_late").write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
            mark = rows.agg(F.max(F.col(t).cast("timestamp")).alias("mark")).select(F.greatest("mark", F.lit(before).cast("timestamp")).alias("mark"))
            mark.write.mode("overwrite").parquet(f"{path}/marks/batch={batch_id}")
        finally:
            rows.unpersist()

    return keep


def kept_rows(spark: SparkSession, path: str, schema: str, late: bool = False) -> DataFrame:
    """Rows of all batches so far, or the late ones, with the batch that brought them."""
    return spark.read.schema(f"{schema}, batch int").parquet(f"{path}/{'late' if late else 'rows'}")


def late_counts(late: DataFrame, keys: list[str], t: str) -> DataFrame:
    """n, first and last time of the late rows of each key and batch."""
    return late.groupBy(*keys, "batch").agg(F.count(F.lit(1)).alias("n"), F.min(t).alias("first"), F.max(t).alias("last"))
