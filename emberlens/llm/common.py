"""What the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

#: Words are runs of bytes other than ASCII white space; bytes.split() gives the same ones.
WORD = r"[^\x20\x09-\x0D]+"
#: Spark's setting that deletes what a query has shuffled as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_RECORDS: list[list[str]] = []


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of the tables that are staged within, in a list."""
    made: list[str] = []
    _RECORDS.append(made)
    try:
        yield made
    finally:
        _RECORDS[:] = [x for x in _RECORDS if x is not made]  # remove() would take an equal list of an outer record


def release(spark: SparkSession, paths: list[str], still_read: DataFrame | None = None) -> None:
    """Deletes staged tables, but those that still_read reads."""
    in_use = "\n".join(still_read.inputFiles()) if still_read is not None else ""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        if path.rsplit("/", 1)[-1] not in in_use:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """What queries that run within shuffle is deleted as each ends, not when the driver happens to collect its garbage. The session's own setting is put back."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def staged(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there, and a lost executor loses nothing. What was shuffled for it isn't read again, so it goes at once."""
    path = f"{shared_dir(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    for made in _RECORDS:
        made.append(path)
    with shuffles_deleted(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def utf8(text: str | Column) -> Column:
    """The text's bytes; null is empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def salted_join(rows: DataFrame, by: DataFrame, keys: dict[str, str], how: str = "inner", salts: int = 16) -> DataFrame:
    """rows joined with by on keys (column of rows: column of by), null being a key like others, each key's rows in up to salts tasks.

    by must have one row per key; it is repeated salts times, rows isn't. rows should be read from a written table: a row's salt is its place there.
    """
    left = rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    right = by.withColumn("__of", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    match = F.col("__salt") == F.col("__of")
    for a, b in keys.items():
        match = match & F.col(a).eqNullSafe(F.col(b))
    out = left.join(right, match, how)
    return out.drop("__salt", "__of")
