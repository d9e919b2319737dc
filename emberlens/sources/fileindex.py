"""Which files to read: an index of files by what their paths say, pruned before any byte is read, and an account of what was read and skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .eventlog import read_lines, with_line_numbers


def file_index(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes and modified of every file under path, and what its path says. Files are listed, their contents aren't read."""
    from ..operators.logtext import path_facts

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    hour = F.regexp_extract("file", r"(\d{4}-\d\d-\d\d-\d\d)(?:\D|$)", 1)
    return path_facts(files).withColumn("hour", F.try_to_timestamp(hour, F.lit("yyyy-MM-dd-HH")))


def scoped(index: DataFrame, app: str, began: str, ended: str, hosts: DataFrame | None = None, slack_hours: int = 1) -> DataFrame:
    """index with skipped: why a file isn't read for one application's run, null for those that are.

    Files of another application are skipped; of files of a node or daemon, which name no application, those of hosts that the run didn't use (hosts: host, all if not given), and those of an hour outside the run's, an hour more on both sides.
    A file whose path says none of these is read. began and ended are instants as text.
    """
    rows = index
    if hosts is not None:
        used = F.broadcast(hosts.select(F.lower("host").alias("_used")).distinct())  # an application's hosts, not the cluster's files
        rows = rows.join(used, F.lower("host") == F.col("_used"), "left").withColumn("_known", F.col("_used").isNotNull()).drop("_used")
    else:
        rows = rows.withColumn("_known", F.lit(True))
    slack = F.expr(f"INTERVAL {slack_hours} HOURS")
    early = F.col("hour") + F.expr("INTERVAL 1 HOUR") < F.lit(began).cast("timestamp") - slack
    late = F.col("hour") > F.lit(ended).cast("timestamp") + slack
    node = F.col("app").isNull()
    why = F.when(~node & (F.col("app") != app), "another application").when(node & F.col("host").isNotNull() & ~F.col("_known"), "a host that the run didn't use").when(early, "before the run").when(late, "after the run")
    return rows.withColumn("skipped", why).drop("_known")


def read_scoped(spark: SparkSession, index: DataFrame) -> DataFrame:
    """file, line and value of the files that scoped didn't skip, with what their paths say. Only these are named to the reader, as a listing of any folder would be; without any, no lines."""
    from ..operators.logtext import path_facts

    names = [r["file"] for r in index.filter("skipped is null").select("file").distinct().collect()]
    if not names:
        return path_facts(spark.createDataFrame([], "file string, value string, line long"))
    return path_facts(with_line_numbers(read_lines(spark, names)).drop("block", "row", "size"))


def source_status(index: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Per kind of file and reason: files, bytes, and lines of those that were read; reason is null for these."""
    rows = index
    if lines is not None:
        rows = rows.join(lines.groupBy(F.col("file").alias("_file")).agg(F.count(F.lit(1)).alias("lines")), F.col("file") == F.col("_file"), "left").drop("_file")
    else:
        rows = rows.withColumn("lines", F.lit(None).cast("long"))
    return rows.groupBy("kind", F.col("skipped").alias("reason")).agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.sum("lines").alias("lines"))
