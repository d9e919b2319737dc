"""Whose split a line is, and how large: by the task that the line names, by the only task that is open there, or by a group of which all sizes are equal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .timesplit import single_owner


def owned_lines(lines: DataFrame) -> DataFrame:
    """lines with owner, the task a line that names none belongs to. lines: file, line, kind (start, end, split, size), task (null where a line names none), bytes."""
    sign = F.when(F.col("kind") == "start", 1).when(F.col("kind") == "end", -1).otherwise(0)
    return single_owner(lines.withColumn("sign", sign), "file", "line", "sign", "task").drop("sign")


def region_splits(lines: DataFrame) -> DataFrame:
    """file, line, task, bytes and how (named, only task, equal group or null) of each split line.

    A split's task is the one that its line names, else the only one open there. A size line of a known task is that of the task's last split before it, unless that has one already. What is left is taken
    in groups, from a split with none open to the size after which none is open: the splits of a group have its size if all of its sizes are equal, else none; nothing is guessed. Sizes that no split waits for count nothing, nor
    does a group that never closes. lines: as owned_lines gives them; windows run over one file, for groups over its lines of no known task only.
    """
    facts = lines.filter(F.col("kind").isin("split", "size")).withColumn("of", F.coalesce("task", "owner"))
    order = W.partitionBy("file", "of").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    # A size whose line names its task never joins a group; one of the only open task does if that has no split.
    known = facts.filter("of is not null").withColumn("split", F.last(F.when(F.col("kind") == "split", F.col("line")), ignorenulls=True).over(order))
    first = F.min_by("bytes", F.when(F.col("kind") == "size", F.col("line")))
    sized = known.filter("split is not null").groupBy("file", "of", "split").agg(first.alias("bytes"), F.max(F.when(F.col("kind") == "split", F.col("task").isNotNull())).alias("named"))
    exact = sized.select("file", F.col("split").alias("line"), F.col("of").alias("task"), "bytes", F.when(F.col("named"), "named").otherwise("only task").alias("how"))

    loose = facts.filter("of is null").select("file", "line", "kind", "bytes").unionByName(known.filter("split is null and kind = 'size' and task is null").select("file", "line", "kind", "bytes"))
    w = W.partitionBy("file").orderBy("line")
    d = F.when(F.col("kind") == "split", 1).otherwise(-1)
    walked = loose.withColumn("sum", F.sum(d).over(w.rowsBetween(W.unboundedPreceding, 0)))
    low = F.least(F.lit(0), F.coalesce(F.min("sum").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    used = walked.withColumn("low", low).filter((F.col("kind") == "split") | (F.col("sum") >= F.col("low"))).withColumn("open", F.col("sum") - F.col("low"))
    begins = (F.col("kind") == "split") & (F.col("open") == 1)
    grouped = used.withColumn("group", F.sum(begins.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    of_size = F.when(F.col("kind") == "size", F.col("bytes"))
    gates = grouped.groupBy("file", "group").agg(F.min(of_size).alias("lo"), F.max(of_size).alias("hi"), F.count_if(F.col("kind") == "size").alias("sizes"), F.count_if(F.col("kind") == "split").alias("splits"), F.count_if((F.col("kind") == "size") & F.col("bytes").isNull()).alias("unread"))
    fair = gates.filter("sizes = splits and lo = hi and unread = 0").select("file", "group", F.col("lo").alias("size"))
    rest = grouped.filter("kind = 'split'").drop("bytes").join(fair, ["file", "group"], "left")
    return exact.unionByName(rest.select("file", "line", F.lit(None).cast(facts.schema["of"].dataType).alias("task"), F.col("size").alias("bytes"), F.when(F.col("size").isNotNull(), "equal group").alias("how")))
