"""Parts that must add up, room on nodes, groups that share elements, and the single owner of a line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def fitted_parts(df: DataFrame, whole: str, parts: Sequence[str], other: str) -> DataFrame:
    """Parts that exceed the whole are scaled down in whole numbers, what rounding leaves going to the first largest scaled one; else other is what they leave.

    So parts and other add up to the whole.
    """
    total = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    scaled = {p: F.when(F.col("__total") > F.col(whole), F.expr(f"`{p}` * `{whole}` div __total")).otherwise(F.col(p)) for p in parts}
    out = df.withColumn("__total", total)
    out = out.withColumns({f"__{p}": v.cast("long") for p, v in scaled.items()})
    out = out.withColumn("__largest", F.greatest(*[F.col(f"__{p}") for p in parts]) if len(parts) > 1 else F.col(f"__{parts[0]}"))
    used = sum((F.col(f"__{p}") for p in parts[1:]), F.col(f"__{parts[0]}"))
    out = out.withColumn("__rest", F.when(F.col("__total") > F.col(whole), F.col(whole) - used).otherwise(F.lit(0)))
    final: dict[str, Column] = {}
    before = F.lit(False)
    for p in parts:
        mine = ~before & (F.col(f"__{p}") == F.col("__largest"))
        final[p] = F.col(f"__{p}") + F.when(mine, F.col("__rest")).otherwise(F.lit(0))
        before = before | (F.col(f"__{p}") == F.col("__largest"))
    left = F.greatest(F.lit(0).cast("long"), F.col(whole) - F.col("__total"))
    kept = [F.col(c) for c in df.columns if c not in parts]
    return out.select(*kept, *[v.alias(p) for p, v in final.items()], left.alias(other))


def capacity_fit(nodes: DataFrame, keys: Sequence[str], cap: str, size: int, reserved: int = 0) -> DataFrame:
    """nodes, room and none per key: how many pieces of size fit beside what is reserved, and on how many nodes none does."""
    fit = F.greatest(F.lit(0), F.floor((F.col(cap) - reserved) / size)).cast("long")
    return nodes.withColumn("__fit", fit).groupBy(*keys).agg(F.count(F.lit(1)).alias("nodes"), F.sum("__fit").alias("room"), F.count_if(F.col("__fit") == 0).alias("none"))


def group_overlap(df: DataFrame, group: str, sub: str, element: str, percent: int) -> DataFrame:
    """group, first, other and common: sub-groups that share at least percent of the smaller side's elements with their group's first sub-group.

    Each element meets the first sub-group's own only, so pairs don't grow with the square of a group.
    """
    rows = df.select(F.col(group).alias("group"), F.col(sub).alias("sub"), F.col(element).alias("e")).dropna().distinct()
    sizes = rows.groupBy("group", "sub").agg(F.count(F.lit(1)).alias("n"))
    heads = sizes.groupBy("group").agg(F.min("sub").alias("first"), F.min_by("n", "sub").alias("n_first"))
    placed = rows.join(heads, "group")
    own = placed.filter("sub = first").select("group", "e")
    both = placed.filter("sub <> first").join(own, ["group", "e"]).groupBy("group", "first", "n_first", F.col("sub").alias("other")).agg(F.count(F.lit(1)).alias("common"))
    sized = both.join(sizes.withColumnRenamed("sub", "other"), ["group", "other"])
    return sized.filter(100 * F.col("common") >= percent * F.least("n_first", "n")).select("group", "first", "other", "common")


def single_owner(df: DataFrame, file: str, line: str, sign: str, id_col: str) -> DataFrame:
    """owner of each line: the only id that is open there, else null. sign is 1 on a line that opens an id, -1 on one that closes it, 0 on others.

    The number of open ids and the sum of their ids are running sums: if one is open, the sum is its id. Repeated openings of an open id and closings
    of one that isn't open count nothing. A file's lines are one task's work.
    """
    own = W.partitionBy(file, id_col).orderBy(line)
    marks = df.filter(F.col(sign) != 0).withColumn("__prev", F.lag(sign).over(own))
    keep = (F.col(sign) == 1) & (F.coalesce(F.col("__prev"), F.lit(-1)) == -1) | (F.col(sign) == -1) & (F.coalesce(F.col("__prev"), F.lit(-1)) == 1)
    marks = marks.withColumn("__d", F.when(keep, F.col(sign)).otherwise(0)).drop("__prev")
    rows = marks.unionByName(df.filter(F.coalesce(F.col(sign), F.lit(0)) == 0).withColumn("__d", F.lit(0)))
    w = W.partitionBy(file).orderBy(line).rowsBetween(W.unboundedPreceding, 0)
    n = F.sum("__d").over(w)
    total = F.sum(F.col("__d") * F.coalesce(F.col(id_col), F.lit(0))).over(w)
    return rows.withColumn("owner", F.when(n == 1, total)).drop("__d")
