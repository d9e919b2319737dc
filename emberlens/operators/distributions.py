"""Distributions per key: summaries, log-scaled histograms, medians, modes, top-k and samples.

Every function takes and returns DataFrames, names its columns by parameter, and groups by the given keys, so it runs on log
tables and on any other. Rows whose value is null count nowhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def dist_summary(df: DataFrame, keys: Sequence[str], v: str, probs: Sequence[float] = (0.5, 0.95)) -> DataFrame:
    """n, total, lo, hi and nearest-rank quantiles p50, p95, ... of v per key; negative values count as 0.

    Equal values of a key are counted first, in tasks and after the shuffle, so what is sorted per key are its different values.
    """
    w = W.partitionBy(*keys)
    counts = df.filter(F.col(v).isNotNull()).groupBy(*keys, F.greatest(F.col(v), F.lit(0)).cast(df.schema[v].dataType).alias("__x")).agg(F.count(F.lit(1)).alias("__n"))
    ranked = counts.withColumns({"__upto": F.sum("__n").over(w.orderBy("__x").rowsBetween(W.unboundedPreceding, 0)), "__all": F.sum("__n").over(w)})
    rank = lambda p: F.greatest(F.lit(1), F.col("__all") - F.floor(F.col("__all") - F.col("__all") * F.lit(p)))
    quantiles = [F.min(F.when(F.col("__upto") >= rank(p), F.col("__x"))).alias(f"p{round(p * 100):d}") for p in probs]
    return ranked.groupBy(*keys).agg(F.sum("__n").alias("n"), F.sum(F.col("__x") * F.col("__n")).alias("total"), F.min("__x").alias("lo"), F.max("__x").alias("hi"), *quantiles)


def log_bucket(v: Column) -> Column:
    """Bucket of a whole number: itself below 16, else 16 buckets to each doubling. Negative numbers count as 0."""
    x = F.greatest(v.cast("long"), F.lit(0).cast("long"))
    e = F.length(F.bin(x)) - 1
    fine = F.shiftrightunsigned(x, 0)  # keeps the type long
    within = F.call_function("shiftright", fine, e - 4).bitwiseAND(F.lit(15))
    return F.when(x < 16, x).otherwise(16 + (e - 4) * 16 + within).cast("long")


def log_bucket_start(b: Column) -> Column:
    """The smallest number of a bucket."""
    e = F.floor((b - 16) / 16).cast("int") + 4
    return F.when(b < 16, b).otherwise(F.call_function("shiftleft", F.lit(16).cast("long") + (b - 16) % 16, e - 4)).cast("long")


def log_hist(df: DataFrame, keys: Sequence[str], v: str, max_bins: int = 40) -> DataFrame:
    """lo, hi and n of at most about max_bins bars per key; bars join equally many fine buckets, empty ones are left out."""
    fine = df.filter(F.col(v).isNotNull()).withColumn("bucket", log_bucket(F.col(v)))
    counts = fine.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    w = W.partitionBy(*keys)
    low, high = F.min("bucket").over(w), F.max("bucket").over(w)
    width = F.greatest(F.lit(1), F.floor((high - low + max_bins) / max_bins)).cast("long")
    bars = counts.withColumn("bar", F.floor((F.col("bucket") - low) / width).cast("long"))
    return bars.groupBy(*keys, "bar").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each key in the given order, with rank from 1. Spark cuts each task's rows to k before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long")
    return df.withColumn("rank", rank).filter(F.col("rank") <= k)


def sample_per_key(df: DataFrame, keys: Sequence[str], id_col: str, n: int, seed: int = 0) -> DataFrame:
    """n rows per key by the smallest seeded hash of their id: uniform, and the same in every run."""
    return top_k(df, keys, [F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), F.col(id_col)], n).drop("rank")


def budgeted_n(counts: DataFrame, n_col: str, n: int, budget: int, floor: int) -> int:
    """n halved until the sum of min(count, n) over all keys is within budget, but not under floor. One aggregate, however many keys."""
    steps = [n]
    while steps[-1] // 2 >= floor:
        steps.append(steps[-1] // 2)
    totals = counts.agg(*[F.sum(F.least(F.col(n_col), F.lit(s))).alias(f"s{i}") for i, s in enumerate(steps)]).first()
    return next((s for i, s in enumerate(steps) if (totals[f"s{i}"] or 0) <= budget), steps[-1])


def median_mid(v: str) -> Column:
    """Mean of the two middle values, cut to a whole number."""
    return F.expr(f"percentile({v}, 0.5)").cast("long")


def median_low(v: str) -> Column:
    """Nearest-rank median."""
    return F.expr(f"percentile_disc(0.5) within group (order by {v})").cast("long")


def median_high(df: DataFrame, keys: Sequence[str], v: str) -> DataFrame:
    """The upper of the two middle values per key, as median: place n div 2 from 0 in ascending order."""
    w = W.partitionBy(*keys)
    ranked = df.filter(F.col(v).isNotNull()).withColumn("place", F.row_number().over(w.orderBy(v)) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    return ranked.filter(F.col("place") == F.expr("n div 2")).select(*keys, F.col(v).alias("median"))


def mode_of(df: DataFrame, keys: Sequence[str], v: str, largest: bool = True) -> DataFrame:
    """The most frequent value per key and how often it occurs; of equally frequent ones the largest, or else the smallest."""
    counts = df.filter(F.col(v).isNotNull()).groupBy(*keys, v).agg(F.count(F.lit(1)).alias("n"))
    order = [F.desc("n"), F.desc(v) if largest else F.asc(v)]
    return top_k(counts, keys, order, 1).drop("rank")


def slow_rows(df: DataFrame, keys: Sequence[str], v: str, times: float = 2.0, more: float = 1000.0) -> DataFrame:
    """Rows of at least times their key's middle value (mean of the two middles) and at least more above it."""
    mid = df.filter(F.col(v).isNotNull()).groupBy(*keys).agg(F.expr(f"percentile({v}, 0.5)").alias("median"))
    slow = (F.col(v) >= F.col("median") * times) & (F.col(v) - F.col("median") >= more)
    return df.join(mid, list(keys)).filter(slow)


def straggler_levels(df: DataFrame, keys: Sequence[str], v: str) -> DataFrame:
    """p50, p95, top and level per key with a median above 0: 3, 2 or 1 where p95 is 5, 3 or 2 times the median or more."""
    d = dist_summary(df, keys, v, (0.5, 0.95)).filter("p50 > 0")
    level = F.when(F.col("p95") >= 5 * F.col("p50"), 3).when(F.col("p95") >= 3 * F.col("p50"), 2).when(F.col("p95") >= 2 * F.col("p50"), 1).otherwise(0)
    return d.select(*keys, "p50", "p95", F.col("hi").alias("top"), level.alias("level"))
