"""Mixing sources to target weights by capped water-filling, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, salted_join, staged


def water_fill(sources: DataFrame, max_epochs: float = 2.0, share: float = 1.5) -> DataFrame:
    """sources(source, source_size, weight) -> with target: share of all sizes, by weight, none above max_epochs times its size.

    Each round offers every open source its weight's part of what is left, clamps those that would get more than they
    may, and hands on the rest. All sources that a round clamps go at once, and a round without one ends it, so
    rounds don't exceed sources. Each round is one aggregate over the sources.
    """
    cap = F.col("source_size") * F.lit(max_epochs)
    state = sources.select("source", "source_size", "weight", cap.alias("cap"), F.lit(False).alias("full"))
    budget = sources.agg((F.coalesce(F.sum("source_size"), F.lit(0)) * F.lit(share)).alias("b")).first()["b"]
    while True:
        left = state.agg(
            F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))), F.lit(0.0)).alias("taken"),
            F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))), F.lit(0)).alias("weight"),
        ).first()
        level = (budget - left["taken"]) / left["weight"] if left["weight"] else 0.0
        over = ~F.col("full") & (F.col("weight") * F.lit(level) > F.col("cap"))
        if not left["weight"] or not state.filter(over).take(1):
            break
        state = staged(state.withColumn("full", F.col("full") | over))
    return state.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * F.lit(level)).alias("target"))


def cycle_weights(sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2), ranges: int = 64) -> DataFrame:
    """weight by the source's place in code point order, null last, weights repeating. One row per source. Sources are numbered in ranges of that order, each after those before it."""
    order = F.col("source").asc_nulls_last()
    ranged = staged(sources.repartitionByRange(ranges, order).withColumn("__range", F.spark_partition_id()))
    counts = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select(F.col("__range").alias("__of"), (F.sum("__n").over(W.orderBy("__range")) - F.col("__n")).alias("__before"))  # one row per range
    own = F.row_number().over(W.partitionBy("__range").orderBy(order)) - 1
    placed = ranged.withColumn("__own", own).join(F.broadcast(before), F.col("__range") == F.col("__of"))
    place = F.col("__before") + F.col("__own")
    return placed.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))).select(*sources.columns, "weight")


def _order(id_col: str, text_col: str, seed: str) -> Column:
    """A seeded hash of id and text: rows of one id, or without one, are apart unless their texts are equal as well."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))))


def source_cuts(sized: DataFrame, weigh: Callable[[DataFrame], DataFrame], max_epochs: float, share: float) -> DataFrame:
    """sized(source, order, part, tie, size) -> one row per source: source_size, target, whole repetitions, and the last order, and tie in it, that gets one more."""
    parts = sized.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    parts = parts.withColumn("before", F.sum("part_size").over(W.partitionBy("source").orderBy("part")) - F.col("part_size"))
    sources = staged(weigh(sized.groupBy("source").agg(F.sum("size").alias("source_size"))))
    targets = staged(
        water_fill(sources, max_epochs, share)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    # Only the range in which a source's rest ends has to be looked at more closely, by groups of rows of one order.
    across = (
        parts.join(targets.select(F.col("source").alias("of"), "rest"), F.col("source").eqNullSafe(F.col("of")))
        .filter((F.col("before") < F.col("rest")) & (F.col("part_size") > 0))
        .groupBy("source")
        .agg(F.max(F.struct("part", "before", "rest")).alias("last"))
        .select(F.col("source").alias("of"), F.col("last.part").alias("of_part"), "last.before", "last.rest")
    )
    groups = sized.filter(F.col("size") > 0).groupBy("source", "part", "order", "size").agg(F.count(F.lit(1)).alias("n"))
    inside = groups.join(across, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part")))
    begins = F.sum(F.col("size") * F.col("n")).over(W.partitionBy("source", "part").orderBy("order", "size")) - F.col("size") * F.col("n")
    # A row is in if more than half of it lies within the rest: of n rows of one order, so many.
    fit = F.ceil((F.col("rest") - F.col("before") - begins) / F.col("size") + F.lit(0.5)) - 1
    fitted = inside.withColumn("fit", F.greatest(F.lit(0), F.least(fit, F.col("n"))))
    last = F.max(F.when(F.col("fit") > 0, F.struct("order", "size", "fit", "n")))
    cuts = staged(fitted.groupBy("source").agg(last.alias("x"), F.max("part").alias("part")).select(F.col("source").alias("of"), "part", "x.*"))
    # Equal rows across the end: those of the lowest ties are in. They are numbered in ranges of ties.
    split = cuts.filter("fit < n").select("of", F.col("order").alias("of_order"), "fit")
    tied = sized.join(split, F.col("source").eqNullSafe(F.col("of")) & (F.col("order") == F.col("of_order"))).select("of", "fit", "tie", F.substring("tie", 1, 3).alias("range"))
    ranges = tied.groupBy("of", "range").agg(F.count(F.lit(1)).alias("n"))
    ranges = ranges.select(F.col("of").alias("r_of"), F.col("range").alias("r_range"), (F.sum("n").over(W.partitionBy("of").orderBy("range")) - F.col("n")).alias("earlier"))
    place = F.row_number().over(W.partitionBy("of", "range").orderBy("tie")) + F.col("earlier")
    numbered = tied.join(ranges, F.col("of").eqNullSafe(F.col("r_of")) & (F.col("range") == F.col("r_range"))).withColumn("place", place)
    ends = numbered.filter("place = fit").select(F.col("of").alias("t_of"), F.col("tie").alias("t_tie"))
    known = cuts.join(ends, F.col("of").eqNullSafe(F.col("t_of")), "left")
    # Without a row that is in, the cut is the range's own name, which is before all its orders; "g" is after all ties.
    known = known.select("of", F.coalesce("order", "part").alias("cut"), F.coalesce("t_tie", F.lit("g")).alias("tie_cut"))
    out = targets.join(known, F.col("source").eqNullSafe(F.col("of")), "left")
    return out.select("source", "source_size", "target", "whole", F.coalesce("cut", F.lit("")).alias("cut"), F.coalesce("tie_cut", F.lit("")).alias("tie_cut"))


def mix(
    docs: DataFrame,
    weigh: Callable[[DataFrame], DataFrame] = cycle_weights,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    max_epochs: float = 2.0,
    share: float = 1.5,
    seed: str = "mix",
    copies: bool = False,
) -> DataFrame:
    """size, source_size, target, repeats and taken (size times repeats) of every row; with copies, the rows of docs themselves, each as often as it is taken.

    A source's rows are repeated floor(target / source_size) times, and the rest of its target is one more repetition of
    its first rows in the order of a seeded hash of id and text: of those that end within the rest, and of the row across its end
    if more than half of it lies within. So a source's taken words are within half a document of its target, whatever ids repeat or are null. The order
    is cut in steps: sums of 4096 hash ranges per source, then of groups of equal rows within the range that the rest ends in, then of single rows within the group.
    Null and empty texts have size 0 and take nothing; a null source is a source; of rows of equal id and text, some may get a repetition
    more than others; an empty table gives an empty one; other columns aren't read, and come back unchanged with copies.
    """
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)} if copies else {id_col: "c0"}
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    order = _order(id_col, text_col, seed)
    rows = staged(
        docs.select(*[F.col(c).alias(k) for c, k in own.items()], F.col(source_col).cast("string").alias("source"), size.alias("size"), order.alias("order")).withColumns(
            {"part": F.substring("order", 1, 3), "tie": F.md5(F.monotonically_increasing_id().cast("string").cast("binary"))}
        )
    )
    cuts = source_cuts(rows.select("source", "order", "part", "tie", "size"), weigh, max_epochs, share).withColumnRenamed("source", "of")
    more = (F.col("order") < F.col("cut")) | (F.col("order") == F.col("cut")) & (F.col("tie") <= F.col("tie_cut"))
    # A source may hold a third of all rows.
    joined = salted_join(rows, cuts, {"source": "of"}, salts=256).withColumn("repeats", F.when(F.col("size") > 0, F.col("whole") + F.when(more, 1).otherwise(0)).otherwise(0).cast("long"))
    if copies:
        again = joined.filter(F.col("repeats") > 0).withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats"))))
        return again.select(*[F.col(k).alias(c) for c, k in own.items()])
    return joined.select(F.col("c0").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), "repeats")
