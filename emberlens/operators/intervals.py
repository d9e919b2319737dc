"""Intervals and instants per key: concurrency, gaps, unions, as-of joins, runs and sessions.

Times are whole numbers (milliseconds in the log tables) or timestamps cast to them. keys must not be empty for tables of
any size: every function shuffles by them, so each key's rows are one task's work at most, and sums per instant come first
where a key may hold many rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema


def _steps(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """One row of +1 for each start and one of -1 for each end; an interval without an end only adds."""
    both = F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("d")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("d")))
    return df.filter(F.col(start).isNotNull()).select(*keys, F.inline(both)).filter(F.col("t").isNotNull())


def step_series(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """t and running: how many intervals are open from each instant of change on. Changes of one instant are one row."""
    changes = _steps(df, keys, start, end).groupBy(*keys, "t").agg(F.sum("d").alias("d"))
    running = F.sum("d").over(W.partitionBy(*keys).orderBy("t"))
    return changes.select(*keys, "t", running.alias("running"))


def peak_concurrency(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """peak: most intervals open at once per key, an end at an instant coming before a start; at: the first such instant."""
    changes = _steps(df, keys, start, end).groupBy(*keys, "t", "d").agg(F.sum("d").alias("change"))
    running = F.sum("change").over(W.partitionBy(*keys).orderBy("t", "d"))
    return changes.withColumn("running", running).groupBy(*keys).agg(F.max("running").alias("peak"), F.expr("max_by(t, struct(running, -t))").alias("at"))


def busy_buckets(df: DataFrame, keys: Sequence[str], start: str, end: str, width: int, origin: str) -> DataFrame:
    """bucket and busy: exact time that intervals take of each bucket of width from the key's origin column on.

    No interval is spread over its buckets: counts and offsets of starts and ends per bucket, and their running net, are enough.
    Buckets without a start or an end in which nothing changes are left out; their busy time is running times width.
    """
    first = F.greatest(F.col(start) - F.col(origin), F.lit(0))
    both = F.array(F.struct(first.alias("off"), F.lit(1).alias("d")), F.struct(F.greatest(F.col(end) - F.col(origin), F.lit(0)).alias("off"), F.lit(-1).alias("d")))
    steps = df.filter(F.col(start).isNotNull() & F.col(end).isNotNull()).select(*keys, F.inline(both))
    sums = (
        steps.withColumn("bucket", F.expr(f"off div {width}"))
        .groupBy(*keys, "bucket")
        .agg(F.sum("d").cast("long").alias("net"), F.sum(F.col("d") * (width * (F.col("bucket") + 1) - F.col("off"))).cast("long").alias("part"))
    )
    before = F.coalesce(F.sum("net").over(W.partitionBy(*keys).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return sums.select(*keys, "bucket", (before * width + F.col("part")).cast("long").alias("busy"), (before + F.col("net")).cast("long").alias("running"))


def bucket_width(span: int, most: int = 2000, first: int = 100) -> int:
    """first doubled until a span has fewer than most buckets."""
    width = first
    while span // width >= most:
        width *= 2
    return width


def _reach(keys: Sequence[str], start: str, end: str) -> Column:
    """The latest end among a key's earlier intervals."""
    return F.max(end).over(W.partitionBy(*keys).orderBy(start, end).rowsBetween(W.unboundedPreceding, -1))


def gaps(df: DataFrame, keys: Sequence[str], lo: str, hi: str, start: str, end: str, least: int = 1) -> DataFrame:
    """gap_start and gap_end of at least least where no interval of the key is open between its lo and hi columns, head and tail included.

    An interval without an end lasts to hi. Keys without intervals have no row here.
    """
    a = F.greatest(F.col(start), F.col(lo))
    b = F.least(F.coalesce(F.col(end), F.col(hi)), F.col(hi))
    inside = df.filter(F.col(start).isNotNull()).select(*keys, F.col(lo).alias("lo"), F.col(hi).alias("hi"), a.alias("a"), b.alias("b")).filter("b >= a")
    before = F.coalesce(_reach(keys, "a", "b"), F.col("lo"))
    between = inside.withColumn("gap_start", before).select(*keys, "gap_start", F.col("a").alias("gap_end"))
    tail = inside.groupBy(*keys).agg(F.max("b").alias("gap_start"), F.max("hi").alias("gap_end"))
    return between.unionByName(tail).filter(F.col("gap_end") - F.col("gap_start") >= least)


def union_length(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """covered: time that at least one of the key's intervals is open."""
    new = F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), F.coalesce(F.col("reach"), F.col(start))))
    rows = df.filter(F.col(start).isNotNull() & (F.col(end) >= F.col(start))).withColumn("reach", _reach(keys, start, end))
    return rows.groupBy(*keys).agg(F.sum(new).cast("long").alias("covered"))


def _level(lo: Column, hi: Column) -> Column:
    """The power of four, as its number of bits, that an interval fits into: it lies in one or two slots of that width."""
    return F.least(F.ceil(F.log2(hi - lo + 1) / 2) * 2, F.lit(62)).cast("int")


def latest_containing(points: DataFrame, intervals: DataFrame, keys: Sequence[str], t: str, start: str, end: str, carry: Sequence[str]) -> DataFrame:
    """Each point with carry of the interval of its key that holds it and started last, ties to the smallest carry; null if none does. Times are whole numbers.

    An interval is dealt to the one or two slots of the power of four that it fits into, and a point to its slot of each such width. Each slot is walked in order; what is held
    are open intervals, of which those that one begun later outlasts are dropped. So no pairs of a key are formed and work grows with rows times widths. Of intervals without an end, which hold all that comes after, the last counts.
    What a point gets is its key's and instant's, so points are looked up once per key and instant, whatever their ids. Points or intervals with a null key or time meet nothing.
    """
    of = F.struct(*[F.col(c) for c in carry])
    begun = intervals.filter(F.col(start).isNotNull()).dropna(subset=list(keys)).select(*keys, F.col(start).cast("long").alias("lo"), F.col(end).cast("long").alias("hi"), of.alias("of"))
    dealt = begun.filter("hi >= lo").withColumn("_level", _level(F.col("lo"), F.col("hi")))
    kind = dealt.schema["of"].dataType
    in_slots = dealt.select(*keys, "_level", F.expr("explode(sequence(shiftright(lo, _level), shiftright(hi, _level)))").alias("_slot"), F.col("lo").alias("_at"), F.lit(0).alias("_point"), "hi", "of")
    at = points.dropna(subset=[*keys, t]).select(*keys, F.col(t).cast("long").alias("_t")).distinct()
    levels = dealt.agg(F.collect_set("_level").alias("_levels"))  # one row of at most 32 levels
    ups = at.crossJoin(F.broadcast(levels)).select(*keys, F.explode("_levels").alias("_level"), F.col("_t").alias("_at"))
    ups = ups.select(*keys, "_level", F.expr("shiftright(_at, _level)").alias("_slot"), "_at", F.lit(1).alias("_point"), F.lit(None).cast("long").alias("hi"), F.lit(None).cast(kind).alias("of"))
    width = len(keys)

    def walk(rows: Iterator[tuple]) -> Iterator[tuple]:
        slot, held = None, []
        for row in rows:
            if row[: width + 2] != slot:
                slot, held = row[: width + 2], []
            now, point, hi, what = row[width + 2 :]
            while held and (held[-1][1] < now if point else held[-1][1] <= hi):
                held.pop()
            if not point:
                held.append((now, hi, what))
            elif held:
                yield (*row[:width], now, -held[-1][0], held[-1][2])

    found = in_order(in_slots.unionByName(ups), [*keys, "_level", "_slot"], ["_at", "_point", F.desc("of")], walk, _with(dealt, keys, _t=T.LongType(), late=T.LongType(), of=kind))
    ended = found.select(*keys, "_t", F.struct("late", "of").alias("best"))
    ranked = F.struct((-F.col("lo")).alias("late"), "of").alias("best")
    lasting = begun.filter("hi is null").groupBy(*keys, "lo").agg(F.min("of").alias("of")).select(*keys, "lo", ranked)
    open_ = latest_before(at, lasting, keys, "_t", "lo", ["best"]).filter("best is not null").select(*keys, "_t", "best")
    held = ended.unionByName(open_).groupBy(*keys, "_t").agg(F.min("best").alias("_best")).withColumnsRenamed({k: f"_of_{k}" for k in keys})
    match = F.col(t).cast("long") == F.col("_t")
    for k in keys:
        match = match & (F.col(k) == F.col(f"_of_{k}"))
    # A file's size tells little of what is looked up in it, so this join isn't left to a guess that might broadcast it.
    return points.join(held.hint("merge"), match, "left").select(*points.columns, *[F.col(f"_best.of.{c}").alias(c) for c in carry])


def latest_before(points: DataFrame, facts: DataFrame, keys: Sequence[str], t: str, fact_t: str, carry: Sequence[str]) -> DataFrame:
    """Each point with carry of the key's last fact at or before it: one union and one running window, no join of pairs."""
    fact = F.struct(*[F.col(c) for c in carry])
    kind = facts.select(fact.alias("f")).schema["f"].dataType
    left = points.select(*keys, F.col(t).alias("at"), F.lit(1).alias("point"), F.struct(*[F.col(c) for c in points.columns]).alias("row"), F.lit(None).cast(kind).alias("fact"))
    row = points.select(F.struct(*[F.col(c) for c in points.columns]).alias("r")).schema["r"].dataType
    right = facts.select(*keys, F.col(fact_t).alias("at"), F.lit(0).alias("point"), F.lit(None).cast(row).alias("row"), fact.alias("fact"))
    w = W.partitionBy(*keys).orderBy("at", "point", "fact").rowsBetween(W.unboundedPreceding, 0)
    last = left.unionByName(right).withColumn("last", F.last("fact", ignorenulls=True).over(w)).filter("point = 1")
    return last.select(*[F.col(f"row.{c}").alias(c) for c in points.columns], *[F.col(f"last.{c}").alias(c) for c in carry])


def runs(df: DataFrame, keys: Sequence[str], t: str, v: str, gap: int) -> DataFrame:
    """ups and downs per key: runs of changes of v in one direction; a change in the same direction over gap later begins a new one."""
    w = W.partitionBy(*keys).orderBy(t)
    moves = df.withColumn("way", F.signum(F.col(v) - F.lag(v).over(w))).filter("way <> 0")
    new = F.lag("way").over(w).isNull() | (F.lag("way").over(w) != F.col("way")) | (F.col(t) - F.lag(t).over(w) > gap)
    begun = moves.withColumn("new", new)
    return begun.groupBy(*keys).agg(*[F.sum(F.when(F.col("new") & (F.col("way") == way), 1).otherwise(0)).alias(name) for way, name in ((1, "ups"), (-1, "downs"))])


def fold_within(df: DataFrame, keys: Sequence[str], t: str, gap: int, longest: str | None = None) -> DataFrame:
    """n, first and last of each session: a row over gap after the one before it begins a new one."""
    w = W.partitionBy(*keys).orderBy(t)
    more = [F.max(longest).alias("longest")] if longest else []
    marked = df.filter(F.col(t).isNotNull()).withColumn("new", F.when(F.col(t) - F.lag(t).over(w) <= gap, 0).otherwise(1))
    island = F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0))
    return marked.withColumn("island", island).groupBy(*keys, "island").agg(F.count(F.lit(1)).alias("n"), F.min(t).alias("first"), F.max(t).alias("last"), *more).drop("island")


def in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], walk: Callable[[Iterator[tuple]], Iterator[tuple]], schema: T.StructType) -> DataFrame:
    """What walk makes of the rows, in order and each key's together. Rows are streamed: a key, however large, is one task's time but never held."""
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = walk(row for b in batches for row in zip(*[c.to_pylist() for c in b.columns]))
        while rows := list(islice(out, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _with(df: DataFrame, keys: Sequence[str], **more: T.DataType) -> T.StructType:
    return T.StructType([df.schema[k] for k in keys] + [T.StructField(n, t) for n, t in more.items()])


def anchored_batches(df: DataFrame, keys: Sequence[str], t: str, span: int) -> DataFrame:
    """n, first and last of each batch: a row over span after its batch's first begins a new one. Each cut depends on the one before it, so a key's instants are walked in order."""
    instants = df.filter(F.col(t).isNotNull()).groupBy(*keys, F.col(t).cast("long").alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    width = len(keys)

    def walk(rows: Iterator[tuple]) -> Iterator[tuple]:
        key = None
        for row in rows:
            now, n = row[width:]
            if key == row[:width] and now - first <= span:
                total, last = total + n, now
                continue
            if key is not None:
                yield (*key, total, first, last)
            key, total, first, last = row[:width], n, now, now
        if key is not None:
            yield (*key, total, first, last)

    return in_order(instants, keys, ["_t"], walk, _with(df, keys, n=T.LongType(), first=T.LongType(), last=T.LongType()))


def pair_next(df: DataFrame, keys: Sequence[str], t: str, kind: str, opens: str, closes: str) -> DataFrame:
    """open_t and close_t per key: each close takes the earliest unused open before it; what finds none stays alone.

    A close counts only if more opens than used closes came before it, which a running minimum of the balance tells, so opens and closes are paired by number.
    """
    rows = df.select(*keys, F.col(t).alias("t"), F.when(F.col(kind) == opens, 1).when(F.col(kind) == closes, -1).alias("d")).filter("d is not null")
    order = W.partitionBy(*keys).orderBy("t", F.desc("d"))
    walked = rows.withColumn("balance", F.sum("d").over(order.rowsBetween(W.unboundedPreceding, 0)))
    least = F.least(F.lit(0), F.coalesce(F.min("balance").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    used = walked.withColumn("alone", (F.col("d") == -1) & (F.col("balance") < least))
    number = F.row_number().over(W.partitionBy(*keys, "d", "alone").orderBy("t"))
    numbered = used.withColumn("k", number)
    names = [F.col(f"o.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    o, c = numbered.filter("d = 1").alias("o"), numbered.filter("d = -1 and not alone").alias("c")
    match = F.col("o.k") == F.col("c.k")
    for n in names:
        match = match & n
    pairs = o.join(c, match, "left").select(*[F.col(f"o.{k}").alias(k) for k in keys], F.col("o.t").alias("open_t"), F.col("c.t").alias("close_t"))
    single = numbered.filter("alone").select(*keys, F.lit(None).cast(rows.schema["t"].dataType).alias("open_t"), F.col("t").alias("close_t"))
    return pairs.unionByName(single)


def slot_pack(df: DataFrame, keys: Sequence[str], id_col: str, start: str, end: str) -> DataFrame:
    """slot per row, from 0: in order of start, the lowest one that is free. A key's rows are walked in order; what is held are the slots in use."""
    rows = df.select(*keys, F.col(id_col).alias("_id"), F.col(start).cast("long").alias("_start"), F.col(end).cast("long").alias("_end")).dropna(subset=["_start", "_end"])
    width = len(keys)

    def walk(rows: Iterator[tuple]) -> Iterator[tuple]:
        key, busy, free = None, [], []
        for row in rows:
            if row[:width] != key:
                key, busy, free = row[:width], [], []
            of, a, b = row[width:]
            while busy and busy[0][0] <= a:
                heapq.heappush(free, heapq.heappop(busy)[1])
            slot = heapq.heappop(free) if free else len(busy)
            heapq.heappush(busy, (b, slot))
            yield (*key, of, slot)

    return in_order(rows, keys, ["_start", "_id"], walk, _with(df, keys, **{id_col: rows.schema["_id"].dataType, "slot": T.LongType()}))


def overlap_join(a: DataFrame, b: DataFrame, keys: Sequence[str], start: str, end: str, slack: int = 0) -> DataFrame:
    """Pairs of equal keys whose intervals touch within slack; columns of a and b as structs a and b. Both tables have the same key, start and end names.

    Times are whole numbers. An interval's level is the power of four that it fits into, and it lies in one or two slots of each such width. A pair meets at the higher of its
    levels, in the slot of its later start, so that intervals far apart never meet, however many rows a key has and however long some intervals are.
    """

    def spans(df: DataFrame, name: str, more: int) -> DataFrame:
        lo, hi = F.least(start, end).cast("long") - more, F.greatest(start, end).cast("long") + more
        rows = df.filter(F.col(start).isNotNull() & F.col(end).isNotNull()).select(*keys, *[F.col(c).alias(f"_{name}_{c}") for c in df.columns], lo.alias("_lo"), hi.alias("_hi"))
        return rows.withColumn("_home", _level(F.col("_lo"), F.col("_hi")))

    def dealt(rows: DataFrame, other: DataFrame, name: str) -> DataFrame:
        levels = other.agg(F.collect_set("_home").alias("_levels"))  # one row of at most 32 levels
        slots = """inline(flatten(transform(array_union(array(_home), filter(_levels, l -> l > _home)), l ->
            transform(sequence(shiftright(_lo, l), shiftright(_hi, l)), s -> named_struct('_level', l, '_slot', s)))))"""
        return rows.crossJoin(F.broadcast(levels)).select(*keys, *[c for c in rows.columns if c.startswith(f"_{name}_")], F.col("_lo").alias(f"_lo_{name}"), F.col("_home").alias(f"_home_{name}"), F.expr(slots))

    left, right = spans(a, "a", slack), spans(b, "b", 0)
    met = dealt(left, right, "a").join(dealt(right, left, "b"), [*keys, "_level", "_slot"])
    once = F.expr("_level = greatest(_home_a, _home_b) and _slot = shiftright(greatest(_lo_a, _lo_b), _level)")
    near = (F.col(f"_a_{start}") <= F.col(f"_b_{end}") + slack) & (F.col(f"_a_{end}") >= F.col(f"_b_{start}") - slack)
    structs = [F.struct(*[F.col(f"_{name}_{c}").alias(c) for c in df.columns]).alias(name) for name, df in (("a", a), ("b", b))]
    return met.filter(once & near).select(*keys, *structs)


def open_at_end(starts: DataFrame, ends: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Starts without an end of the same keys."""
    return starts.join(ends, list(keys), "left_anti")

