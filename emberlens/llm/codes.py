"""Vector codes: parts of vectors assigned to small codebooks by ball k-means, in exact integer arithmetic."""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import shared_dir
from .common import salted_join, staged

#: Numbers in a block of vectors, and its rows at most. A block is a row of the intermediate tables and is worked on at once.
BLOCK, BLOCK_ROWS = 1 << 20, 16_384
#: Sums are passed on in limbs of so many bits, so that a sum of limbs fits into 64 bits.
LIMB = 40


def kept_vectors(embeddings: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, label and vector of doubles of the rows that take part: those with a vector of finite components."""
    v = F.col("v")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    rows = embeddings.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.filter(v.isNotNull() & finite)


def blocks(rows: DataFrame, dim: int) -> DataFrame:
    """block, ids, labels and data (doubles, each row padded with zeros to dim) of stretches of rows. A block is named by its place, so that a task that runs again makes the same ones."""
    per = max(1, min(BLOCK_ROWS, BLOCK // max(1, dim)))
    schema = T.StructType([T.StructField("block", T.StringType()), T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)), T.StructField("labels", T.ArrayType(rows.schema["label"].dataType)), T.StructField("data", T.BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, done = [], 0, 0
        of = TaskContext.get().partitionId()

        def out(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts)
            lists = t["v"].combine_chunks()
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            data = np.zeros((len(sizes), dim))
            at = np.arange(dim)[None, :] < sizes[:, None]
            data[at] = lists.flatten().to_numpy(zero_copy_only=False)
            one = lambda c: pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), t[c].combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([f"{of}-{done}"]), one("id"), one("label"), pa.array([data.tobytes()], pa.binary())], names=["block", "ids", "labels", "data"])

        for b in batches:
            while b.num_rows:
                part = b.slice(0, per - n)
                held.append(part)
                n += part.num_rows
                b = b.slice(part.num_rows)
                if n == per:
                    yield out(held)
                    held, n, done = [], 0, done + 1
        if n:
            yield out(held)

    return rows.mapInArrow(pack, schema)


def assign(x: np.ndarray, codes: np.ndarray, radii: np.ndarray, old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry of each row, its squared distance (-1 where it wasn't needed), and the new squared radii of the entries' balls.

    Rows of an entry are its ball, its radius the largest distance among them. Entries further from an entry than twice the radius can't be nearer to any
    of its rows: the others are its neighbours. If neither the entry nor any neighbour has moved since the last time, the ball stays as it is. Else each row has a ring:
    the neighbours within twice its own distance. Rows without any are the stable core; the others meet the neighbours of their ring only.
    """
    k = len(new)
    diff = new[:, None, :] - new[None, :, :]
    between = (diff * diff).sum(axis=2)
    moved = (new != old).any(axis=1) if new.shape[1] else np.zeros(k, bool)
    best, least = codes.copy(), np.full(len(x), -1, x.dtype)
    skipped = []
    for i in range(k):
        rows = np.flatnonzero(codes == i)
        if not len(rows):
            continue
        near = np.array([j != i and between[i, j] <= 4 * float(radii[i]) for j in range(k)], bool)
        if float(radii[i]) >= 0 and not moved[i] and not moved[near].any():
            skipped.append(i)
            continue
        mine = x[rows]
        d = mine - new[i]
        own = (d * d).sum(axis=1)
        least[rows] = own
        reach = own.max()
        others = [j for j in range(k) if j != i and between[i, j] <= 4 * reach]
        others.sort(key=lambda j: (between[i, j], j))
        if not others:
            continue
        ring = np.searchsorted(between[i, others], 4 * own, side="right")
        for t, j in enumerate(others):
            inside = np.flatnonzero(ring > t)
            if not len(inside):
                break
            at = rows[inside]
            d = mine[inside] - new[j]
            to = (d * d).sum(axis=1)
            nearer = (to < least[at]) | ((to == least[at]) & (j < best[at]))
            least[at[nearer]] = to[nearer]
            best[at[nearer]] = j
    out = np.full(k, -1.0)
    for i in range(k):
        rows = best == i
        if rows.any():
            known = least[rows]
            # A little more than the largest distance: a ball that is too large only has more neighbours.
            most = known.max()
            out[i] = max(float(most) * (1 + 1e-9) if most < 1e300 else np.inf, radii[i] if i in skipped else -1.0)
    return best, least, out


def limbs(value: int) -> list[int]:
    """value as limbs of LIMB bits, lowest first, each with the value's sign."""
    sign, value, out = (1, value, []) if value >= 0 else (-1, -value, [])
    while value:
        out.append(sign * (value & ((1 << LIMB) - 1)))
        value >>= LIMB
    return out


def moves(x: np.ndarray, before: np.ndarray, after: np.ndarray, k: int, part: int) -> Iterator[dict]:
    """What the rows that changed their entry add to the counts (at position -1) and sums of entries."""
    rows = before != after
    if not rows.any():
        return
    for codes, sign in ((after[rows], 1), (before[rows], -1)):
        for i in np.unique(codes[codes >= 0]).tolist():
            mine = x[rows][codes == i]
            yield {"part": part, "entry": i, "position": -1, "limb": 0, "value": sign * len(mine)}
            exact = len(mine) * float(np.abs(mine).max(initial=0)) < 2.0**53
            sums = mine.sum(axis=0) if exact else np.vectorize(int, otypes=[object])(mine).sum(axis=0)
            for p, total in enumerate(sums.tolist()):
                for limb, value in enumerate(limbs(int(total))):
                    yield {"part": part, "entry": i, "position": p, "limb": limb, "value": sign * value}


def _data(block: pa.RecordBatch, r: int, name: str, dtype, columns: int) -> np.ndarray:
    return np.frombuffer(block[name][r].as_py(), dtype).reshape(-1, columns)


def floors(values: Iterable[float], scale: int) -> list[int]:
    """floor(scale * x) of each value; a double beyond 2**53 is an integer."""
    return [math.floor(v * scale) if abs(v) < 2**53 else int(v) * scale for v in values]


def _numbers(data: np.ndarray, scale: int, parts: int, *books: list) -> list[np.ndarray]:
    """The block's integers and codebooks in one exact type: doubles where squared distances stay below 2**53, else Python's integers."""
    books = [np.array(b, dtype=object).reshape(parts, len(b[0]), -1) for b in books]
    most = max([float(np.abs(data).max(initial=0)) * scale, *(float(max(map(abs, b.ravel().tolist()))) for b in books)]) + 1
    if 4 * most * most * (data.shape[1] // parts) < 2.0**53:
        return [np.floor(data * float(scale)), *(b.astype(np.float64) for b in books)]
    return [np.array([floors(row, scale) for row in data.tolist()], dtype=object), *books]


_SUM = T.StructType([T.StructField(x, T.LongType()) for x in ("part", "entry", "position", "limb", "value")])
_STATE = T.StructType([T.StructField("block", T.StringType()), T.StructField("codes", T.BinaryType()), T.StructField("radii", T.BinaryType()), T.StructField("sums", T.ArrayType(_SUM))])
_ARROW_SUM = pa.list_(pa.struct([(x, pa.int64()) for x in ("part", "entry", "position", "limb", "value")]))


def round_of(state: DataFrame, dim: int, scale: int, parts: int, old: list, new: list) -> DataFrame:
    """One assignment of all blocks: their codes, radii, and what the rows that changed their entry add to the sums."""
    k = len(new[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                x, before, after = _numbers(_data(b, r, "data", np.float64, dim), scale, parts, old, new)
                width = dim // parts
                first = b["codes"][r].as_py() is None
                codes = np.zeros((len(x), parts), np.int16) if first else _data(b, r, "codes", np.uint8, parts).astype(np.int16)
                radii = np.full((parts, k), -1.0) if first else _data(b, r, "radii", np.float64, k)
                out, sizes, sums = np.zeros((len(x), parts), np.uint8), np.zeros((parts, k)), []
                for p in range(parts):
                    piece = x[:, p * width : (p + 1) * width]
                    best, _, sizes[p] = assign(piece, codes[:, p], radii[p], before[p], after[p])
                    out[:, p] = best
                    sums += moves(piece, np.full(len(x), -1) if first else codes[:, p], best, k, p)
                yield pa.RecordBatch.from_arrays([pa.array([b["block"][r].as_py()]), pa.array([out.tobytes()], pa.binary()), pa.array([sizes.tobytes()], pa.binary()), pa.array([sums], _ARROW_SUM)], names=["block", "codes", "radii", "sums"])

    return state.mapInArrow(run, _STATE)


def coded(state: DataFrame, dim: int, scale: int, parts: int, book: list) -> DataFrame:
    """block, and the codes and squared distances of its rows in the final codebook."""
    schema = T.StructType([T.StructField("of", T.StringType()), T.StructField("codes", T.ArrayType(T.StringType())), T.StructField("errors", T.ArrayType(T.DecimalType(38, 0)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                x, entries = _numbers(_data(b, r, "data", np.float64, dim), scale, parts, book)
                width, codes = dim // parts, _data(b, r, "codes", np.uint8, parts)
                total = np.zeros(len(x), x.dtype)
                for p in range(parts):
                    d = x[:, p * width : (p + 1) * width] - entries[p][codes[:, p]]
                    total = total + (d * d).sum(axis=1)
                texts = [codes[i].tobytes().hex() for i in range(len(codes))]
                errors = [v if v < 10**38 else None for v in map(int, total.tolist())]
                yield pa.RecordBatch.from_arrays([b["block"].slice(r, 1), pa.array([texts], pa.list_(pa.string())), pa.array([errors], pa.list_(pa.decimal128(38, 0)))], names=["of", "codes", "errors"])

    return state.mapInArrow(run, schema)


def compress(
    embeddings: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", tasks: int = 64
) -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of each row with a vector of finite components.

    Vectors are stored once, in blocks dealt to tasks buckets; a round reads them beside the codes and radii of the round before, which are bucketed alike, so
    that no round shuffles vectors. Within a block, ball k-means (`assign`) meets only entries that can be nearest; rows that keep their entry add nothing to the sums. A
    round's sums are at most entries times dimension numbers a block, added up in tasks; codebooks, which the parameters and the dimension bound, are made on the driver.

    Codebooks start as the parts of the smallest ids, nulls last, rows of one id by their components; with fewer rows than entries, of all. Vectors that are
    shorter than the longest, or whose length parts doesn't divide, are padded with zeros, one component a part at least, so each row has a code. Arithmetic is exact for all finite values: blocks whose squared distances may pass 2**53 are
    worked on in Python's integers. An error beyond 64 bits is null, and so is a label's sum that has or makes one. Repeated ids are rows of their own; null labels are one label. An empty table has no rows.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hexadecimal digits for each part")
    spark = embeddings.sparkSession
    rows = kept_vectors(embeddings, id_col, vector_col, label_col)
    dim = -(-max(1, rows.agg(F.max(F.size("v")).alias("dim")).first()["dim"] or 0) // parts) * parts
    width = dim // parts
    first = rows.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    start = [floors(r["v"], scale) + [0] * (dim - len(r["v"])) for r in first]
    book = [[v[p * width : (p + 1) * width] for v in start] for p in range(parts)]

    own = f"{shared_dir(spark)}/codes-{uuid.uuid4().hex}"
    tables: list[str] = []

    def stored(df: DataFrame) -> DataFrame:
        """A table of blocks, each in the bucket of its key."""
        tables.append(f"codes_{uuid.uuid4().hex}")
        df.write.bucketBy(tasks, "block").option("path", f"{own}/{len(tables)}").saveAsTable(tables[-1])
        return spark.table(tables[-1])

    vectors = stored(blocks(rows, dim).repartition(tasks, "block"))
    codes = None
    sums: dict[tuple[int, int, int], int] = {}
    old = book
    for left in range(rounds if start else -1, -1, -1):
        if codes is None:
            state = vectors.select("block", "data", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("binary").alias("radii"))
        else:
            state = vectors.select("block", "data").join(codes.select("block", "codes", "radii").hint("shuffle_hash"), "block")
        codes = stored(round_of(state, dim, scale, parts, old, book))
        if not left:
            break
        added = codes.select(F.explode("sums").alias("s")).groupBy("s.part", "s.entry", "s.position", "s.limb").agg(F.sum("s.value").alias("value")).collect()
        for s in added:
            at = (s["part"], s["entry"], s["position"])
            sums[at] = sums.get(at, 0) + (s["value"] << (LIMB * s["limb"]))
        old = book
        book = [[[sums.get((p, i, c), 0) // sums[p, i, -1] for c in range(width)] if sums.get((p, i, -1)) else list(entry) for i, entry in enumerate(book[p])] for p in range(parts)]
    digest = hashlib.sha256(",".join(str(v) for p in book for entry in p for v in entry).encode()).hexdigest()
    if not start:
        packed = vectors.select("ids", "labels", F.lit(None).cast("array<string>").alias("codes"), F.lit(None).cast("array<decimal(38,0)>").alias("errors"))
    else:
        state = vectors.select("block", "data").join(codes.select("block", "codes").hint("shuffle_hash"), "block")
        packed = vectors.select("block", "ids", "labels").join(staged(coded(state, dim, scale, parts, book)), F.col("block") == F.col("of"))
    each = packed.select(F.explode(F.arrays_zip("ids", "labels", "codes", "errors")).alias("r"))
    out = staged(each.select(F.col("r.ids").alias("id"), F.col("r.labels").alias("label"), F.col("r.codes").alias("code"), F.col("r.errors").alias("e")))
    for t in tables:
        spark.sql(f"DROP TABLE {t}")
    whole_long = lambda e: F.expr(f"try_cast({e} AS BIGINT)")
    total = F.when(F.count("e") == F.count(F.lit(1)), F.try_sum("e"))
    by_label = out.groupBy(F.col("label").alias("of")).agg(total.alias("sum"))
    joined = salted_join(out, by_label, {"label": "of"})
    return joined.select(F.col("id").alias(id_col), "label", "code", whole_long("e").alias("error"), whole_long("sum").alias("label_error"), F.lit(digest).alias("codebooks_sha256"))
