"""Exact top-k inner products by distributed histogram selection, queries and candidates in blocks."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import staged

#: Scores are cut into digits of so many bits, from the highest.
DIGIT = 10
#: Vectors whose scaled squared norm is below meet in 64-bit numbers: all inner products, and their distances to the lowest one, fit. Others are large and meet in Python's integers.
MOST = float(1 << 61)
#: Digits of a score's order key: products of two doubles scaled by up to 2**20, summed, have fewer.
DIGITS = 660
_NO_ID = (1 << 63) - 1


def quantised(embeddings: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """row (a number of its own), id, asked, large, vector of floor(scale * x) as long, its squared norm and dim of each row that takes part; of a large one the doubles in raw instead."""
    v = F.col("v")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asked"), F.col(vector_col).cast("array<double>").alias("v")).filter(v.isNotNull() & finite)
    scaled = rows.withColumn("scaled", F.transform(v, lambda x: x * F.lit(float(scale))))
    norm = F.aggregate("scaled", F.lit(0.0), lambda a, x: a + x * x)
    sized = scaled.withColumn("norm", norm).withColumn("large", F.col("norm") >= MOST)
    whole = F.when(~F.col("large"), F.transform("scaled", lambda x: F.floor(x).cast("long")))
    return sized.select(F.monotonically_increasing_id().alias("row"), "id", "asked", "large", whole.alias("vector"), "norm", F.size("v").alias("dim"), v.alias("raw"))


def blocks(vectors: DataFrame, per_block: int, rows: int, column: str = "vector") -> DataFrame:
    """dim, block, and row numbers, ids (without one, the largest long) and flattened vectors of about per_block rows each."""
    n = max(1, -(-rows // per_block))
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n)).cast("int"))
    packed = dealt.groupBy("dim", "block").agg(F.collect_list(F.struct("row", F.coalesce("id", F.lit(_NO_ID)).alias("id"), F.col(column).alias("vector"))).alias("rows"))
    return packed.select("dim", "block", F.col("rows.row").alias("rows"), F.col("rows.id").alias("ids"), F.flatten("rows.vector").alias("data"))


def _as_queries(packed: DataFrame) -> DataFrame:
    return packed.select("dim", F.col("block").alias("q_block"), F.col("rows").alias("q_rows"), F.col("ids").alias("q_ids"), F.col("data").alias("q"))


def order_key(score: int) -> str:
    """Digits that sort as scores do."""
    return f"1{score:0{DIGITS}d}" if score >= 0 else f"0{10**DIGITS + score:0{DIGITS}d}"


def large_pairs(vectors: DataFrame, counts: dict[str, int], k: int, scale: int, per_block: int, tasks: int) -> DataFrame:
    """query, query_id, vec_id, score (null beyond 64 bits) and key: each query's k best of every block, of the pairs with a large vector, in Python's integers."""

    def whole(values: np.ndarray, dim: int) -> np.ndarray:
        return np.array([math.floor(x * scale) if abs(x) < 2**53 else int(x) * scale for x in values.tolist()], dtype=object).reshape(-1, dim)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                q, c = whole(np.asarray(r.q), r.dim), whole(np.asarray(r.data), r.dim)
                scores = q @ c.T
                out = []
                for i, (row, of) in enumerate(zip(r.q_rows, r.q_ids)):
                    best = heapq.nsmallest(k, ((-s, v) for s, v, other in zip(scores[i].tolist(), r.ids, r.rows) if other != row))
                    out += [(row, of, v, -s if abs(s) < 2**63 else None, order_key(-s)) for s, v in best]
                yield pd.DataFrame(out, columns=["query", "query_id", "vec_id", "score", "key"]).astype({"score": "Int64"})

    asked, large = vectors.filter("asked"), vectors.filter("large")
    sides = ((asked, counts["asked"], large, counts["large"]), (asked.filter("large"), counts["large"], vectors.filter("not large"), counts["n"]))
    out = None
    for q, nq, c, nc in sides:
        met = grid(_as_queries(blocks(q, per_block, nq, "raw")), blocks(c, 8 * per_block, nc, "raw"), tasks).mapInPandas(run, "query long, query_id long, vec_id long, score long, key string")
        out = met if out is None else out.unionByName(met)
    return out


def grid(q: DataFrame, c: DataFrame, tasks: int) -> DataFrame:
    """Each query block with each candidate block of its dimension. Both are repeated, so that a pair of (block, lane) is a key of its own, of at least about tasks keys where there are as many pairs."""
    per = c.groupBy("dim").agg(F.collect_list("block").alias("blocks"))
    lanes = F.greatest(F.lit(1), F.ceil(F.lit(tasks) / F.size("blocks"))).cast("int")
    sizes = per.select(F.col("dim").alias("of_dim"), "blocks", lanes.alias("lanes"))
    left = q.join(sizes, F.col("dim") == F.col("of_dim")).withColumn("block", F.explode("blocks")).withColumn("lane", F.pmod(F.xxhash64("q_block"), F.col("lanes")).cast("int"))
    right = c.join(sizes.select("of_dim", "lanes"), F.col("dim") == F.col("of_dim")).withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1))).drop("of_dim", "lanes")
    return left.drop("of_dim", "blocks", "lanes").join(right, ["dim", "block", "lane"])


def _scores(q_rows: np.ndarray, q: np.ndarray, c_rows: np.ndarray, c: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Integer inner products, and which count: all but those of a row with itself."""
    q, c = q.reshape(len(q_rows), dim), c.reshape(len(c_rows), dim)
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, dim)
    s = (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64) if most < 2**53 else q @ c.T
    return s, q_rows[:, None] != c_rows[None, :]


def top_k(
    embeddings: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, queries_per_block: int = 512, candidates_per_block: int = 4096, tasks: int = 64
) -> DataFrame:
    """query_id, rank, vec_id and score: each query row's k highest integer inner products with other rows, ties to the smaller id.

    Every query block meets every candidate block, each pair under a key of its own. A round sums, per query row, a histogram of one
    digit of the scores that still share the prefix of the kth; the digits that lead to the kth value are fixed, and after the last round the scores
    at or above it are filtered and ranked. A histogram has 2**DIGIT cells and is summed in tasks before it is shuffled. Queries with fewer than k
    candidates return all. Vectors that are null or hold null or non-finite components take no part; vectors of another length aren't compared. Pairs with a vector of a scaled squared
    norm of 2**61 or more are scored block by block in Python's integers, and each block's k best of a query join its others, so every finite vector is ranked exactly; a score beyond 64 bits is null, its rank right. Rows of one id are rows like others: each query row has its own
    ranks, and a row of its id is a candidate. A row without an id is a candidate that loses ties, and a query where is_query holds.
    """
    everything = staged(quantised(embeddings, is_query, id_col, vector_col, scale))
    vectors = everything.filter("not large")
    sizes = everything.agg(
        F.count_if(~F.col("large")).alias("n"), F.count_if("asked").alias("asked"), F.max(F.when(~F.col("large"), F.col("norm"))).alias("norm"), F.max(F.when(~F.col("large"), F.col("dim"))).alias("dim"), F.count_if("large").alias("large")
    ).first()
    q = _as_queries(staged(blocks(vectors.filter("asked"), queries_per_block, sizes["asked"])))
    c = staged(blocks(vectors, candidates_per_block, sizes["n"]))
    # A floor moves each component by less than one, so no score is further from 0 than this.
    bound = int(((sizes["norm"] or 0.0) ** 0.5 + (sizes["dim"] or 0) ** 0.5 + 1) ** 2) + 1
    digits = -(-(2 * bound + 1).bit_length() // DIGIT)

    def histogram(shift: int):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for r in f.itertuples():
                    s, other = _scores(np.asarray(r.q_rows), np.asarray(r.q), np.asarray(r.rows), np.asarray(r.data), r.dim)
                    s = s + bound
                    fits = other if r.prefixes is None else other & (s >> (shift + DIGIT) == np.asarray(r.prefixes)[:, None])
                    at, _ = np.nonzero(fits)
                    cell, n = np.unique((at << DIGIT) | ((s[fits] >> shift) & ((1 << DIGIT) - 1)), return_counts=True)
                    yield pd.DataFrame({"query": np.asarray(r.q_rows)[cell >> DIGIT], "digit": cell & ((1 << DIGIT) - 1), "n": n})

        return run

    found = None  # per query: the prefix of its kth score so far, and how many of its candidates are wanted below that prefix's start
    for d in reversed(range(digits)):
        shift = d * DIGIT
        asked_now = q.withColumn("prefixes", F.lit(None).cast("array<long>")) if found is None else q.join(prefix_lists(q, found), ["dim", "q_block"])
        cells = grid(asked_now, c, tasks).mapInPandas(histogram(shift), "query long, digit long, n long").groupBy("query", "digit").agg(F.sum("n").alias("n"))
        above = F.sum("n").over(W.partitionBy("query").orderBy(F.desc("digit")))
        if found is None:
            cells = cells.withColumn("prefix", F.lit(0).cast("long")).withColumn("wanted", F.lit(k).cast("long"))
        else:
            cells = cells.join(found, "query")
        # With fewer than wanted, the lowest cell that has candidates is the last.
        total = F.sum("n").over(W.partitionBy("query"))
        ranked = cells.withColumn("above", above - F.col("n")).withColumn("goal", F.least(F.col("wanted"), total))
        hit = ranked.filter((F.col("above") < F.col("goal")) & (F.col("above") + F.col("n") >= F.col("goal")))
        found = staged(hit.select("query", (F.col("prefix") * (1 << DIGIT) + F.col("digit")).alias("prefix"), (F.col("goal") - F.col("above")).alias("wanted")))

    def kept(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                s, other = _scores(np.asarray(r.q_rows), np.asarray(r.q), np.asarray(r.rows), np.asarray(r.data), r.dim)
                at, to = np.nonzero(other & (s + bound >= np.asarray(r.prefixes)[:, None]))
                out = pd.DataFrame({"query": np.asarray(r.q_rows)[at], "query_id": np.asarray(r.q_ids)[at], "vec_id": np.asarray(r.ids)[to], "score": s[at, to]})
                # Ties at the kth score can be many: of one block, the k best of a query are enough.
                out = out.sort_values(["query", "score", "vec_id"], ascending=[True, False, True])
                yield out.groupby("query").head(k)

    best = grid(q.join(prefix_lists(q, found), ["dim", "q_block"]), c, tasks).mapInPandas(kept, "query long, query_id long, vec_id long, score long")
    order = [F.desc("score"), F.col("vec_id")]
    if sizes["large"]:
        digits_of = lambda x: F.lpad(F.abs(x.cast("decimal(20,0)")).cast("string"), DIGITS, "0")
        nines = F.translate(digits_of(-(F.col("score").cast("decimal(20,0)")) - 1), "0123456789", "9876543210")
        key = F.when(F.col("score") >= 0, F.concat(F.lit("1"), digits_of(F.col("score")))).otherwise(F.concat(F.lit("0"), nines))
        best = best.withColumn("key", key).unionByName(large_pairs(everything, {"asked": sizes["asked"], "large": sizes["large"], "n": sizes["n"]}, k, scale, max(1, queries_per_block // 8), tasks))
        order = [F.desc("key"), F.col("vec_id")]
    rank = F.row_number().over(W.partitionBy("query").orderBy(*order))
    known = lambda x: F.when(F.col(x) != _NO_ID, F.col(x)).alias(x)
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select(known("query_id"), "rank", known("vec_id"), "score")


def prefix_lists(q: DataFrame, found: DataFrame) -> DataFrame:
    """dim, q_block and the prefixes of the block's queries, in the order of its rows; a query without a candidate has one that no score reaches."""
    ids = q.select("dim", "q_block", F.posexplode("q_rows").alias("pos", "query")).join(found, "query", "left")
    ordered = ids.groupBy("dim", "q_block").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("prefix", F.lit(_NO_ID)).alias("prefix")))).alias("x"))
    return ordered.select("dim", "q_block", F.col("x.prefix").alias("prefixes"))
