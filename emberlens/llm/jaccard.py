"""Jaccard self-join of documents on sets of word n-grams: rare-first prefixes, length, positional and suffix filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import recorded, release, salted_join, shuffles_deleted, staged, utf8
from .wordsets import BITS, CELLS, by_owner, cell_of, ranks, sets_of_texts, stretches, word_hashes

_U = np.uint64
#: Documents of a bundle that one task compares with as many others.
BLOCK = 1000
#: Members of a large bundle that all others are compared with first.
HEADS = 16
#: Bundles of at most so many members are compared many at once.
SMALL = 16
#: About so many prefix n-grams are sorted at once.
GRAMS = 1 << 18
#: Counts of words' cells that make a row.
_PIECE = 1 << 12
#: Texts' hashes are told apart by so many bits where texts that can't be wanted are left out, so what is broadcast for it is bounded.
_WANTED = 22
#: Rows, and bytes of them, that are worked on at once.
_ROWS, _BYTES = 1 << 13, 1 << 22


def prefix_length(size: np.ndarray | int, percent: int):
    return size - -(-percent * size // 100) + 1


def word_ranks(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Ranks of the cells of all documents' words by their counts, summed in tasks and after the shuffle, both in a table of fixed size."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(1 << BITS, np.int64)
        for b in batches:
            for _, _, text, bounds in stretches(b.column(0)):
                out += np.bincount(cell_of(word_hashes(text, bounds)[0]), minlength=1 << BITS)
        yield from pieces(out)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for b in batches:
            for piece, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = np.frombuffer(x.as_py(), np.int64)
                out[piece] = out[piece] + x if piece in out else x
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([x.tobytes() for x in out.values()], pa.binary())], names=["piece", "counts"])

    def pieces(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows = [(i // _PIECE, counts[i : i + _PIECE].tobytes()) for i in range(0, len(counts), _PIECE) if counts[i : i + _PIECE].any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["piece", "counts"])

    out = np.zeros(1 << BITS, np.int64)
    with shuffles_deleted(docs.sparkSession):
        rows = docs.select(utf8(text_col).alias("text")).mapInArrow(counted, "piece int, counts binary").repartition("piece").mapInArrow(summed, "piece int, counts binary").toArrow()
    for piece, x in zip(rows["piece"].to_pylist(), rows["counts"], strict=True):
        out[piece * _PIECE : (piece + 1) * _PIECE] += np.frombuffer(x.as_py(), np.int64)
    return ranks(out)


def overlaps(tokens: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Common tokens of the sets at rows with all sets, by products of blocks of the incidence matrix."""
    m = len(tokens)
    out = np.zeros((len(rows), m), np.float32)
    owner = np.repeat(np.arange(m), [len(t) for t in tokens])
    _, t, times = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    use = times[t] > 1
    _, t = np.unique(t[use], return_inverse=True)
    order = np.argsort(t, kind="stable")
    t, owner = t[order], owner[use][order]
    for a in range(0, int(t[-1]) + 1 if len(t) else 0, 4096):
        i, j = np.searchsorted(t, [a, a + 4096])
        x = np.zeros((m, min(4096, int(t[-1]) + 1 - a)), np.float32)
        x[owner[i:j], t[i:j] - a] = 1
        out += x[rows] @ x.T
    return out.astype(np.int64)


def candidates(sizes: np.ndarray, shared: list[np.ndarray], cells: np.ndarray, split: int, pivots: list[list[int]], own: int, percent: int) -> np.ndarray:
    """Which pairs i < j of a bundle may link. split: only pairs across that place count, unless it is 0. shared: tokens of the prefixes that others share."""
    at = np.arange(len(sizes))
    low, high = np.minimum.outer(sizes, sizes), np.maximum.outer(sizes, sizes)
    need = -(-percent * np.add.outer(sizes, sizes) // (100 + percent))
    maybe = (100 * low >= percent * high) & (at[:, None] < at[None, :])  # length
    if split:
        maybe[:split, :split] = maybe[split:, split:] = False
    seen: dict[int, list[int]] = {}
    for i, p in enumerate(pivots):
        for q in p:
            if q < own:
                seen.setdefault(q, []).append(i)
    for group in seen.values():  # a pair is verified in the bundle of its smallest common pivot only
        maybe[np.ix_(group, group)] = False
    if maybe.any():
        c = overlaps(shared, at)
        rest = sizes - prefix_length(sizes, percent)
        # Positional: beyond the common tokens of both prefixes, only what follows the prefix that ends first can be common.
        maybe &= (c > 0) & (c + np.maximum.outer(rest, rest) >= need)
    if maybe.any():
        # Suffix: sets can't share more of a cell of hashes than the smaller number of tokens in it.
        bound = sum(np.minimum.outer(cells[:, k], cells[:, k]) for k in range(CELLS))
        maybe &= bound >= need
    return maybe


def linked(sizes: np.ndarray, sets: list[np.ndarray], maybe: np.ndarray, percent: int) -> np.ndarray:
    """Smallest index that each set reaches by links among the pairs that may link."""
    rows = np.flatnonzero(maybe.any(axis=1))
    both = overlaps(sets, rows)
    a, b = np.nonzero(maybe[rows] & (100 * both >= percent * (np.add.outer(sizes[rows], sizes) - both)))
    return labels_of(len(sizes), rows[a], b)


def cell_counts(tokens: np.ndarray) -> np.ndarray:
    return np.bincount((tokens >> _U(60)).astype(np.int64), minlength=CELLS).astype("<i4")


def packed(hashes: np.ndarray, buckets: int, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row for each bucket of hashes, with its values of each column of 64 bits as bytes."""
    bucket = ((hashes >> _U(40)) * _U(buckets)) >> _U(24)
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
    bucket = bucket[order]
    start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)])
    at = np.append(start, len(bucket)).tolist()
    found = {"bucket": pa.array(bucket[start].astype(np.int64))}
    for name, x in columns.items():
        data = memoryview(x[order].tobytes())
        found[name] = pa.array([data[8 * a : 8 * b] for a, b in zip(at, at[1:], strict=False)], pa.binary())
    return pa.RecordBatch.from_arrays(list(found.values()), names=list(found))


def unpacked(table: pa.Table, column: str) -> np.ndarray:
    return np.frombuffer(b"".join(table[column].to_pylist()), np.int64)


class Pairs:
    """All pairs a < b of rows of the same group; start: where the groups begin, and the end. Up to 65,536 groups, each of few rows."""

    def __init__(self, start: np.ndarray) -> None:
        self.m = np.diff(start)
        each = self.m * (self.m - 1) // 2
        self.base = np.cumsum(each) - each
        self.group = np.repeat(np.arange(len(self.m)).astype(np.uint16), self.m)
        self.local = np.arange(len(self.group)) - np.repeat(start[:-1] - start[0], self.m)
        self.a, self.b = np.empty(int(each.sum()), np.int64), np.empty(int(each.sum()), np.int64)
        for v in np.unique(self.m[self.m > 1]):
            g = np.flatnonzero(self.m == v)
            i, j = np.triu_indices(v, 1)
            at = self.base[g][:, None] + np.arange(len(i))
            self.a[at], self.b[at] = (start[g] - start[0])[:, None] + i, (start[g] - start[0])[:, None] + j

    def common(self, values: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How many values the rows of each pair have in common. row: whose each value is; none has a value twice."""
        order = by_owner(self.group[row], np.argsort(values))
        v, row = values[order], row[order]
        group = self.group[row]
        out = np.zeros(len(self.a), np.int64)
        at, d = np.flatnonzero((v[1:] == v[:-1]) & (group[1:] == group[:-1])), 1
        while len(at):  # places whose value is also that of the place d further on
            x, y = np.minimum(row[at], row[at + d]), np.maximum(row[at], row[at + d])
            i, m = self.local[x], self.m[group[at]]
            out += np.bincount(self.base[group[at]] + i * (2 * m - i - 1) // 2 + self.local[y] - i - 1, minlength=len(out))
            d += 1
            at = at[at + d < len(v)]
            at = at[(v[at + d] == v[at]) & (group[at + d] == group[at])]
        return out


class Bundled:
    """Rows of whole pairs of blocks, in their order and without repeated ones: pivot, k, own, sizes, cells, lists of shared tokens and of pivots."""

    def __init__(self, table: pa.Table, sets: bool) -> None:
        column = lambda c: table[c].to_numpy()
        pivot, i, j, k = (column(c) for c in ("pivot", "i", "j", "k"))
        change = np.ones(len(k), bool)
        change[1:] = (pivot[1:] != pivot[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        first = change.copy()
        first[1:] |= k[1:] != k[:-1]
        if not first.all():
            table, change = table.filter(pa.array(first)), change[first]
        self.start = np.append(np.flatnonzero(change), table.num_rows)
        self.pivot, self.k, self.own = (column(c) for c in ("pivot", "k", "own"))
        longs = lambda c, kind: [np.frombuffer(x, kind) for x in table[c].to_pylist()]
        self.shared, self.pivots = longs("shared", np.int64), [np.array(x, np.int64) for x in table["pivots"].to_pylist()]
        self.sets = longs("tokens", _U) if sets else None
        self.sizes = np.array([len(x) for x in self.sets]) if sets else column("n")
        self.cells = np.stack([cell_counts(x) for x in self.sets] if sets else longs("cells", "<i4"))

    def __iter__(self) -> Iterator[tuple[np.ndarray, int]]:
        """Rows of each larger pair of blocks, and where its second block begins among them (0: it is one block)."""
        m = np.diff(self.start)
        for g in np.flatnonzero(m > SMALL):
            at = np.arange(self.start[g], self.start[g + 1])
            own = self.own[at]
            yield at, 0 if own[0] == own[-1] else int((own == own[0]).sum())

    def likely(self, at: np.ndarray, split: int, percent: int) -> np.ndarray:
        """Which pairs of a larger pair of blocks may link."""
        return candidates(self.sizes[at], [self.shared[x] for x in at], self.cells[at], split, [self.pivots[x].tolist() for x in at], int(self.pivot[at[0]]), percent)

    def small(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Both rows of the pairs of all small bundles that may link, as candidates() finds them, or that link, if there are sets."""
        m = np.diff(self.start)
        rows = np.flatnonzero(np.repeat((m > 1) & (m <= SMALL), m))
        m = m[(m > 1) & (m <= SMALL)]
        start = np.concatenate(([0], np.cumsum(m)))
        pairs = Pairs(start)
        a, b = rows[pairs.a], rows[pairs.b]
        low, high = np.minimum(self.sizes[a], self.sizes[b]), np.maximum(self.sizes[a], self.sizes[b])
        need = -(-percent * (low + high) // (100 + percent))
        split = (self.own[rows[start[:-1]]] != self.own[rows[start[1:] - 1]])[pairs.group[pairs.a]] if len(m) else np.zeros(0, bool)
        maybe = (100 * low >= percent * high) & (~split | (self.own[a] != self.own[b]))
        if maybe.any():  # a pair is verified in the bundle of its smallest common pivot only
            values, row = listed(self.pivots, rows)
            own = values < self.pivot[rows[row]]
            maybe &= pairs.common(values[own], row[own]) == 0
        if maybe.any():
            c = pairs.common(*listed(self.shared, rows))
            rest = self.sizes - prefix_length(self.sizes, percent)
            maybe &= (c > 0) & (c + np.maximum(rest[a], rest[b]) >= need)
            at = np.flatnonzero(maybe)
            maybe[at] = np.minimum(self.cells[a[at]], self.cells[b[at]]).sum(axis=1) >= need[at]
        if self.sets is None or not maybe.any():
            return a[maybe], b[maybe]
        wanted = np.zeros(len(rows), bool)
        wanted[pairs.a[maybe]] = wanted[pairs.b[maybe]] = True
        both = pairs.common(*listed(self.sets, rows, wanted))
        maybe &= 100 * both >= percent * (low + high - both)
        return a[maybe], b[maybe]


def listed(lists: list[np.ndarray], rows: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The values of rows' lists one after another, and the place in rows that each belongs to; only of wanted ones, if these are given."""
    at = np.arange(len(rows)) if wanted is None else np.flatnonzero(wanted)
    found = [lists[x] for x in rows[at]]
    return np.concatenate(found) if found else np.empty(0, np.int64), np.repeat(at, [len(x) for x in found])


def labels_of(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index that each of count rows reaches by the links a, b."""
    label = np.arange(count)
    while True:  # the smallest label spreads along links
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in the order of pivot, i and j in tables of whole pairs of blocks. Only the last one is held until the next batch."""
    held: pa.Table | None = None
    for b in batches:
        table = pa.Table.from_batches([b])
        held = table if held is None else pa.concat_tables([held, table])
        pivot, i, j = (held[c].to_numpy() for c in ("pivot", "i", "j"))
        start = np.concatenate(([0], np.flatnonzero((pivot[1:] != pivot[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1))
        weight = held.nbytes / max(1, held.num_rows)
        most = max(1, min(_ROWS, int(_BYTES / max(1.0, weight))))
        at = 0
        while at < start[-1]:
            to = int(start[max(np.searchsorted(start, at + most, "right") - 1, np.searchsorted(start, at, "right"))])
            yield held.slice(at, to - at)
            at = to
        held = held.slice(at)
    if held is not None and held.num_rows:
        yield held


def dealt(rows: DataFrame, block: int) -> DataFrame:
    """rows(k, pivot, label, ...) with own, i and j: a bundle's members are dealt to groups of about block of one label, or of none, and each goes to all pairs of
    groups that its own is in, but for pairs of one label: their members are linked already. Bundles of one group without a label stay as they are."""
    sized = rows.groupBy("pivot", "label").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("n"))
    several = sized.groupBy("pivot").agg(F.collect_list(F.struct("label", "n")).alias("x"), F.sum("n").alias("groups")).filter("groups > 1 or exists(x, y -> y.label is not null)")
    one = F.transform(F.sequence(F.lit(0), F.col("y.n") - 1), lambda b: F.struct(F.col("y.label").isNull().alias("free"), F.coalesce("y.label", F.lit(0)).alias("label"), b.alias("b"), F.col("y.n").alias("n")))
    groups = several.select(F.col("pivot").alias("of"), F.explode("x").alias("y")).select("of", F.explode(one).alias("g")).groupBy("of").agg(F.array_sort(F.collect_list("g")).alias("groups"))
    placed = salted_join(rows, groups, {"pivot": "of"}, "left")
    free, label = F.col("label").isNull(), F.coalesce("label", F.lit(0))
    mine = F.filter(F.transform("groups", lambda g, at: F.when((g["free"] == free) & (g["label"] == label) & (g["b"] == F.pmod(F.xxhash64("k"), g["n"])), at)), lambda at: at.isNotNull())
    others = F.filter(F.transform("groups", lambda g, at: F.when(g["free"] | free | (g["label"] != label), at)), lambda at: at.isNotNull())
    own = placed.withColumn("own", F.coalesce(F.get(mine, F.lit(0)), F.lit(0))).withColumn("other", F.explode(F.coalesce(others, F.array(F.lit(0)))))
    return own.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("of", "groups", "other", "label")


def heads_of(members: DataFrame, sets: DataFrame, percent: int, block: int) -> tuple[DataFrame, DataFrame]:
    """members(k, pivot) of large bundles -> label of those that link to one of their bundle's first HEADS members, and edges to these.

    A bundle may be one large group of near copies, whose pairs would grow with its square. Each block of members meets its bundle's
    heads only; members of one label are linked through them and needn't meet.
    """
    blocks = members.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"))
    first = F.row_number().over(W.partitionBy("pivot").orderBy("k"))
    heads = members.withColumn("place", first).filter(F.col("place") <= HEADS).join(blocks, "pivot").select("k", "pivot", F.lit(True).alias("head"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    others = salted_join(members, blocks.withColumnRenamed("pivot", "of"), {"pivot": "of"}).select("k", "pivot", F.lit(False).alias("head"), F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int").alias("block"))
    places = heads.unionByName(others).groupBy("k").agg(F.collect_list(F.struct("pivot", "head", "block")).alias("places")).withColumnRenamed("k", "of_k")
    rows = sets.select("k", "tokens").join(places, F.col("k") == F.col("of_k")).withColumn("x", F.explode("places")).select("k", "tokens", "x.*")

    def nearest(table: pa.Table) -> pa.Table:
        table = table.sort_by([("head", "descending"), ("k", "ascending")])
        k, n = table["k"].to_numpy(), int(np.count_nonzero(table["head"].to_numpy(zero_copy_only=False)))
        tokens = [np.frombuffer(x, _U) for x in table["tokens"].to_pylist()]
        sizes = np.array([len(t) for t in tokens])
        both = overlaps(tokens, np.arange(n))
        link = 100 * both >= percent * (np.add.outer(sizes[:n], sizes) - both)
        root = np.arange(n)  # heads that link to each other share one; every block finds the same
        while True:
            new = np.minimum(root, np.where(link[:, :n], root[None, :], n).min(axis=1, initial=n))
            new = new[new]
            if (new == root).all():
                break
            root = new
        at, of = np.nonzero(link[:, n:])
        least = np.full(len(k) - n, n)
        np.minimum.at(least, of, root[at])
        edges = np.unique(np.stack([k[n:][of], k[root[at]]]), axis=1) if len(at) else np.zeros((2, 0), np.int64)
        far = least < n
        out_k, label = k[n:][far], k[np.minimum(least[far], n - 1)]
        pivot = np.full(len(out_k), table["pivot"][0].as_py() if table.num_rows else 0)
        return pa.concat_tables(
            [pa.table({"k": out_k, "pivot": pivot, "label": label, "to": pa.nulls(len(out_k), pa.int64())}), pa.table({"k": edges[0], "pivot": np.full(edges.shape[1], pivot[0] if len(pivot) else 0), "label": pa.nulls(edges.shape[1], pa.int64()), "to": edges[1]})]
        )

    found = staged(rows.groupBy("pivot", "block").applyInArrow(nearest, "k long, pivot long, label long, to long"))
    return found.filter("label is not null").select("k", "pivot", "label").distinct(), found.filter("to is not null").select(F.col("k").alias("a"), F.col("to").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (a, root): the smallest node that each node reaches, by large and small stars in turn; nodes without edges are left out."""
    edges = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "of")
        large = salted_join(both, low, {"a": "of"}).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))  # a node may have very many neighbours
        large = staged(large.filter("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "of")
        small = salted_join(large, low, {"a": "of"}).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("of").alias("a"), F.col("m").alias("b")))
        edges = staged(small.filter("a <> b").distinct())
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            return edges.select("a", F.col("b").alias("root"))
        last = state


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, block: int = BLOCK, heads_from: int = 16) -> DataFrame:
    """n_shingles and component_id of every row: the smallest id reachable by links of Jaccard similarity of percent or more.

    Equal sets are one node. A node's prefix is its first n-grams in a global order from rare to common; two sets that link share
    an n-gram of their prefixes. All nodes that share one are bundled under that n-gram's smallest node, its pivot, so
    every candidate pair meets in a bundle, and no pair becomes a row: a task filters a bundle's pairs by length, position and
    suffix, and hands on the members that may link. Only their sets are fetched and dealt to bundles again, where what the
    filters leave is verified once and at most one edge per member handed on. A bundle of more than block members is cut into blocks, each pair of which is
    a group of its own; in one of over heads_from blocks, all members are first compared with a few of them, and only those that aren't linked through these meet.

    Null or empty texts have an empty set and their own id. Rows count by themselves, whatever their ids: rows of equal ids share what any of them links
    to only if their sets link, and a row without an id links others, takes the id that it reaches, and is null only where none is reached. An
    empty table gives an empty one; other columns aren't read. Sets are told apart by 64-bit hashes: of N different sets, about N**2 / 2**65 pairs
    are expected to count as equal, less than one for 6 billion.
    """
    rank = word_ranks(docs, text_col)
    # A row is found again by its id and its text's hash.
    kept = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    id_type = kept.schema["id"].dataType.simpleString()

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in batches:
            for i, j, s in sets_of_texts(b.column(1), n, rank):
                size, key, at, tokens = np.diff(s.bounds), s.keys(), s.bounds.tolist(), s.rare_first()
                prefix = []
                for k, x, m in zip(key, at, size.tolist(), strict=False):
                    prefix.append(tokens[x : x + prefix_length(m, percent)].tobytes() if m and k not in seen else None)
                    seen.add(k)
                cells = [x.tobytes() for x in s.cells().astype("<i4")]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array(size, pa.int64()), pa.array(key, pa.int64()), pa.array(prefix, pa.binary()), pa.array(cells, pa.binary())],
                    names=["id", "th", "n", "k", "prefix", "cells"],
                )

    with recorded() as made:
        prefixes = staged(kept.mapInArrow(keyed, f"id {id_type}, th long, n long, k long, prefix binary, cells binary"))
    nodes = staged(prefixes.drop("prefix"))
    buckets = -(-(prefixes.agg(F.sum(F.octet_length("prefix").cast("long"))).first()[0] or 0) // (8 * GRAMS)) or 1

    def dealt_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prefix = [np.frombuffer(x, _U) for x in b.column(1).to_pylist()]
            h, k = np.concatenate([np.empty(0, _U), *prefix]), np.repeat(b.column(0).to_numpy(), [len(x) for x in prefix])
            yield packed(h, buckets, {"h": h, "k": k})

    def shared(table: pa.Table) -> pa.Table:
        """Of a bucket's grams, those that several k have: with each k and the gram's smallest one, by buckets of k."""
        h, k = unpacked(table, "h").view(_U), unpacked(table, "k")
        order = np.argsort(h)
        h, k = h[order], k[order]
        new = np.append(True, h[1:] != h[:-1])
        start = np.flatnonzero(new)
        pivot, last, gram = np.minimum.reduceat(k, start), np.maximum.reduceat(k, start), np.cumsum(new) - 1
        use = (pivot != last)[gram]
        h, k, pivot = h[use], k[use], pivot[gram[use]]
        return pa.Table.from_batches([packed(k.view(_U), -(-buckets // 2), {"h": h, "k": k, "pivot": pivot})])

    def gathered(table: pa.Table) -> pa.Table:
        """Of a bucket of k: each with its grams, and their pivots."""
        h, k, pivot = (unpacked(table, c) for c in ("h", "k", "pivot"))
        order = np.lexsort((h, k))
        h, k, pivot = h[order], k[order], pivot[order]
        new = np.append(True, (k[1:] != k[:-1]) | (h[1:] != h[:-1]))  # tasks that saw equal sets have each emitted the key
        h, k, pivot = h[new], k[new], pivot[new]
        at = [*np.flatnonzero(np.append(True, k[1:] != k[:-1])).tolist(), len(k)]
        parts = list(zip(at, at[1:], strict=False))
        return pa.table({"k": k[at[:-1]], "shared": pa.array([h[a:b].tobytes() for a, b in parts], pa.binary()), "pivots": pa.array([np.unique(pivot[a:b]) for a, b in parts], pa.list_(pa.int64()))})

    # Hashes and keys are shuffled in packed columns: a task's grams of a bucket are one row, and so are a bucket's of a bucket of keys.
    grams = prefixes.filter("prefix is not null").select("k", "prefix").mapInArrow(dealt_grams, "bucket long, h binary, k binary")
    found = grams.groupBy("bucket").applyInArrow(shared, "bucket long, h binary, k binary, pivot binary")
    pairs = found.groupBy("bucket").applyInArrow(gathered, "k long, shared binary, pivots array<long>")
    row = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th"))
    one = nodes.filter("k is not null").groupBy("k").agg(row.alias("at"), F.first("n").alias("n"), F.first("cells").alias("cells"))
    members = staged(pairs.join(one, "k"))
    release(docs.sparkSession, made)  # nothing reads the prefixes any more, and of all that is written here they take the most

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole(batches):
            x = Bundled(table, sets=False)
            use = np.zeros(len(x.k), bool)
            a, b = x.small(percent)
            use[a] = use[b] = True
            for at, split in x:
                maybe = x.likely(at, split, percent)
                use[at] = maybe.any(axis=0) | maybe.any(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(x.k[use]), pa.array(x.pivot[use])], names=["k", "pivot"])

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in batches:
            for i, j, s in sets_of_texts(b.column(3), n):
                part, keys = b.slice(i, j - i), b.column(0).slice(i, j - i).to_pylist()
                same = [of == k and k not in seen for of, k in zip(s.keys(), keys, strict=True)]
                seen.update(keys)
                data, at = memoryview(s.tokens.tobytes()), (8 * s.bounds).tolist()
                out = pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([data[x:y] for x, y in zip(at, at[1:], strict=False)], pa.binary())], names=["k", "pivots", "shared", "tokens"])
                yield out.filter(pa.array(same, pa.bool_()))

    def sets_of(bundled: DataFrame) -> tuple[DataFrame, DataFrame]:
        """k, pivots, shared and tokens of bundled(k, pivot); and bundled without repeated rows."""
        pivots = bundled.groupBy("k").agg(F.array_sort(F.collect_set("pivot")).alias("pivots"))
        wanted = staged(pivots.join(members.select("k", "at", "shared"), "k").select(F.col("at.id").alias("of"), F.col("at.th").alias("of_th"), "k", "pivots", "shared"))
        low = F.lit((1 << _WANTED) - 1)
        cells = wanted.select(F.col("of_th").bitwiseAND(low).alias("cell")).distinct()
        near = kept.join(F.broadcast(cells), F.col("th").bitwiseAND(low) == F.col("cell"), "left_semi")  # most texts are wanted by nobody, and aren't shuffled
        texts = near.join(wanted, F.col("id").eqNullSafe(F.col("of")) & (F.col("th") == F.col("of_th"))).select("k", "pivots", "shared", "text")
        return texts.mapInArrow(with_sets, "k long, pivots array<long>, shared binary, tokens binary"), wanted.select("k", F.explode("pivots").alias("pivot"))

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole(batches):
            x = Bundled(table, sets=True)
            label = labels_of(len(x.k), *x.small(percent))
            for at, split in x:
                maybe = x.likely(at, split, percent)
                if maybe.any():
                    label[at] = at[linked(x.sizes[at], [x.sets[y] for y in at], maybe, percent)]
            far = label != np.arange(len(x.k))
            yield pa.RecordBatch.from_arrays([pa.array(x.k[far]), pa.array(x.k[label[far]])], names=["a", "b"])

    def in_order(rows: DataFrame) -> DataFrame:
        return rows.repartition("pivot", "i", "j").sortWithinPartitions("pivot", "i", "j", "own", "k")

    each = members.select("k", "n", "shared", "cells", "pivots", F.explode("pivots").alias("pivot"))
    huge = staged(each.groupBy("pivot").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > heads_from * block).select(F.col("pivot").alias("of")))
    labels = edges = None
    if huge.take(1):
        sets, bundled = sets_of(salted_join(each.select("k", "pivot"), huge, {"pivot": "of"}, "left_semi"))
        labels, edges = heads_of(bundled, staged(sets), percent, block)
        labels = labels.select(F.col("k").alias("l_k"), F.col("pivot").alias("l_pivot"), "label")

    def labelled(rows: DataFrame) -> DataFrame:
        if labels is None:
            return rows.withColumn("label", F.lit(None).cast("long"))
        return rows.join(labels, (F.col("k") == F.col("l_k")) & (F.col("pivot") == F.col("l_pivot")), "left").drop("l_k", "l_pivot")

    some = in_order(dealt(labelled(each), block)).mapInArrow(likely, "k long, pivot long")
    sets, bundled = sets_of(some)
    # Blocks are counted before the texts are fetched.
    bundles = dealt(labelled(bundled), block).groupBy("k").agg(F.collect_set(F.struct("pivot", "own", "i", "j")).alias("bundles")).withColumnRenamed("k", "of_k")
    ready = sets.join(bundles, F.col("k") == F.col("of_k")).withColumn("x", F.explode("bundles")).select("k", "pivots", "shared", "tokens", "x.*")
    verified = in_order(ready).mapInArrow(links, "a long, b long")
    roots = components(verified if edges is None else verified.unionByName(edges))
    # A set, and so a class, may hold a third of all rows.
    every = staged(salted_join(nodes.select("id", "n", "k"), roots.withColumnRenamed("a", "of"), {"k": "of"}, "left").select("id", "n", F.coalesce("root", "k").alias("c")))
    least = every.filter("c is not null").groupBy("c").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").select(F.col("c").alias("of"), "component_id")
    return salted_join(every, least, {"c": "of"}, "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
