"""Removal of long repeated byte strings by a run-length compressed index of the text that may repeat."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salted_join, staged, utf8

_U = np.uint64
_GRAM = 32
_STEPS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)
#: Starts of strings that one region holds at most, and bytes of regions that one index holds.
_STARTS = 512
SHARD = 1 << 21
#: Different regions of one key beyond which its strings are counted one by one instead of in one index.
HOT = 4096


def gram_hashes(text: np.ndarray) -> np.ndarray:
    """A hash of the 32 bytes from each place on."""
    h, step = text.astype(_U) + _U(0x9E37), 1
    for m in _STEPS:
        h = h[:-step] * _U(m) + (h[step:] ^ (h[step:] >> _U(29)))
        step *= 2
    h ^= h >> _U(31)
    h *= _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(29))


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w neighbours, from running minima of blocks of w."""
    n, m = len(h), -(-len(h) // w) * w
    p = np.full(m, ~_U(0))
    p[:n] = h
    rows = p.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def regions(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, first byte, number of bytes, and whether it may repeat within itself, of each region: runs of starts whose strings have the same smallest gram hash.

    Each start of a string of the length is in one region, and equal strings are in regions of equal key. A region in which its
    key's gram occurs twice may hold a string twice.
    """
    if len(text) < length:
        return np.empty(0, _U), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    h, w = gram_hashes(np.frombuffer(text, np.uint8)), length - _GRAM + 1
    low = sliding_min(h, w)
    new = np.concatenate(([True], low[1:] != low[:-1]))
    at = np.arange(len(low))
    new |= (at - np.maximum.accumulate(np.where(new, at, 0))) % _STARTS == 0
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(low))) + length - 1
    # A gram is the smallest of some string around it if the largest minimum of these strings is its own.
    around = ~sliding_min(~np.concatenate([np.zeros(w - 1, _U), low, np.zeros(w - 1, _U)]), w)
    places = np.flatnonzero(h == around)
    first, last = np.searchsorted(places, start), np.searchsorted(places, start + size - _GRAM, "right")
    times = np.zeros(len(start), np.int64)
    for k in range(int((last - first).max())):
        i = np.minimum(first + k, len(places) - 1)
        times += (first + k < last) & (h[places[i]] == low[start])
    return low[start], start, size, times > 1


def _places(n: int) -> type[np.signedinteger]:
    """Type of places in a text of n symbols: two of them can be added."""
    return np.int32 if n < 1 << 30 else np.int64


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes of symbols (0 to 256) in order, by doubling: a rank is the first place of a suffix's group, and only groups of several are sorted on."""
    n = len(symbols)
    kind = _places(n)
    padded = np.concatenate([symbols.astype(np.int16), np.zeros(7, np.int16)])
    key = np.zeros(n, np.int64)
    for i in range(7):
        key *= 257
        key += padded[i : i + n]
    order, done = np.argsort(key), 7
    key = key[order]
    order = order.astype(kind)
    first = np.concatenate(([True], key[1:] != key[:-1]))
    places = np.arange(n, dtype=kind)
    head = np.maximum.accumulate(np.where(first, places, kind(0)))
    rank = np.empty(n + 1, kind)
    rank[order], rank[n] = head + kind(1), 0
    del key, head
    while True:
        alone = first & np.append(first[1:], True)
        slots = places[~alone]
        if not len(slots):
            return order
        at = order[slots]
        # One number for the group and the rank of what follows; a suffix that ends there comes first.
        key = rank[at].astype(np.int64)
        key *= n + 2
        key += rank[np.minimum(at + kind(done), kind(n))]
        by = np.argsort(key)
        key = key[by]
        at = at[by]
        order[slots] = at
        new = np.concatenate(([True], key[1:] != key[:-1]))
        del key, by
        rank[at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots), dtype=kind), kind(0)))] + kind(1)
        places, first = slots, new
        done = min(2 * done, n)  # no suffix is longer


def common_prefixes(symbols: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of suffixes a and b."""
    n = len(symbols)
    padded = np.concatenate([symbols.astype(np.uint16), np.zeros(14, np.uint16)])
    word = np.zeros(n + 7, _U)
    for i in range(7):
        word <<= _U(9)
        word |= padded[i : i + n + 7]
    out, left = np.zeros(len(a), _places(n)), np.arange(len(a), dtype=_places(len(a)))
    a, b = a.copy(), b.copy()
    while len(left):
        x = word[a] ^ word[b]
        same = x == 0
        if not same.all():
            bits = np.frexp(x[~same].astype(np.float64))[1]  # place of the highest bit that differs
            # Rounding up to a power of two happens only when all lower bits of a symbol's group are set, so look again.
            bits -= (x[~same] >> np.maximum(bits - 1, 0).astype(_U)) == 0
            out[left[~same]] += 7 - (bits + 8) // 9
        left, a, b = left[same], a[same] + 7, b[same] + 7
        out[left] += 7
        more = (a < n) & (b < n)
        left, a, b = left[more], a[more], b[more]
    return out


class RunIndex:
    """Run-length Burrows-Wheeler transform of texts, with samples at the ends of its runs.

    Within a run, a suffix's neighbour follows from that of the suffix one byte longer, and their common prefix is one
    byte shorter. So common prefixes are compared only where runs meet, and one pass over the text gives the rest.
    """

    def __init__(self, texts: Sequence[bytes]) -> None:
        self.sizes = np.array([len(t) for t in texts])
        joined = np.frombuffer(b"\0".join(texts), np.uint8).astype(np.int16) + np.int16(1)
        self.starts = np.cumsum(self.sizes + 1) - self.sizes - 1
        joined[self.starts[1:] - 1] = 0
        self.symbols = joined
        order = suffix_array(joined)
        before = np.where(order > 0, joined[order - 1], np.int16(-1))
        heads = np.flatnonzero(before[1:] != before[:-1]) + 1  # a run ends before each and begins at it
        self.first, self.last = order[np.concatenate(([0], heads))], order[np.concatenate((heads - 1, [len(order) - 1]))]
        self.runs = len(heads) + 1
        common = common_prefixes(joined, order[heads], order[heads - 1])
        self.up, self.down = np.concatenate(([0], common)), np.concatenate((common, [0]))

    def matching_statistics(self) -> np.ndarray:
        """For each place of the joined texts, the longest string from there on that also starts elsewhere."""
        n = len(self.symbols)
        return np.maximum(_streamed(n, self.first, self.up), _streamed(n, self.last, self.down))

    def repeated(self, length: int) -> list[np.ndarray]:
        """Per text, the places at which strings of the length begin that also start elsewhere."""
        found = np.flatnonzero(self.matching_statistics() >= length)
        of = np.searchsorted(self.starts, found, "right") - 1
        fits = found + length <= self.starts[of] + self.sizes[of]
        found, of = found[fits], of[fits]
        cut = np.searchsorted(of, np.arange(len(self.sizes) + 1))
        return [found[a:b] - self.starts[i] for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True))]


def _streamed(n: int, places: np.ndarray, values: np.ndarray) -> np.ndarray:
    kind = _places(n)
    known, at = np.full(n, -1, kind), np.arange(n, dtype=kind)
    known[places] = values
    at = np.maximum.accumulate(np.where(known >= 0, at, kind(0)))
    known = known[at]
    known += at
    known -= np.arange(n, dtype=kind)
    return np.maximum(known, kind(0), out=known)


def spans_of(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes that strings at ascending starts cover."""
    if not len(starts):
        return starts, starts
    new = np.flatnonzero(starts[1:] > starts[:-1] + length) + 1
    return starts[np.concatenate(([0], new))], starts[np.concatenate((new - 1, [len(starts) - 1]))] + length


def repeated_spans(texts: DataFrame, length: int = 200) -> DataFrame:
    """texts(t, n, text), t a hash of the text -> (t, n, start, end): spans of bytes covered by repeated strings; they may touch or overlap."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in batches:
            key, digest, of, start, size, inner = [], [], [], [], [], []
            for i, (t, text) in enumerate(zip(b.column(0).to_pylist(), b.column(2), strict=True)):
                data = text.as_py()
                if (t, len(data)) in seen:
                    continue
                seen.add((t, len(data)))
                k, s, n, within = regions(data, length)
                view = memoryview(data)
                digest.append(np.fromiter((xxhash.xxh3_64_intdigest(view[a:e]) for a, e in zip(s.tolist(), (s + n).tolist(), strict=True)), _U, len(s)))
                key.append(k)
                of.append(np.full(len(s), i))
                start.append(s)
                size.append(n)
                inner.append(within)
            if key:
                of = pa.array(np.concatenate(of))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(key).view(np.int64)), pa.array(np.concatenate(digest).view(np.int64)), b.column(0).take(of), b.column(1).take(of), pa.array(np.concatenate(start) << 16 | np.concatenate(size) << 1 | np.concatenate(inner))],
                    names=["key", "digest", "t", "n", "place"],
                )

    rows = staged(texts.mapInArrow(cut, "key long, digest long, t long, n long, place long"))  # place: first byte, number of bytes, inner
    inner = F.max(F.col("place").bitwiseAND(F.lit(1))) == 1
    keys = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c"), (F.min("digest") != F.max("digest")).alias("differ"), inner.alias("inner"))
    keys = keys.filter("c > 1 or inner").select("key", (F.col("differ") | F.col("inner")).alias("mixed"))
    # A passage may be in a third of all texts: keys and regions are joined by salt as well.
    shared = staged(salted_join(rows, keys.withColumnRenamed("key", "of"), {"key": "of"}).drop("of"))
    each = staged(shared.groupBy("key", "digest", "mixed").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("t", "n", "place")).alias("one")))
    start, size = F.shiftright("place", 16), F.shiftright(F.col("place").bitwiseAND(F.lit(0xFFFF)), 1)
    again = each.filter("c > 1").select(F.col("key").alias("of"), F.col("digest").alias("of_digest"))
    whole = salted_join(shared, again, {"key": "of", "digest": "of_digest"}, "left_semi").select("t", "n", start.alias("start"), (start + size).alias("end"))

    # Keys with several different regions: their bytes go to an index, or string by string if there are too many.
    mixed = each.filter("mixed").select("key", "c", "one.*")
    counts = mixed.groupBy("key").agg(F.count(F.lit(1)).alias("different"))
    wanted = mixed.join(counts, "key").withColumn("row", F.struct("key", (F.col("c") == 1).alias("once"), (F.col("different") > HOT).alias("hot"), start.alias("start"), size.alias("size")))
    by_text = wanted.groupBy("t", "n").agg(F.collect_list("row").alias("rows"))
    total = mixed.agg(F.sum(size)).first()[0] or 0
    shards = max(1, -(-total // SHARD))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = set()
        for b in batches:
            out = []
            for t, n, text, rows in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (t, n) in done:
                    continue
                done.add((t, n))
                for r in rows:
                    a, e = r["start"], r["start"] + r["size"]
                    if r["hot"]:
                        out += [(r["key"], True, r["once"], t, n, x, xxhash.xxh3_128_digest(text[x : x + length])) for x in range(a, e - length + 1)]
                    else:
                        out.append((r["key"], False, r["once"], t, n, a, text[a:e]))
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            types = [pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, types, strict=True)], names=["key", "hot", "once", "t", "n", "start", "bytes"])

    fetched = texts.join(by_text, ["t", "n"]).select("t", "n", "text", "rows").mapInArrow(fetch, "key long, hot boolean, once boolean, t long, n long, start long, bytes binary")
    fetched = staged(fetched)
    hot = fetched.filter("hot").select(F.col("bytes").alias("string"), "once", "t", "n", "start")  # a string by its 128-bit hash
    twice = hot.groupBy("string").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(F.col("string").alias("of"))
    counted = salted_join(hot.filter("once"), twice, {"string": "of"}, "left_semi").select("t", "n", "start", (F.col("start") + length).alias("end"))

    def indexed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("t", "ascending"), ("start", "ascending")])
        index = RunIndex(table["bytes"].to_pylist())
        of, lo, hi = [], [], []
        for i, (found, once) in enumerate(zip(index.repeated(length), table["once"].to_pylist(), strict=True)):
            if once and len(found):
                a, e = spans_of(found, length)
                of.append(np.full(len(a), i))
                lo.append(a)
                hi.append(e)
        at = pa.array(np.concatenate([np.empty(0, np.int64), *of]))
        start, n = table["start"].take(at).to_numpy(), table["n"].take(at)
        return pa.table({"t": table["t"].take(at), "n": n, "start": start + np.concatenate([np.empty(0, np.int64), *lo]), "end": start + np.concatenate([np.empty(0, np.int64), *hi])})

    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")
    in_index = fetched.filter("not hot").withColumn("shard", shard).select("shard", "once", "t", "n", "start", "bytes")
    matched = in_index.groupBy("shard").applyInArrow(indexed, "t long, n long, start long, end long")
    return whole.unionByName(counted).unionByName(matched)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, as_text: bool = False) -> DataFrame:
    """docs' own columns, and n_bytes, n_removed, n_spans, spans (start, end in bytes) and kept of each row's text.

    kept: the bytes that are left; as text, a string without the characters that a cut halves.

    Removes each byte that a string of length bytes covers which also starts at another place of any row's text, the same row
    included. Strings are dealt by their smallest hash of 32 bytes, so equal ones meet, and each start is in one region of
    text. Keys met once can't repeat. Regions met twice or more are removed whole; different regions of one key go to run-length
    indexes of about SHARD bytes, whose matching statistics mark what repeats; keys with over HOT different regions are
    counted string by string, by 128-bit hashes. Texts are told apart by their length and a 64-bit hash, regions of one key by another one: of N different
    texts of one length, about N**2 / 2**65 pairs are expected to count as copies. A null text is empty; texts under length bytes keep all; equal texts of at least length
    bytes lose all, under whatever ids; an empty table gives an empty one. The added columns take the place of columns of docs of those names.
    """
    added = ("n_bytes", "n_removed", "n_spans", "spans", "kept")
    own = {c: f"c{i}" for i, c in enumerate(docs.columns) if c not in added}
    rows = docs.select(*[F.col(c).alias(k) for c, k in own.items()]).withColumn("bytes", utf8(own[text_col]))
    rows = rows.withColumn("t", F.xxhash64("bytes")).withColumn("n", F.octet_length("bytes").cast("long"))
    keys = rows.select("t", "n", F.col("bytes").alias("text"))
    copies = keys.groupBy("t", "n").agg(F.count(F.lit(1)).alias("c")).filter(f"c > 1 and n >= {length}").select("t", "n", F.lit(0).cast("long").alias("start"), F.col("n").alias("end"))
    spans = repeated_spans(keys.filter(F.col("n") >= length), length).unionByName(copies)
    by_text = staged(spans.groupBy("t", "n").agg(F.collect_set(F.struct("start", "end")).alias("spans"))).withColumnRenamed("t", "of_t").withColumnRenamed("n", "of_n")
    joined = salted_join(rows, by_text, {"t": "of_t", "n": "of_n"}, "left", salts=8).drop("t", "of_t", "of_n")  # a text may have very many copies
    carried = joined.select(*own.values(), F.col("n").alias("n_bytes"), "bytes", "spans")

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, lists = b.column(b.num_columns - 2), b.column(b.num_columns - 1)
            out, gone, kept = [], [], []
            for text, spans in zip(texts.to_pylist(), lists.to_pylist(), strict=True):
                merged: list[list[int]] = []
                for s in sorted((x["start"], x["end"]) for x in spans or ()):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
                ends = [0, *(e for _, e in merged)]
                kept.append(b"".join(text[a:b] for a, b in zip(ends, [*(a for a, _ in merged), len(text)], strict=True)))
                gone.append(sum(e - a for a, e in merged))
                out.append([{"start": a, "end": e} for a, e in merged])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-2], pa.array(gone, pa.int64()), pa.array([len(x) for x in out], pa.int64()), pa.array(out, kind), pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary())],
                names=[*b.schema.names[:-2], "n_removed", "n_spans", "spans", "kept"],
            )

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in carried.schema.fields[:-2])
    out = carried.mapInArrow(removed, f"{fields}, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept {'string' if as_text else 'binary'}")
    return out.select(*[F.col(k).alias(c) for c, k in own.items()], *added)
