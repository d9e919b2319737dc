"""Phrase collocations: padded longest windows are counted once, and a ROLLUP sums their shorter prefixes."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import salted_join, staged

#: What ends a piece of text, as bytes.
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
#: A byte that no UTF-8 text has stands for a break.
_BREAK = b"\xff"
_TABLE = bytes.maketrans(bytes(range(65, 91)) + b"\x09" + BREAKS, bytes(range(97, 123)) + b" " + _BREAK * len(BREAKS))
#: Texts are read in slices of about so many bytes, and counted about every so many words; a task's dictionary is emptied when it is larger than KNOWN.
SLICE, WORDS, KNOWN = 1 << 20, 1 << 19, 1 << 19
#: An odd number whose powers make up words' hashes. They only say what may be frequent, so words that share one are counted apart all the same.
BASE = 0x9E3779B97F4A7C15
#: Bits of a pair's bucket. Buckets only say which pairs may be frequent.
BUCKET = 40
#: Joins by phrase part are dealt to so many salts: a common word begins and ends many phrases.
SALTS = 8


def slices(text: bytes) -> Iterator[bytes]:
    """A text in slices, breaks and spaces made one byte each, A to Z small; no word is cut."""
    at = 0
    while at < len(text):
        end = at + SLICE
        while end < len(text) and _TABLE[text[end]] not in b" \xff":
            end += 1
        yield text[at:end].translate(_TABLE)
        at = end


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """A text's words in order, breaks among them, slice by slice."""
    for part in slices(text):
        yield part.replace(_BREAK, b" \xff ").split()


@lru_cache(8)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64."""
    out = []
    for x in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(n, x, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


def hashed(part: bytes, lang: str) -> tuple[np.ndarray, np.ndarray, bool]:
    """Hashes of a slice's words, whether a break follows each, and whether one comes before the first. All words at once: sums of powers up to a word's ends tell its own."""
    a = np.frombuffer(part, np.uint8)
    word = (a != 32) & (a != 255)
    edge = np.diff(np.concatenate([[False], word, [False]]).view(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(1 << max(20, int(len(a)).bit_length()))
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a + np.uint64(1)) * up[: len(a)], out=total[1:])
    keys = (total[ends] - total[starts]) * down[starts]
    keys = (keys ^ np.uint64(zlib.crc32(lang.encode()) << 20)) * np.uint64(0xC2B2AE3D27D4EB4F)
    keys ^= keys >> np.uint64(31)
    breaks = np.zeros(len(a) + 1, np.int64)
    np.cumsum(a == 255, out=breaks[1:])
    after = np.append(starts[1:], len(a)) if len(starts) else starts
    return keys, breaks[after] > breaks[ends], bool(breaks[starts[0]] if len(starts) else breaks[-1])


def hash_words(words: list[bytes], langs: list[str]) -> np.ndarray:
    """The same hashes for words of which each has its language."""
    out = np.zeros(len(words), np.uint64)
    names, of = np.unique(np.array(langs, object).astype(str), return_inverse=True)
    for k, lang in enumerate(names.tolist()):
        mine = np.flatnonzero(of == k)
        for lo in range(0, len(mine), 1 << 16):
            at = mine[lo : lo + (1 << 16)]
            out[at] = hashed(b" ".join([words[i] for i in at.tolist()]), lang)[0]
    return out


class Known(dict):
    """Numbers of the words of one language."""

    def __init__(self, names: list[bytes], langs: list[str], lang: str):
        super().__init__({_BREAK: -1})
        self.names, self.langs, self.lang = names, langs, lang

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.names)
        self.names.append(word)
        self.langs.append(self.lang)
        return number


def counted(docs: DataFrame, count: Callable, schema: str) -> DataFrame:
    """What count(numbers, names, langs) gives for each stretch of the documents' words: -1 between pieces and texts, else a word's number in the task's lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, langs, by = [], [], {}
        held, n = [], 0
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
                known = by.get(lang)
                if known is None:
                    known = by[lang] = Known(names, langs, lang)
                for part in tokens(text.as_py()):
                    held.append(np.fromiter(map(known.__getitem__, part), np.int32, len(part)))
                    n += len(part)
                held.append(np.full(1, -1, np.int32))
                if n >= WORDS:
                    yield count(np.concatenate(held), names, langs)
                    held, n = [], 0
                    if len(names) > KNOWN:
                        names, langs, by = [], [], {}
        if n:
            yield count(np.concatenate(held), names, langs)

    return docs.mapInArrow(run, schema)


def counted_hashes(docs: DataFrame, count: Callable, schema: str) -> DataFrame:
    """What count(keys, joined) gives for each stretch of words of one language: their hashes, and whether the next word is in the same piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short: dict[str, list[bytes]] = {}  # texts that are hashed together
        sizes: dict[str, int] = {}
        held, n = [], 0

        def add(part: bytes, lang: str, goes_on: bool) -> int:
            keys, broken, before = hashed(part, lang)
            if held and before and goes_on:
                held[-1][1][-1:] = False
            if len(keys):
                held.append((keys, ~broken))
            return len(keys)

        def close() -> None:
            if held:
                held[-1][1][-1:] = False

        def together(lang: str) -> int:
            close()
            many = add(_BREAK.join(short.pop(lang)).translate(_TABLE), lang, False)
            sizes.pop(lang)
            close()
            return many

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
                text = text.as_py()
                if len(text) > SLICE:
                    close()
                    for part in slices(text):
                        n += add(part, lang, True)
                    close()
                else:
                    short.setdefault(lang, []).append(text)
                    sizes[lang] = sizes.get(lang, 0) + len(text) + 1
                    if sizes[lang] > SLICE:
                        n += together(lang)
                if n >= WORDS:
                    yield count(*map(np.concatenate, zip(*held)))
                    held.clear()
                    n = 0
        for lang in list(short):
            together(lang)
        if held:
            yield count(*map(np.concatenate, zip(*held)))

    return docs.mapInArrow(run, schema)


def bitmap(rows: DataFrame, key: Column, bits: int) -> np.ndarray:
    """The set bits of the keys' lowest bits, as words of 64. It is made in tasks and never larger than 2**bits bits."""
    at = key.bitwiseAND(F.lit((1 << bits) - 1))
    one = F.expr("shiftleft(1L, cast(at & 63 as int))")
    cells = rows.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("cell")).agg(F.bit_or(one).alias("word")).toArrow()
    out = np.zeros(max(1, (1 << bits) // 64), np.int64)
    out[cells["cell"].to_numpy()] = cells["word"].to_numpy()
    return out.view(np.uint64)


def _set(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    keys = keys & np.uint64(len(bits) * 64 - 1)
    return (bits[keys >> np.uint64(6)] >> (keys & np.uint64(63))) & np.uint64(1) == 1


def _mixed(keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    mixed = (keys * np.uint64(0x9E3779B97F4A7C15)) ^ (hashes * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(7))
    return mixed * np.uint64(0x165667B19E3779F9) >> np.uint64(64 - BUCKET)


def neighbours(keys: np.ndarray, joined: np.ndarray, filters: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For pairs, then triples: whether the words from each place on may be a frequent one, and the buckets of these places.

    Filters are the bitmaps of frequent words, pairs and triples, as far as they are known. A triple needs two pairs.
    """
    first = keys
    on = _set(filters[0].value, keys)
    on = np.append(on[:-1] & on[1:] & joined[:-1], False)
    for k in (1, 2):
        at = np.flatnonzero(on)
        bucket = _mixed(keys[at], first[at + k])
        if len(filters) > k:
            on[at] = _set(filters[k].value, bucket)
        yield on, bucket
        keys = keys.copy()
        keys[at] = bucket
        on = np.append(on[:-1] & on[1:], False)


def frequent_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of words as signed numbers."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(hash_words(b.column(1).cast(pa.binary()).to_pylist(), b.column(0).to_pylist()).view(np.int64))], names=["key"])


def count_words(numbers: np.ndarray, names: list[bytes], langs: list[str]) -> pa.RecordBatch:
    n = np.bincount(numbers[numbers >= 0], minlength=len(names))
    used = np.flatnonzero(n).tolist()
    return pa.RecordBatch.from_arrays([pa.array([langs[i] for i in used], pa.string()), pa.array([names[i] for i in used], pa.binary()).cast(pa.string()), pa.array(n[used], pa.int64())], ["lang", "word", "n"])


def count_buckets(filters: list) -> Callable:
    """How often each bucket of pairs occurs, or of triples where the pairs' filter is there: those whose shorter parts may be frequent."""

    def count(keys: np.ndarray, joined: np.ndarray) -> pa.RecordBatch:
        _, found = list(islice(neighbours(keys, joined, filters), len(filters)))[-1]
        bucket, n = np.unique(found, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int64)), pa.array(n, pa.int64())], ["bucket", "n"])

    return count


def count_windows(filters: list) -> Callable:
    """The longest windows: from each word, up to four words of which all pairs and triples may be frequent, padded with empty words."""

    def count(numbers: np.ndarray, names: list[bytes], langs: list[str]) -> pa.RecordBatch:
        whole = numbers >= 0
        keys = np.append(hash_words(names, langs), np.uint64(0))[numbers]
        (two, _), (three, _) = neighbours(keys, np.append(whole[:-1] & whole[1:], False), filters)
        at = np.flatnonzero(two)
        lead = np.append(numbers, [-1] * 3).astype(np.int64)
        third = three[at]
        fourth = third & three[at + 1]
        columns = [lead[at], lead[at + 1], np.where(third, lead[at + 2], -1), np.where(fourth, lead[at + 3], -1)]
        halves = [np.unique((a << 32) | (b + 1), return_inverse=True) for a, b in (columns[:2], columns[2:])]
        _, first, n = np.unique((halves[0][1].astype(np.int64) << 32) | halves[1][1], return_index=True, return_counts=True)
        used, where = np.unique(np.concatenate([c[first] for c in columns]), return_inverse=True)
        words = pa.array([b"" if i < 0 else names[i] for i in used.tolist()], pa.binary()).cast(pa.string())
        of = pa.array(["" if i < 0 else langs[i] for i in used.tolist()], pa.string())
        where = where.reshape(4, -1)
        return pa.RecordBatch.from_arrays([of.take(pa.array(where[0])), *(words.take(pa.array(w)) for w in where), pa.array(n, pa.int64())], ["lang", "w1", "w2", "w3", "w4", "n"])

    return count


def mine_phrases(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = 30, top: int = 2000, scale: int = 2_000_000, inside: int = 80, filter_bits: int = 26
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases of two to four words.

    Texts are read four times. First all words are counted. Then pairs, and after them triples, whose parts are frequent are counted by buckets of 40 bits; last, the windows of up to four
    words within a piece, whose pairs and triples all lie in buckets of min_count, are counted as they stand. The whole windows are phrases of four words; ROLLUP sums windows to the phrases of two
    and three words that they begin with. What a window leaves out can't be part of a phrase of min_count. The words and buckets that tasks
    look up are bitmaps of 2**filter_bits bits whatever the input: a word, pair or triple that isn't frequent but shares a bit is counted as well and then dropped by its own count, so
    counts are exact at every size, and a full bitmap costs time only.

    A phrase's score is that of its lowest cut, ties to the shortest first part; a phrase inside a longer one with inside percent of its count is dropped. Ties in score
    go to the higher count, then the smaller phrase by bytes. A null text has no words, a null language is und; languages without words or phrases have no rows. Repeated rows count as
    often as they are there. Other columns aren't read.
    """
    spark = docs.sparkSession
    read = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = staged(counted(read, count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    common = words.filter(F.col("n") >= min_count)
    filters = [spark.sparkContext.broadcast(bitmap(common.select("lang", "word").mapInArrow(frequent_words, "key long"), F.col("key"), filter_bits))]
    for _ in range(2):
        buckets = counted_hashes(read, count_buckets(list(filters)), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
        filters.append(spark.sparkContext.broadcast(bitmap(buckets.filter(F.col("n") >= min_count), F.col("bucket"), filter_bits)))
    order = ["lang", "w1", "w2", "w3", "w4"]
    windows = staged(counted(read, count_windows(filters), "lang string, w1 string, w2 string, w3 string, w4 string, n long").groupBy(*order).agg(F.sum("n").alias("n")))
    longest = windows.filter((F.col("w4") != "") & (F.col("n") >= min_count)).select(*order, F.lit(4).alias("size"), F.col("n").alias("a"))
    summed = spark.sql("SELECT lang, w1, w2, w3, '' AS w4, 3 - grouping(w3) AS size, sum(n) AS a FROM {windows} GROUP BY lang, w1, w2, ROLLUP(w3) HAVING sum(n) >= {least}", windows=windows, least=min_count)
    # Padding at a level's last word belongs to the level above.
    summed = summed.filter((F.col("size") == 2) | (F.col("w3") != "")).withColumn("w3", F.coalesce("w3", F.lit("")))
    words_in = F.filter(F.array("w1", "w2", "w3", "w4"), lambda w: w != "")
    found = staged(longest.unionByName(summed).select("lang", F.array_join(words_in, " ").alias("phrase"), F.col("size").cast("int").alias("size"), "a"))

    counts = found.select(F.col("lang").alias("of"), F.col("phrase").alias("part"), F.col("a").alias("f")).unionByName(common.select(F.col("lang").alias("of"), F.col("word").alias("part"), F.col("n").alias("f")))
    cuts = staged(found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))))
    for name, part in (("l", "substring_index(phrase, ' ', k)"), ("r", "substring_index(phrase, ' ', k - size)")):
        cuts = salted_join(cuts.withColumn("at", F.expr(part)), counts, {"lang": "of", "at": "part"}, salts=SALTS).withColumnRenamed("f", name).drop("of", "part", "at")
    # Of 19 digits and the scale's: no product is too long.
    exact = lambda x: F.col(x).cast("decimal(19,0)")
    cuts = cuts.withColumn("scaled", F.lit(scale).cast("decimal(10,0)") * exact("a")).withColumn("parts", exact("l") + exact("r")).withColumn("score", F.expr("scaled div parts"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    parts = F.split("phrase", " ")
    inner = [F.array_join(F.slice(parts, F.lit(i), F.lit(k)), " ") for k, i in ((2, 1), (2, 2), (2, 3), (3, 1), (3, 2))]
    three = F.array(*inner[:2])
    held = found.filter(F.col("size") > 2).select(F.col("lang").alias("of"), F.explode(F.array_distinct(F.when(F.col("size") == 3, three).otherwise(F.array(*inner)))).alias("part"), "a")
    held = held.groupBy("of", "part").agg(F.max("a").alias("longer"))
    alone = scored.join(held, (F.col("lang") == F.col("of")) & (F.col("phrase") == F.col("part")), "left")
    alone = alone.filter(F.col("longer").isNull() | (F.lit(100).cast("decimal(3,0)") * exact("longer") < F.lit(inside).cast("decimal(3,0)") * exact("a"))).drop("of", "part")

    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    best = alone.withColumn("rank", rank).filter(F.col("rank") <= top)
    total = words.groupBy(F.col("lang").alias("of")).agg(F.sum("n").alias("n"))
    return best.join(total, F.col("lang") == F.col("of")).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
