"""Operators on documents against brute force, on texts with nulls, empties, copies, near copies, ties and repeated ids."""

import hashlib
import json
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    r = random.Random(7)
    vocabulary = ["".join(r.choice("abcdefghijklmnopé") for _ in range(r.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage, line = prose(60), prose(12)
    base = prose(150).split(" ")
    texts = [None, "", " \n\t ", "one", "two words", prose(4), "a b c d e", "x" * 900, "ab " * 400, "日本語 " * 80, (line + "\n") * 30, prose(6000)]
    texts += [prose(r.randint(20, 200)) for _ in range(40)]
    texts += [prose(30) + "\n" + passage + "\n" + prose(30) for _ in range(6)]
    for k in range(25):  # near copies of different strength
        words = list(base)
        for _ in range(r.randint(0, 6)):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        texts.append(" ".join(words))
    texts += [texts[15]] * 5 + [texts[20].upper()] * 2
    sources = ["web", "book", "code", "news", None]
    rows = [(i, t, "en", sources[0] if i % 3 else sources[i % 5], len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[15], (16, "another text of a repeated id", "de", "web", 3)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    # extra columns whose names the operators use themselves
    spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS n", "2 AS k", "3 AS t", "'x' AS bytes", "4 AS part").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def found(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_quality(docs, rows, empty):
    from emberlens.llm.quality import quality_rules

    want = []
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k + x for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for x in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        n, rep = len(w), len(covered)
        want.append((i, n, sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), len(lines) - len(set(lines)), rep, n < 50 or 100 * rep > 50 * n))
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    out = quality_rules(docs)
    assert found(out, *cols) == sorted(want, key=repr)
    assert not out.filter("kept and base_failed").count()
    assert quality_rules(empty).count() == 0


def test_bad_host_is_rejected_and_small_ones_are_shrunk(spark):
    from emberlens.llm.quality import quality_rules

    good, bad = " ".join(f"w{i}" for i in range(60)), "short"
    rows = [(i, good, "en", f"h{i % 5}", 0) for i in range(200)] + [(1000 + i, good if i < 10 else bad, "en", "junk", 0) for i in range(100)] + [(2000, good, "en", "new", 0), (2001, bad, "en", "new2", 0)]
    out = {r.doc_id: r.kept for r in quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(out[i] for i in range(200)) and not any(out[1000 + i] for i in range(100))
    assert out[2000] and not out[2001]


def removed(texts, length):
    c = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    for b in texts:
        cover = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if c[b[i : i + length]] > 1:
                cover[i : i + length] = b"\1" * length
        yield sum(cover), sum(1 for i, x in enumerate(cover) if x and not (i and cover[i - 1])), bytes(x for x, y in zip(b, cover, strict=True) if not y)


@pytest.mark.parametrize("hot", [4096, 1])
def test_repeats(docs, rows, empty, hot, monkeypatch):
    from emberlens.llm import repeats

    monkeypatch.setattr(repeats, "HOT", hot)
    texts = [(t or "").encode() for _, t, *_ in rows]
    want = [(r[0], len(b), gone, spans, hashlib.sha256(kept).hexdigest()) for r, b, (gone, spans, kept) in zip(rows, texts, removed(texts, 200), strict=True)]
    out = repeats.remove_repeats(docs)
    assert found(out.selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256) h"), "doc_id", "n_bytes", "n_removed", "n_spans", "h") == sorted(want, key=repr)
    if hot > 1:
        assert out.filter("k <> 2 OR t <> 3 OR bytes <> 'x'").count() == 0
        assert repeats.remove_repeats(empty).count() == 0


def test_run_index_against_brute_force():
    from emberlens.llm.repeats import RunIndex

    r = random.Random(3)
    for _ in range(150):
        alphabet = r.choice([b"ab", b"abcdefgh", b"\x00\xff a"])
        pool = [bytes(r.choice(alphabet) for _ in range(r.randint(20, 120))) for _ in range(5)]
        texts = [b"".join(r.choice(pool) if r.random() < 0.6 else bytes(r.choice(alphabet) for _ in range(r.randint(1, 30))) for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 12))]
        texts = list(dict.fromkeys(texts))
        n = r.choice([5, 20, 50])
        c = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
        index = RunIndex(texts)
        assert [x.tolist() for x in index.repeated(n)] == [[i for i in range(len(t) - n + 1) if c[t[i : i + n]] > 1] for t in texts]
        assert index.runs <= len(index.symbols)


def links(rows, percent=80):
    lower = {i: i + 32 for i in range(65, 91)}
    sets = []
    for _, t, *_ in rows:
        w = WORD.findall((t or "").translate(lower))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            k = len(sets[a] & sets[b])
            if k and 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                root[top(a)] = top(b)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[top(i)].append(r[0])
    return [(r[0], len(s), min((x for x in least[top(i)] if x is not None), default=None)) for i, (r, s) in enumerate(zip(rows, sets, strict=True))]


def test_run_index_takes_few_bytes_a_symbol():
    import tracemalloc

    from emberlens.llm.repeats import RunIndex

    rng = random.Random(5)
    base = [rng.randbytes(600) for _ in range(20)]
    texts = [base[k % 20][: 200 + k % 400] + rng.randbytes(k % 300) for k in range(1000)]
    tracemalloc.start()
    try:
        index = RunIndex(texts)
        found = index.repeated(200)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(map(len, found)) > 100_000
    assert peak < 60 * len(index.symbols)


@pytest.mark.parametrize("block", [1000, 4])
def test_jaccard(docs, rows, empty, block):
    from emberlens.llm import jaccard

    assert found(jaccard.jaccard_components(docs, block=block), "doc_id", "n_shingles", "component_id") == sorted(links(rows), key=repr)
    if block == 1000:
        assert jaccard.jaccard_components(empty).count() == 0


def shuffled(spark):
    return str(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()).count("shuffle_")


def test_staged_leaves_nothing_shuffled(spark):
    from pyspark.sql import functions as F

    from emberlens.llm.common import _CLEANUP, recorded, staged

    for _ in range(3):  # what earlier tests have shuffled may be deleted meanwhile
        before, setting = shuffled(spark), spark.conf.get(_CLEANUP)
        out = staged(spark.range(1000).repartition(7).groupBy((F.col("id") % 10).alias("k")).count())
        for _ in range(50):  # files are deleted in the background
            if shuffled(spark) <= before:
                break
            time.sleep(0.1)
        assert shuffled(spark) <= before
        assert out.count() == 10 and spark.conf.get(_CLEANUP) == setting
    with recorded() as outer:
        with recorded() as inner:
            staged(spark.range(1))
        staged(spark.range(1))
    assert len(inner) == 1 and len(outer) == 2 and outer[0] == inner[0]


def test_jaccard_keeps_no_prefixes(spark, docs):
    from pathlib import Path
    from urllib.parse import urlparse

    from emberlens.llm.common import recorded
    from emberlens.llm.jaccard import jaccard_components

    with recorded() as made:
        out = jaccard_components(docs)
    kept = [spark.read.parquet(p).columns for p in made if any(Path(urlparse(p).path).glob("*.parquet"))]
    assert any("k" in c for c in kept) and not any("prefix" in c or "total" in c for c in kept)
    assert out.count() == docs.count()


@pytest.mark.parametrize("block", [1000, 20])
def test_jaccard_of_null_and_repeated_ids_and_a_large_group(spark, block):
    from emberlens.llm import jaccard

    r = random.Random(5)
    words = lambda n: ["".join(r.choice("abcdefghijkl") for _ in range(6)) for _ in range(n)]
    base = words(150)

    def near(text, cuts):
        text = list(text)
        for at in cuts:
            text[at] = "x" + str(r.randrange(10**9))
        return text

    # 1 and 2 link to the third row, which has no id, and not to each other.
    mid = words(100)
    texts = [(1, near(mid, [20])), (2, near(mid, [70])), (None, mid), (7, near(mid, [5, 50, 95])), (None, words(40)), (None, None), (None, "")]
    texts += [(7, words(60)), (8, None), (8, words(60))]
    group = [near(base, r.sample(range(150), r.choice([0, 1, 1, 2, 2, 3, 9]))) for _ in range(150)]
    texts += [(i % 60 + 100 if i % 9 else None, t) for i, t in enumerate(group)] + [(i + 300, base) for i in range(40)]
    head = words(12)
    texts += [(500 + i, head + words(30)) for i in range(50)]  # what they share doesn't make them link
    rows = [(i, t if t is None or isinstance(t, str) else " ".join(t), "en", "s", 0) for i, t in texts]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert found(jaccard.jaccard_components(docs, block=block, heads_from=1), "doc_id", "n_shingles", "component_id") == sorted(links(rows), key=repr)


def test_mixing(docs, rows, empty):
    from pyspark.sql import functions as F

    from emberlens.llm.mixing import mix

    out = mix(docs.withColumn("doc_id", F.struct("doc_id", "source"))).toPandas()
    out["source"] = [x["source"] for x in out["doc_id"]]
    sizes = defaultdict(int)
    for _, t, _, s, _ in rows:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    budget, full = 1.5 * sum(sizes.values()), set()
    while True:
        level = (budget - sum(2 * sizes[s] for s in full)) / max(1, sum(weight[s] for s in order if s not in full))
        over = {s for s in order if s not in full and weight[s] * level > 2 * sizes[s]}
        if not over:
            break
        full |= over
    all_rows = mix(docs, copies=True)
    taken = defaultdict(int)
    for r in all_rows.collect():
        taken[r.source] += len(WORD.findall(r.text))
    longest = max(len(WORD.findall(t or "")) for _, t, *_ in rows)
    for s in order:
        target = 2.0 * sizes[s] if s in full else weight[s] * level
        got = out[out.source.isna() if s is None else out.source == s]
        assert abs(got.target.iloc[0] - target) < 1e-6 and (got.source_size == sizes[s]).all()
        assert abs(taken[s] - target) <= longest
    assert (out.taken <= 2 * out["size"]).all()
    assert sorted(map(repr, mix(docs).collect())) == sorted(map(repr, mix(docs).collect()))
    assert all_rows.columns == docs.columns and mix(empty).count() == 0


@pytest.mark.parametrize("same", [True, False])
def test_mixing_of_tied_ids(spark, same):
    from emberlens.llm.mixing import mix

    texts = [" ".join(f"w{0 if same else i}" for _ in range(6)) for i in range(1000)]
    rows = [(None, t, "en", "b", 0) for t in texts] + [(7, t, "en", "a", 0) for t in texts[:300]] + [(i, "x y z", "en", None, 0) for i in range(50)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = mix(docs).groupBy("source_size").agg({"taken": "sum", "target": "max", "repeats": "max"}).toPandas()
    assert len(out) == 3 and ((out["sum(taken)"] - out["max(target)"]).abs() <= 3).all() and out["max(repeats)"].max() <= 2
    assert mix(docs, copies=True).count() == mix(docs).agg({"repeats": "sum"}).first()[0]
    assert sorted(map(repr, mix(docs).collect())) == sorted(map(repr, mix(docs).collect()))


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    from emberlens.llm.packing import pack
    from emberlens.llm.queries import tokenizer_path

    out = pack(docs, tokenizer_path(), pieces_per_group=40).toPandas()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = []
    for i, t, *_ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        cut = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        for p, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
            want.append((i, p, a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b]))))
    assert sorted(map(tuple, out[["doc_id", "piece", "start", "length", "ids_crc32"]].values.tolist())) == sorted(want)
    out = out.sort_values(["sequence_id", "offset"])
    assert (out.offset == out.groupby("sequence_id").length.cumsum() - out.length).all()
    assert out.groupby("sequence_id").length.sum().max() <= 2048
    assert pack(empty, tokenizer_path()).count() == 0


def test_chunked_encoding_equals_the_tokenizer():
    from emberlens.llm.packing import ChunkEncoder
    from emberlens.llm.queries import tokenizer_path

    e, r = ChunkEncoder(tokenizer_path()), random.Random(1)
    parts = [" ", "  ", "\n", "\n\n", "\t", " \n", "a", "the", "'s", "é", "<|endoftext|>", "123", "...", "日本", "\x1c", "\x85", "😀", "x ", "\r\n"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(1500)]
    want = [b"".join(x.to_bytes(4, "little") for x in enc.ids) for enc in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert list(e.encode(texts)) == want
    e.ranked = None
    e.known.clear()
    assert list(e.encode(texts[:300])) == want[:300]


def jump(key, n):
    key, b, j = key % 2**64, -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_sharding(docs, rows, empty):
    from emberlens.llm.sharding import shard_by_key

    out = shard_by_key(docs, rows_per_group=2).collect()
    want = sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), jump(i, 16), jump(i, 17)) for i, t, *_ in rows)
    assert sorted((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in out) == want
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16) and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shard_by_key(empty).count() == 0


def test_jump_hash_of_odd_keys(spark):
    from pyspark.sql import functions as F

    from emberlens.llm.sharding import jump_hash

    keys = [-1, 0, 1, 2**63 - 1, -(2**63), 123456789]
    rows = spark.createDataFrame([(k,) for k in keys], "k long").select("k", *[jump_hash(F.col("k"), n).alias(f"n{n}") for n in (1, 2, 1000)]).collect()
    assert all(r[f"n{n}"] == jump(r.k, n) for r in rows for n in (1, 2, 1000))


def test_pipeline(spark, docs, rows, tmp_path):
    import corpus_pipeline as p

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {(r[0], r[1]) for r in rows}
    for (name, stage), want in zip(p.STAGES[:3], (None, None, None), strict=True):
        before = [tuple(r) for r in now.collect()]
        now = stage(spark, now, str(tmp_path))
        assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        after = [tuple(r) for r in now.collect()]
        if name == "n-gram Jaccard join":
            # One row of each class stays, one of its smallest id; rows are numbered, as ids repeat.
            least = {}
            for (i, _, c), r in zip(links([(k, *r[1:]) for k, r in enumerate(before)]), before, strict=True):
                least[c] = min(least.get(c, r[0]), r[0])
            assert sorted(r[0] for r in after) == sorted(least.values())
            assert {tuple(r) for r in after} <= {tuple(r) for r in before}
        if name == "suffix-array dedup":
            texts = [(r[1] or "").encode() for r in before]
            want = {r[0]: k.decode("utf-8", "ignore") for r, (_, _, k) in zip(before, removed(texts, 200), strict=True)}
            assert {r[0]: r[1] or "" for r in after} == want
        assert {r[0] for r in after} <= {i for i, _ in kept}
    assert p.run(spark, str(tmp_path)).count() > 0


def test_pipeline_takes_rows_not_ids(spark, tmp_path):
    import corpus_pipeline as p

    r = random.Random(11)
    prose = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(80))
    twice, one, other, copied = prose(), prose(), prose(), prose()
    rows = [(1, twice), (1, twice), (2, one), (2, other), (3, "short"), (3, prose()), (5, copied), (4, copied), (4, copied), (6, None), (None, prose()), (None, prose())]
    docs = spark.createDataFrame([(i, t, "en", "web", 0) for i, t in rows], SCHEMA).repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now = p.quality(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path))
    assert found(now, "doc_id", "text") == sorted(((i, t) for i, t in rows if t and t != "short"), key=repr)  # of id 3 only the row that passes
    now = p.near_duplicates(spark, now, str(tmp_path))
    whole = [(1, twice), (2, one), (2, other), (4, copied), *((i, t) for i, t in rows[5:] if i in (3, None))]
    assert found(now, "doc_id", "text") == sorted(whole, key=repr)  # one row of each class
    assert found(p.repeats(spark, now, str(tmp_path)), "doc_id", "text") == sorted(whole, key=repr)  # and so nothing repeats
