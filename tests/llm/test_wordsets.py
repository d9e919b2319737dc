"""Sets of many texts at once, and small bundles compared many at once, against one by one."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(text, n):
    w = WORD.findall(text.lower())
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


@pytest.mark.parametrize("stretch", [1, 300, 1 << 20])
def test_sets_of_many_texts(stretch, monkeypatch):
    from emberlens.llm import wordsets

    monkeypatch.setattr(wordsets, "STRETCH", stretch)
    r = random.Random(1)
    pool = [r.randbytes(r.choice([1, 3, 7, 8, 9, 16, 17, 63, 64, 65, 72, 200])) for _ in range(40)] + [b"a", b"A", b"aa", b"\0", b"\0\0", b"\xc2\xa0", b"x" * 8, b"x" * 16, b"x" * 64, b"x" * 65]
    texts = [b"", b" \n", b"one", b"one", b"two words", b"\x0b\x0cx\x1c\ry", b"a b c d e", b"A B C D E"] + [b" \t\n"[(k := r.randrange(3)) : k + 1].join(r.choices(pool, k=r.choice([1, 2, 4, 5, 6, 30, 200]))) for _ in range(80)]
    texts += [texts[20], texts[20] + b" ", b"\n" + texts[20]]
    rank = wordsets.ranks(np.random.default_rng(2).integers(0, 9, 1 << wordsets.BITS))
    got, keys, at = [], [], 0
    for i, j, s in wordsets.sets_of_texts(pa.array([None, *texts], pa.binary()).slice(1), 5, rank):
        assert i == at and (np.diff(s.owner.astype(int)) >= 0).all()
        cells, rare = s.cells(), s.rare_first()
        for a, b, c in zip(s.bounds, s.bounds[1:], cells, strict=False):
            assert (np.diff(s.tokens[a:b]) > 0).all() and sorted(rare[a:b]) == s.tokens[a:b].tolist()
            assert c.tolist() == np.bincount((s.tokens[a:b] >> np.uint64(60)).astype(int), minlength=16).tolist()
            by = dict(zip(s.tokens[a:b].tolist(), s.rank[a:b].tolist(), strict=True))
            assert (np.diff([by[x] for x in rare[a:b].tolist()]) >= 0).all()
            got.append(set(s.tokens[a:b].tolist()))
        keys += s.keys()
        at = j
    assert at == len(texts)
    want = [brute(t, 5) for t in texts]
    assert [len(x) for x in got] == [len(x) for x in want]
    for a in range(len(texts)):
        assert (keys[a] is None) == (not want[a])
        for b in range(a):
            assert len(got[a] & got[b]) == len(want[a] & want[b]) and ((keys[a] == keys[b]) == (want[a] == want[b]))


def test_ranks_put_rare_words_first():
    from emberlens.llm.wordsets import BITS, ranks

    counts = np.random.default_rng(3).integers(0, 1000, 1 << BITS)
    rank = ranks(counts)
    assert rank.dtype == np.uint16 and rank.max() == 65535 and (np.diff(rank[np.argsort(counts, kind="stable")].astype(int)) >= 0).all()


@pytest.mark.parametrize("sets", [False, True])
def test_small_bundles_at_once(sets, monkeypatch):
    from emberlens.llm import jaccard

    r = random.Random(4)
    rows = []
    for g in range(150):
        base, split, m = [r.getrandbits(64) for _ in range(40)], r.random() < 0.4, r.randint(1, 12)
        for k in sorted(r.sample(range(1000), m)):
            tokens = np.array(sorted({*r.sample(base, r.choice([40, 39, 37, 30, 20])), *(r.getrandbits(64) for _ in range(r.choice([0, 1, 4])))}), np.uint64)
            prefix = [x for x in tokens.view(np.int64).tolist() if x & 7 in (1, 2)]
            rows.append({"pivot": g, "i": 0, "j": int(split), "own": int(split and k % 2), "k": k, "n": len(tokens), "shared": np.array(prefix, np.int64).tobytes(), "cells": jaccard.cell_counts(tokens).tobytes(), "pivots": sorted({g, *(r.randrange(200) for _ in range(r.choice([0, 0, 1])))}), "tokens": tokens.tobytes()})
    rows.sort(key=lambda x: (x["pivot"], x["i"], x["j"], x["own"], x["k"]))
    rows += rows[-1:]  # a repeated one counts once
    batches = [pa.RecordBatch.from_pylist(rows[i : i + 70]) for i in range(0, len(rows), 70)]
    monkeypatch.setattr(jaccard, "_ROWS", 50)

    def pairs():
        out, tables = set(), list(jaccard.whole(iter(batches)))
        assert sum(t.num_rows for t in tables) == len(rows) and len(tables) > 5
        for t in tables:
            x = jaccard.Bundled(t, sets)
            label = jaccard.labels_of(len(x.k), *x.small(80))
            for at, split in x:
                maybe = x.likely(at, split, 80)
                if sets:
                    label[at] = np.minimum(label[at], at[jaccard.linked(x.sizes[at], [x.sets[y] for y in at], maybe, 80)])
                else:
                    label[at] = at[jaccard.labels_of(len(at), *np.nonzero(maybe))]
            out |= {(int(p), int(a), int(b)) for p, a, b in zip(x.pivot, x.k, x.k[label], strict=True)}
        return out

    many = pairs()
    monkeypatch.setattr(jaccard, "SMALL", 0)
    assert many == pairs() and 100 < sum(a != b for _, a, b in many) < len(rows) - 100


def shuffled(spark):
    """Records and bytes that each stage has shuffled so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return {x.stageId(): (x.shuffleWriteRecords(), x.shuffleWriteBytes()) for x in sc._jvm.scala.jdk.javaapi.CollectionConverters.asJava(found)}


def test_jaccard_shuffles_no_row_for_each_word_or_n_gram(spark):
    from emberlens.llm.jaccard import jaccard_components

    texts = [[f"w{i}x{k}" for k in range(400)] for i in range(60)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(100 + i, " ".join(t[:395])) for i, t in enumerate(texts)]
    before = max(shuffled(spark), default=-1)
    out = {r.doc_id: r.component_id for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()}
    assert out == {i: i % 100 for i, _ in rows}
    assert 0 < sum(n for s, (n, _) in shuffled(spark).items() if s > before) < len(rows) * 80  # a prefix has 80 n-grams and more


def test_texts_that_nobody_wants_are_not_shuffled(spark):
    from emberlens.llm.jaccard import jaccard_components

    r = random.Random(6)
    word = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=500))
    texts = [[word() for _ in range(80)] for _ in range(100)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(200 + i, " ".join(t[:79])) for i, t in enumerate(texts[:5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).persist()
    assert docs.count() == 105
    before, most = max(shuffled(spark), default=-1), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if all tables were large
    try:
        out = {r.doc_id: r.component_id for r in jaccard_components(docs).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    docs.unpersist()
    assert out == {i: i % 200 for i, _ in rows}
    assert 0 < sum(n for s, (_, n) in shuffled(spark).items() if s > before) < sum(len(t) for _, t in rows) / 2
