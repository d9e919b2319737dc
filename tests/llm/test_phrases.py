"""Phrases against brute force."""

import random
import re
from collections import Counter

from emberlens.llm import phrases as ph


def brute(rows, least, top, scale=2_000_000):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    found = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in found.items():
        longer = [b for (m, q), b in found.items() if m == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= 80 * a for b in longer):
            continue
        score, k = min((scale * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    rank, rows = Counter(), set()
    for lang, s, a, p, l, r in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            rows.add((lang, rank[lang], p.decode(), -a, l, r, total[lang], -s))
    return rows


def corpus():
    r = random.Random(4)
    vocabulary = ["a", "b", "Of", "the", "é", "日本", "x-y", "ß", "\x00", "q" * 40]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60))) for _ in range(120)]
    texts = [re.sub(" ", lambda m: r.choice([" ", " ", " ", "\t ", ". ", "\n", "!", "\x0b", ";,"]), t) for t in texts]
    rows = [(r.choice(["en", "de", None, "und"]), t) for t in texts]
    rows += [("en", None), (None, ""), ("fr", " . "), ("es", "one two")] + [("en", "the hot pair " * 200)] + [("de", "New York City hall. " * 9)] * 5 + [("fr", "red green blue. " * 9)]
    return rows


def test_phrases_are_those_of_brute_force(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame([(*x, 1, "p") for x in rows], "lang string, text string, n int, phrase string").repartition(5)
    want = brute(rows, 6, 1000)
    assert len(want) > 100 and {len(x[2].split(" ")) for x in want} == {2, 3, 4}
    assert {tuple(x) for x in ph.mine_phrases(docs, min_count=6, top=1000).collect()} == want
    assert {tuple(x) for x in ph.mine_phrases(docs, min_count=6, top=7).collect()} == brute(rows, 6, 7)
    monkeypatch.setattr(ph, "SLICE", 5)
    # Bitmaps that are full drop nothing and add nothing.
    assert {tuple(x) for x in ph.mine_phrases(docs, min_count=6, top=1000, filter_bits=6).collect()} == want
    assert ph.mine_phrases(docs.limit(0)).count() == 0


def test_slices_and_restarts(monkeypatch):
    text = "ab Cd.ef  gh\tij!\n" * 50
    whole = [w for part in ph.tokens(text.encode()) for w in part]
    monkeypatch.setattr(ph, "SLICE", 3)
    assert [w for part in ph.tokens(text.encode()) for w in part] == whole and whole[:7] == [b"ab", b"cd", b"\xff", b"ef", b"gh", b"ij", b"\xff"]


def test_hashes_of_slices_are_those_of_words(monkeypatch):
    import numpy as np

    text = "ab cd.ef  gh\tij! \x00 ab é,\n x" * 7 + "."
    words = [w for part in ph.tokens(text.encode()) for w in part]
    want = ph.hash_words([w for w in words if w != b"\xff"], ["en"] * len([w for w in words if w != b"\xff"]))
    for size in (1 << 20, 1, 3, 10):
        monkeypatch.setattr(ph, "SLICE", size)
        keys, broken = [], []
        for part in ph.slices(text.encode()):
            k, b, before = ph.hashed(part, "en")
            if broken and before:
                broken[-1][-1:] = True
            if len(k):
                keys.append(k)
                broken.append(b)
        assert (np.concatenate(keys) == want).all()
        follows = [words[i + 1] == b"\xff" for i, w in enumerate(words[:-1]) if w != b"\xff"]
        assert np.concatenate(broken).tolist() == follows
    assert ph.hash_words([b"a", b"a", b"\x00", b"\x00\x00"], ["en", "de", "en", "en"]).tolist() != ph.hash_words([b"a"] * 4, ["en"] * 4).tolist()


def test_long_and_short_texts_are_hashed_alike(monkeypatch):
    """Slices of every size give the same pairs of neighbours."""
    import numpy as np
    import pyarrow as pa

    rows = [(lang or "und", text or "") for lang, text in corpus()]
    seen = []

    class Rows:
        def mapInArrow(self, run, _):
            batch = pa.RecordBatch.from_pylist([{"lang": a, "text": b} for a, b in rows])
            return list(run(iter([batch.slice(0, 50), batch.slice(50)])))

    def pairs(keys, joined):
        seen.extend(zip(keys[:-1][joined[:-1]].tolist(), keys[1:][joined[:-1]].tolist()))
        assert not joined[-1]
        return len(keys)

    found = []
    for size, words in ((1 << 20, 1 << 21), (40, 100), (1, 1)):
        monkeypatch.setattr(ph, "SLICE", size)
        monkeypatch.setattr(ph, "WORDS", words)
        seen.clear()
        n = sum(ph.counted_hashes(Rows(), pairs, ""))
        found.append((n, sorted(seen)))
    assert found[0] == found[1] == found[2] and len(found[0][1]) > 100 and np.uint64


def test_query_equals_its_sql(spark):
    import duckdb

    from emberlens.llm.queries import oracle_sql, queries

    base = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{base}/documents.parquet'")
    out = queries()["op13_phrases"](spark, base)
    want = con.sql(oracle_sql()["op13_phrases"])
    rows = {tuple(x) for x in out.select(*sorted(out.columns)).collect()}
    assert rows == set(want.project(",".join(sorted(out.columns))).fetchall()) and len(rows) > 100
