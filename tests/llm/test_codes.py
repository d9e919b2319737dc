"""Vector codes against brute force in Python's integers."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from emberlens.llm import codes as vc


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [(i, label, [math.floor(scale * x) if abs(x) < 2**53 else int(x) * scale for x in v]) for i, label, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dim = -(-max(1, max((len(v) for *_, v in kept), default=0)) // parts) * parts
    kept = [(i, label, v + [0] * (dim - len(v))) for i, label, v in kept]
    w = dim // parts
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[v[p * w : p * w + w] for *_, v in first] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for r in range(rounds + 1):
        codes = [[min(range(len(b)), key=lambda e: (dist(v[p * w : p * w + w], b[e]), e)) for p, b in enumerate(books)] for *_, v in kept]
        if r == rounds:
            break
        for p, b in enumerate(books):
            by = defaultdict(list)
            for c, (*_, v) in zip(codes, kept):
                by[c[p]].append(v[p * w : p * w + w])
            books[p] = [[sum(x) // len(x) for x in zip(*by[e])] if e in by else b[e] for e in range(len(b))]
    errors = [sum(dist(v[p * w : p * w + w], books[p][c[p]]) for p in range(parts)) for c, (*_, v) in zip(codes, kept)]
    labels = defaultdict(int)
    for e, (_, label, _) in zip(errors, kept):
        labels[label] += e
    fits = lambda x: x if x < 2**63 else None
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{x:02x}" for x in c), fits(e), fits(labels[label]), digest) for (i, label, _), c, e in zip(kept, codes, errors)), key=str)


SCHEMA = "vec_id long, embedding array<double>, label int, code string, block int"


def check(spark, rows, **args):
    df = spark.createDataFrame([(i, v, label, "x", 1) for i, label, v in rows], SCHEMA).repartition(3)
    out = vc.compress(df, tasks=4, **args).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted((tuple(x) for x in out), key=str) == brute(rows, **{k: v for k, v in args.items() if k != "tasks"})


def clustered(r, n, dim, spread=0.05):
    centres = [[r.gauss(0, 0.3) for _ in range(dim)] for _ in range(9)]
    return [(i, r.choice([1, 2, 3, None]), [x + r.gauss(0, spread) for x in r.choice(centres)]) for i in range(n)]


def test_codes_are_those_of_brute_force(spark, monkeypatch):
    r = random.Random(8)
    rows = clustered(r, 300, 16)
    rows += [rows[5]] * 3 + [(7, 2, [0.0] * 16), (None, None, rows[9][2]), (900, 1, None), (901, 1, [0.1] * 15 + [None]), (902, 1, [math.inf] + [0.0] * 15), (903, 2, [math.nan] * 16)]
    rows += [(904, 1, []), (905, 3, [0.5] * 7), (906, None, rows[0][2])] + [(1000 + i, 4, [0.25] * 16) for i in range(80)]
    check(spark, rows)
    check(spark, rows, parts=4, entries=5, rounds=3)


def test_ties_few_rows_and_large_values(spark):
    grid = [(i, 0, [float(x) / 4096 for x in (i % 5, i // 5 % 5, i % 3, 0)]) for i in range(100)]
    check(spark, grid, parts=2, entries=7)
    check(spark, grid[:3], parts=2)
    big = [(i, i % 2, [1e6 * (i % 7), -3.0e7 + i, 2.0**70 if i % 3 else 1e300, -1.5]) for i in range(40)]
    check(spark, big, parts=2, entries=4)
    check(spark, [(1, None, []), (2, 1, [])])
    assert vc.compress(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        vc.compress(spark.createDataFrame([], SCHEMA), entries=257)


def test_balls_give_the_nearest_entries_and_skip_work():
    r = np.random.default_rng(3)
    centres = r.normal(size=(16, 6)) * 3000
    x = np.floor(centres[r.integers(0, 16, 2000)] + r.normal(size=(2000, 6)) * 300)
    old, codes, radii = x[:16], np.zeros(2000, np.int64), np.full(16, -1.0)
    new, skipped = old, 0
    for _ in range(40):
        codes, least, radii = vc.assign(x, codes, radii, old, new)
        d = ((x[:, None] - new[None]) ** 2).sum(axis=2)
        assert (codes == d.argmin(axis=1)).all() and ((least == d.min(axis=1)) | (least == -1)).all()
        assert all(radii[i] >= d[codes == i, i].max(initial=-1) for i in range(16))
        skipped += int((least == -1).sum())
        old, new = new, np.array([np.floor(x[codes == i].mean(axis=0)) if (codes == i).any() else new[i] for i in range(16)])
    assert skipped > 0


def test_limbs():
    for v in (0, 1, -1, 2**40, -(2**40), 2**200 - 7, -(2**77) + 3):
        assert sum(x << (vc.LIMB * k) for k, x in enumerate(vc.limbs(v))) == v


def test_rounds_read_vectors_without_a_shuffle(spark):
    r = random.Random(1)
    df = spark.createDataFrame([(i, v, label, "x", 1) for i, label, v in clustered(r, 50, 8)], SCHEMA)
    seen = []
    state = vc.round_of

    def spy(frame, *args):
        seen.append(frame._jdf.queryExecution().executedPlan().toString())
        return state(frame, *args)

    vc.round_of, kept = spy, vc.round_of
    try:
        vc.compress(df, tasks=4).count()
    finally:
        vc.round_of = kept
    assert len(seen) == 7 and all("Exchange" not in p for p in seen)


def test_query_equals_its_sql(spark):
    import duckdb

    from emberlens.llm.queries import oracle_sql, queries

    base = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{base}/embeddings.parquet'")
    out = queries()["op12_vector_codes"](spark, base)
    want = con.sql(oracle_sql()["op12_vector_codes"])
    rows = [tuple(x) for x in out.select(*sorted(out.columns)).collect()]
    assert sorted(rows, key=str) == sorted(want.project(",".join(sorted(out.columns))).fetchall(), key=str) and len(rows) == 500
