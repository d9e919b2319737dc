"""SQL that gives the rows of the queries that SQL can express."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

OP2 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM documents),
w AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM w) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY 1),
b AS (SELECT doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    coalesce(c.n, 0) AS n_repeat_words, len(ls) AS n_lines FROM d LEFT JOIN c USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
a AS (SELECT *, base_failed OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 30 * n_lines AS any_failed FROM f),
h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (any_failed) AS DOUBLE) AS x FROM a GROUP BY 1),
p AS (SELECT sum(x) / sum(n) AS m, sum(x * x / n) / sum(n) - (sum(x) / sum(n)) * (sum(x) / sum(n)) - (sum(x) / sum(n)) * (1 - sum(x) / sum(n)) * count(*) / sum(n) AS v FROM h),
s AS (SELECT m, CASE WHEN v > 0 THEN least(1000, greatest(1, m * (1 - m) / v - 1)) ELSE 1000 END AS k FROM p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (h.x + m * k) / (h.n + k) > 0.5 AS kept
FROM a JOIN h ON a.source IS NOT DISTINCT FROM h.source, s
"""

OP5 = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size, md5('mix:' || doc_id || ':' || md5(coalesce(text, ''))) AS o FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss FROM d GROUP BY 1),
w AS (SELECT source, ss, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, ss * 2::DOUBLE AS cap FROM s),
p AS (SELECT *, row_number() OVER o AS k, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c0,
    coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w0 FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
l AS (SELECT *, (((SELECT sum(ss) FROM w) * 1.5::DOUBLE) - c0) / ((SELECT sum(w) FROM w) - w0) AS level FROM p),
e AS (SELECT min(k) AS k0, arg_min(level, k) AS level0 FROM l WHERE w * level <= cap),
t AS (SELECT source, ss, CASE WHEN k < k0 THEN cap ELSE w * level0 END AS target FROM l, e),
r AS (SELECT *, CASE WHEN ss > 0 THEN CAST(floor(target / ss) AS BIGINT) ELSE 0 END AS whole FROM t),
n AS (SELECT d.*, ss, target, whole, sum(size) OVER (PARTITION BY d.source ORDER BY o, size ROWS UNBOUNDED PRECEDING) - size / 2 < target - whole * ss AS more
    FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
c AS (SELECT source, coalesce(max(o) FILTER (more AND size > 0), '') AS cut FROM n GROUP BY 1)
SELECT doc_id, size, ss AS source_size, target, size * (whole + CASE WHEN o <= cut THEN 1 ELSE 0 END) AS taken FROM n JOIN c ON n.source IS NOT DISTINCT FROM c.source
"""

OP6 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i : least(i + 4, len(w))], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, CASE WHEN len(w) = 0 THEN 1 ELSE greatest(2, len(w) - 3) END)) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(b) FROM r WHERE a = d.doc_id) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
"""

OP7 = """
WITH v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, q.row, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.row <> q.row)
SELECT query_id, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p QUALIFY rank <= 5
"""

OP10 = """
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t),
d AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, strlen(text) + 1 AS size, xor(4294967295, list_reduce(list_transform(range(0, strlen(text)), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)),
    lambda a, b: xor(t.t[(xor(a, b) & 255) + 1], a >> 8), CAST(4294967295 AS BIGINT))) AS crc FROM d, t),
j AS (SELECT doc_id, n, (CAST(doc_id AS HUGEINT) + 18446744073709551616) % 18446744073709551616 AS k, CAST(-1 AS BIGINT) AS b, CAST(0 AS BIGINT) AS j FROM documents, (VALUES (16), (17)) x(n)
    UNION ALL SELECT doc_id, n, z AS k, j AS b, CAST(floor((j + 1) * (2147483648::DOUBLE / CAST(z // 8589934592 + 1 AS DOUBLE))) AS BIGINT) AS j
    FROM (SELECT *, (k * 2862933555777941757 + 1) % 18446744073709551616 AS z FROM j WHERE j < n)),
s AS (SELECT doc_id, CAST(max(b) FILTER (n = 16) AS INTEGER) AS shard, CAST(max(b) FILTER (n = 17) AS INTEGER) AS grown_shard FROM j WHERE j >= n GROUP BY 1),
g AS (SELECT greatest(1, (count(*) + 79999) // 80000) AS g FROM documents),
a AS (SELECT c.doc_id, size, crc, shard, grown_shard, ((((CAST(c.doc_id AS HUGEINT) + 18446744073709551616) % 18446744073709551616) * 2862933555777941757 + 1) % 18446744073709551616) // 8589934592 % g AS part
    FROM c JOIN s ON c.doc_id = s.doc_id, g)
SELECT doc_id, CAST(size AS BIGINT) AS size, crc AS text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY part, doc_id, crc, size) - 1 AS slot, grown_shard FROM a
"""



def _op12(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Codebooks and assignments, round by round."""
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"x AS MATERIALIZED (SELECT row, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS x FROM v, range({parts}) r(p))",
        f"c0 AS MATERIALIZED (SELECT p, e, x AS c FROM x JOIN (SELECT row, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM v QUALIFY e < {entries}) USING (row))",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"a{r} AS MATERIALIZED (SELECT row, p, x, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT row, x.p, x, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM x JOIN c{r} c ON c.p = x.p) GROUP BY ALL)"
        )
        if r < rounds:
            steps.append(
                f"m{r} AS (SELECT p, e, list(m ORDER BY i) AS c FROM (SELECT p, e, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS m FROM (SELECT p, e, x, unnest(range(1, len(x) + 1)) AS i FROM a{r}) GROUP BY p, e, i) GROUP BY p, e)"
            )
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.c, c.c) AS c FROM c{r} c LEFT JOIN m{r} m ON m.p = c.p AND m.e = c.e)")
    return (
        "WITH "
        + ",\n".join(steps)
        + f""",
k AS (SELECT row, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY row),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS s FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256 FROM v JOIN k USING (row), h
"""
    )


OP12 = _op12()

OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d)),
g AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS p FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 5) x(k))),
f AS MATERIALIZED (SELECT lang, k, p, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY 1),
c AS MATERIALIZED (SELECT lang, k AS m, p, f AS a, string_split(p, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
u AS MATERIALIZED (SELECT lang, m, p, a, j, array_to_string(w[1 : j], ' ') AS lp, array_to_string(w[j + 1 :], ' ') AS rp FROM (SELECT *, unnest(range(1, m)) AS j FROM c)),
x AS (SELECT u.lang, m, u.p, a, j, l.f AS l, r.f AS r, CAST(2000000::HUGEINT * a // (l.f + r.f) AS BIGINT) AS score FROM u JOIN f l ON l.lang = u.lang AND l.p = lp JOIN f r ON r.lang = u.lang AND r.p = rp),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1),
o AS (SELECT b.lang, b.p, b.a, b.l, b.r, b.score FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.m > b.m AND 100 * c.a >= 80 * b.a AND contains(' ' || c.p || ' ', ' ' || b.p || ' ')))
SELECT o.lang, row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, encode(p)) AS rank, p AS phrase, a, l, r, n, score FROM o JOIN n ON n.lang = o.lang QUALIFY rank <= 2000
"""

SQL = {"op2_quality_rules": OP2, "op5_mixing": OP5, "op6_ngram_jaccard_join": OP6, "op7_exact_topk": OP7, "op10_sharding": OP10, "op12_vector_codes": OP12, "op13_phrases": OP13}
