"""Queries that run the operators on whole tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cluster as C
from ..operators import distributions as D
from ..operators import intervals as I
from ..operators import timesplit as S
from ..sources import eventlog as E

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its name, with its SQL if there is one."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(c: str) -> F.Column:
    return F.unix_seconds(F.col(c).cast("timestamp"))


def user_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as intervals of six hours per user, in seconds."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", seconds("ts").alias("a"), (seconds("ts") + 21600).alias("b"))


_EV = "SELECT event_id, user_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS a, CAST(floor(epoch(ts)) AS BIGINT) + 21600 AS b FROM events"


@query(
    """SELECT l_suppkey, count(*) AS n, CAST(sum(q) AS BIGINT) AS total, min(q) AS lo, max(q) AS hi, quantile_disc(q, 0.25) AS p25,
    quantile_disc(q, 0.5) AS p50, quantile_disc(q, 0.95) AS p95
    FROM (SELECT l_suppkey, greatest(CAST(floor(l_extendedprice) AS BIGINT), 0) AS q FROM lineitem) GROUP BY l_suppkey"""
)
def task_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", F.floor("l_extendedprice").alias("q"))
    return D.dist_summary(items, ["l_suppkey"], "q", (0.25, 0.5, 0.95))


@query(
    """WITH b AS (SELECT o_orderpriority AS k, CAST(floor(o_totalprice) AS BIGINT) AS v FROM orders),
    e AS (SELECT k, v, CASE WHEN v < 16 THEN 0 ELSE length(ltrim(CAST(v AS BIT)::VARCHAR, '0')) - 1 END AS e FROM b),
    f AS (SELECT k, v, CASE WHEN v < 16 THEN v ELSE 16 + (e - 4) * 16 + ((v >> CAST(e - 4 AS BIGINT)) & 15) END AS bucket FROM e),
    c AS (SELECT k, bucket, count(*) AS n, min(v) AS lo, max(v) AS hi FROM f GROUP BY ALL),
    w AS (SELECT *, min(bucket) OVER (PARTITION BY k) AS low, max(bucket) OVER (PARTITION BY k) AS high FROM c)
    SELECT k AS o_orderpriority, CAST((bucket - low) // greatest(1, (high - low + 40) // 40) AS BIGINT) AS bar, min(lo) AS lo, max(hi) AS hi, CAST(sum(n) AS BIGINT) AS n
    FROM w GROUP BY 1, 2"""
)
def price_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", F.floor("o_totalprice").alias("v"))
    return D.log_hist(orders, ["o_orderpriority"], "v")


@query("SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 3")
def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return D.top_k(orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY md5('0:' || o_orderkey), o_orderkey) AS r FROM orders) WHERE r <= 2")
def sampled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.sample_per_key(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", 2)


@query(
    """WITH m AS (SELECT l_partkey, quantile_cont(l_quantity, 0.5) AS median FROM lineitem GROUP BY 1)
    SELECT l_partkey, l_orderkey, l_linenumber, l_quantity, median FROM lineitem JOIN m USING (l_partkey) WHERE l_quantity >= 1.5 * median AND l_quantity - median >= 10"""
)
def stragglers(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity")
    return D.slow_rows(items, ["l_partkey"], "l_quantity", 1.5, 10)


@query(
    """WITH q AS (SELECT l_suppkey, CAST(floor(l_extendedprice) AS BIGINT) AS q FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY q) - 1 AS place, count(*) OVER (PARTITION BY l_suppkey) AS n FROM q),
    u AS (SELECT l_suppkey, q AS upper_mid FROM r WHERE place = n // 2)
    SELECT l_suppkey, CAST(trunc(quantile_cont(q, 0.5)) AS BIGINT) AS mean_mid, quantile_disc(q, 0.5) AS nearest, any_value(upper_mid) AS upper_mid FROM q JOIN u USING (l_suppkey) GROUP BY 1"""
)
def three_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "lineitem").select("l_suppkey", F.floor("l_extendedprice").alias("q"))
    two = q.groupBy("l_suppkey").agg(D.median_mid("q").alias("mean_mid"), D.median_low("q").alias("nearest"))
    return two.join(D.median_high(q, ["l_suppkey"], "q").withColumnRenamed("median", "upper_mid"), "l_suppkey")


@query(
    """SELECT l_suppkey, q AS l_quantity, n FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, q DESC) AS r FROM
    (SELECT l_suppkey, l_quantity AS q, count(*) AS n FROM lineitem GROUP BY ALL)) WHERE r = 1"""
)
def modal_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.mode_of(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity")


@query(
    f"""WITH e AS ({_EV}), s AS (SELECT user_id, a AS t, 1 AS d FROM e UNION ALL SELECT user_id, b, -1 FROM e), c AS (SELECT user_id, t, sum(d) AS d FROM s GROUP BY ALL)
    SELECT user_id, t, CAST(sum(d) OVER (PARTITION BY user_id ORDER BY t) AS BIGINT) AS running FROM c"""
)
def open_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.step_series(user_intervals(spark, sf_dir), ["user_id"], "a", "b")


@query(
    f"""WITH e AS ({_EV}), s AS (SELECT user_id, a AS t, 1 AS d FROM e UNION ALL SELECT user_id, b, -1 FROM e), c AS (SELECT user_id, t, d, sum(d) AS x FROM s GROUP BY ALL),
    r AS (SELECT user_id, t, CAST(sum(x) OVER (PARTITION BY user_id ORDER BY t, d) AS BIGINT) AS n FROM c)
    SELECT user_id, n AS peak, t AS at FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, t) = 1"""
)
def open_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.peak_concurrency(user_intervals(spark, sf_dir), ["user_id"], "a", "b")


@query(
    f"""WITH e AS ({_EV}), o AS (SELECT min(a) AS o FROM e), s AS (SELECT event_type, a - o AS x, b - o AS y FROM e, o),
    k AS (SELECT event_type, x // 7200 AS bucket FROM s UNION SELECT event_type, y // 7200 FROM s)
    SELECT event_type, bucket, CAST(sum(greatest(0, least(y, 7200 * (bucket + 1)) - greatest(x, 7200 * bucket))) AS BIGINT) AS busy,
    count(*) FILTER (x < 7200 * (bucket + 1) AND y >= 7200 * (bucket + 1)) AS running
    FROM k JOIN s USING (event_type) GROUP BY ALL"""
)
def busy_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = user_intervals(spark, sf_dir)
    first = e.agg(F.min("a").alias("o"))
    return I.busy_buckets(e.crossJoin(F.broadcast(first)), ["event_type"], "a", "b", 7200, "o")  # one row


_SPAN = f"WITH e AS ({_EV}), s AS (SELECT min(a) AS lo, max(b) + 3600 AS hi FROM e), x AS (SELECT e.*, lo, hi FROM e, s)"


@query(
    _SPAN
    + """, r AS (SELECT user_id, a, b, lo, hi, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x)
    SELECT user_id, coalesce(reach, lo) AS gap_start, a AS gap_end FROM r WHERE a - coalesce(reach, lo) >= 1
    UNION ALL SELECT user_id, max(b), max(hi) FROM x GROUP BY 1 HAVING max(hi) - max(b) >= 1"""
)
def idle_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = user_intervals(spark, sf_dir)
    span = e.agg(F.min("a").alias("lo"), (F.max("b") + 3600).alias("hi"))
    return I.gaps(e.crossJoin(F.broadcast(span)), ["user_id"], "lo", "hi", "a", "b")  # one row


@query(
    f"""WITH e AS ({_EV}), r AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e)
    SELECT user_id, CAST(sum(greatest(0, b - greatest(a, coalesce(reach, a)))) AS BIGINT) AS covered FROM r GROUP BY 1"""
)
def union_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.union_length(user_intervals(spark, sf_dir), ["user_id"], "a", "b")


@query(
    f"""WITH e AS ({_EV}), p AS (SELECT event_id, user_id, a AS t FROM e WHERE event_type = 'purchase'), i AS (SELECT user_id, event_id AS of, a, b FROM e WHERE event_type <> 'purchase'),
    j AS (SELECT p.event_id, i.of, row_number() OVER (PARTITION BY p.event_id ORDER BY i.a DESC, i.of) AS r FROM p JOIN i ON p.user_id = i.user_id AND i.a <= t AND t <= i.b)
    SELECT p.event_id, p.user_id, p.t, coalesce(j.of, -1) AS of FROM p LEFT JOIN j ON p.event_id = j.event_id AND r = 1"""
)
def stage_of_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = user_intervals(spark, sf_dir)
    points = e.filter("event_type = 'purchase'").select("event_id", "user_id", F.col("a").alias("t"))
    intervals = e.filter("event_type <> 'purchase'").select("user_id", F.col("event_id").alias("of"), "a", "b")
    return I.latest_containing(points, intervals, ["user_id"], "t", "a", "b", ["of"]).fillna(-1, ["of"])


@query(
    f"""WITH e AS ({_EV}), p AS (SELECT event_id, user_id, a AS t FROM e WHERE event_type = 'purchase'), f AS (SELECT user_id, a AS ft, event_id AS fact FROM e WHERE event_type = 'click')
    SELECT p.event_id, p.user_id, p.t, coalesce((SELECT max_by(fact, (ft, fact)) FROM f WHERE f.user_id = p.user_id AND ft <= p.t), -1) AS fact FROM p"""
)
def last_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = user_intervals(spark, sf_dir)
    points = e.filter("event_type = 'purchase'").select("event_id", "user_id", F.col("a").alias("t"))
    facts = e.filter("event_type = 'click'").select("user_id", F.col("a").alias("ft"), F.col("event_id").alias("fact"))
    return I.latest_before(points, facts, ["user_id"], "t", "ft", ["fact"]).fillna(-1, ["fact"])


@query(
    """WITH d AS (SELECT o_orderpriority AS k, CAST(floor(epoch(o_orderdate)) AS BIGINT) // 86400 AS day, count(*) AS n FROM orders GROUP BY ALL),
    m AS (SELECT *, sign(n - lag(n) OVER (PARTITION BY k ORDER BY day)) AS way FROM d), c AS (SELECT * FROM m WHERE way <> 0),
    f AS (SELECT *, lag(way) OVER w IS NULL OR lag(way) OVER w <> way OR day - lag(day) OVER w > 3 AS new FROM c WINDOW w AS (PARTITION BY k ORDER BY day))
    SELECT k AS o_orderpriority, count(*) FILTER (new AND way = 1) AS ups, count(*) FILTER (new AND way = -1) AS downs FROM f GROUP BY 1"""
)
def direction_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").groupBy("o_orderpriority", F.expr("unix_seconds(cast(o_orderdate as timestamp)) div 86400").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return I.runs(days, ["o_orderpriority"], "day", "n", 3)


@query(
    f"""WITH e AS ({_EV}), m AS (SELECT *, CASE WHEN a - lag(a) OVER w <= 21600 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY a)),
    i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY a RANGE UNBOUNDED PRECEDING) AS island FROM m)
    SELECT user_id, count(*) AS n, min(a) AS first, max(a) AS last FROM i GROUP BY user_id, island"""
)
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.fold_within(user_intervals(spark, sf_dir), ["user_id"], "a", 21600)


@query(
    f"""WITH RECURSIVE e AS ({_EV}), t AS (SELECT user_id, a AS t, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY a) AS r FROM e GROUP BY user_id, a),
    w AS (SELECT user_id, t, n, r, t AS first FROM t WHERE r = 1
    UNION ALL SELECT t.user_id, t.t, t.n, t.r, CASE WHEN t.t - w.first > 86400 THEN t.t ELSE w.first END FROM w JOIN t ON t.user_id = w.user_id AND t.r = w.r + 1)
    SELECT user_id, CAST(sum(n) AS BIGINT) AS n, first, max(t) AS last FROM w GROUP BY user_id, first"""
)
def start_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.anchored_batches(user_intervals(spark, sf_dir), ["user_id"], "a", 86400)


@query(
    f"""WITH e AS ({_EV}), s AS (SELECT user_id, a AS t, CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN -1 END AS d FROM e WHERE event_type IN ('signup', 'purchase')),
    b AS (SELECT *, sum(d) OVER (PARTITION BY user_id ORDER BY t, d DESC ROWS UNBOUNDED PRECEDING) AS balance FROM s),
    l AS (SELECT *, least(0, coalesce(min(balance) OVER (PARTITION BY user_id ORDER BY t, d DESC, balance DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low FROM b),
    u AS (SELECT *, d = -1 AND balance < low AS alone FROM l), k AS (SELECT *, row_number() OVER (PARTITION BY user_id, d, alone ORDER BY t) AS k FROM u)
    SELECT o.user_id, o.t AS open_t, coalesce(c.t, -1) AS close_t FROM (SELECT * FROM k WHERE d = 1) o LEFT JOIN (SELECT * FROM k WHERE d = -1 AND NOT alone) c ON o.user_id = c.user_id AND o.k = c.k
    UNION ALL SELECT user_id, -1, t FROM k WHERE alone"""
)
def paired_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.pair_next(user_intervals(spark, sf_dir), ["user_id"], "a", "event_type", "signup", "purchase").fillna(-1)


@query(
    f"""WITH RECURSIVE e AS ({_EV}), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY a, event_id) AS r FROM e), w AS (SELECT user_id, event_id, r, [b] AS ends, CAST(0 AS BIGINT) AS slot FROM o WHERE r = 1
    UNION ALL SELECT user_id, event_id, r, list_concat(ends[1 : k - 1], [b], ends[k + 1 :]), CAST(k - 1 AS BIGINT) FROM (SELECT o.*, w.ends, coalesce(list_position(list_transform(w.ends, lambda x: x <= o.a), true), len(w.ends) + 1) AS k
    FROM w JOIN o ON o.user_id = w.user_id AND o.r = w.r + 1)) SELECT user_id, event_id, slot FROM w"""
)
def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.slot_pack(user_intervals(spark, sf_dir), ["user_id"], "event_id", "a", "b")


@query(
    """WITH o AS (SELECT o_custkey, o_orderkey, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS a FROM orders),
    l AS (SELECT o_custkey, l_orderkey, l_linenumber, CAST(floor(epoch(l_shipdate)) AS BIGINT) AS a FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT o.o_custkey, o.o_orderkey, l.l_orderkey, l.l_linenumber FROM o JOIN l ON o.o_custkey = l.o_custkey AND o.a <= l.a + 172800 + 3600 AND o.a + 86400 >= l.a - 3600"""
)
def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", seconds("o_orderdate").alias("a"))
    lines = table(spark, sf_dir, "lineitem").join(orders.select("o_custkey", F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    lines = lines.select("o_custkey", "l_orderkey", "l_linenumber", seconds("l_shipdate").alias("a")).withColumn("b", F.col("a") + 172800)
    pairs = I.overlap_join(orders.withColumn("b", F.col("a") + 86400), lines, ["o_custkey"], "a", "b", 3600)
    return pairs.select("o_custkey", "a.o_orderkey", "b.l_orderkey", "b.l_linenumber")


@query("SELECT event_id, user_id, p FROM (SELECT event_id, user_id, floor(value) AS p FROM events WHERE event_type = 'signup') e WHERE NOT EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id AND floor(p.value) = e.p)")
def never_ended(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.floor("value").cast("double").alias("p"))
    return I.open_at_end(e.filter("event_type = 'signup'").drop("event_type"), e.filter("event_type = 'purchase'").select("user_id", "p"), ["user_id", "p"])


@query(
    """SELECT role, regexp_replace(text, '[0-9]+', '#', 'g') AS template, count(*) AS n, min(conv_id * 1000 + turn) AS first_line, max(conv_id * 1000 + turn) AS last_line,
    arg_min(text, conv_id * 1000 + turn) AS example FROM conversations WHERE text IS NOT NULL GROUP BY 1, 2"""
)
def folded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "conversations").select("role", "text", (F.col("conv_id") * 1000 + F.col("turn")).alias("line"))
    return T.fold_templates(lines, ["role"], "text", "line")


LINE_RULES = (
    T.Pattern("email", "@", r"([A-Za-z0-9._]+)@([A-Za-z0-9.]+)", ("name", "host")),
    T.Pattern("url", "://", r"(https?)://([^/ ]+)", ("scheme", "host")),
    T.Pattern("number", "", r"([0-9]{4,})", ("n",)),
    T.Pattern("shout", "!", r"(!!+)", ("marks",)),
)


@query(
    r"""SELECT doc_id, CASE WHEN contains(text, '@') AND regexp_matches(text, '([A-Za-z0-9._]+)@([A-Za-z0-9.]+)') THEN 'email' WHEN contains(text, '://') AND regexp_matches(text, '(https?)://([^/ ]+)') THEN 'url'
    WHEN regexp_matches(text, '([0-9]{4,})') THEN 'number' WHEN contains(text, '!') AND regexp_matches(text, '(!!+)') THEN 'shout' END AS rule FROM documents"""
)
def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.first_match(F.col("text"), LINE_RULES).alias("rule"))


_SECRET = "|".join(n.replace(".", "[._-]?") for n in T.SENSITIVE)


@query(
    rf"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(?i)([A-Za-z0-9_.\-]*(?:{_SECRET})[A-Za-z0-9_.\-]*[ \t]*[=:][ \t]*)("[^"]*"|''[^'']*''|[^\s,;&)\]}}\[][^\s,;&)\]}}]*)', '\1[redacted]', 'g'),
    '([A-Za-z][A-Za-z0-9+.\-]*://[^\s/:@]+:)([^\s/@]+)(@)', '\1[redacted]\3', 'g'), '\b(?:AKIA|ASIA)[A-Z0-9]{{16}}\b', '[redacted]', 'g') AS text FROM documents"""
)
def masked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.redact_text(F.col("text")).alias("text"))


@query(r"SELECT doc_id, regexp_replace(text, '([A-Za-z0-9._]+)@([A-Za-z0-9.]+)', '#', 'g') AS text FROM documents")
def masked_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", LINE_RULES[0].regex, "#").alias("text"))


@query(
    """WITH d AS (SELECT DISTINCT s_nationkey AS g, l_suppkey AS s, l_partkey AS p FROM lineitem JOIN supplier ON l_suppkey = s_suppkey), n AS (SELECT g, s, count(*) AS n FROM d GROUP BY ALL),
    f AS (SELECT g, min(s) AS first FROM d GROUP BY 1), j AS (SELECT d.g, f.first, d.s AS other, count(*) AS common FROM d JOIN f ON d.g = f.g AND d.s <> f.first JOIN d e ON e.g = d.g AND e.s = f.first AND e.p = d.p GROUP BY ALL)
    SELECT j.g AS "group", first, other, common FROM j JOIN n x ON x.g = j.g AND x.s = first JOIN n y ON y.g = j.g AND y.s = other WHERE 100 * common >= 25 * least(x.n, y.n)"""
)
def shared_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("g"))
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_partkey").alias("p")).join(nations, "l_suppkey")
    return S.group_overlap(items, "g", "l_suppkey", "p", 25)


@query(
    """SELECT s_nationkey, count(*) AS nodes, CAST(sum(fit) AS BIGINT) AS room, count(*) FILTER (fit = 0) AS none FROM
    (SELECT s_nationkey, greatest(0, (CAST(floor(s_acctbal) AS BIGINT) - 384) // 1500) AS fit FROM supplier) GROUP BY 1"""
)
def capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "supplier").select("s_nationkey", F.floor("s_acctbal").alias("cap"))
    return S.capacity_fit(nodes, ["s_nationkey"], "cap", 1500, 384)


@query(
    """WITH p AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS run, CAST(floor(l_discount * 100) AS BIGINT) AS a, CAST(floor(l_tax * 100) AS BIGINT) AS b, CAST(l_linenumber AS BIGINT) AS c FROM lineitem),
    s AS (SELECT *, a + b + c AS s FROM p), f AS (SELECT *, CASE WHEN s > run THEN a * run // s ELSE a END AS fa, CASE WHEN s > run THEN b * run // s ELSE b END AS fb, CASE WHEN s > run THEN c * run // s ELSE c END AS fc FROM s),
    r AS (SELECT *, CASE WHEN s > run THEN run - fa - fb - fc ELSE 0 END AS rest FROM f)
    SELECT l_orderkey, l_linenumber, fa + CASE WHEN fa >= fb AND fa >= fc THEN rest ELSE 0 END AS a, fb + CASE WHEN fb > fa AND fb >= fc THEN rest ELSE 0 END AS b,
    fc + CASE WHEN fc > fa AND fc > fb THEN rest ELSE 0 END AS c, greatest(0, run - s) AS other FROM r"""
)
def split_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("run"), F.floor(F.col("l_discount") * 100).alias("a"), F.floor(F.col("l_tax") * 100).alias("b"), F.col("l_linenumber").cast("long").alias("c")
    )
    return S.fitted_parts(items, "run", ["a", "b", "c"], "other").drop("run")


@query("""SELECT event_type AS event, field, count(*) AS n, min(event_id) AS first_line FROM (SELECT event_type, event_id, unnest(json_keys(props)) AS field FROM events) WHERE NOT (event_type = 'click' AND field = 'k') GROUP BY ALL""")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("event"), F.lit("events").alias("file"), F.col("event_id").alias("line"), F.col("props").alias("value"))
    known = spark.createDataFrame([("click", "k")], "event string, field string")
    return E.unknown_fields(e, known).select("event", "field", "n", F.col("first.line").alias("first_line"))


@query(
    r"""SELECT regexp_replace(regexp_replace(url, '/[^/]*$', ''), '(/[^/=]+=[^/]*)+$', '') AS folder, count(*) AS n, min(page_id) AS first FROM pages GROUP BY 1"""
)
def page_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(T.data_folder(F.col("url")).alias("folder")).agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first"))


@query(
    """SELECT 's' || (user_id % 3) AS service, event_type AS action, count(*) AS calls, count(*) FILTER (event_type IN ('error', 'signup')) AS errors, count(*) FILTER (event_type = 'error') AS refused,
    array_to_string(list_sort(list_distinct(list('r' || (user_id % 7)) FILTER (event_type = 'error'))), ' ') AS resources FROM events GROUP BY 1, 2"""
)
def audit_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("event_type") == "error", "AccessDeniedException").when(F.col("event_type") == "signup", "Throttling")
    rows = table(spark, sf_dir, "events").select(F.expr("concat('s', user_id % 3)").alias("service"), F.col("event_type").alias("action"), code.alias("error_code"), F.array(F.expr("concat('r', user_id % 7)")).alias("resources"))
    joined = C.audit_calls(rows)
    return joined.withColumn("resources", F.when(F.size("resources") > 0, F.array_join("resources", " ")))


@query(
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_size WHEN 1 THEN p_size * 1024 WHEN 2 THEN p_size * 1048576 WHEN 3 THEN p_size * 1610612736::BIGINT WHEN 4 THEN p_size * 1048576 ELSE -1 END::BIGINT AS bytes FROM part"""
)
def part_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes written in several units; 1.5 GiB each in one of them, and a word that is none."""
    text = F.expr("CASE p_partkey % 6 WHEN 0 THEN concat(p_size, 'b') WHEN 1 THEN concat(p_size, ' KiB') WHEN 2 THEN concat(' ', p_size) WHEN 3 THEN concat(p_size * 3 / 2, 'GB') WHEN 4 THEN concat(p_size, 'm') ELSE concat(p_size, ' x') END")
    return table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 6 == 2, T.size_to_bytes(text, "m")).otherwise(T.size_to_bytes(text)).alias("bytes"))


@query(
    """SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'ip-10-0-' || (page_id % 7) || '-9' WHEN page_id % 4 = 1 THEN 'localhost' ELSE split_part(lower(regexp_extract(url, '://([^/?#]*)', 1)), '.', 1) END AS key FROM pages"""
)
def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.expr("CASE WHEN page_id % 4 = 0 THEN concat('10.0.', page_id % 7, '.9') WHEN page_id % 4 = 1 THEN if(page_id % 8 = 1, '127.0.0.1', 'LOCALHOST') ELSE regexp_extract(url, '://([^/?#]*)', 1) END")
    return table(spark, sf_dir, "pages").select("page_id", T.host_key(host).alias("key"))


@query(
    """WITH e AS (SELECT event_id, [0, 1, 52, 137, 143, 127, -104, -100, 130, 77][event_id % 10 + 1] AS code FROM events)
    SELECT event_id, CASE code WHEN 0 THEN 'finished' WHEN 1 THEN 'failed' WHEN 52 THEN 'out of heap' WHEN 137 THEN 'signal 9' WHEN 143 THEN 'signal 15' WHEN 127 THEN 'command not found' WHEN -104 THEN 'over physical memory' WHEN -100 THEN 'container released'
    WHEN 130 THEN 'signal 2' ELSE 'status 77' END AS meaning, CASE WHEN code IN (0, 143) THEN 'info' WHEN code IN (52, 137, -104) THEN 'critical' ELSE 'warning' END AS severity FROM e"""
)
def exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.element_at(F.array(*map(F.lit, (0, 1, 52, 137, 143, 127, -104, -100, 130, 77))), F.expr("cast(event_id % 10 + 1 as int)"))
    meaning, severity = C.exit_meaning(code)
    return table(spark, sf_dir, "events").select("event_id", meaning.alias("meaning"), severity.alias("severity"))


@query(
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'OFF_HEAP' ELSE (CASE WHEN p_partkey % 2 = 0 AND p_size % 2 = 0 THEN 'MEMORY_AND_DISK' WHEN p_partkey % 2 = 0 THEN 'MEMORY_ONLY' WHEN p_size % 2 = 0 THEN 'DISK_ONLY' ELSE 'NONE' END)
    || CASE WHEN p_partkey % 2 = 0 AND p_size % 5 > 0 THEN '_SER' ELSE '' END END || CASE WHEN p_size % 7 = 0 THEN '_2' ELSE '' END AS level FROM part"""
)
def storage_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = F.expr("struct(p_size % 2 = 0 AS disk, p_partkey % 2 = 0 AS memory, p_size % 3 = 0 AS off_heap, p_size % 5 = 0 AS deserialized, if(p_size % 7 = 0, 2, 1) AS replication)")
    return table(spark, sf_dir, "part").select("p_partkey", T.level_name(flags).alias("level"))


@query(
    """SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS quantity, round(sum(l_extendedprice), 2) AS price, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers,
    grouping(l_returnflag) * 2 + grouping(l_linestatus) AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"""
)
def fleet_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return items.rollup("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").cast("long").alias("quantity"),
        F.round(F.sum("l_extendedprice"), 2).alias("price"),
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("l_suppkey").alias("suppliers"),
        F.grouping_id().alias("level"),
    )


@query(
    """WITH n AS (SELECT l_suppkey, quantile_disc(q, 0.5) AS p50, quantile_disc(q, 0.95) AS p95, max(q) AS top FROM (SELECT l_suppkey, CAST(floor(l_extendedprice) AS BIGINT) AS q FROM lineitem) GROUP BY 1)
    SELECT l_suppkey, p50, p95, top, CASE WHEN p95 >= 5 * p50 THEN 3 WHEN p95 >= 3 * p50 THEN 2 WHEN p95 >= 2 * p50 THEN 1 ELSE 0 END AS level FROM n WHERE p50 > 0"""
)
def straggler_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "lineitem").select("l_suppkey", F.floor("l_extendedprice").alias("q"))
    return D.straggler_levels(q, ["l_suppkey"], "q")
