"""Queries of code lines, stage data, quoted regions and owners of lines, on names and lines that Spark derives from the given tables, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import commands as C
from ..operators import accounts as A
from ..operators import codelines as L
from ..operators import stagedata as D
from ..operators.quoted import drop_quoted
from ..operators.regionsplits import region_splits
from ..sources import eventlog as E
from ..sources.shared import shared_dir
from . import edits, fleet
from .kernel_queries import query, seconds, table

_PATH = r"regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id and the host and path of each page, as a file's path."""
    return table(spark, sf_dir, "pages").select("page_id", F.expr(_PATH).alias("path"))


@query(
    rf"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages),
    a AS (SELECT DISTINCT path AS file, list_filter(string_split(path, '/'), lambda x: x <> '') AS w FROM p WHERE page_id % 2 = 0), b AS (SELECT DISTINCT path, list_filter(string_split(path, '/'), lambda x: x <> '') AS w FROM p WHERE page_id % 2 = 1),
    m AS (SELECT file, path, (SELECT max(k) FROM range(1, least(len(a.w), len(b.w)) + 1) r(k) WHERE a.w[-k:] = b.w[-k:]) AS shared FROM a JOIN b ON a.w[-1] = b.w[-1]),
    t AS (SELECT file, max(shared) AS shared FROM m GROUP BY 1)
    SELECT a.file, min(m.path) AS path, CAST(coalesce(max(m.shared), 0) AS INTEGER) AS shared, CAST(greatest(count(m.path) - 1, 0) AS BIGINT) AS others
    FROM a LEFT JOIN (SELECT m.* FROM m JOIN t ON t.file = m.file AND t.shared = m.shared) m ON m.file = a.file GROUP BY a.file"""
)
def source_of_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of even pages as logged names, those of odd ones as sources."""
    p = page_paths(spark, sf_dir)
    return L.match_tails(p.filter("page_id % 2 = 0"), p.filter("page_id % 2 = 1"), "path", "path")


@query(
    """WITH e AS (SELECT user_id, event_id, event_id // 40 AS job, CASE WHEN event_type <> 'signup' THEN CAST(floor(epoch(ts)) AS BIGINT) END AS t,
      CASE WHEN event_type = 'click' AND event_id % 9 < 6 THEN 'job' || event_id % 9 || '.py' END AS own, event_id % 90 + 1 AS line FROM events),
    j AS (SELECT DISTINCT user_id, job FROM e),
    r AS (SELECT e.*, CASE WHEN job % 3 = 0 THEN 'run.py' END AS by_job, CASE WHEN job % 2 = 1 AND job % 3000 + 1 IN (SELECT p_partkey FROM part) THEN 'etl.py' END AS by_text FROM e),
    k AS (SELECT user_id, event_id, t, coalesce(own, by_job, by_text) AS file, CAST(CASE WHEN own IS NOT NULL THEN line WHEN by_job IS NOT NULL THEN job % 70 + 1 WHEN by_text IS NOT NULL THEN job % 3000 + 1 END AS INTEGER) AS line,
      CASE WHEN own IS NOT NULL THEN 'stage' WHEN by_job IS NOT NULL THEN 'job ' || job WHEN by_text IS NOT NULL THEN 'description of job ' || job END AS via FROM r),
    n AS (SELECT k.event_id, max(struct_pack(t := f.t, e := f.event_id, file := f.file, line := f.line)) AS near FROM k JOIN k f ON f.user_id = k.user_id AND f.file IS NOT NULL AND f.t <= k.t WHERE k.file IS NULL GROUP BY 1)
    SELECT 'u' || user_id AS app_id, 1 AS attempt, k.event_id AS stage_id, 0 AS stage_attempt, coalesce(k.file, near.file) AS file, coalesce(k.line, near.line) AS line,
      CASE WHEN near IS NOT NULL THEN 'nearest before' ELSE via END AS via, k.file IS NOT NULL AS certain FROM k LEFT JOIN n ON n.event_id = k.event_id"""
)
def code_of_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as stages and 40 events in a row as a job of each user, whose call sites, stacks and descriptions are made of them; parts as the lines that set descriptions."""
    e = table(spark, sf_dir, "events").withColumn("job_id", F.expr("event_id div 40")).withColumn("app_id", F.concat(F.lit("u"), "user_id")).withColumn("attempt", F.lit(1))
    site = F.when(F.expr("event_type = 'click'"), F.concat(F.lit("count at job"), F.expr("event_id % 9"), F.lit(".py:"), F.expr("event_id % 90 + 1"))).otherwise("count at NativeMethodAccessorImpl.java:0")
    stages = e.select("app_id", "attempt", F.col("event_id").alias("stage_id"), F.lit(0).alias("stage_attempt"), F.when(F.col("event_type") != "signup", seconds("ts")).alias("submitted"), L.code_of(site, F.lit(None).cast("string")).alias("code"))
    stack = F.when(F.expr("job_id % 3 = 0"), F.concat(F.lit("org.apache.spark.rdd.RDD.count(RDD.scala:9)\nat com.me.Run$.main(run.py:"), F.expr("job_id % 70 + 1"), F.lit(")\nother text")))
    described = F.when(F.expr("job_id % 2 = 1"), F.concat(F.lit("load table "), F.expr("job_id % 3000 + 1"), F.lit(" of day "), F.expr("job_id % 365"), F.lit(".")))
    jobs = e.select("app_id", "attempt", "job_id").distinct().withColumn("code", L.code_of(F.lit("count at NativeMethodAccessorImpl.java:0"), stack)).withColumn("description", described)
    links = e.select("app_id", "attempt", "job_id", F.col("event_id").alias("stage_id"))
    sets = F.concat(F.lit('sc.setJobDescription(f"load table '), "p_partkey", F.lit(' of day {day}.")'))
    lines = table(spark, sf_dir, "part").select(F.lit("etl.py").alias("file"), F.col("p_partkey").alias("line"), sets.alias("value"))
    own = e.filter("event_id % 9 < 6").select(F.concat(F.lit("job"), F.expr("event_id % 9"), F.lit(".py")).alias("file")).distinct().unionByName(jobs.select(F.lit("run.py").alias("file")).distinct())
    return L.stage_code(stages, jobs, links, own, L.match_descriptions(jobs, L.description_patterns(lines)))


@query(
    r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages),
    f AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS folder FROM p WHERE page_id % 3 = 0 UNION SELECT DISTINCT regexp_extract(path, '^[^/]*') FROM p WHERE page_id % 5 = 0)
    SELECT page_id, path, (SELECT max_by(folder, length(folder)) FROM f WHERE rtrim(path, '/') = folder OR starts_with(path, folder || '/')) AS folder FROM p"""
)
def folder_of_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' paths and the longest folder above each, of those that every third page names and the hosts of every fifth."""
    p = page_paths(spark, sf_dir)
    named = p.filter("page_id % 3 = 0").select(F.regexp_replace("path", "/[^/]*$", "").alias("up")).unionByName(p.filter("page_id % 5 = 0").select(F.regexp_extract("path", "^[^/]*", 0).alias("up")))
    return D.folders_holding(p, named, [], "path", "up")


@query(
    """WITH l AS (SELECT *, 's3://b/t' || l_partkey % 7 AS folder, CASE l_linenumber % 4 WHEN 0 THEN 1 WHEN 3 THEN 3 ELSE 2 END AS rank, CAST(floor(l_extendedprice) AS BIGINT) AS bytes FROM lineitem),
    e AS (SELECT l_suppkey AS stage, CASE WHEN l_returnflag = 'R' THEN 'write' ELSE 'read' END AS access, rank, bytes, l_partkey, l_linenumber, folder, CASE WHEN rank = 3 THEN 'table' ELSE 'path' END AS kind,
      CASE rank WHEN 1 THEN folder WHEN 3 THEN 'tab' || l_partkey % 3 ELSE folder || '/d=' || l_partkey % 2 || '/part-' || l_partkey % 3 || ', ' || CASE WHEN l_partkey % 5 = 0 THEN 's3://b/t9' ELSE folder END || '/_temporary/0/part-9' END AS name FROM l),
    g AS (SELECT *, rank = 2 AND l_partkey % 5 <> 0 AND EXISTS (SELECT 1 FROM e x WHERE x.stage = e.stage AND x.access = e.access AND x.rank = 1 AND x.name = e.folder) AS folds FROM e)
    SELECT 'a' AS app_id, 1 AS attempt, CAST(stage AS INTEGER) AS stage_id, 0 AS stage_attempt, access, kind, CASE WHEN folds THEN folder ELSE name END AS name, count(*) AS parts, count(*) FILTER (rank <> 3) AS sized, CAST(sum(bytes) AS BIGINT) AS bytes,
      CASE WHEN kind = 'path' THEN CASE WHEN bool_or(rank = 2) THEN 'parquet' END END AS format, array_to_string(list_sort(list_distinct(coalesce(flatten(list(string_split(name, ', ')) FILTER (folds)), []))), ';') AS paths,
      array_to_string(list_transform(list_sort(list_distinct(list(rank))), lambda r: ['executor logs', 'SQL plan', 'region store'][r]), ';') AS sources FROM g GROUP BY stage, access, kind, CASE WHEN folds THEN folder ELSE name END"""
)
def data_of_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as what their suppliers' stages read and wrote: executors name folders, plans two files each, the store tables."""
    li = table(spark, sf_dir, "lineitem").withColumn("rank", F.expr("case l_linenumber % 4 when 0 then 1 when 3 then 3 else 2 end")).withColumn("home", F.expr("concat('s3://b/t', l_partkey % 7)"))
    files = F.expr("concat(home, '/d=', l_partkey % 2, '/part-', l_partkey % 3, ', ', if(l_partkey % 5 = 0, 's3://b/t9', home), '/_temporary/0/part-9')")
    entries = li.select(
        F.lit("a").alias("app_id"), F.lit(1).alias("attempt"), F.col("l_suppkey").cast("int").alias("stage_id"), F.lit(0).alias("stage_attempt"), F.expr("if(l_returnflag = 'R', 'write', 'read')").alias("access"),
        F.expr("if(rank = 3, 'table', 'path')").alias("kind"), F.when(F.col("rank") == 1, F.concat("home", F.lit("/"))).when(F.col("rank") == 3, F.expr("concat('tab', l_partkey % 3)")).otherwise(files).alias("name"),
        F.lit(1).cast("long").alias("parts"), F.expr("cast(if(rank = 3, 0, 1) as bigint)").alias("sized"), F.floor("l_extendedprice").alias("bytes"), F.expr("if(rank = 2, 'parquet', '')").alias("format"), F.expr("element_at(array('executor logs', 'SQL plan', 'region store'), rank)").alias("source"),
    )
    out = D.merge_stage_data(entries)
    return out.withColumn("paths", F.array_join("paths", ";")).withColumn("sources", F.array_join("from", ";")).drop("from")


def user_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of their users' logs, numbered in the order of their ids."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("file"), F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).alias("line"), "event_id", F.col("event_type").alias("value"))


_LINES = "l AS (SELECT user_id AS file, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS line, event_id, event_type AS value FROM events)"


@query(
    f"""WITH RECURSIVE {_LINES},
    r AS (SELECT file, line, event_id, value, value = 'purchase' AS opens, CASE WHEN value = 'purchase' THEN 4 ELSE 0 END AS left, TRUE AS kept FROM l WHERE line = 1
      UNION ALL SELECT l.file, l.line, l.event_id, l.value, NULL, CASE WHEN r.left > 0 AND l.value NOT IN ('signup', 'click') THEN r.left - 1 WHEN (r.left = 0 OR l.value = 'click') AND l.value = 'purchase' THEN 4 ELSE 0 END, r.left = 0 OR l.value = 'click'
      FROM r JOIN l ON l.file = r.file AND l.line = r.line + 1)
    SELECT file, line, event_id, value FROM r WHERE kept"""
)
def unquoted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' lines without the regions that a purchase opens, a signup ends and a click shows to be over, of four lines at most."""
    return drop_quoted(user_lines(spark, sf_dir), "^purchase$", "^signup$", "^click$", 4).select("file", "line", "event_id", "value")


_TASKS = """CASE WHEN event_id % 10 = 0 THEN event_id // 60 END AS task, CASE WHEN event_id % 10 IN (1, 2) THEN event_id // 60 END AS owner"""


@query(
    f"""WITH RECURSIVE {_LINES}, f AS (SELECT file, line, CASE value WHEN 'view' THEN 'split' WHEN 'click' THEN 'size' END AS kind, {_TASKS}, event_id % 3 + 1 AS bytes FROM l WHERE value IN ('view', 'click')),
    k AS (SELECT *, coalesce(task, owner) AS of, max(CASE WHEN kind = 'split' THEN line END) OVER (PARTITION BY file, coalesce(task, owner) ORDER BY line) AS split FROM f),
    x AS (SELECT file, split AS line, of AS task, min_by(bytes, line) FILTER (kind = 'size') AS bytes, bool_or(task IS NOT NULL) FILTER (kind = 'split') AS named FROM k WHERE of IS NOT NULL AND split IS NOT NULL GROUP BY file, of, split),
    g AS (SELECT file, kind, bytes, line, row_number() OVER (PARTITION BY file ORDER BY line) AS n FROM k WHERE of IS NULL OR (task IS NULL AND kind = 'size' AND split IS NULL)),
    r AS (SELECT file, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS splits, CAST([] AS BIGINT[]) AS sizes, CAST([] AS BIGINT[]) AS done, CAST(NULL AS BIGINT) AS size FROM (SELECT DISTINCT file FROM g)
      UNION ALL SELECT file, n, CASE WHEN closes THEN [] ELSE s END, CASE WHEN closes THEN [] ELSE z END, CASE WHEN closes THEN s ELSE [] END, CASE WHEN closes AND list_min(z) = list_max(z) THEN z[1] END FROM (
        SELECT g.file, g.n, CASE WHEN g.kind = 'split' THEN list_append(r.splits, g.line) ELSE r.splits END AS s, CASE WHEN g.kind = 'size' AND len(r.splits) > 0 THEN list_append(r.sizes, g.bytes) ELSE r.sizes END AS z,
          g.kind = 'size' AND len(r.splits) > 0 AND len(r.sizes) + 1 = len(r.splits) AS closes FROM r JOIN g ON g.file = r.file AND g.n = r.n + 1)),
    d AS (SELECT file, unnest(done) AS line, size FROM r)
    SELECT file, line, task, bytes, CASE WHEN named THEN 'named' ELSE 'only task' END AS how FROM x
    UNION ALL SELECT g.file, g.line, NULL, d.size, CASE WHEN d.size IS NOT NULL THEN 'equal group' END FROM g LEFT JOIN d ON d.file = g.file AND d.line = g.line WHERE g.kind = 'split'"""
)
def splits_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' views as splits and clicks as sizes; every tenth line names its task, two more have an only open one."""
    lines = user_lines(spark, sf_dir).filter("value in ('view', 'click')")
    kinds = lines.withColumn("kind", F.expr("if(value = 'view', 'split', 'size')")).withColumn("task", F.expr("if(event_id % 10 = 0, event_id div 60, null)")).withColumn("owner", F.expr("if(event_id % 10 in (1, 2), event_id div 60, null)"))
    return region_splits(kinds.withColumn("bytes", F.expr("event_id % 3 + 1")))


_ENDS = """c AS (SELECT 'a' || o_custkey AS app_id, o_orderkey % 4 AS attempt, o_orderkey AS line, CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'P' THEN 'KILLED' ELSE 'SUCCEEDED' END AS status, CAST(o_orderkey % 5 AS INTEGER) AS code, o_orderkey % 3 AS side FROM orders),
    b AS (SELECT app_id, attempt, max_by(status, line) FILTER (side = 0) AS os, max_by(code, line) FILTER (side = 0) AS oc, max(line) FILTER (side = 0) AS ol, max_by(status, line) FILTER (side <> 0) AS ms, max_by(code, line) FILTER (side <> 0) AS mc,
      max(line) FILTER (side <> 0) AS ml FROM c WHERE status <> 'SUCCEEDED' GROUP BY 1, 2),
    e AS (SELECT app_id, CAST(attempt AS INTEGER) AS attempt, coalesce(os, ms) AS status, CASE WHEN os IS NOT NULL THEN oc ELSE mc END AS code, CASE WHEN os IS NOT NULL THEN 'driver' ELSE 'resource manager' END AS told_by, ol AS own_line, ml AS manager_line FROM b)"""


def order_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the ends of their customers' applications' attempts: a third told by drivers, the others by the resource manager."""
    o = table(spark, sf_dir, "orders")
    status = F.expr("case o_orderstatus when 'F' then 'FAILED' when 'P' then 'KILLED' else 'SUCCEEDED' end")
    return o.select(F.concat(F.lit("a"), "o_custkey").alias("app_id"), F.expr("cast(o_orderkey % 4 as int)").alias("attempt"), status.alias("status"), F.expr("cast(o_orderkey % 5 as int)").alias("code"), F.lit("f").alias("file"), F.col("o_orderkey").alias("line"))


def told_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = order_ends(spark, sf_dir)
    return A.attempt_ends(told.filter("line % 3 <> 0"), told.filter("line % 3 = 0"))


@query(f"WITH {_ENDS} SELECT * FROM e")
def ends_of_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told_ends(spark, sf_dir)


@query(
    f"""WITH {_ENDS}, s AS (SELECT 'a' || o_custkey AS app_id, max(CASE WHEN o_orderkey % 11 = 0 THEN 'KILLED' ELSE 'SUCCEEDED' END) AS summary, bool_or(o_orderkey % 11 = 0) AS killed, bool_and(o_orderkey % 11 = 0) AS only FROM orders GROUP BY 1),
    p AS (SELECT 'a' || o_custkey AS app_id, CAST(max(o_orderkey % 4) AS INTEGER) AS attempt, CASE WHEN count(*) % 3 = 0 THEN 'incomplete' ELSE 'succeeded' END AS state FROM orders GROUP BY 1),
    w AS (SELECT p.*, e.status, e.code, s.summary, p.state = 'succeeded' AND (e.status IS NOT NULL OR s.summary IN ('FAILED', 'KILLED')) AS wrong FROM p LEFT JOIN e ON e.app_id = p.app_id AND e.attempt = p.attempt LEFT JOIN s ON s.app_id = p.app_id),
    t AS (SELECT e.app_id, count(*) AS attempts, max_by(e.code, e.attempt) AS last_code FROM e JOIN p ON p.app_id = e.app_id WHERE e.attempt < p.attempt OR (p.state = 'succeeded' AND e.attempt <> p.attempt) GROUP BY 1)
    SELECT w.app_id, w.attempt, CASE WHEN wrong THEN 'failed' ELSE state END AS state, CASE WHEN wrong AND status IS NOT NULL THEN 'the event log ends normally, but the application master exited with code ' || code
      WHEN wrong THEN 'the event log ends normally, but the resource manager recorded the application as ' || CASE WHEN summary = 'KILLED' THEN 'killed' ELSE 'failed' END END AS reason, coalesce(t.attempts, 0) AS retried, t.last_code FROM w LEFT JOIN t ON t.app_id = w.app_id"""
)
def corrected_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as applications of the attempt with the highest number, most of which their event logs call succeeded, as the accounts of their ends correct them, and how often they were started again."""
    o = table(spark, sf_dir, "orders").withColumn("app_id", F.concat(F.lit("a"), "o_custkey"))
    apps = o.groupBy("app_id").agg(F.expr("cast(max(o_orderkey % 4) as int)").alias("attempt"), F.expr("if(count(*) % 3 = 0, 'incomplete', 'succeeded')").alias("state")).withColumn("reason", F.lit(None).cast("string"))
    ends = told_ends(spark, sf_dir)
    summaries = o.select("app_id", F.expr("if(o_orderkey % 11 = 0, 'KILLED', 'SUCCEEDED')").alias("final"))
    again = A.retried(apps, ends).select(F.col("app_id").alias("of"), "attempts", "last_code")
    out = A.correct_status(apps, ends, summaries).join(again, F.col("app_id") == F.col("of"), "left")
    return out.select("app_id", "attempt", "state", "reason", F.coalesce("attempts", F.lit(0)).alias("retried"), "last_code")


@query(
    """WITH f AS (SELECT 'a' || user_id AS app_id, event_id, 'f' || event_id AS file, CASE WHEN event_type <> 'error' THEN 'container_1_' || user_id || '_0' || event_id % 3 + 1 || '_' || lpad(CAST(event_id % 9 + 1 AS VARCHAR), 6, '0') END AS container FROM events),
    x AS (SELECT app_id, container, max(e) AS e, max(h) AS h FROM (SELECT DISTINCT app_id, container, CAST(event_id % 40 AS VARCHAR) AS e, 'h' || event_id % 4 AS h FROM f WHERE event_id % 4 = 0 AND container IS NOT NULL) GROUP BY 1, 2 HAVING count(*) = 1),
    d AS (SELECT 'a' || user_id AS app_id, 'container_1_' || user_id || '_02_000001' AS container, 'd' || user_id AS host, user_id % 2 = 0 AS cluster FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 5 <> 0))
    SELECT f.app_id, f.file, f.container, CASE WHEN x.e IS NOT NULL THEN x.e WHEN f.container = d.container THEN 'driver' WHEN f.container LIKE '%\\_000001' ESCAPE '\\' THEN CASE WHEN d.cluster THEN 'driver' ELSE 'am' END
        WHEN f.container IS NOT NULL AND event_id % 2 = 0 AND (d.app_id IS NULL OR event_id % 3 + 1 = 2) THEN 's' || event_id % 7 END AS executor,
      CASE WHEN x.e IS NOT NULL THEN x.h WHEN f.container = d.container THEN d.host WHEN f.container LIKE '%\\_000001' ESCAPE '\\' THEN CASE WHEN event_id % 2 = 0 THEN 'o' || event_id % 5 END
        WHEN f.container IS NOT NULL AND event_id % 2 = 0 AND (d.app_id IS NULL OR event_id % 3 + 1 = 2) THEN 'o' || event_id % 5 END AS host,
      CASE WHEN x.e IS NOT NULL THEN 'executor''s attribute' WHEN f.container = d.container THEN 'driver''s attribute' WHEN f.container LIKE '%\\_000001' ESCAPE '\\' THEN 'first container'
        WHEN f.container IS NOT NULL AND event_id % 2 = 0 AND (d.app_id IS NULL OR event_id % 3 + 1 = 2) THEN 'own log' END AS proof,
      CASE WHEN f.container IS NOT NULL AND d.app_id IS NOT NULL AND event_id % 3 + 1 <> 2 THEN CAST(event_id % 3 + 1 AS INTEGER) END AS earlier_attempt
    FROM f LEFT JOIN x ON x.app_id = f.app_id AND x.container = f.container LEFT JOIN d ON d.app_id = f.app_id"""
)
def executor_of_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log files of their users' containers; every fourth is named by an executor, users' drivers by all users but every fifth, and every second file says whose it is."""
    e = table(spark, sf_dir, "events").withColumn("app_id", F.concat(F.lit("a"), "user_id"))
    named = F.when(F.col("event_type") != "error", F.expr("concat('container_1_', user_id, '_0', event_id % 3 + 1, '_', lpad(cast(event_id % 9 + 1 as string), 6, '0'))"))
    files = e.select("app_id", "event_id", F.concat(F.lit("f"), "event_id").alias("file"), named.alias("container"))
    executors = files.filter("event_id % 4 = 0").select("app_id", F.expr("cast(event_id % 40 as string)").alias("executor_id"), F.expr("concat('h', event_id % 4)").alias("host"), "container")
    drivers = e.filter("user_id % 5 <> 0").select("app_id", F.expr("concat('container_1_', user_id, '_02_000001')").alias("container"), F.expr("concat('d', user_id)").alias("host"), F.lit(None).cast("int").alias("attempt"), F.expr("user_id % 2 = 0").alias("cluster")).distinct()
    said = files.filter("event_id % 2 = 0").select("file", F.lit(3).alias("line"), F.expr("concat('s', event_id % 7)").alias("executor"), F.expr("concat('o', event_id % 5)").alias("host"))
    return A.container_executors(files, executors, drivers, said)


def order_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the jobs of 16 applications, a line that is no event after every 97th, as lines that were written as text and read again."""
    orders = fleet.order_rows(spark, sf_dir).withColumn("app_id", F.expr("concat('app-1-', conv(substring(app_id, 7), 10, 10) % 16)"))
    broken = orders.filter("job % 97 = 0").select("app_id", F.lit(1).alias("attempt"), F.lit(0).cast("long").alias("part"), F.lit("events").alias("file"), (F.col("job") * 100 + 50).alias("line"), F.lit("SparkListenerJobEnd").alias("event"), F.lit('{"Event":"SparkListenerJob').alias("value"))
    path = f"{shared_dir(spark)}/logs-{uuid.uuid4().hex}"
    fleet.write_logs(fleet.job_lines(orders).unionByName(broken), path)
    return E.event_lines(spark, path)


_LOG_LINES = """o AS (SELECT 'app-1-' || o_custkey % 16 AS app_id, o_orderkey AS job, o_orderstatus AS s FROM orders),
    k AS (SELECT app_id, job, job * 100 AS pos, 'SparkListenerJobStart' AS event FROM o UNION ALL SELECT app_id, job, job * 100 + 1, 'SparkListenerStageSubmitted' FROM o UNION ALL SELECT app_id, job, job * 100 + 50, NULL FROM o WHERE job % 97 = 0
      UNION ALL SELECT app_id, job, job * 100 + 98, 'SparkListenerStageCompleted' FROM o WHERE s <> 'O' UNION ALL SELECT app_id, job, job * 100 + 99, 'SparkListenerJobEnd' FROM o WHERE s <> 'O'),
    n AS (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY pos) AS line FROM k)"""


@query(f"WITH {_LOG_LINES} SELECT app_id, 1 AS attempt, CAST(0 AS BIGINT) AS part, line, event, CASE WHEN event LIKE '%Job%' THEN job END AS job FROM n")
def log_lines_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as the readers number and name them: after a write as text, whatever splits the files are read in."""
    return order_log_lines(spark, sf_dir).select("app_id", "attempt", "part", "line", "event", F.get_json_object("value", "$['Job ID']").cast("long").alias("job"))


@query(
    f"""WITH {_LOG_LINES}, l AS (SELECT app_id, arg_max(event IS NULL, line) AS cut FROM n GROUP BY 1)
    SELECT n.app_id, count(*) AS lines, count(event) AS events, count(*) FILTER (event IS NULL) - CAST(any_value(cut) AS INTEGER) AS malformed,
      CASE WHEN count(*) FILTER (event IS NULL) > CAST(any_value(cut) AS INTEGER) THEN min(line) FILTER (event IS NULL) END AS first_malformed, any_value(cut) AS truncated FROM n JOIN l ON l.app_id = n.app_id GROUP BY 1"""
)
def log_quality_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    app, _ = E.app_and_attempt(F.col("file"))
    return E.line_quality(order_log_lines(spark, sf_dir)).select(app.alias("app_id"), "lines", "events", "malformed", "first_malformed", "truncated")


@query(
    r"""SELECT p_partkey, '/usr/bin/spark-submit --deploy-mode cluster --conf spark.db.password=[redacted] --secret [redacted] --verbose --name "' || p_name || '" s3://b/job' || p_partkey || '.py --day "it''s \"x\""' AS command,
    's3://b/job' || p_partkey || '.py' AS script FROM part"""
)
def masked_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands that submit a script for each part, with secrets in options and settings, written with quotes of both kinds."""
    words = ("/usr/bin/spark-submit --deploy-mode cluster --conf 'spark.db.password=", "' --secret ", " --verbose --name '", "' s3://b/job", """.py --day "it's \\"x\\"" """)
    command = F.concat(F.lit(words[0]), "p_brand", F.lit(words[1]), F.regexp_replace("p_brand", r"\W", ""), F.lit(words[2]), "p_name", F.lit(words[3]), "p_partkey", F.lit(words[4]))
    return table(spark, sf_dir, "part").select("p_partkey", C.redact_command(command).alias("command"), C.submitted_script(command).alias("script"))


@query(
    """SELECT o_orderkey, '{"a":{"db.password": "[redacted]","k":[1,{"Tokens" : "[redacted]","n":' || o_custkey || '}]},"credential":"[redacted]","api-key":"[redacted]","note":"user=' || o_custkey || ' secret=[redacted]","plain":["x"]}' AS value FROM orders"""
)
def masked_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as nested JSON with secrets as strings, numbers, lists and objects, and in running text."""
    parts = ('{"a":{"db.password": "p \\"q ', '","k":[1,{"Tokens" : ["', '", "b"],"n":', '}]},"credential":{"user":"', '","n":-1.5e3},"api-key":', ',"note":"user=', " secret=", '","plain":["x"]}')
    value = F.concat(F.lit(parts[0]), "o_orderstatus", F.lit(parts[1]), "o_orderkey", F.lit(parts[2]), "o_custkey", F.lit(parts[3]), "o_custkey", F.lit(parts[4]), "o_orderkey", F.lit(parts[5]), "o_custkey", F.lit(parts[6]), F.lit("abc"), F.lit(parts[7]))
    return table(spark, sf_dir, "orders").select("o_orderkey", C.redact_json(value).alias("value"))


@query(
    """WITH o AS (SELECT o_custkey AS c, min(epoch_ms(CAST(o_orderdate AS TIMESTAMP))) AS ref, count(*) AS n FROM orders GROUP BY 1), d AS (SELECT c, (c % 9 - 4) * 1800000 + (c % 41 - 20) * 60000 AS diff FROM o WHERE c % 7 <> 0)
    SELECT 'a' || c AS app_id, CAST(round(diff / 1800000) * 30 AS BIGINT) AS offset_min FROM d WHERE round(diff / 1800000) <> 0 AND abs(diff - round(diff / 1800000) * 1800000) <= 720000"""
)
def zones_of_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as applications whose logs begin some half hours and minutes beside their first order; every seventh has no reference."""
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("a"), "o_custkey").alias("app_id"), "o_custkey", F.col("o_orderdate").cast("timestamp").alias("t"))
    began = o.groupBy("app_id", "o_custkey").agg(F.min("t").alias("t"))
    first = began.select("app_id", F.timestamp_millis(F.unix_millis("t") + F.expr("(o_custkey % 9 - 4) * 1800000 + (o_custkey % 41 - 20) * 60000")).alias("first"))
    none = F.lit(None).cast("timestamp")
    ref = began.filter("o_custkey % 7 <> 0").select("app_id", F.when(F.expr("o_custkey % 2 = 0"), F.col("t")).alias("event_log"), F.when(F.expr("o_custkey % 2 = 1"), F.col("t")).alias("summary"), none.alias("step"))
    return A.zone_offsets(first, ref, slack_min=12)


@query(
    """WITH o AS (SELECT 'a' || o_custkey AS app_id, o_orderkey AS k, ['executor-lost', 'idle-nodes', 'shared-cluster', 'executor-fit', 'executor-memory-kill', 'job-failed'][o_orderkey % 6 + 1] AS rule, o_orderkey % 3 = 0 AS told FROM orders),
    s AS (SELECT app_id, min(CAST(k AS VARCHAR)) AS first FROM o WHERE rule = 'shared-cluster' GROUP BY 1), i AS (SELECT app_id, count(*) AS idle FROM o WHERE rule = 'idle-nodes' GROUP BY 1), f AS (SELECT DISTINCT app_id FROM o WHERE rule = 'executor-fit'),
    r AS (SELECT o.app_id, k, rule, CASE WHEN rule = 'executor-memory-kill' THEN 'critical' WHEN rule IN ('idle-nodes', 'shared-cluster') THEN 'info' ELSE 'warning' END AS severity,
      1 + CASE WHEN told AND rule IN ('executor-lost', 'executor-memory-kill') THEN 1 WHEN rule = 'shared-cluster' AND CAST(k AS VARCHAR) = first THEN coalesce(idle, 0) ELSE 0 END AS evidence,
      CASE WHEN rule = 'executor-memory-kill' AND told THEN 'heap' END AS cause, CASE WHEN rule = 'shared-cluster' AND CAST(k AS VARCHAR) = first THEN CAST(idle AS VARCHAR) END AS instead, CASE WHEN rule = 'idle-nodes' AND f.app_id IS NOT NULL THEN 'executor-fit' END AS see
      FROM o LEFT JOIN s ON s.app_id = o.app_id LEFT JOIN i ON i.app_id = o.app_id LEFT JOIN f ON f.app_id = o.app_id WHERE NOT (rule = 'idle-nodes' AND s.app_id IS NOT NULL))
    SELECT app_id, k AS of, rule, severity, evidence, cause, instead, see, row_number() OVER (PARTITION BY app_id ORDER BY list_position(['critical', 'warning', 'info'], severity),
      coalesce(list_position(['job-failed', 'executor-memory-kill', 'executor-lost', 'executor-fit', 'idle-nodes'], rule), 99), CAST(k AS VARCHAR) || CASE WHEN cause IS NULL THEN '"' ELSE '"' END) AS rank FROM r"""
)
def edited_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as findings of six rules about their customers' applications, every third executor's log telling why it went, edited and ranked."""
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("a"), "o_custkey").alias("app_id"), F.lit(1).alias("attempt"), F.col("o_orderkey").alias("k"))
    rule = F.element_at(F.array(*map(F.lit, ("executor-lost", "idle-nodes", "shared-cluster", "executor-fit", "executor-memory-kill", "job-failed"))), F.expr("cast(k % 6 + 1 as int)"))
    level = F.when(F.col("rule") == "executor-memory-kill", "critical").when(F.col("rule").isin("idle-nodes", "shared-cluster"), "info").otherwise("warning")
    rows = o.withColumn("rule", rule).withColumn("severity", level)
    evidence = F.array(F.struct(F.lit("f").alias("file"), F.col("k").alias("line"), F.lit("t").alias("text")))
    found = rows.select("app_id", "attempt", "rule", "severity", F.lit("s").alias("section"), F.create_map(F.lit("executor"), F.col("k").cast("string")).alias("args"), evidence.cast("array<struct<file:string,line:bigint,text:string>>").alias("evidence"))
    hits = o.filter("k % 3 = 0").select(F.col("app_id").alias("app"), F.col("k").cast("string").alias("executor"), F.lit("g").alias("file"), F.lit(1).alias("line"), F.lit("out-of-memory").alias("hit"), F.lit("heap space").alias("text"))
    out = edits.all_findings([found], hits)
    arg = lambda k: F.col("args")[k]
    return out.select("app_id", arg("executor").cast("long").alias("of"), "rule", "severity", F.size("evidence").alias("evidence"), arg("cause").alias("cause"), arg("instead of idle-nodes").alias("instead"), arg("see").alias("see"), "rank")
