"""Queries that run the event-log operators on lines derived from whole tables, each with the SQL that gives the same rows from the tables themselves."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cluster as C
from ..operators import extract as X
from ..operators import logtext as G
from ..operators import memory as M
from ..operators import sqlplans as P
from ..operators import stages as S
from ..operators import summary as U
from ..sources import eventlog as E
from ..sources.shared import shared_dir
from . import fleet as L
from .fleet import BLOCKS_SQL, JOBS_SQL, TASKS_SQL
from .gold import gold_tables
from .kernel_queries import query

_STATUS = "count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'killed') AS killed"
#: A task's parts in ms, as its line gives them.
_GETTING = "CASE WHEN x = 0 THEN 5 ELSE 0 END"
_DELAY = f"greatest(0, p - p // 2 - ln * 3 - ln - {_GETTING})"


def _tasks(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return X.task_ends(L.task_end_lines(L.item_rows(spark, sf_dir)), columns)


def _jobs(spark: SparkSession, sf_dir: str, *columns: str) -> tuple[DataFrame, DataFrame]:
    lines = L.job_lines(L.order_rows(spark, sf_dir))
    return lines, S.jobs(X.job_starts(lines, columns), X.job_ends(lines))


def _apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, jobs = _jobs(spark, sf_dir, "job_id", "submitted")
    more = L.app_lines(L.order_rows(spark, sf_dir))
    return S.applications(X.app_starts(more), X.app_ends(more), jobs, E.event_counts(lines.unionByName(more)))


def _executors(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = L.executor_lines(L.item_rows(spark, sf_dir))
    return S.executors(X.executors_added(lines), X.executors_removed(lines), _apps(spark, sf_dir))


@query(
    f"""WITH {TASKS_SQL} SELECT app_id, stage_id, task_id, status, executor_id, host, CASE x % 4 WHEN 0 THEN 'PROCESS_LOCAL' WHEN 1 THEN 'NODE_LOCAL' WHEN 2 THEN 'RACK_LOCAL' ELSE 'ANY' END AS locality, ln = 7 AS speculative,
    launched, launched + p AS finished, p AS duration_ms, CAST({_GETTING} AS BIGINT) AS getting_ms, CAST({_DELAY} AS BIGINT) AS scheduler_delay_ms, p // 2 AS run_ms, p * 400000 AS cpu_ns, pk * 10 AS input_bytes, p * 1000 AS heap FROM t"""
)
def log_task_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ("app_id", "stage_id", "task_id", "status", "executor_id", "host", "locality", "speculative", "launched", "finished", "duration_ms", "getting_ms", "scheduler_delay_ms", "run_ms", "cpu_ns", "input_bytes")
    return _tasks(spark, sf_dir).select(*cols, F.col("gauges.JVMHeapMemory").alias("heap"))


_SUMS = f"""count(*) AS tasks, {_STATUS}, count(*) FILTER (ln = 7) AS speculative, count(*) FILTER (x % 4 = 0) AS process_local, count(*) FILTER (x % 4 = 3) AS "any", CAST(sum(p // 2) AS BIGINT) AS run_ms,
    CAST(sum(q * 9) AS BIGINT) AS gc_ms, CAST(sum({_DELAY}) AS BIGINT) AS scheduler_delay_ms, CAST(sum(CASE WHEN d > 6 THEN q * 1000 ELSE 0 END) AS BIGINT) AS disk_spill, CAST(sum(p * 3) AS BIGINT) AS shuffle_write_bytes, max(pk) AS peak_exec_mem"""
_TOTALS = ("tasks", "succeeded", "failed", "killed", "speculative", "process_local", "any", "run_ms", "gc_ms", "scheduler_delay_ms", "disk_spill", "shuffle_write_bytes", "peak_exec_mem")


@query(f"WITH {TASKS_SQL} SELECT app_id, stage_id, {_SUMS} FROM t GROUP BY ALL")
def log_stage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stage_totals(_tasks(spark, sf_dir)).select("app_id", "stage_id", *_TOTALS)


@query(f"WITH {TASKS_SQL} SELECT app_id, executor_id, max(host) AS host, {_SUMS} FROM t GROUP BY ALL")
def log_executor_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.executor_totals(_tasks(spark, sf_dir)).select("app_id", "executor_id", "host", *_TOTALS)


@query(f"WITH {TASKS_SQL} SELECT app_id, stage_id, executor_id, {_SUMS} FROM t GROUP BY ALL")
def log_stage_executor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stage_executor(_tasks(spark, sf_dir)).select("app_id", "stage_id", "executor_id", *_TOTALS)


@query(
    f"""WITH {TASKS_SQL} SELECT app_id, stage_id, count(*) AS n, CAST(sum(p) AS BIGINT) AS total, quantile_disc(p, 0.5) AS p50, quantile_disc(p, 0.95) AS p95, max(p) AS slowest_ms,
    quantile_disc(pk * 10 + p * 3, 0.5) AS moved_p50, max(q * 3) AS most_rows, CAST(sum(q * 9) AS BIGINT) AS gc FROM t WHERE status = 'succeeded' GROUP BY ALL"""
)
def log_stage_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = S.stage_dist(_tasks(spark, sf_dir))
    return d.select(
        "app_id", "stage_id", "n", F.col("duration_ms.total").alias("total"), F.col("duration_ms.p50").alias("p50"), F.col("duration_ms.p95").alias("p95"), F.col("slowest.duration_ms").alias("slowest_ms"),
        F.col("moved_bytes.p50").alias("moved_p50"), F.col("moved_rows.hi").alias("most_rows"), F.col("gc_ms.total").alias("gc"),
    )


@query(
    f"""WITH {TASKS_SQL}, m AS (SELECT app_id, stage_id, unnest(['duration_ms', 'run_ms', 'gc_ms', 'disk_spill', 'input_records', 'fetch_wait_ms']) AS measure,
    unnest([p, p // 2, q * 9, CASE WHEN d > 6 THEN q * 1000 ELSE 0 END, q, x * 11]) AS v FROM t WHERE status = 'succeeded')
    SELECT app_id, stage_id, measure, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, min(v) AS lo, max(v) AS hi, quantile_disc(v, 0.25) AS p25, quantile_disc(v, 0.5) AS p50, quantile_disc(v, 0.75) AS p75 FROM m GROUP BY ALL"""
)
def log_stage_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = S.stage_quartiles(_tasks(spark, sf_dir)).filter(F.col("measure").isin("duration_ms", "run_ms", "gc_ms", "disk_spill", "input_records", "fetch_wait_ms"))
    return q.select("app_id", "stage_id", "measure", "n", "total", "lo", "hi", "p25", "p50", "p75")


@query(f"WITH {TASKS_SQL} SELECT app_id, stage_id, p AS duration_ms, task_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY app_id, stage_id ORDER BY p DESC, task_id) AS rank FROM t) WHERE rank <= 2")
def log_slowest_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.slowest_tasks(_tasks(spark, sf_dir), 2).select("app_id", "stage_id", "duration_ms", "task_id", "rank")


@query(f"WITH {TASKS_SQL} SELECT app_id, stage_id, 'java.io.E' || (x % 3) AS kind, 'no block ' || ln AS message, count(*) AS n, array_to_string(list_sort(list_distinct(list(executor_id))), ' ') AS executors FROM t WHERE status = 'failed' GROUP BY 1, 2, 3, 4")
def log_task_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.task_failures(_tasks(spark, sf_dir)).select("app_id", "stage_id", "kind", "message", "n", F.array_join("executors", " ").alias("executors"))


@query(f"WITH {TASKS_SQL}, e AS (SELECT DISTINCT app_id, task_id FROM t WHERE ln % 3 > 0) SELECT app_id, stage_id, task_id, executor_id, launched FROM t ANTI JOIN e USING (app_id, task_id)")
def log_running_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = L.item_rows(spark, sf_dir)
    out = S.running_tasks(X.task_starts(L.task_start_lines(items)), X.task_ends(L.task_end_lines(items.filter("ln % 3 > 0"))))
    return out.select("app_id", "stage_id", "task_id", "executor_id", "launched")


@query(
    f"""WITH {JOBS_SQL} SELECT app_id, job_id, 'count at /opt/jobs/' || substr(pri, 1, 1) || '.py:' || (job_id % 90) AS name, submitted, completed, CAST(job_id % 7 AS BIGINT) AS execution_id,
    CASE s WHEN 'P' THEN 'JobFailed' WHEN 'F' THEN 'JobSucceeded' END AS result, s = 'P' AS failed, CASE WHEN s = 'P' THEN 'Lost task 0.3: java.io.IOException: gone' END AS error FROM j"""
)
def log_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jobs(spark, sf_dir)[1].select("app_id", "job_id", "name", "submitted", "completed", "execution_id", "result", "failed", "error")


@query(f"WITH {JOBS_SQL} SELECT app_id, job_id, CAST(job_id % 7 AS BIGINT) AS execution_id, job_id AS stage_id FROM j")
def log_job_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.job_stage(_jobs(spark, sf_dir)[1]).drop("attempt")


_APPS_SQL = f"""{JOBS_SQL}, a AS (SELECT app_id, min(submitted) AS started, max(submitted) + 86400000 AS e, count(*) AS n, arg_max(s = 'P', (submitted, job_id)) AS bad, max(coalesce(completed, submitted)) AS seen,
    CAST(sum(CASE WHEN s = 'O' THEN 2 ELSE 4 END) AS BIGINT) AS lines FROM j GROUP BY 1), b AS (SELECT *, CASE WHEN n % 5 > 0 THEN e END AS app_ended, CASE WHEN n % 5 > 0 AND n % 4 = 1 THEN n % 3 END AS code FROM a),
    apps AS (SELECT *, coalesce(app_ended, seen) AS ended, CASE WHEN app_ended IS NULL THEN 'incomplete' WHEN coalesce(code, 0) <> 0 THEN 'failed' WHEN code IS NULL AND bad THEN 'failed' ELSE 'succeeded' END AS state FROM b)"""


@query(
    f"""WITH {_APPS_SQL} SELECT app_id, 'name of ' || app_id AS name, 'u' || (n % 3) AS "user", started, ended, ended - started AS duration_ms, CAST(code AS INTEGER) AS exit_code, state,
    CASE WHEN coalesce(code, 0) <> 0 THEN 'exit code ' || code WHEN bad THEN 'Lost task 0.3: java.io.IOException: gone' END AS reason, lines + 1 + CASE WHEN n % 5 > 0 THEN 1 ELSE 0 END AS events FROM apps"""
)
def log_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _apps(spark, sf_dir).select("app_id", "name", "user", "started", "ended", "duration_ms", "exit_code", "state", "reason", "events")


@query(
    f"""WITH {TASKS_SQL}, {_APPS_SQL}, w AS (SELECT app_id, stage_id, count(*) AS tasks FROM t GROUP BY ALL)
    SELECT j.app_id, j.job_id AS stage_id, 'count at ' || substr(pri, 1, 1) || '.py:' || (j.job_id % 90) AS call_site, CASE WHEN s = 'P' THEN 'failed' WHEN s = 'F' THEN 'complete' WHEN apps.app_ended IS NOT NULL THEN 'incomplete' ELSE 'running' END AS state,
    w.tasks, j.completed - j.submitted AS wall_ms FROM j JOIN apps USING (app_id) LEFT JOIN w ON w.app_id = j.app_id AND w.stage_id = j.job_id"""
)
def log_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, _ = _jobs(spark, sf_dir)
    out = S.stages(X.stage_events(lines), S.stage_totals(_tasks(spark, sf_dir)), X.app_ends(L.app_lines(L.order_rows(spark, sf_dir))))
    return out.select("app_id", "stage_id", "call_site", "state", "tasks", "wall_ms")


_EXEC_SQL = f"""{TASKS_SQL}, {_APPS_SQL}, x0 AS (SELECT app_id, executor_id, min(launched) AS added, max(launched + p) AS b, count(*) AS n, min(host) AS host FROM t GROUP BY 1, 2),
    x1 AS (SELECT x0.*, CASE WHEN n % 3 > 0 THEN b END AS removed, CASE WHEN n % 3 > 0 THEN (n + CAST(executor_id AS INTEGER)) % 8 END AS why FROM x0),
    ex AS (SELECT x1.app_id, executor_id, host, CAST(x1.n % 4 + 1 AS INTEGER) AS cores, added, removed, x1.n * 20000 AS startup_ms, added AS start, coalesce(removed, ended) AS "end",
    ['memory-kill', 'decommissioned', 'killed-by-driver', 'memory-kill', 'lost', 'lost', 'idle', 'other'][why + 1] AS kind FROM x1 LEFT JOIN apps USING (app_id))"""


@query(f'WITH {_EXEC_SQL} SELECT app_id, executor_id, host, cores, startup_ms, added, removed, kind, start, "end" FROM ex')
def log_executors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _executors(spark, sf_dir).select("app_id", "executor_id", "host", "cores", "startup_ms", "added", "removed", "kind", "start", "end")


@query(
    f"""WITH {_EXEC_SQL}, h AS (SELECT app_id, CAST(sum(greatest(0, "end" - start) * cores) AS BIGINT) AS core_ms FROM ex GROUP BY 1), u AS (SELECT app_id, CAST(sum(p // 2) AS BIGINT) AS run_ms, CAST(sum(p * 400000) AS BIGINT) AS cpu_ns, CAST(sum(p) AS BIGINT) AS task_ms FROM t GROUP BY 1)
    SELECT app_id, run_ms, cpu_ns, task_ms, core_ms, CASE WHEN run_ms > 0 THEN round(cpu_ns / 1e6 / run_ms, 6) ELSE 0 END AS cpu_share, CASE WHEN core_ms > 0 THEN round(task_ms / core_ms, 6) ELSE 0 END AS busy_share FROM u LEFT JOIN h USING (app_id)"""
)
def log_cpu_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.cpu_use(_executors(spark, sf_dir), S.stage_totals(_tasks(spark, sf_dir)))
    return out.select("app_id", "run_ms", "cpu_ns", "task_ms", "core_ms", F.round("cpu_share", 6).alias("cpu_share"), F.round("busy_share", 6).alias("busy_share"))


@query(
    f"""WITH {_APPS_SQL}, i AS (SELECT app_id, started AS lo, ended AS hi, greatest(submitted, started) AS a, least(coalesce(completed, ended), ended) AS b FROM j JOIN apps USING (app_id)), k AS (SELECT * FROM i WHERE b >= a),
    r AS (SELECT *, max(b) OVER (PARTITION BY app_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM k)
    SELECT app_id, coalesce(reach, lo) AS gap_start, a AS gap_end FROM r WHERE a - coalesce(reach, lo) >= 1000 UNION ALL SELECT app_id, max(b), max(hi) FROM k GROUP BY 1 HAVING max(hi) - max(b) >= 1000"""
)
def log_driver_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.driver_gaps(_apps(spark, sf_dir), _jobs(spark, sf_dir, "job_id", "submitted")[1]).select("app_id", "gap_start", "gap_end")


@query(
    f"""WITH {_EXEC_SQL}, s AS (SELECT app_id, start AS t, 1 AS d FROM ex WHERE start IS NOT NULL UNION ALL SELECT app_id, "end", -1 FROM ex WHERE start IS NOT NULL AND "end" IS NOT NULL), c AS (SELECT app_id, t, sum(d) AS d FROM s GROUP BY ALL)
    SELECT app_id, t, CAST(sum(d) OVER (PARTITION BY app_id ORDER BY t) AS BIGINT) AS running FROM c"""
)
def log_executors_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.executors_over_time(_executors(spark, sf_dir)).select("app_id", "t", "running")


@query(
    f"""WITH {_EXEC_SQL}, s AS (SELECT app_id, host, start AS t, 1 AS d FROM ex WHERE start IS NOT NULL UNION ALL SELECT app_id, host, "end", -1 FROM ex WHERE start IS NOT NULL AND "end" IS NOT NULL), c AS (SELECT app_id, host, t, d, sum(d) AS x FROM s GROUP BY ALL),
    r AS (SELECT app_id, host, t, CAST(sum(x) OVER (PARTITION BY app_id, host ORDER BY t, d) AS BIGINT) AS n FROM c) SELECT app_id, host, n AS peak, t AS at FROM r QUALIFY row_number() OVER (PARTITION BY app_id, host ORDER BY n DESC, t) = 1"""
)
def log_peak_per_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.peak_per_host(_executors(spark, sf_dir)).select("app_id", "host", "peak", "at")


@query(f"WITH {TASKS_SQL}, s AS (SELECT * FROM t) SELECT app_id, executor_id, max(p * 1000) AS \"JVMHeapMemory\", max(q) AS \"MajorGCTime\" FROM s GROUP BY ALL")
def log_executor_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.executor_peaks(X.peak_samples(L.task_end_lines(L.item_rows(spark, sf_dir)))).select("app_id", "executor_id", "JVMHeapMemory", "MajorGCTime")


@query(
    f"""WITH {TASKS_SQL}, a AS (SELECT app_id, stage_id, CAST(sum({_DELAY}) AS BIGINT) AS delay_ms, CAST(sum(ln * 3) AS BIGINT) AS unpack_ms, CAST(sum(ln + {_GETTING}) AS BIGINT) AS result_ms, CAST(sum(p // 2) AS BIGINT) AS run, CAST(sum(p * 400000) AS BIGINT) // 1000000 AS a, CAST(sum(q * 9) AS BIGINT) AS b,
    CAST(sum(x * 11) AS BIGINT) AS c, CAST(sum(p * 1000) AS BIGINT) // 1000000 AS d FROM t GROUP BY ALL), s AS (SELECT *, a + b + c + d AS s FROM a),
    f AS (SELECT *, CASE WHEN s > run THEN CAST(a::HUGEINT * run // s AS BIGINT) ELSE a END AS fa, CASE WHEN s > run THEN CAST(b::HUGEINT * run // s AS BIGINT) ELSE b END AS fb, CASE WHEN s > run THEN CAST(c::HUGEINT * run // s AS BIGINT) ELSE c END AS fc, CASE WHEN s > run THEN CAST(d::HUGEINT * run // s AS BIGINT) ELSE d END AS fd FROM s),
    r AS (SELECT *, CASE WHEN s > run THEN run - fa - fb - fc - fd ELSE 0 END AS rest, greatest(fa, fb, fc, fd) AS top FROM f)
    SELECT app_id, stage_id, delay_ms, unpack_ms, result_ms, run AS run_ms, fa + CASE WHEN fa = top THEN rest ELSE 0 END AS compute_ms, fb + CASE WHEN fb = top AND fa < top THEN rest ELSE 0 END AS gc_ms, fc + CASE WHEN fc = top AND fa < top AND fb < top THEN rest ELSE 0 END AS fetch_ms,
    fd + CASE WHEN fd = top AND fa < top AND fb < top AND fc < top THEN rest ELSE 0 END AS write_ms, greatest(0, run - s) AS other_ms FROM r"""
)
def log_time_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.time_split(S.stage_totals(_tasks(spark, sf_dir)), ["app_id", "stage_id"])


@query(f"WITH {TASKS_SQL}, {BLOCKS_SQL} SELECT app_id, regexp_extract(block, '^[^_-]*') AS kind, count(*) AS updates, max(memory) AS max_memory, max(disk) AS max_disk FROM u GROUP BY ALL")
def log_block_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.block_kinds(X.block_updates(L.block_lines(L.item_rows(spark, sf_dir)))).drop("attempt")


@query(
    f"""WITH {TASKS_SQL}, {BLOCKS_SQL}, gone AS (SELECT DISTINCT app_id, 2 AS rdd_id FROM t WHERE q % 2 = 0),
    r AS (SELECT app_id, CAST(line % 3 AS INTEGER) AS rdd_id, executor_id, block, arg_max(memory, line) AS m, arg_max(disk, line) AS d FROM u WHERE block LIKE 'rdd\\_%' ESCAPE '\\' GROUP BY 1, 2, 3, 4)
    SELECT app_id, rdd_id, executor_id, count(*) AS blocks, CAST(sum(m) AS BIGINT) AS memory, CAST(sum(d) AS BIGINT) AS disk FROM r ANTI JOIN gone USING (app_id, rdd_id) WHERE m + d > 0 GROUP BY ALL"""
)
def log_cached_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = L.block_lines(L.item_rows(spark, sf_dir))
    return S.cached_blocks(X.block_updates(lines), X.unpersisted(lines)).drop("attempt")


@query(f"WITH {TASKS_SQL} SELECT app_id, 'executor-stage' AS scope, false AS lift, executor_id AS target, launched AS t, stage_id, max(ln) AS failures, min(task_id) * 2 AS line FROM t WHERE d >= 9 GROUP BY ALL")
def log_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.exclusions(L.exclusion_lines(L.item_rows(spark, sf_dir))).select("app_id", "scope", "lift", "target", "t", "stage_id", "failures", F.col("src.line").alias("line"))


_ENV_SQL = """a AS (SELECT 'app-1-' || o_custkey AS app_id, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT app_id, 'spark' AS section, unnest(['spark.executor.memory', 'spark.sql.adaptive.enabled', 'spark.hadoop.fs.s3a.secret.key', 'spark.jars']) AS key,
    unnest([(n % 3 + 1) || 'g', CASE WHEN n % 2 = 0 THEN 'True' ELSE 'false' END, '[redacted]', 's3://b/app-core-1.' || (n % 4) || '.jar,/opt/x/tool_2.13-0.9.jar']) AS value FROM a)"""


@query(f"WITH {_ENV_SQL} SELECT app_id, section, key, value, contains(key, 'secret') AS redacted FROM s")
def log_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.settings(L.environment_lines(L.order_rows(spark, sf_dir))).select("app_id", "section", "key", "value", "redacted")


_KNOWN_SQL = ", ".join(f"('{k}', '{d}')" for k, d, _ in C.KNOWN_SETTINGS)


@query(
    f"""WITH {_ENV_SQL}, k(key, "default") AS (VALUES {_KNOWN_SQL}) SELECT a.app_id, k.key, k."default", s.value, s.value IS NOT NULL AND NOT lower(s.value) = k."default" AS differs
    FROM a CROSS JOIN k LEFT JOIN s ON s.app_id = a.app_id AND s.key = k.key"""
)
def log_settings_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.settings_view(X.settings(L.environment_lines(L.order_rows(spark, sf_dir)))).select("app_id", "key", "default", "value", "differs")


@query(f"WITH {_ENV_SQL} SELECT app_id, 'app-core' AS artifact, '1.' || (n % 4) AS version FROM a UNION ALL SELECT app_id, 'tool_2.13', '0.9' FROM a")
def log_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.components(X.settings(L.environment_lines(L.order_rows(spark, sf_dir)))).select("app_id", "artifact", "version")


@query(
    f"""WITH {JOBS_SQL} SELECT app_id, CAST(job_id AS BIGINT) AS execution_id, n.node, n.parent, n.depth, CASE n.node WHEN 0 THEN 'WholeStageCodegen (1)' WHEN 1 THEN 'Filter' WHEN 3 THEN 'Filter' ELSE 'Scan parquet db.t' || (job_id % 5) END AS name
    FROM j, (VALUES (0, -1, 0), (1, 0, 1), (2, 1, 2), (3, 0, 1), (4, 3, 2)) n(node, parent, depth)"""
)
def log_plan_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = L.plan_lines(L.order_rows(spark, sf_dir))
    plans = S.latest_plans(X.sql_starts(lines), X.sql_adaptive(lines))
    return S.plan_nodes(plans.drop("plan_text")).select("app_id", "execution_id", "node", "parent", "depth", "name")


@query(f"WITH {JOBS_SQL} SELECT DISTINCT app_id, CAST(job_id AS BIGINT) AS execution_id, 'read' AS access, 'table' AS kind, 'db.t' || (job_id % 5) AS name, 'parquet' AS format FROM j")
def log_plan_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = L.plan_lines(L.order_rows(spark, sf_dir))
    plans = S.latest_plans(X.sql_starts(lines), X.sql_adaptive(lines))
    return P.plan_data_refs(S.plan_nodes(plans.drop("plan_text")), plans).select("app_id", "execution_id", "access", "kind", "name", "format")


@query(f"WITH {JOBS_SQL} SELECT app_id, CAST(job_id AS BIGINT) AS execution_id, completed AS t, CASE WHEN s = 'P' THEN 'no such table' END AS error FROM j WHERE completed IS NOT NULL")
def log_sql_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.sql_ends(L.plan_lines(L.order_rows(spark, sf_dir))).select("app_id", "execution_id", "t", "error")


@query(f"WITH {JOBS_SQL}, l AS (SELECT app_id, job_id * 100 AS line, s, unnest(['JobStart', 'StageSubmitted', 'StageCompleted', 'JobEnd']) AS e, unnest([0, 1, 98, 99]) AS k FROM j) SELECT app_id, 'SparkListener' || e AS event, count(*) AS n, min(CAST(line + k AS BIGINT)) AS first_line FROM l WHERE s <> 'O' OR k < 98 GROUP BY 1, 2")
def log_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.event_counts(L.job_lines(L.order_rows(spark, sf_dir))).drop("attempt")


_DRIVER_SQL = f"""{TASKS_SQL}, r AS (SELECT app_id AS app, task_id * 10 AS line, 'task-start' AS event, stage_id, task_id, ln, host, executor_id, NULL AS ms, ['PROCESS_LOCAL', 'NODE_LOCAL', 'ANY'][x % 3 + 1] AS locality, launched AS t FROM t
    UNION ALL SELECT app_id, task_id * 10 + 5, CASE WHEN d = 10 THEN 'task-lost' ELSE 'task-end' END, stage_id, task_id, ln, CASE WHEN d < 10 THEN host END, CASE WHEN d < 10 THEN executor_id END, CASE WHEN d < 10 THEN p END, NULL, (launched + p) // 1000 * 1000 FROM t)"""


@query(f"WITH {_DRIVER_SQL} SELECT app, line, event, CAST(stage_id AS BIGINT) AS stage, task_id AS task, CAST(ln - 1 AS BIGINT) AS \"index\", host, executor_id AS executor, ms, locality, t FROM r")
def log_driver_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = G.driver_events(G.parse_header(L.log_lines(L.item_rows(spark, sf_dir), "driver")))
    return out.select("app", "line", "event", "stage", "task", "index", "host", "executor", "ms", "locality", F.unix_millis("t").alias("t"))


@query(f"WITH {TASKS_SQL} SELECT app_id AS app, task_id AS task, CAST(stage_id AS BIGINT) AS stage_id, launched, CASE WHEN d < 10 THEN p END AS duration_ms, executor_id, host, CASE WHEN d = 10 THEN 'failed' ELSE 'succeeded' END AS status FROM t")
def log_rebuilt_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = G.rebuilt_tasks(G.driver_events(G.parse_header(L.log_lines(L.item_rows(spark, sf_dir), "driver"))))
    return out.select("app", "task", "stage_id", F.unix_millis("launched").alias("launched"), "duration_ms", "executor_id", "host", "status")


_STEPS_SQL = f"""{TASKS_SQL}, l AS (SELECT app_id AS app, executor_id AS executor, task_id * 10 AS line, 'start' AS step, 1 AS sign, task_id, CAST(NULL AS BIGINT) AS bytes, NULL AS name, CAST(stage_id AS BIGINT) AS stage, launched AS t FROM t
    UNION ALL SELECT app_id, executor_id, task_id * 10 + 1, 'stored', 0, NULL, q * 1024, 'broadcast_' || (task_id % 9), NULL, launched FROM t
    UNION ALL SELECT app_id, executor_id, task_id * 10 + CASE WHEN x < 3 THEN 302 ELSE 2 END, 'finish', -1, task_id, p, NULL, CAST(stage_id AS BIGINT), (launched + p) // 1000 * 1000 FROM t),
    o AS (SELECT *, sum(sign) OVER w AS n, sum(sign * coalesce(task_id, 0)) OVER w AS s FROM l WINDOW w AS (PARTITION BY app, executor ORDER BY line ROWS UNBOUNDED PRECEDING)),
    steps AS (SELECT app, executor, line, coalesce(task_id, CASE WHEN n = 1 THEN CAST(s AS BIGINT) END) AS task_id, step, bytes, name, stage, t FROM o)"""


@query(f"WITH {_STEPS_SQL} SELECT app, executor, line, task_id, step, bytes, name, stage, t FROM steps")
def log_task_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = G.task_steps(G.parse_header(L.log_lines(L.item_rows(spark, sf_dir), "executor")))
    return out.select("app", "executor", "line", "task_id", "step", "bytes", "name", "stage", F.unix_millis("t").alias("t"))


@query(
    f"""WITH {_STEPS_SQL} SELECT app, executor, task_id, min(t) FILTER (step = 'start') AS started, max(t) FILTER (step = 'finish') AS ended, max(stage) AS stage, CAST(sum(bytes) FILTER (step = 'finish') AS BIGINT) AS finish_bytes,
    CAST(sum(bytes) FILTER (step = 'stored') AS BIGINT) AS stored_bytes, count(*) AS steps FROM steps WHERE task_id IS NOT NULL GROUP BY ALL"""
)
def log_task_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = G.task_stories(G.task_steps(G.parse_header(L.log_lines(L.item_rows(spark, sf_dir), "executor"))))
    return out.select("app", "executor", "task_id", F.unix_millis("started").alias("started"), F.unix_millis("ended").alias("ended"), "stage", "finish_bytes", "stored_bytes", "steps")


@query(f"WITH {_STEPS_SQL} SELECT '/logs/' || app || '/' || executor AS file, min(t) AS first, max(t) AS last, count(*) AS lines FROM steps GROUP BY 1")
def log_file_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = G.file_times(G.parse_header(L.log_lines(L.item_rows(spark, sf_dir), "executor")))
    return out.select("file", F.unix_millis("first").alias("first"), F.unix_millis("last").alias("last"), "lines")


_RULES_SQL = f"""{_EXEC_SQL}, w AS (SELECT app_id, stage_id, {_SUMS}, CAST(sum(pk * 10) AS BIGINT) AS input_bytes, CAST(sum(p) AS BIGINT) AS duration_ms, count(*) FILTER (x % 4 >= 2) AS far FROM t WHERE ln % 3 > 0 GROUP BY 1, 2),
    g AS (SELECT app_id, sum(run_ms) AS run_ms, sum(disk_spill) AS spill, sum(shuffle_write_bytes) AS wrote, sum(speculative) AS spec, sum(scheduler_delay_ms) AS delay, sum(duration_ms) AS took FROM w GROUP BY 1),
    late AS (SELECT DISTINCT app_id, task_id FROM t WHERE ln % 3 > 0),
    f AS (SELECT j.app_id, 'job-failed' AS rule, CASE WHEN apps.state = 'failed' THEN 'critical' ELSE 'warning' END AS severity FROM j JOIN apps USING (app_id) WHERE s = 'P' QUALIFY row_number() OVER (PARTITION BY j.app_id ORDER BY job_id) <= 5
    UNION ALL SELECT DISTINCT app_id, 'large-results', 'warning' FROM w WHERE duration_ms * 10 >= 536870912
    UNION ALL SELECT app_id, 'memory-spill', 'warning' FROM g WHERE spill > 0 AND (wrote = 0 OR spill > 0.1 * wrote)
    UNION ALL SELECT app_id, 'speculation', 'info' FROM g WHERE spec > 0
    UNION ALL SELECT app_id, 'scheduler-delay', 'warning' FROM g WHERE run_ms >= 60000 AND delay > 0.2 * took
    UNION ALL SELECT app_id, 'poor-locality', 'info' FROM w WHERE input_bytes > 0 AND tasks >= 5 AND far > 0.3 * tasks
    UNION ALL SELECT app_id, 'tasks-running-at-end', 'warning' FROM (SELECT DISTINCT t.app_id FROM t ANTI JOIN late USING (app_id, task_id))
    UNION ALL SELECT app_id, 'slow-executor-startup', 'info' FROM (SELECT DISTINCT app_id FROM ex WHERE startup_ms > 60000)
    UNION ALL SELECT app_id, CASE kind WHEN 'decommissioned' THEN 'executor-decommissioned' ELSE 'executor-' || kind END, CASE kind WHEN 'memory-kill' THEN 'critical' ELSE 'warning' END FROM (SELECT DISTINCT app_id, kind FROM ex WHERE kind IN ('memory-kill', 'lost', 'decommissioned'))
    UNION ALL SELECT DISTINCT app_id, 'executors-excluded', 'info' FROM (SELECT DISTINCT app_id, executor_id, launched, stage_id FROM t WHERE d >= 9)
    UNION ALL SELECT app_id, 'config-aqe-off', 'info' FROM a0 WHERE n % 2 = 1 UNION ALL SELECT app_id, 'access-static-keys', 'warning' FROM a0)"""


@query(
    f"""WITH a0 AS (SELECT 'app-1-' || o_custkey AS app_id, count(*) AS n FROM orders GROUP BY 1), {_RULES_SQL}
    SELECT DISTINCT app_id, rule, severity FROM f"""
)
def log_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines stored once by event, as a fleet's logs are, and the tables behind the rules computed from these."""
    items, orders = L.item_rows(spark, sf_dir), L.order_rows(spark, sf_dir)
    lines = L.task_end_lines(items.filter("ln % 3 > 0"))
    for x in (L.task_start_lines(items), L.job_lines(orders), L.app_lines(orders), L.executor_lines(items), L.exclusion_lines(items), L.environment_lines(orders)):
        lines = lines.unionByName(x)
    tables = gold_tables(lines, store=f"{shared_dir(spark)}/events-{uuid.uuid4().hex}", only=("jobs", "applications", "stage_totals", "executors", "exclusions", "running_tasks", "settings"))
    return tables["findings"].select("app_id", "rule", "severity").distinct()


@query(
    f"""WITH {_ENV_SQL} SELECT app_id, (n % 3 + 1) * 1073741824 AS heap, greatest(402653184, CAST(floor(0.1::DOUBLE * ((n % 3 + 1) * 1073741824)) AS BIGINT)) AS overhead, (n % 3 + 1) * 1073741824 + greatest(402653184, CAST(floor(0.1::DOUBLE * ((n % 3 + 1) * 1073741824)) AS BIGINT)) AS container,
    CAST(floor(((n % 3 + 1) * 1073741824 - 314572800) * 0.6::DOUBLE) AS BIGINT) AS unified FROM a"""
)
def log_memory_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.memory_config(X.settings(L.environment_lines(L.order_rows(spark, sf_dir)))).select("app_id", "heap", "overhead", "container", "unified")


@query(
    f"""WITH {TASKS_SQL}, {_ENV_SQL}, e AS (SELECT app_id, executor_id, max(p * 1000) AS peak_heap, sum(q * 9) AS gc, sum(p // 2) AS run FROM t GROUP BY ALL)
    SELECT e.app_id, executor_id, peak_heap, (n % 3 + 1) * 1073741824 AS heap, CASE WHEN peak_heap > 0 THEN round(peak_heap / ((n % 3 + 1) * 1073741824), 9) END AS heap_share, CASE WHEN run > 0 THEN round(gc / run, 6) ELSE 0 END AS gc_share FROM e LEFT JOIN a USING (app_id)"""
)
def log_memory_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    peaks = S.executor_peaks(X.peak_samples(L.task_end_lines(L.item_rows(spark, sf_dir))))
    config = M.memory_config(X.settings(L.environment_lines(L.order_rows(spark, sf_dir))))
    out = M.memory_use(peaks, S.executor_totals(_tasks(spark, sf_dir)), config)
    return out.select("app_id", "executor_id", "peak_heap", "heap", F.round("heap_share", 9).alias("heap_share"), F.round("gc_share", 6).alias("gc_share"))


@query(
    f"""WITH {TASKS_SQL}, w AS (SELECT app_id, stage_id, CAST(sum(q * 7) AS BIGINT) AS mem_spill, CAST(sum(CASE WHEN d > 6 THEN q * 1000 ELSE 0 END) AS BIGINT) AS disk_spill, CAST(sum(p * 3) AS BIGINT) AS shuffle_write_bytes FROM t GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY disk_spill DESC, stage_id) AS place FROM w WHERE mem_spill > 0 OR disk_spill > 0"""
)
def log_stage_spill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.stage_spill(S.stage_totals(_tasks(spark, sf_dir, "stage_id", "stage_attempt", "mem_spill", "disk_spill", "shuffle_write_bytes"))).drop("attempt", "stage_attempt")


@query(
    f"""WITH {_EXEC_SQL}, c AS (SELECT app_id, cores, row_number() OVER (PARTITION BY app_id ORDER BY count(*) DESC, cores DESC) AS r FROM ex GROUP BY app_id, cores)
    SELECT app_id, count(*) AS started, count(*) FILTER (kind = 'memory-kill') AS memory_kill, count(*) FILTER (kind = 'lost') AS lost, count(*) FILTER (kind = 'idle') AS idle, any_value(c.cores) AS cores FROM ex JOIN c USING (app_id) WHERE r = 1 GROUP BY app_id"""
)
def log_exec_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.exec_summary(_executors(spark, sf_dir)).select("app_id", "started", "memory_kill", "lost", "idle", "cores")


@query(f"WITH {TASKS_SQL} SELECT app_id, host, count(*) AS tasks, count(*) FILTER (status = 'failed') AS failed, count(DISTINCT executor_id) AS executors, CAST(sum(p) AS BIGINT) AS duration_ms, CAST(sum(pk * 10) AS BIGINT) AS input_bytes FROM t GROUP BY ALL")
def log_host_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.host_totals(_tasks(spark, sf_dir)).select("app_id", "host", "tasks", "failed", "executors", "duration_ms", "input_bytes")


@query(f"WITH {TASKS_SQL} SELECT app_id, CAST(sum(pk * 10) AS BIGINT) AS input_bytes, CAST(sum(q) AS BIGINT) AS input_records, CAST(sum(p * 2) AS BIGINT) AS shuffle_remote_bytes, CAST(sum(q) AS BIGINT) AS shuffle_write_records FROM t GROUP BY ALL")
def log_io_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.io_totals(S.stage_totals(_tasks(spark, sf_dir))).select("app_id", "input_bytes", "input_records", "shuffle_remote_bytes", "shuffle_write_records")


@query(
    f"""WITH {TASKS_SQL}, e AS (SELECT app_id, stage_id, executor_id, CAST(sum(p) AS BIGINT) AS v FROM t GROUP BY ALL), m AS (SELECT app_id, stage_id, quantile_cont(v, 0.5) AS middle FROM e GROUP BY ALL)
    SELECT app_id, stage_id, executor_id, v, middle, CASE WHEN middle > 0 THEN round(v / middle, 6) END AS times FROM e JOIN m USING (app_id, stage_id)"""
)
def log_executor_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.executor_heat(S.stage_executor(_tasks(spark, sf_dir)), "duration_ms").select("app_id", "stage_id", "executor_id", "v", "middle", F.round("times", 6).alias("times"))


@query(
    f"""WITH {TASKS_SQL}, {_APPS_SQL}, bb AS (SELECT t.app_id, greatest(0, launched - started) AS a, greatest(0, launched + p - started) AS z FROM t JOIN apps USING (app_id)), k AS (SELECT app_id, a // 3600000 AS bucket FROM bb UNION SELECT app_id, z // 3600000 FROM bb)
    SELECT app_id, bucket, CAST(sum(greatest(0, least(z, 3600000 * (bucket + 1)) - greatest(a, 3600000 * bucket))) AS BIGINT) AS busy, count(*) FILTER (a < 3600000 * (bucket + 1) AND z >= 3600000 * (bucket + 1)) AS running FROM k JOIN bb USING (app_id) GROUP BY ALL"""
)
def log_tasks_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.tasks_over_time(_tasks(spark, sf_dir, "launched", "finished"), _apps(spark, sf_dir), 3_600_000).drop("attempt")


@query(
    f"""WITH {_EXEC_SQL}, e AS (SELECT app_id, launched + p AS t, 'task-failed' AS kind, stage_id FROM t WHERE status = 'failed' UNION ALL SELECT app_id, added, 'executor-added', NULL FROM ex UNION ALL SELECT app_id, removed, 'executor-' || kind, NULL FROM ex WHERE removed IS NOT NULL)
    SELECT app_id, t // 1000 AS second, kind, stage_id, count(*) AS n FROM e GROUP BY ALL"""
)
def log_run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.run_events(_tasks(spark, sf_dir), _executors(spark, sf_dir)).drop("attempt")


@query(f"WITH {JOBS_SQL} SELECT app_id, 'read' AS access, 'db.t' || (job_id % 5) AS name, count(*) AS times, row_number() OVER (PARTITION BY app_id ORDER BY 'db.t' || (job_id % 5)) AS place FROM j GROUP BY app_id, job_id % 5")
def log_data_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = L.plan_lines(L.order_rows(spark, sf_dir))
    plans = S.latest_plans(X.sql_starts(lines), X.sql_adaptive(lines))
    return U.data_refs(P.plan_data_refs(S.plan_nodes(plans.drop("plan_text")), plans)).select("app_id", "access", "name", "times", "place")


@query(
    f"""WITH {TASKS_SQL}, {JOBS_SQL}, w AS (SELECT app_id, stage_id, sum(CASE WHEN d > 6 THEN q ELSE 0 END) AS spill, count(*) FILTER (status = 'failed') AS failed FROM t GROUP BY ALL),
    g AS (SELECT j.app_id, job_id AS stage_id, completed - submitted AS wall_ms, CAST(CASE WHEN s = 'P' THEN 0 WHEN coalesce(spill, 0) > 0 OR coalesce(failed, 0) > 0 THEN 2 ELSE 3 END AS INTEGER) AS "group" FROM j LEFT JOIN w ON w.app_id = j.app_id AND w.stage_id = j.job_id)
    SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY "group", wall_ms DESC NULLS LAST, stage_id) AS place FROM g"""
)
def log_worth_a_look(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = S.stage_totals(_tasks(spark, sf_dir))
    lines, _ = _jobs(spark, sf_dir)
    stages = S.stages(X.stage_events(lines), totals, X.app_ends(L.app_lines(L.order_rows(spark, sf_dir))))
    return U.worth_a_look(stages, totals).select("app_id", "stage_id", "wall_ms", "group", "place")


@query(
    f"""WITH {TASKS_SQL}, {JOBS_SQL}, w AS (SELECT app_id, stage_id, CAST(sum(pk * 10 + p * 6) AS BIGINT) AS moved, CAST(sum(CASE WHEN d > 6 THEN q * 1000 ELSE 0 END) AS BIGINT) AS spill FROM t GROUP BY ALL),
    o AS (SELECT app_id, stage_id, max(p) - quantile_disc(p, 0.5) AS over FROM t WHERE status = 'succeeded' GROUP BY ALL HAVING count(*) >= 3), h AS (SELECT app_id, host, CAST(sum(p) AS BIGINT) AS took FROM t GROUP BY ALL),
    n AS (SELECT app_id, 'mover' AS note, 'stage ' || stage_id || '.0' AS what, moved AS value FROM w UNION ALL SELECT app_id, 'spill', 'stage ' || stage_id || '.0', spill FROM w UNION ALL SELECT app_id, 'straggler', 'stage ' || stage_id || '.0', over FROM o WHERE over >= 1000
    UNION ALL SELECT app_id, 'busiest-host', host, took FROM h UNION ALL SELECT app_id, 'longest-stage', 'stage ' || job_id || '.0', completed - submitted FROM j WHERE completed IS NOT NULL) SELECT app_id, note, what, value FROM n WHERE value > 0 QUALIFY row_number() OVER (PARTITION BY app_id, note ORDER BY value DESC, what) = 1"""
)
def log_run_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = _tasks(spark, sf_dir)
    lines, _ = _jobs(spark, sf_dir)
    totals = S.stage_totals(tasks)
    stages = S.stages(X.stage_events(lines), totals, X.app_ends(L.app_lines(L.order_rows(spark, sf_dir))))
    return U.run_notes(stages, totals, S.stage_dist(tasks), U.host_totals(tasks)).select("app_id", "note", "what", "value")
