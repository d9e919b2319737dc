"""Threshold rules over the gold tables: each gives findings of one shape, and all are joined, edited and put in order at the end.

A rule is a filter on one or two tables of stages, executors, jobs or applications: nothing here sees single tasks. A table that is
missing, or a value that is null, gives no finding: what wasn't measured isn't zero.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import share, size_to_bytes
from ..operators.extract import KEY

Tables = Mapping[str, DataFrame]


@dataclass(frozen=True)
class Thresholds:
    """When a rule fires. Times in ms, shares from 0 to 1."""

    skew_ratio: float = 5.0
    skew_min_tasks: int = 5
    skew_min_ms: int = 1000
    gap_share: float = 0.25
    gap_min_ms: int = 60_000
    run_min_ms: int = 60_000
    heap_low: float = 0.4
    heap_high: float = 0.9
    gc_share: float = 0.1
    spill_share: float = 0.1
    cpu_share: float = 0.3
    delay_share: float = 0.2
    far_share: float = 0.3
    result_share: float = 0.5
    startup_ms: int = 60_000
    retries_named: int = 5


def finding(df: DataFrame, rule: str, severity: Column | str, section: str, evidence: Column, **args: Column) -> DataFrame:
    """app_id, attempt, rule, severity, section, args and evidence of each row."""
    level = F.lit(severity) if isinstance(severity, str) else severity
    pairs = [x for k, v in args.items() for x in (F.lit(k), v.cast("string"))]
    told = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return df.select(*KEY, F.lit(rule).alias("rule"), level.alias("severity"), F.lit(section).alias("section"), told.alias("args"), F.array(evidence).cast("array<struct<file:string,line:bigint,text:string>>").alias("evidence"))


def _at(text: Column, file: Column | None = None, line: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct((none.cast("string") if file is None else file).alias("file"), (none.cast("bigint") if line is None else line).alias("line"), text.cast("string").alias("text"))


def _top(df: DataFrame, order: Column, k: int) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*KEY).orderBy(order))).filter(F.col("__r") <= k).drop("__r")


def _per_app(df: DataFrame) -> DataFrame:
    return df.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))


def job_failed(t: Tables, x: Thresholds) -> DataFrame:
    """Jobs that failed; critical if the application did as well."""
    rows = t["jobs"].filter("failed").join(t["applications"].select(*KEY, (F.col("state") == "failed").alias("app_failed")), list(KEY), "left")
    level = F.when(F.col("app_failed"), "critical").otherwise("warning")
    return finding(_top(rows, F.asc("job_id"), 5), "job-failed", level, "jobs", _at(F.col("error"), F.col("file"), F.col("line")), job=F.col("job_id"), name=F.col("name"))


def stage_retried(t: Tables, x: Thresholds) -> DataFrame:
    return finding(t["stages"].filter("stage_attempt > 0"), "stage-retried", "warning", "stages", _at(F.col("failure")), stage=F.col("stage_id"), attempt_no=F.col("stage_attempt"))


def task_retries(t: Tables, x: Thresholds) -> DataFrame:
    rows = t["stage_totals"].filter("failed > 0").join(t["stages"].filter("state = 'complete'").select(*KEY, "stage_id", "stage_attempt", "name"), [*KEY, "stage_id", "stage_attempt"])
    return finding(rows, "task-retries", "info", "stages", _at(F.col("name")), stage=F.col("stage_id"), failed=F.col("failed"))


def stage_skew(t: Tables, x: Thresholds) -> DataFrame:
    """The slowest task took over skew_ratio times the median and read that much more rows or bytes as well."""
    d, s = F.col("duration_ms"), F.col("slowest")
    more = (s["moved_bytes"] > x.skew_ratio * F.col("moved_bytes.p50")) & (F.col("moved_bytes.p50") > 0) | (s["moved_rows"] > x.skew_ratio * F.col("moved_rows.p50")) & (F.col("moved_rows.p50") > 0)
    rows = t["stage_dist"].filter((F.col("n") >= x.skew_min_tasks) & (d["hi"] >= x.skew_min_ms) & (d["p50"] > 0) & (d["hi"] > x.skew_ratio * d["p50"]) & more)
    rows = rows.join(t["stages"].select(*KEY, "stage_id", "stage_attempt", "wall_ms", "name"), [*KEY, "stage_id", "stage_attempt"], "left")
    level = F.when(2 * d["hi"] < F.col("wall_ms"), "info").otherwise("warning")
    return finding(_top(rows, F.desc(d["hi"] - d["p50"]), 5), "stage-skew", level, "stages", _at(F.col("name"), s["file"], s["line"]), stage=F.col("stage_id"), task=s["task_id"], slowest_ms=d["hi"], median_ms=d["p50"])


def driver_gaps(t: Tables, x: Thresholds) -> DataFrame:
    idle = t["driver_gaps"].groupBy(*KEY).agg(F.sum(F.col("gap_end") - F.col("gap_start")).alias("idle"), F.max(F.col("gap_end") - F.col("gap_start")).alias("longest"))
    rows = idle.join(t["applications"].select(*KEY, "duration_ms"), list(KEY)).filter((F.col("idle") >= x.gap_min_ms) & (F.col("idle") > x.gap_share * F.col("duration_ms")))
    return finding(rows, "driver-gaps", "warning", "timeline", _at(F.lit("no job ran")), idle_ms=F.col("idle"), longest_ms=F.col("longest"))


def _ran(t: Tables, x: Thresholds) -> DataFrame:
    """Totals per application whose tasks ran for long enough to judge."""
    sums = t["stage_totals"].groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in ("run_ms", "cpu_ns", "gc_ms", "duration_ms", "scheduler_delay_ms", "disk_spill", "shuffle_write_bytes", "speculative")])
    return sums.filter(F.col("run_ms") >= x.run_min_ms)


def memory_gc(t: Tables, x: Thresholds) -> DataFrame:
    rows = t["executor_totals"].filter((F.col("run_ms") >= x.run_min_ms) & (F.col("gc_ms") > x.gc_share * F.col("run_ms")))
    return finding(_top(rows, F.desc("gc_ms"), 5), "memory-gc-pressure", "warning", "memory", _at(F.col("host")), executor=F.col("executor_id"), gc_ms=F.col("gc_ms"), run_ms=F.col("run_ms"))


def memory_heap(t: Tables, x: Thresholds) -> DataFrame:
    """Peak heap against what executors may have, by the setting; both ends."""
    heap = t["settings"].filter("section = 'spark' and key = 'spark.executor.memory'").select(*KEY, size_to_bytes(F.col("value"), "m").alias("may"))
    used = t["executor_peaks"].filter("executor_id <> 'driver'").groupBy(*KEY).agg(F.max("JVMHeapMemory").alias("peak"), F.max_by("src", "JVMHeapMemory").alias("src"))
    rows = used.join(heap.filter("may > 0"), list(KEY)).join(_ran(t, x).select(*KEY), list(KEY)).withColumn("part", share(F.col("peak"), F.col("may"))).filter("peak > 0")
    at = _at(F.lit("peak heap"), F.col("src.file"), F.col("src.line"))
    low = finding(rows.filter(F.col("part") < x.heap_low), "memory-over-provisioned", "info", "memory", at, peak=F.col("peak"), may=F.col("may"))
    return low.unionByName(finding(rows.filter(F.col("part") > x.heap_high), "memory-heap-near-limit", "warning", "memory", at, peak=F.col("peak"), may=F.col("may")))


def memory_spill(t: Tables, x: Thresholds) -> DataFrame:
    rows = t["stage_totals"].groupBy(*KEY).agg(F.sum("disk_spill").alias("spill"), F.sum("shuffle_write_bytes").alias("wrote"))
    rows = rows.filter((F.col("spill") > 0) & ((F.col("wrote") == 0) | (F.col("spill") > x.spill_share * F.col("wrote"))))
    return finding(rows, "memory-spill", "warning", "memory", _at(F.lit("spilled to disk")), spill=F.col("spill"), wrote=F.col("wrote"))


def cpu(t: Tables, x: Thresholds) -> DataFrame:
    rows = t["cpu_use"].filter(F.col("run_ms") >= x.run_min_ms)
    low = finding(rows.filter(F.col("cpu_share") < x.cpu_share), "cpu-low", "info", "cpu", _at(F.lit("CPU share of task time")), cpu_share=F.col("cpu_share"))
    idle = rows.filter((F.col("core_ms") > 0) & (F.col("busy_share") < x.cpu_share))
    return low.unionByName(finding(idle, "cpu-idle-executors", "info", "cpu", _at(F.lit("share of core time that tasks used")), busy_share=F.col("busy_share")))


def scheduler_delay(t: Tables, x: Thresholds) -> DataFrame:
    rows = _ran(t, x).filter(F.col("scheduler_delay_ms") > x.delay_share * F.col("duration_ms"))
    return finding(rows, "scheduler-delay", "warning", "stages", _at(F.lit("time before and after tasks")), delay_ms=F.col("scheduler_delay_ms"), task_ms=F.col("duration_ms"))


def poor_locality(t: Tables, x: Thresholds) -> DataFrame:
    far = F.col("rack_local") + F.col("any")
    rows = t["stage_totals"].filter((F.col("input_bytes") > 0) & (F.col("tasks") >= 5) & (far > x.far_share * F.col("tasks")))
    return finding(rows, "poor-locality", "info", "stages", _at(F.lit("tasks far from their data")), stage=F.col("stage_id"), far=far, tasks=F.col("tasks"))


def large_results(t: Tables, x: Thresholds) -> DataFrame:
    most = t["settings"].filter("section = 'spark' and key = 'spark.driver.maxResultSize'").select(*KEY, size_to_bytes(F.col("value")).alias("set"))
    rows = t["stage_totals"].join(most, list(KEY), "left").withColumn("most", F.coalesce("set", F.lit(1 << 30))).filter((F.col("most") > 0) & (F.col("result_bytes") >= x.result_share * F.col("most")))
    return finding(rows, "large-results", "warning", "stages", _at(F.lit("results sent to the driver")), stage=F.col("stage_id"), result_bytes=F.col("result_bytes"), most=F.col("most"))


def slow_startup(t: Tables, x: Thresholds) -> DataFrame:
    rows = _top(t["executors"].filter(F.col("startup_ms") > x.startup_ms), F.desc("startup_ms"), 1)
    return finding(rows, "slow-executor-startup", "info", "executors", _at(F.col("host")), executor=F.col("executor_id"), startup_ms=F.col("startup_ms"))


def speculation(t: Tables, x: Thresholds) -> DataFrame:
    rows = t["stage_totals"].groupBy(*KEY).agg(F.sum("speculative").alias("n")).filter("n > 0")
    return finding(rows, "speculation", "info", "stages", _at(F.lit("tasks run twice")), tasks=F.col("n"))


def still_running(t: Tables, x: Thresholds) -> DataFrame:
    first = t["running_tasks"].groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("part", "file", "line")).alias("src"))
    return finding(first, "tasks-running-at-end", "warning", "stages", _at(F.lit("started, never ended"), F.col("src.file"), F.col("src.line")), tasks=F.col("n"))


def excluded(t: Tables, x: Thresholds) -> DataFrame:
    level = F.when(F.col("scope").endswith("-stage"), "info").otherwise("warning")
    rows = t["exclusions"].filter("not lift")
    return finding(rows, "executors-excluded", level, "executors", _at(F.col("scope"), F.col("src.file"), F.col("src.line")), target=F.col("target"), scope=F.col("scope"))


_REMOVED = {"memory-kill": ("executor-memory-kill", "critical"), "lost": ("executor-lost", "warning"), "decommissioned": ("executor-decommissioned", "warning")}


def executors_removed(t: Tables, x: Thresholds) -> DataFrame:
    """One finding per kind of removal, with how many executors went that way and the first's reason."""
    kinds = t["executors"].filter(F.col("kind").isin(*_REMOVED)).groupBy(*KEY, "kind").agg(F.count(F.lit(1)).alias("n"), F.min_by("reason", "removed").alias("reason"))
    out = None
    for kind, (rule, level) in _REMOVED.items():
        one = finding(kinds.filter(F.col("kind") == kind), rule, level, "executors", _at(F.col("reason")), executors=F.col("n"))
        out = one if out is None else out.unionByName(one)
    return out


def config(t: Tables, x: Thresholds) -> DataFrame:
    """Settings that are known to hurt."""
    s = t["settings"].filter("section = 'spark'").groupBy(*KEY).pivot("key", ["spark.driver.maxResultSize", "spark.dynamicAllocation.enabled", "spark.shuffle.service.enabled", "spark.dynamicAllocation.shuffleTracking.enabled", "spark.sql.adaptive.enabled"]).agg(F.first("value"))
    get = lambda k: F.lower(F.col(f"`{k}`"))
    off = lambda k: F.coalesce(get(k), F.lit("false")) == "false"
    unlimited = finding(s.filter(size_to_bytes(get("spark.driver.maxResultSize")) == 0), "config-unlimited-result", "warning", "settings", _at(F.lit("spark.driver.maxResultSize")))
    shuffle = s.filter((get("spark.dynamicAllocation.enabled") == "true") & off("spark.shuffle.service.enabled") & (get("spark.dynamicAllocation.shuffleTracking.enabled") == "false"))
    lost = finding(shuffle, "config-dynalloc-no-shuffle", "warning", "settings", _at(F.lit("spark.dynamicAllocation.enabled")))
    flat = finding(s.filter(get("spark.sql.adaptive.enabled") == "false"), "config-aqe-off", "info", "settings", _at(F.lit("spark.sql.adaptive.enabled")))
    return unlimited.unionByName(lost).unionByName(flat)


def static_keys(t: Tables, x: Thresholds) -> DataFrame:
    rows = t["settings"].filter(F.col("redacted") & F.lower("key").rlike(r"(access\.key|secret\.key|session\.token)$"))
    return finding(_top(rows, F.asc("key"), 1), "access-static-keys", "warning", "settings", _at(F.col("key"), F.col("file"), F.col("line")), key=F.col("key"))


#: Each rule, the tables that it needs, and where its findings stand among those of one severity.
RULES: dict[Callable[[Tables, Thresholds], DataFrame], tuple[str, ...]] = {
    job_failed: ("jobs", "applications"),
    executors_removed: ("executors",),
    stage_retried: ("stages",),
    stage_skew: ("stage_dist", "stages"),
    driver_gaps: ("driver_gaps", "applications"),
    memory_gc: ("executor_totals",),
    memory_heap: ("settings", "executor_peaks", "stage_totals"),
    memory_spill: ("stage_totals",),
    scheduler_delay: ("stage_totals",),
    large_results: ("settings", "stage_totals"),
    still_running: ("running_tasks",),
    excluded: ("exclusions",),
    config: ("settings",),
    static_keys: ("settings",),
    task_retries: ("stage_totals", "stages"),
    cpu: ("cpu_use",),
    poor_locality: ("stage_totals",),
    slow_startup: ("executors",),
    speculation: ("stage_totals",),
}


def findings(tables: Tables, thresholds: Thresholds | None = None) -> DataFrame | None:
    """All findings of the rules whose tables are there, with rank from 1 per application: by severity, then by rule."""
    x = thresholds or Thresholds()
    out = None
    for i, (rule, needs) in enumerate(RULES.items()):
        if all(n in tables for n in needs):
            one = rule(tables, x).withColumn("place", F.lit(i))
            out = one if out is None else out.unionByName(one)
    if out is None:
        return None
    level = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    rank = F.row_number().over(W.partitionBy(*KEY).orderBy(level, "place", F.to_json("args"))).cast("long")
    return out.withColumn("rank", rank).drop("place")
