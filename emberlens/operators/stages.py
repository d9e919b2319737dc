"""Totals, distributions and states of stages, jobs, executors and applications, from typed event tables.

Sums are taken per application first of all, so they are combined in tasks before any shuffle; no function collects an application's tasks.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import block_kind, call_site, share, short_error
from . import distributions as D
from . import intervals as I
from .extract import COUNTERS, GAUGES, KEY

STAGE = (*KEY, "stage_id", "stage_attempt")
_SUMS = [c for c in COUNTERS if c != "peak_exec_mem"] + ["duration_ms", "scheduler_delay_ms", "getting_ms"]


def _totals(tasks: DataFrame) -> list[Column]:
    """Counts, and sums of the columns that tasks has."""
    has = set(tasks.columns)
    status = [F.count_if(F.col("status") == s).alias(s) for s in ("succeeded", "failed", "killed") if "status" in has]
    near = [F.count_if(F.col("locality") == x).alias(x.lower()) for x in ("PROCESS_LOCAL", "NODE_LOCAL", "RACK_LOCAL", "ANY", "NO_PREF") if "locality" in has]
    twice = [F.count_if(F.col("speculative")).alias("speculative")] if "speculative" in has else []
    most = [F.max("peak_exec_mem").alias("peak_exec_mem")] if "peak_exec_mem" in has else []
    return [F.count(F.lit(1)).alias("tasks"), *status, *twice, *near, *[F.sum(c).alias(c) for c in _SUMS if c in has], *most]


#: What totals of stages are made of.
TOTALLED = ("stage_id", "stage_attempt", "status", "locality", "speculative", *_SUMS, "peak_exec_mem")


def stage_totals(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy(*STAGE).agg(*_totals(tasks))


def executor_totals(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy(*KEY, "executor_id").agg(*_totals(tasks), F.max("host").alias("host"))


def stage_executor(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy(*STAGE, "executor_id").agg(*_totals(tasks))


def executor_peaks(samples: DataFrame) -> DataFrame:
    """Highest value of each gauge per executor, and the line of the highest heap."""
    return samples.groupBy(*KEY, "executor_id").agg(*[F.max(f"gauges.{g}").alias(g) for g in GAUGES], F.max_by(F.struct("file", "line"), F.col("gauges.JVMHeapMemory")).alias("src"))


def _succeeded(tasks: DataFrame) -> DataFrame:
    moved = F.col("input_bytes") + F.col("shuffle_remote_bytes") + F.col("shuffle_local_bytes")
    rows = F.col("input_records") + F.col("shuffle_read_records")
    return tasks.filter("status = 'succeeded'").withColumns({"moved_bytes": moved, "moved_rows": rows})


def stage_dist(tasks: DataFrame) -> DataFrame:
    """Per stage attempt, of tasks that succeeded: n, total, lo, hi, p50 and p95 of four measures as structs, and the slowest task, the first of equals."""
    ok = _succeeded(tasks)
    out = [F.count(F.lit(1)).alias("n")]
    for v in ("duration_ms", "moved_bytes", "moved_rows", "gc_ms"):
        q = [F.expr(f"percentile_disc({p}) within group (order by greatest({v}, 0))").cast("long").alias(n) for n, p in (("p50", 0.5), ("p95", 0.95))]
        out.append(F.struct(F.sum(v).alias("total"), F.min(v).alias("lo"), F.max(v).alias("hi"), *q).alias(v))
    slowest = F.max_by(F.struct("task_id", "task_index", "executor_id", "duration_ms", "moved_bytes", "moved_rows", "file", "line"), F.struct("duration_ms", -F.col("part"), -F.col("line")))
    return ok.groupBy(*STAGE).agg(*out, slowest.alias("slowest"))


QUARTILES = ("duration_ms", "run_ms", "cpu_ns", "gc_ms", "deser_ms", "result_ser_ms", "getting_ms", "scheduler_delay_ms", "result_bytes", "peak_exec_mem", "mem_spill", "disk_spill", "input_bytes", "input_records", "output_bytes", "output_records", "fetch_wait_ms", "shuffle_remote_bytes", "shuffle_local_bytes", "shuffle_read_records", "shuffle_write_bytes", "shuffle_write_records", "shuffle_write_ns")


def stage_quartiles(tasks: DataFrame) -> DataFrame:
    """n, total, lo, p25, p50, p75 and hi of 23 measures per stage attempt, one row per measure."""
    long = tasks.filter("status = 'succeeded'").select(*STAGE, F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in QUARTILES])))
    return D.dist_summary(long, [*STAGE, "measure"], "v", (0.25, 0.5, 0.75))


def stage_duration_hist(tasks: DataFrame, max_bins: int = 40) -> DataFrame:
    return D.log_hist(tasks.filter("status = 'succeeded'"), STAGE, "duration_ms", max_bins)


def slowest_tasks(tasks: DataFrame, k: int = 100) -> DataFrame:
    return D.top_k(tasks, STAGE, [F.desc("duration_ms"), F.asc("task_id")], k)


def sampled_tasks(tasks: DataFrame, n: int = 1000, budget: int = 100_000) -> DataFrame:
    """At most n tasks of each stage attempt, n halved until one application's samples fit the budget."""
    counts = tasks.groupBy(*STAGE).agg(F.count(F.lit(1)).alias("n"))
    sizes = [n]
    while sizes[-1] // 2 >= 10:
        sizes.append(sizes[-1] // 2)
    fits = counts.groupBy(*KEY).agg(*[F.sum(F.least(F.col("n"), F.lit(s))).alias(f"s{s}") for s in sizes])
    chosen = F.lit(sizes[-1])
    for s in reversed(sizes):
        chosen = F.when(F.col(f"s{s}") <= budget, s).otherwise(chosen)
    rank = F.row_number().over(W.partitionBy(*STAGE).orderBy(F.xxhash64("task_id")))
    return tasks.join(fits.select(*KEY, chosen.alias("most")), list(KEY)).withColumn("rank", rank).filter("rank <= most").drop("rank", "most")


def failure_of(reason: Column) -> Column:
    """struct(kind, message) of a task's end reason; a Python traceback tells its error in its last line, others in the first."""
    text = F.coalesce(reason["Description"], reason["Message"], reason["Loss Reason"], reason["Kill Reason"], F.lit(""))
    kind = F.when(reason["Reason"] == "ExceptionFailure", F.coalesce(reason["Class Name"], reason["Reason"])).otherwise(reason["Reason"])
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    message = F.when(F.size(lines) == 0, F.lit("")).when(text.contains("Traceback (most recent call last)"), F.element_at(lines, -1)).otherwise(F.element_at(lines, 1))
    return F.struct(kind.alias("kind"), message.alias("message"))


def task_failures(tasks: DataFrame, max_groups: int = 20) -> DataFrame:
    """Failures per stage attempt by kind and message, the rarest beyond max_groups joined as Other."""
    failed = tasks.filter("status = 'failed'").withColumn("f", failure_of(F.col("reason"))).select(*STAGE, "f.*", "executor_id", "part", "file", "line", F.col("reason.`Full Stack Trace`").alias("stack"))
    first = F.struct("part", "line")
    groups = failed.groupBy(*STAGE, "kind", "message").agg(F.count(F.lit(1)).alias("n"), F.slice(F.array_sort(F.collect_set("executor_id")), 1, 20).alias("executors"), F.min_by("stack", first).alias("stack"), F.min_by(F.struct("file", "line"), first).alias("src"))
    rank = F.row_number().over(W.partitionBy(*STAGE).orderBy(F.desc("n"), "kind", "message"))
    ranked = groups.withColumn("rank", rank)
    other = ranked.filter(F.col("rank") > max_groups).groupBy(*STAGE).agg(F.lit("Other").alias("kind"), F.lit("").alias("message"), F.sum("n").alias("n"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("executors")))), 1, 20).alias("executors"), F.lit(None).cast("string").alias("stack"), F.min("src").alias("src"))
    return ranked.filter(F.col("rank") <= max_groups).drop("rank").unionByName(other)


def running_tasks(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """Task attempts that never ended."""
    return I.open_at_end(starts, ends.select(*KEY, "task_id"), [*KEY, "task_id"])


def stages(stage_events: DataFrame, totals: DataFrame, app_ended: DataFrame) -> DataFrame:
    """One row per stage attempt with its state: complete, failed, running, incomplete (the application ended first) or skipped."""
    last = F.struct("completed_event", "part", "line")
    facts = stage_events.groupBy(*STAGE).agg(*[F.max_by(c, last).alias(c) for c in ("name", "num_tasks", "parents", "details", "failure")], F.min("submitted").alias("submitted"), F.max("completed").alias("completed"), F.bool_or("completed_event").alias("ended"))
    rows = facts.join(totals.select(*STAGE, "tasks", "run_ms"), list(STAGE), "left").join(app_ended.select(*KEY, F.lit(True).alias("app_ended")).distinct(), list(KEY), "left")
    state = F.when(F.col("failure").isNotNull(), "failed").when(F.col("ended"), "complete").when(F.col("tasks").isNull() & F.col("submitted").isNull(), "skipped").when(F.col("app_ended"), "incomplete").otherwise("running")
    return rows.withColumn("state", state).withColumn("call_site", call_site(F.col("name"))).withColumn("wall_ms", F.col("completed") - F.col("submitted"))


def jobs(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """One row per job with its result; its name is that of its highest stage. Of several starts the first counts, of several ends the last, by line.

    Starts and ends are dealt by job together and sorted once: aggregates of names and texts would sort both before and after they are dealt, and a join once more.
    """
    named = F.expr("element_at(array_sort(transform(stage_infos, x -> struct(x.`Stage ID` as id, x.`Stage Name` as name))), -1).name")
    if "stage_infos" in starts.columns:
        starts = starts.withColumn("name", F.when(F.size("stage_infos") > 0, named))
    began, over = [c for c in ("name", "submitted", "stage_ids", "execution_id") if c in starts.columns], ("completed", "result", "message")
    own = (*KEY, "job_id", "part", "file", "line")
    none = lambda df, cols: [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in cols]
    both = starts.select(*own, F.lit(False).alias("over"), *began, *none(ends, over)).unionByName(ends.dropna(subset=[*KEY, "job_id"]).select(*own, F.lit(True).alias("over"), *none(starts, began), *over))
    w = W.partitionBy(*KEY, "job_id").orderBy("over", "part", "line", "file")
    last = {c: F.last(c).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) for c in over}
    first = both.withColumns({**last, "number": F.row_number().over(w)}).filter("number = 1 and not over")
    rows = first.select(*KEY, "job_id", *began, "file", "line", *over)
    return rows.withColumn("failed", F.coalesce(F.col("result") != "JobSucceeded", F.lit(False))).withColumn("error", short_error(F.col("message")))


def job_stage(jobs: DataFrame) -> DataFrame:
    """One row per job and stage; a stage may belong to many jobs."""
    return jobs.select(*KEY, "job_id", "execution_id", F.explode("stage_ids").alias("stage_id"))


def executors(added: DataFrame, removed: DataFrame, apps: DataFrame) -> DataFrame:
    """Lifetimes: from being added, or else the application's start, to being removed, or else the run's end."""
    gone = removed.groupBy(*KEY, "executor_id").agg(F.max("t").alias("removed"), F.max_by("reason", "t").alias("reason"), F.max_by("kind", "t").alias("kind"))
    one = added.groupBy(*KEY, "executor_id").agg(*[F.min_by(c, "t").alias(c) for c in ("host", "cores", "profile", "startup_ms")], F.min("t").alias("added"))
    rows = one.join(gone, [*KEY, "executor_id"], "left").join(apps.select(*KEY, F.col("started").alias("app_start"), F.col("ended").alias("app_end")), list(KEY), "left")
    return rows.withColumn("start", F.coalesce("added", "app_start")).withColumn("end", F.coalesce("removed", "app_end")).drop("app_start", "app_end")


def applications(starts: DataFrame, ends: DataFrame, jobs: DataFrame, counts: DataFrame) -> DataFrame:
    """Identity, times, state and its reason: an exit code counts before the last job's result; without an end event a run is incomplete."""
    a = starts.groupBy(*KEY).agg(F.max_by("name", "t").alias("name"), F.max_by("user", "t").alias("user"), F.min("t").alias("started"))
    e = ends.groupBy(*KEY).agg(F.max("t").alias("app_ended"), F.max_by("exit_code", "t").alias("exit_code"))
    j = jobs.groupBy(*KEY).agg(F.max_by("failed", F.struct("submitted", "job_id")).alias("last_failed"), F.max_by("error", F.struct("submitted", "job_id")).alias("last_error"), F.max(F.coalesce("completed", "submitted")).alias("last_seen"))
    rows = counts.groupBy(*KEY).agg(F.sum("n").alias("events")).join(a, list(KEY), "left").join(e, list(KEY), "left").join(j, list(KEY), "left")
    bad_exit = F.coalesce(F.col("exit_code"), F.lit(0)) != 0
    state = F.when(F.col("started").isNull(), "no events").when(F.col("app_ended").isNull(), "incomplete").when(bad_exit, "failed").when(F.col("exit_code").isNull() & F.coalesce("last_failed", F.lit(False)), "failed").otherwise("succeeded")
    why = F.when(bad_exit, F.concat(F.lit("exit code "), F.col("exit_code").cast("string"))).when(F.col("last_failed"), F.col("last_error"))
    return rows.withColumn("state", state).withColumn("reason", why).withColumn("ended", F.coalesce("app_ended", "last_seen")).withColumn("duration_ms", F.col("ended") - F.col("started"))


def cpu_use(executors: DataFrame, totals: DataFrame) -> DataFrame:
    """Per application: share of task time on the CPU, core time held, and the share of it that tasks used."""
    held = executors.groupBy(*KEY).agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.col("start")) * F.col("cores")).alias("core_ms"))
    used = totals.groupBy(*KEY).agg(F.sum("run_ms").alias("run_ms"), F.sum("cpu_ns").alias("cpu_ns"), F.sum("duration_ms").alias("task_ms"))
    return used.join(held, list(KEY), "left").withColumn("cpu_share", share(F.col("cpu_ns") / 1e6, F.col("run_ms"))).withColumn("busy_share", share(F.col("task_ms"), F.col("core_ms")))


def driver_gaps(apps: DataFrame, jobs: DataFrame, least: int = 1000) -> DataFrame:
    """Times in which no job ran, of at least a second."""
    span = apps.filter("started is not null and ended is not null").select(*KEY, F.col("started").alias("lo"), F.col("ended").alias("hi"))
    return I.gaps(jobs.join(span, list(KEY)), KEY, "lo", "hi", "submitted", "completed", least)


def executors_over_time(executors: DataFrame) -> DataFrame:
    return I.step_series(executors, KEY, "start", "end")


def peak_per_host(executors: DataFrame) -> DataFrame:
    return I.peak_concurrency(executors, [*KEY, "host"], "start", "end")


def block_kinds(updates: DataFrame) -> DataFrame:
    """Updates and largest sizes by kind of block."""
    return updates.groupBy(*KEY, block_kind(F.col("block_id")).alias("kind")).agg(F.count(F.lit(1)).alias("updates"), F.max("memory").alias("max_memory"), F.max("disk").alias("max_disk"))


def cached_blocks(updates: DataFrame, gone: DataFrame) -> DataFrame:
    """What each executor holds of each persisted RDD at the end: a block's last update counts, size 0 is evicted, and an unpersisted RDD holds nothing."""
    rdd = updates.filter("block_id like 'rdd\\_%'").withColumn("rdd_id", F.regexp_extract("block_id", r"^rdd_(\d+)_", 1).cast("int"))
    at = F.struct("part", "line")
    last = rdd.groupBy(*KEY, "rdd_id", "executor_id", "block_id").agg(F.max_by("memory", at).alias("memory"), F.max_by("disk", at).alias("disk"))
    kept = last.filter("memory + disk > 0").join(gone.select(*KEY, "rdd_id"), [*KEY, "rdd_id"], "left_anti")
    return kept.groupBy(*KEY, "rdd_id", "executor_id").agg(F.count(F.lit(1)).alias("blocks"), F.sum("memory").alias("memory"), F.sum("disk").alias("disk"))


def critical_path(jobs: DataFrame, stages: DataFrame) -> DataFrame:
    """Of each application's longest job, the chain of dependent stages with the longest total wall time, in order. Only that job's stages reach the one task that walks them."""
    longest = jobs.filter("completed is not null").groupBy(*KEY).agg(F.max_by(F.struct("job_id", "stage_ids"), F.struct(F.col("completed") - F.col("submitted"), -F.col("job_id"))).alias("j")).select(*KEY, "j.job_id", F.explode("j.stage_ids").alias("stage_id"))
    latest = stages.groupBy(*KEY, "stage_id").agg(F.max_by(F.struct("stage_attempt", "parents", "wall_ms"), "stage_attempt").alias("s")).select(*KEY, "stage_id", "s.*")
    rows = longest.join(latest, [*KEY, "stage_id"]).select(*KEY, "job_id", "stage_id", "parents", F.coalesce("wall_ms", F.lit(0)).alias("wall_ms"))

    def walk(f: pd.DataFrame) -> pd.DataFrame:
        wall = dict(zip(f.stage_id, f.wall_ms, strict=True))
        parents = {s: sorted(p for p in ps if p in wall) for s, ps in zip(f.stage_id, f.parents, strict=True)}
        best: dict[int, tuple[int, int | None]] = {}
        for s in sorted(wall):  # a parent's id is smaller, so cycles can't arise
            before = max(((best[p][0], -p) for p in parents[s] if p in best), default=None)
            best[s] = (wall[s] + (before[0] if before else 0), -before[1] if before else None)
        at = max(best, key=lambda s: (best[s][0], -s), default=None)
        chain = []
        while at is not None:
            chain.append(at)
            at = best[at][1]
        chain.reverse()
        return pd.DataFrame({"app_id": f.app_id.iloc[0], "attempt": f.attempt.iloc[0], "job_id": f.job_id.iloc[0], "step": range(len(chain)), "stage_id": chain, "wall_ms": [wall[s] for s in chain]})

    return rows.groupBy(*KEY).applyInPandas(walk, "app_id string, attempt int, job_id int, step int, stage_id int, wall_ms long")


def walk_back(rows: dict[tuple[int, int], tuple[int, int, list[int]]], jobs: list[tuple[int, int]], start: int, end: int, slack: int) -> list[tuple]:
    """Steps (kind, stage_id, stage_attempt, from, to) from start to end. rows: submitted, completed and parents of stage attempts. Each attempt is taken or passed once, so time grows with stages and jobs and the logarithm of both."""
    out: list[tuple] = []
    tries: dict[int, list[tuple[int, int]]] = {}
    for k in rows:
        tries.setdefault(k[0], []).append(k)
    ends = sorted((c, k) for k, (_, c, _) in rows.items())  # the last is the next candidate; t only goes down, so what doesn't fit never will
    jobs = sorted(jobs)
    begun = [x for x, _ in jobs]
    reach = list(accumulate((y for _, y in jobs), max))
    used: set = set()
    parents: list[int] = []
    t = end

    def gap(a: int, b: int) -> None:
        if b > a:
            i = bisect_right(begun, (a + b) // 2)
            out.append(("scheduling" if i and reach[i - 1] >= (a + b) // 2 else "driver", None, None, a, b))

    def fits(k: tuple[int, int]) -> bool:
        return k not in used and rows[k][1] <= t + slack and rows[k][0] < t

    while t > start:
        pool = [(rows[k][1], k) for p in set(parents) for k in tries.get(p, ()) if fits(k)]
        while not pool and ends and not fits(ends[-1][1]):
            ends.pop()
        if not pool and not ends:
            break
        c, k = max(pool) if pool else ends.pop()
        used.add(k)
        a, last = max(start, rows[k][0]), min(c, t)
        gap(max(start, last), t)
        if last > a:
            out.append(("stage", k[0], k[1], a, last))
            t = a
        elif last > start:
            t = last
        parents = rows[k][2]
    gap(start, t)
    out.reverse()
    return out


def run_path(apps: DataFrame, stages: DataFrame, jobs: DataFrame, slack: int = 50) -> DataFrame:
    """Steps that tile each run, from its start to its end: stages that decided its length, and what lies between them.

    From the end backwards: the last-finishing unused parent of the stage just passed that ended by then, else any such stage; what is left between is scheduling if a job ran in
    its middle, else the driver's own work. An application's stages and jobs, never its tasks, reach the one task that walks them.
    """
    spans = apps.filter("started is not null and ended is not null").select(*KEY, "started", "ended")
    s = stages.filter("submitted is not null and completed is not null").select(*KEY, "stage_id", "stage_attempt", "parents", "submitted", "completed").join(spans, list(KEY))
    j = jobs.filter("submitted is not null").select(*KEY, "submitted", F.coalesce("completed", F.lit(2**62)).alias("completed"))

    def walk(key: tuple, f: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(f):
            rows = {(int(r.stage_id), int(r.stage_attempt)): (int(r.submitted), int(r.completed), [] if r.parents is None else list(r.parents)) for r in f.itertuples()}
            out = walk_back(rows, list(zip(g.submitted, g.completed, strict=True)), int(f.started.iloc[0]), int(f.ended.iloc[0]), slack)
        return pd.DataFrame([(*key, i, *r) for i, r in enumerate(out)], columns=["app_id", "attempt", "step", "kind", "stage_id", "stage_attempt", "start", "end"])

    s, j = s.toDF(*s.columns), j.toDF(*j.columns)  # both come from the same tables: new names tell their keys apart
    return s.groupBy(*KEY).cogroup(j.groupBy(*KEY)).applyInPandas(walk, "app_id string, attempt int, step int, kind string, stage_id int, stage_attempt int, start long, end long")


_NODE = "node int, parent int, depth int, name string, text string, metadata map<string,string>, metrics array<struct<name:string,acc_id:bigint,kind:string>>"


def walk_plan(plan: str | None) -> Iterator[tuple]:
    """Rows of a plan's tree in pre-order: id, parent, depth, name, text, metadata, and its metrics' accumulators."""
    try:
        root = json.loads(plan) if plan else None
    except ValueError:
        root = None
    stack = [(root, -1, 0)] if isinstance(root, dict) else []
    text = lambda x: x if x is None or isinstance(x, str) else str(x)
    number = lambda x: x if isinstance(x, int) else None
    n = 0
    while stack:
        node, parent, depth = stack.pop()
        metrics = [{"name": text(m.get("name")), "acc_id": number(m.get("accumulatorId")), "kind": text(m.get("metricType"))} for m in node.get("metrics") or []]
        yield n, parent, depth, text(node.get("nodeName")), text(node.get("simpleString")), [(k, str(v)) for k, v in (node.get("metadata") or {}).items()], metrics
        stack.extend((c, n, depth + 1) for c in reversed(node.get("children") or []))
        n += 1


def plan_nodes(plans: DataFrame) -> DataFrame:
    """plans(..., plan as JSON) with a row for each node of its tree. The tree's depth has no bound, which no fixed schema can hold: this is the one Python function per row. Nodes are handed back in thousands, whatever a plan's size."""
    rest = [c for c in plans.columns if c != "plan"]
    schema = T.StructType([*plans.select(*rest).schema, *T.StructType.fromDDL(_NODE)])
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = ((i, *node) for i, plan in enumerate(b.column("plan")) for node in walk_plan(plan.as_py()))
            while some := list(islice(found, 5_000)):
                at, *nodes = zip(*some)
                own = [b.column(c).take(pa.array(at)) for c in rest]
                yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(own, kinds)), *(pa.array(c, f.type) for c, f in zip(nodes, list(kinds)[len(rest) :]))], schema=kinds)

    return plans.mapInArrow(run, schema)


def latest_plans(starts: DataFrame, adaptive: DataFrame) -> DataFrame:
    """The last plan of each query: its adaptive updates come after its start. Plans are sorted after they are dealt, not in the tasks that read them as well, which may read any number."""
    both = starts.select(*KEY, "execution_id", "part", "line", "plan", "plan_text").unionByName(adaptive.select(*KEY, "execution_id", "part", "line", "plan", "plan_text"))
    later = F.lead(F.lit(1)).over(W.partitionBy(*KEY, "execution_id").orderBy("part", "line"))
    return both.withColumn("later", later).filter("later is null").select(*KEY, "execution_id", "plan", "plan_text")


def operator_spread(tasks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per SQL operator metric: tasks, lo, p50 and hi of its updates, and the task and stage of the highest."""
    updates = tasks.select(*STAGE, "task_id", F.explode("accumulables").alias("a")).filter("a.Metadata = 'sql'")
    values = updates.select(*STAGE, "task_id", F.col("a.ID").alias("acc_id"), F.expr("try_cast(a.`Update` as bigint)").alias("v")).filter("v is not null")
    metrics = nodes.select(*KEY, "execution_id", "node", F.col("name").alias("operator"), F.explode("metrics").alias("m")).select(*KEY, "execution_id", "node", "operator", F.col("m.name").alias("metric"), F.col("m.acc_id").alias("acc_id"))
    joined = values.join(metrics, [*KEY, "acc_id"])
    return joined.groupBy(*KEY, "execution_id", "node", "operator", "metric").agg(
        F.count(F.lit(1)).alias("tasks"), F.min("v").alias("lo"), F.expr("percentile_disc(0.5) within group (order by v)").cast("long").alias("p50"), F.max("v").alias("hi"), F.max_by(F.struct("stage_id", "task_id"), "v").alias("at")
    )
