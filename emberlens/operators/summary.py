"""What a run looks like at a glance: executors, hosts, data moved, stages worth a look, heat by executor, busy time, and the notes that name its extremes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import distributions as D
from . import intervals as I
from .extract import KEY


def exec_summary(executors: DataFrame) -> DataFrame:
    """Per application: executors started, most at once and when, how many ended in each way, and the usual number of cores (of equally frequent ones the largest)."""
    own = executors.filter("executor_id <> 'driver'")
    ended = [F.count_if(F.col("kind") == k).alias(k.replace("-", "_")) for k in ("memory-kill", "decommissioned", "killed-by-driver", "idle", "lost", "other")]
    counts = own.groupBy(*KEY).agg(F.count(F.lit(1)).alias("started"), *ended)
    most = I.peak_concurrency(own, KEY, "start", "end").select(*KEY, F.col("peak").alias("most"), F.col("at").alias("most_at"))
    return counts.join(most, list(KEY), "left").join(D.mode_of(own, KEY, "cores").select(*KEY, "cores"), list(KEY), "left")


def host_totals(tasks: DataFrame) -> DataFrame:
    """Tasks, failures, executors and counters of each host."""
    sums = [F.sum(c).alias(c) for c in ("duration_ms", "run_ms", "cpu_ns", "gc_ms", "input_bytes", "disk_spill", "shuffle_write_bytes")]
    return tasks.groupBy(*KEY, "host").agg(F.count(F.lit(1)).alias("tasks"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_distinct("executor_id").alias("executors"), *sums)


def io_totals(totals: DataFrame) -> DataFrame:
    """Bytes and records that an application read, wrote and shuffled."""
    cols = ("input_bytes", "input_records", "output_bytes", "output_records", "shuffle_remote_bytes", "shuffle_local_bytes", "shuffle_read_records", "shuffle_write_bytes", "shuffle_write_records")
    return totals.groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in cols])


#: In which order kinds of access are listed.
ACCESS = ("read", "write", "create", "alter", "rename", "drop")


def data_refs(refs: DataFrame) -> DataFrame:
    """References to data once each, with their place: by access in the order of ACCESS, then by kind and name."""
    one = refs.groupBy(*KEY, "access", "kind", "name").agg(F.count(F.lit(1)).alias("times"))
    return one.withColumn("place", F.row_number().over(W.partitionBy(*KEY).orderBy(F.array_position(F.array(*map(F.lit, ACCESS)), F.col("access")), "kind", "name")).cast("long"))


def executor_heat(stage_executor: DataFrame, measure: str) -> DataFrame:
    """A measure of each stage attempt on each executor, and how many times the middle executor's of that stage it is; null where that is 0."""
    keys = [*KEY, "stage_id", "stage_attempt"]
    rows = stage_executor.select(*keys, "executor_id", F.col(measure).alias("v")).dropna(subset=keys)
    return rows.withColumn("middle", F.percentile("v", F.lit(0.5)).over(W.partitionBy(*keys))).withColumn("times", F.when(F.col("middle") > 0, F.col("v") / F.col("middle")))


def worth_a_look(stages: DataFrame, totals: DataFrame, on_path: DataFrame | None = None) -> DataFrame:
    """Stages in the order in which they are worth a look: failed ones, those on the path that decided the run's length unless over half of all are, those that spilled or were retried, then the rest; longer ones first."""
    keys = [*KEY, "stage_id", "stage_attempt"]
    rows = stages.select(*keys, "name", "state", "wall_ms").join(totals.select(*keys, "disk_spill", "failed"), keys, "left")
    path = F.lit(False)
    if on_path is not None:
        rows = rows.join(on_path.filter("stage_id is not null").select(*keys).distinct().withColumn("path", F.lit(True)), keys, "left")
        path = F.coalesce("path", F.lit(False)) & (2 * F.count("path").over(W.partitionBy(*KEY)) <= F.count(F.lit(1)).over(W.partitionBy(*KEY)))
    group = F.when(F.col("state") == "failed", 0).when(path, 1).when((F.coalesce("disk_spill", F.lit(0)) > 0) | (F.coalesce("failed", F.lit(0)) > 0) | (F.col("stage_attempt") > 0), 2).otherwise(3)
    ranked = rows.withColumn("group", group)
    place = F.row_number().over(W.partitionBy(*KEY).orderBy("group", F.desc_nulls_last("wall_ms"), "stage_id", "stage_attempt"))
    return ranked.withColumn("place", place.cast("long")).select(*keys, "name", "state", "wall_ms", "group", "place")


def tasks_over_time(tasks: DataFrame, apps: DataFrame, width: int) -> DataFrame:
    """Busy task time per bucket of width from each run's start on; buckets in which nothing changes are left out."""
    origin = apps.filter("started is not null").select(*KEY, F.col("started").alias("origin"))
    rows = tasks.filter("launched is not null and finished is not null").select(*KEY, "launched", "finished").join(origin, list(KEY))
    return I.busy_buckets(rows, KEY, "launched", "finished", width, "origin")


def run_events(tasks: DataFrame, executors: DataFrame) -> DataFrame:
    """Failed tasks, and executors that came and went, grouped by second, kind and stage."""
    failed = tasks.filter("status = 'failed'").select(*KEY, F.col("finished").alias("t"), F.lit("task-failed").alias("kind"), "stage_id")
    came = executors.filter("added is not null").select(*KEY, F.col("added").alias("t"), F.lit("executor-added").alias("kind"), F.lit(None).cast("int").alias("stage_id"))
    gone = executors.filter("removed is not null").select(*KEY, F.col("removed").alias("t"), F.concat(F.lit("executor-"), F.coalesce("kind", F.lit("other"))).alias("kind"), F.lit(None).cast("int").alias("stage_id"))
    return failed.unionByName(came).unionByName(gone).groupBy(*KEY, F.expr("t div 1000").alias("second"), "kind", "stage_id").agg(F.count(F.lit(1)).alias("n"))


def run_notes(stages: DataFrame, totals: DataFrame, dist: DataFrame, hosts: DataFrame) -> DataFrame:
    """One row per note and application: what had the most of something, and how much. Longest stage, worst straggler (of three tasks or more, a second over the median), biggest mover, top spill, busiest host."""
    stage = F.concat(F.lit("stage "), "stage_id", F.lit("."), "stage_attempt")

    def note(df: DataFrame, kind: str, what, value) -> DataFrame:
        rows = df.select(*KEY, what.alias("what"), value.cast("long").alias("value")).filter("value > 0")
        best = rows.groupBy(*KEY).agg(F.min(F.struct((-F.col("value")).alias("less"), "what")).alias("x"))
        return best.select(*KEY, F.lit(kind).alias("note"), F.col("x.what").alias("what"), (-F.col("x.less")).alias("value"))

    over = F.col("duration_ms.hi") - F.col("duration_ms.p50")
    moved = F.col("input_bytes") + F.col("output_bytes") + F.col("shuffle_remote_bytes") + F.col("shuffle_local_bytes") + F.col("shuffle_write_bytes")
    out = note(stages.filter("wall_ms is not null"), "longest-stage", stage, F.col("wall_ms"))
    for x in (
        note(dist.filter((F.col("n") >= 3) & (over >= 1000)), "straggler", stage, over),
        note(totals, "mover", stage, moved),
        note(totals, "spill", stage, F.col("disk_spill")),
        note(hosts, "busiest-host", F.col("host"), F.col("duration_ms")),
    ):
        out = out.unionByName(x)
    return out
