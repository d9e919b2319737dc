"""Reads of a region store: which task read which region, load of its servers over time, scans, events that met slow tasks, and what they add up to.

splits: app, stage_id, executor, table, start_row, end_row, region, server, bytes, partition (where the line names its task). tasks: app, stage_id, partition, executor_id, launched,
finished, duration_ms, status, task_attempt. region_tasks: both, tied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import row_key_bytes
from . import distributions as D
from . import intervals as I
from . import timesplit as S

STAGE = ["app", "stage_id"]


def tie_splits(splits: DataFrame, tasks: DataFrame, stages: DataFrame) -> DataFrame:
    """Splits with the partition that read each, and why not where that can't be told.

    Where every split of a stage names its task, that is it. Else the regions in the order of their keys are the partitions in theirs, but only if the stage read one table, has as many
    splits as tasks, and every split was logged by the executor that ran that partition; nothing is guessed otherwise. stages: app, stage_id, num_tasks.
    """
    w = W.partitionBy(*STAGE)
    ran = tasks.filter("status = 'succeeded'").groupBy(*STAGE, F.col("partition").alias("place")).agg(F.max_by("executor_id", "task_attempt").alias("ran_on"))
    ranked = splits.withColumns(
        {
            "named": F.count("partition").over(w) == F.count(F.lit(1)).over(w),
            "n": F.count(F.lit(1)).over(w),
            "tables": F.size(F.collect_set("table").over(w)),
            "place": (F.row_number().over(w.orderBy(row_key_bytes(F.col("start_row")), "region")) - 1).cast("int"),
        }
    )
    checked = ranked.join(stages.select(*STAGE, "num_tasks"), STAGE, "left").join(ran, [*STAGE, "place"], "left")
    agree = F.bool_and(F.coalesce(F.col("ran_on") == F.col("executor"), F.lit(True))).over(w)
    why = F.when(F.col("named"), None).when(F.col("tables") > 1, "several tables").when(~(F.col("n") == F.col("num_tasks")) | F.col("num_tasks").isNull(), "splits and tasks differ in number").when(~agree, "executors disagree")
    tied = checked.withColumn("why", why).withColumn("partition", F.when(F.col("named"), F.col("partition")).when(F.col("why").isNull(), F.col("place")))
    return tied.select(*splits.columns, "why")


def region_tasks(tied: DataFrame, tasks: DataFrame) -> DataFrame:
    """Task attempts that read each region, slow ones marked: at least twice their stage's middle duration and a second more."""
    rows = tied.filter("partition is not null").drop("executor").join(tasks, [*STAGE, "partition"])
    middle = rows.filter("duration_ms is not null").groupBy(*STAGE).agg(D.median_mid("duration_ms").alias("median"), F.count(F.lit(1)).alias("timed"))
    slow = (F.col("timed") > 1) & (F.col("duration_ms") >= 2 * F.col("median")) & (F.col("duration_ms") - F.col("median") >= 1000)
    return rows.join(middle, STAGE, "left").withColumn("slow", F.coalesce(slow, F.lit(False))).drop("timed")


def region_event_tasks(events: DataFrame, tasks: DataFrame, slack: int = 1000) -> DataFrame:
    """Events of a region (app, region, event, start, end) with the tasks that read it then, within a second; an event that met no task isn't kept."""
    t = tasks.filter("launched is not null and finished is not null").select("app", "region", F.col("launched").alias("start"), F.col("finished").alias("end"), "stage_id", "partition", "task_attempt", "slow")
    pairs = I.overlap_join(events, t, ["app", "region"], "start", "end", slack)
    task = F.struct("b.stage_id", "b.partition", "b.task_attempt")
    return pairs.groupBy("app", "region", F.col("a.event").alias("event"), F.col("a.start").alias("start"), F.col("a.end").alias("end")).agg(F.array_sort(F.collect_set(task)).alias("tasks"), F.array_sort(F.collect_set(F.when(F.col("b.slow"), task))).alias("slow_tasks"))


def server_load(tasks: DataFrame, least: int = 4, share: float = 0.75) -> DataFrame:
    """Per server: tasks, their time, time with any, most at once and when, and its longest hot stretch: at least `least` tasks there, which are a share of all that run, with several servers in use."""
    t = tasks.filter("launched is not null and finished > launched and server is not null")
    per = t.groupBy("app", "server").agg(F.count(F.lit(1)).alias("tasks"), F.sum(F.col("finished") - F.col("launched")).alias("task_ms"))
    peak = I.peak_concurrency(t, ["app", "server"], "launched", "finished")
    busy = I.union_length(t, ["app", "server"], "launched", "finished").withColumnRenamed("covered", "busy_ms")
    own = I.step_series(t, ["app", "server"], "launched", "finished")
    total = I.step_series(t, ["app"], "launched", "finished").withColumnRenamed("running", "all")
    servers = per.groupBy("app").agg(F.count(F.lit(1)).alias("servers"))
    # Each server at each instant of change of its application, its number carried on from its own last change.
    grid = total.join(servers, "app").join(per.select("app", "server"), "app")
    carried = grid.join(own, ["app", "server", "t"], "left").withColumn("here", F.coalesce(F.last("running", ignorenulls=True).over(W.partitionBy("app", "server").orderBy("t").rowsBetween(W.unboundedPreceding, 0)), F.lit(0)))
    w = W.partitionBy("app", "server").orderBy("t")
    hot = (F.col("servers") > 1) & (F.col("here") >= least) & (F.col("here") >= share * F.col("all"))
    marked = carried.withColumn("hot", hot).withColumn("until", F.coalesce(F.lead("t").over(w), F.col("t"))).withColumn("island", F.sum(F.when(F.coalesce(F.lag("hot").over(w), ~F.col("hot")) != F.col("hot"), 1).otherwise(0)).over(w))
    stretch = marked.filter("hot").groupBy("app", "server", "island").agg(F.min("t").alias("hot_from"), F.max("until").alias("hot_to"), F.max("here").alias("hot_tasks"))
    longest = stretch.groupBy("app", "server").agg(F.max_by(F.struct("hot_from", "hot_to", "hot_tasks"), F.struct(F.col("hot_to") - F.col("hot_from"), -F.col("hot_from"))).alias("h")).select("app", "server", "h.*")
    return per.join(peak.withColumnRenamed("at", "peak_at"), ["app", "server"]).join(busy, ["app", "server"]).join(longest, ["app", "server"], "left")


def scans(tied: DataFrame) -> DataFrame:
    """Per stage and table: regions, servers, bytes, whether first to last row was read, upper median of region sizes, and the most regions of one server."""
    key = row_key_bytes(F.col("start_row"))
    per = tied.groupBy(*STAGE, "table", "server").agg(F.count(F.lit(1)).alias("here"))
    most = per.groupBy(*STAGE, "table").agg(F.max("here").alias("most"), F.max_by("server", F.struct("here", "server")).alias("server"), F.count(F.lit(1)).alias("servers"))
    sized = D.median_high(tied.filter("bytes > 0"), [*STAGE, "table"], "bytes").withColumnRenamed("median", "median_bytes")
    out = tied.groupBy(*STAGE, "table").agg(
        F.count(F.lit(1)).alias("regions"), F.sum("bytes").alias("bytes"), F.count_if(F.col("bytes") > 0).alias("sized"), F.min_by("start_row", key).alias("first_row"), F.max_by("end_row", key).alias("last_row"), F.first("why", ignorenulls=True).alias("why")
    )
    full = (F.col("first_row") == "") & (F.col("last_row") == "")
    return out.withColumn("full", full).join(most, [*STAGE, "table"], "left").join(sized, [*STAGE, "table"], "left")


def repeated_scans(tied: DataFrame, percent: int = 80) -> DataFrame:
    """Stages of one table that read at least a share of the regions that its first stage read."""
    rows = tied.select(F.struct("app", "table").alias("g"), "stage_id", F.concat_ws("\u0001", "start_row", "end_row").alias("range"))
    return S.group_overlap(rows, "g", "stage_id", "range", percent).select("group.*", F.col("first").alias("first_stage"), F.col("other").alias("stage_id"), "common")


def store_findings(tied: DataFrame, tasks: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """app, rule, severity and args of what reads of the store show: hotspots, full scans, tiny regions, repeated scans, retried regions, skewed scans, hot servers, and events that met slow tasks."""

    def found(df: DataFrame, rule: str, severity: str, **args: str) -> DataFrame:
        told = F.create_map(*[x for k, c in args.items() for x in (F.lit(k), F.col(c).cast("string"))])
        return df.select("app", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), told.alias("args"))

    s = scans(tied)
    gib = 1 << 30
    out = [
        found(s.filter("regions >= 4 and servers >= 2 and most >= 0.75 * regions"), "store-hotspot", "warning", table="table", server="server", regions="most"),
        found(s.filter(f"full and (regions >= 10 or bytes >= {10 * gib})"), "store-full-scan", "info", table="table", stage="stage_id", regions="regions"),
        found(s.filter(f"sized >= 20 and median_bytes < {32 << 20}"), "store-tiny-regions", "info", table="table", median="median_bytes"),
        found(repeated_scans(tied), "store-repeated-scan", "info", table="table", first="first_stage", stage="stage_id"),
    ]
    tries = tasks.groupBy("app", "stage_id", "partition").agg(F.count_distinct("task_attempt").alias("tries"), F.count_if(F.col("status") == "failed").alias("failed"), F.first("region").alias("region"))
    out.append(found(tries.filter("tries > 1 and failed > 0"), "store-retried-region", "warning", stage="stage_id", partition="partition", region="region"))
    worst = D.top_k(tasks.filter("slow"), STAGE, [F.desc("duration_ms"), F.asc("partition")], 1)
    out.append(found(worst, "store-scan-skew", "warning", stage="stage_id", region="region", duration_ms="duration_ms", median_ms="median"))
    out.append(found(server_load(tasks).filter("hot_to - hot_from >= 60000"), "store-server-load", "warning", server="server", tasks="hot_tasks"))
    if events is not None:
        met = region_event_tasks(events, tasks)
        out.append(found(met.filter("size(slow_tasks) > 0 or event = 'flush' and end - start >= 10000"), "store-region-event", "warning", region="region", event="event"))
    total = out[0]
    for x in out[1:]:
        total = total.unionByName(x)
    return total
