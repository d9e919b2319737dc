"""Threshold rules over log lines, data flows and cluster metrics. They give the same shape of findings as the rules over event logs.

hits: app, file, line, t, hit, fields, with kind of the file. steps: task steps. points: metric points of a run, keyed by app_id and attempt.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.extract import KEY
from .rules import finding

Tables = Mapping[str, DataFrame]
GIB = 1 << 30


def _at(df_file: str, df_line: str, text: Column) -> Column:
    return F.struct(F.col(df_file).alias("file"), F.col(df_line).cast("long").alias("line"), text.cast("string").alias("text"))


def _hits(t: Tables, kind: str) -> DataFrame:
    return t["hits"].filter(F.col("hit") == kind).withColumns({"app_id": F.coalesce("app", F.lit("")), "attempt": F.lit(1)})


def _first_per(df: DataFrame, keys: list[str]) -> DataFrame:
    """n and the first line of each key."""
    return df.groupBy(*KEY, *keys).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("t", "file", "line")).alias("at")).select(*KEY, *keys, "n", "at.*")


def out_of_memory(t: Tables) -> DataFrame:
    rows = _first_per(_hits(t, "out-of-memory").withColumn("what", F.col("fields")["what"]), ["what"])
    return finding(rows, "out-of-memory", "critical", "logs", _at("file", "line", F.col("what")), lines=F.col("n"))


def memory_kill(t: Tables) -> DataFrame:
    rows = _first_per(_hits(t, "memory-kill").withColumn("container", F.col("fields")["container"]), [])
    return finding(rows, "executor-memory-kill", "critical", "logs", _at("file", "line", F.lit("over a memory limit")), lines=F.col("n"))


def access_denied(t: Tables) -> DataFrame:
    rows = _first_per(_hits(t, "access-denied").withColumn("what", F.substring(F.col("fields")["what"], 1, 200)), ["what"])
    return finding(rows, "access-denied", "critical", "logs", _at("file", "line", F.col("what")), lines=F.col("n"))


def kerberos(t: Tables) -> DataFrame:
    rows = _first_per(_hits(t, "kerberos-failure"), [])
    return finding(rows, "kerberos-failure", "critical", "logs", _at("file", "line", F.lit("authentication failed")), lines=F.col("n"))


def classpath_clash(t: Tables) -> DataFrame:
    rows = _first_per(_hits(t, "class-missing").withColumn("name", F.translate(F.col("fields")["name"], "/", ".")), ["name"])
    return finding(rows, "classpath-clash", "critical", "logs", _at("file", "line", F.col("name")), name=F.col("name"), lines=F.col("n"))


def executor_lost(t: Tables) -> DataFrame:
    rows = _first_per(_hits(t, "executor-lost").withColumn("reason", F.col("fields")["reason"]), ["reason"])
    return finding(rows, "executor-lost", "warning", "logs", _at("file", "line", F.col("reason")), executors=F.col("n"))


_CAUSES = ("out-of-memory", "memory-kill", "access-denied", "kerberos-failure", "class-missing", "stage-failed", "executor-exit", "container-exit")


def first_failure(t: Tables) -> DataFrame:
    """The earliest line that can be the cause of an application's failure; of lines of one instant the likeliest kind."""
    rank = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(_CAUSES) for x in (k, i)]), F.col("hit"))
    rows = t["hits"].filter(F.col("hit").isin(*_CAUSES)).withColumns({"app_id": F.coalesce("app", F.lit("")), "attempt": F.lit(1), "place": rank})
    first = rows.withColumn("r", F.row_number().over(W.partitionBy(*KEY).orderBy(F.col("t").isNull(), "t", "place", "file", "line"))).filter("r = 1")
    if "applications" in t:
        failed = t["applications"].filter("state = 'failed'").select("app_id")
        first = first.join(failed, "app_id", "left_semi")
    return finding(first, "log-first-failure", "critical", "logs", _at("file", "line", F.col("hit")), kind=F.col("hit"))


def _flows(t: Tables) -> DataFrame:
    return t["steps"].withColumns({"app_id": F.coalesce("app", F.lit("")), "attempt": F.lit(1)})


def shuffle_network(t: Tables, least: int = GIB, times: float = 3.0) -> DataFrame:
    """Over a GiB fetched from other nodes; a warning if one executor fetched three times the upper median of the others."""
    per = _flows(t).filter("step = 'blocks' and remote > 0").groupBy(*KEY, "executor").agg(F.sum("remote").alias("remote"), F.max_by(F.struct("file", "line"), "remote").alias("at"))
    w = W.partitionBy(*KEY)
    ranked = per.withColumns({"place": F.row_number().over(w.orderBy("remote", "executor")), "n": F.count(F.lit(1)).over(w), "total": F.sum("remote").over(w)})
    others = F.expr("(n - 1) div 2 + 1")
    median = F.max(F.when(F.col("place") == others, F.col("remote"))).over(w)
    top = ranked.withColumn("median", F.when(F.col("n") > 1, median)).filter((F.col("place") == F.col("n")) & (F.col("total") >= least))
    level = F.when(F.col("remote") >= times * F.col("median"), "warning").otherwise("info")
    return finding(top.select("*", "at.*"), "shuffle-network", level, "flows", _at("file", "line", F.col("executor")), remote=F.col("total"), most=F.col("remote"), median=F.col("median"))


def broadcast_large(t: Tables, least: int = GIB // 2, slow_ms: int = 10_000) -> DataFrame:
    """The largest broadcast variable, where one is half a GiB or one read of it took ten seconds."""
    name = F.regexp_extract("name", r"(\d+)", 1)
    sizes = _flows(t).filter("step = 'stored' and name like 'broadcast\\_%' and name not like '%piece%'").groupBy(*KEY, name.alias("variable")).agg(F.max("bytes").alias("bytes"), F.min(F.struct("file", "line")).alias("at"), F.count_distinct("executor").alias("executors"))
    reads = _flows(t).filter("step = 'broadcast'").groupBy(*KEY, name.alias("variable")).agg(F.max("ms").alias("slowest"), F.sum("ms").alias("ms"))
    rows = sizes.join(reads, [*KEY, "variable"], "left").filter((F.col("bytes") >= least) | (F.col("slowest") >= slow_ms))
    one = rows.withColumn("r", F.row_number().over(W.partitionBy(*KEY).orderBy(F.desc("bytes"), "variable"))).filter("r = 1").select("*", "at.*")
    return finding(one, "broadcast-large", "warning", "flows", _at("file", "line", F.col("variable")), bytes=F.col("bytes"), executors=F.col("executors"), slowest_ms=F.col("slowest"))


def task_spill(t: Tables, least: int = GIB) -> DataFrame:
    rows = _flows(t).filter("step = 'spill'").groupBy(*KEY).agg(F.sum("bytes").alias("bytes"), F.max_by(F.struct("file", "line"), "bytes").alias("at")).filter(F.col("bytes") >= least).select("*", "at.*")
    return finding(rows, "task-spill", "warning", "flows", _at("file", "line", F.lit("the largest spill")), bytes=F.col("bytes"))


def cache_evicted(t: Tables) -> DataFrame:
    rows = _first_per(_hits(t, "not-cached"), [])
    return finding(rows, "cache-evicted", "warning", "flows", _at("file", "line", F.lit("a block found no room")), blocks=F.col("n"))


def commit_slow(t: Tables, share_: float = 0.2, least_ms: int = 60_000) -> DataFrame:
    """Commits took a fifth of the time of the tasks that committed, and a minute in all."""
    commits = _flows(t).filter("step = 'commit' and task_id is not null").groupBy(*KEY, "file", "task_id").agg(F.sum("ms").alias("commit_ms"), F.min("line").alias("line"))
    took = t["stories"].withColumns({"app_id": F.coalesce("app", F.lit("")), "attempt": F.lit(1)}).select(*KEY, "file", "task_id", F.expr("timestampdiff(MILLISECOND, started, ended)").alias("took"))
    rows = commits.join(took, [*KEY, "file", "task_id"]).groupBy(*KEY).agg(F.sum("commit_ms").alias("commit_ms"), F.sum("took").alias("took"), F.min(F.struct("file", "line")).alias("at"))
    rows = rows.filter((F.col("commit_ms") >= least_ms) & (F.col("commit_ms") >= share_ * F.col("took"))).select("*", "at.*")
    return finding(rows, "commit-slow", "warning", "flows", _at("file", "line", F.lit("commits")), commit_ms=F.col("commit_ms"), task_ms=F.col("took"))


def _series(t: Tables, name: str) -> DataFrame:
    return t["points"].filter(F.col("name") == name)


def _no_place(text: Column) -> Column:
    return F.struct(F.lit(None).cast("string").alias("file"), F.lit(None).cast("long").alias("line"), text.cast("string").alias("text"))


def waited_for_capacity(t: Tables) -> DataFrame:
    """Containers waited three minutes and a fifth of the run, or a minute and half of it. free_percent tells whether memory was free meanwhile."""
    runs = t["applications"].select(*KEY, F.col("duration_ms").alias("run_ms"))
    waits = _series(t, "ContainerPending").filter("v > 0").select(*KEY, "t", "v", "period_s")
    free = _series(t, "YARNMemoryAvailablePercentage").select(*KEY, "t", F.col("v").alias("free"))
    rows = waits.join(free, [*KEY, "t"], "left").groupBy(*KEY).agg(F.sum(F.col("period_s") * 1000).alias("wait"), F.max("v").alias("most"), F.avg("free").alias("free")).join(runs, list(KEY))
    rows = rows.withColumn("wait_ms", F.least("wait", "run_ms"))
    long = (F.col("wait_ms") >= 180_000) & (F.col("wait_ms") >= 0.2 * F.col("run_ms")) | (F.col("wait_ms") >= 60_000) & (F.col("wait_ms") >= 0.5 * F.col("run_ms"))
    variant = F.when(F.col("free") >= 25, "fragmented").otherwise("full")
    return finding(rows.filter(long), "waited-for-capacity", "warning", "nodes", _no_place(variant), wait_ms=F.col("wait_ms"), most=F.col("most"), free_percent=F.col("free"), variant=variant)


def shared_cluster(t: Tables) -> DataFrame:
    rows = _series(t, "AppsRunning").groupBy(*KEY).agg(F.max("v").alias("apps")).filter("apps > 1")
    return finding(rows, "shared-cluster", "info", "nodes", _no_place(F.lit("applications at once")), apps=F.col("apps"))


def host_cpu(t: Tables, least: float = 85.0) -> DataFrame:
    rows = _series(t, "CPUUtilization").groupBy(*KEY, "scope").agg(F.avg("v").alias("avg"), F.max("v").alias("peak")).filter(F.col("avg") >= least)
    return finding(rows, "host-cpu-saturated", "warning", "cpu", _no_place(F.col("scope")), node=F.col("scope"), average=F.col("avg"), peak=F.col("peak"))


def host_memory(t: Tables, least: float = 95.0) -> DataFrame:
    rows = _series(t, "mem_used_percent").groupBy(*KEY, "scope").agg(F.max("v").alias("peak")).filter(F.col("peak") >= least)
    return finding(rows, "host-memory-pressure", "warning", "memory", _no_place(F.col("scope")), node=F.col("scope"), peak=F.col("peak"))


LOG_RULES: dict[Callable[..., DataFrame], tuple[str, ...]] = {
    first_failure: ("hits",), out_of_memory: ("hits",), memory_kill: ("hits",), access_denied: ("hits",), kerberos: ("hits",), classpath_clash: ("hits",), executor_lost: ("hits",), cache_evicted: ("hits",),
    shuffle_network: ("steps",), broadcast_large: ("steps",), task_spill: ("steps",), commit_slow: ("steps", "stories"),
    waited_for_capacity: ("points", "applications"), shared_cluster: ("points",), host_cpu: ("points",), host_memory: ("points",),
}


def log_findings(tables: Tables) -> DataFrame | None:
    """Findings of all rules whose tables are there."""
    out = None
    for rule, needs in LOG_RULES.items():
        if all(n in tables for n in needs):
            one = rule(tables)
            out = one if out is None else out.unionByName(one)
    return out
