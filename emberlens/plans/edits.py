"""Rules that change other rules' findings: evidence added, a finding replaced or pointed at another, and the order in which findings are read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.extract import KEY

#: Rules in the order in which findings of one severity are read: what broke the run, what slowed it, then what may be tuned. Others come last.
PRIORITY = (
    "log-first-failure", "job-failed", "step-failed", "bootstrap-failed", "executor-memory-kill", "out-of-memory", "classpath-clash", "access-denied", "kerberos-failure", "executor-lost", "spot-interrupted", "app-retried",
    "waited-for-capacity", "executor-fit", "idle-nodes", "host-memory-pressure", "host-cpu-saturated", "executor-decommissioned", "stage-retried", "store-scan-skew", "store-region-event", "store-retried-region", "store-server-load",
    "store-repeated-scan", "store-hotspot", "store-full-scan", "store-tiny-regions", "cache-evicted", "shuffle-network", "task-spill", "commit-slow", "broadcast-large", "access-static-keys", "stage-skew", "memory-spill", "memory-gc-pressure",
    "memory-heap-near-limit", "config-unlimited-result", "config-dynalloc-no-shuffle",
)
#: The rules that tell of executors that went, and the log kinds that tell why one did.
GONE = ("executor-lost", "executor-memory-kill", "executor-decommissioned")
CAUSES = ("out-of-memory", "memory-kill", "access-denied", "class-missing", "executor-exit", "executor-lost", "kerberos-failure")


def own_errors(hits: DataFrame) -> DataFrame:
    """app_id, executor, hit, file, line, text: the last line of each executor's own log that may tell why it went. hits: app, executor, file, line, hit, text."""
    told = hits.filter(F.col("hit").isin(*CAUSES) & F.col("executor").isNotNull() & ~F.col("executor").isin("driver", "am"))
    return told.groupBy(F.col("app").alias("app_id"), "executor").agg(F.max_by(F.struct("hit", "file", "line", "text"), F.struct("line", "file")).alias("x")).select("app_id", "executor", "x.*")


def with_own_errors(findings: DataFrame, errors: DataFrame, arg: str = "executor") -> DataFrame:
    """Findings of executors that went, each with the last error of that executor's own log as evidence more, and the heap named as the cause where a kill was the JVM's own.

    An executor's error goes to the first of GONE that names it. Findings that name no executor, and those of other rules, stay as they are.
    """
    rank = F.array_position(F.array(*[F.lit(r) for r in GONE]), F.col("rule"))
    rows = findings.withColumn("_of", F.when(rank > 0, F.col("args")[arg])).withColumn("_first", F.row_number().over(W.partitionBy("app_id", "_of").orderBy(F.when(rank > 0, rank), F.to_json("args"))))
    told = errors.select(F.col("app_id").alias("_app"), F.col("executor").alias("_executor"), F.col("hit").alias("_hit"), F.struct(F.col("file"), F.col("line").cast("bigint").alias("line"), F.concat(F.lit("its own log: "), "text").alias("text")).alias("_more"))
    joined = rows.join(told, (F.col("app_id") == F.col("_app")) & (F.col("_of") == F.col("_executor")) & (F.col("_first") == 1), "left")
    evidence = F.when(F.col("_more").isNotNull(), F.concat("evidence", F.array("_more"))).otherwise(F.col("evidence"))
    heap = (F.col("rule") == "executor-memory-kill") & (F.col("_hit") == "out-of-memory")
    args = F.when(heap, F.map_concat("args", F.create_map(F.lit("cause"), F.lit("heap")))).otherwise(F.col("args"))
    return joined.withColumns({"evidence": evidence, "args": args}).select(*findings.columns)


def replaced(findings: DataFrame, rule: str, by: str) -> DataFrame:
    """Where an application has findings of both rules, those of rule are dropped, and their evidence goes to the first of by, which names how many there were. Else nothing changes."""
    first = F.row_number().over(W.partitionBy(*KEY).orderBy(F.to_json("args")))
    new = findings.filter(F.col("rule") == by).withColumn("_n", first)
    order = F.array_sort(F.collect_list(F.struct(F.to_json("args").alias("a"), "evidence")))
    old = findings.filter(F.col("rule") == rule).groupBy(*KEY).agg(F.transform(order, lambda x: x["evidence"]).alias("_old"), F.count(F.lit(1)).alias("_k")).withColumn("_at", F.lit(1))
    taken = new.join(old.withColumnRenamed("_at", "_n"), [*KEY, "_n"], "left")
    evidence = F.concat("evidence", F.coalesce(F.flatten("_old"), F.array().cast(findings.schema["evidence"].dataType)))
    args = F.when(F.col("_k").isNotNull(), F.map_concat("args", F.create_map(F.lit(f"instead of {rule}"), F.col("_k").cast("string")))).otherwise(F.col("args"))
    stays = findings.filter(F.col("rule") == rule).join(new.select(*KEY).distinct(), list(KEY), "left_anti")
    rest = findings.filter(~F.col("rule").isin(rule, by))
    return rest.unionByName(taken.withColumns({"evidence": evidence, "args": args}).select(*findings.columns)).unionByName(stays)


def pointed(findings: DataFrame, rule: str, to: str) -> DataFrame:
    """Findings of rule whose application has one of to as well name it, as its cure is theirs."""
    others = findings.filter(F.col("rule") == to).select(*KEY, F.lit(True).alias("_to")).distinct()
    args = F.when((F.col("rule") == rule) & F.col("_to"), F.map_concat("args", F.create_map(F.lit("see"), F.lit(to)))).otherwise(F.col("args"))
    return findings.join(others, list(KEY), "left").withColumn("args", args).select(*findings.columns)


def ranked(findings: DataFrame, priority: Sequence[str] = PRIORITY) -> DataFrame:
    """findings with rank from 1 per application: by severity, then the rule's place in priority, then what they name."""
    level = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    place = F.array_position(F.array(*[F.lit(r) for r in priority]), F.col("rule"))
    order = W.partitionBy(*KEY).orderBy(level, F.when(place > 0, place).otherwise(len(priority) + 1), "rule", F.to_json("args"), F.to_json("evidence"))
    return findings.withColumn("rank", F.row_number().over(order).cast("long"))


def store_shape(found: DataFrame) -> DataFrame:
    """Findings of the region store (app, rule, severity, args) in the shape of all others."""
    return found.select(F.col("app").alias("app_id"), F.lit(1).alias("attempt"), "rule", "severity", F.lit("store").alias("section"), "args", F.array().cast("array<struct<file:string,line:bigint,text:string>>").alias("evidence"))


def all_findings(parts: Sequence[DataFrame], hits: DataFrame | None = None) -> DataFrame:
    """All rules' findings in one: unranked parts of one shape joined, edited in order, and ranked.

    The edits: executors' own errors go to the findings of their end; applications that share the cluster take the place of idle nodes; idle nodes point at executors that don't fit.
    """
    out = parts[0].drop("rank")
    for p in parts[1:]:
        out = out.unionByName(p.drop("rank"))
    if hits is not None:
        out = with_own_errors(out, own_errors(hits))
    out = replaced(out, "idle-nodes", "shared-cluster")
    return ranked(pointed(out, "idle-nodes", "executor-fit"))
