"""What plans say: data read and written, rule times of the optimizer, and where a stage's time went."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import data_folder, redact_text
from .extract import KEY
from .timesplit import fitted_parts

#: Names of plan nodes that write data.
WRITES = (
    "AppendData", "AtomicCreateTableAsSelect", "AtomicReplaceTableAsSelect", "CreateDataSourceTableAsSelectCommand", "CreateHiveTableAsSelectCommand", "CreateTableAsSelect",
    "InsertIntoDataSourceCommand", "InsertIntoDataSourceDirCommand", "InsertIntoHadoopFsRelationCommand", "InsertIntoHiveDirCommand", "InsertIntoHiveTable",
    "OptimizedCreateHiveTableAsSelectCommand", "OverwriteByExpression", "OverwritePartitionsDynamic", "ReplaceData", "ReplaceTableAsSelect", "SaveIntoDataSourceCommand",
    "WriteDelta", "WriteToDataSourceV2",
)
_NOT_DATA = ("", "ExistingRDD", "OneRowRelation", "In-memory")


def plan_data_refs(nodes: DataFrame, plans: DataFrame) -> DataFrame:
    """access, kind, name, format and node of the tables and paths that each query's plan reads and writes, once each.

    A scan names its table, its JDBC relation or, in its metadata, its path; scans of memory aren't data. A write's target is in its text or, where
    that is bare, on the node's line of arguments in the formatted plan.
    """
    command = F.regexp_replace("name", "^Execute ", "")
    # One pass over the nodes, as they come out of Python; the texts of plans, which have no bound, are never broadcast.
    texts = plans.filter("plan_text is not null").select(*KEY, "execution_id", "plan_text").hint("merge")
    wanted = nodes.withColumn("command", command).withColumn("scans", F.col("name").startswith("Scan ")).filter(F.col("scans") | F.col("command").isin(*WRITES))
    rows = wanted.select(*KEY, "execution_id", "name", "text", "metadata", "command", "scans").join(texts, [*KEY, "execution_id"], "left")
    rows = rows.withColumn("format", F.regexp_extract("name", r"^Scan (\S*)", 1)).withColumn("target", F.trim(F.regexp_extract("name", r"^Scan \S* ?(.*)$", 1)))
    jdbc = F.regexp_extract("format", r"^JDBCRelation\((.*?)\)?$", 1)
    path = F.regexp_extract(F.coalesce(F.col("metadata")["Location"], F.lit("")), r"\[([^\[\]]+)\]\s*$", 1)
    named = (F.col("target") != "") & ~F.col("target").startswith("[")
    read = F.struct(
        F.lit("read").alias("access"), F.when((jdbc != "") | named, "table").when(path != "", "path").alias("kind"), F.when(jdbc != "", jdbc).when(named, F.col("target")).otherwise(path).alias("name"),
        F.when(jdbc != "", "jdbc").otherwise(F.lower("format")).alias("format"), F.col("name").alias("node_name"),
    )
    is_read = ~F.col("format").isin(*_NOT_DATA) & ((jdbc != "") | ~F.col("format").contains("("))
    own = F.trim(F.expr("substring(text, length(name) + 1)"))
    after = F.expr("substring(plan_text, locate(concat(') ', name, '\n'), plan_text))")
    line = F.when(F.expr("locate(concat(') ', name, '\n'), plan_text) > 0"), F.regexp_extract(after, r"Arguments: ([^\n]*)", 1)).otherwise("")
    rows = rows.withColumn("args", F.when(~F.col("scans"), F.when(own != "", own).otherwise(line)))
    table = F.regexp_replace(F.regexp_extract("args", r"(`[^`]+`(?:\.`[^`]+`)*)", 1), "`", "")
    to_path = F.col("command") == "InsertIntoHadoopFsRelationCommand"
    rest = F.regexp_replace(F.regexp_replace("args", r"^[^,]*, [^,]*, ", ""), r"^\[[^\]]*\], ", "")
    write = F.struct(
        F.lit("write").alias("access"), F.when(table != "", "table").otherwise("path").alias("kind"), F.when(table != "", table).otherwise(F.regexp_extract("args", r"^([^,]*)", 1)).alias("name"),
        F.when((table == "") & to_path, F.lower(F.regexp_extract(rest, r"^([^,]*)", 1))).alias("format"), F.col("name").alias("node_name"),
    )
    ref = F.when(F.col("scans"), F.when(is_read, read)).otherwise(F.when((table != "") | to_path, write))
    refs = rows.select(*KEY, "execution_id", F.inline(F.array_compact(F.array(ref)))).filter("name is not null and name <> ''").withColumn("name", redact_text(F.col("name")))
    return refs.dropDuplicates([*KEY, "execution_id", "access", "kind", "name"])


def stage_data(stage_events: DataFrame, refs: DataFrame, job_stage: DataFrame) -> DataFrame:
    """Data of plans at the stages that have the plan's node among their RDDs' operations; a write without one at its query's last stage."""
    ops = stage_events.select(*KEY, "stage_id", F.explode("rdds").alias("r")).select(*KEY, "stage_id", F.get_json_object("r.Scope", "$.name").alias("node_name")).filter("node_name is not null").distinct()
    mine = ops.join(job_stage.select(*KEY, "stage_id", "execution_id").distinct(), [*KEY, "stage_id"])
    at = refs.join(mine, [*KEY, "execution_id", "node_name"], "left")
    final = job_stage.groupBy(*KEY, "execution_id").agg(F.max("stage_id").alias("final"))
    placed = at.join(final, [*KEY, "execution_id"], "left").withColumn("stage_id", F.coalesce("stage_id", F.when(F.col("access") == "write", F.col("final"))))
    folder = F.when((F.col("kind") == "path") & F.col("name").rlike(r"/[^/]*\.[A-Za-z0-9]+$"), data_folder(F.col("name"))).otherwise(F.col("name"))
    return placed.filter("stage_id is not null").select(*KEY, "stage_id", "access", "kind", folder.alias("name"), "format").distinct()


def optimizer_rules(events: DataFrame, most: int = 300) -> DataFrame:
    """Rule times of a query's optimizer report, slowest first: name, ns, runs and useful runs; and per query in total, how many rules ran and how many did something."""
    rows = events.filter(F.col("event").endswith("QueryExecutionMetrics") | F.col("value").contains('"timePerRule"'))
    e = F.from_json("value", "executionId string, timePerRule map<string,bigint>, numRunsPerRule map<string,bigint>, numEffectiveRunsPerRule map<string,bigint>")
    flat = rows.withColumn("e", e).select(*KEY, F.expr("try_cast(e.executionId as bigint)").alias("execution_id"), F.col("e.numRunsPerRule").alias("r"), F.col("e.numEffectiveRunsPerRule").alias("u"), F.explode("e.timePerRule").alias("rule", "ns"))
    each = flat.filter("execution_id is not null").select(*KEY, "execution_id", "rule", "ns", F.col("r")[F.col("rule")].alias("runs"), F.coalesce(F.col("u")[F.col("rule")], F.lit(0)).alias("useful"))
    from .distributions import top_k

    totals = each.groupBy(*KEY, "execution_id").agg(F.sum("ns").alias("total_ns"), F.count(F.lit(1)).alias("rules_run"), F.count_if(F.col("useful") > 0).alias("rules_useful"))
    return top_k(each, [*KEY, "execution_id"], [F.desc("ns"), F.asc("rule")], most).join(totals, [*KEY, "execution_id"])


def time_split(totals: DataFrame, keys: list[str]) -> DataFrame:
    """Eight parts of task time: before and after the task, unpacking, CPU, collection, fetching, writing, results, and the rest. Parts of run time that overlap are scaled to fit it."""
    at_least = lambda c: F.greatest(c, F.lit(0).cast("long"))
    rows = totals.select(
        *keys, at_least(F.col("scheduler_delay_ms")).alias("delay_ms"), at_least(F.col("deser_ms")).alias("unpack_ms"), (at_least(F.col("result_ser_ms")) + at_least(F.col("getting_ms"))).alias("result_ms"), at_least(F.col("run_ms")).alias("run_ms"),
        at_least(F.expr("cpu_ns div 1000000")).alias("compute_ms"), at_least(F.col("gc_ms")).alias("gc_ms"), at_least(F.col("fetch_wait_ms")).alias("fetch_ms"), at_least(F.expr("shuffle_write_ns div 1000000")).alias("write_ms"),
    )
    return fitted_parts(rows, "run_ms", ["compute_ms", "gc_ms", "fetch_ms", "write_ms"], "other_ms")
