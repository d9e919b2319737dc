"""Typed tables of listener events: each takes the lines of one event and reads the fields in use.

Field names are those of Spark's public JSON event format. Every table begins with app_id, attempt, file and line.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = ("app_id", "attempt")
PLACE = (*KEY, "part", "file", "line")
#: Gauges of an executor's memory, as events name them.
GAUGES = (
    "JVMHeapMemory", "JVMOffHeapMemory", "OnHeapExecutionMemory", "OffHeapExecutionMemory", "OnHeapStorageMemory", "OffHeapStorageMemory", "OnHeapUnifiedMemory",
    "OffHeapUnifiedMemory", "DirectPoolMemory", "MappedPoolMemory", "ProcessTreeJVMVMemory", "ProcessTreeJVMRSSMemory", "ProcessTreePythonVMemory",
    "ProcessTreePythonRSSMemory", "ProcessTreeOtherVMemory", "ProcessTreeOtherRSSMemory", "MinorGCCount", "MinorGCTime", "MajorGCCount", "MajorGCTime", "TotalGCTime",
)
_GAUGES = ", ".join(f"{g}: bigint" for g in GAUGES)
_TASK_INFO = (
    "`Task ID`: bigint, `Index`: int, `Attempt`: int, `Partition ID`: int, `Launch Time`: bigint, `Finish Time`: bigint, `Getting Result Time`: bigint, `Executor ID`: string, "
    "`Host`: string, `Locality`: string, `Speculative`: boolean, `Failed`: boolean, `Killed`: boolean, `Accumulables`: array<struct<ID: bigint, Name: string, `Update`: string, Metadata: string>>"
)
_REASON = "Reason: string, `Class Name`: string, Description: string, `Kill Reason`: string, `Executor ID`: string, `Loss Reason`: string, Message: string, `Full Stack Trace`: string, `Exit Caused By App`: boolean"
#: Counters of a task: column, path in Task Metrics. Times in ms, but for those ending in _ns.
COUNTERS = {
    "run_ms": "`Executor Run Time`", "cpu_ns": "`Executor CPU Time`", "gc_ms": "`JVM GC Time`", "deser_ms": "`Executor Deserialize Time`", "deser_cpu_ns": "`Executor Deserialize CPU Time`",
    "result_bytes": "`Result Size`", "result_ser_ms": "`Result Serialization Time`", "peak_exec_mem": "`Peak Execution Memory`", "mem_spill": "`Memory Bytes Spilled`", "disk_spill": "`Disk Bytes Spilled`",
    "input_bytes": "`Input Metrics`.`Bytes Read`", "input_records": "`Input Metrics`.`Records Read`", "output_bytes": "`Output Metrics`.`Bytes Written`", "output_records": "`Output Metrics`.`Records Written`",
    "fetch_wait_ms": "`Shuffle Read Metrics`.`Fetch Wait Time`", "shuffle_remote_bytes": "`Shuffle Read Metrics`.`Remote Bytes Read`", "shuffle_local_bytes": "`Shuffle Read Metrics`.`Local Bytes Read`",
    "shuffle_read_records": "`Shuffle Read Metrics`.`Total Records Read`", "shuffle_local_blocks": "`Shuffle Read Metrics`.`Local Blocks Fetched`", "shuffle_remote_blocks": "`Shuffle Read Metrics`.`Remote Blocks Fetched`",
    "shuffle_remote_to_disk": "`Shuffle Read Metrics`.`Remote Bytes Read To Disk`", "shuffle_remote_req_ms": "`Shuffle Read Metrics`.`Remote Requests Duration`",
    "shuffle_write_bytes": "`Shuffle Write Metrics`.`Shuffle Bytes Written`", "shuffle_write_records": "`Shuffle Write Metrics`.`Shuffle Records Written`", "shuffle_write_ns": "`Shuffle Write Metrics`.`Shuffle Write Time`",
}
_METRICS = (
    "`Executor Run Time`: bigint, `Executor CPU Time`: bigint, `JVM GC Time`: bigint, `Executor Deserialize Time`: bigint, `Executor Deserialize CPU Time`: bigint, `Result Size`: bigint, "
    "`Result Serialization Time`: bigint, `Peak Execution Memory`: bigint, `Memory Bytes Spilled`: bigint, `Disk Bytes Spilled`: bigint, `Input Metrics`: struct<`Bytes Read`: bigint, `Records Read`: bigint>, "
    "`Output Metrics`: struct<`Bytes Written`: bigint, `Records Written`: bigint>, `Shuffle Read Metrics`: struct<`Fetch Wait Time`: bigint, `Remote Bytes Read`: bigint, `Local Bytes Read`: bigint, "
    "`Total Records Read`: bigint, `Local Blocks Fetched`: bigint, `Remote Blocks Fetched`: bigint, `Remote Bytes Read To Disk`: bigint, `Remote Requests Duration`: bigint>, "
    "`Shuffle Write Metrics`: struct<`Shuffle Bytes Written`: bigint, `Shuffle Records Written`: bigint, `Shuffle Write Time`: bigint>"
)
_RDD = (
    "`RDD ID`: int, Name: string, Scope: string, `Parent IDs`: array<int>, Callsite: string, `Number of Partitions`: int, `Number of Cached Partitions`: int, `Memory Size`: bigint, `Disk Size`: bigint, Barrier: boolean, "
    "DeterministicLevel: string, `Storage Level`: struct<`Use Disk`: boolean, `Use Memory`: boolean, `Use Off Heap`: boolean, Deserialized: boolean, Replication: int>"
)
_STAGE = (
    "`Stage ID`: int, `Stage Attempt ID`: int, `Stage Name`: string, `Number of Tasks`: int, `Parent IDs`: array<int>, `Submission Time`: bigint, `Completion Time`: bigint, `Failure Reason`: string, Details: string, "
    f"`Resource Profile Id`: int, `RDD Info`: array<struct<{_RDD}>>, Accumulables: array<struct<ID: bigint, Name: string, Value: string, Metadata: string>>"
)


def _fields(schema: str, exprs: Sequence[str]) -> T.StructType:
    """Those fields of schema that SQL expressions on e name."""
    paths = {tuple(a or b for a, b in re.findall(r"`([^`]+)`|(\w+)", x)) for e in exprs for x in re.findall(r"\be((?:\.(?:`[^`]+`|\w+))+)", e)}

    def cut(kind: T.StructType, at: tuple[str, ...]) -> T.StructType:
        named = [f for f in kind if any(x[: len(at) + 1] == (*at, f.name) for x in paths)]
        return T.StructType([f if (*at, f.name) in paths else T.StructField(f.name, cut(f.dataType, (*at, f.name))) for f in named])

    return cut(T.StructType.fromDDL(schema), ())


def _of(events: DataFrame, name: str, schema: str | T.StructType) -> DataFrame:
    """PLACE and the parsed line as e. It is generated from a list of one: a filter on its fields, or one that a join infers, would else be moved below and parse each line once more for each field."""
    return events.filter(F.col("event") == name).select(*PLACE, F.explode(F.array(F.from_json("value", schema))).alias("e"))


def _time(c: Column) -> Column:
    """Epoch milliseconds; what isn't above 0 is absent."""
    return F.when(c > 0, c)


def task_ends(events: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per finished task attempt: status, times, counters, gauges, failure. scheduler_delay_ms is what none of the task's own parts explains. Where columns are named, only the fields behind them are parsed."""
    info, reason = "e.`Task Info`", "e.`Task End Reason`"
    above = lambda x: f"case when {x} > 0 then {x} end"
    exprs = {
        "stage_id": "e.`Stage ID`",
        "stage_attempt": "e.`Stage Attempt ID`",
        "task_type": "e.`Task Type`",
        "task_id": f"{info}.`Task ID`",
        "task_index": f"{info}.`Index`",
        "task_attempt": f"{info}.`Attempt`",
        "partition_id": f"coalesce({info}.`Partition ID`, {info}.`Index`)",
        "executor_id": f"{info}.`Executor ID`",
        "host": f"{info}.`Host`",
        "locality": f"{info}.`Locality`",
        "speculative": f"{info}.`Speculative`",
        "launched": above(f"{info}.`Launch Time`"),
        "finished": above(f"{info}.`Finish Time`"),
        "getting_ms": f"coalesce(case when {info}.`Getting Result Time` > 0 then {info}.`Finish Time` - {info}.`Getting Result Time` end, 0)",
        "status": f"case when {reason}.`Reason` = 'Success' then 'succeeded' when {info}.`Killed` or {reason}.`Reason` = 'TaskKilled' then 'killed' else 'failed' end",
        "reason": reason,
        "gauges": "e.`Task Executor Metrics`",
        "accumulables": f"{info}.`Accumulables`",
        **{name: f"coalesce(e.`Task Metrics`.{path}, 0L)" for name, path in COUNTERS.items()},
    }
    took = F.greatest(F.lit(0).cast("long"), F.coalesce(F.col("finished") - F.col("launched"), F.lit(0).cast("long")))
    spent = F.col("run_ms") + F.col("deser_ms") + F.col("result_ser_ms") + F.col("getting_ms")
    sums = {"duration_ms": took, "scheduler_delay_ms": F.greatest(F.lit(0).cast("long"), took - spent)}
    parts = {"duration_ms": ("launched", "finished"), "scheduler_delay_ms": ("launched", "finished", "run_ms", "deser_ms", "result_ser_ms", "getting_ms")}
    columns = columns or (*exprs, *sums)
    behind = {x for c in columns for x in parts.get(c, (c,))}
    schema = f"`Stage ID` int, `Stage Attempt ID` int, `Task Type` string, `Task End Reason` struct<{_REASON}>, `Task Info` struct<{_TASK_INFO}>, `Task Metrics` struct<{_METRICS}>, `Task Executor Metrics` struct<{_GAUGES}>"
    used = {c: e for c, e in exprs.items() if c in behind}
    rows = _of(events, "SparkListenerTaskEnd", _fields(schema, tuple(used.values()))).select(*PLACE, *[F.expr(e).alias(c) for c, e in used.items()])
    return rows.withColumns({c: e for c, e in sums.items() if c in columns}).select(*PLACE, *columns)


def task_starts(events: DataFrame) -> DataFrame:
    rows = _of(events, "SparkListenerTaskStart", f"`Stage ID` int, `Stage Attempt ID` int, `Task Info` struct<{_TASK_INFO}>")
    info = "e.`Task Info`"
    return rows.select(
        *PLACE, F.col("e.`Stage ID`").alias("stage_id"), F.col("e.`Stage Attempt ID`").alias("stage_attempt"), F.col(f"{info}.`Task ID`").alias("task_id"), F.col(f"{info}.Index").alias("task_index"),
        F.col(f"{info}.`Executor ID`").alias("executor_id"), F.col(f"{info}.Host").alias("host"), _time(F.col(f"{info}.`Launch Time`")).alias("launched"),
    )


def stage_events(events: DataFrame) -> DataFrame:
    """Submissions and completions of stage attempts, with their RDDs."""
    both = events.filter(F.col("event").isin("SparkListenerStageSubmitted", "SparkListenerStageCompleted"))
    rows = both.select(*PLACE, (F.col("event") == "SparkListenerStageCompleted").alias("completed_event"), F.from_json("value", f"`Stage Info` struct<{_STAGE}>, Properties map<string,string>").alias("e"))
    i = "e.`Stage Info`"
    return rows.select(
        *PLACE, "completed_event", F.col(f"{i}.`Stage ID`").alias("stage_id"), F.col(f"{i}.`Stage Attempt ID`").alias("stage_attempt"), F.col(f"{i}.`Stage Name`").alias("name"),
        F.col(f"{i}.`Number of Tasks`").alias("num_tasks"), F.col(f"{i}.`Parent IDs`").alias("parents"), _time(F.col(f"{i}.`Submission Time`")).alias("submitted"),
        _time(F.col(f"{i}.`Completion Time`")).alias("completed"), F.col(f"{i}.`Failure Reason`").alias("failure"), F.col(f"{i}.Details").alias("details"),
        F.col(f"{i}.`RDD Info`").alias("rdds"), F.col("e.Properties").alias("props"),
    )


def job_starts(events: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per start of a job. Where columns are named, only the fields behind them are parsed."""
    schema = "`Job ID` int, `Submission Time` bigint, `Stage IDs` array<int>, `Stage Infos` array<struct<`Stage ID`: int, `Stage Name`: string, `Number of Tasks`: int, `Parent IDs`: array<int>, Details: string>>, Properties map<string,string>"
    exprs = {
        "job_id": "e.`Job ID`", "submitted": "case when e.`Submission Time` > 0 then e.`Submission Time` end", "stage_ids": "e.`Stage IDs`", "stage_infos": "e.`Stage Infos`",
        "props": "e.Properties", "execution_id": "cast(element_at(e.Properties, 'spark.sql.execution.id') as bigint)",
    }
    used = {c: exprs[c] for c in columns or exprs}
    return _of(events, "SparkListenerJobStart", _fields(schema, tuple(used.values()))).select(*PLACE, *[F.expr(e).alias(c) for c, e in used.items()])


def job_ends(events: DataFrame) -> DataFrame:
    rows = _of(events, "SparkListenerJobEnd", "`Job ID` int, `Completion Time` bigint, `Job Result` struct<Result: string, Exception: struct<Message: string>>")
    return rows.select(*PLACE, F.col("e.`Job ID`").alias("job_id"), _time(F.col("e.`Completion Time`")).alias("completed"), F.col("e.`Job Result`.Result").alias("result"), F.col("e.`Job Result`.Exception.Message").alias("message"))


def executors_added(events: DataFrame) -> DataFrame:
    """startup_ms: from request to registration, where both are known and in order."""
    rows = _of(
        events, "SparkListenerExecutorAdded",
        "Timestamp bigint, `Executor ID` string, `Executor Info` struct<Host: string, `Total Cores`: int, `Resource Profile Id`: int, `Log Urls`: map<string,string>, Attributes: map<string,string>, `Request Time`: bigint, `Registration Time`: bigint>",
    )
    i = "e.`Executor Info`"
    wait = F.col(f"{i}.`Registration Time`") - F.col(f"{i}.`Request Time`")
    return rows.select(
        *PLACE, _time(F.col("e.Timestamp")).alias("t"), F.col("e.`Executor ID`").alias("executor_id"), F.col(f"{i}.Host").alias("host"), F.col(f"{i}.`Total Cores`").alias("cores"),
        F.col(f"{i}.`Resource Profile Id`").alias("profile"), F.col(f"{i}.Attributes").alias("attributes"), F.col(f"{i}.`Log Urls`").alias("log_urls"), F.when(wait >= 0, wait).alias("startup_ms"),
    )


def executors_removed(events: DataFrame) -> DataFrame:
    from ..functions.text import removal_kind

    rows = _of(events, "SparkListenerExecutorRemoved", "Timestamp bigint, `Executor ID` string, `Removed Reason` string")
    return rows.select(*PLACE, _time(F.col("e.Timestamp")).alias("t"), F.col("e.`Executor ID`").alias("executor_id"), F.col("e.`Removed Reason`").alias("reason"), removal_kind(F.col("e.`Removed Reason`")).alias("kind"))


def block_managers(events: DataFrame) -> DataFrame:
    both = events.filter(F.col("event").isin("SparkListenerBlockManagerAdded", "SparkListenerBlockManagerRemoved"))
    rows = both.select(*PLACE, (F.col("event") == "SparkListenerBlockManagerAdded").alias("added"), F.from_json("value", "`Block Manager ID` struct<`Executor ID`: string, Host: string>, Timestamp bigint, `Maximum Onheap Memory` bigint, `Maximum Offheap Memory` bigint").alias("e"))
    return rows.select(*PLACE, "added", _time(F.col("e.Timestamp")).alias("t"), F.col("e.`Block Manager ID`.`Executor ID`").alias("executor_id"), F.col("e.`Block Manager ID`.Host").alias("host"), F.col("e.`Maximum Onheap Memory`").alias("on_heap"), F.col("e.`Maximum Offheap Memory`").alias("off_heap"))


def resource_profiles(events: DataFrame) -> DataFrame:
    rows = _of(events, "SparkListenerResourceProfileAdded", "`Resource Profile Id` int, `Executor Resource Requests` map<string, struct<Amount: bigint>>, `Task Resource Requests` map<string, struct<Amount: double>>")
    wanted = lambda k: F.col("e.`Executor Resource Requests`")[k]["Amount"]
    return rows.select(*PLACE, F.col("e.`Resource Profile Id`").alias("profile"), wanted("cores").alias("cores"), wanted("memory").alias("memory_mb"), wanted("memoryOverhead").alias("overhead_mb"), wanted("pyspark.memory").alias("python_mb"), wanted("offHeap").alias("off_heap_mb"), F.col("e.`Task Resource Requests`")["cpus"]["Amount"].alias("task_cpus"))


def settings(events: DataFrame) -> DataFrame:
    """section, key and value of the environment, secrets masked; an application's last such event counts."""
    from ..functions.text import MASK, is_sensitive, redact_text

    sections = {"jvm": "JVM Information", "spark": "Spark Properties", "hadoop": "Hadoop Properties", "system": "System Properties", "classpath": "Classpath Entries"}
    rows = _of(events, "SparkListenerEnvironmentUpdate", ", ".join(f"`{s}` map<string,string>" for s in sections.values()))
    last = rows.groupBy(*KEY).agg(F.max_by("e", F.struct("part", "line")).alias("e"), F.max(F.struct("part", "file", "line")).alias("src"))
    def entries(section: str, name: str) -> Column:
        pairs = F.map_entries(F.coalesce(F.col(f"e.`{name}`"), F.create_map().cast("map<string,string>")))
        return F.transform(pairs, lambda x: F.struct(F.lit(section).alias("section"), x["key"].alias("key"), x["value"].alias("value")))

    flat = F.concat(*[entries(s, name) for s, name in sections.items()])
    kv = last.select(*KEY, "src.*", F.inline(flat))
    hidden = is_sensitive(F.col("key"))
    return kv.withColumn("redacted", hidden).withColumn("value", F.when(hidden, MASK).otherwise(redact_text(F.col("value"))))


def app_starts(events: DataFrame) -> DataFrame:
    rows = _of(events, "SparkListenerApplicationStart", "`App Name` string, `App ID` string, Timestamp bigint, User string, `App Attempt ID` string, `Driver Logs` map<string,string>, `Driver Attributes` map<string,string>")
    return rows.select(*PLACE, F.col("e.`App Name`").alias("name"), F.col("e.`App ID`").alias("own_id"), _time(F.col("e.Timestamp")).alias("t"), F.col("e.User").alias("user"), F.col("e.`App Attempt ID`").alias("own_attempt"))


def app_ends(events: DataFrame) -> DataFrame:
    rows = _of(events, "SparkListenerApplicationEnd", "Timestamp bigint, ExitCode int")
    return rows.select(*PLACE, _time(F.col("e.Timestamp")).alias("t"), F.col("e.ExitCode").alias("exit_code"))


def block_updates(events: DataFrame) -> DataFrame:
    level = "`Storage Level`: struct<`Use Disk`: boolean, `Use Memory`: boolean, `Use Off Heap`: boolean, Deserialized: boolean, Replication: int>"
    rows = _of(events, "SparkListenerBlockUpdated", f"`Block Updated Info` struct<`Block Manager ID`: struct<`Executor ID`: string, Host: string>, `Block ID`: string, `Memory Size`: bigint, `Disk Size`: bigint, {level}>")
    i = "e.`Block Updated Info`"
    return rows.select(*PLACE, F.col(f"{i}.`Block Manager ID`.`Executor ID`").alias("executor_id"), F.col(f"{i}.`Block ID`").alias("block_id"), F.col(f"{i}.`Memory Size`").alias("memory"), F.col(f"{i}.`Disk Size`").alias("disk"), F.col(f"{i}.`Storage Level`").alias("level"))


def unpersisted(events: DataFrame) -> DataFrame:
    return _of(events, "SparkListenerUnpersistRDD", "`RDD ID` int").select(*PLACE, F.col("e.`RDD ID`").alias("rdd_id"))


def sql_starts(events: DataFrame) -> DataFrame:
    e = F.from_json("value", "executionId bigint, rootExecutionId bigint, description string, details string, physicalPlanDescription string, time bigint, modifiedConfigs map<string,string>, jobTags array<string>")
    rows = events.filter("event = 'SparkListenerSQLExecutionStart'").select(*PLACE, e.alias("e"), F.get_json_object("value", "$.sparkPlanInfo").alias("plan"))
    return rows.select(*PLACE, F.col("e.executionId").alias("execution_id"), F.col("e.rootExecutionId").alias("root_id"), F.col("e.description").alias("description"), F.col("e.details").alias("details"), F.col("e.physicalPlanDescription").alias("plan_text"), _time(F.col("e.time")).alias("t"), "plan")


def sql_ends(events: DataFrame) -> DataFrame:
    rows = _of(events, "SparkListenerSQLExecutionEnd", "executionId bigint, time bigint, errorMessage string")
    return rows.select(*PLACE, F.col("e.executionId").alias("execution_id"), _time(F.col("e.time")).alias("t"), F.nullif(F.col("e.errorMessage"), F.lit("")).alias("error"))


def sql_adaptive(events: DataFrame) -> DataFrame:
    rows = events.filter("event = 'SparkListenerSQLAdaptiveExecutionUpdate'")
    return rows.select(*PLACE, F.get_json_object("value", "$.executionId").cast("long").alias("execution_id"), F.get_json_object("value", "$.physicalPlanDescription").alias("plan_text"), F.get_json_object("value", "$.sparkPlanInfo").alias("plan"))


def driver_accumulators(events: DataFrame) -> DataFrame:
    rows = _of(events, "SparkListenerDriverAccumUpdates", "executionId bigint, accumUpdates array<array<bigint>>")
    return rows.select(*PLACE, F.col("e.executionId").alias("execution_id"), F.explode("e.accumUpdates").alias("u")).select(*PLACE, "execution_id", F.col("u")[0].alias("acc_id"), F.col("u")[1].alias("value"))


def peak_samples(events: DataFrame) -> DataFrame:
    """Gauges per executor from heartbeats, stage peaks and task ends."""
    beats = _of(events, "SparkListenerExecutorMetricsUpdate", f"`Executor ID` string, `Executor Metrics Updated` array<struct<`Executor Metrics`: struct<{_GAUGES}>>>")
    beats = beats.select(*PLACE, F.col("e.`Executor ID`").alias("executor_id"), F.explode("e.`Executor Metrics Updated`").alias("u")).select(*PLACE, "executor_id", F.col("u.`Executor Metrics`").alias("gauges"))
    stages = _of(events, "SparkListenerStageExecutorMetrics", f"`Executor ID` string, `Executor Metrics` struct<{_GAUGES}>").select(*PLACE, F.col("e.`Executor ID`").alias("executor_id"), F.col("e.`Executor Metrics`").alias("gauges"))
    tasks = task_ends(events).select(*PLACE, "executor_id", "gauges")
    return beats.unionByName(stages).unionByName(tasks).filter("gauges is not null")


_EXCLUSION = {
    "SparkListenerExecutorExcluded": ("executor", False), "SparkListenerExecutorBlacklisted": ("executor", False), "SparkListenerExecutorUnexcluded": ("executor", True), "SparkListenerExecutorUnblacklisted": ("executor", True),
    "SparkListenerNodeExcluded": ("node", False), "SparkListenerNodeBlacklisted": ("node", False), "SparkListenerNodeUnexcluded": ("node", True), "SparkListenerNodeUnblacklisted": ("node", True),
    "SparkListenerExecutorExcludedForStage": ("executor-stage", False), "SparkListenerExecutorBlacklistedForStage": ("executor-stage", False),
    "SparkListenerNodeExcludedForStage": ("node-stage", False), "SparkListenerNodeBlacklistedForStage": ("node-stage", False),
}


def exclusions(events: DataFrame) -> DataFrame:
    """Exclusions of executors and nodes; the same one under its new and its old event name is one row."""
    rows = events.filter(F.col("event").isin(*_EXCLUSION)).withColumn("e", F.from_json("value", "time bigint, executorId string, hostId string, taskFailures int, executorFailures int, stageId int, stageAttemptId int"))
    scope = F.create_map(*[F.lit(x) for k, (s, _) in _EXCLUSION.items() for x in (k, s)])
    lifts = [k for k, (_, lift) in _EXCLUSION.items() if lift]
    flat = rows.select(*PLACE, F.element_at(scope, F.col("event")).alias("scope"), F.col("event").isin(*lifts).alias("lift"), F.coalesce("e.executorId", "e.hostId").alias("target"), F.col("e.time").alias("t"), F.col("e.stageId").alias("stage_id"), F.coalesce("e.taskFailures", "e.executorFailures").alias("failures"))
    return flat.groupBy(*KEY, "scope", "lift", "target", "t", "stage_id").agg(F.max("failures").alias("failures"), F.min(F.struct("part", "file", "line")).alias("src"))


def catalog_events(events: DataFrame) -> DataFrame:
    rows = events.filter(F.col("event").rlike("^(Create|Drop|Rename|Alter)(Table|Database|Function).*Event$") & ~F.col("event").contains("Pre"))
    e = F.from_json("value", "database string, name string, newName string")
    table = F.concat_ws(".", F.col("e.database"), F.col("e.name"))
    named = F.when(F.col("e.newName").isNotNull(), F.concat(table, F.lit(" -> "), F.concat_ws(".", F.col("e.database"), F.col("e.newName")))).otherwise(table)
    return rows.withColumn("e", e).select(*PLACE, F.lower(F.regexp_extract("event", "^(Create|Drop|Rename|Alter)", 1)).alias("access"), named.alias("name"))
