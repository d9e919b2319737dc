"""Facts from executor, driver and daemon logs: headers, blocks of lines, classified lines, exceptions, and what tasks and the driver did.

Lines come as (file, line, value) and any columns that path_facts adds. Windows run over one file's lines at most.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import Pattern, first_match, matched_fields, size_to_bytes
from ..sources.eventlog import read_lines, with_line_numbers
from .timesplit import single_owner

#: Header layouts as log4j conversion patterns: name, pattern, and the format of its times. %d, %p, %c, %t and %m stand for time, level, logger, thread and message; what is in parentheses may be missing.
LAYOUTS = (
    ("spark", "%d %p %c: %m", "yy/MM/dd HH:mm:ss"),
    ("level-thread", "%d %p [%t] %c: %m", "yyyy-MM-dd HH:mm:ss"),
    ("thread-level", "%d [%t] %p %c - %m", "yyyy-MM-dd HH:mm:ss"),
    ("controller", "%dZ %p %m", "yyyy-MM-dd HH:mm:ss"),
    ("iso", "%d %p %c( (%t))(:)%m", "yyyy-MM-dd HH:mm:ss"),
)
_LEVELS = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")
_FIELDS = {"%p": f"({'|'.join(_LEVELS)})", "%c": r"([\w.$]+)", "%t": r"([^\]]*)", "%m": r"\s?(.*)"}


def layout_regex(pattern: str, time_format: str) -> tuple[str, tuple[str, ...]]:
    """A conversion pattern as a regular expression, and the fields of its groups in order. Digits of a time may be followed by milliseconds; spaces are one or more."""
    time = "".join(r"\d" if c.isalpha() else {" ": "[ T]"}.get(c, re.escape(c)) for c in time_format) + ("" if time_format.startswith("yy/") else r"(?:[,.]\d{3})?")
    out, fields = "^", []
    for part in re.split(r"( ?%m|%[dpct]|\( \(%t\)\)|\(:\)| )", pattern):
        if part == "%d":
            out += f"({time})"
        elif part == "( (%t))":
            out += r"(?: \(([^)]*)\))?"
        elif part == "(:)":
            out += ":?"
        elif part == " ":
            out += r"\s+"
        elif part.strip() in _FIELDS:
            out += _FIELDS[part.strip()]
        else:
            out += re.escape(part)
        found = re.search("%([dpctm])", part)
        if found:
            fields.append(found[1])
    return out + "$", tuple(fields)


#: Each layout with its expression, the fields of its groups, and the time's format.
HEADERS = tuple((name, *layout_regex(pattern, form), form) for name, pattern, form in LAYOUTS)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """file, line and value of every line under path, with what the file's path says."""
    return path_facts(with_line_numbers(read_lines(spark, path)).drop("block", "row", "size"))


def path_facts(lines: DataFrame) -> DataFrame:
    """kind, app, container, executor, host, step and instance, as far as a path names them."""
    f = F.col("file")
    none = lambda c: F.nullif(c, F.lit(""))
    container = none(F.regexp_extract(f, r"(container_(?:e\d+_)?\d+_\d+_\d+_\d+)", 1))
    app = none(F.regexp_extract(f, r"((?:application_\d+_\d+)|(?:app-\d+-\d+))", 1))
    from_container = F.concat(F.lit("application_"), F.regexp_extract(container, r"container_(?:e\d+_)?(\d+_\d+)_", 1))
    step = none(F.regexp_extract(f, r"/steps/(s-[A-Z0-9]+)/", 1))
    kind = F.when(step.isNotNull() & f.rlike(r"/controller[^/]*$"), "step-controller").when(step.isNotNull(), "step").when(f.rlike("(?i)master"), "master").when(f.rlike("(?i)worker"), "worker").when(f.rlike("(?i)(regionserver|hmaster|hbase)"), "store").when(f.rlike("(?i)resourcemanager"), "resource-manager").when(f.rlike("(?i)nodemanager"), "node-manager").when(f.rlike("(?i)driver"), "driver").when(container.isNotNull() | f.rlike(r"/\d+/std(err|out)"), "executor").otherwise("other")
    executor = none(F.regexp_extract(f, r"/(?:executor-)?(\d+)/std(?:err|out)", 1))
    return lines.withColumns({"kind": kind, "app": F.coalesce(app, from_container), "container": container, "executor": executor, "host": none(F.regexp_extract(f, r"((?:ip-\d+-\d+-\d+-\d+)[\w.]*)", 1)), "step": step, "instance": none(F.regexp_extract(f, r"/(i-[0-9a-f]{8,17})/", 1))})


def parse_header(lines: DataFrame, zone: str = "UTC") -> DataFrame:
    """t, level, logger (its last part), thread and msg of lines that begin an entry; null on others. Times without a zone are read in the given one."""
    v = F.col("value")
    level, logger, thread, msg = (F.lit(None).cast("string") for _ in range(4))
    when = F.lit(None).cast("timestamp")
    utc = F.col("kind") == "step-controller" if "kind" in lines.columns else F.lit(False)  # whatever the others' zone
    for _, regex, fields, form in reversed(HEADERS):
        hit = v.rlike(regex)
        get = lambda f, r=regex, g=fields: F.nullif(F.regexp_extract(v, r, g.index(f) + 1), F.lit("")) if f in g else F.lit(None).cast("string")
        stamp = F.try_to_timestamp(F.substring(F.translate(get("d"), "T,", " ."), 1, len(form)), F.lit(form))
        when = F.when(hit, F.when(utc, stamp).otherwise(F.to_utc_timestamp(stamp, zone))).otherwise(when)
        level, logger, thread = F.when(hit, get("p")).otherwise(level), F.when(hit, get("c")).otherwise(logger), F.when(hit, get("t")).otherwise(thread)
        msg = F.when(hit, F.coalesce(get("m"), F.lit(""))).otherwise(msg)
    return lines.withColumns({"t": when, "level": level, "logger": F.regexp_replace(logger, r"^.*[.$]", ""), "thread": thread, "msg": msg})


def blocks(headed: DataFrame, most: int = 400) -> DataFrame:
    """Entries with the lines that follow them: file, line, last_line, detail. A blank line ends an entry; lines before the first belong to none."""
    w = W.partitionBy("file").orderBy("line")
    begin = F.col("level").isNotNull()
    marked = headed.withColumn("entry", F.sum(begin.cast("int")).over(w)).withColumn("blank", F.sum((F.trim("value") == "").cast("int")).over(w))
    heads = headed.columns
    inside = marked.withColumn("at", F.max(F.when(begin, F.col("blank"))).over(W.partitionBy("file", "entry"))).filter((F.col("entry") > 0) & ((F.col("blank") == F.col("at")) & (F.trim("value") != "")))
    order = F.struct("line", "value")
    rows = inside.withColumn("nth", F.row_number().over(W.partitionBy("file", "entry").orderBy("line"))).filter(F.col("nth") <= most)
    grouped = rows.groupBy("file", "entry").agg(F.max("line").alias("last_line"), F.array_sort(F.collect_list(F.when(~begin, order))).alias("d"), *[F.max_by(c, F.when(begin, F.lit(1)).otherwise(0)).alias(c) for c in heads if c != "file"])
    return grouped.select(*heads, "last_line", F.transform("d", lambda x: x["value"]).alias("detail"))


def exception_summary(entries: DataFrame) -> DataFrame:
    """root_class and root_message of the last cause, up to 3 of the user's frames, and a Python traceback's last place and error."""
    d = F.concat(F.array(F.col("msg")), F.col("detail"))
    thrown = F.filter(d, lambda x: x.rlike(r"^(?:Caused by: )?[a-zA-Z_][\w$]*(?:\.[\w$]+)+(?:Exception|Error|Throwable)\b"))
    root = F.regexp_replace(F.element_at(F.when(F.size(thrown) > 0, thrown), -1), "^Caused by: ", "")
    frames = F.filter(d, lambda x: x.rlike(r"^\s+at ") & ~x.rlike(r"^\s+at (?:java|javax|jdk|sun|scala|org\.apache|py4j|io\.netty|com\.sun|com\.fasterxml|org\.codehaus)\b"))
    places = F.filter(d, lambda x: x.rlike(r'^\s*File ".*", line \d+'))
    python = F.filter(d, lambda x: x.rlike(r"^[A-Za-z_][\w.]*(?:Error|Exception|Interrupt|Exit)(?::|$)"))
    last = lambda c: F.element_at(F.when(F.size(c) > 0, c), -1)
    return entries.withColumns(
        {
            "root_class": F.nullif(F.regexp_extract(root, r"^([\w.$]+)", 1), F.lit("")),
            "root_message": F.regexp_extract(root, r"^[\w.$]+:\s*(.*)$", 1),
            "user_frames": F.slice(F.transform(frames, lambda x: F.regexp_replace(x, r"^\s+at ", "")), 1, 3),
            "python_file": F.regexp_extract(last(places), r'File "([^"]*)", line (\d+)', 1),
            "python_line": F.regexp_extract(last(places), r'File "([^"]*)", line (\d+)', 2).try_cast("int"),
            "python_error": last(python),
        }
    )


#: Kinds of lines with what tells them and the fields that they carry. Order decides.
LINE_KINDS = (
    Pattern("out-of-memory", "OutOfMemoryError", r"java\.lang\.OutOfMemoryError: ?(.*)", ("what",)),
    Pattern("memory-kill", "memory limits", r"Container (?:\[[^\]]*containerID=)?(\S+?)[,\]]? .*?(?:beyond|exceeding).*memory limits", ("container",)),
    Pattern("access-denied", "denied", r"(?i)(?:access ?denied|permission denied|not authorized)[^:]*:?\s*(.*)", ("what",)),
    Pattern("kerberos-failure", "GSS", r"GSS(?:Exception| initiate failed)(.*)", ("what",)),
    Pattern("class-missing", "Class", r"(?:ClassNotFoundException|NoClassDefFoundError|NoSuchMethodError)[: ]+([\w.$/]+)", ("name",)),
    Pattern("executor-exit", "exited with code", r"Executor (\S+) .*exited with code (\d+)", ("executor", "code")),
    Pattern("executor-lost", "Lost executor", r"Lost executor (\S+) on ([^:]+): (.*)", ("executor", "host", "reason")),
    Pattern("fetch-failed", "FetchFailed", r"FetchFailed\((.*)", ("what",)),
    Pattern("stage-failed", "failed", r"^(?:ShuffleMapStage|ResultStage) (\d+) \((.*)\) failed in ([\d.]+) s", ("stage", "name", "seconds")),
    Pattern("spill", "spilling", r"(?:Task (\d+) spilling|spilling in-memory).*?(?:of|map of) ([\d.]+ [KMGT]?i?B)", ("task", "size")),
    Pattern("not-cached", "Not enough space to cache", r"Not enough space to cache (\S+) in memory", ("block",)),
    Pattern("slow-heartbeat", "heartbeat", r"(?i)no recent heartbeats?: (\d+) ms", ("ms",)),
    Pattern("executor-request", "Requesting", r"[Rr]equesting (\d+) new executors?", ("n",)),
    Pattern("app-exit", "Final app status", r"^Final app status: (\w+), exitCode: (-?\d+)(?:, \(reason: (.*)\))?", ("status", "code", "reason")),
    Pattern("attempt-exit", "with final state", r"^Updating application attempt appattempt_\d+_\d+_0*(\d+) with final state: (\w+), and exit status: (-?\d+)", ("attempt", "status", "code")),
    Pattern("app-summary", "finalStatus=", r"^appId=(application_\d+_\d+),.*?\buser=([^,]*).*?\bqueue=([^,]*).*?\bfinalStatus=(\w+)", ("app", "user", "queue", "status")),
    Pattern("app-report", "Application report for", r"^Application report for (application_\d+_\d+) \(state: (\w+)\)", ("app", "state")),
    Pattern("submitted", "Submitted application", r"^Submitted application (application_\d+_\d+)", ("app",)),
    Pattern("resource", "Uploading resource", r"^Uploading resource (\S+) -> ", ("name",)),
    Pattern("localized", "-> resource {", r"^\s*([\w.+-]+) -> resource \{", ("name",)),
    Pattern("submit", "startExec", r"^startExec '(.*)'$", ("command",)),
    Pattern("step-status", "with exitCode", r"^Step (succeeded|failed|cancelled) with exitCode (-?\d+) and took (\d+) seconds", ("status", "code", "seconds")),
    Pattern("bootstrap", "bootstrap action", r"^(i-\w+): (?:failed to start\. bootstrap action (\d+) failed|all bootstrap actions complete)", ("instance", "action")),
    Pattern("task-error", "in stage", r"^(?:Lost|Exception in) task (\S+) in stage (\S+) \(TID (\d+)\)", ("task", "stage", "id")),
    Pattern("signal", "RECEIVED SIGNAL", r"^RECEIVED SIGNAL (\w+)", ("signal",)),
    Pattern("metastore", "etastore", r"(Trying to connect to metastore with URI|Opened a connection to metastore|Unable to instantiate \S*Metastore)", ("what",)),
    Pattern("node-capacity", "vCores:", r"registered with capability: <memory:(\d+), vCores:(\d+)|total resource of <memory:(\d+), vCores:(\d+)", ("memory", "cores", "memory_mb", "vcores")),
    Pattern("worker-capacity", "Starting Spark worker", r"^Starting Spark worker (\S+):\d+ with (\d+) cores, ([\d.]+ [KMGT]?i?B) RAM", ("host", "cores", "memory")),
    Pattern("container-assigned", "Assigned container", r"^Assigned container (\S+) of capacity <memory:(\d+)[^>]*?vCores:(\d+)[^>]*> on host ([^\s:,]+)", ("container", "memory", "cores", "host")),
    Pattern("yarn-request", "executor container(s)", r"^Will request (\d+) executor container\(s\) for\s+ResourceProfile Id: (\d+), each with (\d+) core\(s\) and (\d+) MB memory", ("n", "profile", "cores", "memory")),
    Pattern("driver-host", "BlockManagerId(driver", r"^Registered BlockManager BlockManagerId\(driver, ([^,\s]+),", ("host",)),
    Pattern("executor-host", "Starting executor ID", r"^Starting executor ID (\S+) on host (\S+)$", ("executor", "host")),
    Pattern("node-state", "node state updated", r"^Yarn node state updated for host (\S+) to (\w+)", ("host", "state")),
    Pattern("container-exit", "exit", r"(?:Exit code|exitCode|exit status)[ :=]+(-?\d+)", ("code",)),
    Pattern("traceback", "Traceback", r"^Traceback \(most recent call last\)"),
    Pattern("exception", "", r"^(?:Caused by: |Exception in thread \"[^\"]*\" )?((?:[A-Za-z_$][\w$]*\.)+[A-Z][\w$]*(?:Exception|Error|Throwable|Failure)[\w$]*)(?::|$)", ("class",)),
)


def classify(headed: DataFrame) -> DataFrame:
    """Lines of a known kind with their fields, and other lines of level ERROR or FATAL as error; a kind's severity is its level's."""
    kind = F.coalesce(first_match(F.coalesce("msg", "value"), LINE_KINDS), F.when(F.col("level").isin("ERROR", "FATAL"), "error"))
    hits = headed.withColumn("hit", kind).filter("hit is not null")
    return hits.withColumn("fields", matched_fields(F.coalesce("msg", "value"), F.col("hit"), LINE_KINDS))


#: What an executor's lines say about a task.
TASK_LINES = (
    Pattern("start", "Running task", r"^Running task (\d+)\.(\d+) in stage (\d+)\.(\d+) \(TID (\d+)\)", ("partition", "task_attempt", "stage", "stage_attempt", "task")),
    Pattern("finish", "Finished task", r"^Finished task (\d+)\.(\d+) in stage (\d+)\.(\d+) \(TID (\d+)\)\. (\d+) bytes", ("partition", "task_attempt", "stage", "stage_attempt", "task", "bytes")),
    Pattern("fail", "Exception in task", r"^Exception in task (\d+)\.(\d+) in stage (\d+)\.(\d+) \(TID (\d+)\)", ("partition", "task_attempt", "stage", "stage_attempt", "task")),
    Pattern("kill", "killed task", r"^Executor (?:interrupted and )?killed task (\d+)\.(\d+) in stage (\d+)\.(\d+) \(TID (\d+)\)", ("partition", "task_attempt", "stage", "stage_attempt", "task")),
    Pattern("broadcast", "Reading broadcast variable", r"^Reading broadcast variable (\d+) took (\d+) ms", ("name", "ms")),
    Pattern("blocks", "non-empty blocks", r"^Getting (\d+) \(([\d.]+ [KMGT]?i?B)\) non-empty blocks including .*?(\d+) \(([\d.]+ [KMGT]?i?B)\) remote", ("n", "size", "remote_n", "remote")),
    Pattern("fetch", "remote fetches", r"^Started (\d+) remote fetches in (\d+) ms", ("n", "ms")),
    Pattern("spill", "spilling", r"spilling .*?(?:of|map of) ([\d.]+ [KMGT]?i?B)", ("size",)),
    Pattern("stored", "stored as", r"^Block (\S+) stored as (?:values|bytes) in memory \(estimated size ([\d.]+ [KMGT]?i?B),(?: actual size: [\d.]+ [KMGT]?i?B,)? free ([\d.]+ [KMGT]?i?B)\)", ("name", "size", "free")),
    Pattern("read", "path:", r"^(?:Reading File|TID: \d+ - Reading current file:)\s*path: (\S+?),", ("name",)),
    Pattern("commit", "Committed", r"^attempt_\S+: Committed\. Elapsed time: (\d+) ms\.", ("ms",)),
    Pattern("input", "Input split", r"^Input split: (\S+):\d+\+(\d+)$", ("name", "bytes")),
    Pattern("broadcast-start", "Started reading broadcast", r"^Started reading broadcast variable (\d+) with (\d+) pieces \(estimated total size ([\d.]+ [KMGT]?i?B)\)", ("name", "n", "size")),
    Pattern("drop", "After dropping", r"^After dropping (\d+) blocks, free memory is ([\d.]+ [KMGT]?i?B)", ("n", "free")),
    Pattern("no-room", "Not enough space to cache", r"^Not enough space to cache (\S+) in memory!(?: \(computed ([\d.]+ [KMGT]?i?B) so far\))?", ("name", "size")),
    Pattern("result-too-big", "larger than maxResultSize", r"^Finished task (\d+)\.(\d+) in stage (\d+)\.(\d+) \(TID (\d+)\)\. Result is larger than maxResultSize \(([\d.]+ [KMGT]?i?B) >", ("partition", "task_attempt", "stage", "stage_attempt", "task", "size")),
    Pattern("output", "Saved output of task", r"^Saved output of task '[^']*' to (\S+)", ("name",)),
)
_OPENS, _CLOSES = ("start",), ("finish", "fail", "kill", "result-too-big")


def task_steps(headed: DataFrame) -> DataFrame:
    """Steps of tasks on an executor, in the order of its lines. A line that names no task belongs to the only one that is open there; with several open, to none."""
    msg = F.coalesce("msg", "value")
    rows = headed.withColumn("step", first_match(msg, TASK_LINES)).filter("step is not null").withColumn("f", matched_fields(msg, F.col("step"), TASK_LINES))
    own = F.col("f")["task"].cast("long")
    sign = F.when(F.col("step").isin(*_OPENS), 1).when(F.col("step").isin(*_CLOSES), -1).otherwise(0)
    owned = single_owner(rows.withColumns({"own": own, "sign": sign}), "file", "line", "sign", "own")
    number = lambda k: F.col("f")[k].cast("long")
    size = F.when(F.col("f")["size"].isNotNull(), size_to_bytes(F.col("f")["size"]))
    return owned.withColumn("task_id", F.coalesce("own", "owner")).select(
        *[c for c in ("app", "executor", "file", "line", "t") if c in headed.columns], "task_id", "step", number("stage").alias("stage"), number("stage_attempt").alias("stage_attempt"), number("partition").alias("partition"),
        F.coalesce(number("bytes"), size).alias("bytes"), number("ms").alias("ms"), number("n").alias("n"), F.when(F.col("f")["remote"].isNotNull(), size_to_bytes(F.col("f")["remote"])).alias("remote"),
        F.when(F.col("f")["free"].isNotNull(), size_to_bytes(F.col("f")["free"])).alias("free"), F.col("f")["name"].alias("name"),
    )


def task_stories(steps: DataFrame) -> DataFrame:
    """One row per task attempt: when it began and ended and how, what it fetched, spilled and stored."""
    end = F.when(F.col("step").isin(*_CLOSES), F.col("t"))
    size = lambda k, c="bytes": F.sum(F.when(F.col("step") == k, F.col(c))).alias(f"{k}_{c}")
    keys = [c for c in ("app", "executor", "file") if c in steps.columns]
    return steps.filter("task_id is not null").groupBy(*keys, "task_id").agg(
        F.min(F.when(F.col("step") == "start", F.col("t"))).alias("started"), F.max(end).alias("ended"), F.max_by("step", F.when(F.col("step").isin(*_CLOSES), F.col("line"))).alias("outcome"),
        F.max("stage").alias("stage"), F.max("partition").alias("partition"), size("finish"), size("spill"), size("stored"), size("blocks"), size("blocks", "remote"), size("broadcast", "ms"), F.count(F.lit(1)).alias("steps"),
    )


#: What a driver's lines say about jobs, stages and executors.
DRIVER_LINES = (
    Pattern("job-start", "Got job", r"^Got job (\d+) \((.*)\) with (\d+) output partitions", ("job", "name", "n")),
    Pattern("job-end", "finished", r"^Job (\d+) finished: (.*), took ([\d.]+) (?:s|ms)", ("job", "name", "seconds")),
    Pattern("job-fail", "failed", r"^Job (\d+) failed: (.*), took ([\d.]+) (?:s|ms)", ("job", "name", "seconds")),
    Pattern("final-stage", "Final stage", r"^Final stage: (ShuffleMapStage|ResultStage) (\d+)", ("type", "stage")),
    Pattern("stage-submit", "Submitting", r"^Submitting (?:(\d+) missing tasks from )?(ShuffleMapStage|ResultStage) (\d+)", ("n", "type", "stage")),
    Pattern("stage-end", "finished in", r"^(ShuffleMapStage|ResultStage) (\d+) \((.*)\) finished in ([\d.]+) (?:s|ms)", ("type", "stage", "name", "seconds")),
    Pattern("stage-fail", "failed in", r"^(ShuffleMapStage|ResultStage) (\d+) \((.*)\) failed in ([\d.]+) (?:s|ms)", ("type", "stage", "name", "seconds")),
    Pattern("task-start", "Starting task", r"^Starting task (\d+)\.(\d+) in stage (\d+)\.(\d+) \(TID (\d+)\) \(([^,]+), executor ([^,]+), partition (\d+), (\w+)", ("index", "attempt", "stage", "stage_attempt", "task", "host", "executor", "partition", "locality")),
    Pattern("task-end", "Finished task", r"^Finished task (\d+)\.(\d+) in stage (\d+)\.(\d+) \(TID (\d+)\) in (\d+) ms on (\S+) \(executor ([^)]+)\)", ("index", "attempt", "stage", "stage_attempt", "task", "ms", "host", "executor")),
    Pattern("task-lost", "Lost task", r"^Lost task (\d+)\.(\d+) in stage (\d+)\.(\d+) \(TID (\d+)\)", ("index", "attempt", "stage", "stage_attempt", "task")),
    Pattern("executor-registered", "Registered executor", r"Registered executor .* \(([\d.:]+)\) with ID (\S+?),", ("host", "executor")),
    Pattern("executor-lost", "Lost executor", r"^Lost executor (\S+) on ([^:]+): (.*)", ("executor", "host", "reason")),
    Pattern("map-stage-start", "Got map stage job", r"^Got map stage job (\d+) \((.*)\) with (\d+) output partitions", ("job", "name", "n")),
    Pattern("job-over", "is finished", r"^Job (\d+) is finished\.", ("job",)),
    Pattern("parents", "Parents of final stage", r"^Parents of final stage: List\((.*)\)", ("name",)),
    Pattern("spark-version", "Running Spark version", r"^Running Spark version (\S+)", ("name",)),
    Pattern("app-name", "Submitted application", r"^Submitted application: (.*)$", ("name",)),
    Pattern("container-launched", "Launching container", r"^Launching container (\S+) on host (\S+) for executor with ID (\d+)", ("name", "host", "executor")),
    Pattern("container-over", "Completed container", r"^Completed container (\S+) on host: (\S+) \(state: (\w+), exit status: (-?\d+)\)", ("name", "host", "type", "n")),
    Pattern("block-manager", "Registering block manager", r"^Registering block manager \S+ with ([\d.]+ [KMGT]?i?B) RAM, BlockManagerId\(([^,]+), ([^,]+),", ("name", "executor", "host")),
    Pattern("executor-idle", "idle", r"^Executors? ([\d,]+) (?:is |are |was |were )?removed due to idle timeout", ("name",)),
    Pattern("executor-target", "executors", r"^Requesting \d+ new executors? because tasks are backlogged \(new desired total will be (\d+)", ("n",)),
)


def driver_events(headed: DataFrame) -> DataFrame:
    msg = F.coalesce("msg", "value")
    rows = headed.withColumn("event", first_match(msg, DRIVER_LINES)).filter("event is not null").withColumn("f", matched_fields(msg, F.col("event"), DRIVER_LINES))
    whole = [F.col("f")[k].cast("long").alias(k) for k in ("job", "stage", "stage_attempt", "task", "index", "attempt", "partition", "n", "ms")]
    words = [F.col("f")[k].alias(k) for k in ("name", "type", "host", "executor", "locality", "reason")]
    return rows.select(*[c for c in ("app", "file", "line", "t") if c in headed.columns], "event", *whole, *words)


def rebuilt_tasks(events: DataFrame) -> DataFrame:
    """Task attempts from a driver's lines alone, with their times and states; what only an event log has isn't there."""
    mine = events.filter(F.col("event").isin("task-start", "task-end", "task-lost"))
    first = lambda c, e: F.max(F.when(F.col("event") == e, F.col(c)))
    out = mine.groupBy("app", "file", "task").agg(
        F.max("stage").alias("stage_id"), F.max("stage_attempt").alias("stage_attempt"), F.max("index").alias("task_index"), first("t", "task-start").alias("launched"), first("ms", "task-end").alias("duration_ms"),
        F.max("executor").alias("executor_id"), F.max("host").alias("host"), F.max("locality").alias("locality"), F.bool_or(F.col("event") == "task-end").alias("ok"), F.bool_or(F.col("event") == "task-lost").alias("lost"),
    )
    return out.withColumn("status", F.when(F.col("ok"), "succeeded").when(F.col("lost"), "failed").otherwise("running")).drop("ok", "lost")


def rebuilt_stages(events: DataFrame) -> DataFrame:
    """Stage attempts from a driver's lines: an attempt's number is that of its submission, and it ends with the next line that says so."""
    w = W.partitionBy("app", "file", "stage").orderBy("line")
    rows = events.filter(F.col("event").isin("stage-submit", "stage-end", "stage-fail") & F.col("stage").isNotNull()).filter("event <> 'stage-submit' or n is not null")
    tries = rows.withColumn("try", F.sum((F.col("event") == "stage-submit").cast("int")).over(w) - 1)
    return tries.groupBy("app", "file", "stage", "try").agg(
        F.min(F.when(F.col("event") == "stage-submit", F.col("t"))).alias("submitted"), F.max("n").alias("num_tasks"), F.max(F.when(F.col("event") != "stage-submit", F.col("t"))).alias("completed"),
        F.max("name").alias("name"), F.bool_or(F.col("event") == "stage-fail").alias("failed"),
    ).withColumnsRenamed({"stage": "stage_id", "try": "stage_attempt"})


def file_times(headed: DataFrame) -> DataFrame:
    return headed.groupBy("file").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count(F.lit(1)).alias("lines"))


def executor_targets(events: DataFrame) -> DataFrame:
    """Changes of the wanted number of executors; equal ones in a row are one."""
    w = W.partitionBy("app", "file").orderBy("line")
    return events.filter("event = 'executor-target'").withColumn("before", F.lag("n").over(w)).filter("before is null or before <> n").drop("before")
