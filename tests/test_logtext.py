"""Facts from lines of logs that we write ourselves."""

LOG = """25/01/02 03:04:05 INFO Executor: Running task 0.0 in stage 1.0 (TID 7)
25/01/02 03:04:05 INFO ShuffleBlockFetcherIterator: Getting 4 (2.0 KiB) non-empty blocks including 1 (1.0 KiB) local and 0 (0.0 B) host-local and 0 (0.0 B) push-merged-local and 3 (1.0 KiB) remote blocks
25/01/02 03:04:06 INFO Executor: Running task 1.0 in stage 1.0 (TID 8)
25/01/02 03:04:06 INFO TorrentBroadcast: Reading broadcast variable 3 took 12 ms
25/01/02 03:04:07 INFO Executor: Finished task 0.0 in stage 1.0 (TID 7). 1234 bytes result sent to driver
25/01/02 03:04:07 INFO UnsafeExternalSorter: Thread 5 spilling sort data of 64.0 MiB to disk (0  time so far)
25/01/02 03:04:08 ERROR Executor: Exception in task 1.0 in stage 1.0 (TID 8)
java.lang.RuntimeException: outer
\tat com.me.Job.run(Job.scala:5)
\tat org.apache.spark.X.y(X.scala:1)
Caused by: java.lang.OutOfMemoryError: Java heap space
\tat java.util.Arrays.copyOf(Arrays.java:1)

stray line
2025-01-02 03:04:09,123 WARN [thread-1] a.b.Heart: no recent heartbeats: 130000 ms exceeds timeout
"""
DRIVER = """25/01/02 03:04:05 INFO DAGScheduler: Got job 0 (count at x.py:1) with 2 output partitions
25/01/02 03:04:05 INFO DAGScheduler: Submitting 2 missing tasks from ResultStage 0 (y)
25/01/02 03:04:05 INFO TaskSetManager: Starting task 0.0 in stage 0.0 (TID 0) (h1, executor 1, partition 0, PROCESS_LOCAL, 9 bytes)
25/01/02 03:04:05 INFO TaskSetManager: Starting task 1.0 in stage 0.0 (TID 1) (h1, executor 1, partition 1, PROCESS_LOCAL, 9 bytes)
25/01/02 03:04:06 INFO TaskSetManager: Finished task 0.0 in stage 0.0 (TID 0) in 950 ms on h1 (executor 1) (1/2)
25/01/02 03:04:06 WARN TaskSetManager: Lost task 1.0 in stage 0.0 (TID 1) (h1 executor 1): java.lang.Exception
25/01/02 03:04:07 INFO DAGScheduler: ResultStage 0 (count at x.py:1) failed in 2.0 s due to Job aborted
25/01/02 03:04:08 INFO DAGScheduler: Submitting 1 missing tasks from ResultStage 0 (y)
25/01/02 03:04:09 INFO DAGScheduler: ResultStage 0 (count at x.py:1) finished in 1.0 s
25/01/02 03:04:09 INFO DAGScheduler: Job 0 finished: count at x.py:1, took 4.0 s
"""


def headed(spark, tmp_path, name, text):
    from emberlens.operators import logtext as L

    folder = tmp_path / "app-20250102030405-0001" / "1"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)
    return L.parse_header(L.read_logs(spark, str(folder / name)))


def test_headers_and_blocks(spark, tmp_path):
    from emberlens.operators import logtext as L

    rows = headed(spark, tmp_path, "stderr", LOG)
    first = rows.filter("line = 1").first()
    assert (first.level, first.logger, first.app, first.executor, first.kind) == ("INFO", "Executor", "app-20250102030405-0001", "1", "executor")
    assert str(first.t) == "2025-01-02 03:04:05"
    last = rows.filter("level = 'WARN'").first()
    assert (last.logger, last.thread) == ("Heart", "thread-1") and last.msg.startswith("no recent")
    entries = {r.line: r for r in L.exception_summary(L.blocks(rows)).collect()}
    assert len(entries) == 8 and len(entries[7].detail) == 5 and entries[7].last_line == 12
    assert entries[7].root_class == "java.lang.OutOfMemoryError" and entries[7].root_message == "Java heap space"
    assert entries[7].user_frames == ["com.me.Job.run(Job.scala:5)"]


def test_classes_and_steps(spark, tmp_path):
    from emberlens.operators import logtext as L

    rows = headed(spark, tmp_path, "stderr", LOG)
    hits = {r.hit: r.fields for r in L.classify(rows).collect()}
    assert hits["out-of-memory"] == {"what": "Java heap space"} and hits["slow-heartbeat"] == {"ms": "130000"}
    steps = {(r.line, r.step): r for r in L.task_steps(rows).collect()}
    assert steps[2, "blocks"].task_id == 7 and steps[2, "blocks"].remote == 1024
    assert steps[4, "broadcast"].task_id is None  # two tasks are open
    assert steps[6, "spill"].task_id == 8 and steps[6, "spill"].bytes == 64 << 20
    stories = {r.task_id: r for r in L.task_stories(L.task_steps(rows)).collect()}
    assert stories[7].outcome == "finish" and stories[7].finish_bytes == 1234 and stories[8].outcome == "fail"


def test_rebuild_from_the_driver(spark, tmp_path):
    from emberlens.operators import logtext as L

    events = L.driver_events(headed(spark, tmp_path, "driver.log", DRIVER)).cache()
    tasks = {r.task: r for r in L.rebuilt_tasks(events).collect()}
    assert tasks[0].status == "succeeded" and tasks[0].duration_ms == 950 and tasks[1].status == "failed"
    stages = {r.stage_attempt: r for r in L.rebuilt_stages(events).collect()}
    assert stages[0].failed and not stages[1].failed and stages[1].num_tasks == 1


def test_readme_tells_how_many_kinds_are_there():
    from pathlib import Path

    from emberlens.operators import cluster, logtext

    text = (Path(__file__).resolve().parent.parent / "README.md").read_text()
    more = {"executor-exit", "fetch-failed", "stage-failed", "spill", "not-cached", "slow-heartbeat", "executor-request", "attempt-exit"}  # kinds of our own
    kinds = [*(k for k in logtext.LINE_KINDS if k.name not in more), "error"]
    tables = {"O-112": (logtext.HEADERS, 5), "O-114": (kinds, 34), "O-119": (logtext.DRIVER_LINES, 23), "O-121": (logtext.TASK_LINES, 17), "O-145": (cluster.KNOWN_SETTINGS, 35)}
    for name, (rows, whole) in tables.items():
        assert f"({name}) {len(rows)} of {whole}" in text, name
    missing = text[text.index("## Not built yet") :]
    assert all(name in missing for name in ("O-53", "O-88", "O-127", "O-128", "O-133"))


def test_one_line_of_each_new_kind(spark):
    from pyspark.sql import functions as F

    from emberlens.functions.text import first_match
    from emberlens.operators import logtext as L

    task = {
        "Started reading broadcast variable 7 with 2 pieces (estimated total size 8.0 MiB)": "broadcast-start", "After dropping 3 blocks, free memory is 1.2 GiB": "drop", "Not enough space to cache rdd_3_1 in memory! (computed 2.0 MiB so far)": "no-room",
        "Finished task 1.0 in stage 2.0 (TID 5). Result is larger than maxResultSize (2.0 GiB > 1024.0 MiB), dropping it.": "result-too-big", "Finished task 1.0 in stage 2.0 (TID 5). 1000 bytes result sent to driver": "finish",
        "Saved output of task 'attempt_1_m_0' to hdfs://a/b": "output", "nothing of the kind": None,
    }
    driver = {
        "Got map stage job 3 (count at a.py:1) with 4 output partitions": "map-stage-start", "Job 3 is finished. Cancelling potential speculative or zombie tasks for this job": "job-over", "Job 3 finished: count at a.py:1, took 2.5 s": "job-end",
        "Parents of final stage: List(ShuffleMapStage 1)": "parents", "Running Spark version 3.5.1": "spark-version", "Submitted application: my job": "app-name", "Launching container container_1_2_01_000003 on host h1 for executor with ID 2 with resources": "container-launched",
        "Completed container container_1_2_01_000003 on host: h1 (state: COMPLETE, exit status: 143)": "container-over", "Registering block manager h1:345 with 2.1 GiB RAM, BlockManagerId(2, h1, 345, None)": "block-manager",
        "Executors 1,2 removed due to idle timeout.": "executor-idle", "Requesting 2 new executors because tasks are backlogged (new desired total will be 4 for resource profile id: 0)": "executor-target",
    }
    for rules, lines in ((L.TASK_LINES, task), (L.DRIVER_LINES, driver)):
        rows = spark.createDataFrame([(k,) for k in lines], "m string").select("m", first_match(F.col("m"), rules).alias("kind")).collect()
        assert {r.m: r.kind for r in rows} == lines


def test_lines_of_sparks_own_sources(spark):
    """Executor.scala, SparkHadoopMapRedUtil.scala, HadoopRDD.scala and MemoryStore.scala of Spark 3.5 and 4.0 write these."""
    from pyspark.sql import functions as F

    from emberlens.functions.text import first_match, matched_fields
    from emberlens.operators import logtext as L

    lines = {
        "Executor killed task 3.0 in stage 1.0 (TID 9), reason: another attempt succeeded": ("kill", {"task": "9"}),
        "Executor interrupted and killed task 3.0 in stage 1.0 (TID 9), reason: Stage cancelled": ("kill", {"task": "9"}),
        "attempt_202501020304058392_0004_m_000001_7: Committed. Elapsed time: 12 ms.": ("commit", {"ms": "12"}),
        "Input split: hdfs://nn:8020/in/a.txt:128+64": ("input", {"name": "hdfs://nn:8020/in/a.txt", "bytes": "64"}),
        "Block broadcast_1_piece0 stored as bytes in memory (estimated size 4.0 KiB, free 1.1 GiB)": ("stored", {"size": "4.0 KiB", "free": "1.1 GiB"}),
        "Job committed for everyone": (None, {}),
    }
    rows = spark.createDataFrame([(x,) for x in lines], "m string").withColumn("k", first_match(F.col("m"), L.TASK_LINES)).withColumn("f", matched_fields(F.col("m"), F.col("k"), L.TASK_LINES)).collect()
    for x in rows:
        kind, fields = lines[x.m]
        assert x.k == kind and fields.items() <= (x.f or {}).items(), x
    # A task that was interrupted is over: the next line belongs to the one that still runs.
    log = ["Running task 0.0 in stage 1.0 (TID 7)", "Running task 1.0 in stage 1.0 (TID 8)", "Executor interrupted and killed task 0.0 in stage 1.0 (TID 7), reason: x", "Reading broadcast variable 3 took 12 ms"]
    df = spark.createDataFrame([("f", i, m, None) for i, m in enumerate(log)], "file string, line long, value string, t timestamp").withColumn("msg", F.col("value"))
    assert [x.task_id for x in L.task_steps(df).filter("step = 'broadcast'").collect()] == [8]


def test_each_layout_and_its_fields(spark):
    from emberlens.operators import logtext as L

    lines = {
        "25/01/02 03:04:05 INFO Executor: Running task": ("INFO", "Executor", None, "Running task"), "25/01/02 03:04:05 WARN Executor:": ("WARN", "Executor", None, ""),
        "2025-01-02 03:04:05,123 WARN  [RpcServer.handler=3] ipc.RpcServer: slow (a) call": ("WARN", "RpcServer", "RpcServer.handler=3", "slow (a) call"),
        "2025-01-02 03:04:05,123 [Executor task launch worker for task 1.0 in stage 2.0 (TID 6)] INFO  org.apache.spark.rdd.HadoopRDD  - Input split: x:0+1": ("INFO", "HadoopRDD", "Executor task launch worker for task 1.0 in stage 2.0 (TID 6)", "Input split: x:0+1"),
        "2025-01-02T03:04:05.123Z INFO startExec 'hadoop jar x'": ("INFO", None, None, "startExec 'hadoop jar x'"), "2025-01-02 03:04:05,123 WARN a.b.Launcher (pool #0): Exit code": ("WARN", "Launcher", "pool #0", "Exit code"),
        "2025-01-02 03:04:05 ERROR a.b.C: x": ("ERROR", "C", None, "x"), "no header": (None, None, None, None), "": (None, None, None, None),
    }
    df = spark.createDataFrame([("/steps/s-1AB/controller", i, v) for i, v in enumerate(lines)], "file string, line long, value string")
    rows = {x.value: x for x in L.parse_header(L.path_facts(df), "Asia/Tokyo").collect()}
    for v, want in lines.items():
        x = rows[v]
        assert (x.level, x.logger, x.thread, x.msg) == want, v
        assert (x.kind, x.step) == ("step-controller", "s-1AB") and (x.t is None or x.t.hour == 3)  # a controller's times are UTC whatever the zone
    executors = spark.createDataFrame([("/container_1_2_01_000003/stderr", 1, next(iter(lines)))], "file string, line long, value string")
    assert L.parse_header(L.path_facts(executors), "Asia/Tokyo").first().t.hour == 18


def test_one_line_of_each_further_kind(spark):
    from emberlens.operators import logtext as L

    lines = {
        "Final app status: FAILED, exitCode: 13, (reason: User class threw exception)": "app-exit", "Updating application attempt appattempt_1_0007_000002 with final state: FAILED, and exit status: 1": "attempt-exit",
        "appId=application_1_0007,name=n,user=u,queue=default,state=FINISHED,finalStatus=SUCCEEDED,memorySeconds=1": "app-summary", "Application report for application_1_0007 (state: RUNNING)": "app-report", "Submitted application application_1_0007": "submitted",
        "Uploading resource file:/a/b.py -> hdfs://x/b.py": "resource", "    a-1.0.jar -> resource { scheme: hdfs": "localized", "startExec 'hadoop jar x'": "submit", "Step failed with exitCode 1 and took 25 seconds": "step-status",
        "i-0abc: failed to start. bootstrap action 1 failed with non-zero exit code": "bootstrap", "Lost task 1.0 in stage 2.0 (TID 5) (h1 executor 1): x": "task-error", "RECEIVED SIGNAL TERM": "signal", "Trying to connect to metastore with URI thrift://x": "metastore",
        "NodeManager from node h1(cmPort: 1) registered with capability: <memory:1024, vCores:4>": "node-capacity", "Starting Spark worker 10.0.0.1:777 with 4 cores, 8.0 GiB RAM": "worker-capacity",
        "Assigned container container_1_2_01_000003 of capacity <memory:4096, max memory:9, vCores:2, max vCores:4> on host h1:8041, which": "container-assigned", "Will request 2 executor container(s) for  ResourceProfile Id: 0, each with 4 core(s) and 4096 MB memory": "yarn-request",
        "Registered BlockManager BlockManagerId(driver, h1, 7, None)": "driver-host", "Starting executor ID 3 on host h1": "executor-host", "Yarn node state updated for host h1 to DECOMMISSIONING": "node-state", "Traceback (most recent call last):": "traceback",
        "Caused by: java.io.IOException: gone": "exception", "anything else": "error",
    }
    df = spark.createDataFrame([("f", i, m, m, "ERROR") for i, m in enumerate(lines)], "file string, line long, value string, msg string, level string")
    rows = L.classify(df).collect()
    assert {x.value: x.hit for x in rows} == lines
    fields = {x.hit: x.fields for x in rows}
    assert fields["app-exit"] == {"status": "FAILED", "code": "13", "reason": "User class threw exception"} and fields["container-assigned"] == {"container": "container_1_2_01_000003", "memory": "4096", "cores": "2", "host": "h1"}
    assert fields["app-summary"] == {"app": "application_1_0007", "user": "u", "queue": "default", "status": "SUCCEEDED"} and fields["executor-host"] == {"executor": "3", "host": "h1"}
    assert L.classify(df.withColumn("level", df.msg.substr(1, 0))).filter("hit = 'error'").count() == 0
