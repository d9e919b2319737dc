"""Streams over files, run until all that is there is read, against the batch results."""

import json
from datetime import datetime, timezone

import pytest


def line(event, **x):
    return json.dumps({"Event": event, **x})


def task(i, start, end=None):
    info = {"Task ID": i, "Index": i, "Attempt": 0, "Launch Time": start, "Finish Time": end or 0, "Executor ID": "1", "Host": "h", "Locality": "ANY", "Speculative": False, "Failed": False, "Killed": False, "Accumulables": []}
    if end is None:
        return line("SparkListenerTaskStart", **{"Stage ID": 0, "Stage Attempt ID": 0, "Task Info": info})
    return line("SparkListenerTaskEnd", **{"Stage ID": 0, "Stage Attempt ID": 0, "Task Type": "ResultTask", "Task End Reason": {"Reason": "Success"}, "Task Info": info, "Task Metrics": {"Executor Run Time": 5}})


@pytest.fixture()
def folder(tmp_path):
    root = tmp_path / "logs"
    root.mkdir()
    t0 = 1_700_000_000_000
    day = 24 * 3600 * 1000
    first = [task(i, t0 + i) for i in range(5)] + [task(i, t0 + i, t0 + 100 + i) for i in range(3)]
    (root / "app-1-1").write_text("\n".join(first) + "\n")
    late = [task(99, t0 + day), task(99, t0 + day, t0 + day + 5), line("SparkListenerApplicationEnd", Timestamp=t0 + day + 9)]
    (root / "app-2-1").write_text("\n".join(late) + "\n")
    return root


def run(df, spark, mode, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert not q.isActive
    return spark.sql(f"SELECT * FROM {name}").collect()


def test_live_totals_equal_batch(spark, folder, tmp_path):
    from emberlens.operators.extract import task_ends
    from emberlens.operators.stages import stage_totals
    from emberlens.sources.eventlog import event_lines
    from emberlens.streaming import live

    got = run(live.live_totals(live.event_stream(spark, str(folder))), spark, "complete", tmp_path, "totals")
    want = stage_totals(task_ends(event_lines(spark, str(folder)))).select("app_id", "tasks", "run_ms").collect()
    assert sorted((r.app_id, r.tasks, r.run_ms) for r in got) == sorted(tuple(r) for r in want)


def test_tasks_that_never_ended(spark, folder, tmp_path):
    from emberlens.streaming import live

    events = live.event_stream(spark, str(folder), max_files=1)
    rows = run(live.unended_tasks(events, "1 hour"), spark, "append", tmp_path, "unended")
    assert sorted(r.task_id for r in rows if r.ended is not None) == [0, 1, 2, 99]


def events_frame(spark, tmp_path, rows):
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, "k string, t timestamp, n long").write.parquet(path)
    return spark.readStream.schema("k string, t timestamp, n long").parquet(path)


def at(s):
    return datetime.fromtimestamp(1_700_000_000 + s, timezone.utc)


def test_sessions_and_flows(spark, tmp_path):
    from emberlens.streaming import live

    rows = [("a", at(s), 10) for s in (0, 30, 80, 200, 210)] + [("a", at(99999), 1)]
    df = events_frame(spark, tmp_path, rows)
    got = run(live.sessions(df, ["k"], "t"), spark, "complete", tmp_path, "sess")
    assert sorted(r.n for r in got) == [1, 2, 3]
    flows = run(live.flow_series(df, [], "t", "k", "n", "100 seconds"), spark, "complete", tmp_path, "flows")
    assert sum(r.bytes for r in flows) == 51
    first = run(live.first_failures(df, ["k"], "t", "k"), spark, "complete", tmp_path, "firsts")
    assert first[0].n == 6


def test_app_states(spark, folder, tmp_path):
    from emberlens.streaming import live

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = run(live.app_states(live.event_stream(spark, str(folder))), spark, "update", tmp_path, "states")
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    states = {(r.app_id, r.state) for r in rows}
    assert ("app-2-1", "ended") in states and ("app-1-1", "running") in states
