"""Reads of a region store on small tables of our own."""

import pytest

SPLIT = "app string, stage_id int, executor string, table string, start_row string, end_row string, region string, server string, bytes long, partition int"
TASK = "app string, stage_id int, partition int, executor_id string, launched long, finished long, duration_ms long, status string, task_attempt int"


def keys(i, n):
    return ("" if i == 0 else f"\\x{i:02x}", "" if i == n - 1 else f"\\x{i + 1:02x}")


@pytest.fixture(scope="module")
def tables(spark):
    n = 12
    splits = [("a", 1, str(i % 2), "t", *keys(i, n), f"r{i}", "s1" if i < 10 else "s2", 1 << 20, None) for i in reversed(range(n))]
    splits += [("a", 2, str(i % 2), "t", *keys(i, n), f"r{i}", "s1" if i < 10 else "s2", 1 << 20, i) for i in range(n)]
    splits += [("a", 3, "9", "t", *keys(i, n), f"r{i}", "s1", 1, None) for i in range(3)]
    tasks = [("a", s, i, str(i % 2), 1000 * s, 1000 * s + (90_000 if i < 10 else 70_000), 90_000 if i == 0 else 1000, "succeeded", 0) for s in (1, 2) for i in range(n)]
    tasks += [("a", 2, 4, "1", 100, 200, 100, "failed", 1)]
    stages = spark.createDataFrame([("a", 1, n), ("a", 2, n), ("a", 3, n)], "app string, stage_id int, num_tasks int")
    return spark.createDataFrame(splits, SPLIT), spark.createDataFrame(tasks, TASK), stages


def test_ties_only_what_agrees(tables):
    from emberlens.operators import store as S

    splits, tasks, stages = tables
    rows = S.tie_splits(splits, tasks, stages).collect()
    assert {(r.region, r.partition) for r in rows if r.stage_id == 1} == {(f"r{i}", i) for i in range(12)}
    assert {r.why for r in rows if r.stage_id == 3} == {"splits and tasks differ in number"} and all(r.partition is None for r in rows if r.stage_id == 3)
    assert all(r.partition == int(r.region[1:]) for r in rows if r.stage_id == 2)


def test_load_and_findings(spark, tables):
    from emberlens.operators import store as S

    splits, tasks, stages = tables
    tied = S.tie_splits(splits, tasks, stages)
    read = S.region_tasks(tied, tasks)
    assert {(r.stage_id, r.partition) for r in read.filter("slow").collect()} == {(1, 0), (2, 0)}
    load = {r.server: r for r in S.server_load(read).collect()}
    assert load["s1"].peak == 20 and load["s1"].hot_from is not None and load["s2"].hot_from is None
    events = spark.createDataFrame([("a", "r0", "flush", 5000, 6000), ("a", "r3", "move", 5000, 6000), ("a", "r0", "move", 10**9, 10**9)], "app string, region string, event string, start long, end long")
    met = {(r.region, r.event): r for r in S.region_event_tasks(events, read).collect()}
    assert set(met) == {("r0", "flush"), ("r3", "move")} and len(met["r0", "flush"].slow_tasks) == 2
    rules = {r.rule for r in S.store_findings(tied, read, events).collect()}
    assert rules == {"store-hotspot", "store-full-scan", "store-repeated-scan", "store-retried-region", "store-scan-skew", "store-server-load", "store-region-event"}
