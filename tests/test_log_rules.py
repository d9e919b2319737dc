"""Each rule over logs and metrics fires where it should and stays silent where it should not."""

from datetime import datetime, timedelta, timezone

import pytest

T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)


@pytest.fixture(scope="module")
def tables(spark):
    hits = [("bad", "f", 1, T0, "executor", "access-denied", {"what": "s3://b"}), ("bad", "f", 2, T0 + timedelta(seconds=5), "executor", "out-of-memory", {"what": "heap"}), ("bad", "f", 3, None, "executor", "class-missing", {"name": "a/b/C"}),
            ("bad", "f", 4, T0, "driver", "executor-lost", {"reason": "gone"}), ("bad", "f", 5, T0, "executor", "not-cached", {"block": "rdd_1_1"}), ("bad", "f", 6, T0, "executor", "kerberos-failure", {}), ("bad", "f", 7, T0, "executor", "memory-kill", {}),
            ("good", "g", 1, T0, "executor", "slow-heartbeat", {"ms": "1"})]
    g = 1 << 30
    steps = [("bad", str(e), "f", 10 + e, T0, e, "blocks", None, None, 5 * g if e == 1 else g // 2, None) for e in range(1, 5)]
    steps += [("bad", "1", "f", 20, T0, 1, "stored", g, None, None, "broadcast_7"), ("bad", "1", "f", 21, T0, 1, "broadcast", None, 12_000, None, "7"), ("bad", "1", "f", 22, T0, 1, "spill", 2 * g, None, None, None), ("bad", "1", "f", 23, T0, 1, "commit", None, 90_000, None, None)]
    steps += [("good", "1", "g", 1, T0, 1, "blocks", None, None, 10, None), ("good", "1", "g", 2, T0, 1, "spill", 10, None, None, None), ("good", "1", "g", 3, T0, 1, "stored", 10, None, None, "broadcast_1")]
    stories = [("bad", "f", 1, T0, T0 + timedelta(seconds=100)), ("good", "g", 1, T0, T0 + timedelta(seconds=100))]
    points = []
    for app, pending, cpu, mem, n in (("bad", 5.0, 90.0, 99.0, 3.0), ("good", 0.0, 20.0, 30.0, 1.0)):
        for m in range(5):
            t = m * 60_000
            points += [(app, 1, x, "n1", 60, t, v) for x, v in (("ContainerPending", pending), ("YARNMemoryAvailablePercentage", 50.0), ("CPUUtilization", cpu), ("mem_used_percent", mem), ("AppsRunning", n))]
    return {
        "hits": spark.createDataFrame(hits, "app string, file string, line long, t timestamp, kind string, hit string, fields map<string,string>"),
        "steps": spark.createDataFrame(steps, "app string, executor string, file string, line long, t timestamp, task_id long, step string, bytes long, ms long, remote long, name string"),
        "stories": spark.createDataFrame(stories, "app string, file string, task_id long, started timestamp, ended timestamp"),
        "points": spark.createDataFrame(points, "app_id string, attempt int, name string, scope string, period_s int, t long, v double"),
        "applications": spark.createDataFrame([("bad", 1, "failed", 300_000), ("good", 1, "succeeded", 300_000)], "app_id string, attempt int, state string, duration_ms long"),
    }


def test_rules(tables):
    from emberlens.plans.log_rules import log_findings

    rows = log_findings(tables).collect()
    assert not [r for r in rows if r.app_id == "good"]
    rules = {r.rule: r for r in rows}
    assert set(rules) == {"log-first-failure", "out-of-memory", "executor-memory-kill", "access-denied", "kerberos-failure", "classpath-clash", "executor-lost", "cache-evicted", "shuffle-network", "broadcast-large", "task-spill", "commit-slow", "waited-for-capacity", "shared-cluster", "host-cpu-saturated", "host-memory-pressure"}
    assert rules["shuffle-network"].severity == "warning" and rules["waited-for-capacity"].args["variant"] == "fragmented"
    assert rules["log-first-failure"].args["kind"] == "memory-kill" and rules["classpath-clash"].args["name"] == "a.b.C"
