"""Event logs that small jobs of our own write, read back as tables and held against their raw JSON."""

import json
import os
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import pytest

HERE = Path(__file__).resolve().parent


@pytest.fixture(scope="module")
def logs(tmp_path_factory):
    path = tmp_path_factory.mktemp("events") / "logs"
    path.mkdir()
    env = {k: v for k, v in os.environ.items() if not k.startswith("PYSPARK_GATEWAY")}
    subprocess.run([sys.executable, str(HERE / "make_eventlog.py"), str(path)], check=True, timeout=300, env=env, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
    file = next(p for p in path.iterdir() if not p.name.startswith("."))
    text = file.read_text()
    # the same run without its end and with broken lines, as a second application
    other = path / "app-20260101000000-0001.inprogress"
    kept = [x for x in text.splitlines() if "ApplicationEnd" not in x]
    other.write_text("\n".join([*kept[:10], "{broken", *kept[10:-1], kept[-1][:40]]))
    return path, [json.loads(x) for x in text.splitlines()]


@pytest.fixture(scope="module")
def gold(spark, logs, tmp_path_factory):
    from emberlens.plans.gold import gold_tables
    from emberlens.sources.eventlog import event_lines

    events = event_lines(spark, str(logs[0])).cache()
    return events, gold_tables(events, store=str(tmp_path_factory.mktemp("gold")))


def mine(df):
    return df.filter("app_id like 'local-%'")


def test_lines_are_numbered_in_any_split(spark, tmp_path):
    from emberlens.sources.eventlog import read_lines, with_line_numbers

    (tmp_path / "a.txt").write_text("".join(f"line {i}\n" for i in range(1, 3001)))
    (tmp_path / "b.txt").write_text("line 1\nline 2")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = with_line_numbers(read_lines(spark, str(tmp_path))).select("value", "line").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 3002 and all(r.value == f"line {r.line}" for r in rows)


def test_lines_are_numbered_where_they_are_read(spark, tmp_path):
    """Lines of split, packed, compacted and empty files keep their numbers, and no line is shuffled for them."""
    from emberlens.sources.eventlog import event_lines

    for name, n in (("app-1-1/events_1_app-1-1", 900), ("app-1-1/events_2_app-1-1.compact", 700), ("app-1-1/events_3_app-1-1", 3), ("app-2-2", 1), ("app-3-3", 0), ("app-4-4", 2000)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("".join(f'{{"Event":"E","k":{i}}}\n' for i in range(1, n + 1)))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in old:
        spark.conf.set(k, "4096" if "max" in k else "10")
    try:
        events = event_lines(spark, str(tmp_path))
        rows = [(r.app_id, r.part, r.line, r.value) for r in events.collect()]
        plan = events._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = [("app-1-1", 2, 700), ("app-1-1", 3, 3), ("app-2-2", 0, 1), ("app-4-4", 0, 2000)]
    assert sorted(rows) == sorted((app, part, i, f'{{"Event":"E","k":{i}}}') for app, part, n in want for i in range(1, n + 1))
    assert "row_number" not in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan, plan


def test_counts_and_quality(logs, gold):
    events, tables = gold
    want = Counter(e["Event"].rpartition(".")[2] for e in logs[1])
    assert {r.event: r.n for r in mine(tables["event_counts"]).collect()} == want
    quality = {Path(r.file).name[:3]: r for r in tables["line_quality"].collect()}
    assert (quality["app"].malformed, quality["app"].first_malformed, quality["app"].truncated) == (1, 11, True)
    assert (quality["loc"].malformed, quality["loc"].truncated) == (0, False)


def test_stage_totals_equal_the_raw_events(logs, gold):
    want = defaultdict(lambda: [0, 0, 0, 0])
    for e in logs[1]:
        if e["Event"] == "SparkListenerTaskEnd":
            m, w = e.get("Task Metrics") or {}, want[e["Stage ID"], e["Stage Attempt ID"]]
            w[0] += 1
            w[1] += m.get("Executor Run Time", 0)
            w[2] += m.get("Shuffle Write Metrics", {}).get("Shuffle Bytes Written", 0)
            w[3] += e["Task End Reason"]["Reason"] != "Success"
    got = {(r.stage_id, r.stage_attempt): [r.tasks, r.run_ms, r.shuffle_write_bytes, r.failed + r.killed] for r in mine(gold[1]["stage_totals"]).collect()}
    assert got == dict(want)


def test_states(gold):
    t = gold[1]
    apps = {r.app_id[:3]: r for r in t["applications"].collect()}
    assert apps["loc"].name == "fixture" and apps["loc"].state in ("succeeded", "failed") and apps["loc"].duration_ms > 0
    assert apps["app"].state == "incomplete"
    jobs = mine(t["jobs"]).collect()
    assert sum(r.failed for r in jobs) == 1 and "ZeroDivisionError" in next(r.error for r in jobs if r.failed)
    states = Counter(r.state for r in mine(t["stages"]).collect())
    assert states["failed"] == 1 and states["complete"] >= 4


def test_settings_hide_secrets(gold):
    rows = mine(gold[1]["settings"]).collect()
    assert any(r.redacted for r in rows) and not any("planted-secret-value" in (r.value or "") for r in rows)


def test_run_path_tiles_the_run(gold):
    app = mine(gold[1]["applications"]).first()
    steps = mine(gold[1]["run_path"]).orderBy("step").collect()
    assert steps[0].start == app.started and steps[-1].end == app.ended
    assert all(a.end == b.start for a, b in zip(steps, steps[1:], strict=False)) and any(s.kind == "stage" for s in steps)


def test_plans_and_operators(gold):
    nodes = mine(gold[1]["plan_nodes"]).collect()
    assert {"Exchange"} <= {r.name.split()[0] for r in nodes} and min(r.node for r in nodes) == 0
    assert all(r.parent < r.node for r in nodes)
    spread = mine(gold[1]["operator_spread"]).collect()
    assert spread and all(r.lo <= r.p50 <= r.hi for r in spread)


def test_every_table_can_be_computed(gold):
    for name, df in gold[1].items():
        assert df.count() >= 0, name
    assert mine(gold[1]["critical_path"]).count() > 0
    assert mine(gold[1]["cached_blocks"]).count() > 0


def test_findings(gold):
    rows = gold[1]["findings"].collect()
    rules = {r.rule for r in rows}
    assert {"job-failed", "access-static-keys"} <= rules
    assert all(r.evidence and r.severity in ("critical", "warning", "info") for r in rows)


def test_event_at_is_masked(gold):
    from emberlens.sources.eventlog import event_at

    events = gold[0]
    at = events.filter("event = 'SparkListenerEnvironmentUpdate'").first()
    shown = event_at(events, at.file, at.line).first()
    assert shown.line == at.line


def test_parts_and_attempts(spark):
    from emberlens.sources import eventlog as E

    files = [("d", "d/events_1_app"), ("d", "d/events_2_app.compact"), ("d", "d/events_3_app"), ("e", "e/app-1-2")]
    kept = {r.file for r in E.live_parts(spark.createDataFrame(files, "folder string, file string")).collect()}
    assert kept == {"d/events_2_app.compact", "d/events_3_app", "e/app-1-2"}
    attempts = [("a", 1, "a_1"), ("a", 2, "a_2.inprogress"), ("a", 2, "a_2")]
    latest = {r.file for r in E.latest_attempts(spark.createDataFrame(attempts, "app_id string, attempt int, file string")).filter("is_latest").collect()}
    assert latest == {"a_2"}


def test_repeated_ends_multiply_nothing(spark):
    from emberlens.operators import stages as S

    app = "app_id string, attempt int"
    events = spark.createDataFrame([("a", 1, i, 0, False, 0, i, "count at x.py:1", 2, [0], None, None, 5, None) for i in range(6)], f"{app}, stage_id int, stage_attempt int, completed_event boolean, part long, line long, name string, num_tasks int, parents array<int>, details string, failure string, submitted long, completed long")
    totals = spark.createDataFrame([("a", 1, 0, 0, 2, 9)], f"{app}, stage_id int, stage_attempt int, tasks long, run_ms long")
    ended = spark.createDataFrame([("a", 1)] * 5, app)
    rows = S.stages(events, totals, ended).collect()
    assert len(rows) == 6 and {x.state for x in rows} == {"incomplete"}
    starts = spark.createDataFrame([("a", 1, 3, 5, [1], None, "f", n, 0) for n in (7, 4)], f"{app}, job_id int, submitted long, stage_ids array<int>, execution_id long, file string, line long, part long").selectExpr("*", "array(named_struct('Stage ID', 1, 'Stage Name', 'n')) as stage_infos")
    ends = spark.createDataFrame([("a", 1, 3, 10 + n, "JobSucceeded", None, "f", n, 0) for n in (8, 9)], f"{app}, job_id int, completed long, result string, message string, file string, line long, part long")
    job = S.jobs(starts, ends).collect()
    assert [(x.line, x.completed, x.failed, x.name) for x in job] == [(4, 19, False, "n")]


def test_the_run_path_is_that_of_a_plain_search():
    import random
    import time

    from emberlens.operators.stages import walk_back

    def plain(rows, jobs, start, t, slack):
        out, used, parents = [], set(), None
        gap = lambda a, b: b > a and out.append(("scheduling" if any(x <= (a + b) // 2 <= y for x, y in jobs) else "driver", None, None, a, b))
        while t > start:
            free = [(c, k) for k, (a, c, _) in rows.items() if k not in used and c <= t + slack and a < t]
            pool = [x for x in free if parents is not None and x[1][0] in parents] or free
            if not pool:
                break
            c, k = max(pool)
            used.add(k)
            a, end = max(start, rows[k][0]), min(c, t)
            gap(max(start, end), t)
            if end > a:
                out.append(("stage", k[0], k[1], a, end))
                t = a
            elif end > start:
                t = min(t, max(start, end))
            parents = rows[k][2]
        gap(start, t)
        return out[::-1]

    r = random.Random(9)
    for _ in range(300):
        rows = {}
        for i in range(r.randint(0, 12)):
            a = r.randint(-50, 400)
            rows[r.randint(0, 8), r.randint(0, 1)] = (a, a + r.randint(0, 120), [r.randint(0, 8) for _ in range(r.randint(0, 3))])
        jobs = [(x, x + r.randint(0, 100)) for x in (r.randint(-20, 400) for _ in range(r.randint(0, 4)))]
        assert walk_back(rows, jobs, 0, 400, 20) == plain(rows, jobs, 0, 400, 20)
    began = time.time()
    many = {(i, 0): (i * 10, i * 10 + 9, [i - 1]) for i in range(100_000)}
    assert len(walk_back(many, [(0, 10**6)], 0, 10**6, 50)) > 100_000 and time.time() - began < 5
