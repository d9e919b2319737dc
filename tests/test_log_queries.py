"""Event-log and log-text operators on lines derived from the smallest tables, against the same rows by SQL from the tables."""

import duckdb
import pytest

from emberlens.plans import kernel_queries, log_queries

SF = "/root/testdata/sf0.001"
LIGHT = (
    "log_stage_totals", "log_task_failures", "log_running_tasks", "log_jobs", "log_job_stage", "log_block_kinds", "log_cached_blocks", "log_exclusions", "log_settings", "log_components", "log_plan_nodes", "log_sql_ends",
    "log_event_counts", "log_driver_events", "log_rebuilt_tasks", "log_task_steps", "log_file_times", "log_memory_config", "log_stage_spill", "log_host_totals", "log_io_totals", "log_executor_heat", "masked_secrets", "part_sizes", "exit_codes", "log_run_notes", "log_findings",
)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in ("orders", "events", "documents", "part"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", LIGHT)
def test_query_equals_its_sql(spark, tables, name):
    assert log_queries.query is kernel_queries.query
    out = kernel_queries.QUERIES[name](spark, SF)
    cols = sorted(out.columns)
    want = tables.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({kernel_queries.SQL[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in out.select(*cols).collect()))) == sorted(map(repr, want))
    assert want


def test_a_share_of_unknown_heap_is_unknown(spark):
    from emberlens.operators import extract as X
    from emberlens.operators import memory as M

    keys = "app_id string, attempt int, executor_id string, "
    peaks = spark.createDataFrame([(app, 1, "1", *[1 << 20] * len(X.GAUGES)) for app in ("a", "b")], keys + ", ".join(f"{g} bigint" for g in X.GAUGES))
    totals = spark.createDataFrame([("a", 1, "1", 5, 10), ("b", 1, "1", 5, 10)], keys + "gc_ms bigint, run_ms bigint")
    config = spark.createDataFrame([("a", 1, 1 << 21, 1 << 30)], "app_id string, attempt int, heap bigint, driver_heap bigint")
    got = {x.app_id: (x.heap, x.heap_share, x.gc_share) for x in M.memory_use(peaks, totals, config).collect()}
    assert got == {"a": (1 << 21, 0.5, 0.5), "b": (None, None, 0.5)}


def test_rows_of_one_instant_are_one_session(spark):
    """The SQL of sessions, where ids run against the rows' order within an instant."""
    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT 1000 - i AS event_id, i % 3 AS user_id, 'click' AS event_type, TIMESTAMP '2024-01-01' + to_hours(CAST(i // 30 * 12 AS INTEGER)) AS ts FROM range(300) r(i)")
    assert sorted(con.execute(f"SELECT user_id, n FROM ({kernel_queries.SQL['sessions']})").fetchall()) == [(u, 10) for u in range(3) for _ in range(10)]


def _plan(spark, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "100")
    return kernel_queries.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_written_once(spark):
    assert _plan(spark, "log_stage_totals").count("StructsToJsonEvaluator(Map(") == 1


def test_plans_are_walked_once_and_not_joined(spark):
    nodes, data = _plan(spark, "log_plan_nodes"), _plan(spark, "log_plan_data")
    assert "Join" not in nodes and "Aggregate" not in nodes, nodes
    assert data.count("MapInArrow") == 1 and "strategy=merge" in data, data


@pytest.mark.parametrize("name", ["log_task_ends", "log_stage_dist", "log_executor_heat"])
def test_lines_are_parsed_once(spark, name):
    assert _plan(spark, name).count("from_json(") == 1


def test_lines_without_fields_keep_their_row(spark):
    from emberlens.operators import extract as X

    lines = [("a", 1, 0, "f", k, "SparkListenerApplicationEnd", v) for k, v in enumerate((None, "{", "{}", '{"Timestamp": 7}'))]
    events = spark.createDataFrame(lines, "app_id string, attempt int, part long, file string, line long, event string, value string")
    assert sorted((x.line, x.t) for x in X.app_ends(events).collect()) == [(0, None), (1, None), (2, None), (3, 7)]


def test_only_named_fields_are_parsed(spark):
    """A query that sums three counters doesn't parse the others, and gets the same values."""
    from emberlens.operators import extract as X
    from emberlens.plans import fleet as L

    plan = _plan(spark, "log_stage_spill")
    lines = L.task_end_lines(L.item_rows(spark, SF))
    some = ("status", "scheduler_delay_ms", "getting_ms", "disk_spill", "task_id")
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    parsed = [x for x in X.task_ends(lines, some)._jdf.queryExecution().analyzed().toString().splitlines() if "from_json(" in x]
    assert parsed and not any("JVMHeapMemory," in x and "Accumulables,array" in x for x in parsed) and plan.count("from_json(") == 1
    names = str(X._fields("`A B` struct<`C`: int, D: struct<E: int, F: int>>, G int, H map<string,string>", ("e.`A B`.D.E + 1", "element_at(e.H, 'G')")).simpleString())
    assert names == "struct<A B:struct<D:struct<E:int>>,H:map<string,string>>"
    assert sorted(X.task_ends(lines, some).select(*some).collect()) == sorted(X.task_ends(lines).select(*some).collect())


def test_jobs_are_sorted_once(spark):
    """Of several starts the first counts, of several ends the last, without a join or an aggregate of texts; ends of no job are left out."""
    from emberlens.operators import stages as S

    place = "app_id string, attempt int, part long, file string, line long, job_id int, "
    starts = spark.createDataFrame([("a", 1, 0, "f", 5, 1, 50), ("a", 1, 0, "f", 2, 1, 20), ("a", 1, 0, "f", 9, 2, 90), ("a", 1, 0, "f", 10, None, 7)], place + "submitted long")
    ends = spark.createDataFrame([("a", 1, 0, "f", 6, 1, 60, "JobSucceeded", None), ("a", 1, 0, "f", 7, 1, 70, "JobFailed", "gone"), ("a", 1, 0, "f", 8, 3, 80, "JobFailed", None), ("a", 1, 0, "f", 11, None, 8, "JobFailed", None)], place + "completed long, result string, message string")
    out = S.jobs(starts, ends)
    assert sorted(((x.job_id, x.submitted, x.line, x.completed, x.failed, x.error) for x in out.collect()), key=str) == [(1, 20, 2, 70, True, "gone"), (2, 90, 9, None, False, None), (None, 7, 10, None, False, None)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan, plan


def test_only_wanted_tables_are_stored(spark, tmp_path):
    from emberlens.plans import fleet as L
    from emberlens.plans.gold import gold_tables

    orders = L.order_rows(spark, SF)
    out = gold_tables(L.job_lines(orders).unionByName(L.app_lines(orders)), store=str(tmp_path), only=("jobs", "applications"))
    assert set(out) == {"jobs", "applications", "findings"} and {x.name for x in tmp_path.iterdir()} == {"events", "jobs", "applications"}
    assert {x.rule for x in out["findings"].select("rule").distinct().collect()} == {"job-failed"}
