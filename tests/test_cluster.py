"""Inventory, metrics, settings and plans on small tables of our own."""

from pyspark.sql import functions as F


def test_exit_codes(spark):
    from emberlens.operators.cluster import exit_meaning

    meaning, severity = exit_meaning(F.col("c"))
    rows = spark.createDataFrame([(0,), (137,), (52,), (-103,), (99,)], "c int").select("c", meaning.alias("m"), severity.alias("s")).collect()
    assert [(r.m, r.s) for r in rows] == [("finished", "info"), ("signal 9", "critical"), ("out of heap", "critical"), ("over virtual memory", "critical"), ("status 99", "warning")]


def test_clusters_and_points(spark):
    from emberlens.operators import cluster as C

    apps = spark.createDataFrame([("a", 1, "c", 5_000_000), ("b", 1, "c", 100), ("d", 1, "x", 9_000_000)], "app_id string, attempt int, cluster_name string, at long")
    clusters = spark.createDataFrame([("j1", "c", 1_000_000, None), ("j2", "c", 4_000_000, None), ("j3", "x", 8_000_000, None), ("j4", "x", 8_100_000, None)], "id string, name string, created long, ended long")
    got = {r.app_id: (r.cluster_id, r.why) for r in C.resolve_cluster(apps, clusters).collect()}
    assert got == {"a": ("j2", None), "b": (None, "none was up"), "d": (None, "created minutes apart")}
    points = [("k", "ns", "cpu", "n1", 60, t, 1.0) for t in (0, 300_000, 600_000)] + [("k", "ns", "cpu", "n2", 60, 300_000, 1.0)]
    p = spark.createDataFrame(points, "cluster_id string, namespace string, name string, scope string, period_s int, t long, v double")
    runs = spark.createDataFrame([("a", 1, "k", 420_000, 500_000)], "app_id string, attempt int, cluster_id string, started long, ended long")
    assert sorted((r.scope, r.t) for r in C.points_in_run(p, runs).collect()) == [("n1", 300_000), ("n2", 300_000)]


def test_instances(spark):
    from emberlens.operators import cluster as C

    hosts = spark.createDataFrame([("a", 1, "ip-10-0-0-1.ec2.internal"), ("a", 1, "10.0.0.2"), ("a", 1, "other")], "app_id string, attempt int, host string")
    inst = spark.createDataFrame(
        [("i1", "ip-10-0-0-1.ec2.internal", "10.0.0.1", "m5", "core", "spot", 0, None, False), ("i2", "node2", "10.0.0.2", "m5", "core", "spot", 0, None, False), ("i3", "node3", "10.0.0.3", "m5", "core", "od", 0, None, False), ("i4", "node4", "10.0.0.4", "m5", "core", "od", 90, None, False), ("i5", "m", "10.0.0.5", "m5", "main", "od", 0, None, True)],
        "id string, private_dns string, private_ip string, type string, role string, market string, created long, ended long, primary boolean",
    )
    apps = spark.createDataFrame([("a", 1, 10, 100)], "app_id string, attempt int, started long, ended long")
    joined = C.join_instances(hosts, inst, apps)
    assert sorted((r.host, r.instance_id) for r in joined.filter("used").collect()) == [("10.0.0.2", "i2"), ("ip-10-0-0-1.ec2.internal", "i1"), ("other", None)]
    assert [r.instance_id for r in C.idle_nodes(joined, inst, apps).collect()] == ["i3"]


def test_settings_and_components(spark):
    from emberlens.operators import cluster as C

    rows = [("a", 1, "spark", "spark.executor.memory", "1024", False), ("a", 1, "spark", "spark.speculation", "TRUE", False), ("a", 1, "classpath", "/x/spark-core_2.13-4.1.2.jar", "System", False), ("a", 1, "spark", "spark.jars", "s3://b/my-lib-1.2.jar, /y/z.jar", False)]
    s = spark.createDataFrame(rows, "app_id string, attempt int, section string, key string, value string, redacted boolean")
    view = {r.key: r.differs for r in C.settings_view(s).collect()}
    assert view["spark.speculation"] and not view["spark.executor.memory"] and not view["spark.task.maxFailures"]
    assert sorted((r.artifact, r.version) for r in C.components(s).collect()) == [("my-lib", "1.2"), ("spark-core_2.13", "4.1.2")]
    sub = spark.createDataFrame([("a", 1, "spark.speculation", "TRUE")], "app_id string, attempt int, key string, value string")
    clu = spark.createDataFrame([("spark.executor.memory", "1024")], "key string, value string")
    origin = {r.key: r.origin for r in C.setting_origin(s, sub, clu).collect()}
    assert origin["spark.speculation"] == "submit" and origin["spark.executor.memory"] == "cluster" and origin["spark.jars"] == "application"


def test_data_of_plans(spark):
    from emberlens.operators import sqlplans as P

    none = "map<string,string>"
    nodes = spark.createDataFrame(
        [("a", 1, 0, "Scan parquet db.t", "x", None), ("a", 1, 0, "Scan parquet ", "x", {"Location": "InMemoryFileIndex(1 paths)[s3://b/in]"}), ("a", 1, 0, "Scan ExistingRDD", "x", None), ("a", 1, 0, "Scan JDBCRelation(orders)", "x", None),
         ("a", 1, 0, "Execute InsertIntoHadoopFsRelationCommand", "Execute InsertIntoHadoopFsRelationCommand s3://b/out, false, [day#1], Parquet, [x]", None), ("a", 1, 0, "Execute CreateDataSourceTableAsSelectCommand", "Execute CreateDataSourceTableAsSelectCommand", None)],
        f"app_id string, attempt int, execution_id long, name string, text string, metadata {none}",
    )
    text = "(1) Execute CreateDataSourceTableAsSelectCommand\nInput: []\nArguments: `cat`.`db`.`new`, ErrorIfExists\n"
    plans = spark.createDataFrame([("a", 1, 0, text)], "app_id string, attempt int, execution_id long, plan_text string")
    got = sorted((r.access, r.kind, r.name, r.format) for r in P.plan_data_refs(nodes, plans).collect())
    assert got == [("read", "path", "s3://b/in", "parquet"), ("read", "table", "db.t", "parquet"), ("read", "table", "orders", "jdbc"), ("write", "path", "s3://b/out", "parquet"), ("write", "table", "cat.db.new", None)]


def test_time_split_adds_up(spark):
    from emberlens.operators.sqlplans import time_split

    df = spark.createDataFrame([(1, 5, 3, 2, 1, 100, 90_000_000, 20, 10, 5_000_000), (2, -1, 0, 0, 0, 100, 10_000_000, 0, 0, 0)], "stage_id int, scheduler_delay_ms long, deser_ms long, result_ser_ms long, getting_ms long, run_ms long, cpu_ns long, gc_ms long, fetch_wait_ms long, shuffle_write_ns long")
    for r in time_split(df, ["stage_id"]).collect():
        assert r.compute_ms + r.gc_ms + r.fetch_ms + r.write_ms + r.other_ms == r.run_ms and r.delay_ms >= 0
