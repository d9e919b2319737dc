"""Code lines, stage data, quoted regions and owners of lines: against SQL on tables and against plain Python on small cases."""

import random
import re

import duckdb
import pytest

from emberlens.plans import kernel_queries, source_queries

SF = "/root/testdata/sf0.001"
OWN = [n for n, f in kernel_queries.QUERIES.items() if f.__module__ == source_queries.__name__]


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in ("events", "pages", "part", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", OWN)
def test_query_equals_its_sql(spark, tables, name):
    out = kernel_queries.QUERIES[name](spark, SF)
    cols = sorted(out.columns)
    want = tables.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({kernel_queries.SQL[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in out.select(*cols).collect()))) == sorted(map(repr, want))
    assert want


def test_tails_are_the_longest_common_ones(spark):
    from emberlens.operators import codelines as L

    r = random.Random(2)
    path = lambda: "/".join(r.choice(["a", "b", "c", "job.py"]) for _ in range(r.randint(1, 5)))
    logged, sources = [path() for _ in range(60)] + ["C:\\a\\b\\job.py", "//a//job.py", "", None, "x/y/zz"], [path() for _ in range(40)] + ["s3://k/a/b/job.py", None]
    parts = lambda p: [x for x in re.split(r"[/\\]+", p) if x]

    def shared(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[-1 - n] == b[-1 - n]:
            n += 1
        return n

    rows = L.match_tails(spark.createDataFrame([(x, 1) for x in logged], "path string, shared int"), spark.createDataFrame([(x,) for x in sources], "path string"), "path", "path").collect()
    assert sorted(x.file for x in rows) == sorted({x for x in logged if x is not None})
    for x in rows:
        by = {p: shared(parts(x.file), parts(p)) for p in set(sources) if p}
        most = max(by.values())
        best = sorted(p for p, n in by.items() if n == most > 0)
        assert (x.path, x.shared, x.others) == (best[0] if best else None, most, max(0, len(best) - 1)), x


def test_frames_and_call_sites(spark):
    from pyspark.sql import functions as F

    from emberlens.operators import codelines as L

    stack = "org.apache.spark.rdd.RDD.count(RDD.scala:9)\n\tat java.base/java.lang.X.y(X.java:1)\n at com.me.Job$.main(Job.scala:42)\ncom.me.Job.run(Job.scala:0)\napp//com.me.B.c(B.java:7)\nno frame"
    cases = {
        ("count at Job.scala:42", stack): [("Job.scala", 42, "count"), ("B.java", 7, None)],
        ("count at /jobs/etl.py:32", None): [("/jobs/etl.py", 32, "count")],
        ("count at NativeMethodAccessorImpl.java:0", ""): [],
        ("run at <stdin>:1", None): [],
        ("no place", stack): [("Job.scala", 42, None), ("B.java", 7, None)],
        (None, None): [],
    }
    rows = spark.createDataFrame(list(cases), "site string, details string").select("*", L.code_of(F.col("site"), F.col("details")).alias("code")).collect()
    assert {(x.site, x.details): [(c.file, c.line, c.action) for c in x.code] for x in rows} == cases


def test_descriptions_name_the_line_that_set_them(spark):
    from emberlens.operators import codelines as L

    lines = {
        1: 'sc.setJobDescription(f"load {table} into (cold) store")', 2: "sc.setLocalProperty('spark.job.description', 'daily report')", 3: 'sc.setJobDescription("load %s into warm store" % t)', 4: 'x.setJobDescription(f"{a}{b}")',
        5: 'sc.setJobDescription("twice the same")', 6: 'sc.setJobDescription("twice the same")', 7: 'sc.setJobDescription(r"raw {kept} text")', 8: 'sc.setJobDescription("open string', 9: r'sc.setJobDescription("a \"quoted\" word")', 10: "nothing",
    }
    said = {"load x into (cold) store": 1, "load  into (cold) store": 1, "daily report": 2, "daily reports": None, "load orders into warm store": 3, "twice the same": None, "raw {kept} text": 7, "raw x text": None, 'a "quoted" word': 9, "ab": None, "": None}
    df = spark.createDataFrame([("f.py", k, v) for k, v in lines.items()], "file string, line int, value string")
    got = {x.description: x.line for x in L.match_descriptions(spark.createDataFrame([(x,) for x in [*said, None]], "description string"), L.description_patterns(df)).collect()}
    assert got == {k: v for k, v in said.items() if v}


def test_folders_hold_what_is_below_them(spark):
    from emberlens.operators import stagedata as D

    paths = [("a", "/x/y/z"), ("a", "/x/yz"), ("a", "s3://b/k/"), ("b", "/x/y/z"), ("a", None), (None, "/x/y"), ("a", ""), ("a", "/x/y/z")]
    folders = [("a", "/x/y"), ("a", "/x/"), ("a", "s3://b/k"), ("b", "/q"), ("a", None), ("a", "/x")]
    rows = D.folders_holding(spark.createDataFrame(paths, "k string, p string"), spark.createDataFrame(folders, "k string, f string"), ["k"], "p", "f").collect()
    want = {("a", "/x/y/z"): "/x/y", ("a", "/x/yz"): "/x", ("a", "s3://b/k/"): "s3://b/k"}
    assert sorted(((x.k, x.p, x.folder) for x in rows), key=repr) == sorted(((k, p, want.get((k, p))) for k, p in paths), key=repr)


def test_plans_fold_into_the_folders_that_logs_name(spark):
    from emberlens.operators import stagedata as D

    stage = ("a", 1, 2, 0)
    rows = [
        (*stage, "read", "path", "s3://b/t/", 2, 2, 10, "", "executor logs"), (*stage, "read", "path", "s3://b/t/d=1/f1, s3://b/t/d=2/f2", 1, 0, 0, "parquet", "SQL plan"), (*stage, "read", "path", "s3://b/u/f1, s3://b/t/f2", 1, 0, 0, "orc", "SQL plan"),
        (*stage, "write", "path", "s3://b/t/f1", 1, 0, 0, "csv", "SQL plan"), (*stage, "read", "table", "n:t", 1, 0, 5, None, "region store"), (*stage, "read", "table", "n:t", 1, 0, 5, None, "region store"), (*stage, "read", "path", None, 1, 0, 0, "", "SQL plan"), (*stage, "read", "path", "x", 1, 0, 0, "", "elsewhere"),
    ]
    df = spark.createDataFrame(rows, "app_id string, attempt int, stage_id int, stage_attempt int, access string, kind string, name string, parts long, sized long, bytes long, format string, source string")
    got = {(x.access, x.name): (x.parts, x.bytes, x.format, x.paths, x["from"]) for x in D.merge_stage_data(df).collect()}
    assert got == {
        ("read", "s3://b/t"): (3, 10, "parquet", ["s3://b/t/d=1/f1", "s3://b/t/d=2/f2"], ["executor logs", "SQL plan"]), ("read", "s3://b/u/f1, s3://b/t/f2"): (1, 0, "orc", [], ["SQL plan"]),
        ("write", "s3://b/t/f1"): (1, 0, "csv", [], ["SQL plan"]), ("read", "n:t"): (2, 10, None, [], ["region store"]),
    }
    assert D.merge_stage_data(df.limit(0)).count() == 0


def test_a_quoted_error_counts_once(spark):
    from emberlens.operators import logtext as L
    from emberlens.operators.quoted import drop_quoted, quoted_regions

    head = "25/01/02 03:04:05 "
    error = "java.lang.OutOfMemoryError: Java heap space"
    text = [head + "ERROR Executor: " + error, head + "INFO Client: Application diagnostics message: User class threw", error, "\tat a.B.c(B.java:1)", ". Failing the application.", "after", "Application diagnostics message: x", "q", 'Exception in thread "main" ' + error, "Application diagnostics message: open to the end", error]
    lines = spark.createDataFrame([("f", i + 1, v) for i, v in enumerate(text)] + [("g", 1, error), ("g", 2, None)], "file string, line long, value string")
    hits = lambda df: df.filter(df.value.contains("OutOfMemory")).count()
    assert hits(lines) == 5 and hits(drop_quoted(lines)) == 3
    assert sorted(map(tuple, quoted_regions(lines, most=5).collect())) == [("f", 3, 5), ("f", 8, 8), ("f", 11, 15)]
    assert sorted(x.line for x in drop_quoted(lines).filter("file = 'f'").collect()) == [1, 2, 6, 7, 9, 10]
    assert L.parse_header(drop_quoted(lines)).filter("level = 'ERROR'").count() == 1


def test_groups_of_equal_sizes_only(spark):
    from emberlens.operators import regionsplits as R

    def run(*rows):
        df = spark.createDataFrame([("f", i, k, t, b) for i, (k, t, b) in enumerate(rows)], "file string, line long, kind string, task long, bytes long")
        return [(x.line, x.task, x.bytes, x.how) for x in R.region_splits(R.owned_lines(df)).orderBy("line").collect()]

    s, z = ("split", None, None), lambda b: ("size", None, b)
    two = [("start", 1, None), ("start", 2, None)]
    assert run(*two, s, s, z(5), z(5)) == [(2, None, 5, "equal group"), (3, None, 5, "equal group")]
    assert run(*two, s, s, z(5), z(6), s, z(7)) == [(2, None, None, None), (3, None, None, None), (6, None, 7, "equal group")]
    assert run(*two, z(4), s, s, z(5)) == [(3, None, None, None), (4, None, None, None)]
    assert run(("start", 1, None), s, z(9), z(8), ("end", 1, None)) == [(1, 1, 9, "only task")]
    assert run(*two, ("split", 2, None), s, ("size", 2, 3), z(4)) == [(2, 2, 3, "named"), (3, None, 4, "equal group")]
    assert run(("size", 7, 1), ("start", 1, None), z(5)) == []


def test_containers_and_attempts(spark):
    from emberlens.operators import accounts as A

    c = lambda attempt, n: f"container_e01_170_0007_{attempt:02d}_{n:06d}"
    files = [("a", "f1", c(2, 3)), ("a", "f2", c(2, 1)), ("a", "f3", c(1, 4)), ("a", "f4", c(2, 5)), ("a", "f5", c(1, 1)), ("a", "f6", None), ("a", "f7", "odd"), ("a", "f8", c(2, 9)), ("z", "f9", c(1, 2))]
    executors = [("a", "1", "h1", c(2, 3)), ("a", "2", "h2", c(2, 9)), ("a", "3", "h2", c(2, 9)), ("a", "4", "h4", None)]
    said = [("f4", 9, "8", "late"), ("f4", 2, "7", "h7"), ("f3", 1, "7", "h7"), ("f9", 1, "5", "h5"), ("f6", 1, "6", "h6")]
    out = A.container_executors(
        spark.createDataFrame(files, "app_id string, file string, container string"), spark.createDataFrame(executors, "app_id string, executor_id string, host string, container string"),
        spark.createDataFrame([("a", c(2, 1), "hd", None, True)], "app_id string, container string, host string, attempt int, cluster boolean"), spark.createDataFrame(said, "file string, line long, executor string, host string"),
    )
    assert {x.file: (x.executor, x.host, x.proof, x.earlier_attempt) for x in out.collect()} == {
        "f1": ("1", "h1", "executor's attribute", None), "f2": ("driver", "hd", "driver's attribute", None), "f3": (None, None, None, 1), "f4": ("7", "h7", "own log", None), "f5": ("driver", None, "first container", 1),
        "f6": (None, None, None, None), "f7": (None, None, None, None), "f8": (None, None, None, None), "f9": ("5", "h5", "own log", None),
    }
    end = "app_id string, attempt int, status string, code int, file string, line long"
    manager = spark.createDataFrame([("a", 1, "FAILED", 13, "rm", 5), ("a", 1, "FAILED", 15, "rm", 9), ("a", 2, "SUCCEEDED", 0, "rm", 11), ("b", 1, "KILLED", None, "rm", 3), ("c", None, "FAILED", 1, "rm", 1)], end)
    own = spark.createDataFrame([("a", 1, "FAILED", 1, "am", 7), ("d", 1, "FAILED", 4, "am", 2)], end)
    ends = A.attempt_ends(manager, own)
    assert {(x.app_id, x.attempt): (x.status, x.code, x.told_by, x.own_line, x.manager_line) for x in ends.collect()} == {
        ("a", 1): ("FAILED", 1, "driver", 7, 9), ("b", 1): ("KILLED", None, "resource manager", None, 3), ("c", 0): ("FAILED", 1, "resource manager", None, 1), ("d", 1): ("FAILED", 4, "driver", 2, None),
    }
    apps = spark.createDataFrame([("a", 2, "succeeded", None), ("b", 1, "succeeded", None), ("d", 1, "incomplete", "x"), ("e", 1, "succeeded", None), ("f", 1, "succeeded", None)], "app_id string, attempt int, state string, reason string")
    sums = spark.createDataFrame([("e", "KILLED"), ("f", "SUCCEEDED")], "app_id string, final string")
    fixed = {x.app_id: (x.state, x.reason) for x in A.correct_status(apps, ends, sums).collect()}
    assert fixed["a"] == ("succeeded", None) and fixed["d"] == ("incomplete", "x") and fixed["f"] == ("succeeded", None)
    assert fixed["b"][0] == fixed["e"][0] == "failed" and fixed["b"][1].endswith("code unknown") and fixed["e"][1].endswith("as killed")
    assert [tuple(x) for x in A.retried(apps, ends).collect()] == [("a", 1, 1)]
    alone = A.app_from_logs(
        spark.createDataFrame([("a", "n", "u", "q", "SUCCEEDED", 1, 2)], "app_id string, name string, user string, queue string, final string, started long, ended long"),
        spark.createDataFrame([("b", "v", "p", "FAILED", 4), ("b", "w", "p", "UNDEFINED", 2)], "app_id string, user string, queue string, final string, line long"), ends,
    )
    got = {x.app_id: (x.name, x.user, x.state, x.reason) for x in alone.collect()}
    assert got["a"] == ("n", "u", "succeeded", None) and got["b"] == (None, "v", "failed", "its application master exited with code unknown") and got["c"][2] == "failed"


def test_words_and_scripts_of_commands(spark):
    import shlex

    from pyspark.sql import functions as F

    from emberlens.functions import commands as C

    plain = ["a b  c", "spark-submit --class x.Y '/a b/c.jar' 1", 'x "a \\"q\\" b" \'c\\d\' e\\ f', "", "  ", "a'b'\"c\"d", "--conf k=v", 'spark-submit -v --conf "a=b c" --name n job.py --day 1', "/x/spark-submit --conf=a.b=c job.py"]
    broken = ['open "quote runs on', "open 'one", "ends in \\", "q" * 300_000 + " " + '"' + "w " * 150_000]
    df = spark.createDataFrame([(x,) for x in [*plain, *broken, None]], "c string").select("c", C.command_words(F.col("c")).alias("w"), C.submitted_script(F.col("c")).alias("s"), C.command_words(C.redact_command(F.col("c"))).alias("again"))
    rows = {x.c: x for x in df.collect()}
    for c in plain:
        assert rows[c].w == shlex.split(c) == rows[c].again, c
    assert rows[broken[0]].w == ["open", "quote runs on"] and rows[broken[1]].w == ["open", "one"] and rows[broken[2]].w[:2] == ["ends", "in"] and rows[None].w is None and len(rows[broken[3]].w) == 2
    assert rows[plain[1]].s == "/a b/c.jar" and rows[plain[7]].s == "job.py" and rows[plain[8]].s == "job.py" and rows["a b  c"].s == "b" and rows[""].s is None


def test_words_of_a_command_are_found_once(spark):
    """Long commands take time in proportion to their words."""
    import time

    from pyspark.sql import functions as F

    from emberlens.functions import commands as C

    long = "spark-submit " + " ".join(f"--opt{i} 'v {i}'" for i in range(400)) + " --my-secret x job.py"
    df = spark.createDataFrame([(c,) for c in ["spark-submit --password x job.py", *[long] * 4]], "c string").coalesce(1).select(C.redact_command(F.col("c")).alias("c"), C.submitted_script(F.col("c")).alias("s"))
    assert df.first() == ("spark-submit --password [redacted] job.py", "job.py")
    began = time.time()
    out = df.collect()
    assert time.time() - began < 10
    assert {x.s for x in out} == {"job.py"} and all(x.c == long.replace("'", '"').replace("secret x", "secret [redacted]") for x in out[1:])


def test_json_is_masked_at_any_depth(spark):
    import json

    from pyspark.sql import functions as F

    from emberlens.functions import commands as C
    from emberlens.functions.text import MASK

    value = {"Properties": [["spark.password", "x"], {"my.secret.key": 'a"b\\', "ok": 1}], "tokens": ["a", "b", 3], "credential": {"u": "v"}, "deep": {"a": {"b": [{"api_key": -1.5}]}}, "say": "password=hunter2 now", "secretless": None, "passwords": {"a": {"password": "x"}, "b": "kept"}}
    text = json.dumps(value)
    got = spark.createDataFrame([(text,), (None,), ("{",), ('{"password": "' + "x" * 1_000_000 + '"}',)], "v string").select(C.redact_json(F.col("v")).alias("v"), C.redact_json(C.redact_json(F.col("v"))).alias("again")).collect()
    out = json.loads(got[0].v)
    assert out["Properties"][1] == {"my.secret.key": MASK, "ok": 1} and out["tokens"] == MASK and out["credential"] == MASK and out["deep"] == {"a": {"b": [{"api_key": MASK}]}} and out["say"] == f"password={MASK} now"
    assert out["secretless"] is None and out["passwords"] == {"a": {"password": MASK}, "b": "kept"} and got[0].again == got[0].v
    assert got[1].v is None and got[2].v == "{" and json.loads(got[3].v) == {"password": MASK}


def test_edits_change_other_rules_findings(spark):
    from emberlens.plans import edits as X

    def run(*rows, hits=()):
        found = [("a", 1, rule, level, "s", {"executor": e} if e else {}, [("f", 1, rule)]) for rule, level, e in rows]
        df = spark.createDataFrame(found, "app_id string, attempt int, rule string, severity string, section string, args map<string,string>, evidence array<struct<file:string,line:bigint,text:string>>")
        h = spark.createDataFrame(list(hits), "app string, executor string, file string, line long, hit string, text string")
        return [(x.rank, x.rule, x.args, [e.text for e in x.evidence]) for x in X.all_findings([df], h).orderBy("rank").collect()]

    assert run(("idle-nodes", "info", "1"), ("idle-nodes", "info", "2"), ("shared-cluster", "info", None)) == [(1, "shared-cluster", {"instead of idle-nodes": "2"}, ["shared-cluster", "idle-nodes", "idle-nodes"])]
    assert run(("idle-nodes", "warning", None), ("executor-fit", "warning", None)) == [(1, "executor-fit", {}, ["executor-fit"]), (2, "idle-nodes", {"see": "executor-fit"}, ["idle-nodes"])]
    hits = [("a", "1", "g", 3, "out-of-memory", "heap"), ("a", "1", "g", 2, "access-denied", "no"), ("a", "2", "g", 1, "spill", "x"), ("a", "driver", "g", 1, "out-of-memory", "y"), ("b", "1", "g", 9, "out-of-memory", "z")]
    out = run(("executor-memory-kill", "critical", "1"), ("executor-lost", "warning", "1"), ("executor-lost", "warning", "2"), ("other", "critical", "1"), hits=hits)
    assert out == [(1, "executor-memory-kill", {"executor": "1"}, ["executor-memory-kill"]), (2, "other", {"executor": "1"}, ["other"]), (3, "executor-lost", {"executor": "1"}, ["executor-lost", "its own log: heap"]), (4, "executor-lost", {"executor": "2"}, ["executor-lost"])]
    assert run(("executor-memory-kill", "critical", "1"), hits=hits) == [(1, "executor-memory-kill", {"executor": "1", "cause": "heap"}, ["executor-memory-kill", "its own log: heap"])]


def test_files_outside_the_run_are_never_read(spark, tmp_path):
    from emberlens.sources import fileindex as I

    files = {
        "containers/application_1_0007/container_1_0007_01_000002/stderr": "a\nb\n", "containers/application_1_0008/container_1_0008_01_000002/stderr": "c\n", "node/ip-10-0-0-1/daemon-2025-01-02-03.log": "d\n",
        "node/ip-10-0-0-1/daemon-2025-01-02-09.log": "e\n", "node/ip-10-0-0-2/daemon-2025-01-02-03.log": "f\n", "node/ip-10-0-0-1/daemon-2025-01-01-20.log": "g\n", "other.txt": "h\n",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    hosts = spark.createDataFrame([("ip-10-0-0-1",)], "host string")
    index = I.scoped(I.file_index(spark, str(tmp_path)), "application_1_0007", "2025-01-02 03:10:00", "2025-01-02 05:00:00", hosts)
    why = {x.file.split(str(tmp_path) + "/")[1]: x.skipped for x in index.collect()}
    assert [why[n] for n in files] == [None, "another application", None, "after the run", "a host that the run didn't use", "before the run", None]
    lines = I.read_scoped(spark, index)
    assert sorted(x.value for x in lines.collect()) == ["a", "b", "d", "h"]
    scanned = {f.rsplit("/", 1)[1] for f in lines.inputFiles()}
    assert scanned == {"stderr", "daemon-2025-01-02-03.log", "other.txt"} and len(lines.inputFiles()) == 3
    status = {(x.reason, x.kind): (x.files, x.bytes, x.lines) for x in I.source_status(index, lines).collect()}
    assert status[None, "executor"] == (1, 4, 2) and status["another application", "executor"] == (1, 2, None)
    assert I.read_scoped(spark, index.filter("false")).count() == 0


def test_late_rows_are_kept_aside_once(spark, tmp_path):
    import time

    from emberlens.streaming.late import kept_rows, late_counts, late_kept

    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    schema = "k string, t timestamp"
    batches = [[("a", "2025-01-01 00:00:00"), ("a", "2025-01-01 00:10:00")], [("a", "2025-01-01 00:08:59"), ("b", "2025-01-01 00:09:00"), ("b", None)], [("a", "2025-01-01 00:20:00")], [("a", "2025-01-01 00:18:00"), ("b", "2025-01-01 00:30:00")]]
    keep = late_kept(out, "t", 60_000)
    for i, rows in enumerate(batches):
        (source / f"{i}.csv").write_text("".join(f"{k},{t or ''}\n" for k, t in rows))
        time.sleep(0.05)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).csv(str(source))
        stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()  # a query that is started again goes on
    late = kept_rows(spark, out, schema, late=True)
    assert sorted((x.k, str(x.t), x.batch) for x in late.collect()) == [("a", "2025-01-01 00:08:59", 1), ("a", "2025-01-01 00:18:00", 3)]
    assert kept_rows(spark, out, schema).count() == 6
    keep(spark.createDataFrame([("a", None)], "k string, s string").selectExpr("k", "cast('2025-01-01 00:18:00' as timestamp) as t"), 3)  # a batch that runs again
    assert late_counts(kept_rows(spark, out, schema, late=True), ["k"], "t").filter("batch = 3").select("k", "n").collect() == [("a", 1)]
    assert kept_rows(spark, out, schema).count() == 5
