"""Applications on their machines: inventory, metrics, audit calls, settings' origins, capacity and idle nodes.

Inventory, metric and audit tables are exports read with spark.read; no function calls a cloud.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import host_key, share, size_to_bytes
from . import intervals as I
from .extract import KEY

#: What exit codes of containers and executors mean.
EXIT_CODES = {
    0: "finished", 1: "failed", 10: "uncaught exception in the driver", 11: "too many executors failed", 13: "no SparkContext was made", 15: "exception in the main class", 50: "uncaught exception",
    51: "uncaught exception twice", 52: "out of heap", 53: "no local folders", 56: "no heartbeats to the driver", 127: "command not found", -100: "container released", -101: "disks failed", -102: "preempted",
    -103: "over virtual memory", -104: "over physical memory", -105: "stopped by the application master", -106: "stopped by the resource manager", -107: "stopped after the end", -108: "stopped by the scheduler", -109: "too much log output",
}


def exit_meaning(code: Column) -> tuple[Column, Column]:
    """Meaning and severity of an exit code; above 128 it is a signal."""
    text = F.element_at(F.create_map(*[F.lit(x) for k, v in EXIT_CODES.items() for x in (k, v)]), code.cast("int"))
    meaning = F.coalesce(text, F.when(code.between(129, 159), F.concat(F.lit("signal "), (code - 128).cast("string"))), F.concat(F.lit("status "), code.cast("string")))
    severity = F.when(code.isin(0, 143, -105, -107), "info").when(code.isin(52, 137, -103, -104), "critical").otherwise("warning")
    return meaning, severity


def join_instances(hosts: DataFrame, instances: DataFrame, apps: DataFrame) -> DataFrame:
    """hosts(app_id, attempt, host, ...) with its instance's id, type, role and market: by DNS name first, then by address. Instances of the run's cluster that were up during it but hold
    nothing of it are added: apps and instances are joined by cluster_id, a null one being that of a single cluster."""
    cluster = F.col("cluster_id") if "cluster_id" in instances.columns else F.lit(None).cast("string")
    of_run = F.col("cluster_id") if "cluster_id" in apps.columns else F.lit(None).cast("string")
    by_name = instances.select(cluster.cast("string").alias("of_cluster"), F.col("id").alias("instance_id"), "type", "role", "market", "created", "ended", host_key(F.col("private_dns")).alias("key"))
    by_address = instances.select(F.col("id").alias("instance_id2"), F.col("type").alias("type2"), F.col("role").alias("role2"), F.col("market").alias("market2"), host_key(F.col("private_ip")).alias("key2"))
    keyed = hosts.withColumn("key", host_key(F.col("host")))
    out = keyed.join(by_name.drop("created", "ended", "of_cluster"), "key", "left").join(by_address, keyed["key"] == F.col("key2"), "left")
    known = out.select(*hosts.columns, F.coalesce("instance_id", "instance_id2").alias("instance_id"), *[F.coalesce(c, f"{c}2").alias(c) for c in ("type", "role", "market")], F.lit(True).alias("used"))
    up = apps.select(*KEY, of_run.cast("string").alias("in_cluster"), "started", F.col("ended").alias("run_end")).join(by_name, F.col("in_cluster").eqNullSafe(F.col("of_cluster")) & (F.col("created") <= F.col("run_end")) & (F.col("ended").isNull() | (F.col("ended") >= F.col("started"))))
    idle = up.join(known.select(*KEY, "instance_id").filter("instance_id is not null").distinct(), [*KEY, "instance_id"], "left_anti")
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in hosts.schema.fields if f.name not in (*KEY, "host")]
    added = idle.select(*KEY, F.col("key").alias("host"), *rest, "instance_id", "type", "role", "market", F.lit(False).alias("used"))
    return known.unionByName(added)


def idle_nodes(joined: DataFrame, instances: DataFrame, apps: DataFrame, least: float = 0.5) -> DataFrame:
    """Worker instances without executors that were up for at least half of the run and to its end."""
    span = apps.select(*KEY, "started", F.col("ended").alias("run_end"))
    i = instances.select(F.col("id").alias("instance_id"), "created", F.col("ended").alias("gone"), "primary")
    rows = joined.filter("not used").join(i, "instance_id").join(span, list(KEY))
    up = F.col("run_end") - F.greatest("created", "started")
    return rows.filter(~F.col("primary") & (F.col("gone").isNull() | (F.col("gone") >= F.col("run_end"))) & (up >= least * (F.col("run_end") - F.col("started"))))


def resolve_cluster(apps: DataFrame, clusters: DataFrame, apart_ms: int = 600_000) -> DataFrame:
    """cluster_id of each application: the cluster of its cluster_name that was up at its instant `at` and was created last; null with why, if none was or two were created minutes apart."""
    c = clusters.select(F.col("id").alias("cluster_id"), F.col("name").alias("cluster_name"), F.col("created").alias("c_created"), F.col("ended").alias("c_ended"))
    up = apps.join(c, "cluster_name").filter((F.col("c_created") <= F.col("at")) & (F.col("c_ended").isNull() | (F.col("c_ended") >= F.col("at"))))
    w = W.partitionBy(*KEY).orderBy(F.desc("c_created"), "cluster_id")
    best = up.withColumn("r", F.row_number().over(w)).withColumn("next", F.lead("c_created").over(w)).filter("r = 1")
    unsure = F.coalesce(F.col("c_created") - F.col("next") < apart_ms, F.lit(False))
    chosen = best.select(*KEY, F.when(~unsure, F.col("cluster_id")).alias("cluster_id"), F.when(unsure, "created minutes apart").alias("why"))
    return apps.join(chosen, list(KEY), "left").withColumn("why", F.when(F.col("cluster_id").isNull(), F.coalesce("why", F.lit("none was up"))))


def points_in_run(points: DataFrame, runs: DataFrame) -> DataFrame:
    """Metric points that cover a part of a run of the same cluster. A point stands for its period, a minute or the series' spacing, whichever is longest; a series of one point borrows its metric's spacing."""
    series = ["cluster_id", "namespace", "name", "scope"]
    gaps = points.withColumn("gap", F.col("t") - F.lag("t").over(W.partitionBy(*series).orderBy("t")))
    own = gaps.groupBy(*series).agg(F.min("gap").alias("own_gap"))
    metric = own.groupBy("namespace", "name").agg(F.min("own_gap").alias("metric_gap"))
    spaced = points.join(own, series).join(metric, ["namespace", "name"])
    covers = F.greatest(F.coalesce("own_gap", "metric_gap", F.lit(0)), F.col("period_s") * 1000, F.lit(60_000))
    r = runs.select(*KEY, "cluster_id", "started", "ended")
    return spaced.join(r, "cluster_id").filter((F.col("t") + covers > F.col("started")) & (F.col("t") <= F.col("ended"))).drop("own_gap", "metric_gap", "started", "ended")


def audit_calls(events: DataFrame) -> DataFrame:
    """Calls and refusals by service and action, with the resources that were refused."""
    refused = F.coalesce(F.col("error_code"), F.lit("")).rlike("(?i)(denied|unauthorized|forbidden)")
    return events.groupBy("service", "action").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(F.col("error_code").isNotNull()).alias("errors"), F.count_if(refused).alias("refused"),
        F.slice(F.array_sort(F.collect_set(F.when(refused, F.element_at(F.col("resources"), 1)))), 1, 20).alias("resources"),
    )


def setting_origin(settings: DataFrame, submitted: DataFrame, cluster: DataFrame) -> DataFrame:
    """origin of each setting: the submit arguments if they give that value, else the cluster's configuration if it does; a masked value matches any."""
    a = submitted.select(*KEY, "key", F.col("value").alias("sv"))
    b = cluster.select("key", F.col("value").alias("cv")).dropDuplicates(["key"])
    out = settings.join(a, [*KEY, "key"], "left").join(b, "key", "left")
    same = lambda c: F.col(c).isNotNull() & (F.col("redacted") | (F.col("value") == F.col(c)))
    return out.withColumn("origin", F.when(same("sv"), "submit").when(same("cv"), "cluster").otherwise("application")).select(*settings.columns, "origin")


#: Settings worth showing: default, and how values compare.
KNOWN_SETTINGS = (
    ("spark.executor.memory", "1g", "size-m"), ("spark.executor.cores", "1", "number"), ("spark.driver.memory", "1g", "size-m"), ("spark.driver.maxResultSize", "1g", "size"), ("spark.sql.shuffle.partitions", "200", "number"),
    ("spark.sql.adaptive.enabled", "true", "flag"), ("spark.dynamicAllocation.enabled", "false", "flag"), ("spark.shuffle.service.enabled", "false", "flag"), ("spark.speculation", "false", "flag"), ("spark.memory.fraction", "0.6", "number"),
    ("spark.memory.storageFraction", "0.5", "number"), ("spark.sql.autoBroadcastJoinThreshold", "10485760", "size"), ("spark.serializer", "org.apache.spark.serializer.JavaSerializer", "text"), ("spark.task.maxFailures", "4", "number"),
    ("spark.sql.files.maxPartitionBytes", "134217728", "size"), ("spark.locality.wait", "3s", "text"), ("spark.network.timeout", "120s", "text"), ("spark.memory.offHeap.enabled", "false", "flag"), ("spark.rdd.compress", "false", "flag"),
)


def settings_view(settings: DataFrame) -> DataFrame:
    """Known settings of each application with their default and whether they differ from it, compared as sizes, numbers, flags or text."""
    known = settings.sparkSession.createDataFrame(KNOWN_SETTINGS, "key string, default string, kind string")
    apps = settings.select(*KEY).distinct()
    mine = settings.filter("section = 'spark'").select(*KEY, "key", "value")
    rows = apps.join(F.broadcast(known)).join(mine, [*KEY, "key"], "left")  # the table of known settings is fixed
    v, d, k = F.col("value"), F.col("default"), F.col("kind")
    same = F.when(k == "flag", F.lower(F.trim(v)) == d).when(k == "number", v.try_cast("double") == d.try_cast("double"))
    same = same.when(k == "size", size_to_bytes(v) == size_to_bytes(d)).when(k == "size-m", size_to_bytes(v, "m") == size_to_bytes(d, "m")).otherwise(F.trim(v) == d)
    return rows.withColumn("differs", v.isNotNull() & ~F.coalesce(same, F.lit(False)))


def components(settings: DataFrame) -> DataFrame:
    """Artifact and version of each jar or zip on an application's classpath or shipped with it."""
    shipped = settings.filter("section = 'spark' and key in ('spark.jars', 'spark.yarn.dist.jars', 'spark.yarn.secondary.jars')").select(*KEY, F.explode(F.split("value", ",")).alias("jar"))
    jars = settings.filter("section = 'classpath'").select(*KEY, F.col("key").alias("jar")).unionByName(shipped).withColumn("jar", F.element_at(F.split(F.trim("jar"), "/"), -1))
    shape = r"^([A-Za-z][\w.\-]*?)-(\d+(?:\.\d+)+(?:[-.][\w.\-]+?)?)(?:-src)?\.(?:jar|zip)$"
    return jars.withColumn("artifact", F.regexp_extract("jar", shape, 1)).withColumn("version", F.regexp_extract("jar", shape, 2)).filter("artifact <> ''").select(*KEY, "artifact", "version", "jar").distinct()


def nodes(executors: DataFrame, totals: DataFrame, peaks: DataFrame) -> DataFrame:
    """Per host: executors, most at once, cores, tasks, peak heap, lost executors, first and last seen, CPU and busy shares."""
    e = executors.filter("executor_id <> 'driver'")
    held = F.greatest(F.lit(0), F.col("end") - F.col("start")) * F.col("cores")
    base = e.groupBy(*KEY, "host").agg(F.count(F.lit(1)).alias("executors"), F.sum("cores").alias("cores"), F.sum(held).alias("core_ms"), F.count_if(F.col("kind").isin("lost", "memory-kill")).alias("lost"), F.min("start").alias("first"), F.max("end").alias("last"))
    used = totals.join(e.select(*KEY, "executor_id", F.col("host").alias("on")), [*KEY, "executor_id"]).groupBy(*KEY, F.col("on").alias("host")).agg(*[F.sum(c).alias(c) for c in ("tasks", "run_ms", "cpu_ns", "duration_ms")])
    heap = peaks.join(e.select(*KEY, "executor_id", F.col("host").alias("on")), [*KEY, "executor_id"]).groupBy(*KEY, F.col("on").alias("host")).agg(F.max("JVMHeapMemory").alias("peak_heap"))
    most = I.peak_concurrency(e, [*KEY, "host"], "start", "end").select(*KEY, "host", F.col("peak").alias("most"))
    out = base.join(used, [*KEY, "host"], "left").join(heap, [*KEY, "host"], "left").join(most, [*KEY, "host"], "left")
    return out.withColumn("cpu_share", share(F.col("cpu_ns") / 1e6, F.col("run_ms"))).withColumn("busy_share", share(F.col("duration_ms"), F.col("core_ms")))
