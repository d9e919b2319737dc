"""Logs tied to executors by a chain of proofs, and how attempts and applications ended by several accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import container_attempt


def container_executors(files: DataFrame, executors: DataFrame, drivers: DataFrame, said: DataFrame) -> DataFrame:
    """The executor and host of each container's log file, what proves it (proof), and the attempt if it isn't the event log's (earlier_attempt).

    In this order: an executor's attribute of the event log names the container; the driver's does; it is the first container of its attempt, so the application master, which is the driver in cluster mode; the executor's own
    log says which one it was, which doesn't count for another attempt, whose numbers are used again. files: app_id, file, container; executors: app_id, executor_id, host, container; drivers: app_id, container, host, attempt, cluster;
    said: file, line, executor, host, of which a file's first counts. A container that two executors claim is proven by neither; a file without a container keeps null columns.
    """
    claim = executors.filter("container is not null").groupBy("app_id", "container").agg(F.collect_set(F.struct("executor_id", "host")).alias("who")).filter(F.size("who") == 1).select("app_id", "container", F.col("who")[0].alias("exec"))
    driver = drivers.groupBy("app_id").agg(F.max("container").alias("driver_container"), F.max_by("host", "container").alias("driver_host"), F.max("attempt").alias("named_attempt"), F.max("cluster").alias("cluster"))
    own = said.groupBy("file").agg(F.min_by(F.struct("executor", "host"), "line").alias("said"))
    rows = files.select("app_id", "file", "container").join(claim, ["app_id", "container"], "left").join(driver, "app_id", "left").join(own, "file", "left")
    attempt = container_attempt(F.col("container"))
    of = F.coalesce(container_attempt(F.col("driver_container")), F.col("named_attempt"))
    rows = rows.withColumn("earlier_attempt", F.when(attempt != of, attempt))
    is_driver = F.coalesce(F.col("container") == F.col("driver_container"), F.lit(False))
    master = F.coalesce(F.col("container").endswith("_000001"), F.lit(False))
    speaks = F.col("container").isNotNull() & F.col("said").isNotNull() & F.col("earlier_attempt").isNull()
    cases = (
        (F.col("exec").isNotNull(), F.col("exec.executor_id"), F.col("exec.host"), "executor's attribute"),
        (is_driver, F.lit("driver"), F.col("driver_host"), "driver's attribute"),
        (master, F.when(F.coalesce("cluster", F.lit(False)), "driver").otherwise("am"), F.col("said.host"), "first container"),
        (speaks, F.col("said.executor"), F.col("said.host"), "own log"),
    )
    executor, host, proof = (F.lit(None).cast("string") for _ in range(3))
    for when, e, h, p in reversed(cases):
        executor, host, proof = F.when(when, e).otherwise(executor), F.when(when, h).otherwise(host), F.when(when, p).otherwise(proof)
    return rows.select("app_id", "file", "container", executor.alias("executor"), host.alias("host"), proof.alias("proof"), "earlier_attempt")


def attempt_ends(manager: DataFrame, own: DataFrame) -> DataFrame:
    """One row per application and attempt that failed or was killed by either account: status, code, told_by, and the line of each account.

    The driver's own account comes before the resource manager's. manager and own: app_id, attempt, status, code, file, line; of several lines of one account the last counts. An attempt that isn't known is one of its own.
    """
    sides = []
    for df, name in ((manager, "m"), (own, "o")):
        bad = df.filter(F.col("status").isin("FAILED", "KILLED"))
        sides.append(bad.groupBy("app_id", F.coalesce("attempt", F.lit(0)).alias("attempt")).agg(F.max_by(F.struct("status", "code", "file", "line"), F.struct("line", "file")).alias(name)))
    both = sides[0].join(sides[1], ["app_id", "attempt"], "full")
    best = F.coalesce("o", "m")
    return both.select("app_id", "attempt", best["status"].alias("status"), best["code"].alias("code"), F.when(F.col("o").isNotNull(), "driver").otherwise("resource manager").alias("told_by"), F.col("o.line").alias("own_line"), F.col("m.line").alias("manager_line"))


def correct_status(applications: DataFrame, ends: DataFrame, summaries: DataFrame) -> DataFrame:
    """applications with state and reason as the resource manager has them, where the event log ends well and the last attempt or the summary says otherwise: an event log is closed normally on the way out of a failure too.

    applications: app_id, attempt, state, reason, ...; ends: of attempt_ends; summaries: app_id, final.
    """
    final = summaries.groupBy("app_id").agg(F.max("final").alias("_final"))
    e = ends.select("app_id", "attempt", F.col("status").alias("_status"), F.col("code").alias("_code"))
    rows = applications.join(e, ["app_id", "attempt"], "left").join(final, "app_id", "left")
    bad = F.col("_final").isin("FAILED", "KILLED")
    wrong = F.coalesce((F.col("state") == "succeeded") & (F.col("_status").isNotNull() | bad), F.lit(False))
    how = F.when(F.col("_final") == "KILLED", "killed").otherwise("failed")
    why = F.when(F.col("_status").isNotNull(), F.concat(F.lit("the event log ends normally, but the application master exited with code "), F.coalesce(F.col("_code").cast("string"), F.lit("unknown")))).otherwise(F.concat(F.lit("the event log ends normally, but the resource manager recorded the application as "), how))
    out = rows.withColumns({"reason": F.when(wrong, why).otherwise(F.col("reason")), "state": F.when(wrong, "failed").otherwise(F.col("state"))})
    return out.select(*applications.columns)


def app_from_logs(summaries: DataFrame, reports: DataFrame, ends: DataFrame) -> DataFrame:
    """An application's row from logs alone: name, user, queue, state, started, ended, reason. The resource manager's summary counts before the client's report.

    summaries: app_id, name, user, queue, final, started, ended; reports: app_id, user, queue, final, line; ends: of attempt_ends, of which the last attempt's gives the reason.
    """
    s = summaries.groupBy("app_id").agg(*[F.max(c).alias(c) for c in ("name", "user", "queue", "final", "started", "ended")])
    r = reports.groupBy("app_id").agg(*[F.max_by(c, "line").alias(f"r_{c}") for c in ("user", "queue", "final")])
    last = ends.groupBy("app_id").agg(F.max_by(F.struct("status", "code"), "attempt").alias("last"))
    rows = s.join(r, "app_id", "full").join(last, "app_id", "full")
    final = F.coalesce("final", "r_final", "last.status")
    state = F.when(final == "SUCCEEDED", "succeeded").when(final == "FAILED", "failed").when(final == "KILLED", "killed").otherwise("unknown")
    reason = F.when((state == "failed") & F.col("last").isNotNull(), F.concat(F.lit("its application master exited with code "), F.coalesce(F.col("last.code").cast("string"), F.lit("unknown"))))
    return rows.select("app_id", "name", F.coalesce("user", "r_user").alias("user"), F.coalesce("queue", "r_queue").alias("queue"), state.alias("state"), "started", "ended", reason.alias("reason"))


def retried(applications: DataFrame, ends: DataFrame) -> DataFrame:
    """Applications that the resource manager had to start again: the attempts that failed before the one that the event log tells of, or before a success. app_id, attempts, last_code."""
    later = applications.groupBy("app_id").agg(F.max("attempt").alias("at"), F.max(F.col("state") == "succeeded").alias("well"))
    before = ends.join(later, "app_id").filter((F.col("attempt") < F.col("at")) | (F.col("well") & (F.col("attempt") != F.col("at"))))
    return before.groupBy("app_id").agg(F.count(F.lit(1)).alias("attempts"), F.max_by("code", "attempt").alias("last_code"))


def zone_offsets(first_times: DataFrame, references: DataFrame, step_min: int = 30, slack_min: int = 15) -> DataFrame:
    """app_id and offset_min of applications whose containers' logs look written in another zone than they were read in.

    Containers start minutes after the reference, a time that is UTC whatever the zone. A difference that lies within slack_min of a whole number of step_min, other than none, is an offset; with the slack at half a step every difference
    beyond it is one, rounded away from zero. first_times: app_id, first (a container file's first time); references: app_id, event_log, summary, step, of which the first that is there counts. Without a reference or a time there is no row.
    """
    first = first_times.groupBy("app_id").agg(F.min("first").alias("first"))
    ref = references.groupBy("app_id").agg(*[F.min(c).alias(c) for c in ("event_log", "summary", "step")]).select("app_id", F.coalesce("event_log", "summary", "step").alias("ref"))
    ms = lambda c: F.unix_millis(F.col(c))
    rows = first.join(ref, "app_id").withColumn("diff", ms("first") - ms("ref")).filter("diff is not null")
    offset = (F.round(F.col("diff") / (step_min * 60_000)) * step_min).cast("long")
    return rows.withColumn("offset_min", offset).filter((F.col("offset_min") != 0) & (F.abs(F.col("diff") - F.col("offset_min") * 60_000) <= slack_min * 60_000)).select("app_id", "offset_min")
