"""Live views of logs that are still being written: the batch tables' streaming forms, over readStream of the same folders.

Every stateful operation is bounded by a watermark on event time; rows later than it are dropped by Spark and counted in the query's progress.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import extract as X
from ..operators.extract import KEY
from ..sources.eventlog import app_and_attempt, event_name


def event_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Event lines as they arrive, of the shape that the extractors take. Line numbers need whole files: part and line are 0 until a batch run."""
    reader = spark.readStream.option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    app, attempt = app_and_attempt(F.col("file"))
    zero = F.lit(0).cast("long")
    lines = reader.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    return lines.select(app.alias("app_id"), attempt.alias("attempt"), zero.alias("part"), "file", zero.alias("line"), event_name(F.col("value")).alias("event"), "value")


def _at(ms: str) -> Column:
    return F.timestamp_millis(F.col(ms))


def unended_tasks(events: DataFrame, patience: str = "1 hour") -> DataFrame:
    """Starts joined with their ends by task, once patience has passed without one: ended is null. An outer join of two streams, both with watermarks."""
    starts = X.task_starts(events).filter("launched is not null").select(*KEY, "task_id", "stage_id", "executor_id", _at("launched").alias("t")).withWatermark("t", patience)
    ends = X.task_ends(events).filter("finished is not null").select(F.col("app_id").alias("a"), F.col("attempt").alias("n"), F.col("task_id").alias("id"), _at("finished").alias("ended")).withWatermark("ended", patience)
    match = (F.col("app_id") == F.col("a")) & (F.col("attempt") == F.col("n")) & (F.col("task_id") == F.col("id")) & (F.col("ended") >= F.col("t")) & (F.col("ended") <= F.col("t") + F.expr(f"interval {patience}"))
    return starts.join(ends, match, "left_outer").drop("a", "n", "id")


def live_totals(events: DataFrame) -> DataFrame:
    """Running totals of each stage attempt; for update mode, where each trigger gives the rows that changed."""
    tasks = X.task_ends(events)
    return tasks.groupBy(*KEY, "stage_id", "stage_attempt").agg(F.count(F.lit(1)).alias("tasks"), F.count_if(F.col("status") == "failed").alias("failed"), *[F.sum(c).alias(c) for c in ("run_ms", "cpu_ns", "gc_ms", "disk_spill", "shuffle_write_bytes")])


def flow_series(rows: DataFrame, keys: list[str], t: str, kind: str, size: str, step: str = "10 seconds", slide: str | None = None, late: str = "1 minute") -> DataFrame:
    """Bytes moved per kind in tumbling windows of a step, or sliding ones."""
    over = F.window(t, step, slide) if slide else F.window(t, step)
    return rows.withWatermark(t, late).groupBy(*keys, kind, over).agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("n")).select(*keys, kind, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "bytes", "n")


def sessions(rows: DataFrame, keys: list[str], t: str, gap: str = "60 seconds", late: str = "1 minute") -> DataFrame:
    """Repeated events of a key as sessions that a pause of gap ends. A session's end is exclusive, so a pause of exactly gap ends it as well."""
    return rows.withWatermark(t, late).groupBy(*keys, F.session_window(t, gap)).agg(F.count(F.lit(1)).alias("n"), F.min(t).alias("first"), F.max(t).alias("last")).select(*keys, "n", "first", "last")


def first_failures(rows: DataFrame, keys: list[str], t: str, text: str) -> DataFrame:
    """The earliest failure so far per key; for update or complete mode."""
    return rows.groupBy(*keys).agg(F.min(t).alias("t"), F.min_by(text, t).alias("text"), F.count(F.lit(1)).alias("n"))


def unique_exclusions(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Exclusions once each, whichever of the event's two names came first."""
    names = list(X._EXCLUSION)
    rows = events.filter(F.col("event").isin(*names)).withColumn("e", F.from_json("value", "time bigint, executorId string, hostId string, stageId int"))
    flat = rows.select(*KEY, F.coalesce("e.executorId", "e.hostId").alias("target"), F.coalesce("e.stageId", F.lit(-1)).alias("stage_id"), F.timestamp_millis("e.time").alias("t"), F.regexp_replace("event", "Blacklist", "Exclud").alias("kind"))
    return flat.withWatermark("t", late).dropDuplicatesWithinWatermark([*KEY, "target", "stage_id", "t", "kind"])


class AppState(StatefulProcessor):
    """running until an end event, incomplete after silence; a row at each change."""

    SILENCE_MS = 10 * 60 * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "state string, last long")

    def _say(self, key: tuple, state: str, last: int) -> pd.DataFrame:
        return pd.DataFrame({"app_id": [key[0]], "state": [state], "last": [last]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802  Spark's own name
        state, last = self.state.get() if self.state.exists() else (None, 0)
        old = state
        for f in rows:
            last = max(last, int(f["ms"].max()))
            if (f["event"] == "SparkListenerApplicationEnd").any():
                state = "ended"
        state = "ended" if state == "ended" else "running"
        self.state.update((state, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state == "running":
            self.handle.registerTimer(last + self.SILENCE_MS)
        if state != old:
            yield self._say(key, state, last)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        state, last = self.state.get() if self.state.exists() else (None, 0)
        if state == "running":
            self.state.update(("incomplete", last))
            yield self._say(key, "incomplete", last)

    def close(self) -> None:
        pass


def app_states(events: DataFrame, late: str = "1 minute") -> DataFrame:
    """app_id, state and last event time at each change of an application's state. Needs the RocksDB state store."""
    ms = F.coalesce(*[F.get_json_object("value", p).cast("long") for p in ("$.Timestamp", "$['Submission Time']", "$['Completion Time']", "$.time", "$['Task Info']['Finish Time']", "$['Task Info']['Launch Time']")])
    rows = events.filter("event is not null").select("app_id", "event", ms.alias("ms")).filter("ms is not null").withColumn("t", F.timestamp_millis("ms")).withWatermark("t", late)
    return rows.groupBy("app_id").transformWithStateInPandas(AppState(), "app_id string, state string, last long", "Update", "EventTime")
