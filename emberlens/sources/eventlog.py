"""Event logs of many applications as a table of lines, numbered as they stand in their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, size, block, row and value of every line under path, which may be a file, a folder, a pattern or a list of these; gz and bz2 are read by Hadoop's codecs.

    block is where the split begins and row is taken right after the scan, so they number lines without moving them.
    """
    raw = spark.read.option("recursiveFileLookup", "true").text(path)
    return raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        "value",
    )


def splits_of(lines: DataFrame) -> DataFrame:
    """file, block, first, n and before of every split: the row of its first line, its lines, and how many lines stand before it in its file."""
    counts = lines.groupBy("file", "block").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    return counts.withColumn("before", F.sum("n").over(W.partitionBy("file").orderBy("block")) - F.col("n"))


def _numbered(lines: DataFrame, splits: DataFrame) -> DataFrame:
    """lines with the columns of their splits, and line. splits has a row for each split, of which Spark's driver holds a list anyway, so it is broadcast, and no line is moved.
    Were a file split otherwise when its lines are read than when they were counted, rows would lie outside of what was counted, which is an error."""
    inside = F.col("row").between(F.col("first"), F.col("first") + F.col("n") - 1)
    line = F.when(inside, F.col("before") + F.col("row") - F.col("first") + 1).otherwise(F.raise_error(F.lit("a file was split in two ways while its lines were numbered")).cast("long"))
    return lines.join(F.broadcast(splits), ["file", "block"], "left").withColumn("line", line).drop("first", "n", "before")


def with_line_numbers(lines: DataFrame) -> DataFrame:
    """Adds line, from 1 in each file, to all lines that read_lines gives. A split's rows follow each other, so a line's number is its distance from the split's first and what stands before."""
    return _numbered(lines, splits_of(lines))


def part_index(file: Column) -> Column:
    """Number of a rolling log's part; 0 for a single file."""
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(file, r"events_(\d+)_", 1), F.lit("")), F.lit("999999999999")).cast("long"), F.lit(0).cast("long"))


def live_parts(files: DataFrame, folder: str = "folder", file: str = "file") -> DataFrame:
    """Parts of rolling logs without those that a later compacted part has replaced, with part."""
    return _with_live(files, folder, file).filter("live").drop("live")


def _with_live(files: DataFrame, folder: str, file: str) -> DataFrame:
    """Adds part, and live: no later compacted part of its folder has replaced it."""
    rows = files.withColumn("part", part_index(F.col(file)))
    compact = F.max(F.when(F.col(file).contains(".compact"), F.col("part"))).over(W.partitionBy(folder))
    last = F.coalesce(compact, F.lit(-1))
    return rows.withColumn("live", (F.col("part") > last) | (F.col("part") == last) & F.col(file).contains(".compact"))


def app_and_attempt(file: Column) -> tuple[Column, Column]:
    """Application and attempt that a path names: app-1-2, application_1_2_3, with an attempt's number after it."""
    shape = r"((?:application_\d+_\d+)|(?:app-\d+-\d+)|(?:local-\d+))(?:_(\d+))?"
    return F.regexp_extract(file, shape, 1), F.coalesce(F.nullif(F.regexp_extract(file, shape, 2), F.lit("")).cast("int"), F.lit(1))


def latest_attempts(files: DataFrame) -> DataFrame:
    """is_latest: the highest attempt of an application, a finished log before one in progress."""
    w = W.partitionBy("app_id").orderBy(F.desc("attempt"), F.col("file").contains(".inprogress"), "file")
    return files.withColumn("is_latest", F.rank().over(w) == 1)


def event_name(value: Column) -> Column:
    """Name of an event without its package, taken from the line's start where it stands there."""
    quick = F.regexp_extract(value, r'^\{"Event":"([^"\\]+)"', 1)
    return F.regexp_replace(F.when(quick != "", quick).otherwise(F.get_json_object(value, "$.Event")), r"^.*\.", "")


def event_lines(spark: SparkSession, path: str) -> DataFrame:
    """app_id, attempt, part, file, line, event and value of every event-log line under path; lines that aren't events have no event."""
    raw = read_lines(spark, path)
    splits = splits_of(raw).withColumn("folder", F.regexp_replace("file", "/[^/]*$", ""))
    rows = _numbered(raw, _with_live(splits, "folder", "file").drop("folder")).filter(F.coalesce("live", F.lit(True)))
    app, attempt = app_and_attempt(F.col("file"))
    return rows.select(app.alias("app_id"), attempt.alias("attempt"), "part", "file", "line", event_name(F.col("value")).alias("event"), "value")


def line_quality(events: DataFrame) -> DataFrame:
    """Per file: lines, events, malformed lines with the first one's number, and whether the last line is cut off, which isn't malformed. A line is an event if it is JSON with an event's name."""
    bad = (F.col("event").isNull() | F.try_parse_json("value").isNull()) & (F.trim("value") != "")
    sums = events.withColumn("bad", bad).groupBy("file").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(~F.col("bad") & F.col("event").isNotNull()).alias("events"),
        F.count_if("bad").alias("bad"),
        F.min(F.when(F.col("bad"), F.col("line"))).alias("first"),
        F.max_by("bad", "line").alias("truncated"),
        F.max("line").alias("last"),
    )
    first = F.when(F.col("bad") > F.col("truncated").cast("int"), F.col("first"))  # the cut line is the last, so it isn't the first of several
    return sums.select("file", "lines", "events", (F.col("bad") - F.col("truncated").cast("int")).alias("malformed"), first.alias("first_malformed"), "truncated")


def stored_events(events: DataFrame, path: str) -> DataFrame:
    """events written under path, partitioned by event, and read again: each extractor then reads its own event's files only, and lines are numbered and files joined once."""
    named = events.withColumn("event", F.coalesce("event", F.lit("")))
    named.repartition("event", F.pmod(F.xxhash64("app_id", "line"), F.lit(64))).write.mode("overwrite").partitionBy("event").parquet(path)
    back = events.sparkSession.read.schema(named.schema).parquet(path)
    return back.withColumn("event", F.nullif("event", F.lit(""))).select(*events.columns)


def event_counts(events: DataFrame) -> DataFrame:
    """How many events of each kind each application has."""
    return events.filter("event is not null").groupBy("app_id", "attempt", "event").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first_line"))


def unknown_fields(events: DataFrame, known: DataFrame) -> DataFrame:
    """Top-level fields that known(event, field) doesn't list, by event, with their number and one line that has them."""
    fields = events.filter("event is not null").select("event", "file", "line", F.explode(F.json_object_keys("value")).alias("field"))
    return fields.join(known, ["event", "field"], "left_anti").groupBy("event", "field").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("file", "line")).alias("first"))


def event_at(events: DataFrame, file: str, line: int) -> DataFrame:
    """The raw event behind a cited place, secrets masked."""
    from ..functions.text import redact_text

    return events.filter((F.col("file") == file) & (F.col("line") == line)).withColumn("value", redact_text(F.col("value")))


def write_tables(tables: dict[str, DataFrame], path: str, mode: str = "overwrite", by: str | None = None) -> None:
    """Each table as Parquet under path, partitioned by a column where it has it."""
    for name, df in tables.items():
        out = df.write.mode(mode)
        (out.partitionBy(by) if by in df.columns else out).parquet(f"{path}/{name}")
