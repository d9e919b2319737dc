"""Which line of the application's code a stage ran: frames of call sites, logged names matched with source paths, descriptions that the code set, and the nearest line before."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import intervals as I

KEY = ("app_id", "attempt")
STAGE = (*KEY, "stage_id", "stage_attempt")
CODE = "struct<file:string,line:int,function:string,action:string>"

#: Packages whose frames are not the application's.
SYSTEM = ("org.apache.spark.", "scala.", "java.", "javax.", "jdk.", "sun.", "com.sun.", "py4j.", "org.apache.hadoop.", "org.apache.hive.", "org.apache.parquet.", "com.amazon.", "com.amazonaws.", "software.amazon.")
#: A frame of a JVM stack: class and method, file and line.
FRAME = r"^\s*(?:at\s+)?(?:[\w.$@-]*/)*([\w.$<>-]+\.[\w$<>-]+)\(([^:()]+):(\d+)\)\s*$"
#: A call site: what was called, file and line.
SITE = r"^(.*) at ([^\s:<][^\s]*):(\d+)$"


def user_frames(details: Column, most: int = 8) -> Column:
    """The application's frames of a long call site, innermost first."""
    system = "^(?:" + "|".join(p.replace(".", r"\.") for p in SYSTEM) + ")"
    lines = F.filter(F.split(F.coalesce(details, F.lit("")), "\n"), lambda x: x.rlike(FRAME))
    frames = F.transform(
        lines,
        lambda x: F.struct(
            F.regexp_extract(x, FRAME, 2).alias("file"), F.regexp_extract(x, FRAME, 3).try_cast("int").alias("line"), F.regexp_extract(x, FRAME, 1).alias("function"), F.lit(None).cast("string").alias("action")
        ),
    )
    return F.slice(F.filter(frames, lambda f: (f["line"] > 0) & ~f["function"].rlike(system)), 1, most)


def code_of(site: Column, details: Column) -> Column:
    """An array of code places: the application's frames, the innermost with the action of the short call site where that names it; without frames, the short call site. Line 0 names no code."""
    frames = user_frames(details)
    line = F.regexp_extract(site, SITE, 3).try_cast("int")
    short = F.struct(F.regexp_extract(site, SITE, 2).alias("file"), line.alias("line"), F.lit(None).cast("string").alias("function"), F.regexp_extract(site, SITE, 1).alias("action"))
    known = F.coalesce(site.rlike(SITE) & (line > 0), F.lit(False))
    acted = F.transform(
        frames, lambda f, i: F.when((i == 0) & known & (base_name(f["file"]) == base_name(short["file"])) & (f["line"] == line), F.struct(f["file"].alias("file"), f["line"].alias("line"), f["function"].alias("function"), short["action"].alias("action"))).otherwise(f)
    )
    return F.when(F.size(frames) > 0, acted).when(known, F.array(short)).otherwise(F.array().cast(f"array<{CODE}>"))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def tails(path: Column) -> Column:
    """Every tail of a path's components with its length: a/b/c has c, b/c and a/b/c. Slashes of both kinds divide, and several are one."""
    parts = F.filter(F.split(path, r"[/\\]+"), lambda x: x != "")
    return F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("shared"), F.array_join(F.slice(parts, -k, k), "/").alias("tail"))))


def match_tails(logged: DataFrame, sources: DataFrame, file: str, path: str, keys: Sequence[str] = ()) -> DataFrame:
    """Each logged file of a key with the source path that shares the most components from the end: keys, file, path, shared and others (how many more share as many).

    Both sides give one row per tail; sources are first reduced to one row per tail, so a file meets at most as many rows as it has components, however many sources have
    its base name. Of several paths the smallest counts. A file whose base name no source has keeps a row with shared 0; null and empty names have none to share.
    """
    names = logged.select(*keys, F.col(file).alias("file")).filter("file is not null").distinct()
    known = sources.select(*keys, F.col(path).alias("path")).filter("path is not null").distinct().select(*keys, "path", F.inline(tails(F.col("path"))))
    by_tail = known.groupBy(*keys, "tail").agg(F.min("path").alias("path"), (F.count(F.lit(1)) - 1).alias("others"))
    met = names.select(*keys, "file", F.inline(tails(F.col("file")))).join(by_tail, [*keys, "tail"])
    best = met.groupBy(*keys, "file").agg(F.max_by(F.struct("path", "shared", "others"), "shared").alias("b")).select(*keys, F.col("file").alias("_file"), "b.*")
    same = F.col("file") == F.col("_file")
    for k in keys:
        same = same & (names[k] == best[k])
    return names.join(best, same, "left").select(*[names[k] for k in keys], "file", "path", F.coalesce("shared", F.lit(0)).alias("shared"), F.coalesce("others", F.lit(0)).cast("long").alias("others"))


#: A call that sets a job's description, the letters before its string, and the quote.
SETS = r"""(?:setJobDescription\(\s*|setLocalProperty\(\s*["']spark\.job\.description["']\s*,\s*)([A-Za-z]{0,2})("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')"""
#: What a description fills in when it is set.
FILLED = r"\$\{[^}]*\}|\{[^}]*\}|%[-+ #0-9.]*[sdifr]|\$[A-Za-z_][A-Za-z0-9_]*"
#: Descriptions and patterns meet by pieces of so many characters of a pattern's literal text.
PIECE = 4


def description_patterns(lines: DataFrame, least: int = 8) -> DataFrame:
    """file, line, pattern and piece of the lines (file, line, value) that set a job description to a string written there; what is filled in matches anything.

    A pattern's piece is the run of its literal text that the fewest patterns have, so that patterns of one wording don't all meet the same descriptions.

    Strings of raw or bytes literals fill nothing in. Patterns with fewer than least literal characters, or without PIECE of them in a row, match too much and are left out.
    """
    call = F.explode(F.expr(f"regexp_extract_all(value, r'{_quoted(SETS)}', 0)")).alias("call")
    sets = lines.select("file", "line", "value").filter(F.col("value").contains("escription")).select("file", "line", call)
    body = F.regexp_extract("call", SETS, 2)
    text = F.regexp_replace(F.expr("substring(body, 2, length(body) - 2)"), r"\\(.)", "$1")
    found = sets.withColumn("letters", F.lower(F.regexp_extract("call", SETS, 1))).withColumn("body", body).withColumn("text", text)
    fills = F.col("letters").rlike("[fs]") | ~F.col("letters").rlike("[rb]")
    literal = F.when(fills, F.split("text", FILLED)).otherwise(F.array("text"))
    rows = found.withColumn("literal", literal).withColumn("fixed", F.aggregate("literal", F.lit(0), lambda a, x: a + F.length(x)))
    quoted = F.transform("literal", lambda x: F.regexp_replace(x, r"([\\\[\]{}()*+?.^$|])", r"\\$1"))
    pieces = F.array_distinct(F.flatten(F.transform("literal", grams)))
    whole = rows.filter(F.col("fixed") >= least).select("file", "line", F.concat(F.lit("^"), F.array_join(quoted, ".*?"), F.lit("$")).alias("pattern"), pieces.alias("pieces")).distinct()
    each = whole.select("file", "line", "pattern", F.explode("pieces").alias("piece"))
    rarity = F.struct(F.count(F.lit(1)).over(W.partitionBy("piece")).alias("n"), "piece").alias("rare")
    return each.select("file", "line", "pattern", rarity).groupBy("file", "line", "pattern").agg(F.min("rare").alias("rare")).select("file", "line", "pattern", F.col("rare.piece").alias("piece"))


def grams(text: Column) -> Column:
    """The runs of PIECE characters of a text; none of a shorter one."""
    return F.when(F.length(text) >= PIECE, F.transform(F.sequence(F.lit(1), F.length(text) - PIECE + 1), lambda i: F.substring(text, i, F.lit(PIECE)))).otherwise(F.array().cast("array<string>"))


def _quoted(regex: str) -> str:
    """The expression in a raw SQL string of single quotes."""
    return regex.replace("'", r"\x27")


def match_descriptions(descriptions: DataFrame, patterns: DataFrame, key: str = "description") -> DataFrame:
    """key, file and line of each distinct description that one line's pattern matches; none where two lines do. Patterns meet only descriptions that have their piece."""
    own = descriptions.select(F.col(key).alias("d")).filter("d is not null").distinct()
    pieces = own.select("d", F.explode(F.array_distinct(grams(F.col("d")))).alias("piece"))
    met = pieces.join(patterns, "piece").filter(F.expr("d rlike pattern"))
    return met.groupBy("d").agg(F.collect_set(F.struct("file", "line")).alias("at")).filter(F.size("at") == 1).select(F.col("d").alias(key), F.col("at")[0]["file"].alias("file"), F.col("at")[0]["line"].cast("int").alias("line"))


def stage_code(stages: DataFrame, jobs: DataFrame, job_stage: DataFrame, own_files: DataFrame, described: DataFrame) -> DataFrame:
    """The line of the application's code per stage attempt, how it is known (via) and whether that is certain.

    In this order: the first of the stage's places in a file of the application; that of the job with the smallest number among the stage's jobs that has one; the line that set the description of the smallest such
    job; and else the last line known of a stage of the application that began before, or with it, which is a pointer and no certainty. stages: STAGE, submitted, code; jobs: KEY, job_id, code, description; own_files: file;
    described: description, file, line. A stage without a line and without a time stays without one.
    """
    mine = own_files.select(F.col("file").alias("own")).distinct()

    def first_own(df: DataFrame, keys: Sequence[str]) -> DataFrame:
        places = df.select(*keys, F.posexplode("code").alias("nth", "at")).join(mine, F.col("at.file") == F.col("own"), "left_semi").filter("at.line > 0")
        return places.groupBy(*keys).agg(F.min_by("at", "nth").alias("at"))

    by_stage = first_own(stages, STAGE).withColumnRenamed("at", "own_at")
    of_job = first_own(jobs, [*KEY, "job_id"])
    links = job_stage.select(*KEY, "job_id", "stage_id").distinct()
    by_job = links.join(of_job, [*KEY, "job_id"]).groupBy(*KEY, "stage_id").agg(F.min_by(F.struct("job_id", "at"), "job_id").alias("by_job"))
    told = jobs.select(*KEY, "job_id", "description").join(described.select("description", F.struct("file", "line").alias("told")), "description").select(*KEY, "job_id", "told")
    by_text = links.join(told, [*KEY, "job_id"]).groupBy(*KEY, "stage_id").agg(F.min_by(F.struct("job_id", "told"), "job_id").alias("by_text"))
    rows = stages.select(*STAGE, "submitted").join(by_stage, list(STAGE), "left").join(by_job, [*KEY, "stage_id"], "left").join(by_text, [*KEY, "stage_id"], "left")
    at = lambda c: F.struct(F.col(f"{c}.file").alias("file"), F.col(f"{c}.line").cast("int").alias("line"))
    place = F.when(F.col("own_at").isNotNull(), at("own_at")).when(F.col("by_job").isNotNull(), at("by_job.at")).when(F.col("by_text").isNotNull(), at("by_text.told"))
    via = F.when(F.col("own_at").isNotNull(), "stage").when(F.col("by_job").isNotNull(), F.concat(F.lit("job "), "by_job.job_id")).when(F.col("by_text").isNotNull(), F.concat(F.lit("description of job "), "by_text.job_id"))
    known = rows.select(*STAGE, "submitted", place.alias("place"), via.alias("via"))
    facts = known.filter("place is not null and submitted is not null").groupBy(*KEY, "submitted").agg(F.max(F.struct("stage_id", "stage_attempt", "place")).alias("last")).select(*KEY, F.col("submitted").alias("_t"), F.col("last.place").alias("near"))
    lost = I.latest_before(known.filter("place is null and submitted is not null"), facts, KEY, "submitted", "_t", ["near"])
    timeless = known.filter("place is null and submitted is null").withColumn("near", F.lit(None).cast("struct<file:string,line:int>"))
    sure = known.filter("place is not null").withColumn("near", F.lit(None).cast("struct<file:string,line:int>"))
    out = sure.unionByName(lost).unionByName(timeless)
    return out.select(*STAGE, F.coalesce("place", "near").alias("p"), F.when(F.col("near").isNotNull(), "nearest before").otherwise(F.col("via")).alias("via"), F.col("place").isNotNull().alias("certain")).select(*STAGE, "p.file", "p.line", "via", "certain")
