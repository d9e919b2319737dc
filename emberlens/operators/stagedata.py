"""What stages read and wrote, as several sources tell it: folders that hold paths, and one entry per folder or table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import data_folder

STAGE = ("app_id", "attempt", "stage_id", "stage_attempt")
#: Sources of stage data, the ones that know most first.
SOURCES = ("executor logs", "SQL plan", "region store")


def above(path: Column) -> Column:
    """A path and all folders above it, the longest last."""
    parts = F.split(F.regexp_replace(path, "/+$", ""), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def folders_holding(paths: DataFrame, folders: DataFrame, keys: Sequence[str], path: str, folder: str) -> DataFrame:
    """Rows of paths with the longest of the key's folders that is the path or above it (folder), null if none is.

    A path meets the folders above it by equality, as many rows as it has components, and never the other paths or folders of its key. Trailing slashes don't count; null keys and paths meet nothing.
    """
    own = paths.select(*keys, F.col(path).alias("_path")).dropna().distinct()
    named = folders.select(*keys, F.regexp_replace(F.col(folder), "/+$", "").alias("_up")).dropna().filter("_up <> ''").distinct()
    met = own.select(*keys, "_path", F.explode(above(F.col("_path"))).alias("_up")).join(named, [*keys, "_up"])
    best = met.groupBy(*keys, "_path").agg(F.max_by("_up", F.length("_up")).alias("_folder")).withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = F.col(path) == F.col("_path")
    for k in keys:
        same = same & (F.col(k) == F.col(f"_of_{k}"))
    return paths.join(best, same, "left").select(*[F.col(c) for c in paths.columns], F.col("_folder").alias("folder"))


def merge_stage_data(entries: DataFrame, most_paths: int = 20) -> DataFrame:
    """One row per stage attempt, access, kind and name: parts, sized, bytes, format, paths and from (the sources, in the order of SOURCES).

    entries: STAGE, access, kind, name, parts, sized, bytes, format, source. A later source that names files (comma-separated) folds into the folder that an earlier one names for the same stage and access, if all of its files
    are data of that one folder and no earlier source names the files themselves; paths then lists the files, up to most_paths. The format is the first source's that has one. A slash at a name's end doesn't count;
    entries of a null name or of a source that isn't known are left out.
    """
    rank = F.array_position(F.array(*[F.lit(s) for s in SOURCES]), F.col("source")).cast("int")
    clean = entries.withColumn("name", F.regexp_replace("name", "/+$", "")).withColumn("rank", rank).filter("name is not null and rank > 0")
    own = [*STAGE, "access", "kind"]
    summed = clean.groupBy(*own, "name", "rank", "source").agg(
        *[F.sum(c).alias(c) for c in ("parts", "sized", "bytes")], F.min(F.when(F.coalesce("format", F.lit("")) != "", F.col("format"))).alias("format")
    )
    files = F.split("name", ", ")
    homes = F.array_distinct(F.transform(files, data_folder))
    home = F.when((F.col("kind") == "path") & (F.size(homes) == 1) & (homes[0] != "") & ~F.array_contains(files, homes[0]), homes[0])
    known = summed.groupBy(*own, "name").agg(F.min("rank").alias("first"))
    homed = summed.withColumn("home", home)
    named = homed.join(known, [*own, "name"])
    above_ = known.select(*own, F.col("name").alias("home"), F.col("first").alias("home_first"))
    placed = named.join(above_, [*own, "home"], "left").withColumn("folds", (F.col("first") == F.col("rank")) & F.coalesce(F.col("home_first") < F.col("rank"), F.lit(False)))
    rows = placed.select(*own, F.when(F.col("folds"), F.col("home")).otherwise(F.col("name")).alias("name"), "parts", "sized", "bytes", "format", "rank", "source", F.when(F.col("folds"), files).alias("files"))
    sources = F.array_sort(F.collect_set(F.struct("rank", "source")))
    out = rows.groupBy(*own, "name").agg(
        *[F.sum(c).alias(c) for c in ("parts", "sized", "bytes")], F.min_by("format", F.when(F.col("format").isNotNull(), F.col("rank"))).alias("format"),
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("files")))), 1, most_paths).alias("paths"), sources.alias("s"),
    )
    return out.select(*own, "name", "parts", "sized", "bytes", "format", "paths", F.transform("s", lambda x: x["source"]).alias("from"))
