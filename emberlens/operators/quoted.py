"""Lines that quote another process, which its own log has as well: regions of a file that end by a marker, by another marker or after so many lines."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import intervals as I

#: What begins a resource manager's diagnostics, what ends them, and what shows that they are over.
OPENS, ENDS, RESUMES = r"Application diagnostics message: |^\t diagnostics: ", r"^\. Failing the application\.?$|^\t ApplicationMaster host: ", r'^Exception in thread "|^\d\d/\d\d/\d\d \d\d:\d\d:\d\d '


def quoted_regions(lines: DataFrame, opens: str = OPENS, ends: str = ENDS, resumes: str = RESUMES, most: int = 400) -> DataFrame:
    """file, first and last of each quoted region.

    It begins after a line that matches opens, and lasts to the next one that matches ends, which belongs to it, or to before the next one that matches resumes, and over most lines at most.
    What opens within a region opens nothing. Only lines that match one of the three are walked, in order, with one open region at a time held.
    """
    v = F.coalesce("value", F.lit(""))
    marked = lines.select("file", F.col("line").cast("long").alias("line"), v.rlike(opens).alias("o"), v.rlike(ends).alias("e"), v.rlike(resumes).alias("r")).filter("o or e or r")

    def walk(rows: Iterator[tuple]) -> Iterator[tuple]:
        file, start = None, None
        for of, line, o, e, r in rows:
            if start is not None and (of != file or line > start + most):
                yield file, start + 1, start + most
                start = None
            file = of
            if start is not None and (e or r):
                last = line if e else line - 1
                if last > start:
                    yield file, start + 1, last
                start = None
                if e:
                    continue
            if start is None and o:
                start = line
        if start is not None:
            yield file, start + 1, start + most

    schema = T.StructType([lines.schema["file"], T.StructField("first", T.LongType()), T.StructField("last", T.LongType())])
    return I.in_order(marked, ["file"], ["line"], walk, schema)


def drop_quoted(lines: DataFrame, opens: str = OPENS, ends: str = ENDS, resumes: str = RESUMES, most: int = 400) -> DataFrame:
    """The lines outside quoted regions, so that an error that another process quotes counts once. A line belongs to the last region that began before it, if that reaches it."""
    regions = quoted_regions(lines, opens, ends, resumes, most)
    placed = I.latest_before(lines.withColumn("_line", F.col("line").cast("long")), regions, ["file"], "_line", "first", ["last"])
    return placed.filter(F.col("last").isNull() | (F.col("_line") > F.col("last"))).drop("last", "_line")
