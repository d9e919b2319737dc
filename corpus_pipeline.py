"""A corpus pipeline of five operators: each stage takes all documents that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce, wraps
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlens.llm.common import recorded, release, staged
from emberlens.llm.jaccard import jaccard_components
from emberlens.llm.mixing import mix
from emberlens.llm.packing import pack
from emberlens.llm.quality import quality_rules
from emberlens.llm.queries import tokenizer_path
from emberlens.llm.repeats import remove_repeats


#: Tables that the last call of each stage has written for itself.
_TABLES: dict[str, list[str]] = {}


def _after(before: Callable | None) -> Callable:
    """A stage that begins by deleting what the stage before has written for itself: that stage's result has been written and read again by then. Tables that docs still reads stay."""

    def wrap(f: Callable) -> Callable:
        @wraps(f)
        def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            if before:
                release(spark, _TABLES.pop(before.__name__, []), docs)
            with recorded() as made:
                out = f(spark, docs, sf_dir)
            _TABLES[f.__name__] = made
            return out

        return stage

    return wrap


@_after(None)
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep. A verdict is the text's and the source's, so rows are found again by these and the id, the text by its hash."""
    key = F.struct("doc_id", "source", F.xxhash64("text").alias("h"), F.octet_length("text").alias("n"))
    kept = quality_rules(docs.select(key.alias("key"), "source", "text"), id_col="key").filter("kept").select(F.col("key").alias("of")).distinct()
    same = [F.col(f"of.{f}").eqNullSafe(c) for f, c in (("doc_id", F.col("doc_id")), ("source", F.col("source")), ("h", F.xxhash64("text")), ("n", F.octet_length("text")))]
    return docs.join(kept, reduce(and_, same), "left_semi")


@_after(quality)
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of n-gram Jaccard links: of the rows of its smallest id, the one of the smallest hash. Of equal rows one stays."""
    keyed = staged(docs.withColumn("row_key", F.monotonically_increasing_id()))  # written once, so that a row keeps its key
    of = jaccard_components(keyed, id_col="row_key").select(F.col("row_key").alias("of"), "component_id")
    ids = keyed.select("doc_id", F.xxhash64(*docs.columns).alias("h"), "row_key").join(of, F.col("row_key") == F.col("of"))
    kept = ids.groupBy("component_id").agg(F.min(F.struct("doc_id", "h", "row_key")).alias("first")).select(F.col("first.row_key").alias("of"))
    return keyed.join(kept, F.col("row_key") == F.col("of"), "left_semi").select(*docs.columns)


@_after(near_duplicates)
def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without strings of 200 bytes that repeat. A character that a cut halves goes as well."""
    out = remove_repeats(docs, as_text=True)
    return out.withColumn("text", F.when(F.col("text").isNotNull(), F.col("kept"))).select(*docs.columns)


@_after(repeats)
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mix(docs, copies=True)


@_after(mixture)
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in sequences of at most 2048."""
    return pack(docs, tokenizer_path())


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", repeats), ("mixing sources", mixture), ("best-fit packing", packing)]

#: Neither links between sets nor tokens are for SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs)
    return docs
