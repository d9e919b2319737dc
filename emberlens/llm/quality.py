"""Host-level quality rules: failures by host, shrunk with an empirical beta prior, joined back to documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salted_join, staged, utf8

SPACES = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
TAILS = bytes(range(0x80, 0xC0))  # the bytes of UTF-8 that don't begin a code point
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def text_counts(text: bytes) -> tuple[int, ...]:
    """COUNTS of one text: words, code points in words, symbols, lines equal to an earlier one, words in repeated 3-word windows, lines with a word."""
    words = text.split()
    n = len(words)
    seen: set[bytes] = set()
    lines = dup = 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    repeat = 0
    if n > 3:
        ids: dict[bytes, int] = {}
        a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
        v = len(ids)
        pair = a[:-2] * v + a[1:-1]
        if v >= 2_000_000:  # three ids would not fit into 64 bits
            pair = np.unique(pair, return_inverse=True)[1]
        _, which, times = np.unique(pair * v + a[2:], return_inverse=True, return_counts=True)
        again = times[which] > 1
        if again.any():
            within = np.zeros(n, bool)
            for k in range(3):
                within[k : n - 2 + k] |= again
            repeat = int(within.sum())
    return n, len(text.translate(None, SPACES + TAILS)), len(text) - len(text.translate(None, SYMBOLS)), dup, repeat, lines


def document_counts(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id, its host and COUNTS of its whole text (null: a text without words)."""
    kept = docs.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), utf8(text_col).alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [text_counts(x.as_py()) for x in b.column(2)]
            cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=["id", "host", *COUNTS])

    return kept.mapInArrow(counted, f"id {kept.schema['id'].dataType.simpleString()}, host string, " + ", ".join(f"{c} long" for c in COUNTS))


def with_rules(counts: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, max_symbol_percent: int = 10, max_dup_line_percent: int = 30) -> DataFrame:
    """Adds one boolean per rule, base_failed (the first two) and any_failed."""
    short = F.col("n_words") < min_words
    repeats = 100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")
    return counts.withColumns(
        {
            "short": short,
            "repeats": repeats,
            "symbols": 100 * F.col("n_symbols") > max_symbol_percent * F.col("word_chars"),
            "dup_lines": 100 * F.col("n_dup_lines") > max_dup_line_percent * F.col("n_lines"),
            "base_failed": short | repeats,
        }
    ).withColumn("any_failed", F.col("base_failed") | F.col("symbols") | F.col("dup_lines"))


def host_verdicts(rules: DataFrame, max_host_rate: float = 0.5, most_strength: float = 1000.0) -> DataFrame:
    """One row per host (null is a host): n_docs, failures by rule, and the rate of documents that fail any rule, shrunk
    towards all hosts' mean. The beta prior's mean and strength are fitted to the hosts by moments: the variance between
    hosts beyond what sampling explains. Without such variance its strength is most_strength. A host is rejected if
    its shrunk rate is above max_host_rate.
    """
    flag = {f"n_{k}": F.sum(F.col(k).cast("long")) for k in ("short", "repeats", "symbols", "dup_lines", "any_failed")}
    hosts = rules.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), *[v.alias(k) for k, v in flag.items()])
    n, f = F.col("n_docs").cast("double"), F.col("n_any_failed").cast("double")
    total, mean = F.sum(n), F.sum(f) / F.sum(n)
    prior = hosts.agg(mean.alias("mean"), (F.sum(f * f / n) / total - mean * mean - mean * (1 - mean) * F.count(F.lit(1)) / total).alias("between"))
    m, between = F.col("mean"), F.col("between")
    strength = F.when(between > 0, F.least(F.lit(most_strength), F.greatest(F.lit(1.0), m * (1 - m) / between - 1))).otherwise(F.lit(most_strength))
    return (
        hosts.crossJoin(F.broadcast(prior.select(m, strength.alias("strength"))))  # one row
        .withColumn("host_rate", (f + m * F.col("strength")) / (n + F.col("strength")))
        .withColumn("host_rejected", F.col("host_rate") > max_host_rate)
    )


def quality_rules(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", max_host_rate: float = 0.5) -> DataFrame:
    """COUNTS, base_failed, host_rate and kept of every row of docs.

    kept: base_failed is false and the host isn't rejected. A null text has no words, so it fails; a null host is a host
    like others; equal rows and ids each get a row; an empty table gives an empty one; other columns aren't read.
    """
    rules = staged(with_rules(document_counts(docs, id_col, host_col, text_col)))
    hosts = host_verdicts(rules, max_host_rate).select(F.col("host").alias("of"), "host_rate", "host_rejected")
    # A host may hold a third of all rows.
    return salted_join(rules, hosts, {"host": "of"}).select(
        F.col("id").alias(id_col), *COUNTS, "base_failed", (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept"), "host_rate"
    )
