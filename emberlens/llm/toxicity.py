"""Toxicity scores by a logistic regression that is penalised for score changes when identity terms are swapped."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Terms that name groups of people; those of one tuple can stand for each other in a sentence.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("female", "male"), ("girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino"), ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives"), ("mexicans", "americans", "africans", "europeans", "chinese", "russians", "germans"),
    ("elderly", "young", "disabled", "deaf", "blind"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")


def words_of(text: str) -> list[str]:
    """Letters in lower case, punctuation and digits left out."""
    return _WORD.findall(text.lower())


def features_of(words: set[str]) -> set[str]:
    """Words, and what longer ones begin with, so that inflected forms have something in common."""
    return words | {w[:4] + "*" for w in words if len(w) > 4} | {w[:5] + "*" for w in words if len(w) > 5}


class ToxicModel(NamedTuple):
    """Weights of the features that have one; all others count nothing."""

    weights: dict[str, float]
    bias: float

    def score(self, text: str) -> float:
        w = self.weights
        return float(1 / (1 + np.exp(-np.clip(self.bias + sum(sorted(w[x] for x in w.keys() & features_of(set(words_of(text))))), -30, 30))))


def counterfactuals(words: set[str], vocabulary: dict[str, int]) -> list[list[int]]:
    """What each swap of one identity term for another changes in a text's features: k + 1 for each feature k that it adds, -(k + 1) for each that it takes away. Those without a weight are left out."""
    held: dict[str, int] = {}
    out = []
    for group in IDENTITY_TERMS:
        for a in group:
            if a in words:
                if not held:
                    for w in words:
                        for x in features_of({w}):
                            held[x] = held.get(x, 0) + 1
                for b in group:
                    if b not in words:
                        lost, new = features_of({a}), features_of({b})
                        change = [-(vocabulary[x] + 1) for x in sorted(lost - new) if held[x] == 1 and x in vocabulary] + [vocabulary[x] + 1 for x in sorted(new - lost) if x not in held and x in vocabulary]
                        if change:
                            out.append(change)
    return out


class Swaps(NamedTuple):
    """All counterfactuals of the texts: for each change, the swap it belongs to, the feature, and 1 if that is added, -1 if it is taken away."""

    of: np.ndarray
    feature: np.ndarray
    sign: np.ndarray

    @classmethod
    def made(cls, signed: np.ndarray, sizes: np.ndarray) -> Swaps:
        return cls(np.repeat(np.arange(len(sizes)), sizes), np.abs(signed) - 1, np.sign(signed).astype(float))


def class_weight(y: np.ndarray) -> float:
    """What a toxic text's odds are raised by after the fit: the square root of the harmless texts to each toxic one, at most 4. So where toxic texts are few, missing one counts more than a false alarm."""
    toxic = int(y.sum())
    return float(np.clip(np.sqrt((len(y) - toxic) / max(1, toxic)), 1.0, 4.0)) if toxic else 1.0


def fit(flat: np.ndarray, sizes: np.ndarray, y: np.ndarray, swaps: Swaps, dims: int, l1: float = 2e-4, swap: float = 1.0, steps: int = 300, still: float = 1e-5) -> tuple[np.ndarray, float]:
    """Accelerated proximal descent on mean log loss + swap * mean squared score change of the counterfactuals + l1 * |w|.

    flat holds the features of all texts, one text after another, sizes how many each has. A feature counts once per text. The penalty is on the change of the linear score that a swap
    makes as a whole. It ends after steps, or when no weight and neither the bias has moved by more than still in ten steps.
    """
    m = len(sizes)
    if not m:
        return np.zeros(dims), 0.0
    owner = np.repeat(np.arange(m, dtype=np.int32), sizes)
    y = y.astype(float)
    w = v = np.zeros(dims)
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    b = c = float(np.log(prior / (1 - prior)))
    t = 1.0
    n_swaps = max(1, len(swaps.of) and int(swaps.of[-1]) + 1)
    df = np.bincount(flat, minlength=dims)[:dims] / m
    widest = int(np.bincount(swaps.of).max(initial=0)) if len(swaps.of) else 0
    rate = 1 / np.maximum(np.sqrt(df * df.max(initial=1e-9)) + 2 * swap / n_swaps * np.bincount(swaps.feature, minlength=dims)[:dims] * widest, 2e-3)
    quiet = 0
    for _ in range(steps):
        g = 1 / (1 + np.exp(-np.clip(np.bincount(owner, v[flat], minlength=m)[:m] + c, -30, 30))) - y
        grad = np.bincount(flat, g[owner], minlength=dims)[:dims] / m
        if len(swaps.of):
            change = np.bincount(swaps.of, swaps.sign * v[swaps.feature], minlength=n_swaps)
            grad += 2 * swap / n_swaps * np.bincount(swaps.feature, swaps.sign * change[swaps.of], minlength=dims)[:dims]
        new = v - rate * grad
        new = np.sign(new) * np.maximum(np.abs(new) - rate * l1, 0)
        new_b = c - 1.0 * float(g.mean())
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if ((v - new) * (new - w)).sum() > 0:  # the momentum points uphill
            t_next = 1.0
        quiet = quiet + 1 if max(float(np.abs(new - w).max(initial=0)), abs(new_b - b)) < still else 0
        v, c = new + (t - 1) / t_next * (new - w), new_b
        w, b, t = new, new_b, t_next
        if quiet == 10:
            break
    return w, b


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 6_000, min_texts: int = 4, max_words: int = 150_000) -> ToxicModel:
    """Fits a model to labelled texts, may_learn a condition on the label's id.

    It is fitted to at most about max_rows labelled rows, chosen by a hash of the id, and to the max_words most frequent of the features of at least
    min_texts of these: both bound what reaches the driver. Null labels and ids and null texts aren't learned from.
    """
    usable = labels.filter(may_learn & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    total = usable.count()
    share = F.pmod(F.xxhash64(F.col("id"), F.lit(17)), F.lit(1 << 30)) < F.lit(int(min(1.0, max_rows / max(1, total)) * (1 << 30)))
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null").join(usable.filter(share), "id")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(features_of(set(words_of(x.as_py())))) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found, pa.list_(pa.string()))], names=["id", "y", "words"])

    kind = chosen.schema["id"].dataType.simpleString()
    texts = staged(chosen.select("id", "text", "y").mapInArrow(listed, f"id {kind}, y int, words array<string>"))
    frequent = texts.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_texts)
    vocabulary = {r["word"]: i for i, r in enumerate(frequent.orderBy(F.desc("n"), "word").limit(max_words).collect())}

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, swaps, lengths = [], [], []
            for words in b.column(2).to_pylist():
                at.append([vocabulary[x] for x in words if x in vocabulary])
                found = counterfactuals({x for x in words if not x.endswith("*")}, vocabulary)
                swaps.append([x for change in found for x in change])
                lengths.append([len(change) for change in found])
            lists = [pa.array(x, pa.list_(pa.int32())) for x in (at, swaps, lengths)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], names=["id", "y", "at", "swaps", "lengths"])

    table = texts.mapInArrow(indexed, f"id {kind}, y int, at array<int>, swaps array<int>, lengths array<int>").orderBy("id", "y").toArrow()
    at, y = table["at"].combine_chunks(), table["y"].to_numpy()
    flat, sizes = at.flatten().to_numpy(), np.diff(at.offsets.to_numpy())
    signed, lengths = (table[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("swaps", "lengths"))
    w, bias = fit(flat, sizes, y, Swaps.made(signed, lengths), len(vocabulary))
    return ToxicModel({word: float(w[i]) for word, i in vocabulary.items() if w[i]}, bias + float(np.log(class_weight(y))))


def score_toxicity(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """score (0 to 1) and predicted (1 from 0.5) of every row's whole text.

    Null and empty texts have the score of a text without known words; repeated rows each get a row; an empty table gives
    an empty one; only the id and the text are read.
    """
    kept = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = [model.score(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32())], names=["id", "score", "predicted"])

    return kept.mapInArrow(scored, f"id {kept.schema['id'].dataType.simpleString()}, score double, predicted int").withColumnRenamed("id", id_col)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text leaves no remainder by folds; null is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))
