"""URL filters: host and path rules, and a logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The small labelled table that the classifier is fitted to by default: names of sites, put on several hosts and paths.
BLOCK_NAMES = (
    "casino", "win-casino", "online-bets", "bet365win", "free-spins", "poker-win", "jackpot-slots", "cheap-meds", "pills-shop", "buy-pills",
    "diet-pills", "viagra-now", "adult-cams", "xxx-tube", "adult-dating", "porn-x", "ads-server", "click-track", "tracker-ads", "popup-ads",
    "spam-links", "link-farm", "seo-farm", "content-farm", "free-money", "payday-loans", "free-iphone", "win-prize", "crypto-win", "warez-free",
)
ALLOW_NAMES = (
    "museum", "garden", "history", "weather", "science", "physics", "theatre", "orchestra", "library", "university", "cooking", "travel",
    "hiking", "cycling", "railway", "birds", "ocean", "mountain", "recipes", "novels", "poetry", "painting", "health", "medicine", "nursery",
    "school", "teacher", "parliament", "council", "news", "daily", "journal", "gazette", "forum", "wiki", "docs", "python", "linux", "letters",
    "astronomy", "nation", "stone", "winter", "chess", "economy", "archive", "lighthouse", "shelter", "harbour", "theology", "method",
)
#: Stems of both kinds. Names are made of them by rule, with the same words around both kinds, so that what is around a stem tells nothing.
BLOCK_STEMS = (
    "casino", "poker", "bets", "betting", "slots", "jackpot", "roulette", "lottery", "gambling", "bingo", "viagra", "cialis", "pills", "steroids", "weightloss", "porn", "xxx", "sex", "cams", "escorts", "nude", "hookup", "adult",
    "adserver", "adclick", "banners", "popunder", "tracker", "spam", "backlinks", "linkfarm", "seo", "clickbait", "payday", "loans", "giveaway", "prizes", "winner", "earnmoney", "getrich", "doubler", "warez", "torrents", "cracks", "keygen", "serials", "replica", "phishing", "malware",
)
ALLOW_STEMS = (
    "books", "flights", "hotels", "shoes", "flowers", "bikes", "music", "films", "sports", "football", "tennis", "farming", "gardening", "kitchen", "bakery", "coffee", "tea", "wine", "pets", "dogs", "cats", "horses", "maps", "photos", "galleries", "design",
    "fashion", "furniture", "tools", "cars", "trains", "boats", "jobs", "careers", "courses", "lessons", "languages", "stories", "essays", "reviews", "research", "energy", "climate", "nature", "forests", "rivers", "villages", "churches", "charity", "clinic", "dentist", "family",
)
AROUND = ("{}", "cheap-{}", "online{}", "{}-shop", "best-{}-club", "{}24", "my{}", "{}-world")
HOSTS = ("{}.example.com", "www.{}.example.net", "blog.{}.example.org", "m.{}.example.com")
PATHS = ("/en/17", "/de/204/", "/fr/931.html", "/es/8")


class Rule(NamedTuple):
    """host/path of a rule, and allow or block."""

    rule: str
    verdict: str


def labelled_urls(around: Sequence[str] = AROUND) -> list[tuple[str, int]]:
    """(url, 1 if to be blocked): two of each name above, and of each stem with three of the words around, each on another host and path."""
    out = []
    for label, names, stems in ((1, BLOCK_NAMES, BLOCK_STEMS), (0, ALLOW_NAMES, ALLOW_STEMS)):
        made = [around[(i + 3 * k) % len(around)].format(stem) for i, stem in enumerate(stems) for k in range(min(3, len(around)))]
        for i, name in enumerate([*names, *made]):
            out += [("https://" + HOSTS[(i + k) % 4].format(name) + PATHS[(i + 3 * k) % 4], label) for k in range(2)]
    return out


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z in lower case; empty without ://."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. A rule fits its host and all subdomains, on paths that start with the rule's."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        name, _, path_start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + path_start)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def ngrams(host: str, path: str, sizes: Sequence[int], dims: int) -> list[int]:
    """Distinct hashed n-grams; those of the host and of the path differ."""
    out = set()
    for kind, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in sizes:
            out.update(zlib.crc32(f"{kind}{text[i : i + n]}".encode()) % dims for i in range(len(text) - n + 1))
    return sorted(out)


class UrlModel(NamedTuple):
    """Weights of hashed n-grams."""

    weights: np.ndarray
    bias: float
    sizes: tuple[int, ...]

    def score(self, host: str, path: str) -> float:
        """Probability that the url is to be blocked; 0 for an empty host."""
        if not host:
            return 0.0
        at = ngrams(host, path, self.sizes, len(self.weights))
        return float(1 / (1 + np.exp(-(self.bias + self.weights[at].sum() / np.sqrt(max(1, len(at)))))))


def fit_urls(labelled: Sequence[tuple[str, int]], sizes: tuple[int, ...] = (3, 4, 5), dims: int = 1 << 15, l2: float = 3e-5, steps: int = 2500, allow: float = 0.93) -> UrlModel:
    """Full-batch gradient descent on a small labelled table, which is the caller's to bound. allow is what all allowed urls weigh of the loss, so that a name that tells nothing is allowed."""
    rows = []
    for url, label in labelled:
        rest = url.partition("://")[2]
        host = rest[: min([len(rest), *(i for c in "/?#" if (i := rest.find(c)) >= 0)])]
        path = rest[len(host) :].partition("?")[0].partition("#")[0]
        rows.append((ngrams(host.lower(), path, sizes, dims), label))
    y = np.array([r[1] for r in rows], float)
    flat, owner = np.array([i for at, _ in rows for i in at], np.int64), np.repeat(np.arange(len(rows)), [len(at) for at, _ in rows])
    scale = np.array([1 / np.sqrt(max(1, len(at))) for at, _ in rows])
    weigh = np.where(y == 1, (1 - allow) / max(1, y.sum()), allow / max(1, (1 - y).sum()))
    w, b = np.zeros(dims), 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(scale * np.bincount(owner, w[flat], minlength=len(rows)) + b)))
        g = weigh * (p - y)
        w -= 20 * (np.bincount(flat, (g * scale)[owner], minlength=dims) + l2 * w)
        b -= 2 * float(g.sum())
    return UrlModel(w, b, sizes)


def url_filter(pages: DataFrame, rules: Sequence[Rule], model: UrlModel | None = None, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """host, path, rule, verdict and score of every row's url.

    verdict: the longest fitting rule's, else block if the model's score is at least threshold. Null, empty or a url
    without :// has an empty host and path, no rule, score 0 and is allowed; repeated rows each get a row; only the id
    and the url are read.
    """
    model = model or fit_urls(labelled_urls())
    parts = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = [model.score(h, p) for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, pa.float64())], names=["id", "host", "path", "score"])

    out = parts.mapInArrow(scored, f"id {parts.schema['id'].dataType.simpleString()}, host string, path string, score double")
    rule = best_rule(F.col("host"), F.col("path"), rules)
    return out.withColumn("r", rule).select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("r.rule").alias("rule"),
        F.coalesce(F.col("r.verdict"), F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"),
        "score",
    )
