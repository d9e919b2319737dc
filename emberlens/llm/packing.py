"""Best-fit packing of tokenised documents by the sum-of-squares rule."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: A space that ends a token of the byte-level pattern for certain: white space on neither side.
_SPLIT = re.compile(r"(?<=\S) (?=\S)")
_CACHED = 400_000


class ChunkEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, as the tokenizer file gives them.

    Byte-level BPE never merges across a single space between two other characters, so a text's ids are those of its
    chunks. Ids of chunks met before are looked up in a table of bounded size. Where the file numbers its tokens in the
    order of its merges, other chunks are merged by rank from the file's own vocabulary; else, and for texts with special
    tokens, the tokenizer encodes them itself.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.feed = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self.ranked = self._by_rank(path)
        self.known: dict[str, bytes] = {}

    def _by_rank(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the byte-level alphabet's own characters
        others = [b for b in range(256) if b not in set(printable)]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        ids = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if ids != sorted(ids) or len(ids) + 256 < len(model["vocab"]) - len(self.special):
            return None
        ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in self.special}
        return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _lines(self, chunks: list[str]) -> Iterator[bytes]:
        """Ids of chunks without a line feed, encoded as the lines of one text: a line feed before a space is a token of its own."""
        text = "\n " + "\n ".join(chunks) + "\n"
        ids = np.array(self.ranked(text) if self.ranked else self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        at = (np.flatnonzero(ids == self.feed) * 4).tolist()
        data = ids.tobytes()
        return (data[a + 4 : b] for a, b in zip(at[:-1], at[1:], strict=True))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        if len(self.known) > _CACHED:
            self.known.clear()
        # All chunks but a text's first stand for a space and themselves.
        cut = [[t] if any(s in t for s in self.special) else t.split(" ") for t in texts]
        known, fresh = self.known, set().union(*(c[1:] for c in cut)) - self.known.keys()
        if odd := {c for c in fresh if c < "!" or c > "\x7f" and c[0].isspace()}:  # the space before these doesn't end a token
            fresh -= odd
            for i, c in enumerate(cut):
                if not odd.isdisjoint(c[1:]) or len(c) > 1 and c[0][-1:].isspace():
                    cut[i] = _SPLIT.split(texts[i])
                    fresh.update(x for x in cut[i][1:] if x not in known)
        for c in cut:
            if len(c) > 1 and not c[0]:  # a space at the start
                c[0:2] = [" " + c[1]]
        ends = [c for c in fresh if not c.isalnum() and ("\n" in c or c[-1].isspace())]
        plain = list(fresh.difference(ends))
        for i in range(0, len(plain), 10_000):
            part = plain[i : i + 10_000]
            known.update(zip(part, self._lines(part), strict=True))
        known.update(zip(ends, self._encode([" " + c for c in ends]), strict=True))
        for text, c in zip(texts, cut, strict=True):
            special = any(s in text for s in self.special)
            first = self._encode([c[0]])[0] if special or not self.ranked else np.array(self.ranked(c[0]), "<u4").tobytes()
            yield first + b"".join(map(known.__getitem__, c[1:]))


_encoders: dict[str, ChunkEncoder] = {}


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Pieces of every row's ids and end_id: piece, start, length, ids_crc32. Only longer ones are cut, so that all pieces but the first are full."""
    kept = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    last = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = _encoders.get(tokenizer_path) or _encoders.setdefault(tokenizer_path, ChunkEncoder(tokenizer_path))
        for b in batches:
            for at in range(0, b.num_rows, 500):
                ids, texts = b.column(0).slice(at, 500), b.column(1).slice(at, 500).to_pylist()
                of, piece, start, length, crc = [], [], [], [], []
                for i, data in enumerate(encoder.encode(texts)):
                    data += last
                    n, a = len(data) // 4, 0
                    e = n % capacity or capacity
                    k = 0
                    while a < n:
                        of.append(i)
                        piece.append(k)
                        start.append(a)
                        length.append(e - a)
                        crc.append(zlib.crc32(data[4 * a : 4 * e]))
                        a, e, k = e, e + capacity, k + 1
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]],
                    names=["id", "piece", "start", "length", "ids_crc32"],
                )

    return kept.mapInArrow(cut, f"id {kept.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, in the given order.

    open_[g] counts the open bins with gap g. A piece goes where the sum of their squares becomes smallest: into a bin of gap g,
    which moves one bin from g to g - length, or into a new bin; of equal choices, the tightest existing bin.
    """
    open_ = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    gaps: list[int] = []
    for i, n in enumerate(lengths.tolist()):
        here, there = open_[n:], open_[: capacity + 1 - n]
        change = 2 * (there - here) + 2  # of (here - 1)**2 + (there + 1)**2
        change[0] = 1 - 2 * here[0]  # a full bin isn't open
        change[here == 0] = np.iinfo(np.int64).max
        g = int(change.argmin())
        if here[g] and change[g] <= (2 * open_[capacity - n] + 1 if n < capacity else 0):
            gap = g + n
            b = stacks[gap].pop()
            open_[gap] -= 1
        else:
            b, gap = len(gaps), capacity
            gaps.append(capacity)
        bins[i], offsets[i] = b, capacity - gap
        left = gap - n
        gaps[b] = left
        if left:
            stacks[left].append(b)
            open_[left] += 1
    return bins, offsets


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", pieces_per_group: int = 100_000) -> DataFrame:
    """Packs the pieces of every row's tokens into sequences of at most capacity: sequence_id and offset of each piece.

    Pieces are dealt by a hash of id, piece and place to groups of about pieces_per_group, however many rows share an id or a
    source; each group is packed by itself by the sum-of-squares rule, in descending length. A group's last sequences may be
    open, which is a part of about capacity / pieces_per_group of all. Null and empty texts are one piece of the end id; repeated
    rows are packed each; an empty table gives an empty one; other columns aren't read.
    """
    pieces = staged(token_pieces(docs, tokenizer_path, capacity, id_col, text_col))
    groups = max(1, -(-pieces.count() // pieces_per_group))
    schema = f"id {pieces.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def packed(f: pd.DataFrame) -> pd.DataFrame:
        group = int(f["group"].iloc[0])
        f = f.drop(columns="group").sort_values(["length", "id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        bins, offsets = sum_of_squares(f["length"].to_numpy(), capacity)
        return f.assign(sequence_id=bins * groups + group, offset=offsets)

    salt = F.xxhash64("id", "piece", F.monotonically_increasing_id())  # of a written table, so it stays; repeated rows are dealt apart
    dealt = pieces.withColumn("group", F.pmod(salt, F.lit(groups)).cast("int"))
    out = dealt.groupBy("group").applyInPandas(packed, schema)
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
