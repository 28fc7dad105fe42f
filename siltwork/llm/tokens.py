"""Byte-level BPE encoding of a whole corpus with a public vocabulary.

Text is cut into pieces by the vocabulary's pattern. Each distinct piece is merged once per worker with a segment
tree over the ranks of its adjacent pairs: the root holds the leftmost pair of lowest rank, a merge changes at most
three leaves, and merging ends when no pair is in the vocabulary. That is O(n log n) for a piece of n bytes, so a
text without any boundary (one run of letters of a megabyte) costs no more than its share.
"""

from __future__ import annotations

import base64
import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Folder of the public vocabulary files.
VOCABULARIES = "/opt/tokenizers"
#: Pattern of the byte-level vocabularies (fixed value of the public tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces up to this length are remembered, and so many of them before the memory is emptied.
MEMO_CHARS, MEMO_PIECES = 48, 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a ``.tiktoken`` file; the rank is the id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: lowest rank first, leftmost among equals."""
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    parts: list[bytes] = [piece[i : i + 1] for i in range(n)]
    ahead, back = list(range(1, n + 1)), list(range(-1, n - 1))
    width = 1 << (n - 2).bit_length() if n > 2 else 1
    none = (1 << 62) - 1
    # A node is rank * n + position, so that the smaller node is the lower rank and then the position further left.
    tree = [none] * (2 * width)
    get = ranks.get
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[width + i] = r * n + i
    for i in range(width - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b

    def put(i: int, value: int) -> None:
        i += width
        tree[i] = value
        while i > 1:
            i >>= 1
            a, b = tree[2 * i], tree[2 * i + 1]
            low = a if a < b else b
            if tree[i] == low:
                break
            tree[i] = low

    while (top := tree[1]) != none:
        i = top % n
        j = ahead[i]
        parts[i] += parts[j]
        parts[j] = b""
        k = ahead[i] = ahead[j]
        if j < n - 1:
            put(j, none)
        if k < n:
            back[k] = i
            r = get(parts[i] + parts[k])
            put(i, none if r is None else r * n + i)
        else:
            put(i, none)
        h = back[i]
        if h >= 0:
            r = get(parts[h] + parts[i])
            put(h, none if r is None else r * n + h)
    return [ranks[p] for p in parts if p]


class Pieces(dict):
    """Piece -> ids, filled on demand."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        whole = self.ranks.get(data)
        ids = (whole,) if whole is not None else tuple(merge(data, self.ranks))
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Text -> ids. An empty or null text gives no ids."""

    def __init__(self, path: str):
        self.pieces = Pieces(read_ranks(path))
        self.split = regex.compile(PATTERN).findall

    def encode(self, text: str | None) -> list[int]:
        return list(itertools.chain.from_iterable(map(self.pieces.__getitem__, self.split(text)))) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(len, map(self.pieces.__getitem__, self.split(text)))) if text else 0


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder a worker process and vocabulary."""
    return Encoder(path)


def vocabulary(name: str, folder: str = VOCABULARIES) -> str:
    return f"{folder}/{name}.tiktoken"


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """(key, out) with the ids of every row's text, in the order and number of the rows of ``df``.

    Null and empty texts give an empty list, a null key stays null, repeated rows are each encoded, an empty table gives
    an empty table; any other columns of ``df``, also one named as ``out``, are left out. One narrow pass, no shuffle.
    """
    path = path or vocabulary("byte_bpe_50k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for b in batches:
            lists = [encode(t) for t in b.column(1).to_pylist()]
            ends = np.zeros(len(lists) + 1, np.int32)
            np.cumsum([len(x) for x in lists], out=ends[1:])
            flat = np.fromiter(itertools.chain.from_iterable(lists), np.int32, int(ends[-1]))
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], ["key", "ids"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, ids array<int>").toDF(key, out)


def count_tokens(df: DataFrame, text: str = "text", out: str = "tokens", path: str | None = None) -> DataFrame:
    """``df`` without its text, with the number of ids of that text as ``out``; 0 for null and empty texts.

    A column of ``df`` named as ``out`` is replaced. One narrow pass, no shuffle.
    """
    path = path or vocabulary("byte_bpe_50k")
    keep = [c for c in df.columns if c not in (text, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(path).count
        for b in batches:
            n = pa.array([count(t) for t in b.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], n], [*b.schema.names[1:], out])

    schema = df.select(*keep).schema.add(out, LongType())
    return df.select(F.col(text).cast("string").alias("text"), *keep).mapInArrow(run, schema)
