"""Model providers behind one interface, called in Arrow batches; the default one is deterministic and needs no network."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType


#: Words between the white space of ASCII, as engines of SQL count them.
WORDS = re.compile(r"[^ \t\n\r\f\v]+").findall


@dataclass(frozen=True)
class Completion:
    text: str
    tokens_in: int
    tokens_out: int
    latency_ms: int


class Provider(Protocol):
    """Made once in each Python worker; ``name`` identifies it."""

    name: str

    def complete(self, text: str, model: str) -> Completion: ...

    def embed(self, text: str) -> list[float]: ...


@dataclass(frozen=True)
class LineProvider:
    """Answers with the first lines of a text as claims; embeds by hash. Numbers of tokens are numbers of words."""

    name: str = "lines"
    claims: int = 3
    by_model: dict = field(default_factory=dict, hash=False)

    def complete(self, text: str, model: str) -> Completion:
        lines = [x.strip(" \t\r\f\v") for x in text.split("\n")]
        kept = [x for x in lines if x][: self.by_model.get(model, self.claims)]
        return Completion(json.dumps([{"claim": x, "quote": x} for x in kept]), len(WORDS(text)), sum(len(WORDS(x)) for x in kept), 0)

    def embed(self, text: str) -> list[float]:
        return [b / 255 for b in hashlib.sha256(text.encode()).digest()[:8]]


@lru_cache(maxsize=16)
def prompt(folder: str, stage: str, version: str) -> str:
    """The text of a versioned prompt; FileNotFoundError if there is none."""
    with open(f"{folder}/{stage}_{version}.md", encoding="utf-8") as f:
        return f.read()


def complete(rows: DataFrame, provider: Provider, text: str = "text") -> DataFrame:
    """``rows`` without their text, with answer, tokens_in, tokens_out, latency_ms and error.

    An error of the provider becomes a value of its row; the task goes on. A null text is not asked about and gives a
    null answer. ``rows`` need model. Arrow batches, one call each row.
    """
    keep = [c for c in rows.columns if c not in (text, "answer", "tokens_in", "tokens_out", "latency_ms", "error")]
    schema = rows.select(*keep).schema.add("answer", StringType()).add("tokens_in", IntegerType()).add("tokens_out", IntegerType()).add("latency_ms", IntegerType()).add("error", StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for t, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    c = provider.complete(t, m) if t is not None else None
                    out.append((c.text, c.tokens_in, c.tokens_out, c.latency_ms, None) if c else (None,) * 5)
                except Exception as e:  # noqa: BLE001 - any failure of a remote model is data here
                    out.append((None, None, None, None, f"{type(e).__name__}: {e}"))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[2:], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], schema.fieldNames())

    return rows.select(F.col(text).cast("string").alias("__text"), F.col("model").alias("__model"), *keep).mapInArrow(run, schema)


def embed(rows: DataFrame, provider: Provider, text: str = "text", id_: str = "item_id") -> DataFrame:
    """(item_id, embedding) of the rows with a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = [provider.embed(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vectors, pa.list_(pa.float32()))], ["item_id", "embedding"])

    kind = rows.schema[id_].dataType.simpleString()
    return rows.where(F.col(text).isNotNull()).select(F.col(id_).alias("item_id"), F.col(text).alias("t")).mapInArrow(run, f"item_id {kind}, embedding array<float>")
