"""Keyed merges, and tables kept as snapshots."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key: the first in the given order. The rank filter prunes before the shuffle."""
    ranked = df.withColumn("__rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("__rank") == 1).drop("__rank")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], rules: Mapping[str, str] | None = None) -> DataFrame:
    """``old`` with the rows of ``new``, of which each key has one.

    By column: 'new' takes the new value, null included; 'old' keeps the old row's; 'coalesce' takes the new value
    unless it is null; 'min' and 'max' take the smaller or greater of both. Columns without a rule are 'new'. Keys may
    not be null.
    """
    rules = rules or {}
    n = new.select(*(F.col(c).alias(f"__n_{c}") for c in old.columns)).withColumn("__new", F.lit(True))
    o = old.withColumn("__old", F.lit(True))
    on = [F.col(k) == F.col(f"__n_{k}") for k in keys]
    both = o.join(n, on, "full")
    out = []
    for c in old.columns:
        mine, theirs = F.col(c), F.col(f"__n_{c}")
        rule = rules.get(c, "new")
        if c in keys:
            value = F.coalesce(theirs, mine)
        elif rule == "coalesce":
            value = F.coalesce(theirs, mine)
        elif rule in ("min", "max"):
            value = (F.least if rule == "min" else F.greatest)(mine, theirs)
        elif rule == "old":
            value = F.when(F.col("__old"), mine).otherwise(theirs)
        else:
            value = F.when(F.col("__new"), theirs).otherwise(mine)
        out.append(value.alias(c))
    return both.select(*out)


def without(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key is not in ``gone``; rows with a null key stay."""
    return df.join(gone.select(*keys).distinct(), keys, "left_anti")


class Snapshots:
    """A table as immutable snapshots in a folder, one of them current; one writer at a time.

    A snapshot is written whole before the next numbered pointer is put beside the others; the highest number counts. No
    pointer is ever changed or removed, so that a reader, or a writer that failed half way, always finds a full table.
    """

    def __init__(self, spark: SparkSession, folder: str, schema):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def _file(self, name: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _number(self) -> int:
        system, path = self._file("pointers")
        return max((int(f.getPath().getName()) for f in system.listStatus(path)), default=0) if system.exists(path) else 0

    def current(self) -> str | None:
        number = self._number()
        return self.spark.read.text(f"{self.folder}/pointers/{number}").first()[0] if number else None

    def read(self) -> DataFrame:
        name = self.current()
        if name is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/{name}")

    def write(self, df: DataFrame) -> None:
        name = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{name}")
        system, path = self._file(f"new-{uuid.uuid4().hex}")
        stream = system.create(path, False)
        stream.write(bytearray(name.encode()))
        stream.close()
        _, pointer = self._file(f"pointers/{self._number() + 1}")
        system.mkdirs(pointer.getParent())
        if not system.rename(path, pointer):
            raise RuntimeError(f"another writer has changed the table in {self.folder}")

    def merge(self, new: DataFrame, keys: list[str], rules: Mapping[str, str] | None = None) -> None:
        self.write(upsert(self.read(), new, keys, rules))
