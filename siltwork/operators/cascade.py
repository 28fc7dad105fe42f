"""Claims and entities resolved against what is known: exact match, nearest shortlist, threshold, confirmation, attest or create."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltwork.functions import vectors as V
from siltwork.operators import similarity
from siltwork.operators.merge import Snapshots
from siltwork.session import cut

#: Confirms that two rows, each as a struct of its columns, are the same.
Confirm = Callable[[Column, Column], Column]


def usable(v: Column, dimensions: int) -> Column:
    return (F.size(v) == dimensions) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def resolve(candidates: DataFrame, confirm: Confirm, known: DataFrame | None = None, k: int = 5, max_distance: float = 0.6, dimensions: int = 64) -> DataFrame:
    """(id, resolved, is_new): candidates in the order of ``ord`` join the first confirmed of the k nearest rows known so
    far, up to the distance, the bound included; one that none confirms becomes known to those after it.

    ``candidates`` has id, ord, embedding and what ``confirm`` looks at; ``known`` has the same columns, all of whose rows
    come before the candidates. Embeddings are brought to length 1; rows without a usable one join nothing. Pairs in reach
    are confirmed in one pass and the walk then goes over them, so an outcome depends on pairs in reach only.
    """
    before = known.withColumn("__known", F.lit(True)) if known is not None else None
    rows = candidates.withColumn("__known", F.lit(False))
    rows = cut(rows if before is None else before.unionByName(rows), "resolve")
    units = rows.where(usable(F.col("embedding"), dimensions)).select("id", V.normalised(F.col("embedding")).alias("embedding"))
    reach = similarity.within(units, max_distance, "id")
    told = rows.select("id", F.struct(*(c for c in rows.columns if c not in ("embedding", "__known"))).alias("row"))
    pairs = reach.join(told.toDF("a", "ra"), "a").join(told.toDF("b", "rb"), "b")
    near = cut(pairs.select("a", "b", "distance", F.coalesce(confirm(F.col("ra"), F.col("rb")), F.lit(False)).alias("same")), "near")
    order = F.struct(~F.col("__known"), F.col("ord"))
    led = similarity.leaders(rows.select("id", order.alias("ord")), near, "id", k)
    return led.join(candidates.select(F.col("id").alias("item")), "item").select(F.col("item").alias("id"), F.col("leader").alias("resolved"), (F.col("item") == F.col("leader")).alias("is_new"))


def exact_first(mentions: DataFrame) -> DataFrame:
    """``mentions`` (name, type, ord) with first, the least ord of the same name and type as they stand, and is_first."""
    first = mentions.withColumn("first", F.min("ord").over(W.partitionBy("name", "type")))
    return first.withColumn("is_first", F.col("ord") == F.col("first"))


def take_batch(index: Snapshots, batch: DataFrame, confirm: Confirm, **options) -> DataFrame:
    """Resolve a micro-batch against the index and add what is new to it: the state that is kept between runs."""
    out = cut(resolve(batch, confirm, index.read(), **options), "resolved")
    fresh = batch.join(out.where("is_new").select("id"), "id", "left_semi")
    index.merge(fresh.select(*index.read().columns), ["id"])
    return out
