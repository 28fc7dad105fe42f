"""Nearest neighbours of a query set and all pairs within a distance, exactly, in blocks; and clusters around leaders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltwork.operators.graph import components
from siltwork.session import cut

#: Queries and rows of a block; a task holds one block of each.
QUERIES, ROWS = 1024, 8192
#: Rows of a block of the range join, and pairs it passes on at a time.
SIDE, PAIRS = 2048, 100_000


def _blocks(rows: DataFrame, size: int, n: int, id_: str, vector: str, prefix: str) -> DataFrame:
    block = F.pmod(F.xxhash64(id_), F.lit(max(1, -(-n // size))))
    return rows.groupBy(block.alias(f"{prefix}b")).agg(F.collect_list(F.struct(F.col(id_).alias("id"), F.col(vector).cast("array<double>").alias("v"))).alias(prefix))


def knn(queries: DataFrame, index: DataFrame, k: int = 5, max_distance: float | None = None, id_: str = "item_id", vector: str = "embedding") -> DataFrame:
    """(query, item, distance, rank): the k nearest rows of the index by Euclidean distance, rank from 1.

    Exact. Among equal distances (to 6 decimals) the smaller id comes first; with ``max_distance`` those beyond it are
    left out, the bound included. A row is not its own neighbour. Rows with a null id or vector, or of another dimension
    than the query, take no part. Both sides are cut into blocks of bounded size, each pair of blocks is one matrix
    product that passes on k rows a query only; meant for a query set, not for all rows against all.
    """
    kind = index.schema[id_].dataType.simpleString()
    q, x = (d.where(F.col(id_).isNotNull() & F.col(vector).isNotNull()).select(id_, vector) for d in (queries, index))
    left, right = _blocks(q, QUERIES, q.count(), id_, vector, "q"), _blocks(x, ROWS, x.count(), id_, vector, "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids: list = []
            items: list = []
            distances: list = []
            for asked, held in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for d in {len(r["v"]) for r in asked}:
                    mine = [r for r in asked if len(r["v"]) == d]
                    rows = sorted((r for r in held if len(r["v"]) == d), key=lambda r: r["id"])
                    if not rows or not d:
                        continue
                    names = np.array([r["id"] for r in rows], object)
                    qs, xs = np.array([r["v"] for r in mine], float), np.array([r["v"] for r in rows], float)
                    square = (qs * qs).sum(1)[:, None] + (xs * xs).sum(1) - 2 * (qs @ xs.T)
                    for i, r in enumerate(mine):
                        near = np.argpartition(square[i], min(k + 8, len(rows) - 1))[: k + 9] if len(rows) > k + 9 else np.arange(len(rows))
                        # All within rounding of the last are measured again without cancellation.
                        near = np.flatnonzero(square[i] <= square[i][near].max() + 1e-9)
                        exact = np.round(np.sqrt(((xs[near] - qs[i]) ** 2).sum(1)), 6)
                        kept = [j for j in np.argsort(exact, kind="stable") if names[near[j]] != r["id"]][:k]
                        ids += [r["id"]] * len(kept)
                        items += [names[near[j]] for j in kept]
                        distances += [float(exact[j]) for j in kept]
            kinds = pa.schema([("q", b.schema.field(0).type.value_type.field("id").type)])
            yield pa.RecordBatch.from_arrays([pa.array(ids, kinds[0].type), pa.array(items, kinds[0].type), pa.array(distances, pa.float64())], ["query", "item", "distance"])

    best = left.crossJoin(right).select("q", "x").mapInArrow(run, f"query {kind}, item {kind}, distance double")
    if max_distance is not None:
        best = best.where(F.col("distance") <= max_distance)
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("distance", "item")))
    return ranked.where(F.col("rank") <= k)


def with_metadata(hits: DataFrame, rows: DataFrame, item: str = "item") -> DataFrame:
    """Hits with what is known of their items; a hit of which nothing is known is dropped, its rank stays unused."""
    return hits.join(rows, item)


def within(rows: DataFrame, max_distance: float, id_: str = "item_id", vector: str = "embedding") -> DataFrame:
    """(a, b, distance): every pair of rows up to ``max_distance`` apart, the bound included, smaller id first.

    Exact, over all rows and without a limit by row: distances are Euclidean, rounded to 6 decimals as in ``knn``. Rows
    with a null id or vector take no part, rows of different dimensions make no pair. Each pair of blocks is held once.
    """
    kind = rows.schema[id_].dataType.simpleString()
    x = rows.where(F.col(id_).isNotNull() & F.col(vector).isNotNull()).select(id_, vector)
    n = x.count()
    left, right = _blocks(x, SIDE, n, id_, vector, "q"), _blocks(x, SIDE, n, id_, vector, "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            type_ = b.schema.field(1).type.value_type.field("id").type
            columns: tuple[list, list, list] = ([], [], [])

            def full(columns=columns, type_=type_) -> pa.RecordBatch:
                out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (type_, type_, pa.float64()), strict=True)], ["a", "b", "distance"])
                for c in columns:
                    c.clear()
                return out

            for one_block, asked, held in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                for d in {len(r["v"]) for r in asked} - {0}:
                    mine, others = ([r for r in side if len(r["v"]) == d] for side in (asked, held))
                    if not others:
                        continue
                    qs, xs = np.array([r["v"] for r in mine], float), np.array([r["v"] for r in others], float)
                    xx = (xs * xs).sum(1)
                    for i, r in enumerate(mine):
                        square = xx + (qq := qs[i] @ qs[i]) - 2 * (xs @ qs[i])
                        # All within rounding of the bound are measured again without cancellation.
                        near = np.flatnonzero(square <= (max_distance + 1e-6) ** 2 + 1e-9 * (1 + xx + qq))
                        exact = np.round(np.sqrt(((xs[near] - qs[i]) ** 2).sum(1)), 6)
                        for j, distance in zip(near.tolist(), exact.tolist(), strict=True):
                            me, other = r["id"], others[j]["id"]
                            if distance <= max_distance and (me < other or me != other and not one_block):
                                for c, v in zip(columns, (min(me, other), max(me, other), distance), strict=True):
                                    c.append(v)
                        if len(columns[0]) >= PAIRS:
                            yield full()
            yield full()

    blocks = left.crossJoin(right).where("qb <= xb").select((F.col("qb") == F.col("xb")).alias("one_block"), "q", "x")
    return blocks.mapInArrow(run, f"a {kind}, b {kind}, distance double")


def leaders(items: DataFrame, near: DataFrame, id_: str = "item", k: int = 5) -> DataFrame:
    """(item, leader): items in the order of ``ord`` join the first confirmed of the k nearest leaders so far, or lead.

    ``near`` has (a, b, distance) of the pairs in reach, each once, and may have ``same``, whether the pair is confirmed;
    without it every pair is. A pair that is not confirmed takes one of the k places all the same. What happens to an item depends only on
    items it is linked to, so that connected components of the links are worked on apart and give exactly the outcome of
    one pass over all. Items without a link lead themselves without being moved.
    """
    linked = cut(components(near.select("a", "b")), "linked")
    ends = linked.toDF("start", "root")
    kind = items.schema[id_].dataType.simpleString()
    place = F.row_number().over(W.partitionBy("root").orderBy("ord", "item")).alias("place")
    member = items.join(linked, F.col(id_) == F.col("node")).select("root", F.col(id_).alias("item"), "ord").select("root", "item", place)
    near = near if "same" in near.columns else near.withColumn("same", F.lit(True))
    both = near.select("a", "b", "distance", "same").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance", "same"))
    links = both.join(ends, F.col("a") == F.col("start")).select("root", "a", "b", "distance", "same")

    def run(key, group: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        around: dict = {}
        for a, b, d, same in zip(pairs["a"], pairs["b"], pairs["distance"], pairs["same"], strict=True):
            around.setdefault(a, []).append((d, b, same))
        led: dict = {}
        for x in group.sort_values("place")["item"]:
            shortlist = sorted(h for h in around.get(x, ()) if led.get(h[1]) == h[1])[:k]
            led[x] = next((b for _, b, same in shortlist if same), x)
        return pd.DataFrame({"item": list(led), "leader": list(led.values())})

    joined = member.groupBy("root").cogroup(links.groupBy("root")).applyInPandas(run, f"item {kind}, leader {kind}")
    alone = items.select(F.col(id_).alias("item")).join(linked, F.col("item") == F.col("node"), "left_anti").select("item", F.col("item").alias("leader"))
    return joined.unionByName(alone)
