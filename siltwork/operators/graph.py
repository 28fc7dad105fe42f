"""Connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltwork.session import cut


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, root): the connected components of (a, b), each under its smallest node; nodes without links are absent.

    Alternates large-star and small-star steps, each a group by and a join written into the shared folder, until
    nothing changes; the number of steps grows with the logarithm of the size of a component. A node of very many
    links is one row of an aggregate on one side of its join and split by the adaptive skew join on the other.
    """
    now = cut(links.select("a", "b").where("a <> b").distinct(), label)
    seen = _sum(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.where("a <> b").distinct(), label)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        then = cut(small.where("a <> b").distinct(), label)
        before, seen = seen, _sum(then)
        if seen == before:
            ends = then.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return ends.unionByName(then.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        now = then


def _sum(links: DataFrame) -> tuple:
    """Count and sum of two hashes of distinct links: equal for equal sets of them."""
    hashes = (F.xxhash64("a", "b"), F.xxhash64("b", "a", F.lit(1)))
    return tuple(links.agg(F.count(F.lit(1)), *(F.sum(h.cast("decimal(38,0)")) for h in hashes)).first())
