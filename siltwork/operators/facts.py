"""Claims and entities derived from facts: attestations, mentions, links and ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltwork.functions import text as T


def attest(candidates: DataFrame, same: Column, *order: Column) -> DataFrame:
    """Candidates with the claim they attest: the first, in order, of those that are the same.

    Adds ``claim``, the id of that first candidate, and ``is_new``. Candidates need id; equal ones form a group of any
    size, of which only the first row crosses the join.
    """
    keyed = candidates.withColumn("__same", F.xxhash64(same)).withColumn("__key", same)
    first = keyed.groupBy("__same", "__key").agg(F.min(F.struct(*order, F.col("id"))).getField("id").alias("claim"))
    return keyed.join(first, ["__same", "__key"]).withColumn("is_new", F.col("id") == F.col("claim")).drop("__same", "__key")


def attestation_counts(attested: DataFrame, source: Column) -> DataFrame:
    """(claim, attestations, sources): how often and from how many sources a claim was made."""
    return attested.groupBy("claim").agg(F.count(F.lit(1)).alias("attestations"), F.count_distinct(source).alias("sources"))


def run_summary(attested: DataFrame, by: str) -> DataFrame:
    """(by, new, attested) of each run."""
    return attested.groupBy(by).agg(F.count_if("is_new").alias("new"), F.count_if(~F.col("is_new")).alias("attested"))


def accumulate(facts: DataFrame, by: str, what: list[str], *order: str) -> DataFrame:
    """(by, items, n): the facts of each key as one list in order of arrival."""
    item = F.struct(*order, *(c for c in what if c not in order))
    listed = F.array_sort(F.collect_list(item))
    return facts.groupBy(by).agg(F.transform(listed, lambda x: F.struct(*(x[c].alias(c) for c in what))).alias("items"), F.count(F.lit(1)).alias("n"))


def exact_entities(mentions: DataFrame, *order: str) -> DataFrame:
    """(name, type, first, mentions): one entity for each name and type as they stand, with the first mention."""
    return mentions.groupBy("name", "type").agg(F.min(F.struct(*order)).alias("first"), F.count(F.lit(1)).alias("mentions"))


def entity_ids(entities: DataFrame, *order: str) -> DataFrame:
    """Entities with ``entity_id``: the slug of the name, from the second one on with -2, -3 and so on.

    A number is passed over where another name's own slug has it already, as 'a-2' beside 'a'; the numbers are given
    within a slug, in order. Slugs that share a stem are few; only those with a colliding ending are looked up.
    """
    slugs = entities.withColumn("slug", T.slug(F.col("name")))
    taken = slugs.select("slug").distinct()
    stem, number = F.regexp_extract("slug", r"^(.*)-(\d{1,9})$", 1), F.regexp_extract("slug", r"^(.*)-(\d{1,9})$", 2)
    ending = taken.where(F.col("slug").rlike(r"-[1-9]\d{0,8}$")).select(stem.alias("slug"), number.cast("int").alias("n")).where("n >= 2")
    used = ending.groupBy("slug").agg(F.array_sort(F.collect_list("n")).alias("used"))
    ranked = slugs.withColumn("r", F.row_number().over(W.partitionBy("slug").orderBy(*order))).join(used, "slug", "left")
    # The r-th free number from 2 on: r plus how many used numbers lie at or below it.
    free = F.when(F.col("used").isNull(), F.col("r")).otherwise(F.aggregate("used", F.col("r"), lambda at, n: F.when(n <= at, at + 1).otherwise(at)))
    return ranked.withColumn("entity_id", F.when(F.col("r") == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", free.cast("string")))).drop("slug", "r", "used")


def annotations(notes: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Notes with the source they annotate, null where it is not registered."""
    a = artifacts.select(F.col("artifact_hash").alias("annotates"), F.col("title").alias("target_title"), F.col("source_type").alias("target_type"))
    return notes.where("annotates is not null").join(a, "annotates", "left")


def append_costs(costs: DataFrame, folder: str) -> None:
    """Add the costs of a run to a ledger; rows that are there are never changed."""
    costs.write.mode("append").parquet(folder)


def usage(costs: DataFrame, *by: str) -> DataFrame:
    """(by, calls, tokens_in, usd) of a ledger."""
    return costs.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens_in").cast("bigint").alias("tokens_in"), F.round(F.sum("usd"), 6).alias("usd"))
