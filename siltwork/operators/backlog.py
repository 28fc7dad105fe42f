"""The registry of artifacts and what is asked of the backlog: facets, search, pages, counts, progress."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltwork.operators.merge import latest

FACETS = ("source_type", "author", "source", "media")
PAGE = 50
#: States from the one that counts most for an artifact to the one that counts least.
WORST_FIRST = ("failed", "running", "held", "ready")


def register(rows: DataFrame, key: str = "artifact_hash", at: str = "created_at") -> DataFrame:
    """One row for each artifact: the latest delivery wins as a whole, nulls included, the first time is kept.

    Deliveries of one time are ordered by their other columns, so that the result does not depend on file order.
    """
    others = [c for c in rows.columns if c not in (key, at)]
    first = F.min(at).over(W.partitionBy(key)).alias("__first")
    order = [F.col(at).desc_nulls_last(), *(F.col(c).desc_nulls_last() for c in others)]
    return latest(rows.select("*", first), [key], *order).withColumn(at, F.col("__first")).drop("__first").select(*rows.columns)


def current_status(jobs: DataFrame, key: str = "artifact_hash") -> DataFrame:
    """(key, current_status): the worst state among an artifact's stages, 'done' if none of the worse ones is there."""
    chain = reduce(lambda c, s: c.when(F.bool_or(F.col("status") == s), s), WORST_FIRST[1:], F.when(F.bool_or(F.col("status") == WORST_FIRST[0]), WORST_FIRST[0]))
    return jobs.groupBy(key).agg(chain.otherwise("done").alias("current_status"))


def backlog(artifacts: DataFrame, jobs: DataFrame | None = None, filters: Mapping[str, object] | None = None, key: str = "artifact_hash") -> DataFrame:
    """Artifacts under the given filters; those that are empty are ignored.

    'search' looks for a part of title, author or source, case ignored and taken literally. 'status' and
    'hide_completed' join each artifact's state, which leaves out artifacts without any job; without them there is no join.
    """
    filters = {k: v for k, v in (filters or {}).items() if v}
    out = artifacts
    if "status" in filters or "hide_completed" in filters:
        state = current_status(jobs, key)
        if "status" in filters:
            state = state.where(F.col("current_status") == filters["status"])
        if "hide_completed" in filters:
            state = state.where(F.col("current_status") != "done")
        out = out.join(state, key)
    tests: list[Column] = [F.col(f) == filters[f] for f in FACETS if f in filters]
    if "search" in filters:
        low = F.lit(str(filters["search"]).lower())
        tests.append(reduce(lambda a, b: a | b, (F.coalesce(F.contains(F.lower(c), low), F.lit(False)) for c in ("title", "author", "source"))))
    return out.where(reduce(lambda a, b: a & b, tests)) if tests else out


def page(rows: DataFrame, number: int = 1, size: int = PAGE, key: str = "artifact_hash") -> DataFrame:
    """One page, newest first; numbers below 1 count as 1."""
    return rows.orderBy(F.col("created_at").desc(), key).offset((max(1, number) - 1) * size).limit(size)


def pages(rows: DataFrame, size: int = PAGE) -> DataFrame:
    """(total, pages), at least one page."""
    n = F.count(F.lit(1))
    return rows.agg(n.alias("total"), F.greatest(F.ceil(n / size), F.lit(1)).cast("bigint").alias("pages"))


def facet_values(artifacts: DataFrame, facets: tuple[str, ...] = FACETS) -> DataFrame:
    """(facet, value) of all values in use, in one pass."""
    parts = F.explode(F.array(*(F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in facets))).alias("p")
    return artifacts.select(parts).select("p.facet", "p.value").where("value is not null").distinct()


def unregistered(jobs: DataFrame, artifacts: DataFrame, key: str = "artifact_hash") -> DataFrame:
    """The distinct keys that have jobs but are not registered."""
    return jobs.select(key).where(F.col(key).isNotNull()).distinct().join(artifacts.select(key), key, "left_anti")


def backfill(missing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Registry rows for the missing artifacts, made of the latest manifest of each; those without any are left out."""
    newest = latest(manifest, ["content_hash"], F.col("fetched_at").desc_nulls_last(), F.col("source_url").desc_nulls_last())
    rows = missing.join(newest, missing["artifact_hash"] == newest["content_hash"])
    extra, url = F.col("extra"), F.nullif(F.col("source_url"), F.lit(""))
    return rows.select(
        "artifact_hash", "source_type", extra["from"].alias("author"), F.coalesce(F.nullif(extra["list_id"], F.lit("")), url).alias("source"),
        F.lit("text").alias("media"), F.coalesce(F.nullif(extra["subject"], F.lit("")), url).alias("title"),
    )


def resolve_prefixes(refs: DataFrame, artifacts: DataFrame, key: str = "artifact_hash", shortest: int = 2) -> DataFrame:
    """(ref, artifact_hash) of the references that are the beginning of exactly one hash, case ignored.

    References are grouped by their length, so that each length is an equality join on as long a prefix of the hashes.
    """
    lengths = sorted(r[0] for r in refs.select(F.length("ref")).distinct().collect() if r[0] and r[0] >= shortest)
    hashes = artifacts.select(F.col(key).alias("h")).distinct()
    out: DataFrame | None = None
    for n in lengths:
        named = refs.where(F.length("ref") == n).select("ref").distinct().withColumn("p", F.lower("ref"))
        part = named.join(hashes.withColumn("p", F.substring("h", 1, n)), "p").select("ref", "h")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return hashes.sparkSession.createDataFrame([], f"ref string, {key} string")
    return out.groupBy("ref").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias(key)).where("n = 1").select("ref", key)


def stage_matrix(jobs: DataFrame, stages: tuple[str, ...], states: tuple[str, ...]) -> DataFrame:
    """A row a stage with a column a state, in one aggregate; stages in their own order as ``ord``."""
    counts = [F.count_if(F.col("status") == s).cast("bigint").alias(s) for s in states]
    place = F.array_position(F.array(*map(F.lit, stages)), F.col("stage")).cast("int").alias("ord")
    return jobs.groupBy("stage").agg(*counts).select("stage", place, *states)


def frontier(jobs: DataFrame, stages: tuple[str, ...], key: str = "artifact_hash") -> DataFrame:
    """(key, done, total, stage, status): how far an artifact is and its first stage that is not done; an unknown stage
    comes last, and nothing is open if all are done."""
    place = F.array_position(F.array(*map(F.lit, stages)), F.col("stage"))
    place = F.when(place == 0, 99).otherwise(place)
    rows = jobs.select(key, "stage", "status", place.alias("p"))
    first = F.min(F.when(F.col("status") != "done", F.struct("p", "stage", "status")))
    return rows.groupBy(key).agg(F.count_if(F.col("status") == "done").alias("done"), F.count(F.lit(1)).alias("total"), first.alias("f")).select(
        key, "done", "total", F.col("f.stage").alias("stage"), F.col("f.status").alias("status")
    )


def timeline(keys: DataFrame, jobs: DataFrame, stages: tuple[str, ...], key: str = "artifact_hash") -> DataFrame:
    """A row for each stage of each given key, in order, with its job if there is one."""
    rows = keys.select(key).distinct().select(key, F.posexplode(F.array(*map(F.lit, stages))).alias("ord", "stage"))
    return rows.join(jobs.select(key, "stage", "status", "updated_at"), [key, "stage"], "left")


def next_stages(spark, chains: Mapping[str, tuple[str, ...]]) -> DataFrame:
    """(source_type, stage, next_stage) of the chains, null after the last."""
    rows = [(t, i, s) for t, chain in chains.items() for i, s in enumerate(chain)]
    df = spark.createDataFrame(rows, "source_type string, ord int, stage string")
    return df.withColumn("next_stage", F.lead("stage").over(W.partitionBy("source_type").orderBy("ord"))).drop("ord")


def stale(jobs: DataFrame, as_of: Column, minutes: int = 15) -> DataFrame:
    """Jobs that have been running for longer than that."""
    return jobs.where((F.col("status") == "running") & (F.col("updated_at") < as_of - F.make_dt_interval(mins=F.lit(minutes))))


def cost_summary(costs: DataFrame, by: str = "stage") -> DataFrame:
    return costs.groupBy(by).agg(
        F.count(F.lit(1)).alias("calls"), F.round(F.coalesce(F.sum("usd"), F.lit(0.0)), 6).alias("usd"), F.round(F.coalesce(F.avg("latency_ms"), F.lit(0.0)), 6).alias("latency_ms")
    )


def first_override(rows: DataFrame, overrides: DataFrame, scopes: Mapping[str, Column], default: str, out: str = "state") -> DataFrame:
    """``rows`` with the value of the first scope, in the order of ``scopes``, that has one under the row's key.

    ``overrides`` has scope, key, state and is a small table of settings; all scopes are looked up in one pass over it.
    """
    for i, (scope, key) in enumerate(scopes.items()):
        side = overrides.where(F.col("scope") == scope).select(F.col("key").alias(f"__k{i}"), F.col("state").alias(f"__s{i}"))
        rows = rows.join(side, F.coalesce(key, F.lit("")) == F.col(f"__k{i}"), "left")
    value = F.coalesce(*(F.col(f"__s{i}") for i in range(len(scopes))), F.lit(default))
    return rows.withColumn(out, value).drop(*(f"__{c}{i}" for i in range(len(scopes)) for c in "ks"))


def first_of_each(rows: DataFrame, limits: DataFrame, by: str, *order: Column) -> DataFrame:
    """The rows within the limit of their group, in order; groups without a limit are whole.

    ``limits`` is (by, batch_limit).
    """
    ranked = rows.join(limits, by, "left")
    free, bound = ranked.where("batch_limit is null"), ranked.where("batch_limit is not null")
    numbered = bound.withColumn("__rank", F.row_number().over(W.partitionBy(by).orderBy(*order)))
    return free.unionByName(numbered.where(F.col("__rank") <= F.col("batch_limit")).drop("__rank")).drop("batch_limit")


def oldest(jobs: DataFrame, key: str, *order: Column) -> DataFrame:
    """(key, stage): the stage that comes first in the given order for each key."""
    return jobs.groupBy(key).agg(F.min_by("stage", F.struct(*order)).alias("stage"))


def tally(jobs: DataFrame, by: str) -> DataFrame:
    """(by, done): jobs that succeeded, by group, and over all under '*'."""
    done = jobs.where("status = 'done'").rollup(by).agg(F.count(F.lit(1)).alias("done"))
    return done.select(F.coalesce(by, F.lit("*")).alias(by), "done")


def with_progress(rows: DataFrame, jobs: DataFrame, stages: tuple[str, ...], key: str) -> DataFrame:
    """Rows of a page with done, total, stage and status of their artifacts, in one aggregate over the jobs."""
    return rows.join(frontier(jobs, stages, key), key, "left").na.fill(0, ["done", "total"])


def listing(rows: DataFrame, *by: str) -> DataFrame:
    """Rows of a short summary with their place in order; all of it is numbered in one task."""
    return rows.withColumn("place", F.row_number().over(W.orderBy(*by)))
