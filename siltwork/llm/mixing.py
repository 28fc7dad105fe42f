"""Mixtures of documents in which every source has its share of the tokens.

For a mix the token budget is split over its sources; a source that cannot fill its part with max_repeats copies of all
its documents is filled up, and what it lacks goes to the others in proportion to their shares. Within a source every
document has an expected number of copies: whole copies are certain, what is left over one is drawn by Pareto order
sampling. Documents are ranked by the odds of a random number over the odds of their inclusion, and taken in this order
until the size is reached, so that the size is fixed (to within a document) while the chances are unequal: documents
with the same text share the chances of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltwork.llm.tokens import count_tokens
from siltwork.session import cut

#: Seed of the random numbers, which depend on it, the mix and the document alone.
SEED = 11
#: Bins in which ranks are added up, and again within the bin where the size is reached.
BINS = 4096
#: Planned sources up to which they are broadcast to the documents, after they were counted.
FEW_SOURCES = 100_000


def targets(plan: DataFrame, sizes: DataFrame) -> DataFrame:
    """(mix_id, source, target_share, max_repeats, source_tokens, aim): the tokens each source of a mix gives.

    ``plan`` has a row a mix and source, ``sizes`` (source, n) the tokens of each source. The rows are few: sources of
    mixes. Shares are taken in proportion to their sum; a null or negative share or number of repeats counts as 0, and
    several rows of one source in a mix are added up.
    """
    clean = plan.where(F.col("mix_id").isNotNull() & F.col("source").isNotNull()).groupBy("mix_id", "source").agg(
        F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("target_share"),
        F.max(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))).alias("max_repeats"),
        F.max(F.greatest(F.coalesce("budget_ratio", F.lit(0.0)), F.lit(0.0))).alias("budget_ratio"),
    )
    rows = clean.join(sizes, "source", "left").withColumn("source_tokens", F.coalesce("n", F.lit(0)).cast("bigint")).drop("n")
    mix = W.partitionBy("mix_id")
    rows = rows.withColumn("budget", F.max("budget_ratio").over(mix) * F.sum("source_tokens").over(mix))
    rows = rows.withColumn("room", F.col("max_repeats") * F.col("source_tokens").cast("double"))
    # Filled in the order of room for their share, sources are full up to one from which on all have room for theirs.
    order = mix.orderBy(F.when(F.col("target_share") > 0, F.try_divide("room", "target_share")), "source")
    usable = F.col("target_share") > 0
    filled = F.coalesce(F.sum(F.when(usable, F.col("room"))).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    open_share = F.sum(F.when(usable, F.col("target_share"))).over(order.rowsBetween(0, W.unboundedFollowing))
    rows = rows.withColumn("level", F.when(usable, F.try_divide(F.col("budget") - filled, open_share)))
    fits = F.col("level") * F.col("target_share") <= F.col("room")
    rows = rows.withColumn("at", F.max(F.when(fits, F.col("level"))).over(mix))
    aim = F.when(~usable, 0.0).otherwise(F.least("room", F.coalesce(F.col("at") * F.col("target_share"), F.col("room"))))
    return rows.select("mix_id", "source", "target_share", "max_repeats", "source_tokens", "budget", F.greatest(aim, F.lit(0.0)).alias("aim"))


def weights(docs: DataFrame, aims: DataFrame) -> DataFrame:
    """(mix_id, source, copies, each): the expected copies ``each`` of a document whose text its source holds ``copies``
    times: in proportion to 1 / copies, at most max_repeats, and such that the source reaches its aim."""
    held = docs.groupBy("source", "copies").agg(F.sum("tokens").alias("held"))
    rows = aims.join(held, "source")
    group = W.partitionBy("mix_id", "source").orderBy("copies")
    full = F.col("max_repeats") * F.coalesce(F.sum("held").over(group.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("held") / F.col("copies")).over(group.rowsBetween(0, W.unboundedFollowing))
    rows = rows.withColumn("rate", F.try_divide(F.col("aim") - full, rest))
    fits = F.col("rate") <= F.col("max_repeats") * F.col("copies")
    rows = rows.withColumn("rate", F.max(F.when(fits, F.col("rate"))).over(W.partitionBy("mix_id", "source")))
    each = F.least(F.coalesce(F.col("rate") / F.col("copies"), F.col("max_repeats").cast("double")), F.col("max_repeats").cast("double"))
    return rows.select("mix_id", "source", "copies", "max_repeats", "aim", F.greatest(each, F.lit(0.0)).alias("each"))


def uniform(seed: int, *columns: str) -> Column:
    """A number in (0, 1) that depends on the columns and the seed alone."""
    h = F.xxhash64(F.lit(seed), *columns)
    return (F.shiftrightunsigned(h, 12).cast("double") + 0.5) / float(1 << 52)


def up_to(rows: DataFrame, keys: list[str], size: str, goal: str, bins: int = BINS) -> DataFrame:
    """The rows of each group in the order of ``rank``, in [0, 1), until their sizes reach the goal.

    A row is taken if more than half of it fits. Ranks are counted in bins first, so a group of any size is added up by
    parallel tasks; only the rows of the one bin where the goal is reached are put in order.
    """
    bin_ = F.least(F.floor(F.col("rank") * bins), F.lit(bins - 1)).cast("int")
    rows = rows.withColumn("bin", bin_)
    counted = rows.groupBy(*keys, "bin").agg(F.sum(size).alias("in_bin"), F.first(goal).alias("goal"))
    before = F.coalesce(F.sum("in_bin").over(W.partitionBy(*keys).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    edge = counted.withColumn("before", before).where(F.col("before") < F.col("goal"))
    near = rows.join(edge.select(*keys, "bin", "before", (F.col("before") + F.col("in_bin") <= F.col("goal")).alias("whole")), [*keys, "bin"])
    inside = near.where("not whole")
    running = F.sum(size).over(W.partitionBy(*keys, "bin").orderBy("rank", "doc_id").rowsBetween(W.unboundedPreceding, 0))
    part = inside.withColumn("running", F.col("before") + running).where(F.col("running") - F.col(size) / 2 <= F.col(goal)).drop("running")
    return near.where("whole").unionByName(part).drop("bin", "before", "whole")


def sized(documents: DataFrame, plan: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, tokens, copies) of the documents of the planned sources: their tokens, and how many documents of
    the source have the same text."""
    listed = plan.where(F.col("source").isNotNull()).select("source").distinct()
    listed = F.broadcast(listed) if listed.count() <= FEW_SOURCES else listed
    rows = documents.select("doc_id", "source", "text").join(listed, "source", "left_semi")
    rows = rows.withColumn("same", F.when(F.length("text") > 0, F.xxhash64("text")))
    counted = cut(count_tokens(rows, path=path), "sizes")
    many = counted.where("same is not null").groupBy("source", "same").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return cut(counted.join(many, ["source", "same"], "left").select("doc_id", "source", "tokens", F.coalesce("copies", F.lit(1)).alias("copies")), "copies")


def mix(documents: DataFrame, plan: DataFrame, seed: int = SEED, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The drawn documents (mix_id, doc_id, source, tokens, copies) and the shares (mix_id, source, target_share,
    max_repeats, source_tokens, aim_tokens, mix_tokens, actual_share, budget_tokens).

    Documents need doc_id, source, text; the plan mix_id, source, target_share, max_repeats, budget_ratio. Documents
    without tokens are never drawn, nor those of a null or unlisted source; a source without documents gives 0 tokens;
    a document given twice is drawn as two; empty tables give empty results; other columns are ignored.
    """
    docs = sized(documents, plan, path)
    totals = docs.groupBy("source").agg(F.sum("tokens").alias("n"))
    aims = cut(targets(plan, totals), "aims")
    chances = cut(weights(docs, aims), "chances")

    drawn = docs.where("tokens > 0").join(chances, ["source", "copies"]).withColumn("sure", F.floor(F.col("each") + 1e-9))
    drawn = drawn.withColumn("chance", F.greatest(F.col("each") - F.col("sure"), F.lit(0.0)))
    # What the certain copies leave of the aim.
    certain = drawn.groupBy("mix_id", "source").agg((F.max("aim") - F.sum(F.col("sure") * F.col("tokens"))).alias("goal"))
    open_ = drawn.where("chance > 1e-9").join(certain, ["mix_id", "source"])
    u = uniform(seed, "mix_id", "doc_id")
    odds = (u / (1 - u)) * F.try_divide(1 - F.col("chance"), F.col("chance"))
    ranked = open_.withColumn("rank", odds / (1 + odds)).select("mix_id", "source", "doc_id", "tokens", "rank", "goal")
    extra = up_to(ranked, ["mix_id", "source"], "tokens", "goal").select("mix_id", "doc_id", "source", "tokens", F.lit(1).alias("n"))
    sure = drawn.where("sure > 0").select("mix_id", "doc_id", "source", "tokens", F.col("sure").cast("int").alias("n"))
    out = cut(sure.unionByName(extra).groupBy("mix_id", "doc_id", "source", "tokens").agg(F.sum("n").cast("int").alias("copies")), "mix")

    got = out.groupBy("mix_id", "source").agg(F.sum(F.col("copies") * F.col("tokens")).alias("m"))
    rows = aims.join(got, ["mix_id", "source"], "left").withColumn("mix_tokens", F.coalesce("m", F.lit(0)).cast("bigint"))
    share = F.try_divide(F.col("mix_tokens"), F.sum("mix_tokens").over(W.partitionBy("mix_id")))
    shares = rows.select("mix_id", "source", "target_share", "max_repeats", "source_tokens", F.col("aim").alias("aim_tokens"), "mix_tokens", F.coalesce(share, F.lit(0.0)).alias("actual_share"), F.col("budget").alias("budget_tokens"))
    return out, shares
