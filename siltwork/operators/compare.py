"""Variants of a derivation side by side: run, report, approve."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltwork.functions.keys import key_digest_column
from siltwork.operators.providers import Provider, complete


def run(inputs: DataFrame, variants: DataFrame, provider: Provider, text: str = "text", digest: str = "artifact_hash") -> DataFrame:
    """A row for each input and variant with its answer, use and generating key.

    ``variants`` (index, provider, model, prompt_version, params) is a handful of rows.
    """
    rows = inputs.crossJoin(F.broadcast(variants)).withColumn("gen_key", key_digest_column(F.col("provider"), F.col("model"), F.col("params"), F.col("prompt_version"), F.col(digest)))
    return complete(rows, provider, text)


def pending(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """The rows whose generating key has no stored result, so that nothing is computed again."""
    return rows.join(stored.select("gen_key").distinct(), "gen_key", "left_anti")


def report(results: DataFrame, outputs: str = "outputs") -> DataFrame:
    """(index, provider, model, inputs, outputs, tokens_in, tokens_out, latency_ms) over all inputs."""
    return results.groupBy("index", "provider", "model").agg(
        F.count(F.lit(1)).alias("inputs"), F.sum(outputs).cast("bigint").alias("outputs"), F.sum("tokens_in").cast("bigint").alias("tokens_in"),
        F.sum("tokens_out").cast("bigint").alias("tokens_out"), F.round(F.avg("latency_ms"), 6).alias("latency_ms"),
    )


def report_table(summary: DataFrame) -> DataFrame:
    """(line): the report as lines of a markdown table, in order of ``index``."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("—"))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(c) for c in ("index", "provider", "model", "outputs"))), F.lit(" | "), cell("tokens_in"), F.lit("/"), cell("tokens_out"), F.lit(" |"))
    return summary.select("index", row.alias("line"))


def approve(results: DataFrame, choices: DataFrame, digest: str = "artifact_hash") -> DataFrame:
    """The results of the chosen variant of each input; ``choices`` is (digest, index)."""
    return results.join(choices, [digest, "index"])


def queue_next(approved: DataFrame, chain: DataFrame, stage: str) -> DataFrame:
    """Approved results with the stage that follows ``stage`` and status 'ready'; none after the last stage.

    ``chain`` is (source_type, stage, next_stage), a few rows.
    """
    after = chain.where((F.col("stage") == stage) & F.col("next_stage").isNotNull()).select(F.col("next_stage").alias("stage")).distinct()
    return approved.crossJoin(F.broadcast(after)).withColumn("status", F.lit("ready"))
