"""Reading and writing texts, raw blobs with manifests, intermediates and notes."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.functions import text as T
from siltwork.operators.merge import latest
from siltwork.schemas import schema

try:
    import yaml
except ImportError:  # frontmatter is then read and written as JSON, which YAML contains
    yaml = None


def pasted(spark: SparkSession, path: str, source_type: str = "paste") -> DataFrame:
    """(path, text, artifact_hash, title, source_type) of text files, each whole."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return rows.select("path", "text", T.content_hash(F.col("text")).alias("artifact_hash"), T.title(F.col("text")).alias("title"), F.lit(source_type).alias("source_type"))


def write_blobs(rows: DataFrame, folder: str) -> None:
    """Add (artifact_hash, ext, content) to the store, each hash once; rows whose bytes are there already change nothing.

    The store is a table by the first two digits of the hash, so that a look-up reads one part of it and writing takes
    no file for each artifact.
    """
    spark = rows.sparkSession
    new = rows.where(F.col("artifact_hash").isNotNull()).dropDuplicates(["artifact_hash"]).withColumn("prefix", F.substring("artifact_hash", 1, 2))
    try:
        have = spark.read.parquet(folder).select("prefix", "artifact_hash")
        new = new.join(have, ["prefix", "artifact_hash"], "left_anti")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    new.write.mode("append").partitionBy("prefix").parquet(folder)


def read_blobs(spark: SparkSession, folder: str, hashes: list[str] | None = None) -> DataFrame:
    """(artifact_hash, ext, content); with hashes only their parts of the store are read."""
    df = spark.read.parquet(folder)
    if hashes is not None:
        df = df.where(F.col("prefix").isin(sorted({h[:2] for h in hashes})) & F.col("artifact_hash").isin(hashes))
    return df.drop("prefix")


def raw_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of single files, from any file system Spark knows."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")


def manifests(spark: SparkSession, folder: str, strict: bool = True, lines: bool = False) -> DataFrame:
    """The newest manifest of each hash from JSON files, one in each, or one a line. ``strict``: a malformed one fails the read."""
    read = spark.read.schema(schema("manifest")).option("multiLine", str(not lines).lower()).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json")
    df = read.option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(folder)
    return latest(df.where("content_hash is not null"), ["content_hash"], F.col("fetched_at").desc_nulls_last())


def write_intermediate(df: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """Results of a stage by stage and generating key; a key that is written again replaces its own part only."""
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("stage", "gen_key").parquet(folder)


def read_intermediate(spark: SparkSession, folder: str, like) -> DataFrame:
    """The stored results, or an empty table of schema ``like`` if there are none yet."""
    try:
        return spark.read.parquet(folder)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], like)
        raise


def notes_text(notes: DataFrame) -> DataFrame:
    """(path, text) of (path, meta, body): the frontmatter between rules, then the body."""
    meta = F.to_json("meta", {"ignoreNullFields": "false"})
    return notes.select("path", F.concat(F.lit("---\n"), meta, F.lit("\n---\n\n"), F.regexp_replace("body", r"\s+$", ""), F.lit("\n")).alias("text"))


def parse_notes(texts: DataFrame) -> DataFrame:
    """(path, meta, body) of (path, text); meta as JSON, null for a text without frontmatter or with one that can't be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            metas, bodies = [], []
            for text in b.column(1).to_pylist():
                meta, body = None, text or ""
                parts = body.split("---\n", 2)
                if len(parts) == 3 and not parts[0].strip():
                    try:
                        value = yaml.safe_load(parts[1]) if yaml else json.loads(parts[1])
                        meta, body = json.dumps(value, default=str, sort_keys=True), parts[2].strip("\n")
                    except Exception:  # noqa: BLE001 - any malformed head
                        meta = None
                metas.append(meta)
                bodies.append(body)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(metas, pa.string()), pa.array(bodies, pa.string())], ["path", "meta", "body"])

    return texts.select(F.col("path").cast("string"), F.col("text").cast("string")).mapInArrow(run, "path string, meta string, body string")
