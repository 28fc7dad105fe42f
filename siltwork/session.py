"""Session, table access and lineage cuts shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: The folder that holds the package; Python workers must be able to import from it.
ROOT = str(Path(__file__).resolve().parent.parent)


def build(name: str = "siltwork", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans are written for; ``conf`` keys use ``_`` for ``.``.

    ``master`` stays unset on a cluster, where spark-submit names it.
    """
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    return b.config(map=settings).getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, wherever the driver was started."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, have)])
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder."""
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one if it is unset on a local master (tests).

    On a cluster there is no folder that could stand in for it, so that a missing setting is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get().rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="siltwork-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame, label: str, *by: str) -> DataFrame:
    """Write ``df`` into the shared folder, in folders by the columns ``by``, and read it back.

    Cuts the lineage: a lost executor costs a re-read of the files, never a recomputation of what came before.
    """
    path = f"{shared_dir(df.sparkSession)}/siltwork/{label}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
