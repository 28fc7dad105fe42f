"""Incremental runs: landed rows are taken up in micro-batches, what they change is merged into snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltwork.operators.merge import Snapshots, latest
from siltwork.session import shared_dir


def drain(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True, interval: str = "2 seconds") -> None:
    """Run ``each`` for every micro-batch: of all that is there if ``once``, else for ever at an interval."""
    write = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    query = (write.trigger(availableNow=True) if once else write.trigger(processingTime=interval)).start()
    query.awaitTermination()


def keep_latest(stream: DataFrame, table: Snapshots, keys: list[str], order: list[str], checkpoint: str, first: tuple[str, ...] = ()) -> None:
    """Merge the latest row of each key and batch into a table of snapshots; the columns ``first`` keep the least value that
    any row of the key had.

    A row of an earlier time than the table's does not replace it, so that batches may come in any order, and a batch
    that is run again after a failure changes nothing. The table keeps the time it is ordered by in a column
    ``latest_<name>`` for each of ``first``, as the least value no longer tells it.
    """
    newest = [F.col(f"latest_{c}" if c in first else c).desc_nulls_last() for c in order]

    def each(batch: DataFrame, _: int) -> None:
        rows = batch.withColumns({f"latest_{c}": F.col(c) for c in first})
        old = table.read()
        both = old.unionByName(rows.select(*old.columns))
        least = {c: F.min(c).over(W.partitionBy(*keys)) for c in first}
        table.write(latest(both.withColumns(least), keys, *newest))

    drain(stream, each, checkpoint)


def parquet_stream(spark: SparkSession, folder: str, name: str, files: int = 4) -> DataFrame:
    """A table of a data folder as a stream, be it one file or a folder of them."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return read.parquet(f"{folder}/{name}.parquet")
    return read.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def new_folder(spark: SparkSession, label: str) -> str:
    import uuid

    return f"{shared_dir(spark)}/siltwork/{label}-{uuid.uuid4().hex}"
