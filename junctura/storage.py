"""Where operators keep tables and files that several executors must see.

The folder is the cluster's ``spark.checkpoint.dir``. Only where that is unset, as in tests on one
machine, is a folder of our own made and set.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Seconds for which free() waits, twice.
FREE_S = 0.4
#: Bytes of a shuffle that parts() puts into one task.
PART_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that the driver and all executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-junctura-")
        spark.conf.set("spark.checkpoint.dir", named)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named if "://" in named or named.startswith("file:") else f"file://{named}"


def new_dir(spark: SparkSession, name: str) -> str:
    """URI of a folder of its own for one run; it is not created yet."""
    return f"{shared_dir(spark).rstrip('/')}/junctura-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage and survives lost executors."""
    where = new_dir(df.sparkSession, name)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def drop(spark: SparkSession, where: str) -> None:
    """Remove a folder that new_dir() named."""
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Tables:
    """Tables in the shared folder that go together, see tables()."""

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, []

    def dir(self, name: str) -> str:
        self.held.append(new_dir(self.spark, name))
        return self.held[-1]

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        where = self.dir(name)
        df.write.parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def drop(self, all_but: int = 0) -> None:
        """Remove all but the last few."""
        last = len(self.held) - all_but
        for where in self.held[: max(0, last)]:
            drop(self.spark, where)
        self.held = self.held[max(0, last) :]

    def free(self, wait: bool = True) -> None:
        """Have Spark free the files of shuffles that nothing refers to any more, and give it time for it."""
        for _ in range(1 + wait):  # Python's references go first, and Spark hears of them a little later
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(FREE_S * wait)


@contextmanager
def tables(spark: SparkSession, batch_rows: int = 2000) -> Iterator[Tables]:
    """Tables that only one computation needs: they are removed at its end, so what it returns must be stored() by other means.

    Meanwhile Arrow batches have at most ``batch_rows`` rows, as rows hold whole texts.
    """
    held, key = Tables(spark), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), batch_rows) if int(before) > 0 else batch_rows))
    try:
        yield held
    finally:
        spark.conf.set(key, before)
        held.drop()
        held.free(wait=False)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; works in the driver and in tasks."""
    return pafs.FileSystem.from_uri(uri)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def parts(spark: SparkSession, n: int) -> Iterator[None]:
    """Shuffles that run meanwhile have at least n parts, and parts that are put together stay below PART_BYTES: sorted in memory, rows of numbers take about a hundred times as much as in a shuffle's files."""
    conf = {"spark.sql.shuffle.partitions": str(max(n, shuffle_partitions(spark))), "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(PART_BYTES)}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def free_name(name: str, df: DataFrame) -> str:
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def numbered(docs: DataFrame, key: str) -> DataFrame:
    """docs and ``key``, unique and ascending in (doc_id, text): doc_id itself where it has neither nulls nor repeats."""
    if not docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").limit(1).count():
        return docs.withColumn(key, F.col("doc_id").cast("long"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    ranged = docs.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    return stored(ranged.withColumn(key, F.monotonically_increasing_id()), "numbered")
