"""Streams from folders of files, and the results that batches write."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from spendlens import shared

#: Where keyed state lies: on the executors' disks, with its changes in the checkpoint.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Bytes of files to each task that shuffles what has arrived, about.
DEALT = 16 << 20


def read_files(spark: SparkSession, path: str, per_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet file or the folder of files at `path`, with the schema of what is there; `per_batch` files make a batch."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    as_folder = reader.parquet(path) if _is_folder(spark, path) else reader.option("pathGlobFilter", path.rsplit("/", 1)[1]).parquet(path.rsplit("/", 1)[0])
    return as_folder


def _is_folder(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


def _size(spark: SparkSession, uri: str) -> int:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext._jvm.java.net.URI(uri))
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).getLen()


def in_batches(df: DataFrame, n: int, *order: str) -> DataFrame:
    """A stream of the rows of `df` in n batches or fewer, a range of `order` in each, the first the oldest: what has arrived, written as files.

    The rows are written first, so that ranges are drawn without computing them twice. As many tasks compute them, deal
    them and write a range as the size of their files asks for (`DEALT`), `spark.sql.shuffle.partitions` at least; a batch
    is several files.
    """
    spark = df.sparkSession
    context, source, path = spark.sparkContext, shared.new_path(spark, "arriving"), shared.new_path(spark, "arrived")
    least, name = int(spark.conf.get("spark.sql.shuffle.partitions")), "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    tasks = lambda files: max(least, -(-sum(_size(spark, f) for f in files) // DEALT))
    before = spark.conf.get(name, None)
    spark.conf.set(name, max(tasks(df.inputFiles()), int(before or 0)))  # small partitions are joined again
    try:
        df.write.parquet(source)
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    written = spark.read.schema(df.schema).parquet(source)
    written.repartitionByRange(max(n, tasks(written.inputFiles())), *order).write.parquet(path)
    fs = context._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(context._jsc.hadoopConfiguration())
    fs.delete(context._jvm.org.apache.hadoop.fs.Path(source), True)
    files = sorted((f.getPath() for f in fs.listStatus(context._jvm.org.apache.hadoop.fs.Path(path)) if "part-" in f.getPath().getName()), key=lambda p: p.getName())
    now = int(time.time())
    for k, file in enumerate(files):  # streams take files by age
        fs.setTimes(file, (now - len(files) + k) * 1000, -1)
    return read_files(spark, path, -(-len(files) // n))


class Versions:
    """Keyed state as a table with a version for each batch: batch n reads version n - 1 and writes version n, as often as it runs; older ones go."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def read(self, n: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{n}") if n >= 0 else self.spark.createDataFrame([], self.schema)

    def write(self, rows: DataFrame, n: int) -> DataFrame:
        names = [c.split()[0] for c in self.schema.split(", ")]
        rows.select(*names).write.mode("overwrite").parquet(f"{self.path}/{n}")
        old = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n - 2}")
        old.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
        return self.read(n)


def run(rows: DataFrame, mode: str, base: str, schema: str, keep: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Runs a stream over all that is there; each batch's rows go to `out/batch=N` under `base`, together with an empty table to begin with."""
    spark = rows.sparkSession
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{base}/out/batch=-1")

    def save(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={n}")

    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        query = rows.writeStream.outputMode(mode).foreachBatch(keep or save).option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    return query


def results(spark: SparkSession, base: str, schema: str) -> DataFrame:
    """The rows of all batches, with the number of the batch."""
    return spark.read.schema(f"{schema}, batch int").option("basePath", f"{base}/out").parquet(f"{base}/out").withColumn("batch", F.col("batch").cast("long"))
