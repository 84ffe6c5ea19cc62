"""Helpers shared by the operators: scratch tables, batches of bytes, graph components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a new local one only in local mode where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """Tables of one run below the shared folder: written once, so a lost executor costs one stage.

    ``drop`` deletes what is not needed any more; a result that still reads a table keeps it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        df.write.option("compression", "zstd").partitionBy(*by).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def bucketed(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """As ``save``, dealt by ``key`` into as many buckets as there are shuffle partitions: joins by it move only the other side."""
        buckets, title = int(self.spark.conf.get("spark.sql.shuffle.partitions")), f"scratch_{uuid.uuid4().hex}"
        (df.repartition(buckets, key).write.format("parquet").option("compression", "zstd").option("path", self.path(name))
         .bucketBy(buckets, key).sortBy(key).saveAsTable(title))
        return self.spark.table(title)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, one after the other, and where each row starts and ends."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) \
        else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``limit`` text bytes; a longer text comes alone and whole.

    Arrow keeps the memory of former pieces; it goes back after each, as the executor's other tasks need it.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        lo, before = 0, 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(lo, hi - lo)
            pa.default_memory_pool().release_unused()
            lo, before = hi, int(ends[hi - 1])


def components(scratch: Scratch, edges: DataFrame, keep: str = "components") -> DataFrame:
    """node, component: the smallest node that edges (a, b) lead to; for each node of an edge.

    Each round links every node to the smallest neighbour of its neighbourhood (large star, then
    small star), so chains shorten by a factor and a hot node's links are summed before the shuffle.
    """
    spark, rounds, done = scratch.spark, 0, None
    now = scratch.save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                       .where("a <> b").distinct(), f"{keep}-0")
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("low", "a"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (large.join(least, "a")
                 .select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"),
                         F.col("low").alias("b")).where("a <> b").distinct())
        rounds += 1
        new = scratch.save(small, f"{keep}-{rounds}")
        state = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(f"{keep}-{rounds - 1}")
        now = new
        if state == done:
            break
        done = state
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
