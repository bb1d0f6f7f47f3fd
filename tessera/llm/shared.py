"""Shared-folder tables, worker set-up and distributed connected components."""

from __future__ import annotations

import ctypes
import itertools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_REPO = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where it is not already on their path."""
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "") + os.pathsep + os.environ.get("PYTHONPATH", "")
    if _REPO not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_REPO, env.get("PYTHONPATH")) if x)
    return spark


_kept: dict[str, dict] = {}


def kept(name: str) -> dict:
    """What a worker keeps from task to task under this name, until a task begins that doesn't keep it."""
    return _kept.setdefault(name, {})


def trim(keeps: str = "") -> None:
    """Give back what a worker's earlier tasks, of other stages too, kept under other names, or have freed but the allocators still hold."""
    for name, held in _kept.items():
        if name != keeps:
            held.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: str = ""):
    """``run`` for mapInArrow, with ``trim`` before and after: idle workers stay, and count beside those of later stages."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim(keeps)
        yield from run(batches)
        trim(keeps)

    return tidied


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is configured and Spark is local (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        found = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Workspace:
    """Intermediate tables of one operator run, written to the shared folder.

    A table cuts lineage and survives the loss of any executor. ``drop`` removes those that
    the returned plan no longer reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names or ("",):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
            path.getFileSystem(conf).delete(path, True)


def components(edges: DataFrame, work: Workspace, name: str = "cc") -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long): the smallest node reachable.

    Alternating large-star and small-star contraction: each round is two hash aggregations and
    two equi-joins, the edge set never grows, and stars, chains and cliques settle in a
    logarithmic number of rounds; it ends when a round changes nothing. Only one checksum a round reaches the driver.
    """
    e = work.write(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    def state_of(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    last = state_of(e)
    for k in itertools.count(1):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("p")).select("p.u", "p.v").where("u <> v").distinct()
        e = work.write(small, f"{name}-{k}")
        state = state_of(e)
        work.drop(f"{name}-{k - 1}")
        if state == last:
            break
        last = state
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").unionByName(roots)
