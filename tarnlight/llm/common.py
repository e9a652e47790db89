"""What the operators of this subpackage share: scratch tables, free column names, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []
#: Bytes of a batch that goes to a Python worker, at most (or one row): rows are texts of any length.
BATCH_BYTES = 4 << 20
#: What may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session has none (tests, a laptop) a new temporary folder is made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tarnlight-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage and to be read several times.

    A table survives the loss of any executor. ``drop`` frees one that is no longer read; the rest goes when the driver ends.
    Making one bounds the session's Arrow batches by ``BATCH_BYTES``, which bounds the memory of executors and workers.
    """

    def __init__(self, spark: SparkSession, name: str):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        self.spark, self.root = spark, f"{shared_dir(spark)}/tarnlight/{name}-{uuid.uuid4().hex}"
        self.count = 0
        _made.append((spark, self.root))

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:04d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tarnlight_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if path := getattr(t, "_tarnlight_path", None):
                delete(self.spark, path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def bounded(df: DataFrame, size: Column | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it is small; it must be cheap to read. ``size``: bytes of a row, where rows can be large."""
    size = F.lit(0) if size is None else size
    rows, total = df.limit(BROADCAST_ROWS + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and total <= BROADCAST_BYTES else df


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _sweep() -> None:
    for spark, root in _made:
        if spark._jsc is not None and spark._jsc.sc() is not None and not spark._jsc.sc().isStopped():
            delete(spark, root)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of ``edges(a long, b long)`` as ``(node, root)``, root = smallest node reachable.

    Large-star and small-star steps by turns: each is a minimum per node and a join that Spark can split where a node is
    hot. Work per turn is in proportion to the links, and turns grow with the logarithm of the longest chain. Each turn
    is written to the shared folder. Loops and repeated links are harmless; no links give no rows.
    """
    links = scratch.save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "links")
    before = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b")
        # every node keeps a link to the least of its neighbours, itself included
        large = large.unionByName(least.filter("m < a").select("a", F.col("m").alias("b"))).distinct()
        large = scratch.save(large, "large")
        small_min = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_min, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(small_min.select("a", F.col("m").alias("b"))).distinct()
        new = scratch.save(small, "links")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(links, large)
        links = new
        if now == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now
