"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Rows with one text form a group that is never split. Groups are sorted by falling size and enter the bin with the tightest
remaining capacity that still holds them, found in a balanced tree; where none does, a bin opens. That is done twice. First
groups are packed into bins of a fixed capacity, a small part of a shard, by regions of about ``REGION`` groups, a task
each; a region's smallest groups, with 1/``SAND`` of its bytes, get bins of 1/``SAND`` of the capacity, which level out the
shards later. Then the bins, and the groups above a ``1 / (shards * FINE)`` part of all bytes or rows, are packed into the
shards on the driver: at most ``2 * shards * (FINE + 2 * BINS)`` and two a region, of which there are at most
``MOST_REGIONS``, whatever the input. The smallest capacity at which all fit is sought by halving, so shards come out near
equal. A group larger than a fair share takes a shard of its own, and the others share out the rest.

Defined results: a null text counts 0 bytes (size 1, crc32 0) and all null texts with the empty texts form one group.
Repeated rows and ids are kept, each with its own slot. Ties of size go by key. An empty table gives no rows. Extra columns
are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnlight.llm.common import Scratch

FINE, BINS, SAND, REGION, MOST_REGIONS = 64, 128, 16, 20_000, 16_384
#: Rows numbered by one task for slots.
RUN = 50_000


class Node:
    __slots__ = ("key", "left", "level", "right")

    def __init__(self, key):
        self.key, self.left, self.right, self.level = key, None, None, 1


class Tree:
    """An AA tree, balanced, of ``(remaining, bin)``."""

    def __init__(self):
        self.root = None

    @staticmethod
    def _skew(n):
        if n and n.left and n.left.level == n.level:
            m = n.left
            n.left, m.right = m.right, n
            return m
        return n

    @staticmethod
    def _split(n):
        if n and n.right and n.right.right and n.right.right.level == n.level:
            m = n.right
            n.right, m.left = m.left, n
            m.level += 1
            return m
        return n

    def add(self, key):
        def put(n):
            if n is None:
                return Node(key)
            if key < n.key:
                n.left = put(n.left)
            else:
                n.right = put(n.right)
            return self._split(self._skew(n))

        self.root = put(self.root)

    def remove(self, key):
        def cut(n, key):
            if n is None:
                return None
            if key < n.key:
                n.left = cut(n.left, key)
            elif key > n.key:
                n.right = cut(n.right, key)
            elif n.left is None and n.right is None:
                return None
            elif n.left is None:
                m = n.right
                while m.left:
                    m = m.left
                n.key, n.right = m.key, cut(n.right, m.key)
            else:
                m = n.left
                while m.right:
                    m = m.right
                n.key, n.left = m.key, cut(n.left, m.key)
            fit = min((n.left.level if n.left else 0), (n.right.level if n.right else 0)) + 1
            if fit < n.level:
                n.level = fit
                if n.right and fit < n.right.level:
                    n.right.level = fit
            n = self._skew(n)
            n.right = self._skew(n.right)
            if n.right:
                n.right.right = self._skew(n.right.right)
            n = self._split(n)
            n.right = self._split(n.right)
            return n

        self.root = cut(self.root, key)

    def tightest(self, size):
        """The least ``(remaining, bin)`` with room for ``size``, or None."""
        n, best = self.root, None
        while n:
            if n.key[0] >= size:
                best, n = n.key, n.left
            else:
                n = n.right
        return best


def best_fit_decreasing(items: list[tuple[str, int]], capacity: int, bins: int | None = None) -> dict[str, int] | None:
    """Bin of each ``(key, size)``. ``bins``: so many at most, None if they don't hold all; without it, bins open as needed."""
    tree, out, opened = Tree(), {}, 0
    for key, size in sorted(items, key=lambda x: (-x[1], x[0])):
        at = tree.tightest(size)
        if at is None:
            if bins is not None and opened == bins or size > capacity and bins is not None:
                return None
            at, opened = (max(capacity, size), opened), opened + 1
        else:
            tree.remove(at)
        out[key] = at[1]
        tree.add((at[0] - size, at[1]))
    return out


def pack(items: list[tuple[str, int]], shards: int) -> dict[str, int]:
    """Shard of each item: over-large items alone, the rest at the smallest capacity that best-fit-decreasing can keep."""
    items, out, first = sorted(items, key=lambda x: (-x[1], x[0])), {}, 0
    total = sum(s for _, s in items)
    while items and shards - first > 1 and items[0][1] * (shards - first) > total:
        key, size = items.pop(0)
        out[key], total, first = first, total - size, first + 1
    if not items:
        return out
    n = shards - first
    low, high = max(-(-total // n), items[0][1]), -(-total // n) + items[0][1]
    best = best_fit_decreasing(items, high, n)
    while low < high:
        mid = (low + high) // 2
        if (found := best_fit_decreasing(items, mid, n)) is not None:
            best, high = found, mid
        else:
            low = mid + 1
    return out | {k: first + v for k, v in best.items()}


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32, key``: the text is read once and not carried on."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text, 256).alias("key"))


def slots(rows: DataFrame, by: str, order: list[str], scratch: Scratch) -> DataFrame:
    """Gapless numbers from 0 in each ``by``, as ``slot``. Rows are numbered in runs of about ``RUN`` by hash of ``order``,
    so no task holds a whole shard; runs are offset by the counts before them."""
    runs = max(1, -(-rows.count() // RUN))
    rows = rows.withColumn("_run", F.pmod(F.xxhash64(*order), F.lit(runs).cast("long")))
    sums = rows.groupBy(by, "_run").agg(F.count("*").alias("_n"))
    sums = sums.select(by, "_run", (F.sum("_n").over(Window.partitionBy(by).orderBy("_run")) - F.col("_n")).alias("_before"))
    inner = F.row_number().over(Window.partitionBy(by, "_run").orderBy(*order)) - 1
    return rows.withColumn("_in", inner).join(sums, [by, "_run"]).withColumn("slot", (F.col("_before") + F.col("_in")).cast("long")).drop("_run", "_in", "_before")


def binned(groups: DataFrame, capacity: int, region: int = REGION, sand: int = 1) -> DataFrame:
    """``key, size, bin`` string of ``groups(key, size)``: bins of ``capacity`` by best-fit-decreasing, in regions by hash of the key.

    A group above the capacity gets a bin of its own size. ``sand``: see above; 1 for none.
    """
    regions = max(1, min(MOST_REGIONS, -(-groups.count() // region)))

    def pack_region(t: pa.Table) -> pa.Table:
        items = sorted(zip(t.column("key").to_pylist(), t.column("size").to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
        n, tail = len(items), sum(s for _, s in items) // sand if sand > 1 else 0
        while n and items[n - 1][1] <= min(tail, capacity // sand):
            tail, n = tail - items[n - 1][1], n - 1
        name = t.column("region")[0].as_py()
        out = [(k, f"{name}-{at}") for k, at in best_fit_decreasing(items[:n], capacity).items()]
        out += [(k, f"{name}-s{at}") for k, at in best_fit_decreasing(items[n:], capacity // sand).items()]
        sizes = dict(items)
        return pa.table({"key": [k for k, _ in out], "size": pa.array([sizes[k] for k, _ in out], pa.int64()), "bin": [b for _, b in out]})

    return groups.select(F.pmod(F.xxhash64("key"), F.lit(regions).cast("long")).alias("region"), "key", "size").groupBy("region").applyInArrow(pack_region, "key string, size long, bin string")


def shard(docs: DataFrame, shards: int = 16, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "sharding")
    rows = scratch.save(keyed(docs), "keyed")
    groups = scratch.save(rows.groupBy("key").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "groups")
    total, count = (x or 0 for x in groups.agg(F.sum("size"), F.sum("n")).first())
    large = (F.col("size") * (shards * FINE) > total) | (F.col("n") * (shards * FINE) > count)
    big = groups.filter(large).select("key", "size")
    bins = scratch.save(binned(groups.filter(~large), max(1, -(-total // (shards * BINS))), sand=SAND), "bins")
    sizes = bins.groupBy("bin").agg(F.sum("size").alias("size"))
    items = [(f"={r['key']}", r["size"]) for r in big.collect()] + [(r["bin"], r["size"]) for r in sizes.collect()]  # bounded: see above
    placed = pack(items, shards)
    where = lambda some, name: F.broadcast(spark.createDataFrame(some, f"{name} string, shard int"))
    alone = where([(k[1:], v) for k, v in placed.items() if k[0] == "="], "key")
    rest = bins.join(where([(k, v) for k, v in placed.items() if k[0] != "="], "bin"), "bin").select("key", "shard")
    found = rows.join(alone, "key").unionByName(rows.join(alone, "key", "left_anti").join(rest, "key"))
    found = scratch.save(found.select("doc_id", "size", "text_crc32", "shard"), "sharded")
    return slots(found, "shard", ["doc_id", "text_crc32", "size"], scratch)


def pack_fixed(docs: DataFrame, capacity: int, region: int = REGION) -> DataFrame:
    """``doc_id, size, text_crc32, shard`` string with as few shards of ``capacity`` bytes as best-fit-decreasing finds in each region."""
    rows = Scratch(docs.sparkSession, "sharding").save(keyed(docs), "keyed")
    placed = binned(rows.groupBy("key").agg(F.sum("size").alias("size")), capacity, region)
    return rows.join(placed.select("key", F.col("bin").alias("shard")), "key").select("doc_id", "size", "text_crc32", "shard")


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
