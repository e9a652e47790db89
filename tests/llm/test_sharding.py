"""Shards: whole groups, near equal bytes, gapless slots."""

import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from tarnlight.llm import sharding


def check(rows, texts, shards=16):
    by, group, slots = defaultdict(int), defaultdict(set), defaultdict(list)
    assert len(rows) == len(texts)
    for r in rows:
        by[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        group[r["text_crc32"], r["size"]].add(r["shard"])
    want = sorted((d if d is not None else -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"], r["text_crc32"]) for r in rows) == want
    assert all(len(s) == 1 for s in group.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(0 <= s < shards for s in by)
    return by


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = sharding.op8_sharding(spark, sf).collect()
    by = check(rows, texts)
    assert max(by.values()) - min(by.values()) < 0.02 * sum(by.values()) / 16
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("bytes", None)}


def test_odd_rows(spark, docs_of):
    texts = [None, "", "a", "a", "b" * 100_000, *["hot copy" * 20] * 300, (None, "a"), (2, "c")]
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    docs = docs_of(rows).withColumn("size", F.lit("clash")).withColumn("key", F.lit(1)).withColumn("shard", F.lit(2))
    check(sharding.shard(docs).collect(), rows)
    assert sharding.shard(docs.limit(0)).count() == 0


def test_bins_of_many_groups_are_level(spark):
    rows = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.col("id").cast("string"), F.repeat(F.lit("x"), (F.pow(F.rand(3), 4) * 3_000).cast("int"))).alias("text"))
    sums = [r["bytes"] for r in sharding.shard(rows).groupBy("shard").agg(F.sum("size").alias("bytes")).collect()]
    assert len(sums) == 16 and max(sums) - min(sums) < 0.002 * sum(sums) / 16


def brute_best_fit(items, capacity):
    rooms, out = [], {}
    for key, size in sorted(items, key=lambda x: (-x[1], x[0])):
        fits = [(room, i) for i, room in enumerate(rooms) if room >= size]
        if fits:
            at = min(fits)[1]
        else:
            at = len(rooms)
            rooms.append(max(capacity, size))
        rooms[at] -= size
        out[key] = at
    return out


def test_best_fit_against_brute_force():
    import random

    rng = random.Random(9)
    for _ in range(50):
        items = [(f"k{i}", rng.randint(1, 60)) for i in range(rng.randint(0, 120))]
        assert sharding.best_fit_decreasing(items, 50) == brute_best_fit(items, 50)


def test_tree_and_best_fit():
    assert sharding.best_fit_decreasing([("a", 6), ("b", 5), ("c", 4), ("d", 3), ("e", 2)], 10) == {"a": 0, "b": 1, "c": 0, "d": 1, "e": 1}
    tree, live = sharding.Tree(), set()
    import random

    rng = random.Random(5)
    for i in range(2_000):
        if live and rng.random() < 0.45:
            k = rng.choice(sorted(live))
            live.remove(k)
            tree.remove(k)
        else:
            k = (rng.randint(0, 50), i)
            live.add(k)
            tree.add(k)
        size = rng.randint(0, 55)
        assert tree.tightest(size) == min((k for k in live if k[0] >= size), default=None)


def test_fixed_capacity(spark, docs_of):
    texts = [f"{i} " * (i % 40 + 1) for i in range(400)] + ["copy " * 30] * 20 + ["long " * 500]
    rows = sharding.pack_fixed(docs_of(texts), 2_000).collect()
    by, where = defaultdict(int), defaultdict(set)
    for r in rows:
        by[r["shard"]] += r["size"]
        where[r["text_crc32"]].add(r["shard"])
    assert len(rows) == len(texts) and all(len(w) == 1 for w in where.values())
    assert all(v <= 2_000 for s, v in by.items() if v not in (2_501, 151 * 20))
    assert len(by) <= sum(by.values()) / 2_000 * 1.1 + 2
