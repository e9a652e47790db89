"""Training order: a permutation, and shards that give back every text."""

import numpy as np
from pyspark.sql import functions as F

from tarnlight.llm import packing, token_output


def test_permutation():
    for n in (1, 2, 3, 5, 17, 1000, 4097):
        slots = token_output.permuted(np.arange(n), n)
        assert sorted(slots) == list(range(n))
        assert (token_output.permuted(slots, n, back=True) == np.arange(n)).all()
    a, b = (token_output.permuted(np.arange(1000), 1000, key=k) for k in (1, 2))
    assert (a != b).mean() > 0.9 and abs(np.corrcoef(a, np.arange(1000))[0, 1]) < 0.2


def texts_of(index, out, length, shard_rows):
    """The tokens of each document, put together from the shards."""
    total = len(index)
    rows = list(token_output.read(out, 0, total, total, length, shard_rows))
    assert len(rows) == total
    parts = {}
    for r in index:
        ids = rows[r["slot"]][: r["n_tokens"]]
        ends = np.flatnonzero(ids == packing.END)
        at = 0
        for k, doc in enumerate(r["doc_ids"]):
            end = ends[k] + 1 if k < len(ends) else len(ids)
            parts.setdefault(doc, {})[r["first_start"] if k == 0 else 0] = ids[at:end].tolist()
            at = end
        assert at == len(ids)
    return {d: [x for s in sorted(p) for x in p[s]] for d, p in parts.items()}


def test_round_trip(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(5)
    out = f"file://{tmp_path}/shards"
    index = sorted(token_output.materialise(docs, out, length=128, shard_rows=50).collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in index] == list(range(len(index)))
    assert all(r["shard"] == r["slot"] // 50 and r["byte_offset"] == r["slot"] % 50 * 256 for r in index)
    want = {r["doc_id"]: [*packing.encode(r["text"]), packing.END] for r in docs.collect()}
    assert texts_of(index, out, 128, 50) == want
    resumed = list(token_output.read(out, 77, 60, len(index), 128, 50))
    whole = list(token_output.read(out, 0, len(index), len(index), 128, 50))
    assert len(resumed) == 60 and all((a == b).all() for a, b in zip(resumed, whole[77:137], strict=True))


def test_shards_follow_the_input():
    assert token_output.shard_size(0) == token_output.shard_size(8_192 * 65_536) == 8_192
    assert token_output.shard_size(8_192 * 65_536 + 1) == 16_384
    assert -(-5 * 10**10 // token_output.shard_size(5 * 10**10)) <= token_output.MOST_SHARDS


def test_query_keeps_its_shards(spark, sf):
    index = token_output.op5_training_order(spark, sf).orderBy("slot").collect()
    out = index[0]["path"].rsplit("/", 1)[0]
    assert all(r["path"] == f"{out}/{token_output.shard_name(r['shard'])}" for r in index)
    assert len(list(token_output.read(out, 0, len(index), len(index)))) == len(index)


def test_odd_rows(spark, docs_of, tmp_path):
    docs = docs_of([None, "", "a", "word " * 30_000]).withColumn("slot", F.lit("clash")).withColumn("ids", F.lit(1))
    index = token_output.materialise(docs, f"file://{tmp_path}/a", length=64, shard_rows=100).collect()
    got = texts_of(index, f"file://{tmp_path}/a", 64, 100)
    assert got[0] == got[1] == [packing.END] and len(got[3]) == len(packing.encode("word " * 30_000)) + 1
    assert token_output.materialise(docs.limit(0), f"file://{tmp_path}/b").count() == 0
