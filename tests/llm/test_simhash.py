"""Fingerprints and components against brute force."""

import random

import xxhash
from pyspark.sql import functions as F

from tarnlight.llm import simhash
from tests.llm.brute import classes


def plain_fingerprint(text, n=4):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\x09\x0a\x0b\x0c\x0d":
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def expected(rows, n=4, radius=4):
    prints = [plain_fingerprint(t, n) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= radius]
    label = classes(len(rows), links)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[label[i]] = min(d, least.get(label[i], d))
    return sorted(((d, f"{p:016x}", least.get(label[i])) for i, ((d, _), p) in enumerate(zip(rows, prints, strict=True))), key=str)


def test_query_matches_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.op2_simhash(spark, sf).collect()), key=str)
    assert got == expected(rows)


def test_odd_rows(spark, docs_of):
    rng = random.Random(1)
    base = [rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(400)]
    near = [" ".join(base[:k] + ["x"] + base[k + 1 :]) for k in range(0, 400, 20)]
    texts = [None, "", " \t\n\x0b", "one", "One", "a b", "É é", "x\x00y z w", " ".join(base), *near, "one", "word " * 100_000]
    rows = [*enumerate(texts), (3, "one"), (None, "one"), (None, None)]
    docs = docs_of(rows).withColumn("fp", F.lit("clash")).withColumn("k1", F.lit(1)).withColumn("component_id", F.lit(2))
    got = sorted(((r["doc_id"], f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"]) for r in simhash.groups(docs).collect()), key=str)
    assert got == expected(rows)
    assert simhash.groups(docs.limit(0)).count() == 0


def test_hot_prefixes_are_refined(spark, docs_of, monkeypatch):
    monkeypatch.setattr(simhash, "WEIGHT", 2_000)
    rng = random.Random(2)
    base = [str(rng.randint(0, 10**6)) for _ in range(3_000)]
    rows = [(i, " ".join([*base, str(i)])) for i in range(60)] + [(100 + i, " ".join(rng.choice("abc") * 3 for _ in range(9))) for i in range(60)]
    got = sorted(((r["doc_id"], f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"]) for r in simhash.groups(docs_of(rows)).collect()), key=str)
    assert got == expected(rows)
