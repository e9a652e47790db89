"""Removal of repeated 200-byte strings against brute force."""

import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from tarnlight.llm import suffix_dedup


def left_of(texts, size=200):
    """What is left of each text, bytes removed, runs removed."""
    seen = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        out.append((bytes(b for b, g in zip(t, gone, strict=True) if not g), sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))))
    return out


def expected(rows):
    texts = [(t or "").encode() for _, t in rows]
    return sorted(((d, len(t), removed, runs, hashlib.sha256(left).hexdigest()) for (d, _), t, (left, removed, runs) in zip(rows, texts, left_of(texts), strict=True)), key=str)


def got(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()), key=str)


def test_query_matches_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(suffix_dedup.op10_suffix_dedup(spark, sf)) == expected(rows)


def odd_rows():
    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(n))
    p, q = words(80), words(60)
    texts = [None, "", "short", "z" * 199, "y" * 200, "x" * 201, "ab" * 300, words(300), words(40) + p + words(30), p, words(9) + p[:230] + words(9), q + words(20) + q, words(500) + p[13:] + q[5:],
             words(100), "é" * 150, "é" * 150, "-" * 100 + p[:150], "-" * 100 + p[:120] + "!" + p[121:]]
    texts += [p + str(i) for i in range(30)] + [str(i) + q for i in range(30)] + [words(5) + q[7:260] + words(3) for _ in range(20)]
    return [*enumerate(texts), (7, texts[7]), (7, "other text"), (None, "y" * 200), (None, None)]


def test_odd_rows(spark, docs_of):
    rows = odd_rows()
    docs = docs_of(rows).withColumn("k1", F.lit("clash")).withColumn("spans", F.lit(0))
    assert got(suffix_dedup.remove(docs)) == expected(rows)
    assert suffix_dedup.remove(docs.limit(0)).count() == 0


def test_crowds_and_tiles(spark, docs_of, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWD", 3)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 4)
    monkeypatch.setattr(suffix_dedup, "TILE", 700)
    rows = odd_rows()
    assert got(suffix_dedup.remove(docs_of(rows))) == expected(rows)


def test_texts_are_kept_whole_but_for_repeats(spark, docs_of):
    rows = odd_rows()
    left = {(r["doc_id"], hashlib.sha256(r["kept"]).hexdigest()) for r in suffix_dedup.remove(docs_of(rows), texts=True).collect()}
    assert left == {(r[0], r[4]) for r in expected(rows)}
