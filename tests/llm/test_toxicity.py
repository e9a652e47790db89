"""Held-out quality, counterfactual swaps, odd rows."""

import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from tarnlight.llm import toxicity

DATA = "/root/testdata/sf0.1"


def auc(pairs):
    pairs = sorted(pairs)
    ones = sum(y for _, y in pairs)
    rank, i, total = 0, 0, 0.0
    while i < len(pairs):
        j = i
        while j < len(pairs) and pairs[j][0] == pairs[i][0]:
            j += 1
        total += sum(y for _, y in pairs[i:j]) * (rank + (j - i + 1) / 2)
        rank += j - i
        i = j
    return (total - ones * (ones + 1) / 2) / (ones * (len(pairs) - ones))


def test_held_out_quality(spark):
    got = toxicity.op6_toxicity(spark, DATA)
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "toxic")
    rows = got.join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and r["toxic"] is not None]
    hits = sum(r["predicted"] and r["toxic"] for r in held)
    assert auc([(r["score"], r["toxic"]) for r in held]) > 0.95
    assert 2 * hits / (sum(r["predicted"] for r in held) + sum(r["toxic"] for r in held)) > 0.85


def test_penalty_shrinks_the_weight_of_identity(spark):
    bad = [f"you {w} are awful trash number{i}" for i in range(60) for w in ("women",)]
    good = [f"the {w} walk home kindly number{i}" for i in range(60) for w in ("people",)]
    rows = spark.createDataFrame([(t, 1) for t in bad] + [(t, 0) for t in good], "text string, toxic int")
    weight = {p: sum(v for f, v in toxicity.train(rows, penalty=p)[0].items() if f in toxicity.of_word("women")) for p in (0.0, 5.0)}
    assert weight[5.0] < 0.3 * weight[0.0]
    model = toxicity.train(rows, penalty=5.0)
    texts = spark.createDataFrame([(0, "the women walk home"), (1, "the men walk home"), (2, "awful trash")], "doc_id long, text string")
    s = {r["doc_id"]: r["score"] for r in toxicity.score(texts, model).collect()}
    assert abs(s[0] - s[1]) < 0.1 and s[0] < 0.3 < s[2]


def test_swaps():
    kinds = (("women", "men"), ("red", "green", "blue"))
    assert toxicity.swapped({"the", "women", "walk"}, kinds) == ({"the", "women", "walk"}, [{"the", "men", "walk"}])
    before, after = toxicity.swapped({"nobody", "here"}, kinds)
    assert len(before) == 3 and after and all(len(before & a) == 2 for a in after)
    assert toxicity.swapped({"men", "green"}, kinds)[1] == [{"women", "green"}, {"men", "red"}, {"men", "blue"}]
    assert toxicity.swapped({"x"}, ()) == ({"x"}, [])


def test_swaps_act_where_no_text_names_a_group(spark):
    """The labelled texts of the tables name none; the mentions that are added have features there all the same."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.labelled(docs, labels).cache()
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    names = toxicity.choose(toxicity.count_features(rows), n[1], n[0], toxicity.FEATURES)
    swaps = toxicity.changes(got := toxicity.lessons(rows, names))
    assert len(swaps) > 500
    change = {}
    for penalty in (0.0, toxicity.PENALTY):
        w, _ = toxicity.fit(got.column("x").to_pylist(), got.column("y").to_numpy(), swaps, len(names), penalty)
        change[penalty] = sum(abs(w[a].sum() - w[b].sum()) for a, b in swaps) / len(swaps)
    print(f"{len(swaps)} swaps, mean change of the logit {change}")
    assert change[toxicity.PENALTY] < 0.5 * change[0.0]


def plain_score(text, model):
    weights, bias = model
    features = {f for w in toxicity.word_set(text) for f in toxicity.of_word(w)}
    return 1 / (1 + math.exp(-(bias + math.fsum(weights.get(f, 0.0) for f in features))))


def test_scores_against_brute_force(spark, docs_of):
    texts = ["", None, "some Words here", "words words", "unknown only", "ÀÉ words here"]
    model = ({"=words": 1.5, "<wor": -0.25, ">ere": 2.0, "=some": -3.0}, 0.1)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs_of(texts), model).collect()}
    assert all(abs(got[i] - plain_score(t, model)) < 1e-12 for i, t in enumerate(texts))


def test_fit_against_brute_force():
    """The loss at the weights found isn't above that of a slow descent over the dense matrix."""
    rng = np.random.default_rng(2)
    n, width, penalty, l1, l2 = 60, 8, 0.7, 2e-3, 1e-3
    dense = rng.random((n, width)) < 0.4
    y = (dense[:, 0] | (rng.random(n) < 0.2)).astype(float)
    swaps = [([0], [3]), ([1, 2], []), ([4], [5])]
    change = np.array([[sum(1.0 for j in a if j == i) - sum(1.0 for j in b if j == i) for i in range(width)] for a, b in swaps])

    def loss(w, bias):
        z = dense @ w + bias
        return np.mean(np.log1p(np.exp(z)) - y * z) + l2 / 2 * (w @ w) + l1 * np.abs(w).sum() + penalty * np.mean((change @ w) ** 2)

    w, bias = np.zeros(width), 0.0
    for _ in range(20_000):
        p = 1 / (1 + np.exp(-(dense @ w + bias)))
        g = dense.T @ (p - y) / n + l2 * w + 2 * penalty / len(swaps) * change.T @ (change @ w)
        w, bias = w - 0.1 * g, bias - 0.1 * float(np.mean(p - y))
        w = np.sign(w) * np.maximum(np.abs(w) - 0.1 * l1, 0)
    got = toxicity.fit([np.flatnonzero(r).tolist() for r in dense], y, swaps, width, penalty, l1, l2, turns=3_000)
    assert loss(*got) <= loss(w, bias) + 1e-5


def test_odd_rows(spark, docs_of):
    docs = docs_of([None, "", "...", "plain words", "plain words", "awful " * 50_000, (3, "again"), (None, "no id")]).withColumn("score", F.lit("clash")).withColumn("toxic", F.lit(9))
    labels = spark.createDataFrame([(3, 0), (4, None), (5, 1), (None, 1), (0, 0), (2, 2), (7, -1)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    out = toxicity.judge(docs, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == 8
    assert out.filter("score is null or predicted is null or held_out is null").isEmpty()
    none = toxicity.judge(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert toxicity.judge(docs.limit(0), labels).count() == 0
    kept = toxicity.with_score(docs.drop("score"), ({}, 0.0))
    assert kept.columns == [*docs.drop("score").columns, "score"] and kept.count() == 8
