"""Links and components of embeddings against brute force."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tarnlight.llm import embed_dedup
from tests.llm.brute import classes


def expected(rows, threshold=0.93):
    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, np.float64)
        return v / np.sqrt((v * v).sum())

    units = [unit(v) if y is not None and i is not None else None for i, v, y in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and float(units[i] @ units[j]) >= threshold]
    count = [0] * len(rows)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    label = classes(len(rows), links)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[label[i]] = min(r[0], least.get(label[i], r[0]))
    return links, [(r[0], count[i], least.get(label[i])) for i, r in enumerate(rows)]


def test_recall_on_the_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = {r["vec_id"]: r for r in embed_dedup.op9_embedding_dedup(spark, sf).collect()}
    links, want = expected(rows)
    found = sum(got[i]["n_links"] for i, _, _ in want)
    assert found <= 2 * len(links) and found >= 0.9 * 2 * len(links)
    assert all(got[i]["n_links"] <= n for i, n, _ in want)
    assert sum(got[i]["component_id"] == c for i, _, c in want) >= 0.95 * len(want)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def made(n, seed, spread=0.12, width=16, labels=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        c = random.Random(i % 7)
        out.append((i, [c.gauss(0, 1) + spread * rng.gauss(0, 1) for _ in range(width)], i % labels))
    return out


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(0, None, 1), (1, [], 1), (2, [0.0, 0.0, 0.0], 1), (3, [1.0, None, 2.0], 1), (4, [1.0, float("nan"), 2.0], 1), (5, [1.0, float("inf"), 2.0], 1), (6, v, None), (7, v, 1), (8, v, 1), (8, v, 1),
            (9, v, 2), (10, [2.0, 4.0, 6.0], 1), (11, [1.0, 2.0], 1), (12, [-1.0, -2.0, -3.0], 1), (None, v, 1), (13, [1e30, 2e30, 3e30], 1), (14, [1e-30, 2e-30, 3e-30], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("vector", F.lit("clash")).withColumn("r", F.lit(5))
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in embed_dedup.near(df).collect()), key=str)
    assert got == sorted(expected(rows)[1], key=str)
    assert embed_dedup.near(df.limit(0)).count() == 0


def test_one_direction_is_split(spark):
    """More vectors along one line than a cell holds: their projections tie at every level."""
    rows = [(i, [float(i + 1), 2.0 * (i + 1), -(i + 1.0)], 1) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = embed_dedup.near(df, cell=12, trees=2).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(119, 0)}


def test_recall_on_planted_pairs(spark):
    """Pairs just above the threshold among many others, in labels with several times the vectors of a cell."""
    rng, rows = np.random.default_rng(3), []
    for i in range(1_500):
        v = rng.normal(size=24)
        v /= np.linalg.norm(v)
        rows.append((len(rows), v.tolist(), i % 2))
        if i % 3 == 0:
            w = rng.normal(size=24)
            w -= (w @ v) * v
            cosine = rng.uniform(0.931, 0.96)
            rows.append((len(rows), (cosine * v + np.sqrt(1 - cosine * cosine) * w / np.linalg.norm(w)).tolist(), i % 2))
    got = {r["vec_id"]: r for r in embed_dedup.near(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), cell=200).collect()}
    links, want = expected(rows)
    assert len(links) >= 500
    found = sum(got[i]["n_links"] for i, _, _ in want)
    assert 0.9 * 2 * len(links) <= found <= 2 * len(links)
    assert all(got[i]["n_links"] <= n for i, n, _ in want)


def test_large_components_are_counted_in_blocks(spark):
    rows = made(600, 4)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embed_dedup.near(df, cell=40, block=16).collect())
    links, want = expected(rows)
    assert sum(r[1] for r in got) >= 0.97 * 2 * len(links)
    assert sum(g[2] == w[2] for g, w in zip(got, sorted(want), strict=True)) >= 0.97 * len(want)
