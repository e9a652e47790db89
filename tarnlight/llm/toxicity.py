"""Toxicity: a logistic model of words and word ends, with counterfactual regularisation.

Labelled texts that name a group (``IDENTITY``) are copied with the group's term swapped for another of its kind, and the
training loss gains ``PENALTY`` times the squared change of the logit between a text and its copies. A text that names none
gets a mention: a kind picked by a hash of its words, one term added and then swapped. So the features that a term shares
with other words, its beginning and its end, count too: a weight that a term of identity would get from them or from itself
costs more than it explains, and neutral mentions aren't held against a text.

The model is fitted on the driver from at most ``SAMPLE`` labelled rows, taken in order of a hash of the text, and from at
most ``FEATURES`` features: the words, word beginnings and word ends that tell the labels apart best by a chi-square score.
Counts of features, and what each swap changes, are made on the executors. Scoring reads every whole text; a text's score
depends on its set of features alone.

Defined results: null, empty and wordless texts get the score of the intercept. Rows whose label isn't 0 or 1 (null too),
whose doc_id is null, or whose doc_id is held out, teach nothing. Repeated documents and ids are scored row by row; a text
that comes again under one doc_id and label teaches once. Without labelled rows, or with one class only, the score is the smoothed share of toxic rows (0.5 without any). Ties of the
chi-square score go by the feature's text. Empty documents give no rows; extra columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tarnlight.llm.common import Scratch

SAMPLE, FEATURES, PENALTY, THRESHOLD = 20_000, 3_000, 1.0, 0.3
#: Tasks over the sample.
PARTS = 32
#: Terms that may stand for each other, by kind and language.
IDENTITY = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab"), ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives"), ("disabled", "blind", "deaf", "elderly"),
    ("frauen", "männer"), ("juden", "christen", "muslime"), ("ausländer", "flüchtlinge"),
    ("femmes", "hommes"), ("juifs", "chrétiens", "musulmans"), ("étrangers", "réfugiés"),
    ("mujeres", "hombres"), ("judíos", "cristianos", "musulmanes"), ("extranjeros", "refugiados"),
)
_WORD = re.compile(r"\w+")


def of_word(word: str) -> list[str]:
    """A word's features: itself, its beginnings and its ends."""
    out = ["=" + word]
    for n in (3, 4, 5, 6):
        if len(word) > n:
            out += ["<" + word[:n], ">" + word[-n:]]
    return out


def word_set(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def swapped(words: set[str], identity=IDENTITY) -> tuple[set[str], list[set[str]]]:
    """The word set, with a term of identity if it has none, and it with the term swapped, once for each other term of its kind."""
    kinds = [kind for kind in identity if not words.isdisjoint(kind)]
    if not kinds and identity:
        kinds = [identity[zlib.crc32(" ".join(sorted(words)).encode()) % len(identity)]]
        words = words | {kinds[0][0]}
    return words, [words - set(kind) | {other} for kind in kinds for other in kind if other not in words]


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``text, toxic`` of at most ``sample`` rows that may teach, in ``PARTS`` partitions. Rows are chosen by hash before their texts travel."""
    ids = labels.filter("doc_id is not null").filter(F.col("toxic").isin(0, 1)).filter(~held_out()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    ids = ids.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
    docs = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    rows = docs.drop("text").join(F.broadcast(ids), "doc_id").distinct().orderBy("key", "doc_id", "toxic").limit(sample)
    found = docs.join(F.broadcast(rows), ["doc_id", "key"]).repartition(PARTS, "doc_id", "key", "toxic")
    return found.dropDuplicates(["doc_id", "key", "toxic"]).select("text", "toxic")


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def count_features(rows: DataFrame) -> DataFrame:
    """``feature, n1, n0``: toxic and other texts that have it."""

    def run(batches):
        for b in batches:
            n = (Counter(), Counter())
            for text, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                n[y].update({f for w in word_set(text) for f in of_word(w)})
            names = list(n[0].keys() | n[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([n[1][x] for x in names], pa.int64()), pa.array([n[0][x] for x in names], pa.int64())], ["feature", "n1", "n0"])

    return rows.mapInArrow(run, "feature string, n1 long, n0 long").groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def choose(counts: DataFrame, ones: int, zeros: int, features: int) -> list[str]:
    n, a, b = float(ones + zeros), F.col("n1"), F.col("n0")
    chi = n * F.pow(a * zeros - b * ones, F.lit(2)) / (float(ones) * zeros * (a + b) * (n - (a + b) + 1e-9))
    return [r["feature"] for r in counts.filter(a + b >= 4).filter(a + b < n).orderBy(chi.desc(), "feature").limit(features).select("feature").collect()]


def fit(x: list[list[int]], y: np.ndarray, swaps: list[tuple[list[int], list[int]]], width: int, penalty: float = PENALTY, l1: float = 2e-4, l2: float = 1e-4, turns: int = 300) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated proximal gradient. ``swaps``: the features that go and that come with each swap."""

    def sparse(rows):
        return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.array([i for r in rows for i in r], np.int64)

    row, col = sparse(x)
    drow, dcol = sparse([[*a, *b] for a, b in swaps])
    dval = np.array([v for a, b in swaps for v in [1.0] * len(a) + [-1.0] * len(b)])
    n, m, share = len(x), max(1, len(swaps)), float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    w, bias = np.zeros(width), math.log(share / (1 - share))
    v, vb, t = w.copy(), bias, 1.0
    # the largest curvature, by power iteration
    z, top = np.random.default_rng(0).normal(size=width), 1.0
    for _ in range(30):
        z = 0.25 / n * np.bincount(col, np.bincount(row, z[col], n)[row], width) + 2 * penalty / m * np.bincount(dcol, dval * np.bincount(drow, dval * z[dcol], m)[drow], width)
        top = float(np.linalg.norm(z)) or 1.0
        z /= top
    step = 1 / (1.2 * top + 0.5 + l2)
    for _ in range(turns):
        p = 1 / (1 + np.exp(-(np.bincount(row, v[col], n) + vb)))
        g = np.bincount(col, (p - y)[row], width) / n + l2 * v
        if len(dcol):
            g += 2 * penalty / m * np.bincount(dcol, dval * np.bincount(drow, dval * v[dcol], m)[drow], width)
        new, nb = v - step * g, vb - step * float((p - y).mean())
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - bias)
        w, bias, t = new, nb, t2
    return w, bias


def lessons(rows: DataFrame, names: list[str], identity=IDENTITY) -> pa.Table:
    """``y, x, gone, come`` of each of ``rows(text, toxic)``: its features, and those that each swap takes away and brings."""
    index = {f: i for i, f in enumerate(names)}

    def run(batches):
        for b in batches:
            out = []
            ids = lambda s: {index[f] for w in s for f in of_word(w) if f in index}
            for text, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                words = word_set(text)
                before, after = swapped(words, identity)
                old = ids(before)
                pairs = [(sorted(old - new), sorted(new - old)) for new in map(ids, after)]
                out.append((float(y), sorted(ids(words)), [a for a, _ in pairs], [b for _, b in pairs]))
            kinds = (pa.float64(), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32())), pa.list_(pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], ["y", "x", "gone", "come"])

    return rows.mapInArrow(run, "y double, x array<int>, gone array<array<int>>, come array<array<int>>").toArrow()


def train(rows: DataFrame, features: int = FEATURES, penalty: float = PENALTY, identity=IDENTITY) -> tuple[dict[str, float], float]:
    """The model of ``rows(text, toxic)``, which must be bounded: weights by feature, and the intercept."""
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    ones, zeros = n.get(1, 0), n.get(0, 0)
    if not ones or not zeros:
        return {}, math.log((ones + 0.5) / (zeros + 0.5))
    names = choose(count_features(rows), ones, zeros, features)
    got = lessons(rows, names, identity)
    w, bias = fit(got.column("x").to_pylist(), got.column("y").to_numpy(), changes(got), len(names), penalty)
    return {f: float(v) for f, v in zip(names, w, strict=True) if v}, bias


def changes(got: pa.Table) -> list[tuple[list[int], list[int]]]:
    """The swaps of ``lessons`` that change a feature."""
    return [(a, b) for gone, come in zip(got.column("gone").to_pylist(), got.column("come").to_pylist(), strict=True) for a, b in zip(gone, come, strict=True) if a or b]


def with_score(docs: DataFrame, model: tuple[dict[str, float], float], keep: tuple[str, ...] = (), name: str = "score") -> DataFrame:
    """The score as ``name`` and the columns ``keep`` (all without it) of ``docs``; the model is bounded by its number of features."""
    weights, bias = model

    def run(batches):
        known: dict[str, tuple[str, ...]] = {}
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                have: set[str] = set()
                for w in word_set(text):
                    if (f := known.get(w)) is None:
                        if len(known) > 200_000:
                            known.clear()
                        f = known[w] = tuple(x for x in of_word(w) if x in weights)
                    if f:
                        have.update(f)
                z = bias + math.fsum(weights[f] for f in have)
                out.append(1 / (1 + math.exp(-max(-500.0, min(500.0, z)))))
            yield pa.RecordBatch.from_arrays([*(c for c, n in zip(b.columns, b.schema.names, strict=True) if n in names), pa.array(out, pa.float64())], [*names, name])

    names = [c for c in docs.columns if c in keep] if keep else docs.columns
    kinds = StructType([f for f in docs.schema.fields if f.name in names]).add(name, "double")
    return docs.mapInArrow(run, kinds)


def score(docs: DataFrame, model: tuple[dict[str, float], float]) -> DataFrame:
    """``doc_id, score`` of each row of ``docs(doc_id, text)``: the texts don't come back."""
    return with_score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model, ("doc_id",))


def judge(docs: DataFrame, labels: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs(doc_id, text)``, with a model of ``labels(doc_id, toxic)``."""
    scratch = scratch or Scratch(docs.sparkSession, "toxicity")
    model = train(scratch.save(labelled(docs, labels), "labelled"))
    return score(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
