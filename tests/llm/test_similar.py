"""Near copies at a Jaccard similarity against brute force."""

import random

from pyspark.sql import functions as F

from tarnlight.llm import similar
from tests.llm.brute import classes, shingle_set


def words_of(text):
    return (text or "").encode().lower().split()


def labels_of(texts, similarity=0.8):
    sets = [frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := words_of(t)) else frozenset() for t in texts]
    near = lambda x, y: len(x & y) >= similarity * len(x | y) - 1e-9  # noqa: E731  (two empty sets are near)
    links = [(i, j) for i in range(len(sets)) for j in range(i) if near(sets[i], sets[j]) and bool(sets[i]) == bool(sets[j])]
    return classes(len(texts), links)


def as_partition(keys, groups):
    seen = {}
    return [seen.setdefault(g, k) for k, g in zip(keys, groups, strict=True)]


def check(spark_rows, texts):
    by = {(r["doc_id"]): r["group"] for r in spark_rows}
    n = len(texts)
    assert as_partition(range(n), [by[i] for i in range(n)]) == as_partition(range(n), labels_of(texts))


def made(seed, families, copies, length=120, changes=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6)))
    out = []
    for _ in range(families):
        base = [word() for _ in range(rng.randint(length // 2, length))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, changes)):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w))
    return out


def test_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    assert [r["doc_id"] for r in rows] == list(range(len(rows)))
    check(similar.grouped(spark.read.parquet(f"{sf}/documents.parquet")).collect(), [r["text"] for r in rows])


def test_families_and_crowds(spark, docs_of, monkeypatch):
    texts = made(1, 40, 4) + made(2, 1, 150, length=300, changes=3) + made(3, 60, 1, length=12)
    check(similar.grouped(docs_of(texts)).collect(), texts)
    monkeypatch.setattr(similar, "WEIGHT", 60)
    check(similar.grouped(docs_of(texts)).collect(), texts)


def test_odd_rows(spark, docs_of):
    texts = [None, "", " \n\t", "one", "ONE ", "one two", "long " * 60_000, "long " * 50_000, "É", "é", *made(4, 3, 3)]
    check(similar.grouped(docs_of(texts)).collect(), texts)
    docs = docs_of([*enumerate(texts), (3, "one"), (3, "another text"), (None, "one"), (None, "only here")]).withColumn("k1", F.lit("a")).withColumn("_id", F.lit("b")).withColumn("_own1", F.lit(3))
    kept = similar.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"], r["k1"]) for r in kept.collect()), key=str)
    groups = labels_of([*texts, "another text", "only here"])
    keys = [*range(len(texts)), 3, None]
    want = sorted(((keys[i], [*texts, "another text", "only here"][i], "a") for i in range(len(groups)) if groups[i] == i), key=str)
    assert got == want
    assert similar.keep_one(docs.limit(0)).count() == 0


def test_plan_keeps_recall_and_few_chance_hits():
    for n in (1, 1_000, 10**6, 10**9):
        width, blocks = similar.plan(n, 0.8)
        assert width <= similar.MOST_WIDTH and blocks * width * 8 <= 40_000
        p = similar.flip_rate(0.8)
        meet = sum(similar.math.comb(width, i) * p**i * (1 - p) ** (width - i) for i in range(3))
        assert 1 - (1 - meet) ** blocks >= similar.RECALL


def test_near_pairs_in_a_crowd_of_similar_texts(spark, docs_of):
    """A shared template: all texts have a Jaccard similarity of about 0.75 to each other, and some pairs 0.8 or more."""
    rng = random.Random(7)
    fresh = iter(f"w{i}" for i in range(10**6))
    template = [f"t{i}" for i in range(100)]
    texts = []
    for i in range(600):
        own = [next(fresh) for _ in range(16)]
        texts.append(" ".join(template + own))
        if i % 6 == 0:
            changed = rng.randint(11, 12)
            texts.append(" ".join(template + own[:-changed] + [next(fresh) for _ in range(changed)]))
    rng.shuffle(texts)
    groups = labels_of(texts)
    assert len(set(groups)) == 600
    check(similar.grouped(docs_of([*texts, *made(5, 200, 2)])).filter(F.col("doc_id") < len(texts)).collect(), texts)


def test_candidates_of_a_cloud_follow_its_texts_not_its_pairs(spark, docs_of, monkeypatch):
    """Copies of one text with 0 to 15 of 150 words replaced: some hang together, the others are near many and a copy of none."""
    rng = random.Random(8)
    fresh = iter(f"w{i}" for i in range(10**6))
    base, texts = [f"t{i}" for i in range(150)], []
    for _ in range(1_000):
        w = list(base)
        for i in rng.sample(range(150), rng.randint(0, 15)):
            w[i] = next(fresh)
        texts.append(" ".join(w))
    seen, candidates, prefix_pairs = [], similar.candidates, similar.prefix_pairs

    def counted(make):
        def run(*args, **options):
            out = make(*args, **options)
            seen.append(out.count())
            return out

        return run

    monkeypatch.setattr(similar, "candidates", counted(candidates))
    monkeypatch.setattr(similar, "prefix_pairs", counted(prefix_pairs))
    check(similar.grouped(docs_of(texts)).collect(), texts)
    assert sum(seen) <= 30 * len(texts), seen
