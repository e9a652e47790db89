"""Packing: nothing lost, nothing too full, and cheaper than one length alone."""

from collections import defaultdict

from pyspark.sql import functions as F

from tarnlight.llm import packing


def check(rows, tokens):
    bins, pieces = defaultdict(list), defaultdict(int)
    for r in rows:
        bins[r["bin"]].append(r)
        pieces[r["doc_id"]] += r["n_tokens"]
    assert pieces == tokens
    for b in bins.values():
        b.sort(key=lambda r: r["bin_offset"])
        assert len({r["bin_capacity"] for r in b}) == 1 and b[0]["bin_offset"] == 0
        assert all(x["bin_offset"] + x["n_tokens"] == y["bin_offset"] for x, y in zip(b, b[1:], strict=False))
        fill = b[-1]["bin_offset"] + b[-1]["n_tokens"]
        assert b[0]["bin_capacity"] == next(c for c in packing.CAPACITIES if c >= fill)
    return {k: b[0]["bin_capacity"] for k, b in bins.items()}


def test_query(spark, sf):
    tokens = defaultdict(int)
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        tokens[r["doc_id"]] += len(packing.encode(r["text"])) + 1
    bins = check(packing.op7_best_fit_packing(spark, sf).collect(), tokens)
    assert sum(bins.values()) < 1.1 * sum(tokens.values())


def test_odd_rows(spark, docs_of):
    texts = [None, "", "a", "word " * 60_000, "same text", "same text", "x" * 9_000]
    docs = docs_of(texts).withColumn("row", F.lit("clash")).withColumn("bin", F.lit(1)).withColumn("n_tokens", F.lit(0))
    tokens = {i: len(packing.encode(t)) + 1 for i, t in enumerate(texts)}
    check(packing.packed(docs, region=3).collect(), tokens)
    assert packing.packed(docs.limit(0)).count() == 0


def test_best_fit_takes_the_tightest_bin():
    out, fill = packing.best_fit([7, 6, 3, 2, 1], (10,), 10)
    assert [b for b, _ in out] == [0, 1, 0, 1, 1] and fill == [10, 9]


def test_joint_lengths_cost_no_more_than_any_one():
    sizes = sorted([900, 700, 400, 300, 300, 200, 120, 80, 60, 30] * 30, reverse=True)
    cost = lambda final: sum(map(packing.cost, final))
    joint = cost(packing.pack(sizes, (512, 1024, 4096))[1])
    assert all(joint <= cost([c] * len(packing.best_fit(sizes, (c,), c)[1])) for c in (1024, 4096))


def test_long_texts_are_tokenized_like_whole_ones(monkeypatch):
    text = " ".join(f"word{i} l'été, it's 12,5%  \n x" for i in range(300))
    whole = packing.encode(text)
    monkeypatch.setattr(packing, "CHUNK", 97)
    assert packing.encode(text) == whole


def brute(sizes, capacities, opening):
    """Best fit by looking at every bin for every piece."""
    room, fill, touched, out, rest = [], [], [], [], sum(sizes)
    for turn, size in enumerate(sizes):
        fits = [(r, -touched[k], k) for k, r in enumerate(room) if r >= size]
        if fits:
            k = min(fits)[2]  # of equal rooms the bin that was used last
        else:
            able = [c for c in capacities if c >= size]
            c = opening if opening and opening >= size else min(able, key=lambda c: packing.cost(c) / min(c, rest))
            k = len(room)
            room.append(c)
            fill.append(0)
            touched.append(turn)
        touched[k] = turn
        out.append((k, fill[k]))
        room[k] -= size
        fill[k] += size
        rest -= size
    return out, fill, room


def test_best_fit_against_brute_force():
    import random

    rng = random.Random(4)
    for _ in range(60):
        capacities = (16, 40, 100)
        sizes = sorted((rng.randint(1, 100) for _ in range(rng.randint(1, 80))), reverse=True)
        for opening in (None, *capacities):
            out, fill = packing.best_fit(sizes, capacities, opening)
            _, want, _ = brute(sizes, capacities, opening)
            assert sorted(fill) == sorted(want)
            at = {}
            for (k, offset), size in zip(out, sizes, strict=True):
                assert offset == at.get(k, 0)
                at[k] = offset + size
        _, final = packing.pack(sizes, capacities)
        assert sum(map(packing.cost, final)) == min(sum(packing.cost(next(c for c in capacities if c >= f)) for f in brute(sizes, capacities, o)[1]) for o in (None, *capacities))
