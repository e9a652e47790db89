"""Scans of whole texts in Python: the same chunks, terms, scores and ranks as the columns and joins give, in bounded shuffles."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnlight.functions import lexis, porter, values
from tarnlight.functions import text as T
from tarnlight.operators import evidence, scan, search, vectors

ODD = ["", " ", "a", "ab ", "\x1c x\x1d\x1ey ", "Σίσυφος ΟΔΟΣ Σ'α", "İstanbul ılık", "été naïve", "x́ltd", "-_a-b_ __c--d a_ _ -", "日本語 テキスト", "ÅÄÖ ß ﬁ ǅ ½ ²", "क्षत्रिय हिन्दी", "​  z　q", "x", "of-the la-la la", None]


def texts(spark, rows):
    return spark.createDataFrame([(f"{i}.txt", t) for i, t in enumerate(rows)], "rel string, text string")


def test_strings_are_cut_as_columns_are(spark):
    rng = random.Random(1)
    alphabet = "abcde ABCÉéßøñ-_.,0 9\n\t́İΣ½"
    rows = ODD + ["".join(rng.choices(alphabet, k=rng.randrange(4_000))) for _ in range(60)]
    df = texts(spark, rows)
    chunks = {(r["rel"], r["chunk_index"]): r["text"] for r in T.with_chunks(df).collect()}
    assert chunks == {(f"{i}.txt", k): c for i, t in enumerate(rows) for k, c in enumerate(lexis.windows(t))}
    for r in df.filter("text is not null").select("text", T.index_terms(F.col("text")).alias("terms"), T.tokens(F.col("text")).alias("tokens")).collect():
        assert lexis.index_terms(r["text"]) == r["terms"] and lexis.tokens(r["text"]) == r["tokens"], repr(r["text"])


def test_every_character_is_cut_as_columns_cut_it(spark):
    """All that the JVM's tables know: points assigned later are no letters there."""
    points = spark.range(0x110000).filter("id < 55296 or id > 57343").select("id", F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    points = points.filter(~F.col("c").rlike(r"^\p{Cn}$"))
    got = points.select("c", F.concat_ws("|", T.index_terms(F.concat(F.lit("a"), "c", F.lit("b")))).alias("terms"), F.concat_ws("|", T.tokens(F.concat(F.lit("ab"), "c", F.lit("cd")))).alias("tokens")).toArrow().to_pydict()
    assert len(got["c"]) > 250_000
    for c, terms, tokens in zip(*got.values(), strict=True):
        assert "|".join(lexis.index_terms(f"a{c}b")) == terms and "|".join(lexis.tokens(f"ab{c}cd")) == tokens, hex(ord(c))


@pytest.mark.parametrize("stemmed", [False, True])
def test_top_is_the_ranking_of_all_scores(spark, monkeypatch, stemmed):
    """With phrases, words said twice, many equal texts; a few chunks, queries and pairs at a time."""
    rng = random.Random(2)
    words = "the of la term terms relational relate hopping hoped été ete x1 of-the la-la".split()
    rows = [" ".join(rng.choices(words, k=rng.randrange(1, 30))) for _ in range(300)] + ["the terms of la"] * 80
    df = texts(spark, rows).repartition(3)
    asked = spark.createDataFrame([(i, q) for i, q in enumerate(["the of-the terms terms", "la-la", "relate hoping", "nothing", "the of la term x1 ete"])], "query_id long, query string")
    for name, value in (("CHUNKS", 16), ("BLOCK", 2), ("CELLS", 50), ("KNOWN", 5), ("TEXTS", 7)):
        monkeypatch.setattr(scan, name, value)
    want = search.ranked(search.bm25(search.space(search.admitted(df), stemmed), asked), 9).collect()
    got = search.top(df, asked, 9, stemmed).collect()
    key = lambda r: (r["query_id"], r["rank"], r["rel"], r["chunk_index"], round(r["score"], 9))
    assert sorted(map(key, got)) == sorted(map(key, want)) and len(got) > 20


def test_only_the_best_of_a_split_travel(spark, monkeypatch):
    df = texts(spark, ["alpha beta gamma"] * 900 + ["alpha beta 12"] * 900).coalesce(1)
    asked = spark.createDataFrame([(0, "alpha beta")], "query_id long, query string")
    found = scan.best(df, [(search.query_units(asked), False)], 10, flagged=True)
    assert found.count() <= 2 * 10 + 25
    best = search.ranked(found, 10, True).orderBy("rank").collect()
    assert [r["has_value"] for r in best] == [True] * 10 and best[0]["rel"] == "1000.txt"


def test_filters_keep_the_statistics(spark):
    df = texts(spark, [f"alpha w{i}" for i in range(30)] + ["beta"] * 5)
    asked = spark.createDataFrame([(0, "alpha w3 beta")], "query_id int, query string")
    every = {r["rel"]: r["score"] for r in search.top(df, asked, 99).collect()}
    assert {r["rel"]: r["score"] for r in search.top(df, asked, 99, folder="3.TXT").collect()} == {k: v for k, v in every.items() if k.endswith("3.txt")}


def test_vocabulary_in_parts(spark, monkeypatch):
    monkeypatch.setattr(scan, "KNOWN", 3)
    monkeypatch.setattr(scan, "CHUNKS", 2)
    got = {r["term"]: (r["df"], r["cf"]) for r in scan.vocabulary(texts(spark, ["aa bb aa", "bb cc dd ee", "aa ff", None, "gg aa bb"])).collect()}
    assert got == {"aa": (3, 4), "bb": (3, 3), "cc": (1, 1), "dd": (1, 1), "ee": (1, 1), "ff": (1, 1), "gg": (1, 1)}


def test_values_are_found_as_without_shortcuts():
    some = ["as the Vendor", "Acme Ltd, as the Vendor", "(the Vendor)", 'Acme Corp (the "Vendor")', "x_ltd as the y", "Acme-Ltd as the y", "a@b.cd", "no at all", "٣ days", "clause 4", "Big Co. as the Buyer", "x́Ltd as the Vendor", "Vendor: Acme Ltd"]
    for t in some:
        slow = any(values.name_before(t, m.start(), "(" in m[0]) for m in values.ROLE.finditer(t))
        assert values.has_apposition(t) == slow, t
    assert [values.first_value(t) is not None for t in some[6:10]] == [True, False, True, False]


def test_stems_of_words_that_no_step_changes():
    assert [porter.stem(w, False) for w in ("thention", "blerest", "hopping", "ponies", "syzygy", "controll", "abc", "relational")] == ["thention", "blerest", "hop", "poni", "syzygi", "control", "abc", "relat"]


def test_a_phrase_is_a_run_of_words(spark):
    t = spark.createDataFrame([("a", ["xx", "the", "of"]), ("b", ["the", "xx", "of"]), ("c", ["bathe", "of"]), ("d", [])], "rel string, stems array<string>")
    a = spark.createDataFrame([(0, "p", ["the", "of"]), (1, "q", []), (2, "r", ["xx"])], "group_id int, phrase string, stems array<string>")
    assert {tuple(r) for r in evidence.said_in(t, a).collect()} == {("a", 0), ("a", 2), ("b", 2)}
    plan = evidence.said_in(t, a)._jdf.queryExecution().optimizedPlan().toString()
    assert "exists(" not in plan.lower()


def test_batches_of_vectors_are_single_vectors(spark):
    from tarnlight.functions import embed

    some = ["The cap, the cap of 4-5 x_y", "", "éa b c  dd", None]
    got = embed.embedded.func(pa.array(some)).to_pylist()
    assert got[3] is None and [v for v in got if v] == [embed.embed(t) for t in some if t is not None]
    assert embed.words("a-b  cc _d-e f") == ["a-b", "cc", "d-e"] and embed.grams("abcdefgh") == ["abcde", "defgh"]
    assert embed.embed("the cap") == embed.embed("THE CAP") and abs(sum(x * x for x in got[0]) - 1) < 1e-4


def test_semantic_search_embeds_what_it_can_find(spark):
    df = texts(spark, ["liability cap here and more", "nothing of the kind", "the cap"])
    whole, some = (vectors.build(df, **k) for k in ({}, {"saying": "liability cap"}))
    assert some.count() == 2 and whole.count() == 3
    assert vectors.semantic_search(some, "liability cap").collect() == vectors.semantic_search(whole, "liability cap").collect()


def test_vectors_of_all_kinds_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 3)
    monkeypatch.setattr(vectors, "ROWS", 11)
    rng = random.Random(3)
    rows = [(i, [rng.choice([0.1, 0.3, -0.7, 1.1]) for _ in range(4)]) for i in range(90)]
    rows += [(100 + i, [0.1, 0.2, 0.3, 0.4]) for i in range(40)] + [(200, None), (201, [9.0]), (202, [1.0, None, 1.0, 1.0]), (203, []), (204, [1e3, 1e3, 1e3, 1e3, 1e3])]
    v = spark.createDataFrame(rows, "vec_id long, vector array<double>").repartition(2)
    asked = spark.createDataFrame([(i, x) for i, x in rows[::13]] + [(500, [2.0]), (501, None)], "query_id long, q array<double>")
    joined = v.crossJoin(F.broadcast(asked)).select("query_id", "vec_id", vectors.E.dot(F.col("q"), F.col("vector")).alias("score"))
    best = {}
    for q, i, s in joined.collect():
        best.setdefault(q, []).append((s is None, -(s or 0), i, s))
    want = {(q, i, s, k + 1) for q, found in best.items() for k, (_, _, i, s) in enumerate(sorted(found)[:5])}
    assert {tuple(r) for r in vectors.top_k(v, asked, "vec_id", 5).collect()} == want


def test_cache_score_of_two_texts_of_one_path(spark):
    df = spark.createDataFrame([("a/cap.txt", "cap cap"), ("a/cap.txt", "caps liability cap"), ("b.txt", None)], "rel string, text string")
    assert sorted(r["score"] for r in search.cache_score(df, "liability cap").collect()) == [3 + 3 + 10 + 40, 20 + 3 + 3 + 10 + 40]


def test_pools_by_stem_are_scanned(spark, sf):
    """Both queries that take their pool by ``stem_queries.pool`` rank it without joining words with queries."""
    from tarnlight.plans import stem_queries

    asked = stem_queries.asked(spark, sf)[0]
    plan = stem_queries.pool(spark, sf, asked, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan
