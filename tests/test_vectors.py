"""Vector search over many queries, against a plain search."""

from tarnlight.operators import vectors


def test_more_queries_than_a_block(spark):
    of = lambda i: [float((i * k) % 17) for k in (3, 5, 7)]
    v = spark.createDataFrame([(i, of(i)) for i in range(40)], "vec_id long, vector array<double>")
    asked = spark.createDataFrame([(i, of(i)) for i in range(1_201)], "query_id long, q array<double>")
    got = {}
    for r in vectors.top_k(v, asked, "vec_id", 3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert got.keys() == set(range(1_201))
    for i, rows in got.items():
        best = sorted((-sum(a * b for a, b in zip(of(i), of(j), strict=True)), j) for j in range(40))[:3]
        assert sorted(rows) == [(k + 1, j, -s) for k, (s, j) in enumerate(best)]
