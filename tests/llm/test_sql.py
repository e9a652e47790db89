"""Queries that SQL can express, and odd rows, against DuckDB."""

import pytest
from pyspark.sql import functions as F

from tarnlight.llm import decontam, queries, url_filter
from tests.conftest import duck_rows, rows_of


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, sf, name):
    df = queries.queries()[name](spark, sf)
    assert rows_of(df) == duck_rows(queries.oracle_sql()[name], sf, df.columns)


def test_odd_documents_and_items(spark, tmp_path):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    docs = [(0, None), (1, ""), (2, "..."), (3, item), (4, "x " * 50 + item.upper().replace(" ", ", ") + " y" * 50), (5, item[:-3]), (6, item.split()[0]), (7, "solo"), (8, "Solo!"), (8, "Solo!"), (None, item), (9, "x" * 100_000 + " " + item), (10, "alpha beta gamma delta epsilon zeta eta theta iota")]
    items = [(0, item), (1, None), (2, ""), (3, "solo"), (3, "solo"), (4, "one two three four five six"), (None, item)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("h", F.lit(2)).withColumn("_id", F.lit(3))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(7))
    d.write.parquet(f"{tmp_path}/documents.parquet")
    b.write.parquet(f"{tmp_path}/benchmark.parquet")
    df = decontam.op3_decontamination(spark, str(tmp_path))
    want = duck_rows(decontam.SQL, str(tmp_path), df.columns)
    assert len(want) > 10
    assert rows_of(df) == want
    assert rows_of(decontam.leaks(d.repartition(3), b)) == want
    assert decontam.leaks(d.limit(0), b).count() == 0 and decontam.leaks(d, b.limit(0)).count() == 0


def test_odd_urls(spark, tmp_path):
    urls = [None, "", "no scheme", "http://", "://x/y", "HTTP://WWW.Example.COM/en/7?x#y", "http://a.example.com/en/71", "http://example.net/de/8", "http://net/de/8", "http://xnet/de/8", "http://casino-win.example.com/fr/1", "http://spam-farm.org/a.html",
            "http://www.spam-farm.org/a/", "http://spam-farm.org/a", "a://b://c/d", "http://h\n/p\nq", "http://org/es/", "http://x.org/es", "http://x.org?/es/", "http://İ.com/en/", "http://é.org/es/é"]
    df = spark.createDataFrame([*enumerate(urls), (None, urls[5]), (6, urls[6])], "page_id long, url string").withColumn("rule", F.lit("clash")).withColumn("canon", F.lit("c"))
    df.write.parquet(f"{tmp_path}/pages.parquet")
    got = url_filter.op4_url_filter(spark, str(tmp_path))
    assert rows_of(got) == duck_rows(url_filter.SQL, str(tmp_path), got.columns)
    assert url_filter.judge(df.limit(0), df.select("url")).count() == 0
    assert {r["verdict"] for r in url_filter.judge(df, df.select("url").limit(0)).filter("rule is null").collect()} == {"allow"}


def test_large_filters_are_joined(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BROADCAST_BLOCKS", 1)
    pages = spark.range(3_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.test/"), F.col("id")).alias("url"))
    listed = pages.filter("page_id % 3 = 0").select("url")
    assert {r["page_id"] for r in url_filter.judge(pages, listed).filter("verdict = 'block'").collect()} == set(range(0, 3_000, 3))
