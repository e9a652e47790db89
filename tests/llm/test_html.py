"""Main text of pages: structure, differencing, odd pages."""

import html as html_module
import re

from pyspark.sql import functions as F

from tarnlight.llm import html_extract


def extract(spark, pages):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id long, url string, html string").repartition(2)
    return {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}


def test_query_matches_the_article_of_each_page(spark, sf):
    got = {r["page_id"]: r for r in html_extract.op1_html_extract(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        article = re.search(r"<article>(.*)</article>", p["html"], re.S)[1]
        blocks = re.split(r"</?(?:h1|p)>", article)
        want = [" ".join(html_module.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in blocks]
        assert got[p["page_id"]]["text"] == "\n\n".join(w for w in want if w)
        assert got[p["page_id"]]["n_chars"] == len(got[p["page_id"]]["text"])


def test_marked_article(spark):
    page = """<html><head><title>T</title><script>if (a < b) "</p>"</script></head><body><header>Site</header><nav><ul><li>Menu</ul></nav>
      <div class="ad">Buy</div><main><article><header><h1>Title &amp;  more</h1></header><p>First <b>bold</b>&nbsp;line<br>next</p><p>Second &#233;&lt;x&gt;
      <!-- <p>gone</p> --><aside>Side</aside><form><p>Form</p></form><ul><li>a</li><li>b</li></ul><div class="share-bar">Share</div>
      <section id="comments"><article><p>Reader</p></article></section></article></main><footer>End</footer></body></html>"""
    assert extract(spark, [("http://h/a", page)])[0] == "Title & more\n\nFirst bold line next\n\nSecond é<x>\n\na\n\nb"


def test_pages_without_marks_lose_what_the_nearest_shares(spark):
    page = lambda t: f"<body><div>Our site</div><div>Home | News</div><h1>{t}</h1><p>About {t} only</p><div>Contact us</div></body>"
    got = extract(spark, [("http://h/n/1", page("one")), ("http://h/n/2", page("two")), ("http://other/n/1", page("alone")), ("http://h/n/2", page("two"))])
    assert got[0] == "one\n\nAbout one only"
    assert got[2] == "Our site\n\nHome | News\n\nalone\n\nAbout alone only\n\nContact us"
    assert got[1] == got[3] and "About two only" in got[1]


def test_common_lines_are_a_longest_common_subsequence():
    import random

    def longest(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = random.Random(6)
    for _ in range(300):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 14))] for _ in range(2))
        common = sorted(html_extract.common_lines(a, b))
        assert len(common) == longest(a, b)
        it = iter(b)
        assert all(a[i] in it for i in common)


def test_odd_pages(spark):
    pages = [(None, None), ("", ""), ("no scheme", "<p>x"), ("http://h/1", None), ("http://h/2", "plain text"), ("http://h/3", "<p>" + "word " * 200_000), ("http://h/4", "<<<>>> <p <b>a"), ("http://h/5", "<!-- open"), ("http://h/6", "<script>never closed"), ("http://h/7", "<div " * 2_000)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate([*pages, pages[4]])], "page_id long, url string, html string").withColumn("lines", F.lit("clash")).withColumn("host", F.lit(1))
    got = {r["page_id"]: r for r in html_extract.extract(df).collect()}
    assert len(got) == len(pages) + 1 and all(r["text"] is not None and r["n_chars"] == len(r["text"]) for r in got.values())
    assert got[0]["text"] == got[3]["text"] == "" and got[4]["text"] == "plain text" == got[10]["text"] and got[5]["n_chars"] == 999_999
    assert html_extract.extract(df.limit(0)).count() == 0
    assert html_extract.extract(df.withColumn("page_id", F.lit(None).cast("long"))).count() == len(got)
