"""Main text of HTML pages: structure first, then nearest-URL page differencing.

A page is read once into lines (blocks of text) with their zone. Scripts, styles, menus, page headers, footers, sidebars,
notices, adverts, forms and comments are known by element, role or class and left out. Where the page marks its article
(``article``, ``main`` or ``role=main``), the marked lines are the text. Else the page is compared with its neighbours: all
pages of a host are ordered by path, the lines of a page are aligned with those of the page before and after it by longest
common subsequence, and lines shared with the nearer of the two (by common path) are deleted as the site's template.

Differencing isn't applied within a marked article, since it would delete what two copies of one article share; so only
hashes of lines travel for pages that are marked, and their texts are never shuffled. Ranges of the order are cut by size,
not by host, so that a host with a third of all pages is spread over many tasks; a range's first and last page are joined
to their neighbours across the cut.

Defined results: null or empty html gives empty text. A null url or one without ``://`` belongs to the host "" with the path
"". Repeated rows are separate pages (and, if unmarked, neighbours that delete each other's shared lines; a page whose
every line is shared with the neighbour is kept whole, being a copy). Ties of the path go by page_id, then by reading order.
A page alone on its host is kept whole. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnlight.llm.common import Scratch, bounded
from tarnlight.llm.url_filter import host_of, path_of

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))|([^\s=/>"']+)""")
RAW = {"script", "style", "title", "textarea", "xmp", "noembed", "noframes"}
LEFT_OUT = {"nav", "footer", "aside", "form", "noscript", "template", "iframe", "svg", "math", "select", "button", "object", "canvas", "audio", "video", "dialog", "menu", "head", "fieldset", "datalist", "map"}
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup p pre section summary table tbody tfoot thead tr ul".split())
SPACES = {"br", "td", "th", "wbr", "img", "input"}
VOID = {"br", "wbr", "img", "input", "hr", "meta", "link", "source", "track", "area", "base", "col", "embed", "param"}
HINTS = set("ad ads adv advert adverts advertisement advertisements advertising adsense adslot banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login masthead menu menus modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion recommended related respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split())
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
NEVER_HINTED = {"html", "body", "main"}
SPLIT = re.compile(r"[^a-z0-9]+")


def attributes(text: str) -> dict[str, str]:
    return {(m[1] or m[5]).lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)} if text.strip() else {}


def unwanted(tag: str, text: str, in_article: bool) -> bool:
    """Whether an element begins a zone that is left out."""
    if tag in LEFT_OUT or tag == "header" and not in_article:
        return True
    if tag in NEVER_HINTED or not text.strip(" /"):
        return False
    a = attributes(text)
    if a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", a.get("style", ""), re.I):
        return True
    return not HINTS.isdisjoint(SPLIT.split(f"{a.get('class', '')} {a.get('id', '')}".lower()))


def lines_of(page: str | None) -> tuple[list[str], bool]:
    """The wanted lines of a page in order, and whether they are those of a marked article."""
    page = page or ""
    body: list[str] = []
    marked: list[str] = []
    held: list[str] = []
    article: list[str] = []  # open article and main elements
    zone, depth, had, at = "", 0, False, 0

    def flush():
        if held:
            if line := " ".join("".join(held).split()):
                (marked if article else body).append(line)
            held.clear()

    while at < len(page):
        m = TOKEN.search(page, at)
        if not zone and (end := m.start() if m else len(page)) > at:
            held.append(html.unescape(page[at:end]))
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attrs = bool(m[1] or m[4]), m[3] or m[6] or ""
        if closing:
            if zone:
                if tag == zone:
                    depth -= 1
                    zone = zone if depth else ""
                elif tag in ("body", "html") or tag in article:
                    zone = ""
            if not zone or tag in article:
                if tag in BLOCKS:
                    flush()
                elif tag in SPACES:
                    held.append(" ")
                if tag in article:
                    zone = ""
                    del article[len(article) - 1 - article[::-1].index(tag) :]
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else len(page)
            continue
        if tag == "plaintext":
            break
        if zone == "p" and tag in BLOCKS:
            zone = ""
        if zone == "head" and tag == "body":
            zone = ""
        if zone:
            depth += tag == zone and tag not in VOID
            continue
        if tag in BLOCKS:
            flush()
        elif tag in SPACES:
            held.append(" ")
        main = tag in ("article", "main") or "role" in attrs and attributes(attrs).get("role", "").lower() in ("main", "article")
        if tag == "article" and "article" in article or unwanted(tag, attrs, bool(article)):  # an article in an article is a comment
            if tag not in VOID:
                zone, depth = tag, 1
        elif main:
            article.append(tag)
            had = True
    flush()
    return (marked, True) if had and marked else (body, False)


def common_lines(a: list[int], b: list[int]) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b``."""
    lead = 0
    while lead < min(len(a), len(b)) and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < min(len(a), len(b)) - lead and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = set(range(lead)) | set(range(len(a) - tail, len(a)))
    where: dict[int, list[int]] = {}
    for j in range(lead, len(b) - tail):
        where.setdefault(b[j], []).append(j)
    ends: list[int] = []
    chains: list[tuple] = []
    for i in range(lead, len(a) - tail):
        for j in reversed(where.get(a[i], ())):
            k = bisect_left(ends, j)
            link = (i, chains[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chains.append(link)
            else:
                ends[k], chains[k] = j, link
    link = chains[-1] if chains else None
    while link:
        out.add(link[0])
        link = link[1]
    return out


def nearness(a: str, b: str) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def parsed(pages: DataFrame) -> DataFrame:
    """``page_id, url, host, path, lines, marked, hashes`` of each page."""

    def run(batches):
        for b in batches:
            got = [lines_of(x) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array([x for x, _ in got], pa.list_(pa.string())), pa.array([m for _, m in got], pa.bool_()), pa.array([[xxhash.xxh3_64_intdigest(line) - (1 << 63) for line in x] for x, _ in got], pa.list_(pa.int64()))],
                ["page_id", "url", "lines", "marked", "hashes"],
            )

    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    rows = rows.mapInArrow(run, f"page_id {kind}, url string, lines array<string>, marked boolean, hashes array<long>")
    return rows.withColumn("host", F.coalesce(host_of(F.col("url")), F.lit(""))).withColumn("path", F.coalesce(path_of(F.col("url")), F.lit("")))


def neighbours(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows`` in the order of host and path, each with ``before`` and ``after``: structs of host, path and hashes, or null."""
    ordered = rows.repartitionByRange("host", "path", "page_id", "uid").sortWithinPartitions("host", "path", "page_id", "uid")
    ordered = scratch.save(ordered.withColumn("range", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), "ordered")
    own = F.struct("host", "path", "hashes")
    edges = ordered.groupBy("range").agg(F.min_by(own, "place").alias("first"), F.max_by(own, "place").alias("last"))
    w = Window.orderBy("range")  # one row a range
    edges = edges.select("range", F.lag("last").over(w).alias("_before"), F.lead("first").over(w).alias("_after"))
    w = Window.partitionBy("range").orderBy("place")
    out = ordered.withColumn("before", F.lag(own).over(w)).withColumn("after", F.lead(own).over(w)).join(bounded(edges, 8 * (F.size("_before.hashes") + F.size("_after.hashes"))), "range")
    near = lambda name: F.coalesce(name, F.col("_" + name))
    keep = lambda c: F.when(c["host"] == F.col("host"), c)
    return out.select("page_id", "url", "uid", "path", "hashes", "lines", "marked", keep(near("before")).alias("before"), keep(near("after")).alias("after"))


def different(rows: DataFrame) -> DataFrame:
    """``page_id, url, text`` of pages with neighbours, without the lines they share with the nearer one."""

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                others = [x for x in (r["before"], r["after"]) if x]
                kept = r["lines"]
                if others:
                    other = max(others, key=lambda x: nearness(x["path"], r["path"]))
                    shared = common_lines(r["hashes"], other["hashes"])
                    if len(shared) < len(kept):
                        kept = [x for i, x in enumerate(kept) if i not in shared]
                out.append("\n\n".join(kept))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.select("page_id", "url", "path", "hashes", "lines", "before", "after").mapInArrow(run, f"page_id {kind}, url string, text string")


def extract(pages: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages(page_id, url, html)``."""
    scratch = scratch or Scratch(pages.sparkSession, "html")
    rows = scratch.save(parsed(pages).withColumn("uid", F.monotonically_increasing_id()), "lines")
    out = rows.filter("marked").select("page_id", "url", F.array_join("lines", "\n\n").alias("text"))
    if not rows.filter("not marked").isEmpty():
        thin = rows.withColumn("lines", F.when(~F.col("marked"), F.col("lines")))  # texts of marked pages stay where they are
        out = out.unionByName(different(neighbours(thin, scratch).filter("not marked")))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op1_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
