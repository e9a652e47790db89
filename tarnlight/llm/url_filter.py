"""URL filter: rules by host and path, and a list of URLs behind a blocked Bloom filter.

Native: only DataFrame functions. A page's verdict is that of the longest rule that fits; where none fits, a page whose
canonical URL is on the list is blocked and any other allowed. The list is met in two steps: a blocked Bloom filter (one
64-bit block a URL, ``BITS`` bits in it) passes possible hits, and only those are shuffled to an exact join on the
canonical URL, which removes false positives.

Defined results: null URL or no ``://``: empty host and path, no rule, canonical URL null, so allowed. Repeated rows and
ties stay as they are (each row is judged alone; rules of equal length: the first in order). An empty table gives an empty
result; an empty list blocks nothing. Extra columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Verdict and prefix; a rule holds for its host with all subdomains, and for paths that start with its path.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
BITS = 4
#: Listed URLs to a block: 64 bits hold six at about 10 bits each.
PER_BLOCK = 6
#: A filter of at most so many blocks (16 bytes each, 4 MB) is broadcast; a larger one is joined by shuffle.
BROADCAST_BLOCKS = 262_144


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``, or empty."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), r"(?s)^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Host without ``www.`` or ``m.``, path without a last slash or ``.html``; null for an empty host."""
    return F.when(host != "", F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"(\.html|/)$", "")))


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def mask(key: Column) -> Column:
    """``BITS`` bits of a 64-bit word, each from six bits of a second hash."""
    h = F.xxhash64(key, F.lit(7))
    out = F.lit(0).cast("long")
    for i in range(BITS):
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * i).bitwiseAND(63).cast("int")))
    return out


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks).cast("long"))


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """``(block, bits)`` over ``listed(canon)``; partial ORs are made before the shuffle."""
    return listed.groupBy(block_of(F.col("canon"), blocks).alias("block")).agg(F.bit_or(mask(F.col("canon"))).alias("bits"))


def on_list(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """``pages`` (with ``canon``) plus ``listed`` boolean. ``listed``: canonical URLs, any number, repeats allowed."""
    listed = listed.select("canon").filter("canon is not null").distinct()
    blocks = max(1, -(-listed.count() // PER_BLOCK))
    words = bloom(listed, blocks)
    if blocks <= BROADCAST_BLOCKS:
        words = F.broadcast(words)
    tested = pages.withColumn("block", block_of(F.col("canon"), blocks)).join(words, "block", "left").withColumn("maybe", F.coalesce(F.col("bits").bitwiseAND(mask(F.col("canon"))) == mask(F.col("canon")), F.lit(False))).drop("block", "bits")
    hits = tested.filter("maybe").drop("maybe").join(listed.withColumn("listed", F.lit(True)), "canon", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    return hits.unionByName(tested.filter("not maybe").drop("maybe").withColumn("listed", F.lit(False)))


def judge(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """One row per row of ``pages(page_id, url)``: page_id, host, path, rule, verdict, listed. ``listed(url)``: URLs to block."""
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    split = split.select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    split = split.withColumn("canon", canonical(F.col("host"), F.col("path")))
    keys = listed.select(canonical(host_of(F.col("url")), path_of(F.col("url"))).alias("canon"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    return on_list(split, keys).select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


#: Names of hosts under which every URL counts as listed, for the registered query: the tables have no list of their own.
LISTED_HOSTS = r"(^|\.)(casino-win|ads-track|free-bets|spam-farm|cheap-pills|adult-x)\."


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, pages.filter(host_of(F.col("url")).rlike(LISTED_HOSTS)).select("url"))


SQL = r"""
WITH s AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s),
c AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(\.html|/)$', '') END AS canon FROM p),
l AS (SELECT DISTINCT canon FROM c WHERE regexp_matches(host, '(^|\.)(casino-win|ads-track|free-bets|spam-farm|cheap-pills|adult-x)\.')),
r(what, rule, name, start) AS (VALUES ('block', 'com/en/', 'com', '/en/'), ('allow', 'example.com/en/7', 'example.com', '/en/7'),
  ('allow', 'net/de/', 'net', '/de/'), ('block', 'example.net/de/8', 'example.net', '/de/8'), ('block', 'org/es/', 'org', '/es/')),
j AS (SELECT page_id, host, path, canon,
  (SELECT max_by(rule, length(rule)) FROM r WHERE (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start)) AS rule FROM c)
SELECT page_id, host, path, j.rule AS rule,
  coalesce((SELECT max(what) FROM r WHERE r.rule = j.rule), CASE WHEN canon IN (SELECT canon FROM l WHERE canon IS NOT NULL) THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(canon IN (SELECT canon FROM l WHERE canon IS NOT NULL), false) AS listed
FROM j
"""
