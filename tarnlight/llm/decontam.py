"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Native: only DataFrame functions. An item with ``m`` different five-word shingles is found in a document that has at least
``THRESHOLD`` of them, so such a document lacks at most ``m - need`` and must hold one of the item's ``m - need + 1``
shingles of least hash: that bottom-k MinHash sketch loses no document. Items are partitioned by size (powers of two), and
each partition has a bound, the greatest hash in its sketches, and a least number of shingles that a document must have.
A document is searched in the partitions that it is large enough for. Their bounds all begin at the least hash, so a
shingle is probed once, up to the greatest bound of the document's own partitions. Hits that don't fit their partition's
bound and the item's own need are dropped. Candidates are then verified on the shingles' own text, each document once for
all its items.

Words are runs of letters and digits, lower-cased. Sketches, candidate keys and item shingles are broadcast while they hold
at most ``common.BROADCAST_ROWS`` rows and ``common.BROADCAST_BYTES``; beyond that the joins shuffle.

Defined results: null and empty texts, and items without a word, match nothing. A text of fewer than five words has one
shingle, the whole sequence, so a very short item matches only documents that say just this. Repeated rows of documents or
items give repeated rows. Empty tables give no rows. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlight.llm.common import Scratch, bounded, fresh

SHINGLE, THRESHOLD = 5, 0.8


def words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def shingles(w: Column, what=lambda s: s) -> Column:
    """Shingles of an array of words, each through ``what``; none for no words."""
    n = F.size(w)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - SHINGLE + 1)), lambda i: what(F.concat_ws(" ", F.slice(w, i, SHINGLE)))))


def items_of(benchmark: DataFrame) -> DataFrame:
    """``row, item_id, shingles, n_item, need, part`` of the items that have words."""
    b = benchmark.select(F.monotonically_increasing_id().alias("row"), "item_id", words(F.col("text")).alias("w")).filter("size(w) > 0")
    b = b.select("row", "item_id", F.array_distinct(shingles(F.col("w"))).alias("shingles"))
    n = F.size("shingles")
    return b.withColumn("n_item", n).withColumn("need", F.ceil(F.lit(THRESHOLD) * n - 1e-9).cast("int")).withColumn("part", F.floor(F.log2(n)).cast("int"))


def sketches(items: DataFrame) -> DataFrame:
    """``part, h, row, need``: of each item the ``n_item - need + 1`` shingles of least hash."""
    low = F.slice(F.array_sort(F.transform("shingles", lambda s: F.xxhash64(s))), F.lit(1), F.col("n_item") - F.col("need") + 1)
    return items.select("part", "row", "need", F.explode(low).alias("h"))


def leaks(docs: DataFrame, benchmark: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment for each leak of ``benchmark(item_id, text)`` in ``docs(doc_id, text)``."""
    return keyed_leaks(docs, benchmark, scratch or Scratch(docs.sparkSession, "decontam")).drop("key")


def partitions(sketch: DataFrame) -> list[tuple[int, int, int]]:
    """``(part, bound, least)`` of each partition of sizes: at most 31 rows."""
    return [tuple(r) for r in sketch.groupBy("part").agg(F.max("h"), F.min("need")).orderBy("part").collect()]


def keyed_leaks(docs: DataFrame, benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """``leaks`` with the key of the document's text, which tells rows of one doc_id apart."""
    items = scratch.save(items_of(benchmark), "items")
    sketch = scratch.save(sketches(items), "sketches")
    parts = partitions(sketch)
    own = F.greatest(F.lit(1), F.col("n") - SHINGLE + 1)  # shingles of the document, repeats included
    bound = F.greatest(F.lit(None).cast("long"), F.lit(None).cast("long"), *(F.when(own >= least, F.lit(high)) for _, high, least in parts))
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    split = rows.select("doc_id", "key", words(F.col("text")).alias("w")).withColumn("n", F.size("w")).filter("n > 0").withColumn("bound", bound).filter("bound is not null")
    probes = split.select("doc_id", "key", "n", F.explode(F.filter(shingles(F.col("w"), F.xxhash64), lambda h: h <= F.col("bound"))).alias("h"))
    fits = own >= F.col("need")
    for part, high, least in parts:
        fits = fits & ((F.col("part") != part) | (F.col("h") <= high) & (own >= least))
    found = probes.join(bounded(sketch), "h").filter(fits).select("doc_id", "key", "row").distinct()
    found = scratch.save(found, "candidates")
    asked = found.groupBy(F.col("doc_id").alias("id"), F.col("key").alias("k")).agg(F.collect_list("row").alias("rows"))  # of one document: as many as there are items
    asked = scratch.save(asked, "asked")
    texts = rows.alias("d").join(bounded(asked, 8 * F.size("rows")), F.col("d.doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("k")))
    own = texts.select("doc_id", "key", "rows", words(F.col("text")).alias("w")).select("doc_id", "key", "rows", shingles(F.col("w")).alias("own"))
    own = own.select("doc_id", "key", "own", F.explode("rows").alias("row"))
    shared = own.join(bounded(items, F.octet_length(F.array_join("shingles", " "))), "row").withColumn("n_shared", F.size(F.array_intersect("shingles", "own")))
    return shared.filter("n_shared >= need").select("doc_id", "key", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def clean(docs: DataFrame, benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` without those that hold an item of ``benchmark``. Rows of one doc_id, null too, are judged each by their own text."""
    names = fresh(docs, "_id", "_key")
    bad = keyed_leaks(docs, benchmark, scratch).select(F.col("doc_id").alias(names[0]), F.col("key").alias(names[1])).distinct()
    bad = scratch.save(bad, "leaks")
    return docs.join(bounded(bad), F.col("doc_id").eqNullSafe(F.col(names[0])) & (F.xxhash64("text") == F.col(names[1])), "left_anti")


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


SQL = r"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, [x for x in string_split(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' ') if x <> ''] AS w FROM documents),
iw AS (SELECT row_number() OVER () AS r, item_id, [x for x in string_split(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' ') if x <> ''] AS w FROM benchmark),
ds AS (SELECT DISTINCT r, doc_id, unnest([array_to_string(w[i:i + 4], ' ') for i in range(1, greatest(2, len(w) - 3))]) AS s FROM dw WHERE len(w) > 0),
s AS (SELECT DISTINCT r, item_id, unnest([array_to_string(w[i:i + 4], ' ') for i in range(1, greatest(2, len(w) - 3))]) AS s FROM iw WHERE len(w) > 0),
n AS (SELECT r, count(*) AS n_item FROM s GROUP BY r),
j AS (SELECT ds.r, any_value(ds.doc_id) AS doc_id, s.r AS ir, any_value(s.item_id) AS item_id, count(*) AS n_shared FROM ds JOIN s ON ds.s = s.s GROUP BY ds.r, s.r)
SELECT doc_id, item_id, CAST(n_shared AS INTEGER) AS n_shared, CAST(n_item AS INTEGER) AS n_item, n_shared / CAST(n_item AS DOUBLE) AS containment
FROM j JOIN n ON j.ir = n.r WHERE n_shared >= ceil(0.8 * n_item - 1e-9)
"""
