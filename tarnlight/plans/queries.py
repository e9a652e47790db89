"""The registered queries over the driver's tables, each beside the SQL that tells the same rows, where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlight.functions import embed, facts, porter, values
from tarnlight.functions import text as T
from tarnlight.operators import evidence, inventory, reports, scan, search, vectors
from tarnlight.sources import corpus

QUERY, PHRASE_QUERY = "ered thention blerest oningen", "of-the erblest thention"
ALIASES = {"the of": ["by with", "erwhtion"], "queeux": ["éaux", "les des"], "in nicht": ["schst"]}
queries: dict = {}
sql: dict[str, str] = {}


def registered(oracle: str | None = None):
    def add(f):
        queries[f.__name__] = f
        if oracle:
            sql[f.__name__] = oracle
        return f

    return add


# ---- parts of SQL

REL = "coalesce(source, '_') || '/' || coalesce(lang, '_') || '/doc_' || coalesce(CAST(doc_id AS VARCHAR), '_') || '.txt'"
DOCS = f"docs AS (SELECT {REL} AS rel, doc_id, text FROM documents)"
SPACE = r"[\t\n\x0b\f\r\x{85}\p{Z}]+"
FLAT = f"trim(regexp_replace(text, '{SPACE}', ' ', 'g'))"
WORDS = r"[lower(x) for x in regexp_extract_all({}, '[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}_\-]*') if length(x) >= 2]"
TERMS = r"[strip_accents(lower(x)) for x in regexp_extract_all({}, '[\p{{L}}\p{{N}}\p{{M}}\p{{Co}}]+')]"
STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
INVENTORY = f"""{DOCS}, inv AS (SELECT rel, strlen(coalesce(text, '')) AS size, sha1(coalesce(text, '')) AS sha1, '.txt' AS ext, regexp_replace(rel, '/[^/]*$', '') AS folder, split_part(rel, '/', 1) AS top_folder FROM docs)"""
CHUNKS = f"""{DOCS}, flat AS (SELECT rel, {FLAT} AS whole FROM docs WHERE text IS NOT NULL), sized AS (SELECT *, length(whole) AS n, CASE WHEN length(whole) <= 1800 THEN 1 ELSE CAST(ceil((length(whole) - 1800) / 1550.0) AS INTEGER) + 1 END AS n_chunks FROM flat WHERE length(whole) > 0),
windows AS (SELECT rel, whole, n, n_chunks, CAST(unnest(range(n_chunks)) AS INTEGER) AS chunk_index FROM sized),
every AS (SELECT rel, chunk_index, chunk_index * 1550 AS start_offset, CAST(least(chunk_index * 1550 + 1800, n) AS INTEGER) AS end_offset, n_chunks, substr(whole, chunk_index * 1550 + 1, 1800) AS text FROM windows),
chunks AS (SELECT * FROM every WHERE length(trim(text)) >= 3)"""
SCORED = f"""{CHUNKS}, lists AS (SELECT rel, chunk_index, {TERMS.format("text")} AS ts FROM chunks), lens AS (SELECT rel, chunk_index, len(ts) AS dl FROM lists), words AS (SELECT rel, chunk_index, generate_subscripts(ts, 1) - 1 AS pos, unnest(ts) AS term FROM lists),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
qw AS (SELECT query_id, {WORDS.format("query")} AS ws FROM queries), qu AS (SELECT query_id, generate_subscripts(ws, 1) - 1 AS unit, unnest(ws) AS word FROM qw), qt AS (SELECT query_id, unit, {TERMS.format("word")} AS ts FROM qu),
units AS (SELECT query_id, unit, len(ts) AS size, generate_subscripts(ts, 1) - 1 AS place, unnest(ts) AS term FROM qt),
runs AS (SELECT query_id, unit, size, rel, chunk_index, pos - place AS at, count(*) AS found FROM words JOIN units USING (term) GROUP BY ALL),
hits AS (SELECT query_id, unit, rel, chunk_index, count(*) AS tf FROM runs WHERE found = size GROUP BY ALL), dfs AS (SELECT query_id, unit, count(*) AS df FROM hits GROUP BY ALL),
scored AS (SELECT query_id, rel, chunk_index, sum(CASE WHEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) > 0 THEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) ELSE 1e-6::DOUBLE END * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
  FROM hits JOIN dfs USING (query_id, unit) JOIN lens USING (rel, chunk_index), stats GROUP BY ALL),
ranks AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 4) DESC, round(score, 9) DESC, rel, chunk_index) AS rank FROM scored)"""


def with_queries(select: str, source: str) -> str:
    return f"WITH queries AS ({source}), {SCORED} {select}"


TOP = "SELECT query_id, rel, chunk_index, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM ranks WHERE rank <= {}"


def one(spark: SparkSession, query: str) -> DataFrame:
    return spark.createDataFrame([(0, query)], "query_id long, query string")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


ITEMS = "SELECT item_id AS query_id, text AS query FROM benchmark"


def chunks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.admitted(corpus.documents(spark, sf_dir)).select("rel", "chunk_index", "text")


def shown(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "rel", "chunk_index", F.round("score", 6).alias("score"), "rank")


# ---- corpus and text


@registered(f"WITH {INVENTORY} SELECT * FROM inv")
def inventory_stat(spark, sf_dir):
    return corpus.inventory(corpus.documents(spark, sf_dir))


@registered(f"WITH {DOCS} SELECT rel FROM docs WHERE contains(lower(rel), 'c1/en/d')")
def folder_filter(spark, sf_dir):
    rows = corpus.documents(spark, sf_dir)
    return rows.filter(T.in_folder(F.col("rel"), "C1/en/D")).select("rel")


@registered(f"WITH {DOCS}, everything AS (SELECT rel FROM docs UNION ALL SELECT 'pages/page_' || coalesce(CAST(page_id AS VARCHAR), '_') || '.html' FROM pages) SELECT CASE WHEN ends_with(rel, '.html') THEN '.html' ELSE '.txt' END AS ext, count(*) AS n FROM everything WHERE ends_with(rel, '.html') OR ends_with(rel, '.txt') GROUP BY ALL")
def ext_filter(spark, sf_dir):
    good, _ = T.wanted_types(["text", "*.html"])
    rows = corpus.documents(spark, sf_dir).select("rel").unionByName(corpus.pages(spark, sf_dir).select("rel"))
    return rows.withColumn("ext", T.extension(F.col("rel"))).filter(F.col("ext").isin(*good)).groupBy("ext").agg(F.count("*").alias("n"))


@registered(r"SELECT page_id, length(regexp_replace(html, '[\x00-\x08\x0B\x0E-\x1F\x7F]', '', 'g')) AS n, sha1(regexp_replace(html, '[\x00-\x08\x0B\x0E-\x1F\x7F]', '', 'g')) AS h FROM pages")
def sanitize_text(spark, sf_dir):
    clean = T.sanitized(F.col("text"))
    return corpus.pages(spark, sf_dir).select("page_id", F.length(clean).cast("long").alias("n"), F.sha1(clean.cast("binary")).alias("h"))


@registered(f"SELECT doc_id, length({FLAT}) AS n, sha1({FLAT}) AS h FROM documents")
def normalize_ws(spark, sf_dir):
    flat = T.squeezed(F.col("text"))
    return corpus.documents(spark, sf_dir).select("doc_id", F.length(flat).cast("long").alias("n"), F.sha1(flat.cast("binary")).alias("h"))


@registered(f"SELECT doc_id, len({WORDS.format('text')}) AS n_tokens, len(list_distinct({WORDS.format('text')})) AS n_different FROM documents WHERE text IS NOT NULL")
def tokenize_counts(spark, sf_dir):
    w = T.tokens(F.col("text"))
    return corpus.documents(spark, sf_dir).filter("text is not null").select("doc_id", F.size(w).cast("long").alias("n_tokens"), F.size(F.array_distinct(w)).cast("long").alias("n_different"))


@registered("SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, (length(text) + 3) // 4) END AS cost FROM documents WHERE text IS NOT NULL")
def token_cost(spark, sf_dir):
    return corpus.documents(spark, sf_dir).filter("text is not null").select("doc_id", T.token_cost(F.col("text")).cast("long").alias("cost"))


@registered(f"WITH w AS (SELECT item_id, {WORDS.format('text')} AS ws FROM benchmark) SELECT item_id, array_to_string([x for x in ws if length(x) >= 4 AND x NOT IN ({STOP})], ' ') AS terms FROM w")
def content_terms(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.array_join(T.content_terms(F.col("text")), " ").alias("terms"))


@registered(f"WITH {CHUNKS} SELECT rel, chunk_index, start_offset, end_offset, n_chunks, sha1(text) AS h FROM every")
def chunk_windows(spark, sf_dir):
    return T.with_chunks(corpus.documents(spark, sf_dir)).withColumn("h", F.sha1(F.col("text").cast("binary"))).drop("text")


@registered(f"""WITH w AS (SELECT doc_id, text, lower(text) AS low FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, text, CASE WHEN instr(low, 'the of') > 0 THEN instr(low, 'the of') WHEN instr(low, 'erre') > 0 AND instr(low, 'nicht') > 0 THEN least(instr(low, 'erre'), instr(low, 'nicht'))
  WHEN instr(low, 'erre') > 0 THEN instr(low, 'erre') WHEN instr(low, 'nicht') > 0 THEN instr(low, 'nicht') ELSE 1 END - 1 AS begins FROM w)
SELECT doc_id, trim(regexp_replace(substr(text, greatest(0, begins - 86) + 1, 260), '{SPACE}', ' ', 'g')) AS snippet FROM p""")
def snippet_window(spark, sf_dir):
    terms = F.array(F.lit("erre"), F.lit("nicht"))
    return corpus.documents(spark, sf_dir).filter("text is not null").select("doc_id", T.snippet(F.col("text"), F.lit("The of "), terms).alias("snippet"))


@registered("SELECT conv_id, count(*) AS n_turns, sha1(string_agg(coalesce(role, '') || ': ' || coalesce(text, ''), chr(10) ORDER BY turn, role, text)) AS h FROM conversations GROUP BY conv_id")
def conversation_docs(spark, sf_dir):
    return corpus.conversations(spark, sf_dir).select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.sha1(F.col("text").cast("binary")).alias("h"))


# ---- search


@registered(f"WITH {CHUNKS}, lists AS (SELECT rel, chunk_index, {TERMS.format('text')} AS ts FROM chunks), words AS (SELECT rel, chunk_index, unnest(ts) AS term FROM lists) SELECT term, count(DISTINCT rel || '#' || chunk_index) AS df, count(*) AS cf FROM words GROUP BY term")
def vocab_df(spark, sf_dir):
    return scan.vocabulary(corpus.documents(spark, sf_dir))


@registered(f"WITH {CHUNKS}, lens AS (SELECT len({TERMS.format('text')}) AS dl FROM chunks) SELECT count(*) AS n_chunks, round(avg(dl), 6) AS avgdl FROM lens")
def corpus_stats(spark, sf_dir):
    return search.corpus_stats(search.lengths(chunks_of(spark, sf_dir))).select("n_chunks", F.round("avgdl", 6).alias("avgdl"))


@registered(with_queries(TOP.format(8), f"SELECT 0 AS query_id, '{QUERY}' AS query"))
def bm25_exact_topk(spark, sf_dir):
    return shown(search.top(corpus.documents(spark, sf_dir), one(spark, QUERY), 8))


@registered(with_queries(TOP.format(8), f"SELECT 0 AS query_id, '{PHRASE_QUERY}' AS query"))
def bm25_phrase(spark, sf_dir):
    return shown(search.top(corpus.documents(spark, sf_dir), one(spark, PHRASE_QUERY), 8))


@registered(with_queries("SELECT query_id, rel, chunk_index, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS rank FROM ranks WHERE contains(rel, '/en/') QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 8", f"SELECT 0 AS query_id, '{QUERY}' AS query"))
def bm25_ext_filtered(spark, sf_dir):
    return shown(search.top(corpus.documents(spark, sf_dir), one(spark, QUERY), 8, folder="/EN/", types={".txt"}))


@registered(with_queries(TOP.format(3), ITEMS))
def batched_bm25(spark, sf_dir):
    return shown(search.top(corpus.documents(spark, sf_dir), items(spark, sf_dir), 3))


@registered()
def bm25_stem_topk(spark, sf_dir):
    return shown(search.top(corpus.documents(spark, sf_dir), items(spark, sf_dir), 8, stemmed=True))


@registered()
def dual_fusion_topk(spark, sf_dir):
    return shown(search.search(corpus.documents(spark, sf_dir), items(spark, sf_dir), 8, flagged=True))


@registered()
def cache_scorer(spark, sf_dir):
    return search.cache_score(corpus.documents(spark, sf_dir), QUERY).orderBy(F.col("score").desc(), "rel").limit(8)


@registered(with_queries(f"""SELECT query_id, rel, chunk_index, rank, contains(c.text, trim(regexp_replace(q.query, '{SPACE}', ' ', 'g'))) AS found FROM (SELECT query_id, rel, chunk_index, CAST(rank AS INTEGER) AS rank FROM ranks WHERE rank = 1) JOIN chunks c USING (rel, chunk_index) JOIN queries q USING (query_id)""", ITEMS))
def planted_recall(spark, sf_dir):
    docs, asked = corpus.documents(spark, sf_dir), items(spark, sf_dir)
    best = search.top(docs, asked, 1).select("query_id", "rel", "chunk_index", "rank")
    return search.with_text(best, docs).join(asked, "query_id").select("query_id", "rel", "chunk_index", "rank", F.col("text").contains(T.squeezed(F.col("query"))).alias("found"))


@registered(with_queries("SELECT quality, count(DISTINCT doc_id) AS n FROM ranks JOIN docs USING (rel) JOIN labels USING (doc_id) WHERE rank <= 10 GROUP BY quality", ITEMS))
def quality_of_hits(spark, sf_dir):
    best = search.top(corpus.documents(spark, sf_dir), items(spark, sf_dir), 10).select("rel").distinct()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return corpus.documents(spark, sf_dir).select("rel", "doc_id").join(best, "rel").join(labels, "doc_id").groupBy("quality").agg(F.countDistinct("doc_id").alias("n"))


# ---- evidence

WANTED = f"wanted AS (SELECT item_id AS query_id, list_distinct([x for x in {WORDS.format('text')} if length(x) >= 4 AND x NOT IN ({STOP})]) AS wanted FROM benchmark)"


@registered(with_queries(f"SELECT query_id, rel, chunk_index, rank FROM (SELECT query_id, rel, chunk_index, CAST(rank AS INTEGER) AS rank, score FROM ranks WHERE rank <= 40) JOIN (SELECT rel, chunk_index, {WORDS.format('text')} AS ws FROM chunks) USING (rel, chunk_index) JOIN wanted USING (query_id) WHERE CASE WHEN len(wanted) = 0 THEN score >= 0.01 ELSE list_has_any(ws, wanted) END", ITEMS).replace(f"), {CHUNKS[:4]}", f"), {WANTED}, {CHUNKS[:4]}", 1))
def existence_filter(spark, sf_dir):
    docs, asked = corpus.documents(spark, sf_dir), items(spark, sf_dir)
    pool = search.with_text(search.top(docs, asked, 40), docs).withColumn("stems", T.tokens(F.col("text")))
    terms = asked.select("query_id", F.array_distinct(T.content_terms(F.col("query"))).alias("wanted"))
    return evidence.existing(pool, terms).select("query_id", "rel", "chunk_index", "rank")


@registered(with_queries(f"SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest(wanted) AS term FROM wanted) a WHERE NOT EXISTS (SELECT 1 FROM (SELECT query_id, unnest(ws) AS term FROM ranks JOIN (SELECT rel, chunk_index, {WORDS.format('text')} AS ws FROM chunks) USING (rel, chunk_index) WHERE rank <= 3) b WHERE b.query_id = a.query_id AND b.term = a.term)", ITEMS).replace(f"), {CHUNKS[:4]}", f"), {WANTED}, {CHUNKS[:4]}", 1))
def missing_terms(spark, sf_dir):
    docs, asked = corpus.documents(spark, sf_dir), items(spark, sf_dir)
    pool = search.with_text(search.top(docs, asked, 3), docs).select("query_id", T.tokens(F.col("text")).alias("stems"))
    terms = asked.select("query_id", F.explode(T.content_terms(F.col("query"))).alias("term")).withColumn("stem", F.col("term"))
    return evidence.missing_terms(terms, pool)


@registered(with_queries("SELECT query_id, rel, chunk_index, CAST(rank AS INTEGER) AS rank FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM ranks WHERE rank <= 40) WHERE top <= 0.01 OR score >= 0.15::DOUBLE * top", ITEMS))
def relevance_floor(spark, sf_dir):
    return evidence.above_floor(search.top(corpus.documents(spark, sf_dir), items(spark, sf_dir), 40)).select("query_id", "rel", "chunk_index", "rank")


@registered(with_queries("SELECT query_id, rel, chunk_index, CAST(rank AS INTEGER) AS rank FROM ranks WHERE rank <= 40 QUALIFY row_number() OVER (PARTITION BY query_id, rel ORDER BY rank) <= 2", ITEMS))
def per_source_cap(spark, sf_dir):
    return evidence.per_source(search.top(corpus.documents(spark, sf_dir), items(spark, sf_dir), 40), [F.col("rank")]).select("query_id", "rel", "chunk_index", "rank")


@registered(with_queries("SELECT query_id, rel, chunk_index, CAST(rank AS INTEGER) AS rank, CAST(used AS BIGINT) AS used FROM (SELECT *, min(CASE WHEN used > 3000 AND rank > 1 THEN rank END) OVER (PARTITION BY query_id) AS over FROM (SELECT query_id, rel, chunk_index, rank, 80 + sum((length(text) + 3) // 4 + 12) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM ranks JOIN chunks USING (rel, chunk_index) WHERE rank <= 40)) WHERE over IS NULL OR rank < over", ITEMS))
def budget_pack(spark, sf_dir):
    docs = corpus.documents(spark, sf_dir)
    pool = search.with_text(search.top(docs, items(spark, sf_dir), 40), docs)
    pool = pool.select("query_id", "rel", "chunk_index", "rank", evidence.excerpt_cost(F.col("text")).alias("cost"))
    return evidence.packed(pool, [F.col("rank")], 3000).select("query_id", "rel", "chunk_index", "rank", F.col("used").cast("long").alias("used"))


@registered("""WITH RECURSIVE f AS (SELECT lang AS query_id, CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS INTEGER) AS place, source AS label, 6 + n_chars % 97 AS cost, n_chars % 3 = 0 AS has_value FROM documents WHERE lang IS NOT NULL QUALIFY place <= 200),
t AS (SELECT query_id, place, label, (80 + cost <= 2000 OR has_value) AS packed, CAST(80 + CASE WHEN 80 + cost <= 2000 OR has_value THEN cost ELSE 0 END AS BIGINT) AS used, (80 + cost <= 2000 OR has_value) AS got FROM f WHERE place = 1
  UNION ALL SELECT f.query_id, f.place, f.label, (t.used + cost <= 2000 OR (NOT got AND has_value)), CAST(t.used + CASE WHEN t.used + cost <= 2000 OR (NOT got AND has_value) THEN cost ELSE 0 END AS BIGINT), got OR (t.used + cost <= 2000 OR (NOT got AND has_value)) FROM t JOIN f ON f.query_id = t.query_id AND f.place = t.place + 1)
SELECT query_id, place, label, packed, used FROM t""")
def field_pack_fold(spark, sf_dir):
    """A form per language; its fields, 200 at most as in any form, have costs made of the documents' lengths."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("lang is not null")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))
    fields = d.select(F.col("lang").alias("query_id"), place.alias("place"), F.col("source").alias("label"), (6 + F.col("n_chars") % 97).alias("cost"), (F.col("n_chars") % 3 == 0).alias("has_value")).filter("place <= 200")
    return evidence.packed_fields(fields, 2000)


@registered("""WITH RECURSIVE b AS (SELECT *, coalesce(lang, '_') || '/' || coalesce(CAST(doc_id // 200 AS VARCHAR), '_') AS block FROM documents),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY block ORDER BY doc_id, n_chars, source) AS INTEGER) - 1 AS nth FROM b),
f AS (SELECT block || '/' || CAST(nth // 200 AS VARCHAR) AS query_id, nth % 200 + 1 AS place, source AS label, 6 + n_chars % 97 AS cost, n_chars % 3 = 0 AS has_value FROM p),
t AS (SELECT query_id, place, label, (80 + cost <= 2000 OR has_value) AS packed, CAST(80 + CASE WHEN 80 + cost <= 2000 OR has_value THEN cost ELSE 0 END AS BIGINT) AS used, (80 + cost <= 2000 OR has_value) AS got FROM f WHERE place = 1
  UNION ALL SELECT f.query_id, f.place, f.label, (t.used + cost <= 2000 OR (NOT got AND has_value)), CAST(t.used + CASE WHEN t.used + cost <= 2000 OR (NOT got AND has_value) THEN cost ELSE 0 END AS BIGINT), got OR (t.used + cost <= 2000 OR (NOT got AND has_value)) FROM t JOIN f ON f.query_id = t.query_id AND f.place = t.place + 1)
SELECT query_id, place, label, packed, used FROM t""")
def field_pack_forms(spark, sf_dir):
    """All documents in forms of 200 fields at most: of one language and 200 following doc_ids, and by 200 where ids repeat."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    d = d.withColumn("block", F.concat_ws("/", F.coalesce("lang", F.lit("_")), F.coalesce(F.expr("doc_id div 200").cast("string"), F.lit("_"))))
    first = [F.col(c).asc_nulls_last() for c in ("doc_id", "n_chars", "source")]
    nth = F.row_number().over(Window.partitionBy("block").orderBy(*first)) - 1
    fields = d.withColumn("nth", nth).select(F.concat_ws("/", "block", F.expr("nth div 200").cast("string")).alias("query_id"), (F.col("nth") % 200 + 1).alias("place"), F.col("source").alias("label"), (6 + F.col("n_chars") % 97).alias("cost"), (F.col("n_chars") % 3 == 0).alias("has_value"))
    return evidence.packed_fields(fields, 2000)


ALIAS_SQL = "VALUES " + ", ".join(f"({i}, {[*words]})" for i, group in enumerate([[k, *v] for k, v in ALIASES.items()]) for words in ([w for w in p.split()] for p in group))


def aliases_of(spark: SparkSession) -> DataFrame:
    """The groups with their words as they are: the registered queries compare literally, as SQL has no stemmer."""
    return spark.createDataFrame([(i, p, p.split()) for i, g in enumerate(evidence.alias_groups(ALIASES)) for p in g], "group_id int, phrase string, stems array<string>")


@registered(f"WITH a(group_id, p) AS ({ALIAS_SQL}), t AS (SELECT item_id AS query_id, {WORDS.format('text')} AS ws FROM benchmark) SELECT DISTINCT query_id, group_id FROM t, a WHERE list_has_all(ws, p)")
def alias_trigger(spark, sf_dir):
    return evidence.triggered(items(spark, sf_dir).select("query_id", T.tokens(F.col("query")).alias("stems")), aliases_of(spark))


@registered(f"WITH a(group_id, p) AS ({ALIAS_SQL}), {DOCS}, t AS (SELECT rel, ' ' || array_to_string({WORDS.format('text')}, ' ') || ' ' AS ws FROM docs WHERE text IS NOT NULL) SELECT DISTINCT rel, group_id FROM t, a WHERE contains(ws, ' ' || array_to_string(p, ' ') || ' ')")
def alias_in_text(spark, sf_dir):
    return evidence.said_in(corpus.documents(spark, sf_dir).filter("text is not null").select("rel", T.tokens(F.col("text")).alias("stems")), aliases_of(spark))


# ---- values

AMOUNTS = ("INR 4.2 crore", "₹4.20 cr", "42,000,000", "-5 lakh", "1.5 million", "2 bn", "7k", "3 k", "no number", "$1,234.50", "12%", "24 months", "", "9 lac")
AMOUNT_SQL = r"CASE WHEN num = '' THEN NULL ELSE CAST(num AS DOUBLE) * CASE WHEN regexp_matches(s, 'crore|\bcr\b') THEN 1e7 WHEN regexp_matches(s, 'lakh|\blac?\b') THEN 1e5 WHEN regexp_matches(s, 'billion|\bbn\b') THEN 1e9 WHEN regexp_matches(s, 'million|\bmn\b') THEN 1e6 WHEN regexp_matches(s, '\bk\b') THEN 1e3 ELSE 1e0 END * CASE WHEN regexp_matches(value, '^\s*-') THEN -1 ELSE 1 END END"
MONTHS_SQL = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
KEYS = (*AMOUNTS[:-2], "31/12/2026", "31-12-2026", "01/02/2026", "2026-01-05", "5  Jan 2026", "Mar 7", "Plain   Text")


def as_values(rows) -> str:
    return ", ".join(f"('{r}')" for r in rows)


@registered(rf"WITH v(value) AS (VALUES {as_values(AMOUNTS)}), n AS (SELECT value, lower(replace(value, ',', '')) AS s, regexp_extract(lower(replace(value, ',', '')), '\d+\.?\d*') AS num FROM v) SELECT value, {AMOUNT_SQL} AS amount FROM n")
def amount_normalize(spark, sf_dir):
    return spark.createDataFrame([(v,) for v in AMOUNTS], "value string").select("value", facts.amount(F.col("value")).alias("amount"))


@registered(rf"""WITH v(value) AS (VALUES {as_values(KEYS)}), n AS (SELECT value, lower(trim(regexp_replace(value, '\s+', ' ', 'g'))) AS low, lower(replace(value, ',', '')) AS s, regexp_extract(lower(replace(value, ',', '')), '\d+\.?\d*') AS num FROM v), a AS (SELECT *, {AMOUNT_SQL} AS amount,
  regexp_matches(trim(value), '^(?:\d{{1,2}}[/\-]\d{{1,2}}[/\-]\d{{2,4}}\b|\d{{4}}[/\-]\d{{1,2}}[/\-]\d{{1,2}}\b|\d{{1,2}}\s+{MONTHS_SQL}\s+\d{{2,4}}\b|{MONTHS_SQL}\s+\d+)', 'i') AS dated FROM n)
SELECT value, CASE WHEN dated THEN 'date' WHEN amount IS NOT NULL THEN 'num' ELSE 'txt' END AS kind, CASE WHEN dated AND regexp_matches(low, '^\d{{1,4}}[/\-]\d{{1,2}}[/\-]\d{{1,4}}$') THEN array_to_string([CAST(CAST(x AS INTEGER) AS VARCHAR) for x in string_split(replace(low, '-', '/'), '/')], '/') WHEN dated THEN low WHEN amount IS NOT NULL THEN printf('%.2f', round(amount, 2)) ELSE low END AS key FROM a""")
def value_key(spark, sf_dir):
    return spark.createDataFrame([(v,) for v in KEYS], "value string").select("value", facts.value_key(F.col("value")).alias("k")).select("value", "k.kind", "k.key")


@registered(rf"WITH {DOCS}, s AS (SELECT rel || CASE doc_id % 6 WHEN 0 THEN '_signed' WHEN 1 THEN '_draft_v2' WHEN 2 THEN ' Final old' WHEN 3 THEN 'signedness' ELSE '' END AS rel FROM docs), n AS (SELECT rel, replace(rel, '_', ' ') AS r FROM s) SELECT rel, CAST(regexp_matches(r, '\b(executed|signed|final|amended|effective)\b', 'i') AS INTEGER) - CAST(regexp_matches(r, '\b(draft|wip|working|superseded|archive|old)\b', 'i') AS INTEGER) AS authority FROM n")
def authority_hint(spark, sf_dir):
    k = F.col("doc_id") % 6
    tail = F.when(k == 0, "_signed").when(k == 1, "_draft_v2").when(k == 2, " Final old").when(k == 3, "signedness").otherwise("")
    rows = corpus.documents(spark, sf_dir).select(F.concat("rel", F.when(F.col("doc_id").isNull(), "").otherwise(tail)).alias("rel"))
    return rows.select("rel", facts.authority(F.col("rel")).alias("authority"))


@registered()
def has_value(spark, sf_dir):
    return scan.flags(corpus.documents(spark, sf_dir))


@registered()
def value_scan(spark, sf_dir):
    """The first value of every chunk, with where it stands."""

    def run(batches):
        import pandas as pd

        for b in batches:
            found = [values.first_value(t) for t in b["text"]]
            yield pd.DataFrame({"rel": b["rel"], "chunk_index": b["chunk_index"], "value": [m and m[0].strip() for m in found], "at": pd.array([m and m.start() for m in found], "Int64")}).dropna(subset=["value"])

    return chunks_of(spark, sf_dir).mapInPandas(run, "rel string, chunk_index int, value string, at long")


FORM = ("Legal name", "Effective date", "Liability cap", "Phone", "Email")


@registered()
def field_answers(spark, sf_dir):
    """What each chunk answers to the fields of a form."""
    groups, tokens = evidence.alias_groups(evidence.STARTER_ALIASES), {w for f in FORM for w in values.words(f)}

    def run(batches):
        import pandas as pd

        for b in batches:
            out = [(r, f, a.value, a.clean, a.how) for r, t in zip(b["rel"], b["text"], strict=True) for f in FORM if (a := values.answer(t, f, tokens - set(values.words(f)), groups))]
            yield pd.DataFrame(out, columns=["rel", "field", "value", "clean", "how"])

    return chunks_of(spark, sf_dir).mapInPandas(run, "rel string, field string, value string, clean boolean, how string")


CLAIMS = (("cap", "4.2 crore", "a_signed.md", "2026-01-01T00:00:00Z"), ("cap", "42,000,000", "b.md", "2026-02-01T00:00:00Z"), ("cap", "5 crore", "c_draft.md", "2026-02-01T00:00:00Z"), ("cap", "6 crore", "d_signed.md", "2026-02-01T00:00:00Z"),
          ("start", "31/12/2026", "a_signed.md", "2026-01-01T00:00:00Z"), ("start", "31-12-2026", "b.md", "2026-02-01T00:00:00Z"), ("law", "Karnataka", "a_signed.md", "2026-01-01T00:00:00Z"), ("law", "Goa", "x.md", None), ("law", "", "b.md", None))


@registered("SELECT * FROM (VALUES ('cap', 'num', '60000000.00', '6 crore', 'd_signed.md', 1), ('cap', 'num', '42000000.00', '42,000,000', 'b.md', 2), ('cap', 'num', '50000000.00', '5 crore', 'c_draft.md', 3), ('law', 'txt', 'karnataka', 'Karnataka', 'a_signed.md', 1), ('law', 'txt', 'goa', 'Goa', 'x.md', 2)) t(key, value_kind, value_key, value, rel, place)")
def conflict_groups(spark, sf_dir):
    rows = spark.createDataFrame([(*c[:3], c[1]) for c in CLAIMS], "key string, value string, rel string, line string")
    sources = spark.createDataFrame(sorted({(c[2], c[3]) for c in CLAIMS if c[3]}), "rel string, mtime_iso string")
    return evidence.conflicts(rows, sources).drop("line", "authority")


FORM_TEXT = "Vendor form\n\n1. Legal name: ____\n- Effective date: \n* Échéance :\nPhone ______\nLegal name: again\nno label here\n   Rate (per year)/month _\nlegal Name:"


@registered("SELECT * FROM (VALUES (1, 'Legal name'), (2, 'Effective date'), (3, 'Échéance'), (4, 'Phone'), (5, 'Legal name #2'), (6, 'Rate (per year)/month'), (7, 'legal Name #3')) t(place, label)")
def form_fields(spark, sf_dir):
    return evidence.form_fields(spark.createDataFrame([(0, FORM_TEXT)], "form_id int, text string")).select("place", "label")


# ---- inventory: an older snapshot is made of the documents by rule, so every kind of change is there

OLD = f"""{INVENTORY}, ids AS (SELECT doc_id, rel FROM docs), old AS (
 SELECT CASE WHEN doc_id % 11 = 1 THEN 'old/' || rel ELSE rel END AS rel, CASE WHEN doc_id % 5 = 2 THEN size + 1 ELSE size END AS size, CASE WHEN doc_id % 5 = 2 THEN sha1(sha1) WHEN doc_id % 9 = 4 THEN NULL ELSE sha1 END AS sha1, '2026-01-0' || (1 + doc_id % 2) || 'T00:00:00Z' AS mtime_iso FROM inv JOIN ids USING (rel) WHERE doc_id % 7 <> 3
 UNION ALL SELECT 'gone/' || rel, size, CASE WHEN doc_id % 2 = 0 THEN sha1 ELSE sha1('gone' || rel) END, '2026-01-01T00:00:00Z' FROM inv JOIN ids USING (rel) WHERE doc_id % 13 = 5),
cur AS (SELECT rel, size, sha1, '2026-01-01T00:00:00Z' AS mtime_iso FROM inv)"""
SAME = "CASE WHEN coalesce(n.sha1, '') <> '' AND coalesce(b.sha1, '') <> '' THEN n.sha1 = b.sha1 ELSE n.mtime_iso IS NOT DISTINCT FROM b.mtime_iso AND n.size IS NOT DISTINCT FROM b.size END"


def snapshots(spark, sf_dir):
    ids = corpus.documents(spark, sf_dir).select("rel", "doc_id")
    inv = corpus.inventory(corpus.documents(spark, sf_dir)).select("rel", "size", "sha1")
    d, i = F.col("doc_id"), inv.join(ids, "rel")
    old = i.filter(d % 7 != 3).select(
        F.when(d % 11 == 1, F.concat(F.lit("old/"), "rel")).otherwise(F.col("rel")).alias("rel"), F.when(d % 5 == 2, F.col("size") + 1).otherwise(F.col("size")).alias("size"),
        F.when(d % 5 == 2, F.sha1(F.col("sha1").cast("binary"))).when(d % 9 == 4, F.lit(None)).otherwise(F.col("sha1")).alias("sha1"), F.concat(F.lit("2026-01-0"), (1 + d % 2).cast("string"), F.lit("T00:00:00Z")).alias("mtime_iso"),
    )
    gone = i.filter(d % 13 == 5).select(F.concat(F.lit("gone/"), "rel").alias("rel"), "size", F.when(d % 2 == 0, F.col("sha1")).otherwise(F.sha1(F.concat(F.lit("gone"), "rel").cast("binary"))).alias("sha1"), F.lit("2026-01-01T00:00:00Z").alias("mtime_iso"))
    return inv.withColumn("mtime_iso", F.lit("2026-01-01T00:00:00Z")), old.unionByName(gone)


DIFF = f"""{OLD}, both_ AS (SELECT coalesce(n.rel, b.rel) AS rel, coalesce(n.sha1, b.sha1) AS sha1, CASE WHEN b.rel IS NULL THEN 'new' WHEN n.rel IS NULL THEN 'gone' WHEN coalesce({SAME}, false) THEN 'unchanged' ELSE 'changed' END AS state FROM cur n FULL JOIN old b ON n.rel = b.rel),
lost AS (SELECT sha1, min(rel) AS old_rel FROM both_ WHERE state = 'gone' AND coalesce(sha1, '') <> '' GROUP BY sha1), kept AS (SELECT DISTINCT sha1 FROM cur WHERE coalesce(sha1, '') <> ''),
diff AS (SELECT rel, CASE WHEN state = 'new' AND old_rel IS NOT NULL THEN 'renamed' WHEN state <> 'gone' THEN state WHEN kept.sha1 IS NOT NULL THEN 'moved_away' ELSE 'deleted' END AS action, CASE WHEN state = 'new' THEN old_rel END AS old_rel FROM both_ LEFT JOIN lost USING (sha1) LEFT JOIN kept ON kept.sha1 = both_.sha1)"""


@registered(f"WITH {DIFF} SELECT * FROM diff")
def sync_diff(spark, sf_dir):
    return inventory.diff(*snapshots(spark, sf_dir))


@registered(f"WITH {DIFF} SELECT rel, old_rel FROM diff WHERE action = 'renamed'")
def rename_detect(spark, sf_dir):
    return inventory.diff(*snapshots(spark, sf_dir)).filter("action = 'renamed'").select("rel", "old_rel")


@registered(f"WITH {DIFF} SELECT action, count(*) AS n FROM diff GROUP BY action")
def sync_counts(spark, sf_dir):
    return inventory.counts(inventory.diff(*snapshots(spark, sf_dir)))


@registered(f"WITH {OLD} SELECT rel, 'added' AS bucket FROM cur WHERE rel NOT IN (SELECT rel FROM old) UNION ALL SELECT rel, 'deleted' FROM old WHERE rel NOT IN (SELECT rel FROM cur) UNION ALL SELECT n.rel, 'modified' FROM cur n JOIN old b ON n.rel = b.rel WHERE n.size IS DISTINCT FROM b.size OR n.mtime_iso IS DISTINCT FROM b.mtime_iso")
def status_diff(spark, sf_dir):
    return inventory.status(*snapshots(spark, sf_dir))


@registered(f"WITH {OLD} SELECT coalesce(n.rel, b.rel) AS rel, unnest(CASE WHEN b.rel IS NULL THEN ['add'] WHEN n.rel IS NULL THEN ['remove'] WHEN NOT coalesce({SAME}, false) THEN ['add', 'remove'] ELSE [] END) AS work FROM cur n FULL JOIN old b ON n.rel = b.rel")
def reindex_set(spark, sf_dir):
    return inventory.reindex(*snapshots(spark, sf_dir))


@registered(f"WITH {INVENTORY}, r AS (SELECT CASE WHEN doc_id % 4 = 1 THEN 'Update/' || rel ELSE rel END AS rel, inv.sha1 FROM inv JOIN (SELECT rel, doc_id FROM docs) USING (rel)), o AS (SELECT sha1, min(rel) AS original FROM r WHERE NOT starts_with(rel, 'Update/') GROUP BY sha1) SELECT rel, original FROM r JOIN o USING (sha1) WHERE starts_with(rel, 'Update/')")
def dup_sha1(spark, sf_dir):
    d = corpus.documents(spark, sf_dir)
    rows = corpus.inventory(d.withColumn("rel", F.when(F.col("doc_id") % 4 == 1, F.concat(F.lit("Update/"), "rel")).otherwise(F.col("rel"))))
    return inventory.duplicates(rows)


# ---- reports

ENTRY = f"strlen(chr(10) || chr(10) || '{reports.LINE}' || chr(10) || 'FILE: ' || rel || chr(10) || 'MTIME: ' || chr(10) || 'SHA1: ' || substr(sha1(text), 1, 12) || chr(10) || '{reports.LINE}' || chr(10) || regexp_replace(text, '^{SPACE}|{SPACE}$', '', 'g') || chr(10))"


def dump_rows(spark, sf_dir):
    d = corpus.documents(spark, sf_dir).withColumn("text", F.when(F.length(F.col("text")) % 10 != 7, F.col("text")))
    return d.select("rel", F.element_at(F.split("rel", "/"), 2).alias("top_folder"), F.lit(None).cast("string").alias("mtime_iso"), F.sha1(F.coalesce("text", F.lit("")).cast("binary")).alias("sha1"), "text")


DUMP = f"{DOCS}, r AS (SELECT rel, split_part(rel, '/', 2) AS top_folder, CASE WHEN length(text) % 10 <> 7 THEN text END AS text FROM docs), e AS (SELECT rel, top_folder, {ENTRY} AS bytes FROM r WHERE coalesce(text, '') <> '')"


@registered(f"WITH {DUMP} SELECT top_folder, count(*) FILTER (coalesce(text, '') <> '') AS files_dumped, count(*) FILTER (coalesce(text, '') = '') AS skipped, CAST(coalesce((SELECT sum(bytes) FROM e WHERE e.top_folder = r.top_folder), 0) AS BIGINT) AS bytes FROM r GROUP BY top_folder")
def dump_manifest(spark, sf_dir):
    return reports.dump_manifest(dump_rows(spark, sf_dir))


@registered(f"""WITH RECURSIVE {DUMP}, o AS (SELECT *, row_number() OVER (PARTITION BY top_folder ORDER BY rel) AS k FROM e), t AS (SELECT top_folder, rel, bytes, k, 1 AS part, bytes AS filled FROM o WHERE k = 1
 UNION ALL SELECT o.top_folder, o.rel, o.bytes, o.k, CASE WHEN filled > 0 AND filled + o.bytes > 50000 THEN part + 1 ELSE part END, CASE WHEN filled > 0 AND filled + o.bytes > 50000 THEN o.bytes ELSE filled + o.bytes END FROM t JOIN o ON o.top_folder = t.top_folder AND o.k = t.k + 1)
SELECT top_folder, rel, CAST(bytes AS BIGINT) AS bytes, CAST(part AS INTEGER) AS part FROM t""")
def dump_parts(spark, sf_dir):
    return reports.dump_parts(reports.dump_entries(dump_rows(spark, sf_dir)), 50_000)


STATUS = "CASE WHEN length(text) % 10 = 7 THEN 'failed' WHEN length(text) % 10 = 3 THEN 'empty' WHEN length(text) % 10 = 5 THEN 'skipped' END"


def status_rows(spark, sf_dir):
    n = F.length("text") % 10
    d = corpus.documents(spark, sf_dir)
    return d.select("rel", T.extension(F.col("rel")).alias("ext"), F.when(n == 7, "failed").when(n == 3, "empty").when(n == 5, "skipped").alias("status"), F.when(n != 5, F.col("text")).alias("text"), F.lit(0).alias("pictures"))


@registered(f"WITH s AS (SELECT {STATUS} AS status, CASE WHEN length(text) % 10 <> 5 THEN text END AS text FROM documents) SELECT CASE WHEN status = 'empty' THEN 'empty' WHEN status = 'failed' THEN 'failed' WHEN coalesce(text, '') <> '' THEN 'cached' WHEN status = 'skipped' THEN 'skipped' ELSE 'missing' END AS bucket, count(*) AS n FROM s GROUP BY bucket")
def coverage_counts(spark, sf_dir):
    return reports.coverage(status_rows(spark, sf_dir))


@registered(f"WITH {INVENTORY}, o AS (SELECT rel, row_number() OVER (ORDER BY rel) - 1 AS k FROM inv) SELECT rel, true AS ok FROM o WHERE k % 50 = 0")
def sampled_hash_check(spark, sf_dir):
    d = corpus.documents(spark, sf_dir)
    return reports.hash_check(corpus.inventory(d).select("rel", "sha1"), d)


@registered(f"""WITH {DOCS}, s AS (SELECT rel, {STATUS} AS status, CASE WHEN length(text) % 10 <> 5 THEN text END AS text FROM docs UNION ALL SELECT 'pages/page_' || coalesce(CAST(page_id AS VARCHAR), '_') || '.html', NULL, html FROM pages)
SELECT rel, 'file-low-or-no-text' AS reason, 'pending' AS status FROM s WHERE coalesce(status, '') <> 'skipped' AND length(regexp_replace(coalesce(text, ''), '^{SPACE}|{SPACE}$', '', 'g')) < 300""")
def vision_queue(spark, sf_dir):
    html = corpus.pages(spark, sf_dir).select("rel", T.extension(F.col("rel")).alias("ext"), F.lit(None).cast("string").alias("status"), "text", F.lit(0).alias("pictures"))
    return reports.vision_queue(status_rows(spark, sf_dir).unionByName(html))


# ---- vectors


@registered("""WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id, list_dot_product(CAST(q AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS score FROM q, embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8""")
def vector_topk(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vector"))
    asked = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("q"))
    return vectors.top_k(v, asked, "vec_id").withColumn("score", F.round("score", 6))


@registered()
def hash_embed(spark, sf_dir):
    return vectors.build(corpus.documents(spark, sf_dir)).select("rel", "chunk_index", "vector", F.size("vector").alias("width"), F.round(embed.dot(F.col("vector"), F.col("vector")), 3).alias("norm"))


@registered()
def semantic_topk(spark, sf_dir):
    return vectors.semantic_search(vectors.build(corpus.documents(spark, sf_dir), saying=QUERY), QUERY)


@registered()
def stem_vocabulary(spark, sf_dir):
    words = chunks_of(spark, sf_dir).select(F.explode(T.tokens(F.col("text"))).alias("word")).distinct()
    return words.withColumn("stem", porter.stem_guarded("word"))


@registered()
def packet_evidence(spark, sf_dir):
    """Evidence for each benchmark item: fused search, existence, floor, two per source, budget."""
    docs, asked = corpus.documents(spark, sf_dir), items(spark, sf_dir)
    pool = search.with_text(search.search(docs, asked, 40, flagged=True), docs)
    terms = asked.select("query_id", F.array_distinct(T.content_terms(F.col("query"))).alias("wanted"))
    pool = evidence.existing(pool.withColumn("stems", porter.stem_lists(F.array_distinct(T.tokens(F.col("text"))))), terms.select("query_id", porter.stem_lists("wanted").alias("wanted")))
    pool = evidence.per_source(evidence.above_floor(pool), [F.col("rank")]).join(asked, "query_id").join(terms, "query_id")
    pool = pool.withColumn("excerpt", T.snippet(F.col("text"), F.col("query"), F.col("wanted"), evidence.EXCERPT)).withColumn("cost", evidence.excerpt_cost(F.col("excerpt")))
    return evidence.packed(pool, [F.col("rank")], 3000).select("query_id", "rel", "chunk_index", "excerpt", "cost", "used", "place")


def flagship(spark, sf_dir):
    """The best eight chunks for a query, with snippets."""
    docs = corpus.documents(spark, sf_dir)
    hits = search.with_text(search.top(docs, one(spark, QUERY), 8), docs)
    return hits.select("rank", "rel", "chunk_index", F.round("score", 4).alias("score"), T.snippet(F.col("text"), F.lit(QUERY), F.array(*map(F.lit, search.words_of(QUERY)))).alias("snippet"))
