"""Queries with stems, and more of the engine's operators over whole tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.functions import facts, porter, values
from tarnlight.functions import text as T
from tarnlight.operators import evidence, inventory, reports, search, vectors
from tarnlight.plans import queries as Q
from tarnlight.plans.queries import ALIASES, AMOUNT_SQL, CHUNKS, DOCS, INVENTORY, ITEMS, MONTHS_SQL, QUERY, STOP, WORDS, registered, with_queries
from tarnlight.plans.stem_sql import stems
from tarnlight.sources import corpus

# ---- ranking by stems

RANKED = """runs AS (SELECT query_id, unit, size, rel, chunk_index, pos - place AS at, count(*) AS found FROM {p}words JOIN {p}units USING (term) GROUP BY ALL),
{p}hits AS (SELECT query_id, unit, rel, chunk_index, count(*) AS tf FROM {p}runs WHERE found = size GROUP BY ALL), {p}dfs AS (SELECT query_id, unit, count(*) AS df FROM {p}hits GROUP BY ALL),
{p}scored AS (SELECT query_id, rel, chunk_index, sum(CASE WHEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) > 0 THEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) ELSE 1e-6::DOUBLE END * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
  FROM {p}hits JOIN {p}dfs USING (query_id, unit) JOIN lens USING (rel, chunk_index), stats GROUP BY ALL),
{p}ranks AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 4) DESC, round(score, 9) DESC, rel, chunk_index) AS rank FROM {p}scored)"""
STEMMED = f"""{stems("stem_of", "(SELECT term AS word FROM words UNION SELECT term FROM units)", False)}, s_words AS (SELECT rel, chunk_index, pos, stem AS term FROM words JOIN stem_of ON word = term),
s_units AS (SELECT query_id, unit, size, place, stem AS term FROM units JOIN stem_of ON word = term), s_{RANKED.format(p="s_")}"""


def with_stems(select: str, source: str, more: str = "") -> str:
    """As ``with_queries``, with the stemmed space in tables that begin with ``s_``."""
    return with_queries(f", {STEMMED}{more} {select}", source)


STEM_TOP = "SELECT query_id, rel, chunk_index, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM s_ranks WHERE rank <= 8"
Q.sql["bm25_stem_topk"] = with_stems(STEM_TOP, ITEMS)
Q.sql["stem_vocabulary"] = f"WITH {CHUNKS}, t AS (SELECT DISTINCT unnest({WORDS.format('text')}) AS word FROM chunks), {stems('stem_of', 't', True)} SELECT word, stem FROM stem_of"


@registered(with_stems(
    "SELECT query_id, rel, chunk_index, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM best WHERE rank <= 8", ITEMS,
    """, fused AS (SELECT query_id, rel, chunk_index, max(score) AS score FROM (SELECT query_id, rel, chunk_index, score FROM ranks WHERE rank <= 50 UNION ALL SELECT query_id, rel, chunk_index, score FROM s_ranks WHERE rank <= 50) GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 4) DESC, round(score, 9) DESC, rel, chunk_index) AS rank FROM fused)""",
))
def dual_fusion_unflagged(spark, sf_dir):
    """Both spaces fused, without the flags of values, which SQL can't read."""
    return Q.shown(search.search(corpus.documents(spark, sf_dir), Q.items(spark, sf_dir), 8))


Q.sql["cache_scorer"] = f"""WITH {DOCS}, q AS (SELECT unnest({WORDS.format(f"'{QUERY}'")}) AS word), t AS (SELECT rel, 1 AS inside, unnest({WORDS.format('text')}) AS word FROM docs UNION ALL SELECT rel, 0, unnest({WORDS.format('rel')}) FROM docs),
{stems('stem_of', '(SELECT word FROM t UNION SELECT word FROM q)', True)}, wanted AS (SELECT DISTINCT stem FROM q JOIN stem_of USING (word)),
hit AS (SELECT rel, stem, coalesce(sum(inside), 0) AS tf, count(*) - coalesce(sum(inside), 0) AS pf FROM t JOIN stem_of USING (word) WHERE stem IN (SELECT stem FROM wanted) GROUP BY ALL),
s AS (SELECT rel, count(*) AS matched, sum(CASE WHEN length(stem) >= 5 THEN 3 ELSE 1 END * least(tf, 3) + 5 * least(pf, 2)) AS points FROM hit GROUP BY rel),
p AS (SELECT rel, coalesce((length(lower(text)) - length(replace(lower(text), '{QUERY}', ''))) // length('{QUERY}'), 0) AS times FROM docs),
r AS (SELECT rel, CAST(floor((20 * least(3, times) + points) * pow(matched / CAST((SELECT count(*) FROM wanted) AS DOUBLE), 2) + 20 * matched) AS BIGINT) AS score FROM s JOIN p USING (rel))
SELECT rel, score FROM r WHERE score > 0 ORDER BY score DESC, rel LIMIT 8"""

# ---- evidence by stems and synonyms

GROUPS = [[k, *v] for k, v in ALIASES.items()]
ALIAS_ROWS = ", ".join(f"({i}, {j}, {p.split()})" for i, g in enumerate(GROUPS) for j, p in enumerate(g))
WANTED_STEMS = f""", al(group_id, phrase, ws) AS (VALUES {ALIAS_ROWS}), aw AS (SELECT group_id, phrase, unnest(ws) AS word FROM al), qt_ AS (SELECT query_id, unnest({WORDS.format('query')}) AS word FROM queries),
ct AS (SELECT query_id, unnest({WORDS.format('text')}) AS word, rel, chunk_index FROM ranks JOIN chunks USING (rel, chunk_index) WHERE rank <= @N),
{stems('stem_in', '(SELECT word FROM aw UNION SELECT word FROM qt_ UNION SELECT word FROM ct)', True)}, qs AS (SELECT DISTINCT query_id, stem FROM qt_ JOIN stem_in USING (word)), ap AS (SELECT group_id, phrase, list(DISTINCT stem) AS p FROM aw JOIN stem_in USING (word) GROUP BY ALL),
tr AS (SELECT DISTINCT query_id, group_id FROM (SELECT query_id, list(stem) AS s FROM qs GROUP BY query_id), ap WHERE list_has_all(s, p)),
wd AS (SELECT DISTINCT query_id, word AS term FROM qt_ WHERE length(word) >= 4 AND word NOT IN ({STOP})),
ws_ AS (SELECT query_id, stem FROM wd JOIN stem_in ON word = term UNION SELECT query_id, unnest(p) FROM tr JOIN ap USING (group_id)), cs AS (SELECT DISTINCT query_id, rel, chunk_index, stem FROM ct JOIN stem_in USING (word))"""


def asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The queries, their content terms with stems, and the stems that count for each: its own and those of synonyms it calls up."""
    rows = Q.items(spark, sf_dir)
    terms = rows.select("query_id", F.array_distinct(T.content_terms(F.col("query"))).alias("terms"))
    terms = terms.select("query_id", F.explode(F.arrays_zip("terms", porter.stem_lists("terms").alias("stems"))).alias("x")).select("query_id", F.col("x.terms").alias("term"), F.col("x.stems").alias("stem"))
    aliases = evidence.alias_table(spark, evidence.alias_groups(ALIASES))
    called = evidence.triggered(rows.select("query_id", porter.stem_lists(T.tokens(F.col("query"))).alias("stems")), aliases)
    also = called.join(F.broadcast(aliases), "group_id").select("query_id", F.explode("stems").alias("stem"))  # as large as the alias file
    wanted = rows.select("query_id").join(terms.select("query_id", "stem").unionByName(also), "query_id", "left").groupBy("query_id").agg(F.collect_set("stem").alias("wanted"))
    return rows, terms, wanted


def pool(spark: SparkSession, sf_dir: str, rows: DataFrame, limit: int) -> DataFrame:
    docs = corpus.documents(spark, sf_dir)
    found = search.with_text(search.top(docs, rows, limit), docs)
    return found.withColumn("stems", porter.stem_lists(F.array_distinct(T.tokens(F.col("text")))))


@registered(with_queries(
    f"{WANTED_STEMS.replace("@N", "40")} SELECT query_id, rel, chunk_index, CAST(rank AS INTEGER) AS rank FROM ranks WHERE rank <= 40 AND CASE WHEN query_id IN (SELECT query_id FROM ws_) THEN EXISTS (SELECT 1 FROM cs JOIN ws_ USING (query_id, stem) WHERE cs.query_id = ranks.query_id AND cs.rel = ranks.rel AND cs.chunk_index = ranks.chunk_index) ELSE score >= 0.01 END", ITEMS,
))
def existence_by_stem(spark, sf_dir):
    rows, _, wanted = asked(spark, sf_dir)
    return evidence.existing(pool(spark, sf_dir, rows, 40), wanted).select("query_id", "rel", "chunk_index", "rank")


@registered(with_queries(f"{WANTED_STEMS.replace("@N", "3")} SELECT query_id, term FROM wd JOIN stem_in ON word = term WHERE NOT EXISTS (SELECT 1 FROM cs WHERE cs.query_id = wd.query_id AND cs.stem = stem_in.stem)", ITEMS))
def missing_by_stem(spark, sf_dir):
    rows, terms, _ = asked(spark, sf_dir)
    return evidence.missing_terms(terms, pool(spark, sf_dir, rows, 3).select("query_id", "stems"))


# ---- values over whole tables: texts made of the documents by rule

SAID = "CASE doc_id % 9 WHEN 0 THEN 'INR ' || n_chars || '.5 crore' WHEN 1 THEN '-' || n_chars || ' lakh' WHEN 2 THEN n_chars || ' bn' WHEN 3 THEN n_chars || ' k' WHEN 4 THEN '1,' || (100 + doc_id % 900) || ' days' WHEN 5 THEN (1 + doc_id % 28) || '/' || (1 + doc_id % 12) || '/2026' WHEN 6 THEN (1 + doc_id % 28) || '  Jan 2026' WHEN 7 THEN coalesce(lang, '') || '  Words' ELSE '' END"


def said(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("value", F.expr(SAID)).filter("value is not null")


@registered(rf"WITH v AS (SELECT doc_id, {SAID} AS value FROM documents), n AS (SELECT doc_id, value, lower(replace(value, ',', '')) AS s, regexp_extract(lower(replace(value, ',', '')), '\d+\.?\d*') AS num FROM v WHERE value IS NOT NULL) SELECT doc_id, value, {AMOUNT_SQL} AS amount FROM n")
def amount_of_documents(spark, sf_dir):
    return said(spark, sf_dir).select("doc_id", "value", facts.amount(F.col("value")).alias("amount"))


KEYED = rf"""v AS (SELECT *, {SAID} AS value FROM documents), n AS (SELECT *, lower(trim(regexp_replace(value, '\s+', ' ', 'g'))) AS low, lower(replace(value, ',', '')) AS s, regexp_extract(lower(replace(value, ',', '')), '\d+\.?\d*') AS num FROM v WHERE value IS NOT NULL), a AS (SELECT *, {AMOUNT_SQL} AS amount,
  regexp_matches(trim(value), '^(?:\d{{1,2}}[/\-]\d{{1,2}}[/\-]\d{{2,4}}\b|\d{{4}}[/\-]\d{{1,2}}[/\-]\d{{1,2}}\b|\d{{1,2}}\s+{MONTHS_SQL}\s+\d{{2,4}}\b|{MONTHS_SQL}\s+\d+)', 'i') AS dated FROM n),
k AS (SELECT *, CASE WHEN dated THEN 'date' WHEN amount IS NOT NULL THEN 'num' ELSE 'txt' END AS kind, CASE WHEN dated AND regexp_matches(low, '^\d{{1,4}}[/\-]\d{{1,2}}[/\-]\d{{1,4}}$') THEN array_to_string([CAST(CAST(x AS INTEGER) AS VARCHAR) for x in string_split(replace(low, '-', '/'), '/')], '/') WHEN dated THEN low WHEN amount IS NOT NULL THEN printf('%.2f', round(amount, 2)) ELSE low END AS key FROM a)"""


@registered(f"WITH {KEYED} SELECT doc_id, kind, key FROM k")
def value_key_of_documents(spark, sf_dir):
    return said(spark, sf_dir).select("doc_id", facts.value_key(F.col("value")).alias("k")).select("doc_id", "k.kind", "k.key")


NAMED = "'doc_' || doc_id || CASE doc_id % 3 WHEN 0 THEN '_signed' WHEN 1 THEN '_draft' ELSE '' END"


@registered(f"""WITH {KEYED}, c AS (SELECT lang || '/' || (doc_id // 18) AS fact, kind, key AS vk, value, {NAMED} AS rel, CASE WHEN doc_id % 5 < 4 THEN '2026-01-0' || (1 + doc_id % 5) || 'T00:00:00Z' ELSE '' END AS t, CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END AS w FROM k WHERE value <> '' AND lang IS NOT NULL AND doc_id IS NOT NULL),
b AS (SELECT *, row_number() OVER (PARTITION BY fact, kind, vk ORDER BY t DESC, w DESC, rel DESC, value DESC) AS i FROM c), o AS (SELECT *, count(*) OVER (PARTITION BY fact) AS n, row_number() OVER (PARTITION BY fact ORDER BY t DESC, w DESC, rel DESC, value DESC) AS place FROM b WHERE i = 1)
SELECT fact AS key, kind AS value_kind, vk AS value_key, value, rel, CAST(place AS INTEGER) AS place, w AS authority FROM o WHERE n > 1""")
def conflicts_of_documents(spark, sf_dir):
    rows = said(spark, sf_dir).filter("doc_id is not null").select(F.expr("lang || '/' || (doc_id div 18)").alias("key"), "value", F.expr(NAMED).alias("rel"), "doc_id").withColumn("line", F.col("value"))
    sources = rows.filter("doc_id % 5 < 4").select("rel", F.expr("'2026-01-0' || (1 + doc_id % 5) || 'T00:00:00Z'").alias("mtime_iso")).distinct()
    return evidence.conflicts(rows.drop("doc_id"), sources).drop("line")


@registered("""WITH f AS (SELECT doc_id // 40 AS form_id, CAST(row_number() OVER (PARTITION BY doc_id // 40 ORDER BY doc_id, n_chars) AS INTEGER) AS place, CASE n_chars % 3 WHEN 0 THEN 'Field ' || coalesce(source, '') ELSE 'field (' || coalesce(lang, '') || ')/Échéance' END AS label, doc_id, n_chars FROM documents WHERE doc_id IS NOT NULL AND n_chars % 4 <> 3),
n AS (SELECT *, row_number() OVER (PARTITION BY form_id, lower(trim(label)) ORDER BY place) AS again FROM f) SELECT form_id, place, trim(label) || CASE WHEN again > 1 THEN ' #' || again ELSE '' END AS label FROM n""")
def form_fields_of_documents(spark, sf_dir):
    """A form of each 40 documents, a line a document; every fourth line is no field."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id is not null")
    label = F.expr("CASE n_chars % 3 WHEN 0 THEN 'Field ' || coalesce(source, '') ELSE 'field (' || coalesce(lang, '') || ')/Échéance' END")
    line = F.when(F.col("n_chars") % 4 == 3, F.lit("nothing to fill")).when(F.col("n_chars") % 4 == 0, F.concat(F.lit(" - "), label, F.lit(" : "))).when(F.col("n_chars") % 4 == 1, F.concat(F.lit("12.) "), label, F.lit("  ____"))).otherwise(F.concat(label, F.lit(":____")))
    rows = F.array_sort(F.collect_list(F.struct("doc_id", "n_chars", line.alias("line"))))  # 40 lines
    forms = d.groupBy(F.expr("doc_id div 40").alias("form_id")).agg(F.concat_ws("\n", F.transform(rows, lambda r: r["line"])).alias("text"))
    return evidence.form_fields(forms)


LABELLED = "'Legal name: ' || CASE doc_id % 3 WHEN 0 THEN 'Acme Holdings Ltd' WHEN 1 THEN 'Beta Components Pvt. Ltd.' ELSE 'Group ' || (1 + doc_id % 9) || ' Sentinel LLP' END || ', of Goa. Effective date: ' || (1 + doc_id % 28) || '/' || (1 + doc_id % 12) || '/2026; Liability cap: INR ' || doc_id || '.5 crore Renewal term: ' || (1 + doc_id % 36) || ' months Phone: see page ' || doc_id || '. Email: u' || doc_id || '@mail.test'"
ASKED = ("Legal name", "Effective date", "Liability cap", "Phone", "Email", "Renewal term", "Governing law")


@registered("""WITH d AS (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL) SELECT doc_id, 'Legal name' AS field, CASE doc_id % 3 WHEN 0 THEN 'Acme Holdings Ltd' WHEN 1 THEN 'Beta Components Pvt. Ltd' ELSE 'Group ' || (1 + doc_id % 9) || ' Sentinel LLP' END AS value, 'exact' AS how FROM d
UNION ALL SELECT doc_id, 'Effective date', (1 + doc_id % 28) || '/' || (1 + doc_id % 12) || '/2026', 'exact' FROM d UNION ALL SELECT doc_id, 'Liability cap', doc_id || '.5 crore', 'exact' FROM d
UNION ALL SELECT doc_id, 'Renewal term', (1 + doc_id % 36) || ' months', 'exact' FROM d UNION ALL SELECT doc_id, 'Email', 'u' || doc_id || '@mail.test', 'exact' FROM d""")
def labelled_answers(spark, sf_dir):
    """What a text made of each document by rule answers to the fields of a form; two of them have no value there."""
    tokens = {w for f in ASKED for w in values.words(f)}

    def run(batches):
        import pandas as pd

        for b in batches:
            out = [(i, f, a.value, a.how) for i, t in zip(b["doc_id"], b["text"], strict=True) for f in ASKED if (a := values.answer(t, f, tokens - set(values.words(f))))]
            yield pd.DataFrame(out, columns=["doc_id", "field", "value", "how"])

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id is not null").select("doc_id", F.expr(LABELLED).alias("text"))
    return rows.mapInPandas(run, "doc_id long, field string, value string, how string")


# ---- state: what is to be left out, made again or looked at

SCAFFOLD = ", ".join(f"({i}, '{n}')" for i, n in enumerate(inventory.scaffold()))


@registered(f"WITH {INVENTORY}, s(k, name) AS (VALUES {SCAFFOLD}), r AS (SELECT coalesce(name, rel) AS rel, sha1, doc_id FROM inv JOIN (SELECT rel, doc_id FROM docs) USING (rel) LEFT JOIN s ON k = doc_id) SELECT rel FROM r WHERE doc_id IS NULL OR doc_id NOT IN (SELECT k FROM s) OR doc_id % 2 = 1")
def scaffold_filter(spark, sf_dir):
    """The first documents stand for files of the engine's own; those with an odd number have been edited since."""
    d = corpus.documents(spark, sf_dir)
    names = spark.createDataFrame(list(enumerate(inventory.scaffold())), "k long, name string")
    rows = corpus.inventory(d).join(d.select("rel", "doc_id"), "rel").join(F.broadcast(names), F.col("doc_id") == F.col("k"), "left")
    now = rows.select(F.coalesce("name", "rel").alias("rel"), "sha1", "doc_id")
    written = now.filter("doc_id is not null").select("rel", F.when(F.col("doc_id") % 2 == 1, F.lit("other")).otherwise(F.col("sha1")).alias("sha1")).filter(F.col("rel").isin(*inventory.scaffold()))
    return inventory.without_scaffold(now, written).select("rel")


@registered(f"WITH {INVENTORY} SELECT rel FROM inv JOIN (SELECT rel, doc_id FROM docs) USING (rel) WHERE doc_id % 3 = 1")
def orphan_texts(spark, sf_dir):
    d = corpus.documents(spark, sf_dir).select("rel", "doc_id")
    return reports.orphans(d, d.filter("doc_id % 3 <> 1 or doc_id is null"))


@registered(f"WITH {INVENTORY}, e AS (SELECT rel, sha1, doc_id FROM inv JOIN (SELECT rel, doc_id FROM docs) USING (rel)) SELECT rel FROM e WHERE doc_id IS NULL OR doc_id % 4 <> 0 OR doc_id % 8 = 4 OR doc_id % 12 = 8")
def embed_work(spark, sf_dir):
    """Of a manifest made by rule every fourth document is known, half of them by another text, and a third with another model."""
    d = corpus.documents(spark, sf_dir)
    now = corpus.inventory(d).join(d.select("rel", "doc_id"), "rel").select("rel", "sha1", "doc_id")
    manifest = now.filter("doc_id % 4 = 0").select("rel", F.when(F.col("doc_id") % 8 == 4, F.sha1(F.col("sha1").cast("binary"))).otherwise(F.col("sha1")).alias("sha1"), F.when(F.col("doc_id") % 12 == 8, "other").otherwise("mine").alias("backend"))
    return vectors.to_embed(now, manifest, "mine").select("rel")


@registered(f"WITH {INVENTORY}, e AS (SELECT rel, doc_id FROM inv JOIN (SELECT rel, doc_id FROM docs) USING (rel)) SELECT rel FROM e WHERE doc_id % 8 = 0 AND doc_id % 12 <> 8")
def vectors_reused(spark, sf_dir):
    d = corpus.documents(spark, sf_dir)
    now = corpus.inventory(d).join(d.select("rel", "doc_id"), "rel").select("rel", "sha1", "doc_id")
    manifest = now.filter("doc_id % 4 = 0").select("rel", F.when(F.col("doc_id") % 8 == 4, F.sha1(F.col("sha1").cast("binary"))).otherwise(F.col("sha1")).alias("sha1"), F.when(F.col("doc_id") % 12 == 8, "other").otherwise("mine").alias("backend"))
    return vectors.reused(now.select("rel"), now, manifest, "mine")


@registered("WITH t AS (SELECT DISTINCT source AS f FROM documents WHERE source IS NOT NULL AND doc_id % 50 = 7), r AS (SELECT doc_id, list_sort(list(f)) AS folders FROM documents, t WHERE contains(coalesce(source, '') || ' ' || coalesce(lang, ''), f) AND doc_id IS NOT NULL GROUP BY doc_id) SELECT 'reports/' || (10 + doc_id % 80) || '_' || doc_id || '.md' AS rel, array_to_string(folders, ',') AS folders FROM r")
def stale_topics(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    curated = d.select(F.expr("'reports/' || (10 + doc_id % 80) || '_' || doc_id || '.md'").alias("rel"), F.expr("coalesce(source, '') || ' ' || coalesce(lang, '')").alias("text")).filter("rel is not null")
    changed = d.filter("doc_id % 50 = 7 and source is not null").select(F.col("source").alias("top_folder"))
    return reports.stale_reports(curated, changed).select("rel", F.array_join("folders", ",").alias("folders"))


@registered(f"WITH {INVENTORY} SELECT rel, doc_id % 100 <> 3 AS ok FROM (SELECT rel, doc_id, row_number() OVER (ORDER BY rel) - 1 AS k FROM inv JOIN (SELECT rel, doc_id FROM docs) USING (rel)) WHERE k % 5 = 0 AND doc_id IS NOT NULL")
def changed_hash_check(spark, sf_dir):
    """Each fifth file; of one in a hundred the recorded hash is another text's."""
    d = corpus.documents(spark, sf_dir).filter("doc_id is not null")
    recorded = corpus.inventory(d).join(d.select("rel", "doc_id"), "rel").select("rel", F.when(F.col("doc_id") % 100 == 3, F.sha1(F.col("sha1").cast("binary"))).otherwise(F.col("sha1")).alias("sha1"))
    return reports.hash_check(recorded, d, 5)
