"""From candidates to evidence: which chunks count, conflicts between sources, packing into a budget, aliases.

All of it as DataFrames over candidates, which are few per query (a pool of 40, and 6 per field), for any number of queries.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlight.functions import facts, porter
from tarnlight.functions import text as T

FLOOR, LEAST_TOP, PER_SOURCE, RESERVE, EXCERPT = 0.15, 0.01, 2, 80, 360
FIELD_COST, EVIDENCE_COST = 6, 12
#: The alias table that comes with the engine.
STARTER_ALIASES = {
    "legal name": ["vendor", "supplier", "counterparty", "legal entity"], "governing law": ["jurisdiction", "governed by"], "effective date": ["commencement date", "start date"],
    "liability cap": ["limitation of liability", "maximum liability"], "termination": ["cancellation", "expiry"], "confidentiality": ["non-disclosure", "nda"],
}


def alias_groups(aliases: str | dict | None) -> list[list[str]]:
    """Groups of phrases that stand for each other, from JSON or a dict; what can't be read gives none."""
    if isinstance(aliases, str):
        try:
            aliases = json.loads(aliases)
        except ValueError:
            return []
    out = []
    for key, others in aliases.items() if isinstance(aliases, dict) else ():
        if isinstance(key, str) and isinstance(others, list):
            group = dict.fromkeys(p.strip().lower() for p in [key, *others] if isinstance(p, str) and re.search(r"[^\W_][\w\-]", p))
            if len(group) > 1:
                out.append(list(group))
    return out


def alias_table(spark: SparkSession, groups: list[list[str]]) -> DataFrame:
    """``group_id, phrase, stems``: as large as the alias file."""
    from tarnlight.functions.values import phrase_stems

    return spark.createDataFrame([(i, p, phrase_stems(p)) for i, g in enumerate(groups) for p in g], "group_id int, phrase string, stems array<string>")


def triggered(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """``query_id, group_id`` of ``queries(query_id, stems)``: all stems of one of a group's phrases are in the query."""
    hit = (F.size("p") > 0) & (F.size(F.array_except("p", "stems")) == 0)
    return queries.crossJoin(F.broadcast(aliases.select("group_id", F.col("stems").alias("p")))).filter(hit).select("query_id", "group_id").distinct()


def said_in(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """``rel, group_id`` of ``texts(rel, stems)``: a phrase of the group stands in the text, word after word. No word holds a blank."""
    line = lambda words: F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    phrases = aliases.filter(F.size("stems") > 0).select("group_id", line(F.col("stems")).alias("p"))
    return texts.select("rel", line(F.col("stems")).alias("line")).crossJoin(F.broadcast(phrases)).filter(F.col("line").contains(F.col("p"))).select("rel", "group_id").distinct()


def existing(candidates: DataFrame, terms: DataFrame) -> DataFrame:
    """Candidates that share a stem with their query's content terms; without any, those with a score.

    ``candidates(query_id, stems, score)``, ``terms(query_id, wanted)``.
    """
    rows = candidates.join(terms, "query_id", "left")
    none = F.coalesce(F.size("wanted"), F.lit(0)) <= 0
    return rows.filter(F.when(none, F.col("score") >= LEAST_TOP).otherwise(F.arrays_overlap("stems", "wanted"))).drop("wanted")


def missing_terms(terms: DataFrame, pool: DataFrame) -> DataFrame:
    """``query_id, term`` of ``terms(query_id, term, stem)`` that no candidate ``pool(query_id, stems)`` has."""
    return terms.join(pool.select("query_id", F.explode("stems").alias("stem")).distinct(), ["query_id", "stem"], "left_anti").select("query_id", "term").distinct()


def above_floor(candidates: DataFrame) -> DataFrame:
    """Candidates near their query's best score; a pinned one always stays, and so do all if the best is next to nothing."""
    top = F.max("score").over(Window.partitionBy("query_id"))
    pinned = F.col("pinned") if "pinned" in candidates.columns else F.lit(False)
    return candidates.withColumn("_top", top).filter((F.col("_top") <= LEAST_TOP) | (F.col("score") >= FLOOR * F.col("_top")) | pinned).drop("_top")


def per_source(candidates: DataFrame, order: list[Column], most: int = PER_SOURCE) -> DataFrame:
    return candidates.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "rel").orderBy(*order))).filter(F.col("_n") <= most).drop("_n")


def packed(candidates: DataFrame, order: list[Column], budget: int, used: int = RESERVE) -> DataFrame:
    """The candidates, in order, up to the first that exceeds the budget; the very first is packed in any case. ``cost`` is a column."""
    w = Window.partitionBy("query_id").orderBy(*order)
    rows = candidates.withColumn("used", F.lit(used) + F.sum("cost").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("place", F.row_number().over(w))
    over = F.min(F.when((F.col("used") > budget) & (F.col("place") > 1), F.col("place"))).over(Window.partitionBy("query_id"))
    return rows.withColumn("_over", over).filter(F.col("_over").isNull() | (F.col("place") < F.col("_over"))).drop("_over")


def packed_fields(fields: DataFrame, budget: int, used: int = RESERVE) -> DataFrame:
    """``query_id, place, label, packed, used`` of ``fields(query_id, place, label, cost, has_value)``, in order of place.

    A field that doesn't fit is dropped and the next is tried; the first answer is packed in any case. A form has 200 fields
    at most, so the fold runs over one array per form.
    """
    items = F.array_sort(F.collect_list(F.struct("place", "label", "cost", "has_value")))
    kind = "struct<used:bigint,some:boolean,rows:array<struct<place:int,label:string,packed:boolean,used:bigint>>>"

    def step(state, x):
        fits = (state["used"] + x["cost"] <= budget) | (~state["some"] & x["has_value"])
        after = state["used"] + F.when(fits, x["cost"]).otherwise(0)
        row = F.struct(x["place"].cast("int").alias("place"), x["label"].alias("label"), fits.alias("packed"), after.cast("bigint").alias("used"))
        return F.struct(after.cast("bigint").alias("used"), (state["some"] | fits).alias("some"), F.concat(state["rows"], F.array(row)).alias("rows")).cast(kind)

    start = F.struct(F.lit(used).cast("bigint").alias("used"), F.lit(False).alias("some"), F.array().cast("array<struct<place:int,label:string,packed:boolean,used:bigint>>").alias("rows")).cast(kind)
    out = fields.groupBy("query_id").agg(items.alias("items")).select("query_id", F.aggregate("items", start, step)["rows"].alias("rows"))
    return out.select("query_id", F.inline("rows"))


def conflicts(items: DataFrame, sources: DataFrame) -> DataFrame:
    """``key, value_kind, value_key, value, rel, line, place, authority``: facts with two or more values, each by its newest source, newest first.

    ``items(key, value, rel, line)``, ``sources(rel, mtime_iso)``. Ties of time go by the weight of the source's name, then the
    name. With a column ``by_kind`` that is true, values of different kinds are different facts.
    """
    rows = items.filter((F.coalesce("value", F.lit("")) != "") & F.col("key").isNotNull()).join(sources, "rel", "left")
    rows = rows.withColumn("k", facts.value_key(F.col("value"))).withColumn("newest", F.struct(F.coalesce("mtime_iso", F.lit("")).alias("t"), facts.authority(F.col("rel")).alias("a"), F.col("rel").alias("r"), F.col("value").alias("v"), F.col("line").alias("l")))
    rows = rows.withColumn("sort", F.when(F.col("by_kind"), F.col("k.kind")).otherwise("") if "by_kind" in rows.columns else F.lit(""))
    best = rows.groupBy("key", "sort", "k").agg(F.max("newest").alias("x"))
    w = Window.partitionBy("key", "sort")
    best = best.withColumn("n", F.count("*").over(w)).filter("n > 1").withColumn("place", F.row_number().over(w.orderBy(F.col("x").desc())))
    return best.select("key", F.col("k.kind").alias("value_kind"), F.col("k.key").alias("value_key"), F.col("x.v").alias("value"), F.col("x.r").alias("rel"), F.col("x.l").alias("line"), "place", F.col("x.a").alias("authority"))


def excerpt_cost(text: Column) -> Column:
    return T.token_cost(text) + EVIDENCE_COST


#: Characters of a label beside letters and digits, the most of them, and the least.
LABEL_MARKS, LONGEST_LABEL, SHORTEST_LABEL = " _/&'()-", 61, 2


def form_fields(forms: DataFrame, limit: int = 200) -> DataFrame:
    """``form_id, place, label`` of ``forms(form_id, text)``: lines ``Label:`` or ``Label ___``, repeats numbered.

    What stands before the first letter of a line may be bullets and numbers only, and the label ends at its first colon, or
    at an underscore that isn't followed by more of the label.
    """
    lines = forms.select("form_id", F.posexplode(F.split("text", r"\R|[\x1C-\x1E]")).alias("at", "line"))
    head = F.regexp_extract("line", r"(?U)^([\s\d\-*.)]*)", 1)
    rest = F.substring("line", F.length(head) + 1, F.length("line"))
    said = F.regexp_replace(F.substring_index(rest, ":", 1), r"_[_\s]*$", "")
    said = F.when(rest.contains(":"), said).when(rest.contains("_"), F.regexp_extract(rest, r"^([^_]*)_", 1)).otherwise("")
    label = F.regexp_replace(said, r"(?U)\s+$", "")
    odd = F.regexp_replace(F.translate(label, LABEL_MARKS, ""), r"[\p{L}\p{N}]", "") != ""
    fine = label.rlike(r"^\p{L}") & ~odd & F.length(label).between(SHORTEST_LABEL, LONGEST_LABEL)
    rows = lines.select("form_id", "at", F.when(fine, label).otherwise("").alias("label")).filter("label <> ''")
    again = F.row_number().over(Window.partitionBy("form_id", F.lower("label")).orderBy("at"))
    rows = rows.withColumn("n", again).withColumn("place", F.row_number().over(Window.partitionBy("form_id").orderBy("at")))
    return rows.filter(F.col("place") <= limit).select("form_id", "place", F.when(F.col("n") == 1, F.col("label")).otherwise(F.concat("label", F.lit(" #"), "n")).alias("label"))
