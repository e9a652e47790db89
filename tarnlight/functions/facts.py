"""Values as facts: amounts, comparison keys, how much weight a source's name carries. Native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that scale an amount, and by how much; the first that is there counts.
SCALES = ((r"crore|\bcr\b", 1e7), (r"lakh|\blac?\b", 1e5), (r"billion|\bbn\b", 1e9), (r"million|\bmn\b", 1e6), (r"\bk\b", 1e3))
#: How a date begins.
MONTHS = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
DATE = rf"(?i)^(?:\d{{1,2}}[/\-]\d{{1,2}}[/\-]\d{{2,4}}\b|\d{{4}}[/\-]\d{{1,2}}[/\-]\d{{1,2}}\b|\d{{1,2}}\s+{MONTHS}\s+\d{{2,4}}\b|{MONTHS}\s+\d+)"
#: Names of sources that weigh more, and less.
STRONG, WEAK = r"(?i)\b(executed|signed|final|amended|effective)\b", r"(?i)\b(draft|wip|working|superseded|archive|old)\b"


def amount(value: Column) -> Column:
    """The first number with its scale word, or null."""
    low = F.lower(F.regexp_replace(value, ",", ""))
    number = F.regexp_extract(low, r"\d+\.?\d*", 0)
    factor = F.lit(1.0)
    for pattern, by in reversed(SCALES):
        factor = F.when(low.rlike(pattern), F.lit(by)).otherwise(factor)
    signed = F.when(value.rlike(r"^\s*-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    return F.when(number != "", number.cast("double") * factor * signed)


def value_key(value: Column) -> Column:
    """``struct(kind, key)`` by which values are the same: dates by day, amounts by two decimals, else the text."""
    flat = F.lower(F.trim(F.regexp_replace(value, r"\s+", " ")))
    numeric = F.concat_ws("/", F.transform(F.split(flat, r"[/\-]"), lambda p: F.coalesce(p.cast("long").cast("string"), p)))
    date = F.when(flat.rlike(r"^\d{1,4}[/\-]\d{1,2}[/\-]\d{1,4}$"), numeric).otherwise(flat)
    n = amount(value)
    return F.when(F.trim(value).rlike(DATE), F.struct(F.lit("date").alias("kind"), date.alias("key"))).when(n.isNotNull(), F.struct(F.lit("num").alias("kind"), F.format_string("%.2f", F.round(n, 2)).alias("key"))).otherwise(F.struct(F.lit("txt").alias("kind"), flat.alias("key")))


def authority(source: Column) -> Column:
    """1 for a source whose name says final, -1 for a draft, else 0."""
    name = F.replace(source, F.lit("_"), F.lit(" "))
    return name.rlike(STRONG).cast("int") - name.rlike(WEAK).cast("int")
