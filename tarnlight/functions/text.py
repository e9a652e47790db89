"""Text functions as columns: cleaning, tokens, chunks, snippets. All of them stay in whole-stage codegen."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK, OVERLAP = 1800, 250
#: Words that say nothing about a task.
STOPWORDS = ("the", "and", "for", "with", "from", "this", "that", "all", "any", "our", "fill", "find", "form", "please", "using", "about", "what", "which", "name", "many", "much", "have", "does", "did")
WORD = r"[\p{L}\p{N}][\p{L}\p{N}_\-]*"
INDEX_WORD = r"[\p{L}\p{N}\p{M}\p{Co}]+"


def _folds() -> tuple[str, str]:
    """Letters with accents and their bare forms, from the canonical decomposition."""
    pairs = [(chr(c), bare) for c in (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)) if (d := unicodedata.normalize("NFD", chr(c))) != chr(c) and len(bare := "".join(x for x in d if not unicodedata.combining(x))) == 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, BARE = _folds()


def fold(text: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.regexp_replace(F.lower(text), r"\p{Mn}+", ""), ACCENTED, BARE)


def sanitized(text: Column) -> Column:
    """Without control characters, but for tab, line feed, form feed and carriage return."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0E-\x1F\x7F]", "")


def squeezed(text: Column) -> Column:
    """White space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def tokens(text: Column) -> Column:
    """Lower-cased words of two characters or more; hyphens and underscores stay inside."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower), lambda w: F.length(w) >= 2)


def index_terms(text: Column) -> Column:
    """Terms of the literal index: runs of letters and digits of the folded text (folding whole texts is far cheaper than each word)."""
    return F.regexp_extract_all(fold(text), F.lit(INDEX_WORD), F.lit(0))


def content_terms(text: Column) -> Column:
    return F.filter(tokens(text), lambda w: (F.length(w) >= 4) & ~w.isin(*STOPWORDS))


def token_cost(text: Column) -> Column:
    """Estimated tokens: a quarter of the characters, one at least for any text."""
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor((F.length(text) + 3) / 4).cast("int"))).cast("int")


def with_chunks(texts: DataFrame, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``rel, chunk_index, start_offset, end_offset, n_chunks, text``: overlapping windows over the squeezed text of ``texts(rel, text)``."""
    step = size - overlap
    flat = texts.select("rel", squeezed(F.col("text")).alias("whole")).withColumn("n", F.length("whole")).filter("n > 0")
    count = F.when(F.col("n") <= size, F.lit(1)).otherwise(F.ceil((F.col("n") - size) / step).cast("int") + 1)
    rows = flat.withColumn("n_chunks", count).select("rel", "whole", "n", "n_chunks", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("chunk_index"))
    start = F.col("chunk_index") * step
    return rows.select("rel", "chunk_index", start.alias("start_offset"), F.least(start + size, F.col("n")).alias("end_offset"), "n_chunks", F.substring("whole", start + 1, F.lit(size)).alias("text"))


def snippet(text: Column, query: Column, terms: Column, width: int = 260) -> Column:
    """A window around the whole query, else around the first of its terms, else from the start."""
    low, phrase = F.lower(text), F.lower(F.trim(query))
    whole = F.when(phrase != "", F.instr(low, phrase)).otherwise(0)
    first = F.array_min(F.filter(F.transform(terms, lambda t: F.instr(low, t)), lambda p: p > 0))
    at = F.when(whole > 0, whole).otherwise(F.coalesce(first, F.lit(1))) - 1
    start = F.greatest(F.lit(0), at - width // 3)
    return squeezed(F.substring(text, start + 1, F.lit(width)))


def trimmed(text: Column, limit: int = 360) -> Column:
    """The squeezed text; a longer one ends at its last blank within ``limit`` and an ellipsis."""
    flat = squeezed(text)
    cut = F.substring(flat, 1, limit)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.regexp_replace(cut, r" [^ ]*$", ""), F.lit(" …")))


def extension(rel: Column) -> Column:
    """Lower-cased file type with its dot, or empty."""
    return F.lower(F.regexp_extract(rel, r"[^/.][^/]*(\.[^./]+)$", 1))


def folder(rel: Column) -> Column:
    return F.when(rel.contains("/"), F.regexp_replace(rel, r"/[^/]*$", "")).otherwise(".")


def top_folder(rel: Column, home: str = "evidence_home") -> Column:
    """First segment of a path; two folders of the engine's own home go by their own names."""
    return F.when(rel.startswith(f"{home}/Update/"), "Update").when(rel.startswith(f"{home}/vision_notes/"), "vision_notes").when(rel.contains("/"), F.substring_index(rel, "/", 1)).otherwise("_root")


def in_folder(rel: Column, part: str) -> Column:
    """Whether a path has ``part`` anywhere, case aside; no character is special."""
    return F.lower(rel).contains(part.lower())


#: What people call file types.
EXTENSION_NAMES = {"ppt": ".pptx", "powerpoint": ".pptx", "deck": ".pptx", "slides": ".pptx", "doc": ".docx", "word": ".docx", "xls": ".xlsx", "excel": ".xlsx", "spreadsheet": ".xlsx", "markdown": ".md", "text": ".txt"}
#: File types with a reader.
TEXT_TYPES = (".txt", ".md", ".csv", ".json", ".html", ".htm", ".py", ".js", ".ts", ".tsx", ".css", ".yaml", ".yml", ".xml", ".log", ".bat", ".tex", ".rst")
OFFICE_TYPES = (".docx", ".pptx", ".xlsx", ".xlsm", ".pdf")
LEGACY_TYPES = (".doc", ".rtf")


def wanted_types(values) -> tuple[set[str], list[str]]:
    """File types to filter on, and those of ``values`` that name none (the caller should refuse them)."""
    good, bad = set(), []
    for value in values:
        name = value.strip().lower().lstrip("*").lstrip(".")
        kind = EXTENSION_NAMES.get(name, f".{name}")
        if kind in TEXT_TYPES + OFFICE_TYPES + LEGACY_TYPES:
            good.add(kind)
        else:
            bad.append(value)
    return good, bad
