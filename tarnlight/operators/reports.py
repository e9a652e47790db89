"""Reports on a corpus and its state: dumps, coverage, queue of files without text, health."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnlight.functions import text as T

LINE, LOW_TEXT = "=" * 80, 300
#: Paths, taken by hash, by which a list of files is cut into ranges.
CUTS = 4_096
IMAGES = (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tif", ".tiff", ".webp", ".heic")


def size_of(text: str) -> int:
    """Bytes of ``10``, ``1.5K``, ``2M`` or ``1G``."""
    text = text.strip().upper()
    power = "KMG".find(text[-1:]) + 1 if text else 0
    return int(float(text[:-1]) * 1024**power) if power else int(text)


def dump_entries(rows: DataFrame) -> DataFrame:
    """``top_folder, rel, entry, bytes`` of ``rows(rel, top_folder, mtime_iso, sha1, text)``; files without text are left out."""
    head = F.concat(F.lit(f"\n\n{LINE}\nFILE: "), F.col("rel"), F.lit("\nMTIME: "), F.coalesce("mtime_iso", F.lit("")), F.lit("\nSHA1: "), F.substring(F.coalesce("sha1", F.lit("")), 1, 12), F.lit(f"\n{LINE}\n"))
    entry = F.concat(head, F.regexp_replace("text", r"(?U)^\s+|\s+$", ""), F.lit("\n"))
    return rows.filter(F.coalesce("text", F.lit("")) != "").select("top_folder", "rel", entry.alias("entry")).withColumn("bytes", F.octet_length("entry").cast("long"))


def dump_parts(entries: DataFrame, most: int) -> DataFrame:
    """``top_folder, rel, bytes, part``: files in order of path, a new part where the next would exceed ``most`` bytes.

    Where a part ends depends on all before it in the folder, so sizes alone are folded, in order, folder by folder; texts
    don't travel.
    """

    def fold(batches):
        import pandas as pd

        folder, part, filled = None, 1, 0
        for b in batches:
            parts = []
            for top, size in zip(b["top_folder"], b["bytes"], strict=True):
                if top != folder:
                    folder, part, filled = top, 1, 0
                if filled and filled + size > most:
                    part, filled = part + 1, 0
                filled += size
                parts.append(part)
            yield pd.DataFrame({"top_folder": b["top_folder"], "rel": b["rel"], "bytes": b["bytes"], "part": parts})

    sizes = entries.select("top_folder", "rel", "bytes")
    return sizes.repartition("top_folder").sortWithinPartitions("top_folder", "rel").mapInPandas(fold, "top_folder string, rel string, bytes long, part int")


def write_dumps(rows: DataFrame, out: str, most: int) -> None:
    """Text files below ``out``, a folder for each top folder and part: the entries of ``dump_entries`` in order of path.

    A part is written by one task and has at most ``most`` bytes, or one entry.
    """
    entries = dump_entries(rows)
    placed = entries.join(dump_parts(entries, most).select("top_folder", "rel", "part"), ["top_folder", "rel"])
    parts = placed.repartition("top_folder", "part").sortWithinPartitions("top_folder", "part", "rel")
    parts.select("top_folder", "part", F.regexp_replace("entry", r"\n$", "").alias("value")).write.partitionBy("top_folder", "part").text(out)


def dump_manifest(rows: DataFrame) -> DataFrame:
    """``top_folder, files_dumped, skipped, bytes`` of ``rows(top_folder, text, ...)``."""
    has = F.coalesce("text", F.lit("")) != ""
    entries = dump_entries(rows).groupBy("top_folder").agg(F.sum("bytes").alias("bytes"))
    return rows.groupBy("top_folder").agg(F.count_if(has).alias("files_dumped"), F.count_if(~has).alias("skipped")).join(entries, "top_folder", "left").select("top_folder", "files_dumped", "skipped", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))


def coverage(rows: DataFrame) -> DataFrame:
    """``bucket, n`` of ``rows(ext, status, text)``: empty before failed, cached, skipped and missing."""
    bucket = F.when(F.col("status") == "empty", "empty").when(F.col("status") == "failed", "failed").when(F.coalesce("text", F.lit("")) != "", "cached").when(F.col("status") == "skipped", "skipped").otherwise("missing")
    return rows.filter(F.col("ext").isin(*T.TEXT_TYPES, *T.OFFICE_TYPES)).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def every_nth(rows: DataFrame, n: int = 50) -> DataFrame:
    """Each nth row in order of path, the first included, for rows of one path each.

    Ranges of paths are cut by quantiles that are known before rows are counted, so counting and numbering, though run apart,
    see the same ranges.
    """
    cuts = rows.select(F.xxhash64("rel").alias("h"), "rel").orderBy("h").limit(CUTS).select("rel").distinct().agg(F.array_sort(F.collect_list("rel")).alias("cuts"))
    cuts = [c for i, c in enumerate(cuts.first()[0]) if i % 64 == 0]
    at = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<string>")
    ordered = rows.withColumn("range", F.size(F.filter(at, lambda c: c <= F.col("rel"))))
    before = ordered.groupBy("range").agg(F.count("*").alias("c"))
    before = before.select("range", (F.sum("c").over(Window.orderBy("range")) - F.col("c")).alias("start"))  # a row per range
    place = F.row_number().over(Window.partitionBy("range").orderBy("rel")) - 1
    return ordered.withColumn("place", place).join(F.broadcast(before), "range").filter((F.col("start") + F.col("place")) % n == 0).drop("range", "place", "start")


def hash_check(rows: DataFrame, texts: DataFrame, n: int = 50) -> DataFrame:
    """``rel, ok`` of each nth row: whether its recorded hash is that of its text now."""
    return every_nth(rows, n).join(texts.select("rel", F.sha1(F.coalesce("text", F.lit("")).cast("binary")).alias("now")), "rel", "left").select("rel", F.coalesce(F.col("now") == F.col("sha1"), F.lit(False)).alias("ok"))


def vision_queue(rows: DataFrame, noted: DataFrame | None = None) -> DataFrame:
    """``rel, reason, status``: images, decks with pictures and files with little text, of ``rows(rel, ext, text, status, pictures)``."""
    stripped = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", ""))
    low = stripped < LOW_TEXT
    reason = F.when(F.col("ext").isin(*IMAGES), "image-file").when(F.col("ext") == ".pptx", F.when(F.col("pictures") > 0, "ppt-embedded-images")).when((F.col("ext") == ".pdf") & low, "pdf-low-or-no-text").when(F.col("ext").isin(*T.TEXT_TYPES, *T.OFFICE_TYPES) & low, "file-low-or-no-text")
    out = rows.filter(F.coalesce("status", F.lit("")) != "skipped").select("rel", reason.alias("reason")).filter("reason is not null")
    if noted is None:
        return out.withColumn("status", F.lit("pending"))
    return out.join(noted.select("rel").distinct().withColumn("done", F.lit(True)), "rel", "left").select("rel", "reason", F.when(F.col("done"), "done").otherwise("pending").alias("status"))


def orphans(stored: DataFrame, expected: DataFrame) -> DataFrame:
    return stored.join(expected, "rel", "left_anti").select("rel")


def stale_reports(curated: DataFrame, changed: DataFrame) -> DataFrame:
    """``rel, folders``: curated files (``NN_*.md``) that name a top folder with changes. Folders are words of paths: few."""
    tops = changed.select(F.col("top_folder").alias("f")).distinct().agg(F.collect_set("f").alias("all"))
    rows = curated.filter(F.col("rel").rlike(r"(^|/)\d\d_[^/]*\.md$")).crossJoin(F.broadcast(tops))
    return rows.select("rel", F.array_sort(F.filter("all", lambda f: F.col("text").contains(f))).alias("folders")).filter(F.size("folders") > 0)


def health(tables: dict[str, DataFrame]) -> DataFrame:
    """``check_name, ok, detail`` of an index with ``texts, chunks, words, stem_words, inventory, lengths``: nothing lost between them, nothing left over."""
    chunks, texts, stat = tables["chunks"], tables["texts"], tables["inventory"]
    with_words = chunks.filter(F.size(T.index_terms(F.col("text"))) > 0)
    chunk, rel = ["rel", "chunk_index"], ["rel"]
    missing = {
        "every text has chunks": (texts.filter(F.length(T.squeezed(F.coalesce("text", F.lit("")))) >= 3), chunks, rel), "every chunk has its text": (chunks, texts, rel),
        "every chunk is in words": (with_words, tables["words"], chunk), "every chunk is in stem_words": (with_words, tables["stem_words"], chunk), "every chunk has a length": (chunks, tables["lengths"], chunk),
        "every word has its chunk": (tables["words"], chunks, chunk), "every file was read": (stat, texts, rel), "every text is of a file": (texts, stat, rel),
    }
    counts = {name: left.join(right.select(*keys).distinct(), keys, "left_anti") for name, (left, right, keys) in missing.items()}
    counts |= {"no file twice": stat.groupBy("rel").count().filter("count > 1"), "no chunk twice": chunks.groupBy(*chunk).count().filter("count > 1"), "no file failed": texts.filter("status = 'failed'")}
    rows = [rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("check_name"), "n") for name, rows in counts.items()]
    return reduce(DataFrame.unionByName, rows).select("check_name", (F.col("n") == 0).alias("ok"), F.concat("n", F.lit(" found")).alias("detail"))
