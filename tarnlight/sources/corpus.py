"""Corpora: tables of documents, pages and conversations, or a folder of files, as ``(rel, text)`` and an inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.functions import text as T

#: Files above are not hashed, and not extracted.
HASH_LIMIT, EXTRACT_LIMIT = 200 * 1024 * 1024, 50 * 1024 * 1024
#: Folders and files that no corpus holds.
SKIP_FOLDERS = ("node_modules", "__pycache__", "venv", "_indexes")
SKIP_FILES = (".DS_Store", "Thumbs.db", "desktop.ini", "Icon\r")


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores where a table has fewer splits than there are cores, such as a file of one row group.

    A table with as many splits or more, as any large one has, is read where it lies.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rel, doc_id, text`` of the table of documents; null parts of a path are ``_``, null texts stay null."""
    d = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang"))
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("_"))
    return d.select(F.concat(part("source"), F.lit("/"), part("lang"), F.lit("/doc_"), part("doc_id"), F.lit(".txt")).alias("rel"), "doc_id", "text")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as raw HTML files."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat(F.lit("pages/page_"), F.coalesce(F.col("page_id").cast("string"), F.lit("_")), F.lit(".html")).alias("rel"), "page_id", F.col("html").alias("text"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per conversation, its turns in order, a line each. A conversation is sorted within its own group."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    line = lambda x: F.concat(F.coalesce(x["role"], F.lit("")), F.lit(": "), F.coalesce(x["text"], F.lit("")))
    return t.groupBy("conv_id").agg(turns.alias("turns")).select(F.concat(F.lit("conversations/conv_"), F.coalesce(F.col("conv_id").cast("string"), F.lit("_")), F.lit(".txt")).alias("rel"), "conv_id", F.size("turns").alias("n_turns"), F.array_join(F.transform("turns", line), "\n").alias("text"))


def inventory(texts: DataFrame) -> DataFrame:
    """``rel, size, sha1, ext, folder, top_folder`` of a table of texts."""
    filled = F.coalesce("text", F.lit(""))
    size = F.octet_length(filled).cast("long")
    return texts.select("rel", size.alias("size"), F.when(size < HASH_LIMIT, F.sha1(filled.cast("binary"))).alias("sha1"), T.extension(F.col("rel")).alias("ext"), T.folder(F.col("rel")).alias("folder"), T.top_folder(F.col("rel")).alias("top_folder"))


def walk(files: DataFrame, root: str, skip: tuple[str, ...] = (), home: str = "evidence_home") -> DataFrame:
    """``files`` of ``binaryFile`` as ``rel, size, mtime, content``, without folders and files that no corpus holds.

    Of the engine's own ``home`` only ``Update/`` and ``vision_notes/`` count.
    """
    rel = F.regexp_replace(F.url_decode(F.regexp_replace(F.col("path"), r"\+", "%2B")), r"^\w+:/+", "/")
    base = "/" + root.split("://")[-1].removeprefix("file:").strip("/") + "/"
    rows = files.select(rel.alias("at"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")
    rows = rows.filter(F.col("at").startswith(base)).withColumn("rel", F.substring("at", len(base) + 1, F.length("at"))).drop("at")
    parts = F.split("rel", "/")
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    name = F.element_at(parts, -1)
    banned = F.exists(dirs, lambda s: s.isin(*SKIP_FOLDERS, *skip) | (s.startswith(".") & (s != home)))
    own = F.col("rel").startswith(f"{home}/") & ~F.col("rel").startswith(f"{home}/Update/") & ~F.col("rel").startswith(f"{home}/vision_notes/")
    odd = name.isin(*SKIP_FILES) | name.startswith("~$") | name.startswith(".")
    return rows.filter(~banned & ~own & ~odd).select("rel", "size", "mtime", "content")


def folder_files(spark: SparkSession, root: str, skip: tuple[str, ...] = ()) -> DataFrame:
    return walk(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root), root, skip)


def stat_rows(files: DataFrame) -> DataFrame:
    """The inventory of ``walk``: path, size, time in UTC, hash, type, folders.

    Large files are not hashed, and their branch asks for no content, so the source doesn't read it.
    """
    small, large = files.filter(F.col("size") < HASH_LIMIT), files.filter(F.col("size") >= HASH_LIMIT)
    return _stat(small, F.sha1("content")).unionByName(_stat(large, F.lit(None).cast("string")))


def _stat(files: DataFrame, sha1) -> DataFrame:
    return files.select("rel", "size", F.date_format("mtime", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("mtime_iso"), sha1.alias("sha1"), T.extension(F.col("rel")).alias("ext"), T.folder(F.col("rel")).alias("folder"), T.top_folder(F.col("rel")).alias("top_folder"))
