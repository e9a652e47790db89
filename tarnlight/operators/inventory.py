"""Changes of a corpus between two inventories, and duplicates. Joins on path and hash; an empty hash equals none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unchanged(a: str, b: str) -> Column:
    """Rows of aliases ``a`` and ``b`` are one version: by hash if both have one, else by time and size."""
    col = lambda t, c: F.col(f"{t}.{c}")
    hashed = (F.coalesce(col(a, "sha1"), F.lit("")) != "") & (F.coalesce(col(b, "sha1"), F.lit("")) != "")
    return F.when(hashed, col(a, "sha1") == col(b, "sha1")).otherwise(col(a, "mtime_iso").eqNullSafe(col(b, "mtime_iso")) & col(a, "size").eqNullSafe(col(b, "size")))


def diff(now: DataFrame, before: DataFrame) -> DataFrame:
    """``rel, action, old_rel`` for each path: new, renamed, changed, unchanged, deleted or moved_away.

    A new path is renamed if its hash belonged to a path that is gone (``old_rel``: the first of these). A path that is gone
    is deleted only if its hash is nowhere now. Both inventories: ``rel, size, mtime_iso, sha1``.
    """
    both = now.alias("n").join(before.alias("b"), F.col("n.rel") == F.col("b.rel"), "full_outer")
    state = F.when(F.col("b.rel").isNull(), "new").when(F.col("n.rel").isNull(), "gone").when(F.coalesce(unchanged("n", "b"), F.lit(False)), "unchanged").otherwise("changed")
    rows = both.select(F.coalesce("n.rel", "b.rel").alias("rel"), F.coalesce("n.sha1", "b.sha1").alias("sha1"), state.alias("state"))
    hashed = F.coalesce("sha1", F.lit("")) != ""
    lost = rows.filter((F.col("state") == "gone") & hashed).groupBy("sha1").agg(F.min("rel").alias("old_rel"))
    kept = now.filter(hashed).select("sha1").distinct().withColumn("still", F.lit(True))
    rows = rows.join(lost, "sha1", "left").join(kept, "sha1", "left")
    action = F.when((F.col("state") == "new") & F.col("old_rel").isNotNull(), "renamed").when(F.col("state") != "gone", F.col("state")).when(F.col("still"), "moved_away").otherwise("deleted")
    return rows.select("rel", action.alias("action"), F.when((F.col("state") == "new"), F.col("old_rel")).alias("old_rel"))


def counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("action").agg(F.count("*").alias("n"))


def status(now: DataFrame, before: DataFrame) -> DataFrame:
    """``rel, bucket``: added, deleted or modified, by path, size and time alone."""
    added = now.join(before, "rel", "left_anti").select("rel", F.lit("added").alias("bucket"))
    gone = before.join(now, "rel", "left_anti").select("rel", F.lit("deleted").alias("bucket"))
    both = now.alias("n").join(before.alias("b"), "rel").filter(~(F.col("n.size").eqNullSafe(F.col("b.size")) & F.col("n.mtime_iso").eqNullSafe(F.col("b.mtime_iso"))))
    return added.unionByName(gone).unionByName(both.select("rel", F.lit("modified").alias("bucket")))


def reindex(now: DataFrame, indexed: DataFrame) -> DataFrame:
    """``rel, work``: add what isn't in the index as it is now, remove what is no longer there or has changed."""
    both = now.alias("n").join(indexed.alias("b"), F.col("n.rel") == F.col("b.rel"), "full_outer")
    stale = F.col("n.rel").isNotNull() & F.col("b.rel").isNotNull() & ~F.coalesce(unchanged("n", "b"), F.lit(False))
    work = F.when(F.col("b.rel").isNull(), F.array(F.lit("add"))).when(F.col("n.rel").isNull(), F.array(F.lit("remove"))).when(stale, F.array(F.lit("add"), F.lit("remove"))).otherwise(F.array().cast("array<string>"))
    return both.select(F.coalesce("n.rel", "b.rel").alias("rel"), F.explode(work).alias("work"))


def duplicates(rows: DataFrame, inbox: str = "Update/") -> DataFrame:
    """``rel, original``: files of the inbox whose content is elsewhere, with the first such path. The hot hash meets one row."""
    hashed = rows.filter(F.coalesce("sha1", F.lit("")) != "")
    originals = hashed.filter(~F.col("rel").startswith(inbox)).groupBy("sha1").agg(F.min("rel").alias("original"))
    return hashed.filter(F.col("rel").startswith(inbox)).join(originals, "sha1").select("rel", "original")


def scaffold(home: str = "evidence_home") -> tuple[str, ...]:
    """The files that the engine itself writes into a corpus."""
    return ("CLAUDE.md", "AGENTS.md", f"{home}/HANDOFF.md", f"{home}/00_MASTER_INDEX.md", f"{home}/Update/README.md", f"{home}/vision_notes/README.md")


def without_scaffold(rows: DataFrame, written: DataFrame, home: str = "evidence_home") -> DataFrame:
    """``rows(rel, sha1)`` without the engine's own files, as they say nothing about the corpus.

    One that was edited since, by ``written(rel, sha1)``, is its user's and stays. With nothing known of a file its name decides.
    """
    own = F.broadcast(written.filter(F.col("rel").isin(*scaffold(home))).groupBy("rel").agg(F.first("sha1").alias("_written")))  # six rows at most
    edited = F.coalesce(F.col("_written") != F.col("sha1"), F.lit(False))
    return rows.join(own, "rel", "left").filter(~F.col("rel").isin(*scaffold(home)) | edited).drop("_written")
