"""The index of a corpus: build and update it, search it, read fields from it, write a packet of evidence."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight import reachable
from tarnlight.functions import embed, porter, values
from tarnlight.functions import text as T
from tarnlight.operators import evidence, inventory, reports, search, vectors
from tarnlight.plans.state import State, StateError

POOL, FIELD_POOL = 40, 6
INVENTORY = ("rel", "size", "mtime_iso", "sha1", "ext", "folder", "top_folder")
TABLES = ("inventory", "texts", "chunks", "words", "stem_words", "lengths", "vectors")


@dataclass
class Report:
    version: int
    counts: dict[str, int]
    errors: dict[str, str] = field(default_factory=dict)
    #: Of the files that were read in this run.
    statuses: dict[str, int] = field(default_factory=dict)


class CorpusIndex:
    """``root``: a folder for state that all executors share. ``aliases``: JSON or a dict of phrases and their synonyms.

    ``scaffold``: hashes, by path, of the files that the engine wrote into the corpus itself; unchanged they are no evidence.
    """

    def __init__(self, spark: SparkSession, root: str, aliases: str | dict | None = None, embedder=embed.embedded, query_embedder=embed.embed, backend: str = embed.BACKEND, scaffold: dict[str, str] | None = None):
        reachable(spark)
        self.spark, self.state, self.groups = spark, State(spark, root), evidence.alias_groups(aliases)
        self.embedder, self.query_embedder, self.backend, self.scaffold = embedder, query_embedder, backend, scaffold or {}

    # ---- writing

    def sync(self, texts: DataFrame, stat: DataFrame | None = None, partial: bool = False) -> Report:
        """Brings the index up to ``texts(rel, text)``; ``stat``: their inventory with ``mtime_iso``, else made from the texts.

        ``texts`` may have ``status`` and ``detail`` of reading, which are kept; else a text is ``ok`` or ``empty``. Files that
        didn't change keep their chunks, words and vectors; what is made anew is written as a layer on the old tables, and
        counts when it is complete. ``partial``: files that aren't in ``texts`` stay as they are, and aren't looked at.
        """
        now = stat if stat is not None else inventory_of(texts)
        have = self.state.versions()
        fresh = not have or not self.state.is_current() or self.state.meta().get("backend") != self.backend
        if partial and fresh and have:
            old = self.state.read("texts")
            texts = with_status(texts).unionByName(with_status(old).join(texts.select("rel"), "rel", "left_anti"))
            now = now.select(*INVENTORY).unionByName(self.state.read("inventory").select(*INVENTORY).join(now.select("rel"), "rel", "left_anti"))
        whole = fresh or self.state.full()
        version = self.state.begin()
        now = self.state.write(version, "seen", now.select(*INVENTORY))
        before = now.limit(0) if not have else self.state.read("inventory")
        if partial and not fresh:
            before = before.join(now.select("rel"), "rel", "left_semi")
        changes = self.state.write(version, "changes", inventory.diff(now, before))
        counts = {r["action"]: r["n"] for r in inventory.counts(changes).collect()}  # six actions at most
        work = self.state.write(version, "work", inventory.reindex(now, before.limit(0) if fresh else before))
        todo = work.filter("work = 'add'").select("rel")
        layers = {}

        def joined(name: str, made: DataFrame, sort: tuple[str, ...] = (), replaced: str = "work") -> DataFrame:
            layers[name] = self.state.next_layers(name, version, replaced, whole)
            if whole and not fresh:
                stale = self.state.spark.read.parquet(f"{self.state.root}/v={version}/{replaced}").select("rel").distinct()
                made = made.unionByName(self.state.read(name).join(stale, "rel", "left_anti"))
            return self.state.write(version, name, made, sort)

        if partial and not fresh:
            joined("inventory", now, replaced="seen")
        else:
            layers["inventory"] = {"versions": [version], "replaced": "seen"}
            self.state.write(version, "inventory", now)
        new = with_status(texts).join(todo, "rel", "left_semi")
        joined("texts", new)
        mine = self.state.spark.read.parquet(f"{self.state.root}/v={version}/texts").join(todo, "rel", "left_semi")
        chunks = search.admitted(mine).select("rel", "chunk_index", "start_offset", "end_offset", "text").withColumn("tokens", T.token_cost(F.col("text"))).withColumn("has_value", values.value_flags("text"))
        joined("chunks", chunks)
        mine_chunks = self.state.spark.read.parquet(f"{self.state.root}/v={version}/chunks").join(todo, "rel", "left_semi")
        joined("words", search.terms_of(mine_chunks), ("term", "rel"))
        joined("stem_words", search.terms_of(mine_chunks, True), ("term", "rel"))
        joined("lengths", search.lengths(mine_chunks))
        report = Report(version, counts, statuses={r["status"]: r["count"] for r in mine.groupBy("status").count().collect()})  # five at most
        try:
            joined("vectors", vectors.build(mine, self.embedder, self.backend))
        except Exception as e:  # noqa: BLE001  words can be searched without vectors; the report names the failure
            report.errors["vectors"] = str(e)[:500]
            layers.pop("vectors", None)
        self.state.commit(version, backend=self.backend if not report.errors else "", layers=layers)
        moved = changes.filter("action not in ('unchanged', 'moved_away')")
        self.state.append_history(moved.withColumn("version", F.lit(version)))
        return report

    # ---- reading

    def table(self, name: str) -> DataFrame:
        return self.state.read(name)

    def spaces(self) -> tuple[search.Space, search.Space]:
        lengths = self.table("lengths")
        return search.Space(self.table("words"), lengths, False), search.Space(self.table("stem_words"), lengths, True)

    def search(self, queries: DataFrame, limit: int = 8, folder: str | None = None, ext: list[str] | None = None) -> DataFrame:
        """``query_id, rel, chunk_index, has_value, score, rank`` for a batch of ``queries(query_id, query)``."""
        return search.search(self.table("chunks"), queries, limit, folder, ext, flagged=True, spaces=self.spaces())

    def search_one(self, query: str, limit: int = 8, folder: str | None = None, ext: list[str] | None = None) -> list[dict]:
        """Hits with snippets; a miss in an index that isn't whole is an error."""
        terms = search.words_of(query)
        if not terms:
            raise search.EmptyQuery(query)
        hits = self.search(self.spark.createDataFrame([(0, query)], "query_id int, query string"), limit, folder, ext)
        rows = search.with_text(hits, self.table("chunks")).select("rank", "rel", "chunk_index", F.round("score", search.GRAIN).alias("score"), T.snippet(F.col("text"), F.lit(query), F.array(*map(F.lit, terms))).alias("snippet"))
        found = [r.asDict() for r in rows.orderBy("rank").collect()]  # at most limit
        if not found:
            self.refuse_if_broken()
        return found

    def refuse_if_broken(self) -> None:
        bad = self.health().filter("not ok and check_name <> 'no file failed'").collect()  # one row per check
        if bad or self.table("chunks").isEmpty():
            raise search.EmptyIndex("; ".join(f"{r['check_name']}: {r['detail']}" for r in bad) or "the index holds no chunks")

    def semantic(self, query: str, limit: int = 8, folder: str | None = None) -> DataFrame:
        if not search.words_of(query):
            raise search.EmptyQuery(query)
        return vectors.semantic_search(self.table("vectors"), query, limit, folder, embedder=self.query_embedder, lexical=self.backend == embed.BACKEND)

    def health(self) -> DataFrame:
        return reports.health({n: self.table(n) for n in ("texts", "chunks", "words", "stem_words", "inventory", "lengths")})

    def duplicates(self, inbox: str = "Update/") -> DataFrame:
        return inventory.duplicates(self.table("inventory"), inbox)

    # ---- evidence

    def candidates(self, queries: list[tuple[int, str, int]], folder: str | None = None, exclude: tuple[str, ...] = ()) -> pd.DataFrame:
        """Chunks for ``(query_id, text, pool)``: one plan for all of them; what comes to the driver is the pools."""
        extra = {i: sorted({s for g in self.triggered(q) for p in g for s in values.phrase_stems(p)}) for i, q, _ in queries}
        df = self.spark.createDataFrame([(i, " ".join([q, *extra[i]]), n) for i, q, n in queries], "query_id int, query string, pool int")
        hits = self.search(df.select("query_id", "query"), max(n for _, _, n in queries), folder).join(F.broadcast(df.select("query_id", "pool")), "query_id").filter("rank <= pool")
        rows = search.with_text(hits, self.table("chunks")).join(self.table("inventory").select("rel", "mtime_iso", "sha1"), "rel", "left").toPandas()
        own = [r in inventory.scaffold() and not (self.scaffold.get(r) and s and s != self.scaffold[r]) for r, s in zip(rows["rel"], rows["sha1"], strict=True)]
        rows = rows[~rows["rel"].isin(exclude) & ~pd.Series(own, index=rows.index, dtype=bool)].sort_values(["query_id", "rank"])
        wanted = {i: {porter.stem(t) for t in content(q)} | set(extra[i]) for i, q, _ in queries}
        keep = [bool(wanted[i] & {porter.stem(w) for w in values.words(t)}) if content(q := dict((a, b) for a, b, _ in queries)[i]) else s >= evidence.LEAST_TOP for i, t, s in zip(rows["query_id"], rows["text"], rows["score"], strict=True)]
        return rows[pd.Series(keep, index=rows.index, dtype=bool)]

    def triggered(self, query: str) -> list[list[str]]:
        own = set(values.phrase_stems(query))
        return [g for g in self.groups if any((p := set(values.phrase_stems(x))) and p <= own for x in g)]

    def packet(self, task: str, budget: int = 3000, fields: list[str] | None = None, folder: str | None = None, exclude: tuple[str, ...] = (), explain: bool = False) -> str:
        from tarnlight.plans.packet import Packet

        return Packet(self, task, budget, fields or [], folder, exclude).render(explain)


def content(task: str) -> list[str]:
    return [w for w in values.words(task) if len(w) >= 4 and w not in T.STOPWORDS]


def with_status(texts: DataFrame) -> DataFrame:
    """``rel, text, status, detail``: as given, else by whether there is a text."""
    status = F.when(F.length(T.squeezed(F.coalesce("text", F.lit("")))) > 0, "ok").otherwise("empty")
    return texts.select("rel", "text", F.col("status") if "status" in texts.columns else status.alias("status"), F.col("detail") if "detail" in texts.columns else F.lit("").alias("detail"))


def inventory_of(texts: DataFrame) -> DataFrame:
    from tarnlight.sources import corpus

    return corpus.inventory(texts).withColumn("mtime_iso", F.lit(None).cast("string"))


__all__ = ["TABLES", "CorpusIndex", "Report", "StateError", "content", "inventory_of"]
