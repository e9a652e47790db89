"""The engine at a terminal: ``python -m tarnlight STATE COMMAND ...``.

``STATE`` is the folder of an index; its settings (source folder, folders to skip, aliases, secrets) lie in
``STATE/settings.json`` and are written by ``init``. Files are read from the source folder alone: a path that leads out of it
is refused.
"""

from __future__ import annotations

import argparse
import json
import posixpath
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.operators import inventory, reports, search
from tarnlight.plans.corpus_index import CorpusIndex
from tarnlight.plans.packet import EmptyTask
from tarnlight.plans.state import StateError
from tarnlight.sources import corpus, readers


class Outside(ValueError):
    """A path outside the source folder."""


def confined(source: str, rel: str) -> str:
    """The path of ``rel`` below ``source``; an absolute path, or one that climbs out, is an error."""
    at = posixpath.normpath(rel)
    if at.startswith(("/", "..")) or "://" in rel:
        raise Outside(rel)
    return posixpath.join(source.rstrip("/"), at)


class Project:
    """An index with its settings."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/settings.json")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.settings: dict = {}
        if fs.exists(path):
            stream = fs.open(path)
            try:
                self.settings = json.loads(bytes(stream.readAllBytes()).decode())
            finally:
                stream.close()
        self._fs, self._path = fs, path
        self.index = CorpusIndex(spark, self.root, self.settings.get("aliases"), scaffold=self.settings.get("scaffold"))

    def init(self, source: str, skip: list[str], aliases: str | None, secrets: str | None) -> str:
        table = json.loads(open(aliases).read()) if aliases else None
        stream = self._fs.create(self._path, True)
        stream.write(bytearray(json.dumps({"source": source, "skip": skip, "aliases": table, "secrets": secrets}).encode()))
        stream.close()
        return f"{self.root}: an index of {source}"

    @property
    def source(self) -> str:
        if "source" not in self.settings:
            raise StateError(f"{self.root} has no settings: run init first")
        return self.settings["source"]

    def files(self, folder: str | None = None) -> DataFrame:
        files = corpus.folder_files(self.spark, self.source, tuple(self.settings.get("skip", ())))
        if folder:
            confined(self.source, folder)
            files = files.filter(F.col("rel").startswith(folder.strip("/") + "/"))
        return files

    def sync(self) -> str:
        secrets = readers.read_secrets(self.spark, self.settings["secrets"]) if self.settings.get("secrets") else {}
        files = self.files()
        report = self.index.sync(readers.extracted(files, secrets).select("rel", "text", "status", "detail"), corpus.stat_rows(files))
        said = [f"version {report.version}", *(f"{n} {action}" for action, n in sorted(report.counts.items())), *(f"{n} read as {status}" for status, n in sorted(report.statuses.items()))]
        return "\n".join(said + [f"{name}: {error}" for name, error in report.errors.items()])

    def status(self) -> DataFrame:
        """What has changed in the source folder since the last sync."""
        return inventory.status(corpus.stat_rows(self.files()), self.index.table("inventory")).orderBy("bucket", "rel")

    def dump(self, out: str, most: str) -> DataFrame:
        rows = self.index.table("texts").join(self.index.table("inventory").select("rel", "top_folder", "mtime_iso", "sha1"), "rel")
        reports.write_dumps(rows, out, reports.size_of(most))
        return reports.dump_manifest(rows)


def lines(df: DataFrame, limit: int) -> str:
    rows = df.limit(limit).collect()
    return "\n".join("\t".join("" if v is None else str(v) for v in r) for r in rows)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tarnlight", description=__doc__)
    p.add_argument("state")
    p.add_argument("--limit", type=int, default=50, help="lines of a listing")
    c = p.add_subparsers(dest="command", required=True)
    a = c.add_parser("init")
    a.add_argument("source")
    a.add_argument("--skip", nargs="*", default=[])
    a.add_argument("--aliases")
    a.add_argument("--secrets")
    for name in ("sync", "status", "doctor", "dedup", "history", "failed"):
        c.add_parser(name)
    a = c.add_parser("search")
    a.add_argument("query")
    a.add_argument("-n", type=int, default=8)
    a.add_argument("--folder")
    a.add_argument("--ext", nargs="*")
    a.add_argument("--semantic", action="store_true")
    a = c.add_parser("packet")
    a.add_argument("task")
    a.add_argument("--field", action="append", default=[])
    a.add_argument("--budget", type=int, default=3000)
    a.add_argument("--folder")
    a.add_argument("--explain", action="store_true")
    a = c.add_parser("dump")
    a.add_argument("out")
    a.add_argument("--most", default="1M", help="bytes of a part")
    a = c.add_parser("purge")
    a.add_argument("--all", action="store_true", help="the whole index, not only its old versions")
    return p


def run(project: Project, a: argparse.Namespace) -> tuple[str, int]:
    """What a command prints, and its exit code."""
    ix = project.index
    if a.command == "init":
        return project.init(a.source, a.skip, a.aliases, a.secrets), 0
    if a.command == "sync":
        return project.sync(), 0
    if a.command == "status":
        return lines(project.status(), a.limit), 0
    if a.command == "doctor":
        rows = ix.health().collect()  # a row a check
        return "\n".join(f"{'ok ' if r['ok'] else 'BAD'} {r['check_name']}: {r['detail']}" for r in rows), int(not all(r["ok"] for r in rows))
    if a.command == "dedup":
        return lines(ix.duplicates().orderBy("rel"), a.limit), 0
    if a.command == "history":
        return lines(ix.state.history().select("version", "action", "rel", "old_rel").orderBy(F.col("version").desc(), "action", "rel"), a.limit), 0
    if a.command == "failed":
        return lines(ix.table("texts").filter("status not in ('ok', 'empty')").select("rel", "status", "detail").orderBy("rel"), a.limit), 0
    if a.command == "search":
        if a.semantic:
            return lines(ix.semantic(a.query, a.n, a.folder), a.n), 0
        hits = ix.search_one(a.query, a.n, a.folder, a.ext)
        return "\n".join(f"{h['rank']}. {h['rel']} ·{h['chunk_index']} ({h['score']})\n   {h['snippet']}" for h in hits), int(not hits)
    if a.command == "packet":
        return ix.packet(a.task, a.budget, a.field, a.folder, explain=a.explain), 0
    if a.command == "dump":
        return lines(project.dump(a.out, a.most).orderBy("top_folder"), a.limit), 0
    if a.all:
        ix.state.drop()
        return f"{project.root}: gone", 0
    ix.state.drop_before(max(ix.state.versions(), default=0))
    return f"versions left: {ix.state.versions()}", 0


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    try:
        said, code = run(Project(spark or SparkSession.builder.appName("tarnlight").getOrCreate(), a.state), a)
    except (StateError, EmptyTask, Outside, search.EmptyQuery, search.EmptyIndex, ValueError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 2
    print(said)
    return code
