"""State of an index in versioned folders: tables are written under ``v=N`` and count once ``N`` has its commit mark.

The mark is created exclusively, so of two writers of one version one fails; readers take the highest marked version, so a
run that breaks off leaves the old index as it was. All files go through the session's file system.

A table may lie in layers: the mark then names the versions that hold it, and beside each layer a table of the ``rel`` whose
rows in older layers it replaces. So an update writes what has changed, and a read leaves the replaced rows out. With
``MOST_LAYERS`` a table is to be written whole again.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession

SCHEMA, MOST_LAYERS = 2, 8


class StateError(RuntimeError):
    """State that can't be read or written."""


class State:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def versions(self) -> list[int]:
        """Committed versions, rising."""
        if not self._fs.exists(self._path("")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path("")) if s.isDirectory()]
        found = sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())
        return [v for v in found if self._fs.exists(self._path(f"v={v}/_COMMIT"))]

    def read(self, name: str, version: int | None = None) -> DataFrame:
        have = self.versions()
        if not have:
            raise StateError(f"{self.root} has no committed version")
        newest = version or have[-1]
        layers = self.meta(newest).get("layers", {}).get(name) or {"versions": [newest], "replaced": ""}
        return self.stacked(name, layers)

    def stacked(self, name: str, layers: dict) -> DataFrame:
        """The rows of a table that no later layer replaces. ``layers``: ``versions``, rising, and the table of replaced ``rel``."""
        table = lambda v, n: self.spark.read.parquet(f"{self.root}/v={v}/{n}")
        out, gone = None, None
        for v in reversed(layers["versions"]):
            rows = table(v, name)
            rows = rows if gone is None else rows.join(gone, "rel", "left_anti")
            out = rows if out is None else rows.unionByName(out)
            if v != layers["versions"][0]:
                mine = table(v, layers["replaced"]).select("rel").distinct()
                gone = mine if gone is None else gone.unionByName(mine).distinct()
        return out

    def next_layers(self, name: str, version: int, replaced: str, whole: bool) -> dict:
        """The layers of a table with ``version`` on top, or alone if it is written whole."""
        below = [] if whole else self.meta().get("layers", {}).get(name, {}).get("versions", [])
        return {"versions": [*below, version], "replaced": replaced}

    def full(self) -> bool:
        """Whether the tables have as many layers as they may have, or none that could be added to."""
        layers = self.meta().get("layers", {})
        return not layers or max(len(x["versions"]) for x in layers.values()) >= MOST_LAYERS

    def meta(self, version: int | None = None) -> dict:
        have = [version] if version else self.versions()
        if not have or version and not self._fs.exists(self._path(f"v={version}/_COMMIT")):
            return {}
        stream = self._fs.open(self._path(f"v={have[-1]}/_COMMIT"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def is_current(self) -> bool:
        """Whether the newest version was written by this schema; if not, derived tables are to be built anew."""
        return self.meta().get("schema") == SCHEMA

    def begin(self) -> int:
        """A new version's number: above all folders, committed or not."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(""))] if self._fs.exists(self._path("")) else []
        return max([0, *(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())]) + 1

    def write(self, version: int, name: str, df: DataFrame, sort: tuple[str, ...] = ()) -> DataFrame:
        """A table of a version that isn't committed yet; ``sort``: its order, for pruning by min and max.

        Ranges are cut by all columns of the order, so that a value with very many rows is spread over several files.
        """
        out = df.repartitionByRange(*sort).sortWithinPartitions(*sort) if sort else df
        out.write.mode("errorifexists").parquet(f"{self.root}/v={version}/{name}")
        return self.spark.read.parquet(f"{self.root}/v={version}/{name}")

    def commit(self, version: int, **meta) -> None:
        try:
            stream = self._fs.create(self._path(f"v={version}/_COMMIT"), False)
        except Exception as e:
            raise StateError(f"version {version} has been committed by another writer") from e
        stream.write(bytearray(json.dumps(meta | {"schema": SCHEMA, "at": time.time()}).encode()))
        stream.close()

    def append_history(self, df: DataFrame) -> None:
        """``action`` is the partition."""
        df.write.mode("append").partitionBy("action").parquet(f"{self.root}/history")

    def history(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/history")

    def compact(self) -> int:
        """Writes the newest version's layered tables whole, as a new version."""
        meta, version = self.meta(), self.begin()
        for name, layers in meta["layers"].items():
            self.write(version, name, self.stacked(name, layers))
        meta["layers"] = {name: layers | {"versions": [version]} for name, layers in meta["layers"].items()}
        self.commit(version, **{k: v for k, v in meta.items() if k not in ("schema", "at")})
        return version

    def drop_before(self, version: int) -> None:
        """Frees versions below ``version``; the newest committed one always stays, written whole if it needs an older one."""
        keep = max(self.versions(), default=version)
        if any(v < keep for x in self.meta().get("layers", {}).values() for v in x["versions"]):
            keep = version = self.compact()
        for s in list(self._fs.listStatus(self._path(""))):
            name = s.getPath().getName()
            if name.startswith("v=") and name[2:].isdigit() and int(name[2:]) < min(version, keep):
                self._fs.delete(s.getPath(), True)

    def drop(self) -> None:
        self._fs.delete(self._path(""), True)
