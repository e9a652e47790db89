"""A PySpark-native engine that turns a corpus of documents into ranked, cited evidence."""

from __future__ import annotations

import os


def reachable(spark) -> None:
    """Lets Python workers that share this machine's files import the package, from whatever folder the driver runs.

    On a cluster whose nodes have no copy of it, ship it with ``--py-files`` or ``spark.sparkContext.addPyFile``.
    """
    root, known = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        known["PYTHONPATH"] = os.pathsep.join([*paths, root])
