"""Every registered query of the engine, by name, with its SQL where SQL can express it."""

from __future__ import annotations

from tarnlight.plans import queries as _all
from tarnlight.plans import stem_queries as _more  # noqa: F401  registers itself

flagship = _all.flagship


def queries():
    return dict(_all.queries)


def oracle_sql():
    return dict(_all.sql)
