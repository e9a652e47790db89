"""The Porter stemmer as SQL, for the SQL that stands beside queries with stems: a chain of common table expressions."""

from __future__ import annotations

from tarnlight.functions.porter import STEP_2, STEP_3, STEP_4


def _shape(w: str) -> str:
    """``c`` and ``v`` for each letter; y is a consonant at the start, after a vowel and after a letter that isn't ASCII."""
    marked = rf"regexp_replace({w}, '(^|[aeiou]|[^\x00-\x7f])y', '\1Y', 'g')"
    return rf"replace(regexp_replace(regexp_replace({marked}, '[aeiouy]', '♦', 'g'), '[\x00-\x7f]', 'c', 'g'), '♦', 'v')"


def _part(k: int, of: str = "w") -> str:
    return f"substr({of}, 1, length(w) - {k})"


def _rules(rules: dict[str, str], measured: str) -> str:
    """The longest suffix of ``rules`` replaced where what stays is measured."""
    whens = []
    for end in sorted(rules, key=len, reverse=True):
        fits = f"regexp_matches({_part(len(end), 'sh')}, '{measured}')" + (f" AND regexp_matches({_part(3)}, '[st]$')" if end == "ion" else "")
        whens.append(f"WHEN ends_with(w, '{end}') THEN CASE WHEN {fits} THEN {_part(len(end))} || '{rules[end]}' ELSE w END")
    return f"CASE {' '.join(whens)} ELSE w END"


def stems(name: str, source: str, guarded: bool) -> str:
    """Expressions that end in ``name(word, stem)`` for the different ``word`` of ``source``."""
    able = "length(low) > 2" + (" AND regexp_full_match(low, '[a-z]+')" if guarded else "")
    once, twice = "vc", "vc.*vc"
    last, before = "right(part, 1)", "substr(part, length(part) - 1, 1)"
    shaped = "substr(sh, 1, length(part))"
    double = f"(length(part) > 1 AND {last} = {before} AND right({shaped}, 1) = 'c' AND {last} NOT IN ('l', 's', 'z'))"
    one = f"(contains({shaped}, '{once}') AND NOT regexp_matches({shaped}, '{twice}'))"
    short = f"(ends_with({shaped}, 'cvc') AND {last} NOT IN ('w', 'x', 'y'))"
    steps = [
        f"SELECT DISTINCT word, lower(word) AS low FROM {source}",
        f"SELECT word, low, CASE WHEN NOT ({able}) THEN NULL WHEN ends_with(low, 'sses') OR ends_with(low, 'ies') THEN substr(low, 1, length(low) - 2) WHEN ends_with(low, 's') AND NOT ends_with(low, 'ss') THEN substr(low, 1, length(low) - 1) ELSE low END AS w FROM {{}}",
        f"SELECT *, {_shape('w')} AS sh FROM {{}}",
        f"SELECT *, CASE WHEN ends_with(w, 'eed') THEN NULL WHEN ends_with(w, 'ed') AND contains({_part(2, 'sh')}, 'v') THEN {_part(2)} WHEN ends_with(w, 'ing') AND contains({_part(3, 'sh')}, 'v') THEN {_part(3)} END AS part FROM {{}}",
        f"SELECT word, low, CASE WHEN part IS NULL THEN CASE WHEN ends_with(w, 'eed') AND contains({_part(3, 'sh')}, '{once}') THEN {_part(1)} ELSE w END WHEN regexp_matches(part, '(at|bl|iz)$') OR NOT {double} AND {one} AND {short} THEN part || 'e' WHEN {double} THEN substr(part, 1, length(part) - 1) ELSE part END AS w FROM {{}}",
        f"SELECT word, low, CASE WHEN ends_with(w, 'y') AND contains({_part(1, _shape('w'))}, 'v') THEN {_part(1)} || 'i' ELSE w END AS w FROM {{}}",
        *(f"SELECT word, low, {_rules(rules, measured)} AS w FROM (SELECT *, {_shape('w')} AS sh FROM {{}})" for rules, measured in ((STEP_2, once), (STEP_3, once), (STEP_4, twice))),
        f"SELECT word, low, CASE WHEN ends_with(w, 'e') AND (regexp_matches({_part(1, 'sh')}, '{twice}') OR contains({_part(1, 'sh')}, '{once}') AND NOT (ends_with({_part(1, 'sh')}, 'cvc') AND right({_part(1)}, 1) NOT IN ('w', 'x', 'y'))) THEN {_part(1)} ELSE w END AS w FROM (SELECT *, {_shape('w')} AS sh FROM {{}})",
        f"SELECT word, coalesce(CASE WHEN ends_with(w, 'll') AND regexp_matches(sh, '{twice}') THEN {_part(1)} ELSE w END, low) AS stem FROM (SELECT *, {_shape('w')} AS sh FROM {{}})",
    ]
    names = [*(f"{name}_{i}" for i in range(len(steps) - 1)), name]
    return ", ".join(f"{n} AS ({s.format(before)})" for n, s, before in zip(names, steps, ["", *names], strict=False))
