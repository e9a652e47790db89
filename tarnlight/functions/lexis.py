"""Chunks and terms once more, over Python strings: for operators that look at every word of a corpus in Arrow batches.

Each function gives what its namesake in ``functions.text`` gives as a column; tests hold one against the other. A table of
code points turns what is no part of a word into blanks, so a text is cut by two calls into C. For texts of ASCII that is
some ten times as fast as the columns' expressions. Letters younger than the JVM's tables (Unicode 13 in Java 17) are letters
here and none there; one mark that was moved to another class since, U+1734, is held where it was.
"""

from __future__ import annotations

import re
import unicodedata

from tarnlight.functions import text as T

#: White space of ``text.squeezed``; Python's own has four separators more.
SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
ODD_SPACE = "\x1c\x1d\x1e\x1f"


class Kept(dict):
    """Code point to what stays of it, filled as code points turn up."""

    def __init__(self, keep):
        self.keep = keep

    def __missing__(self, point: int):
        self[point] = out = self.keep(chr(point))
        return out


_BARE = dict(zip(T.ACCENTED, T.BARE, strict=True))


def _of_term(c: str) -> str:
    kind = unicodedata.category(c)
    return "" if kind == "Mn" or c == "\u1734" else _BARE.get(c, c) if kind[0] in "LNM" or kind == "Co" else " "


_TERM = Kept(_of_term)
_RUN = Kept(lambda c: c if c.isalnum() else " ")
_WORD = Kept(lambda c: c if c in "_-" or unicodedata.category(c)[0] in "LN" else " ")


def squeezed(text: str) -> str:
    if any(c in text for c in ODD_SPACE):
        return SPACE.sub(" ", text).strip(" ")
    return " ".join(text.split())


def windows(text: str | None, size: int = T.CHUNK, overlap: int = T.OVERLAP) -> list[str]:
    """The chunks of a text; their places in the list are their numbers."""
    whole, step = squeezed(text or ""), size - overlap
    n = len(whole)
    return [whole[at : at + size] for at in range(0, 1 + max(0, -(-(n - size) // step)) * step, step)] if n else []


def cut(text: str, table: Kept) -> str:
    """``text`` with each character as ``table`` has it."""
    if text.isascii():
        return text.translate(table)
    for c in set(text):  # few different ones: each is replaced at the speed of a search
        if (kept := table[ord(c)]) != c:
            text = text.replace(c, kept)
    return text


def folded(text: str) -> str:
    """Lower case without accents, with blanks for all that is no part of a term."""
    return cut(text.lower(), _TERM)


def index_terms(text: str) -> list[str]:
    return folded(text).split()


def tokens(text: str) -> list[str]:
    # lower case looks at neighbours, so it is made word by word
    words = cut(text.lower(), _WORD).split() if text.isascii() else [w.lower() for w in cut(text, _WORD).split()]
    if "_" in text or "-" in text:
        words = [w.lstrip("_-") for w in words]
    return [w for w in words if len(w) >= 2]


def runs(text: str) -> list[str]:
    """Runs of what Python counts as letters and digits, in small letters."""
    return cut(text.lower(), _RUN).split()
