"""Hashed embeddings: words, word pairs and character grams, each at a place and with a sign of its hash."""

from __future__ import annotations

import hashlib
import math
import re
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tarnlight.functions import lexis

WIDTH, BACKEND = 384, "local-hash-v1"


class EmbeddingError(ValueError):
    """A vector that can't be used."""


#: Characters of a word, the length of a gram and the step from gram to gram.
SAID, GRAM, STRIDE = lexis.Kept(lambda c: c if c in "abcdefghijklmnopqrstuvwxyz0123456789_-" else " "), 5, 3
#: Places of features that a worker keeps, of each kind; texts that are embedded at once; bits of a code point of a gram.
KNOWN, TEXTS, BITS = 200_000, 500, 12


def words(low: str) -> list[str]:
    return [w for x in lexis.cut(low, SAID).split() if len(w := x.lstrip("_-")) > 1]


def grams(line: str) -> list[str]:
    return [line[i : i + GRAM] for i in range(0, len(line) - GRAM + 1, STRIDE)]


class _Places(dict):
    """Where a feature counts, with its sign: by an eight-byte BLAKE2b, whose tenth bit is the sign. Positive ones come after the negative."""

    def __missing__(self, feature: str) -> int:
        h = int.from_bytes(hashlib.blake2b(feature.encode("utf-8", "ignore"), digest_size=8).digest())
        if len(self) >= KNOWN:
            self.clear()
        self[feature] = out = h % WIDTH + WIDTH * (h >> 9 & 1)
        return out


class _GramPlaces(_Places):
    """The same by a gram's code points, ``BITS`` each."""

    def __missing__(self, key: int) -> int:
        if len(self) >= KNOWN:
            self.clear()
        self[key] = out = _Places.__missing__(_once, "".join(chr(key >> BITS * k & (1 << BITS) - 1) for k in range(GRAM)))
        _once.clear()
        return out


_said, _pairs, _grams, _once = _Places(), _Places(), _GramPlaces(), _Places()


def gram_places(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Line and place of each gram of ``lines``, whose code points all fit into ``BITS``."""
    n = np.fromiter(map(len, lines), np.int64, len(lines))
    points = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32).astype(np.int64)
    many = np.maximum(0, (n - GRAM) // STRIDE + 1)
    row = np.repeat(np.arange(len(lines)), many)
    at = np.repeat(np.cumsum(n) - n, many) + STRIDE * (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
    key = sum(points[at + k] << BITS * k for k in range(GRAM))
    different, which = np.unique(key, return_inverse=True)
    return row, np.fromiter(map(_grams.__getitem__, different.tolist()), np.int64, len(different))[which]


def embed_all(texts: list[str]) -> np.ndarray:
    """A row a text, of its words, pairs of words that follow each other, and grams in small letters and single blanks.

    Longer features weigh up to four times. Each component sums words, pairs and grams in their order.
    """
    lists, plain = [], []
    for row, text in enumerate(texts):
        said, line = words(low := text.lower()), re.sub(r"\s+", " ", low)
        wide = not line.isascii() and ord(max(line)) >> BITS
        if not wide:
            plain.append((row, line))
        lists.append((said, list(map("_".join, pairwise(said))), grams(line) if wide else []))
    flat = [x for three in lists for some in three for x in some]
    at = [np.fromiter(map(known.__getitem__, some), np.int64, len(some)) for three in lists for some, known in zip(three, (_said, _pairs, _said), strict=True)]
    size = np.fromiter(map(len, flat), np.int64, len(flat))
    row = np.repeat(np.arange(len(lists)), [sum(map(len, three)) for three in lists])
    if plain:
        line, place = gram_places([x for _, x in plain])
        at, row, size = [*at, place], np.append(row, np.array([r for r, _ in plain])[line]), np.append(size, np.full(len(place), GRAM))
    place = np.concatenate(at) if at else np.zeros(0, np.int64)
    weight = np.where(place >= WIDTH, 1, -1) * (1 + np.minimum(3, size / 12))
    total = np.bincount(row * WIDTH + place % WIDTH, weight, len(lists) * WIDTH).reshape(len(lists), WIDTH)
    norm = np.array([math.sqrt(math.fsum(r)) or 1.0 for r in (total * total).tolist()])
    return np.round(total / norm.reshape(-1, 1), 6)


def embed(text: str) -> list[float]:
    return embed_all([text])[0].tolist()


@F.arrow_udf(ArrayType(DoubleType()))
def embedded(texts: pa.Array) -> pa.Array:
    """Vectors as one table of numbers, never as lists of Python's; null for null."""
    parts = []
    for at in range(0, len(texts), TEXTS):
        some = texts.slice(at, TEXTS)
        flat = embed_all([t or "" for t in some.to_pylist()]).reshape(-1)
        ends = pa.array(np.arange(len(some) + 1) * WIDTH, pa.int32())
        parts.append(pa.ListArray.from_arrays(ends, pa.array(flat), mask=some.is_null()))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float64()))


def with_embedder(embedder):
    """A column function of a caller's own model: ``embedder`` takes and gives a pandas series."""
    return F.pandas_udf(embedder, ArrayType(DoubleType()))


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision; a longer vector's surplus doesn't count."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def valid(v: Column, width: int | None = None) -> Column:
    """Whether a vector has components, all of them numbers, and the width asked for."""
    fine = F.coalesce(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    return fine & (F.size(v) == width) if width else fine


def checked(v: Column, width: int | None = None) -> Column:
    """The vector, or an error of the job."""
    return F.when(valid(v, width), v).otherwise(F.raise_error(F.lit("an embedding is empty, not finite or of another width")))
