"""Removal of every repeated 200-byte string, by prefix-free parsing.

A rolling hash picks triggers: of the ``GRAM``-byte grams in a ``LENGTH``-byte window the one with the least hash, the
rightmost of equals. The choice depends on the window's own bytes, so equal windows have equal triggers at equal offsets
wherever they stand. Consecutive windows with one trigger make up a phrase: trigger, first and last window, and a hash of
all bytes they span. The dictionary of phrases and the parse of each text into them then decide, without looking at single
bytes, nearly everything:

* a trigger gram that occurs once: none of the phrase's windows repeats;
* a phrase that occurs twice or more: all of its windows repeat;
* else (a gram that occurs in different phrases, at the ends of repeated passages): the phrases' suffixes are ordered. One
  copy of each phrase is fetched with its bytes, those of a gram meet in one block, and their 200-byte suffixes are sorted;
  equal neighbours repeat. A gram with over ``CROWD`` different phrases isn't met in one block: its suffixes are
  counted one by one by key, which no crowd makes large.

What repeats of a phrase covers one run of bytes, since every window holds the trigger. Suffixes are ordered by 64-bit
hashes within a block instead of by bytes: only equality over 200 bytes matters here, and the order of hashes brings equal
ones together just as the lexical order would, in linear memory. (A suffix array over dictionary and parse of all texts
would need an order over the whole corpus, which no task could hold.)

Defined results: a null text is empty. Texts under ``LENGTH`` bytes keep everything. Equal texts, also of one repeated
row, repeat each other. Very long texts are parsed in tiles of ``TILE`` bytes, whose windows overlap, with the same result.
Repeated ids are kept as rows. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlight.llm.common import Scratch, bounded, fresh

LENGTH, GRAM = 200, 100
TILE = 1 << 18
#: Phrases to a block, and different phrases of one gram that may meet in a block.
BLOCK, CROWD = 5_000, 2_500

_rng = np.random.default_rng(20_011)
_VALUE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C13
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``_BASE`` to the powers 0 to n - 1, and their inverses mod 2**64."""
    if not _powers or len(_powers[0]) < n:
        m = max(n, TILE + LENGTH)
        _powers[:] = [np.multiply.accumulate(np.array([1] + [b] * (m - 1), np.uint64)) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Hashes:
    """Hashes of any substrings of one buffer, from sums of prefixes."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(max(1, len(data) + 1))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.add.accumulate(_VALUE[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def all(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return mixed((self.sums[width:] - self.sums[:n]) * self.down[:n])


def phrases(pieces: list[bytes], limits: list[int], length: int = LENGTH, gram: int = GRAM):
    """Phrases of the windows that start before ``limits[i]`` in ``pieces[i]``: piece, trigger, first and last window, gram, hash."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    begin = np.cumsum(sizes) - sizes
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    hashes = Hashes(data)
    grams = hashes.all(gram)
    low = np.uint64((1 << 24) - 1)
    least = (grams & ~low) | (low - np.arange(len(grams), dtype=np.uint64))
    span, width = length - gram + 1, 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    at = (low - (least & low)).astype(np.int64)  # the trigger of each window
    n = np.clip(np.minimum(sizes - length + 1, limits), 0, None)
    ok = np.zeros(len(at) + 1, np.int8)
    np.add.at(ok, begin[n > 0], 1)
    np.add.at(ok, (begin + n)[n > 0], -1)
    starts = np.flatnonzero(np.cumsum(ok[:-1], dtype=np.int8))
    if not len(starts):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    piece = np.searchsorted(begin, starts, "right") - 1
    # empty pieces share their begin with the next one
    trigger = at[starts]
    new = np.flatnonzero(np.concatenate(([True], (trigger[1:] != trigger[:-1]) | (piece[1:] != piece[:-1]))))
    first, last = starts[new], starts[np.concatenate((new[1:] - 1, [len(starts) - 1]))]
    t, piece = trigger[new], piece[new]
    whole = hashes.of(first, last + length)
    whole = mixed(whole ^ ((t - first) * 256 + (last - first)).astype(np.uint64))
    return piece, t - begin[piece], first - begin[piece], last - begin[piece], grams[t], whole


def tiles(texts, size: int = TILE, length: int = LENGTH):
    """Lists of ``(row, offset, bytes, limit)`` with about ``size`` bytes together; a longer text comes in overlapping tiles."""
    held, total = [], 0
    for row, text in texts:
        for offset in range(0, max(1, len(text) - length + 1), size):
            part = text[offset : offset + size + length - 1]
            if len(part) < length:
                continue
            if held and total + len(part) > size + length:
                yield held
                held, total = [], 0
            held.append((row, offset, part, size))
            total += len(part)
    if held:
        yield held


def with_key(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` as bytes, and a 128-bit key of the text in two longs."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.cast("binary").alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"))


PHRASE = "k1 long, k2 long, place long, gram long, phrase long"


def parse(docs: DataFrame) -> DataFrame:
    """The parse of each text: ``k1, k2, place, gram, phrase``. place: trigger * 2**16 + its distance from the first window * 2**8 + from the first to the last."""

    def run(batches):
        for b in batches:
            texts, k1, k2 = b.column("text"), b.column("k1").to_numpy(), b.column("k2").to_numpy()
            for held in tiles((i, texts[i].as_py()) for i in range(len(texts))):
                piece, t, first, last, gram, whole = phrases([h[2] for h in held], [h[3] for h in held])
                row, offset = np.array([h[0] for h in held])[piece], np.array([h[1] for h in held], np.int64)[piece]
                place = ((t + offset) << 16) | ((t - first) << 8) | (last - first)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k1[row], k2[row], place, gram.view(np.int64), whole.view(np.int64))], ["k1", "k2", "place", "gram", "phrase"])

    return docs.select("text", "k1", "k2").mapInArrow(run, PHRASE)


def unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigger, first and last window of places."""
    t = place >> 16
    first = t - ((place >> 8) & 255)
    return t, first, first + (place & 255)


def repeated_suffixes(table: pa.Table) -> pa.Table:
    """The phrases of whole grams with their bytes: from the first repeated window to the end of the last, where there is one."""
    place, size = table.column("place").to_numpy(), LENGTH
    owner, start, value = suffixes(table)
    order = np.argsort(value)
    v = value[order]
    same = np.concatenate((v[1:] == v[:-1], [False]))
    same[1:] |= same[:-1].copy()
    hit = order[same]
    lo, hi = np.full(len(place), 1 << 62), np.full(len(place), -1)
    np.minimum.at(lo, owner[hit], start[hit])
    np.maximum.at(hi, owner[hit], start[hit])
    found = np.flatnonzero(hi >= 0)
    return pa.table({"k1": table.column("k1").to_numpy()[found], "k2": table.column("k2").to_numpy()[found], "s": lo[found], "e": hi[found] + size})


def suffixes(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every window of every phrase: its row, its start in the text, and the hash of its bytes with the gram."""
    place, grams = table.column("place").to_numpy(), table.column("gram").to_numpy().view(np.uint64)
    _, first, last = unpacked(place)
    n = last - first + 1
    sizes = n + LENGTH - 1
    begin = np.cumsum(sizes) - sizes
    hashes = Hashes(np.frombuffer(b"".join(x.as_py() for x in table.column("bytes")), np.uint8))
    owner = np.repeat(np.arange(len(n)), n)
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = begin[owner] + inner
    return owner, first[owner] + inner, mixed(hashes.of(at, at + LENGTH) ^ grams[owner])


def fetch(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``k1, k2, place, gram, bytes`` of ``wanted(k1, k2, place, gram)``. Each different text travels once, compressed."""

    def squeeze(batches):
        z = zstandard.ZstdCompressor(3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), pa.array([z.compress(x.as_py()) for x in b.column("text")], pa.binary())], ["k1", "k2", "z"])

    def cut(batches):
        z = zstandard.ZstdDecompressor()
        for b in batches:
            for i in range(len(b)):
                text, asked = z.decompress(b.column("z")[i].as_py()), b.column("asked")[i].values
                place = asked.field("place")
                _, first, last = unpacked(place.to_numpy())
                n = len(place)
                yield pa.RecordBatch.from_arrays([pa.array([b.column(k)[i].as_py()] * n, pa.int64()) for k in ("k1", "k2")] + [place, asked.field("gram"), pa.array([text[s : e + LENGTH] for s, e in zip(first.tolist(), last.tolist(), strict=True)], pa.binary())], ["k1", "k2", "place", "gram", "bytes"])

    texts = docs.select("k1", "k2", "text").mapInArrow(squeeze, "k1 long, k2 long, z binary").groupBy("k1", "k2").agg(F.first("z").alias("z"))
    asked = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("place", "gram")).alias("asked"))  # of one text: bounded by its length
    return texts.join(asked, ["k1", "k2"]).select("k1", "k2", "z", "asked").mapInArrow(cut, "k1 long, k2 long, place long, gram long, bytes binary")


def repeats(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``k1, k2, spans`` array of ``(s, e)``: the bytes to remove of each text that has any. ``docs``: as of ``with_key``."""
    parsed = scratch.save(parse(docs), "parse")
    # the dictionary, by gram: how often, and whether in more than one phrase
    grams = parsed.groupBy("gram").agg(F.count("*").alias("n"), F.min("phrase").alias("p"), F.max("phrase").alias("q")).filter("n > 1").select("gram", (F.col("p") != F.col("q")).alias("mixed"))
    again = scratch.save(parsed.join(scratch.save(grams, "grams"), "gram"), "again")
    scratch.drop(parsed)
    entries = scratch.save(again.filter("mixed").groupBy("gram", "phrase").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "place")).alias("one")).select("gram", "phrase", "n", "one.*"), "dictionary")
    entire = again.filter("not mixed").select("k1", "k2", "place").unionByName(again.filter("mixed").join(bounded(entries.filter("n > 1").select("gram", "phrase")), ["gram", "phrase"]).select("k1", "k2", "place"))
    first = F.shiftright("place", 16) - F.shiftright("place", 8).bitwiseAND(255)
    sure = entire.select("k1", "k2", first.alias("s"), (first + F.col("place").bitwiseAND(255) + LENGTH).alias("e"))

    crowds = scratch.save(entries.groupBy("gram").count().filter(F.col("count") > CROWD).select("gram"), "crowds")
    known = scratch.save(fetch(docs, entries.select("k1", "k2", "place", "gram")), "fetched")
    blocks = max(1, -(-entries.count() // BLOCK))
    few = known.join(crowds, "gram", "left_anti").groupBy(F.pmod(F.xxhash64("gram"), F.lit(blocks).cast("long")).alias("block")).applyInArrow(repeated_suffixes, "k1 long, k2 long, s long, e long")
    spans = sure.unionByName(few)
    if not crowds.isEmpty():

        def single(batches):
            for b in batches:
                owner, start, value = suffixes(pa.table(b))
                yield pa.RecordBatch.from_arrays([b.column("k1").take(pa.array(owner)), b.column("k2").take(pa.array(owner)), pa.array(start), pa.array(value.view(np.int64))], ["k1", "k2", "s", "suffix"])

        many = scratch.save(known.join(crowds, "gram", "left_semi").select("k1", "k2", "place", "gram", "bytes").mapInArrow(single, "k1 long, k2 long, s long, suffix long"), "suffixes")
        twice = many.groupBy("suffix").count().filter("count > 1").select("suffix")
        spans = spans.unionByName(many.join(twice, "suffix").select("k1", "k2", "s", (F.col("s") + LENGTH).alias("e")))
    # copies of a text have the same spans: once is enough, and no text gets more than its length allows
    return spans.distinct().groupBy("k1", "k2").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def kept(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of a text, bytes removed, maximal runs removed."""
    parts, done, removed, runs, end = [], 0, 0, 0, -1
    for s, e in sorted(spans):
        if s > end:
            if end >= 0:
                removed += end - begin
            parts.append(text[done if end < 0 else end : s])
            begin, end, runs = s, e, runs + 1
        else:
            end = max(end, e)
    if end < 0:
        return text, 0, 0
    return b"".join([*parts, text[end:]]), removed + end - begin, runs


def remove(docs: DataFrame, scratch: Scratch | None = None, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of ``docs(doc_id, text)``; with ``texts`` also ``kept`` (bytes).

    ``kept`` may end or begin within a character, since strings are judged as bytes.
    """
    scratch = scratch or Scratch(docs.sparkSession, "suffixes")
    docs = with_key(docs)
    spans = scratch.save(repeats(docs, scratch), "spans")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts

    def squeeze(batches):
        z = zstandard.ZstdCompressor(3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("k1"), b.column("k2"), pa.array([z.compress(x.as_py()) for x in b.column("text")], pa.binary())], ["doc_id", "k1", "k2", "z"])

    def run(batches):
        z = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for x, y in zip(b.column("z"), b.column("spans"), strict=True):
                text = z.decompress(x.as_py())
                left, removed, runs = kept(text, list(zip(y.values.field("s").to_pylist(), y.values.field("e").to_pylist(), strict=True)) if y.is_valid else [])
                out.append((len(text), removed, runs, hashlib.sha256(left).hexdigest(), *[left] * texts))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, zip(*out, strict=True))], [x.split()[0] for x in schema.split(", ")])

    rows = docs.withColumn("doc_id", F.col("doc_id").cast("long")).select("doc_id", "k1", "k2", "text").mapInArrow(squeeze, "doc_id long, k1 long, k2 long, z binary")
    return rows.join(spans, ["k1", "k2"], "left").select("doc_id", "z", "spans").mapInArrow(run, schema)


def cleaned(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """All columns of ``docs``, text and n_chars after removal; rows of which nothing is left go, unless they were empty before."""
    k1, k2, found = fresh(docs, "k1", "k2", "spans")
    spans = scratch.save(repeats(with_key(docs), scratch).toDF(k1, k2, found), "spans")
    text = F.coalesce("text", F.lit(""))
    rows = docs.withColumn(k1, F.xxhash64(text)).withColumn(k2, F.xxhash64(F.lit(1), text)).join(spans, [k1, k2], "left")

    @F.pandas_udf("string")
    def left(texts, spans):
        import pandas as pd

        return pd.Series([None if t is None else kept(t.encode(), [(x["s"], x["e"]) for x in y])[0].decode("utf-8", "ignore") for t, y in zip(texts, spans, strict=True)], dtype=object)

    same = rows.filter(F.col(found).isNull()).select(*docs.columns)
    changed = rows.filter(F.col(found).isNotNull()).withColumn("text", left("text", found)).filter("text <> ''").withColumn("n_chars", F.length("text").cast("long"))
    return same.unionByName(changed.select(*docs.columns))


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
