"""Variable-capacity best-fit packing of token sequences.

Each text has its tokens and one end mark. A text longer than the largest permitted length is cut into full pieces of that
length and a rest. Pieces are dealt by hash into regions of about ``REGION``, each packed by one task: by falling size,
a piece enters the open bin with the tightest remaining room; where none holds it, the least-cost permitted length is
opened, by cost a token that the bin can still expect. Several opening rules are tried in each region, the choice by cost
and one for each permitted length, and the cheapest packing is kept after every bin is downsized to the least permitted
length that holds its contents.

A bin of length ``c`` costs ``c + c * c / QUADRATIC``: its slots, and attention that grows with the square.

Defined results: null and empty texts have the end mark alone. Repeated rows and ids are packed each (``row`` tells them
apart). Ties of size go by row and piece. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import base64
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlight.llm.common import Scratch

CAPACITIES = (512, 1024, 2048, 4096, 8192)
REGION, QUADRATIC = 20_000, 65_536
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Free in the vocabulary, so it marks ends.
END = 50_256
#: Characters tokenized at once: longer texts are cut at white space between two words, which changes no token.
CHUNK = 1 << 20


@cache
def tokenizer(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str | None, path: str = VOCABULARY) -> list[int]:
    """Token ids of a whole text."""
    text, encoding = text or "", tokenizer(path)
    if len(text) <= CHUNK:
        return encoding.encode_ordinary(text)
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + CHUNK)
        # a chunk ends before a single space between two letters: there the pattern always begins a new token
        while end < len(text) and not (text[end] == " " and text[end - 1].isalpha() and text[end + 1 : end + 2].isalpha()):
            end += 1
        out += encoding.encode_ordinary(text[at:end])
        at = end
    return out


def lengths(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_tokens`` with the end mark."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(encode(x, vocabulary)) + 1 for x in b.column("text").to_pylist()], pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long")


def cost(capacity: int) -> float:
    return capacity + capacity * capacity / QUADRATIC


def best_fit(sizes: list[int], capacities: tuple[int, ...], opening: int | None) -> tuple[list[tuple[int, int]], list[int]]:
    """Bin and offset of each of ``sizes`` (falling), and the contents of each bin. ``opening``: the length to open, or by cost."""
    rooms: list[list[int]] = [[] for _ in range(capacities[-1] + 1)]
    open_rooms, fill, room, out = 0, [], [], []  # open_rooms: bit r set if a bin has room r
    rest = sum(sizes)
    for size in sizes:
        fits = open_rooms >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            k = rooms[r].pop()
            if not rooms[r]:
                open_rooms &= ~(1 << r)
        else:
            able = [c for c in capacities if c >= size]
            c = opening if opening and opening >= size else min(able, key=lambda c: cost(c) / min(c, rest))
            k, r = len(fill), c
            fill.append(0)
            room.append(c)
        out.append((k, fill[k]))
        fill[k] += size
        rest -= size
        if r > size:
            rooms[r - size].append(k)
            open_rooms |= 1 << (r - size)
    return out, fill


def pack(sizes: list[int], capacities=CAPACITIES) -> tuple[list[tuple[int, int]], list[int]]:
    """Bin and offset of each of ``sizes`` (falling, none above the largest capacity), and each bin's final capacity."""
    capacities, best = tuple(sorted(capacities)), None
    for opening in (None, *capacities):
        out, fill = best_fit(sizes, capacities, opening)
        final = [next(c for c in capacities if c >= f) for f in fill]
        total = sum(map(cost, final))
        if best is None or total < best[0]:
            best = (total, out, final)
    return best[1], best[2]


def packed(docs: DataFrame, capacities=CAPACITIES, vocabulary: str = VOCABULARY, region: int = REGION, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, row, piece, start, n_tokens, bin, bin_capacity, bin_offset: one row per piece of ``docs(doc_id, text)``."""
    scratch = scratch or Scratch(docs.sparkSession, "packing")
    largest = max(capacities)
    rows = scratch.save(lengths(docs, vocabulary).withColumn("row", F.monotonically_increasing_id()), "lengths")
    pieces = rows.select("doc_id", "row", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_tokens") - 1) / largest))).alias("piece"))
    pieces = pieces.select("doc_id", "row", "piece", (F.col("piece") * largest).alias("start"), F.least(F.lit(largest).cast("long"), F.col("n_tokens") - F.col("piece") * largest).alias("n_tokens"))
    regions = max(1, -(-pieces.count() // region))

    def pack_region(t: pa.Table) -> pa.Table:
        t = t.sort_by([("n_tokens", "descending"), ("row", "ascending"), ("piece", "ascending")])
        out, final = pack(t.column("n_tokens").to_pylist(), capacities)
        first = t.column("region")[0].as_py() << 32
        cols = {c: t.column(c) for c in ("doc_id", "row", "piece", "start", "n_tokens")}
        return pa.table(cols | {"bin": pa.array([first + k for k, _ in out], pa.int64()), "bin_capacity": pa.array([final[k] for k, _ in out], pa.int64()), "bin_offset": pa.array([o for _, o in out], pa.int64())})

    return pieces.withColumn("region", F.pmod(F.xxhash64("row", "piece"), F.lit(regions).cast("long"))).groupBy("region").applyInArrow(pack_region, "doc_id long, row long, piece long, start long, n_tokens long, bin long, bin_capacity long, bin_offset long")


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
