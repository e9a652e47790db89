"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has 64 bits over the XXH64 (seed 42) of a text's word shingles. Two fingerprints within ``radius`` bits
share a variant that lies within half the radius of both, so every fingerprint emits all its variants up to that distance
(2,081 at radius 4) and equal variants meet. What is shuffled is not each variant but each different prefix of them: a
row ``(prefix, flips left, fingerprint)`` stands for all variants of the fingerprint with that prefix, which the receiving
task unfolds, sorts and drops again. Fingerprints under one variant are linked in a star and each link is verified. Nothing
is lost: any two fingerprints at one variant are within the radius, so the star joins what all pairs would join.

The prefix length follows the number of fingerprints so that a prefix has about ``WEIGHT`` variants. A prefix with over
four times that, such as a crowd of near copies, is refined by further bits until it is small; at 64 bits only one
variant is left, which at most 2,081 different fingerprints share.

Defined results: a null or empty text, or one of white space, has no words and fingerprint zero, linked like any other.
Texts with fewer words than a shingle have one shingle, the whole sequence. Equal texts have equal fingerprints and are
linked. Repeated rows and ids are kept; a component's id is its smallest doc_id that isn't null. An empty table gives no
rows. Extra columns are not read.
"""

from __future__ import annotations

import math
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlight.llm.common import Scratch, components

SEED = 42
WEIGHT = 1_000_000
STEP = 6


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """XXH64 of each word shingle of a UTF-8 text, in order, repeats included."""
    words = (text or b"").lower().split()  # bytes: A-Z alone are lowered, and white space is x20 and x09 to x0D
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, len(words) - k + 1)


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text."""
    hashes = shingle_hashes(text, shingle)
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        counts += np.unpackbits(hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``doc_id, fp`` (the bits as a signed long) of each row of ``docs(doc_id, text)``."""

    def run(batches):
        for b in batches:
            texts = b.column("text").cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


@cache
def flips(width: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks of up to ``most`` of the low ``width`` bits, with their numbers of bits."""
    out = [(sum(1 << i for i in c), n) for n in range(min(most, width) + 1) for c in combinations(range(width), n)]
    return np.array([m for m, _ in out], np.uint64), np.array([n for _, n in out], np.int64)


def weight(width: int, left: int) -> int:
    return sum(math.comb(width, n) for n in range(left + 1))


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index reachable from each of ``n`` by links ``a``-``b``."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        keep = la != lb
        if not keep.any():
            break
        a, b, la, lb = a[keep], b[keep], la[keep], lb[keep]
        least = np.minimum(la, lb)
        np.minimum.at(label, la, least)
        np.minimum.at(label, lb, least)
        while (label != label[label]).any():
            label = label[label]
    return label


def meet(fps: np.ndarray, left: np.ndarray, width: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of the fingerprints of one prefix: unfold the variants over the low ``width`` bits, sort, verify."""
    low = fps & np.uint64((1 << width) - 1)
    parts, owners = [], []
    for n in np.unique(left):
        at = np.flatnonzero(left == n)
        masks = flips(width, int(n))[0]
        parts.append((low[at][:, None] ^ masks[None, :]).ravel())
        owners.append(np.repeat(at.astype(np.int32), len(masks)))
    values, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.argsort(values)
    values, owner = values[order], owner[order]
    same = np.concatenate(([False], values[1:] == values[:-1]))
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(values))))
    a, b = owner[same], owner[first[same]]
    a, b = np.divmod(np.unique(np.maximum(a, b).astype(np.int64) * len(fps) + np.minimum(a, b)), len(fps))
    near = np.bitwise_count(fps[a] ^ fps[b]) <= radius
    label = roots(len(fps), a[near], b[near])
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return fps[moved], fps[label[moved]]


def meeting(width: int, radius: int):
    def group(table: pa.Table) -> pa.Table:
        a, b = meet(table.column("fp").to_numpy().view(np.uint64), table.column("left").to_numpy(), width, radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return group


def unfolded(rows: DataFrame, old: int, new: int, half: int, total: int = 64) -> DataFrame:
    """Prefixes of ``old`` bits of ``total`` made ``new`` bits long: each row becomes one for each way to spend its flips there."""
    masks, bits = flips(new - old, half)
    table = F.array(*[F.struct(F.lit(int(m)).cast("long").alias("mask"), F.lit(int(n)).alias("cost")) for m, n in zip(masks, bits, strict=True)])
    own = F.shiftrightunsigned("fp", total - new).bitwiseAND((1 << (new - old)) - 1) if new < total else F.col("fp").bitwiseAND((1 << (new - old)) - 1)
    rest = [c for c in rows.columns if c not in ("key", "left")]
    rows = rows.select("key", "left", *rest, F.explode(table).alias("v")).filter("v.cost <= left")
    key = F.shiftleft("key", new - old).bitwiseOR(own.bitwiseXOR(F.col("v.mask")))
    return rows.select(key.alias("key"), (F.col("left") - F.col("v.cost")).alias("left"), *rest)


def links(fps: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """``(a, b)`` over different ``fps(fp)``: enough verified links within ``radius`` to join what all of them join."""
    half = -(-radius // 2)
    n = fps.count()
    bits = max(4, min(24, math.ceil(math.log2(max(1, n) * weight(64, half) / WEIGHT))))
    rows = unfolded(fps.select(F.lit(0).cast("long").alias("key"), F.lit(half).alias("left"), "fp"), 0, bits, half)
    found = None
    while True:
        width = 64 - bits
        cost = F.element_at(F.array(*[F.lit(weight(width, i)).cast("long") for i in range(half + 1)]), F.col("left") + 1)
        hot = rows.groupBy("key").agg(F.sum(cost).alias("w")).filter(F.col("w") > 4 * WEIGHT).select("key")
        hot = scratch.save(hot, "hot")
        any_hot = bits < 64 and hot.count()
        cool = rows.join(hot, "key", "left_anti") if any_hot else rows

        here = cool.groupBy("key").applyInArrow(meeting(width, radius), "a long, b long")
        if not any_hot:
            return here if found is None else found.unionByName(here)
        here = scratch.save(here, "links")
        found = here if found is None else found.unionByName(here)
        step = min(STEP, 64 - bits)
        rows = scratch.save(unfolded(rows.join(hot, "key", "left_semi"), bits, bits + step, half), "refined")
        bits += step


def groups(docs: DataFrame, shingle: int = 4, radius: int = 4, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, fp, component_id for each row of ``docs(doc_id, text)``."""
    scratch = scratch or Scratch(docs.sparkSession, "simhash")
    return grouped(scratch.save(fingerprints(docs, shingle), "fingerprints"), radius, scratch)


def grouped(prints: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """``prints`` with component_id."""
    each = scratch.save(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    joined = scratch.save(links(each.select("fp"), radius, scratch), "links")
    found = scratch.save(components(joined, scratch), "components")
    each = each.join(found, each.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = each.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(each.select("fp", "root").join(ids, "root").select("fp", "component_id"), "fp").select(*prints.columns, "component_id")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return groups(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
