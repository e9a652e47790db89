"""Near-duplicate embeddings by a forest of random-projection trees.

Vectors are compared within a label. Equal vectors count as one, with their number. In each of ``TREES`` trees a node is
split at the median of the projections on a random direction; vectors within ``SPILL`` of the median, by rank, go to both
sides. Nodes above ``CELL`` vectors are split by DataFrame steps, one level at a time, smaller ones within a task, down to
``LEAF``. Projections that tie, as those of unit vectors along one line do, are ranked by a hash, so every split makes both
sides smaller; the shared vectors of a tied node join its sides. Within a leaf all vectors are compared by cosine in double precision, and what is linked is joined; only a tree
of links leaves the task. The union of all trees gives the components.

Links are then counted within components, so that a pair which no tree put into a leaf still counts, and no pair is ever
emitted: small components at once, large ones by angles to their centre. A member whose angle and the greatest angle sum
up to no more than the threshold's is linked to all; the others are compared with all members in blocks.

Two components that no tree joined stay apart: that is the method's approximation (recall against brute force is tested).

Defined results: a row with a null label or id, or a vector that is null, empty, zero or holds null or non-finite
components, has no links and is its own component. Vectors of unequal lengths are not compared. Repeated rows link to each
other. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlight.llm.common import Scratch, components
from tarnlight.llm.simhash import roots

THRESHOLD, TREES, LEAF, SPILL, CELL, BLOCK, GRAIN = 0.93, 8, 128, 0.1, 8_192, 1_024, 2.0**-28


def matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors of an array column whose rows have one length."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    m = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def direction(seed: int, width: int) -> np.ndarray:
    return np.random.default_rng(seed & (1 << 63) - 1).normal(size=width)


def tree_links(m: np.ndarray, seed: int, threshold: float, leaf: int = LEAF, spill: float = SPILL) -> np.ndarray:
    """The root of each row of ``m`` after one tree."""
    n, stack = len(m), [(np.arange(len(m)), seed)]
    a, b = [], []
    while stack:
        ids, s = stack.pop()
        if len(ids) <= leaf:
            i, j = np.nonzero(np.triu(m[ids] @ m[ids].T >= threshold, 1))
            label = roots(len(ids), i, j)
            moved = np.flatnonzero(label != np.arange(len(ids)))
            a.append(ids[moved])
            b.append(ids[label[moved]])
            continue
        order = ids[np.argsort(m[ids] @ direction(s, m.shape[1]), kind="stable")]
        half, more = len(ids) // 2, math.ceil(len(ids) * spill)
        stack += [(order[: half + more], s * 2 + 1), (order[half - more :], s * 2 + 2)]
    return roots(n, np.concatenate(a), np.concatenate(b))


def links_of(threshold: float):
    def group(table: pa.Table) -> pa.Table:
        r = table.column("r").to_numpy()
        label = tree_links(matrix(table.column("vector")), table.column("cell")[0].as_py() & 0x7FFFFFFF, threshold)
        moved = np.flatnonzero(label != np.arange(len(r)))
        return pa.table({"a": r[moved], "b": r[label[moved]]})

    return group


def cells(reps: DataFrame, trees: int, scratch: Scratch, cell: int) -> DataFrame:
    """``cell, r, vector``: the forest's nodes of at most ``cell`` vectors. Larger nodes are split level by level."""
    rows = reps.select("r", "vector", F.explode(F.array(*map(F.lit, range(trees)))).alias("tree"), "label").select(F.xxhash64("label", F.size("vector"), "tree").alias("cell"), "r", "vector")
    done = None

    def project(batches):
        known: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            ids, out = b.column("cell").to_numpy(), np.zeros(len(b))
            widths = pc.list_value_length(b.column("vector")).to_numpy(zero_copy_only=False)
            for c, width in {*zip(ids.tolist(), widths.tolist(), strict=True)}:
                if len(known) > 10_000:
                    known.clear()
                if (c, width) not in known:
                    known[c, width] = direction(c, width)
                at = np.flatnonzero((ids == c) & (widths == width))
                out[at] = matrix(b.column("vector").take(pa.array(at))) @ known[c, width]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ranked(out, b.column("r").to_numpy(), ids))], ["cell", "r", "vector", "p"])

    while True:
        big = scratch.save(rows.groupBy("cell").count().filter(F.col("count") > cell).select("cell"), "big")
        if big.isEmpty():
            return rows if done is None else done.unionByName(rows)
        small = scratch.save(rows.join(big, "cell", "left_anti"), "cells")
        done = small if done is None else done.unionByName(small)
        at = scratch.save(rows.join(big, "cell", "left_semi").select("cell", "r", "vector").mapInArrow(project, "cell long, r long, vector array<double>, p double"), "projected")
        cuts = at.groupBy("cell").agg(F.percentile_approx("p", F.array(F.lit(0.5 - SPILL), F.lit(0.5 + SPILL)), 1000).alias("q"))
        sides = F.filter(F.array(F.when(F.col("p") <= F.col("q")[1], 1), F.when(F.col("p") >= F.col("q")[0], 2)), lambda s: s.isNotNull())
        rows = scratch.save(at.join(cuts, "cell").select("cell", "r", "vector", F.explode(sides).alias("side")).select(F.xxhash64("cell", "side").alias("cell"), "r", "vector"), "split")


def ranked(p: np.ndarray, r: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Projections to ``GRAIN`` with a hash of the row and the cell below it, by which ties are ordered."""
    x = (r.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ cell.view(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (np.round(p / GRAIN) + (x >> np.uint64(43)).astype(np.float64) / (1 << 21)) * GRAIN


def counting(threshold: float):
    """Groups of whole small components: the weight of the others that each member is linked to."""

    def group(table: pa.Table) -> pa.Table:
        comp, r, n = (table.column(c).to_numpy() for c in ("comp", "r", "n"))
        order = np.argsort(comp, kind="stable")
        bounds = np.flatnonzero(np.concatenate(([True], comp[order][1:] != comp[order][:-1], [True])))
        vectors, out = table.column("vector").combine_chunks(), np.zeros(len(r), np.int64)
        for s, e in zip(bounds[:-1], bounds[1:], strict=True):
            ids = order[s:e]
            m = matrix(vectors.take(pa.array(ids)))
            hit = m @ m.T >= threshold
            np.fill_diagonal(hit, False)
            out[ids] = hit @ n[ids]
        return pa.table({"r": r, "others": out})

    return group


def comparing(threshold: float):
    """Blocks of a large component: ``side`` 0 are the members to count for, 1 those to compare with."""

    def group(table: pa.Table) -> pa.Table:
        side, r, n = (table.column(c).to_numpy() for c in ("side", "r", "n"))
        m = matrix(table.column("vector"))
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        hit = (m[a] @ m[b].T >= threshold) & (r[a][:, None] != r[b][None, :])
        return pa.table({"r": r[a], "others": hit.astype(np.int64) @ n[b]})

    return group


def others_linked(members: DataFrame, threshold: float, scratch: Scratch, block: int) -> DataFrame:
    """``r, others`` of ``members(comp, r, n, vector)``: how many vectors of other values each is linked to."""
    sizes = members.groupBy("comp").agg(F.count("*").alias("size"), F.sum("n").alias("total"))
    sizes = scratch.save(sizes, "sizes")
    small = members.join(sizes.filter(F.col("size") <= block), "comp").select("comp", "r", "n", "vector")
    buckets = max(1, -(-(sizes.filter(F.col("size") <= block).agg(F.sum("size")).first()[0] or 0) // (4 * block)))
    out = small.groupBy(F.pmod(F.xxhash64("comp"), F.lit(buckets).cast("long")).alias("bucket")).applyInArrow(counting(threshold), "r long, others long")
    large = sizes.filter(F.col("size") > block)
    if large.isEmpty():
        return out
    rows = scratch.save(members.join(large, "comp"), "large")
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    parts = rows.select("comp", F.posexplode("vector").alias("i", "x")).groupBy("comp", "i").agg(F.sum("x").alias("x"))
    centre = parts.groupBy("comp").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centre"))
    dot = F.aggregate(F.zip_with("vector", "centre", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    angle = F.when(norm(F.col("centre")) > 0, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / norm(F.col("vector")) / norm(F.col("centre")))))).otherwise(math.pi)
    rows = rows.join(centre, "comp").withColumn("angle", angle).drop("centre")
    widest = rows.groupBy("comp").agg(F.max("angle").alias("widest"))
    rows = scratch.save(rows.join(widest, "comp").withColumn("to_all", F.col("angle") + F.col("widest") < math.acos(threshold) - 1e-9), "angles")
    out = out.unionByName(rows.filter("to_all").select("r", (F.col("total") - F.col("n")).alias("others")))
    blocks = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("r"), blocks.cast("long")).cast("int")
    every = F.sequence(F.lit(0), blocks - 1)
    left = rows.filter("not to_all")
    queries = left.select("comp", own.alias("x"), F.explode(every).alias("y"), "r", "n", "vector", F.lit(0).alias("side"))
    against = rows.join(left.select("comp", own.alias("q")).distinct(), "comp").select("comp", F.col("q").alias("x"), own.alias("y"), "r", "n", "vector", F.lit(1).alias("side"))
    blocked = queries.unionByName(against).groupBy("comp", "x", "y").applyInArrow(comparing(threshold), "r long, others long")
    return out.unionByName(blocked.groupBy("r").agg(F.sum("others").alias("others")))


def usable(v):
    """Whether a vector can be linked."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def near(vectors: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, scratch: Scratch | None = None, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors(vec_id, embedding, label)``."""
    scratch = scratch or Scratch(vectors.sparkSession, "embeddings")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.withColumn("ok", usable(F.col("vector")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    rows = rows.withColumn("k1", F.xxhash64("label", "vector")).withColumn("k2", F.xxhash64(F.lit(1), "label", "vector"))
    reps = rows.filter("ok").groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    reps = scratch.save(reps.withColumn("r", F.monotonically_increasing_id()), "vectors")
    found = cells(reps, trees, scratch, cell).groupBy("cell").applyInArrow(links_of(threshold), "a long, b long")
    found = scratch.save(components(found, scratch).withColumnRenamed("node", "r").withColumnRenamed("root", "comp"), "components")
    others = others_linked(reps.select("r", "n", "vector").join(found, "r"), threshold, scratch, block)
    ids = reps.select("r", "k1", "k2", "n", "least").join(found, "r", "left").withColumn("comp", F.coalesce("comp", "r"))
    least = ids.groupBy("comp").agg(F.min("least").alias("component_id"))
    ids = ids.join(others, "r", "left").join(least, "comp").select("k1", "k2", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    ids = scratch.save(ids, "result")
    alone = rows.filter("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    linked = rows.filter("ok").select("vec_id", "k1", "k2").join(ids, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op9_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
