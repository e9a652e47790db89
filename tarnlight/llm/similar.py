"""SimHash near-duplicates at a given similarity of shingle sets, by ball hashing over blocks of a wide fingerprint.

One 64-bit fingerprint can't tell a Jaccard similarity of 0.8: such texts differ in some 10 of its bits, and a ball of that
radius has a hundred million variants. So a text gets a wide SimHash over its set of shingles, cut into blocks. Two texts
of the wanted similarity differ by at most ``2 * HALF`` bits in one of the blocks with a probability of ``RECALL`` or more,
and there they share a variant within ``HALF`` bits of both. The width of a block follows the logarithm of the number of
texts, so what collides by chance stays a few texts to each, and the number of blocks follows from width and recall.

A rough pass over ``FIRST`` blocks links each text to one near it, and in a crowd to the text at its centre, so that a crowd of
near copies is one group before the main pass, which looks at texts of different groups alone. Where few texts share a variant
(``FEW``), all pairs near by ``CHECK`` bits of the fingerprint are candidates; of a crowd of several groups the groups are
marked instead, and pairs of two marked groups are no candidates. Links are verified on the shingle sets themselves: first
each text's nearest, then those that still join different groups. What is near across marked groups comes from a search
without loss: their texts are joined on the shingles that are rarest among them (a prefix filter), where a map of all their
shingles bounds what two of them can share.

Texts with equal shingle sets (also by case and white space) are copies at once. Texts without words are copies of each
other alone.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlight.llm.common import Scratch, components, fresh
from tarnlight.llm.simhash import flips, roots, shingle_hashes, unfolded, weight

HALF, RECALL, CHECK = 1, 0.99, 128
#: Bits of a block over the logarithm of the number of texts, so that few collide by chance.
SPARE, LEAST_WIDTH, MOST_WIDTH = 8, 24, 52
WEIGHT, STEP = 1_000_000, 6
#: Texts under one variant that are all compared, leaders of a crowd in the rough pass, and its blocks.
FEW, LEADERS, FIRST = 4, 32, 3
#: Counters of shingles, which set the order of the prefix filter and so its cost, not what it finds.
COUNTERS = 1 << 18
#: Bits of a text's map of shingles, by which the prefix filter turns pairs down; they set its cost, too.
SLOTS = 1024
LINK = "a long, b long, d long, crowded boolean"


def flip_rate(similarity: float) -> float:
    """Share of bits in which texts of that similarity differ at most, on average."""
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def plan(n: int, similarity: float) -> tuple[int, int]:
    """Width and number of blocks for ``n`` texts."""
    width, p = min(MOST_WIDTH, max(LEAST_WIDTH, math.ceil(math.log2(max(2, n))) + SPARE)), flip_rate(similarity)
    meet = sum(math.comb(width, i) * p**i * (1 - p) ** (width - i) for i in range(2 * HALF + 1))
    return width, 1 if meet >= RECALL else math.ceil(math.log(1 - RECALL) / math.log(1 - meet))


def _lane(hashes: np.ndarray, lane: int) -> np.ndarray:
    x = hashes + np.uint64((lane + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def wide_bits(hashes: np.ndarray, bits: int) -> np.ndarray:
    """SimHash of ``bits`` bits over different hashes, as zeros and ones."""
    lanes = -(-bits // 64)
    counts = np.zeros((lanes, 64), np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14)]
        for lane in range(lanes):
            counts[lane] += np.unpackbits(_lane(part, lane).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return (counts.ravel()[:bits] * 2 > len(hashes)).astype(np.uint8)


def prints(docs: DataFrame, shingle: int, width: int, blocks: int) -> DataFrame:
    """Of each row: doc_id, key of its text (k1, k2), key of its shingle set (c1, c2), blocks, check bits (v1, v2). No words: no blocks."""
    bits, power = max(width * blocks, CHECK), np.uint64(1) << np.arange(width, dtype=np.uint64)

    def run(batches):
        for b in batches:
            c1, c2, all_blocks, v1, v2 = [], [], [], [], []
            for t in b.column("text").cast(pa.binary()):
                hashes = np.unique(shingle_hashes(t.as_py(), shingle))
                d = xxhash.xxh3_128_digest(hashes.tobytes())
                c1.append(int.from_bytes(d[:8], "little", signed=True))
                c2.append(int.from_bytes(d[8:], "little", signed=True))
                if len(hashes):
                    found = wide_bits(hashes, bits)
                    check = np.packbits(found[:CHECK], bitorder="little").view(np.int64)
                    all_blocks.append((found[: width * blocks].reshape(blocks, width) * power).sum(1, dtype=np.uint64).view(np.int64))
                    v1.append(int(check[0]))
                    v2.append(int(check[1]))
                else:
                    all_blocks.append(np.zeros(0, np.int64))
                    v1.append(0)
                    v2.append(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("k1"), b.column("k2"), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(all_blocks, pa.list_(pa.int64())), pa.array(v1, pa.int64()), pa.array(v2, pa.int64())], ["doc_id", "k1", "k2", "c1", "c2", "blocks", "v1", "v2"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_key(text), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, k1 long, k2 long, c1 long, c2 long, blocks array<long>, v1 long, v2 long")


def text_key(text) -> list:
    filled = F.coalesce(text, F.lit(""))
    return [F.xxhash64(filled).alias("k1"), F.xxhash64(F.lit(1), filled).alias("k2")]


def distance(v1: np.ndarray, v2: np.ndarray, a, b) -> np.ndarray:
    return np.bitwise_count(v1[a] ^ v1[b]).astype(np.int64) + np.bitwise_count(v2[a] ^ v2[b])


def met(r: np.ndarray, c: np.ndarray, x: np.ndarray, v1: np.ndarray, v2: np.ndarray, fp: np.ndarray, left: np.ndarray, width: int, most: int, rough: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links of the texts of one prefix: unfold the variants over the low ``width`` bits, sort, take near pairs and mark crowds.

    Texts of one group ``c`` need no link, nor do those of two groups that are marked (``x``). The last array tells the marks: of
    a crowd of several groups each group that has none, by one text linked to itself. ``rough``: of each text the nearest, be it a
    leader of a crowd, and the text at the centre of its largest crowd, which most texts of that crowd share; the marks link all
    texts of a crowd, and of crowds with texts in common, to one of them.
    """
    low = fp & np.uint64((1 << width) - 1)
    parts, owners = [], []
    for n in np.unique(left):
        at = np.flatnonzero(left == n)
        masks = flips(width, int(n))[0]
        parts.append((low[at][:, None] ^ masks[None, :]).ravel())
        owners.append(np.repeat(at.astype(np.int32), len(masks)))
    values, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((r[owner], values))
    values, owner = values[order], owner[order]
    starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(values)])))
    size = np.repeat(sizes, sizes)
    near, central, marks = [(np.zeros(0, np.int64),) * 3], [(np.zeros(0, np.int64),) * 4], [(np.zeros(0, np.int64),) * 2]
    for k in range(1, min(FEW, int(sizes.max()))):
        at = np.flatnonzero((values[k:] == values[:-k]) & (size[k:] <= FEW))
        at = at[(c[owner[at]] != c[owner[at + k]]) & ~(x[owner[at]] & x[owner[at + k]])]
        d = distance(v1, v2, owner[at], owner[at + k])
        at, d = at[d <= most], d[d <= most]
        near.append((owner[at], owner[at + k], d))
    for s, n in zip(starts[sizes > FEW], sizes[sizes > FEW], strict=True):
        ids = owner[s : s + n]
        if (c[ids] == c[ids[0]]).all() or x[ids].all():
            continue
        if not rough:
            marks.append((ids[~x[ids]],) * 2)
            continue
        marks.append((ids, np.full(n, ids[0])))
        bits = np.unpackbits(np.stack([v1[ids], v2[ids]], 1).view(np.uint8), axis=1)
        centre = bits.sum(0, dtype=np.int64) * 2 > n
        middle = np.argsort((bits != centre).sum(1), kind="stable")[: LEADERS // 2]
        lucky = np.argsort((r[ids].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), kind="stable")[: LEADERS // 2]
        leaders = ids[np.unique(np.concatenate((middle, lucky)))]
        d = np.stack([np.where(c[ids] == c[y], 1 << 20, distance(v1, v2, ids, np.full(n, y))) for y in leaders], 1)
        best, least = d.argmin(1), d.min(1)
        near.append((ids[least <= most], leaders[best[least <= most]], least[least <= most]))
        d = distance(v1, v2, ids, np.full(n, ids[middle[0]]))
        at = np.flatnonzero((d <= most) & (ids != ids[middle[0]]))
        central.append((ids[at], np.full(len(at), ids[middle[0]]), d[at], np.full(len(at), -n)))
    a, b, d = (np.concatenate(y) for y in zip(*near, strict=True))
    ma, mb = (np.concatenate(y) for y in zip(*marks, strict=True))
    if rough:
        a, b, d = np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((d, d))
        order = np.lexsort((r[b], d, a))
        order = order[np.concatenate(([True], a[order][1:] != a[order][:-1]))] if len(a) else order
        ca, cb, cd, cn = (np.concatenate(y) for y in zip(*central, strict=True))
        largest = np.lexsort((r[cb], cn, ca))
        largest = largest[np.concatenate(([True], ca[largest][1:] != ca[largest][:-1]))] if len(ca) else largest
        a, b, d = (np.concatenate((y[order], z[largest])) for y, z in ((a, ca), (b, cb), (d, cd)))
        label = roots(len(r), ma, mb)
        ma = np.unique(ma)
        mb = label[ma]
    else:
        ma = mb = ma[np.unique(c[ma], return_index=True)[1]]
    a, b = np.maximum(r[a], r[b]), np.minimum(r[a], r[b])
    order = np.lexsort((d, b, a))
    a, b, d = a[order], b[order], d[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, bool)
    a, b, d = np.concatenate((a[new], r[ma])), np.concatenate((b[new], r[mb])), np.concatenate((d[new], np.zeros(len(ma), np.int64)))
    return a, b, d, np.arange(len(a)) >= len(a) - len(ma)


def candidates(classes: DataFrame, width: int, similarity: float, scratch: Scratch, rough: bool = False) -> DataFrame:
    """``(a, b, d, crowded)``, a > b: links between ``classes(r, c, x, blocks, v1, v2)`` of different ``c`` to verify, with their distance in check bits.

    ``x``: the group is marked, and no link between two such is given. ``crowded``: no link, but a = b marks a group more, that of
    a text in a crowd. ``rough``: enough to join most crowds; ``crowded`` there gives the texts ``a`` of a crowd ``b``.
    """
    p = flip_rate(similarity)
    most = math.ceil(CHECK * p + 4 * math.sqrt(CHECK * p * (1 - p)))
    n = classes.count()
    bits = max(1, min(width - 4, math.ceil(math.log2(max(2, n * weight(width, HALF) / WEIGHT)))))
    own = ["r", "c", "x", "v1", "v2"]
    rows = classes.select(*own, F.posexplode("blocks").alias("key", "fp")).select(F.col("key").cast("long").alias("key"), F.lit(HALF).alias("left"), "fp", *own)
    rows, found = unfolded(rows, 0, bits, HALF, width), None

    def group(rest):
        def run(t: pa.Table) -> pa.Table:
            r, c, v1, v2, fp = (t.column(y).to_numpy().view(k) for y, k in (("r", np.int64), ("c", np.int64), ("v1", np.uint64), ("v2", np.uint64), ("fp", np.uint64)))
            a, b, d, crowded = met(r, c, t.column("x").to_numpy(), v1, v2, fp, t.column("left").to_numpy(), rest, most, rough)
            return pa.table({"a": a, "b": b, "d": d, "crowded": crowded})

        return run

    while True:
        cost = F.element_at(F.array(*[F.lit(weight(width - bits, i)).cast("long") for i in range(HALF + 1)]), F.col("left") + 1)
        hot = scratch.save(rows.groupBy("key").agg(F.sum(cost).alias("w"), F.min("c").alias("low"), F.max("c").alias("high"), F.bool_and("x").alias("marked")).filter(F.col("w") > 4 * WEIGHT), "hot")
        any_hot = not hot.isEmpty()
        cool = rows.join(hot.select("key"), "key", "left_anti") if any_hot else rows
        here = cool.groupBy("key").applyInArrow(group(width - bits), LINK)
        mixed = hot.filter("low < high AND NOT marked")  # a crowd of one group needs no links
        if any_hot and bits == width:
            # one variant with an unbounded crowd: parts by chance, each with one text that all parts share
            crowd = rows.join(mixed.select("key", F.ceil(F.col("w") / WEIGHT).cast("int").alias("parts")), "key")
            shared = crowd.groupBy("key").agg(F.min_by(F.struct("left", "fp", *own, "parts"), F.xxhash64("key", "r")).alias("one"))
            shared = shared.select("key", "one.*", F.explode(F.sequence(F.lit(0), F.col("one.parts") - 1)).alias("part"))
            crowd = crowd.withColumn("part", F.pmod(F.xxhash64("r"), F.col("parts").cast("long")).cast("int")).unionByName(shared).select("key", "part", "left", "fp", *own).dropDuplicates(["key", "part", "r"])
            here = here.unionByName(crowd.groupBy("key", "part").applyInArrow(group(0), LINK))
            if rough:
                marks = crowd.join(crowd.groupBy("key").agg(F.min("r").alias("b")), "key").select(F.col("r").alias("a"), "b")
            else:
                marks = crowd.filter("NOT x").groupBy("c").agg(F.min("r").alias("a")).select("a", F.col("a").alias("b"))
            here = here.unionByName(marks.select("a", "b", F.lit(0).cast("long").alias("d"), F.lit(True).alias("crowded")))
            any_hot = False
        if not any_hot and found is None:
            return here
        here = scratch.save(here, "links")
        found = here if found is None else found.unionByName(here)
        if not any_hot:
            return found
        step = min(STEP, width - bits)
        rows = scratch.save(unfolded(rows.join(mixed.select("key"), "key", "left_semi"), bits, bits + step, HALF, width), "refined")
        bits += step


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The ``(a, b)`` of ``pairs`` whose ``texts(r, text)`` have that Jaccard similarity of shingle sets at least."""

    def run(batches):
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            keep = []
            for i, (a, ta, tb) in enumerate(zip(batch.column("a").to_pylist(), batch.column("ta"), batch.column("tb"), strict=True)):
                if a not in known:
                    known.clear()  # rows come sorted by a
                    known[a] = np.unique(shingle_hashes(ta.as_py().encode(), shingle))
                x, y = known[a], np.unique(shingle_hashes(tb.as_py().encode(), shingle))
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= similarity * (len(x) + len(y) - both) - 1e-9:
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(keep, pa.int32())), batch.column("b").take(pa.array(keep, pa.int32()))], ["a", "b"])

    # the larger ids get their own text first: the smaller ones, of which a few may be in most pairs, last
    first = pairs.select("a", "b").join(texts.select(F.col("r").alias("a"), F.col("text").alias("ta")), "a")
    both = first.join(texts.select(F.col("r").alias("b"), F.col("text").alias("tb")), "b")
    return both.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("tb").alias("ta"), F.col("ta").alias("tb")).mapInArrow(run, "a long, b long").select(F.col("b").alias("a"), F.col("a").alias("b"))


def prefix_pairs(texts: DataFrame, shingle: int, similarity: float, scratch: Scratch) -> DataFrame:
    """``(a, b)``, a > b: pairs of ``texts(r, c, text)`` of different ``c``, among them all with that Jaccard similarity.

    With the shingles of all texts in one order, two such texts share one of their first few: the larger text's first
    ``1 - similarity`` of its shingles and the smaller's still shorter share. The rarest come first. As the texts of a crowd share
    nearly all of these, each text also has a map of ``SLOTS`` bits: the shingles that occur in other texts, the commonest each
    at a place of its own. Two texts share no more shingles than places, and those that found their place taken.
    """
    index = 2 * similarity / (1 + similarity)

    def hashes_of(b):
        return [np.unique(shingle_hashes(t.as_py(), shingle)) for t in b.column("text").cast(pa.binary())]

    def counted(batches):
        n = np.zeros(COUNTERS, np.int64)
        for b in batches:
            n += np.bincount((np.concatenate([np.zeros(0, np.uint64), *hashes_of(b)]) % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["at", "n"])

    counts = texts.select("text").mapInArrow(counted, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(COUNTERS, np.int64)
    often[counts.column("at").to_numpy()] = counts.column("n").to_numpy()
    slot = np.empty(COUNTERS, np.int16)
    slot[np.argsort(-often, kind="stable")] = np.arange(COUNTERS) % SLOTS

    def firsts(batches):
        for b in batches:
            taken, places, sizes, over = [], [], [], []
            places_of = np.zeros((b.num_rows, SLOTS), np.uint8)
            for row, hashes in enumerate(hashes_of(b)):
                at = (hashes % np.uint64(COUNTERS)).astype(np.int64)
                n = often[at]
                order = np.lexsort((hashes, n))[: len(hashes) - math.ceil(similarity * len(hashes) - 1e-6) + 1]
                shared = n[order] > 1  # the rest meets nothing
                taken.append(hashes[order[shared]])
                places.append(np.flatnonzero(shared))
                sizes.append(len(hashes))
                used = slot[at[n > 1]]
                places_of[row, used] = 1
                over.append(len(used) - int(places_of[row].sum()))
            own = np.repeat(np.arange(len(taken)), [len(y) for y in taken])
            h = np.concatenate([np.zeros(0, np.uint64), *taken]).view(np.int64)
            i = np.concatenate([np.zeros(0, np.int64), *places])
            r, c = (b.column(y).to_numpy()[own] for y in ("r", "c"))
            m, o = (np.array(y, np.int64)[own] for y in (sizes, over))
            words = np.packbits(places_of, axis=1, bitorder="little").view(np.int64)[own]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(y)) for y in (h, r, c, m, i, o, *words.T)], ["h", *own_columns])

    own_columns = ["r", "c", "m", "i", "o", *(f"w{k}" for k in range(SLOTS // 64))]
    rows = scratch.save(texts.select("r", "c", "text").mapInArrow(firsts, ", ".join(f"{k} long" for k in ("h", *own_columns))), "firsts")
    # of each shingle the commonest group need not be compared with itself
    mixed = scratch.save(rows.groupBy("h").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.mode("c").alias("main")).filter("low < high").select("h", "main"), "mixed")
    x = rows.join(mixed, "h").filter("c <> main").select("h", *(F.col(k).alias(f"x{k}") for k in own_columns))
    y = rows.select("h", *(F.col(k).alias(f"y{k}") for k in own_columns))
    ends = [F.struct(*(F.col(f"{side}{k}").alias(k) for k in "mri")) for side in "xy"]
    (lm, li), (sm, si) = ((s["m"], s["i"]) for s in (F.greatest(*ends), F.least(*ends)))
    fits = (sm >= similarity * lm - 1e-6) & (sm - si >= index * sm - 1e-6) & (F.least(lm - li, sm - si) * (1 + similarity) >= similarity * (lm + sm) - 1e-6)
    both = sum((F.bit_count(F.col(f"xw{k}").bitwiseAND(F.col(f"yw{k}"))) for k in range(SLOTS // 64)), F.least("xo", "yo"))
    fits &= both * (1 + similarity) >= similarity * (lm + sm) - 1e-6
    found = x.join(y, "h").filter((F.col("xc") != F.col("yc")) & fits)
    return found.select(F.greatest("xr", "yr").alias("a"), F.least("xr", "yr").alias("b")).distinct()


def nearest(links: DataFrame) -> DataFrame:
    """``(a, b)``, a > b: of each text the link of least distance."""
    both = links.select("a", "b", "d").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    best = both.groupBy("a").agg(F.min(F.struct("d", "b")).alias("x"))
    return best.select(F.greatest("a", "x.b").alias("a"), F.least("a", "x.b").alias("b")).distinct()


def grouped(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, k1, k2 (key of the text), group for each row of ``docs(doc_id, text)``. Near copies have one group.

    Null, empty and white texts have no words and are one group. An empty table gives no rows. Repeated rows and ids are kept.
    """
    scratch = scratch or Scratch(docs.sparkSession, "similar")
    width, blocks = plan(docs.count(), similarity)
    rows = scratch.save(prints(docs, shingle, width, blocks), "prints")
    classes = rows.groupBy("c1", "c2").agg(F.min(F.struct("k1", "k2")).alias("one"), F.first("blocks").alias("blocks"), F.first("v1").alias("v1"), F.first("v2").alias("v2"))
    classes = scratch.save(classes.withColumn("r", F.monotonically_increasing_id()), "classes")
    text = F.col("text").cast("string")
    own = classes.filter(F.size("blocks") > 0).select("r", "one.k1", "one.k2")

    def texts_of(ids: DataFrame) -> DataFrame:
        wanted = own.join(ids, "r")
        return docs.select(*text_key(text), text.alias("text")).join(wanted, ["k1", "k2"]).groupBy(*ids.columns).agg(F.min("text").alias("text"))

    def ends(df: DataFrame) -> DataFrame:
        return df.select("a").unionByName(df.select(F.col("b").alias("a"))).distinct().withColumnRenamed("a", "r")

    def in_groups(df: DataFrame, found: DataFrame, key: str, name: str) -> DataFrame:
        return df.join(found.select(F.col("node").alias(key), F.col("root").alias(name)), key, "left").withColumn(name, F.coalesce(name, key))

    # crowds, by a few blocks
    some = classes.select("r", F.col("r").alias("c"), F.lit(False).alias("x"), F.slice("blocks", 1, FIRST).alias("blocks"), "v1", "v2")
    rough = scratch.save(candidates(some, width, similarity, scratch, rough=True), "rough")
    best = scratch.save(rough.filter("NOT crowded").select("a", "b").distinct(), "best")
    good = scratch.save(verified(best, texts_of(ends(best)), shingle, similarity), "good")
    found = scratch.save(components(good, scratch), "first")
    # the groups of crowds that are not one group now: what is near among these is found last
    crowd = in_groups(rough.filter("crowded").select("a", "b"), found, "a", "c")
    several = crowd.groupBy("b").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high").select("b")
    crowd = scratch.save(crowd.join(several, "b").select("c").distinct(), "crowds")
    # what is near across the other groups so far, by all blocks
    some = in_groups(classes.select("r", "blocks", "v1", "v2"), found, "r", "c").join(crowd.withColumn("x", F.lit(True)), "c", "left")
    links = candidates(some.select("r", "c", F.coalesce("x", F.lit(False)).alias("x"), "blocks", "v1", "v2"), width, similarity, scratch)
    links = scratch.save(links.groupBy("a", "b").agg(F.min("d").alias("d"), F.max("crowded").alias("crowded")), "links")
    crowd = crowd.select(F.col("c").alias("r")).unionByName(links.filter("crowded").select(F.col("a").alias("r"))).distinct()
    links = links.filter("NOT crowded")
    texts = scratch.save(texts_of(ends(links)), "texts")
    # a text's nearest: most groups hang together by these alone
    best = scratch.save(nearest(links), "nearest")
    good = scratch.save(good.unionByName(verified(best, texts, shingle, similarity)), "good")
    found = scratch.save(components(good, scratch), "second")
    rest = links.join(best, ["a", "b"], "left_anti").select("a", "b")
    rest = in_groups(in_groups(rest, found, "a", "c1"), found, "b", "c2").filter("c1 <> c2").select("a", "b")
    rest = scratch.save(rest, "rest")
    good = scratch.save(good.unionByName(verified(rest, texts, shingle, similarity)), "good")
    scratch.drop(texts)
    found = scratch.save(components(good, scratch), "groups")
    # all texts of groups that met in a crowd
    crowd = scratch.save(in_groups(crowd, found, "r", "c").select("c").distinct(), "crowd")
    if crowd.limit(2).count() > 1:
        members = scratch.save(texts_of(in_groups(classes.select("r"), found, "r", "c").join(crowd, "c", "left_semi").select("r", "c")), "members")
        pairs = scratch.save(prefix_pairs(members, shingle, similarity, scratch), "pairs")
        good = scratch.save(good.unionByName(verified(pairs, members.select("r", "text"), shingle, similarity)), "good")
        found = scratch.save(components(good, scratch), "groups")
        scratch.drop(members)
    classes = in_groups(classes.select("r", "c1", "c2"), found, "r", "group").select("c1", "c2", "group")
    return scratch.save(rows.select("doc_id", "k1", "k2", "c1", "c2").join(classes, ["c1", "c2"]).select("doc_id", "k1", "k2", "group"), "grouped")


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the smallest doc_id (null is the largest), and of its rows one."""
    scratch = scratch or Scratch(docs.sparkSession, "similar")
    found = grouped(docs, shingle, similarity, scratch)
    best = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "k1", "k2")).alias("one"))
    names = fresh(docs, "_id", "_k1", "_k2", "_own1", "_own2")
    best = scratch.save(best.select(*(F.col(f"one.{c}").alias(n) for c, n in zip(("doc_id", "k1", "k2"), names, strict=False))), "kept")
    own = [k.alias(n) for k, n in zip(text_key(F.col("text").cast("string")), names[3:], strict=True)]
    rows = docs.select("*", *own)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(names[0])) & (F.col(names[3]) == F.col(names[1])) & (F.col(names[4]) == F.col(names[2]))
    kept = rows.join(best, same, "left_semi")
    repeated = found.groupBy("doc_id", "k1", "k2").agg(F.count("*").alias("n")).filter("n > 1")
    if not repeated.isEmpty():
        kept = kept.dropDuplicates(["doc_id", *names[3:]])
    return kept.select(*docs.columns)
