"""Vector index and search."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlight.functions import embed as E
from tarnlight.functions import text as T
from tarnlight.operators import scan

LEAST, KEPT_TEXT = 5, 500
#: Queries that are searched at once, at most; they are broadcast. Queries and vectors that are multiplied at once.
BLOCK, TILE, ROWS = 1_000, 500, 1_000


def admitted(texts: DataFrame) -> DataFrame:
    """Chunks worth a vector: five characters or more, and 40 if the file has several."""
    n = F.length(F.trim("text"))
    return T.with_chunks(texts).filter((n >= LEAST) & ((F.length("text") >= 40) | (F.col("n_chunks") == 1)))


def build(texts: DataFrame, embedder=E.embedded, backend: str = E.BACKEND, saying: str | None = None) -> DataFrame:
    """``rel, chunk_index, start_offset, text, vector, backend``; the text is its first 500 characters.

    ``saying``: only chunks with a word of this query there or in the path, for a search that finds no others.
    """
    rows = admitted(scan.bounded(texts))
    if saying is not None:
        rows = rows.filter(present(F.substring("text", 1, KEPT_TEXT), saying) > 0)
    return rows.select("rel", "chunk_index", "start_offset", F.substring("text", 1, KEPT_TEXT).alias("text"), E.checked(embedder(F.col("text"))).alias("vector"), F.lit(backend).alias("backend"))


def to_embed(texts: DataFrame, manifest: DataFrame, backend: str) -> DataFrame:
    """``texts(rel, sha1, ...)`` whose vectors can't be used again: no known hash, a new one, or another model's."""
    known = manifest.filter(F.col("sha1").isNotNull() & (F.col("backend") == backend)).select("rel", "sha1").distinct()
    return texts.join(known, ["rel", "sha1"], "left_anti")


def reused(vectors: DataFrame, texts: DataFrame, manifest: DataFrame, backend: str) -> DataFrame:
    known = manifest.filter(F.col("sha1").isNotNull() & (F.col("backend") == backend)).select("rel", "sha1").distinct()
    return vectors.join(texts.join(known, ["rel", "sha1"], "left_semi").select("rel"), "rel", "left_semi")


def top_k(vectors: DataFrame, queries: DataFrame, key: str, limit: int = 8) -> DataFrame:
    """``query_id, <key>, score, rank``: the nearest vectors of each of ``queries(query_id, q)`` by dot product.

    Each query meets each vector. Queries are broadcast, in blocks by the hash of their ids if they are more than ``BLOCK``,
    and multiplied as matrices with the vectors of a split, of which the best of each query are ranked. Vectors that are no
    rows of such a matrix (null, of another width, with components that are no numbers) are multiplied one by one.
    """
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(key))
    n, width = queries.agg(F.count("*"), F.max(F.size("q"))).first()
    every = {f.name: f.dataType for f in [*queries.schema, *vectors.schema]}
    schema = f"query_id {every['query_id'].simpleString()}, `{key}` {every[key].simpleString()}, score double"
    one_by_one = lambda a, b: a.crossJoin(F.broadcast(b)).select("query_id", key, E.dot(F.col("q"), F.col("vector")).alias("score"))
    even_q, even_v = (F.col(c).isNotNull() & E.valid(F.col(v), width or 1) for c, v in (("query_id", "q"), (key, "vector")))
    odd_v, odd_q = vectors.filter(~even_v), queries.filter(~even_q)
    even = vectors.filter(even_v).select(key, F.col("vector").cast("array<double>").alias("vector"))
    blocks = 1 if n <= BLOCK else -(-n * 2 // BLOCK)  # half full on average, as hashing doesn't deal evenly
    parts, some_odd = [], not odd_v.isEmpty()
    for i in range(blocks):
        some = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) if blocks > 1 else queries
        rows = some.filter(even_q).select("query_id", F.col("q").cast("array<double>").alias("q")).collect()  # BLOCK at most, more or less
        if rows:
            parts.append(scan.bounded(even).mapInArrow(nearest([r["query_id"] for r in rows], np.array([r["q"] for r in rows]), limit, schema), schema))
        if some_odd:
            parts.append(one_by_one(odd_v, some))
    if not odd_q.isEmpty():
        parts.append(one_by_one(vectors.filter(even_v), odd_q))
    scored = reduce(DataFrame.unionByName, parts) if parts else one_by_one(vectors, queries)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def nearest(ids: list, asked: np.ndarray, limit: int, schema: str):
    """For ``mapInArrow``: of each query the best vectors of a split, by score and then key.

    Products of matrices find what can be among them; its scores are then summed component by component, as elsewhere.
    """
    lengths = np.sqrt((asked * asked).sum(1))

    def run(batches):
        kept = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))] * -(-len(asked) // TILE)
        floors, keys, kind = np.full(len(asked), -np.inf), [], None
        for batch in batches:
            kind = batch.schema.types[0]
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                v = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                first, longest = sum(map(len, keys)), np.sqrt((v * v).sum(1).max())
                keys.append(part.column(0))
                for t, (query, score, which) in enumerate(kept):
                    q = asked[t * TILE : (t + 1) * TILE]
                    floor, near = floors[t * TILE : (t + 1) * TILE], 4e-16 * (v.shape[1] + 8) * lengths[t * TILE : (t + 1) * TILE] * longest
                    rough = v @ q.T
                    if len(v) > limit:
                        np.maximum(floor, np.partition(rough, len(v) - limit, axis=0)[len(v) - limit] - 2 * near, out=floor)
                    i, k = np.nonzero(rough >= floor - near)
                    exact = np.zeros(len(i))
                    for d in range(v.shape[1]):
                        exact += q[k, d] * v[i, d]
                    query, score, which = np.append(query, k), np.append(score, exact), np.append(which, first + i)
                    kept[t] = cut(query, score, which, keys, limit, floor)
            if len(keys) > 1:
                keys = [pa.concat_arrays(keys)]
                used = np.unique(np.concatenate([x[2] for x in kept]))
                keys, kept = [keys[0].take(pa.array(used))], [(q, s, np.searchsorted(used, w)) for q, s, w in kept]
        for t, (query, score, which) in enumerate(kept):
            if len(query):
                out = [pa.array([ids[t * TILE + k] for k in query.tolist()]), pa.concat_arrays(keys).take(pa.array(which)), pa.array(score)]
                yield pa.RecordBatch.from_arrays([out[0].cast(kinds[0]), out[1].cast(kind), out[2]], names)

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema).fields
    kinds, names = [to_arrow_type(f.dataType) for f in fields], [f.name for f in fields]
    return run


def cut(query: np.ndarray, score: np.ndarray, which: np.ndarray, keys: list, limit: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best ``limit`` of each query; ``floor`` is raised to the last of them."""
    by = pa.concat_arrays(keys).take(pa.array(which)).to_numpy(zero_copy_only=False)
    order = np.lexsort((by, -score, query))
    query, score, which = query[order], score[order], which[order]
    begins = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, np.int64)
    nth = np.arange(len(query)) - np.repeat(begins, np.diff(np.append(begins, len(query))))
    last = nth == limit - 1
    floor[query[last]] = np.maximum(floor[query[last]], score[last])
    return query[nth < limit], score[nth < limit], which[nth < limit]


def terms_of(query: str) -> list[str]:
    return sorted(set(re.findall(r"[a-z0-9][a-z0-9_\-]{2,}", query.lower())))


def present(text: Column, query: str) -> Column:
    """How many words of the query the text or the path ``rel`` has."""
    hay = F.lower(F.concat_ws(" ", text, "rel"))
    return sum((hay.contains(t).cast("int") for t in terms_of(query)), F.lit(0))


def semantic_search(index: DataFrame, query: str, limit: int = 8, folder: str | None = None, least: float = 1e-6, embedder=E.embed, lexical: bool = True) -> DataFrame:
    """``rel, chunk_index, score``: similarity times one plus twice the share of query words in the text or path.

    ``lexical`` (the hashed model): a hit needs a query word.
    """
    terms, said = terms_of(query), present(F.col("text"), query)
    q = F.array(*[F.lit(float(x)) for x in embedder(query)])
    rows = index.filter(T.in_folder(F.col("rel"), folder)) if folder else index
    rows = rows.select("rel", "chunk_index", said.alias("present"), (E.dot(q, F.col("vector")) * (1.0 + 2.0 * said / max(1, len(terms)))).alias("score"))
    rows = rows.filter(F.col("score") >= least)
    if lexical:
        rows = rows.filter("present > 0")
    return rows.select("rel", "chunk_index", "score").orderBy(F.col("score").desc(), "rel", "chunk_index").limit(limit)
