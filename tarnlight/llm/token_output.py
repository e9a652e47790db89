"""Training-order materialisation of token ids in binary shards of fixed stride.

Texts are tokenized in the order in which tasks read them, an end mark after each, and cut into sequences of ``LENGTH``
ids; the last sequence of a task is filled up with end marks. The sequences are kept in one table with their number (task,
position), so a lost executor changes nothing. A keyed Feistel permutation with cycle-walking maps the gapless numbers 0 to
N - 1 one to one onto slots, the global training order. Sequences then go to the task of their shard, a range of
``shard_rows`` slots, which writes them in order as little-endian 16-bit ids: the sequence of slot ``s`` begins at byte
``(s % shard_rows) * LENGTH * 2`` of shard ``s // shard_rows``. A reader can start at any slot with one seek. A shard has
``SHARD_ROWS`` slots, doubled until at most ``MOST_SHARDS`` shards are left. It is written under another name and moved, so
a task that runs twice does no harm. The order depends on the key and on the
table of sequences alone.

Defined results: null and empty texts give an end mark. Repeated rows and ids are kept. An empty table gives no sequences
and no shards. Extra columns are not read.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlight.llm.common import Scratch, shared_dir
from tarnlight.llm.packing import END, VOCABULARY, encode

LENGTH, SHARD_ROWS, KEY, ROUNDS = 1_024, 8_192, 0x5EED_0F_0DE5, 6
MOST_SHARDS = 65_536
#: Offsets of so many tasks at most are broadcast (16 bytes each).
BROADCAST_TASKS = 500_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(numbers: np.ndarray, n: int, key: int = KEY, back: bool = False) -> np.ndarray:
    """The slots of ``numbers`` under a Feistel permutation of 0 to ``n - 1``; ``back``: the numbers of slots."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(key & (1 << 64) - 1))
    x = numbers.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> shift, x[todo] & mask
        for k in keys[::-1] if back else keys:
            if back:
                left, right = right ^ (_mix(left ^ k) & mask), left
            else:
                left, right = right, left ^ (_mix(right ^ k) & mask)
        x[todo] = (left << shift) | right
        todo = todo[x[todo] >= n]  # walk the cycle until it is back inside
    return x.astype(np.int64)


def sequences(docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_ids, first_start, n_tokens, ids``: sequences of ``length`` ids as bytes, with the documents they hold in order.

    first_start: where in its own tokens the first document begins here. n_tokens: ids that aren't filling.
    """

    def run(batches):
        held = np.empty(0, np.uint16)  # less than a sequence
        parts: list[tuple[int | None, int, int]] = []  # doc_id, start in its tokens, number of tokens in held

        def cut(last=False):
            nonlocal held, parts
            out = []
            at = 0
            while len(held) - at >= length or (last and len(held) > at):
                piece = held[at : at + length]
                docs_here, first, room = [], parts[0][1], length
                while parts and room:
                    doc, start, n = parts.pop(0)
                    docs_here.append(doc)
                    if n > room:
                        parts.insert(0, (doc, start + room, n - room))
                    room -= min(n, room)
                full = piece if len(piece) == length else np.concatenate([piece, np.full(length - len(piece), END, np.uint16)])
                out.append((docs_here, first, len(piece), full.astype("<u2").tobytes()))
                at += length
            held = held[at:]
            if out:
                a, b, c, d = zip(*out, strict=True)
                return pa.RecordBatch.from_arrays([pa.array(a, pa.list_(pa.int64())), pa.array(b, pa.int64()), pa.array(c, pa.int32()), pa.array(d, pa.binary())], ["doc_ids", "first_start", "n_tokens", "ids"])

        for b in batches:
            fresh, size = [held], 0
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = encode(text, vocabulary)
                ids.append(END)
                fresh.append(np.array(ids, np.uint16))
                parts.append((doc, 0, len(ids)))
                size += len(ids)
                if size > 1 << 20:
                    held, fresh, size = np.concatenate(fresh), [], 0
                    if (done := cut()) is not None:
                        yield done
                    fresh = [held]
            held = np.concatenate(fresh)
            if (done := cut()) is not None:
                yield done
        if (done := cut(last=True)) is not None:
            yield done

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_ids array<long>, first_start long, n_tokens int, ids binary")


def place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "", 1))


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def shard_size(total: int) -> int:
    """Slots of a shard for ``total`` sequences."""
    rows = SHARD_ROWS
    while rows * MOST_SHARDS < total:
        rows *= 2
    return rows


def materialise(docs: DataFrame, out: str, length: int = LENGTH, shard_rows: int | None = None, key: int = KEY, vocabulary: str = VOCABULARY, scratch: Scratch | None = None) -> DataFrame:
    """Writes the shards of ``docs(doc_id, text)`` to the folder ``out``, which all executors must share.

    Returns a row per sequence: slot, shard, byte_offset, doc_ids, first_start, n_tokens, ids_crc32.
    """
    spark, scratch = docs.sparkSession, scratch or Scratch(docs.sparkSession, "tokens")
    table = scratch.save(sequences(docs, length, vocabulary).withColumn("uid", F.monotonically_increasing_id()), "sequences")
    counts = scratch.save(table.groupBy(F.shiftright("uid", 33).alias("task")).agg(F.count("*").alias("n")), "counts")  # a row per task
    total, tasks = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    shard_rows = shard_rows or shard_size(total)
    before = counts.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("before"))
    before = F.broadcast(before) if tasks <= BROADCAST_TASKS else before

    def placed(batches):
        z = zstandard.ZstdCompressor(9)
        for b in batches:
            slot = permuted(b.column("number").to_numpy(), total, key)
            shard, ids = (slot // shard_rows).astype(np.int32), pa.array([z.compress(x.as_py()) for x in b.column("ids")], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(slot), b.column("doc_ids"), b.column("first_start"), b.column("n_tokens"), ids], ["shard", "slot", "doc_ids", "first_start", "n_tokens", "ids"])

    rows = table.withColumn("task", F.shiftright("uid", 33)).join(before, "task").withColumn("number", F.col("before") + F.col("uid").bitwiseAND((1 << 33) - 1))
    rows = rows.select("number", "doc_ids", "first_start", "n_tokens", "ids").mapInArrow(placed, "shard int, slot long, doc_ids array<long>, first_start long, n_tokens int, ids binary")
    shards = max(1, -(-total // shard_rows))
    rows = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("slot")
    names = ["slot", "shard", "byte_offset", "doc_ids", "first_start", "n_tokens", "ids_crc32"]

    def write(batches):
        sink, z = None, zstandard.ZstdDecompressor()
        for b in batches:
            if sink is None and len(b):
                shard = b.column("shard")[0].as_py()
                system, path = place(out)
                system.create_dir(path)
                temporary = f"{path}/.{shard_name(shard)}-{uuid.uuid4().hex}"
                sink = system.open_output_stream(temporary)
            crcs = []
            for x in b.column("ids"):
                data = z.decompress(x.as_py())
                sink.write(data)
                crcs.append(zlib.crc32(data))
            offset = (b.column("slot").to_numpy() % shard_rows) * length * 2
            yield pa.RecordBatch.from_arrays([b.column("slot"), b.column("shard"), pa.array(offset), b.column("doc_ids"), b.column("first_start"), b.column("n_tokens"), pa.array(crcs, pa.int64())], names)
        if sink is not None:
            sink.close()
            system.move(temporary, f"{path}/{shard_name(shard)}")

    index = rows.mapInArrow(write, "slot long, shard int, byte_offset long, doc_ids array<long>, first_start long, n_tokens int, ids_crc32 long")
    return scratch.save(index, "index")


def read(out: str, slot: int, count: int, total: int, length: int = LENGTH, shard_rows: int | None = None):
    """Yields the ids of ``count`` sequences in training order from ``slot`` on: a seek, then sequential reads."""
    shard_rows = shard_rows or shard_size(total)
    system, path = place(out)
    at, end = slot, min(total, slot + count)
    while at < end:
        shard, first = divmod(at, shard_rows)
        n = min(end - at, shard_rows - first)
        with system.open_input_file(f"{path}/{shard_name(shard)}") as f:
            f.seek(first * length * 2)
            for _ in range(n):
                yield np.frombuffer(f.read(length * 2), "<u2")
        at += n


def op5_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards go to a new folder ``training-order/...`` in the shared folder and stay there; ``path`` names each."""
    out = f"{shared_dir(spark)}/training-order/{uuid.uuid4().hex}"
    index = materialise(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), out)
    return index.withColumn("path", F.format_string(f"{out}/shard-%08d.bin", "shard"))
