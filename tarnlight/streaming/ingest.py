"""Continuous ingest: a folder of files, or a stream of texts, kept in an index batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlight.plans.corpus_index import CorpusIndex, inventory_of
from tarnlight.sources import corpus, readers


def file_stream(spark: SparkSession, root: str, pattern: str = "*", per_batch: int = 1_000) -> DataFrame:
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_batch).load(root)
    return corpus.walk(files, root)


def follow(stream: DataFrame, index: CorpusIndex, checkpoint: str, available_now: bool = True):
    """Starts a query that brings ``index`` up to each batch of ``stream(rel, size, mtime, content)``.

    Files of earlier batches stay: a batch replaces those it has, and writes no more than these. A batch that runs twice finds
    nothing changed. Files without text are kept with their status.
    """

    def apply(batch: DataFrame, _id: int) -> None:
        batch = batch.withColumn("n", F.row_number().over(Window.partitionBy("rel").orderBy(F.col("mtime").desc(), F.sha1("content")))).filter("n = 1").drop("n")
        index.sync(readers.extracted(batch).select("rel", "text", "status", "detail"), corpus.stat_rows(batch), partial=True)

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


__all__ = ["file_stream", "follow", "inventory_of"]
