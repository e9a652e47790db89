"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one before kept; ``run`` writes each stage's rows
as Parquet and reads them again. All stages but the last return the columns of ``documents``.

1. toxicity: documents that the classifier rejects go.
2. simhash: one document of each group of near copies stays, the one with the smallest doc_id. Near copies share 0.8 or more
   of their five-word shingles (Jaccard), found by ball hashing over blocks of a wide SimHash and verified on the shingles;
   a document with no words is a copy of its like only.
3. suffix: every 200-byte string that occurs twice or more is removed; what is left of characters cut in two goes too.
   Documents of which nothing is left go, ``n_chars`` is brought up to date where the text changed.
4. decontamination: documents that hold a benchmark item go.
5. packing: what is left is cut into pieces and packed into sequences.

Defined results: a null text is non-toxic unless the classifier's intercept says otherwise, counts as a text without words
and stays null in stage 3. Rows with one and the same doc_id and text are copies: one stays in stage 2. Rows with one
doc_id and different texts are judged each by their own text. Empty tables give no rows; further columns of the documents are
carried along by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.llm import decontam, packing, similar, suffix_dedup, toxicity
from tarnlight.llm.common import Scratch, fresh


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "toxic")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.train(scratch.save(toxicity.labelled(docs, labels), "labelled"))
    (score,) = fresh(docs, "score")
    return toxicity.with_score(docs, model, name=score).filter(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.keep_one(docs, shingle=5, similarity=0.8, scratch=Scratch(spark, "near"))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.cleaned(docs, Scratch(spark, "repeats"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontam.clean(docs, benchmark, Scratch(spark, "leaks"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, scratch=Scratch(spark, "pack"))


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_copies), ("suffix", drop_repeats), ("decontamination", drop_leaks), ("packing", pack)]

#: The classifier, the fingerprints and the packing can't be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
