"""Each stage of the pipeline by brute force on its own input, and odd documents through all of them."""

import ast
import pathlib

import regex
from pyspark.sql import functions as F

import corpus_pipeline
from tarnlight.llm import toxicity as tox
from tests.llm.brute import shingle_set
from tests.llm.test_similar import labels_of
from tests.llm.test_suffix_dedup import left_of, odd_rows
from tests.llm.test_toxicity import plain_score


def words_of(text):
    return regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())


def stages(spark, docs, sf, tmp_path):
    """Rows into and out of each stage."""
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{i}")
        out = spark.read.parquet(f"{tmp_path}/{i}")
        yield name, docs, out
        docs = out


def test_stages_on_the_table(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, []
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").filter("toxic = 1").collect()}
    items = [shingle_set(words_of(r["text"])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, before, after in stages(spark, docs, sf, tmp_path):
        seen.append(name)
        old, new = ({r["doc_id"]: r for r in x.collect()} for x in (before, after))
        if name != "packing":
            assert after.columns == columns and new.keys() <= old.keys()
        if name == "toxicity":
            gone = old.keys() - new.keys()
            labelled = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
            assert len(gone & toxic) >= 0.8 * len(toxic) and len(gone & (labelled - toxic)) <= 0.05 * len(labelled)
            model = tox.train(tox.labelled(before, spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")))
            assert gone == {i for i, r in old.items() if plain_score(r["text"], model) >= tox.THRESHOLD}
        elif name == "simhash":
            ids = sorted(old)
            group = labels_of([old[i]["text"] for i in ids])
            assert new.keys() == {ids[g] for g in set(group)}
        elif name == "suffix":
            ids = sorted(old)
            left = left_of([old[i]["text"].encode() for i in ids])
            assert {i: r["text"] for i, r in new.items()} == {i: t for i, (x, gone, _) in zip(ids, left, strict=True) if (t := x.decode("utf-8", "ignore")) or not gone}
            assert all(len(r["text"]) == r["n_chars"] for i, r in new.items() if r["text"] != old[i]["text"])
        elif name == "decontamination":
            leaks = {d for d, r in old.items() if any(5 * len(shingle_set(words_of(r["text"])) & s) >= 4 * len(s) for s in items)}
            assert old.keys() - new.keys() == leaks
        else:
            assert new.keys() == old.keys() and all(c in after.columns for c in ("bin", "bin_offset", "bin_capacity"))
    assert seen == ["toxicity", "simhash", "suffix", "decontamination", "packing"]


def test_odd_documents(spark, sf, docs_of, tmp_path):
    docs = docs_of(odd_rows())
    for name in ("k1", "spans", "score", "_id", "fp", "row", "bin"):
        docs = docs.withColumn(name, F.lit("clash"))
    for name, before, after in stages(spark, docs, sf, tmp_path):
        assert name == "packing" or after.columns == docs.columns
        assert before.count() >= after.count() > 0 or name == "packing"
    for i, (_, _, after) in enumerate(stages(spark, docs.limit(0), sf, tmp_path / "none")):
        assert after.count() == 0, i


def test_rows_of_one_id_are_judged_by_their_own_text(spark, docs_of, tmp_path):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, item), (1, "a clean text"), (1, None), (None, item), (None, "another clean text"), (None, None), (2, item + " nu"), (3, "clean")]
    kept = corpus_pipeline.drop_leaks(spark, docs_of(rows).withColumn("_key", F.lit("clash")), str(tmp_path))
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted((r for r in rows if item not in (r[1] or "")), key=str)


def test_run_gives_the_last_stage(spark, sf):
    assert corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_only_the_entry_guards_imports():
    root = pathlib.Path(corpus_pipeline.__file__).parent
    for path in [root / "corpus_pipeline.py", *(root / "tarnlight/llm").glob("*.py")]:
        for node in ast.walk(ast.parse(path.read_text())):
            assert not (isinstance(node, ast.ExceptHandler) and "Import" in ast.dump(node.type or ast.Constant("ImportError"))), path
    for path in (root / "tarnlight").rglob("*.py"):
        if "llm" not in path.parts:
            assert "tarnlight.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text(), path
