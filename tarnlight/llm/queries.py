"""The registered queries of this subpackage."""

from __future__ import annotations

import corpus_pipeline
from tarnlight.llm import decontam, embed_dedup, html_extract, packing, sharding, simhash, suffix_dedup, token_output, toxicity, url_filter


def queries():
    all_of = (
        html_extract.op1_html_extract, simhash.op2_simhash, decontam.op3_decontamination, url_filter.op4_url_filter, token_output.op5_training_order, toxicity.op6_toxicity,
        packing.op7_best_fit_packing, sharding.op8_sharding, embed_dedup.op9_embedding_dedup, suffix_dedup.op10_suffix_dedup,
    )
    return {f.__name__: f for f in all_of} | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    return {"op3_decontamination": decontam.SQL, "op4_url_filter": url_filter.SQL}
