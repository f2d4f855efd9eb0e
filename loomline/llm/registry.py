"""The queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from . import collocations, decontaminate, exact_dedup, language_model, lexical, mixing, paragraphs, pieces, quality, simhash, toxicity, url_rules, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pipeline": corpus_pipeline.run,
    "op1_warc_zip": warc.query,
    "op2_toxicity": toxicity.query,
    "op3_simhash_near_dedup": simhash.query,
    "op4_mix_sources": mixing.query,
    "op5_url_rules": url_rules.query,
    "op6_quality": quality.query,
    "op7_paragraph_minhash": paragraphs.query,
    "op8_exact_dedup": exact_dedup.query,
    "op9_decontaminate": decontaminate.query,
    "op10_language_model": language_model.query,
    "op11_lexical_search": lexical.query,
    "op12_collocations": collocations.query,
    "op13_sentencepiece": pieces.query,
}

SQL: dict[str, str] = {
    "op1_warc_zip": warc.SQL,
    "op5_url_rules": url_rules.SQL,
    "op8_exact_dedup": exact_dedup.SQL,
    "op9_decontaminate": decontaminate.SQL,
    "op11_lexical_search": lexical.SQL,
    "op12_collocations": collocations.SQL,
}
