"""Queries and DuckDB statements of the corpus operators, for ``__spark_entry__``."""

from __future__ import annotations

from strata.llm import bpe, hmm, html_text, media, mixing, near_dedup, quality_classifier, quality_rules, secrets, url_filter

QUERIES = {
    "op1_quality_rules": quality_rules.query,
    "op2_quality_classifier": quality_classifier.query,
    "op3_url_filter": url_filter.query,
    "op4_minhash_forest": near_dedup.query,
    "op5_flac_media": media.query,
    "op6_secret_scan": secrets.query,
    "op7_byte_bpe": bpe.query,
    "op8_hmm_score": hmm.query,
    "op9_html_text": html_text.query,
    "op10_source_mixing": mixing.query,
}

ORACLE_SQL = {
    "op1_quality_rules": quality_rules.oracle_sql(),
    "op3_url_filter": url_filter.oracle_sql(),
    "op6_secret_scan": secrets.oracle_sql(),
    "op10_source_mixing": mixing.oracle_sql(),
}
