"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import op1_html_extraction, op2_decontamination, op3_language_id, op4_bpe, op5_quality, op6_exact_dedup, op7_url_filter, op8_sharding, op9_pii, op10_jaccard_join, op11_simhash, op12_whitening, op13_spelling
from .common import table


def vocabulary_path() -> str:
    """The installed byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_html_extraction_query(spark, sf_dir):
    return op1_html_extraction.extract(table(spark, sf_dir, "pages"))


def op2_decontamination_query(spark, sf_dir):
    return op2_decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_language_id_query(spark, sf_dir):
    return op3_language_id.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op4_bpe_query(spark, sf_dir):
    return op4_bpe.roundtrip(table(spark, sf_dir, "documents"), vocabulary_path())


def op5_quality_query(spark, sf_dir):
    return op5_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_exact_dedup_query(spark, sf_dir):
    return op6_exact_dedup.classify(table(spark, sf_dir, "documents"))


def op7_url_filter_query(spark, sf_dir):
    return op7_url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op8_sharding_query(spark, sf_dir):
    return op8_sharding.shard(table(spark, sf_dir, "documents"))


def op9_pii_query(spark, sf_dir):
    return op9_pii.find(table(spark, sf_dir, "documents"))


def op10_jaccard_join_query(spark, sf_dir):
    return op10_jaccard_join.join(table(spark, sf_dir, "documents"))


def op11_simhash_query(spark, sf_dir):
    return op11_simhash.near(table(spark, sf_dir, "documents"))


def op12_whitening_query(spark, sf_dir):
    return op12_whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_spelling_query(spark, sf_dir):
    return op13_spelling.variants(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_html_extraction": op1_html_extraction_query,
    "op2_decontamination": op2_decontamination_query,
    "op3_language_id": op3_language_id_query,
    "op4_bpe": op4_bpe_query,
    "op5_quality": op5_quality_query,
    "op6_exact_dedup": op6_exact_dedup_query,
    "op7_url_filter": op7_url_filter_query,
    "op8_sharding": op8_sharding_query,
    "op9_pii": op9_pii_query,
    "op10_jaccard_join": op10_jaccard_join_query,
    "op11_simhash": op11_simhash_query,
    "op12_whitening": op12_whitening_query,
    "op13_spelling": op13_spelling_query,
}

#: op8's crc32 has no counterpart in DuckDB, so its SQL leaves text_crc32 out and is used by the tests alone.
ORACLE_SQL = {
    "op6_exact_dedup": op6_exact_dedup.ORACLE,
    "op7_url_filter": op7_url_filter.oracle(),
}
