"""Queries of the subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import alignment, chunks, conversations, decontamination, licenses, pieces, quality, sharding, similarity, suffixes, toxicity, url_filters, wrappers
from .shared import table


def op1_toxicity(spark, folder):
    return toxicity.documents_to_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op2_ngram_jaccard_join(spark, folder):
    return similarity.documents_to_components(table(spark, folder, "documents"))


def op3_quality_rules(spark, folder):
    return quality.documents_to_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op4_url_filters(spark, folder):
    return url_filters.pages_to_verdicts(table(spark, folder, "pages"))


def op5_html_extraction(spark, folder):
    return wrappers.pages_to_texts(table(spark, folder, "pages"))


def op6_sharding(spark, folder):
    return sharding.documents_to_shards(table(spark, folder, "documents"))


def op7_substring_dedup(spark, folder):
    return chunks.documents_to_repeats(table(spark, folder, "documents"))


def op8_benchmark_decontamination(spark, folder):
    return decontamination.overlaps(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op9_suffix_array_dedup(spark, folder):
    return suffixes.documents_to_cuts_and_passages(table(spark, folder, "documents"))


def op10_sentencepiece(spark, folder):
    return pieces.documents_to_pieces(table(spark, folder, "documents"))


def op11_license_scans(spark, folder):
    return licenses.documents_to_licenses(table(spark, folder, "documents"))


def op12_conversation_repair(spark, folder):
    return conversations.conversations_to_audits(table(spark, folder, "conversations"))


def op13_cross_tokenizer_alignment(spark, folder):
    return alignment.documents_to_alignment(table(spark, folder, "documents"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_quality_rules": op3_quality_rules,
    "op4_url_filters": op4_url_filters,
    "op5_html_extraction": op5_html_extraction,
    "op6_sharding": op6_sharding,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_license_scans": op11_license_scans,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_cross_tokenizer_alignment": op13_cross_tokenizer_alignment,
}

SQL = {"op4_url_filters": url_filters.SQL, "op11_license_scans": licenses.SQL}
