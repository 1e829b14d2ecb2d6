"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from tablelens.llm import collocations, decontamination, exact_dedup, jaccard_join, language, license_scan, mixing, pii, prefix_trie, quality, suffix_dedup, token_counts, toxicity
from tablelens.llm.common import table


def op1_license_scan(spark, sf_dir):
    return license_scan.license_scan(license_scan.laid_out(table(spark, sf_dir, "documents")), "doc_id", "path")


def op2_source_mixing(spark, sf_dir):
    return mixing.mixed_documents(table(spark, sf_dir, "documents"))


def op3_token_counts(spark, sf_dir):
    import public_tokenizers

    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_benchmark_decontamination(spark, sf_dir):
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_suffix_array_dedup(spark, sf_dir):
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark, sf_dir):
    return quality.predict(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_language_id(spark, sf_dir):
    return language.predict(table(spark, sf_dir, "documents"))


def op10_toxicity(spark, sf_dir):
    return toxicity.predict(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_personal_data(spark, sf_dir):
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark, sf_dir):
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_source_mixing, op3_token_counts, op4_benchmark_decontamination, op5_suffix_array_dedup, op6_exact_dedup, op7_jaccard_join, op8_quality_classifier, op9_language_id, op10_toxicity, op11_personal_data, op12_conversation_trie, op13_collocations)}
ORACLE = {"op1_license_scan": license_scan.SQL, "op2_source_mixing": mixing.SQL, "op4_benchmark_decontamination": decontamination.SQL, "op5_suffix_array_dedup": suffix_dedup.SQL, "op7_jaccard_join": jaccard_join.SQL, "op6_exact_dedup": exact_dedup.SQL, "op12_conversation_trie": prefix_trie.SQL, "op13_collocations": collocations.SQL}
