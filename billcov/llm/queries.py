"""Registered queries of the training-data operators: name -> callable(spark, sf_dir) -> DataFrame.

Each applies its operator with production parameters to a whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billcov.llm import collocations, exact_dedup, license_scan, minhash_dedup, ngram_join, oracle, packing, prefix_trie, quality_classifier, quality_rules, secret_scan, source_mixing, url_filter, warc_table
from billcov.llm.common import shared_folder, table

Query = Callable[[SparkSession, str], DataFrame]


def word_tokenizer_path() -> str:
    """Vocabulary file of the public tokenizers."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by 4-word shingles at 85 % Jaccard."""
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans with ownership frequency."""
    return secret_scan.digest(secret_scan.secret_spans(table(spark, sf_dir, "documents")))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages against a dated domain list, as of their fetch day."""
    return url_filter.filtered_pages(spark, sf_dir)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents repeated to tempered source weights, shuffled globally."""
    return source_mixing.mixed(table(spark, sf_dir, "documents"))


def op5_warc_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC archives and read back."""
    return warc_table.digest(warc_table.archived(table(spark, sf_dir, "pages"), shared_folder(spark, "warc")))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost-balanced packing; pieces with a checksum of their ids."""
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), word_tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict by cross-document line frequency."""
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), min_line_words=1).drop("removed_lines")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner of every document's text through radix tries."""
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and covered template spans."""
    return license_scan.digest(license_scan.license_spans(table(spark, sf_dir, "documents")))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return quality_classifier.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie of the conversations, rebuilt on shared heads."""
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components by 2-word shingles at 80 % Jaccard, one document of each kept."""
    return minhash_dedup.minhash_components(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of two and three words of each language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_secret_scan": op2_secret_scan,
    "op3_url_filter": op3_url_filter,
    "op4_source_mixing": op4_source_mixing,
    "op5_warc_table": op5_warc_table,
    "op6_packing": op6_packing,
    "op7_quality_rules": op7_quality_rules,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_license_scan": op9_license_scan,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_minhash_dedup": op12_minhash_dedup,
    "op13_collocations": op13_collocations,
}

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_join": oracle.OP1,
    "op2_secret_scan": oracle.OP2,
    "op3_url_filter": oracle.OP3,
    "op4_source_mixing": oracle.OP4,
    "op5_warc_table": oracle.OP5,
    "op7_quality_rules": oracle.OP7,
    "op8_exact_dedup": oracle.OP8,
    "op11_conversation_trie": oracle.OP11,
    "op12_minhash_dedup": oracle.OP12,
    "op13_collocations": oracle.OP13,
}
