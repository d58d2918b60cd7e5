"""Training-corpus pipeline: quality rules, exact dedup, near dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every stage's rows to
a table in the shared folder and hands that to the next one, so a lost executor repeats at most one
stage.  All stages but the last return the columns of ``documents``; source mixing repeats rows.

Defined cases are those of the operators; a stage that gets no rows returns none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from billcov.llm import exact_dedup, ngram_join, packing, quality_rules, source_mixing
from billcov.llm.common import table, written
from billcov.llm.queries import word_tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Near duplicates: five words, a similarity of 0.8 or more.
NEAR_SHINGLE, NEAR_THRESHOLD = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: rejected documents go.  Texts stay as they are, so that copies on other hosts stay equal."""
    return quality_rules.kept_documents(docs, min_line_words=1)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of equal texts the document with the smallest identifier stays."""
    return exact_dedup.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of each group of near copies the document with the smallest identifier stays."""
    return ngram_join.one_of_each(docs, shingle=NEAR_SHINGLE, threshold=NEAR_THRESHOLD)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents repeated to the sources' target weights, shuffled."""
    return source_mixing.mixed(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: pieces of token sequences, with their ids."""
    return packing.pack_documents(docs, word_tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("ngram_join", near),
    ("source_mixing", mix),
    ("packing", pack),
]

#: Tokenisation and greedy packing have no SQL form; tests compare run() with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
