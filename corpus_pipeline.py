"""A pipeline over ``documents``: quality rules, near duplicates, repeated
passages, mixing to target weights, tokens.

Each stage takes all documents that the one before it kept. A stage's result is
written as Parquet and read again as the next stage's documents.

Every stage bears null and empty texts, null and repeated doc_ids, null
languages and sources, empty tables and further columns of any name, which all
but the last pass on. Documents without words go in the first stage; repeated
rows stay or go together there, and are near duplicates of each other in the
second; an empty table goes through all stages and gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnfold.llm.common import Scratch, table
from tarnfold.llm.jaccard_join import keep_first
from tarnfold.llm.lexicon_bpe import round_trip
from tarnfold.llm.mixing import mix
from tarnfold.llm.robust_quality import keep_good
from tarnfold.llm.suffix_dedup import strip_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the robust outlier test keep."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of 5-word Jaccard
    similarity 0.8 or more."""
    return keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of 50-byte strings that start in an earlier one."""
    return strip_repeats(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, sorted by training position."""
    return mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each document's token ids, and of their decoding."""
    import public_tokenizers

    return round_trip(docs, public_tokenizers.path("word_bpe_49k.json"), ["doc_id", "lang", "source"])


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("mixed sources", mixed_sources),
    ("token ids", token_ids),
]

#: SQL can't express the robust estimates or the tokenizer; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last through a table in the
    shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.write(docs, f"stage{k}")
    return docs
