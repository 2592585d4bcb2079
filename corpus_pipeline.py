"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing, token ids.

Each stage takes all rows that the one before kept, and all but the last give the columns of documents. Null ids are
allowed throughout and come first in the token files; null and empty texts fail the base rules and go; an empty table
gives no rows; extra columns, whatever their names, are handed on up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sieveline.llm.common import materialize, table
from sieveline.llm.decontaminate import drop_contaminated
from sieveline.llm.mixing import mixed_documents
from sieveline.llm.queries import tokenizer_path
from sieveline.llm.rules import kept_documents
from sieveline.llm.simhash import keep_one_per_component
from sieveline.llm.tokenbin import token_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither fail the base checks nor meet a rule learned from the training fold's labels; repeated rows are judged alike."""
    return kept_documents(docs, table(spark, sf_dir, "labels"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component: the smallest id; of components of null ids alone, one row; of rows that repeat an id, one."""
    return keep_one_per_component(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item matches; benchmark items that are null or empty match nothing."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row each time a document is taken, at most twice; a document at the edge of a shard's run comes in part. A null source is a source of its own, the last."""
    return mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each row of the mix, from the token files read back; repeated ids are in the order of their texts."""
    return token_documents(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("token_ids", token_ids),
]

#: Learned rules, hashes of shingles and tokenizer ids are beyond SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
