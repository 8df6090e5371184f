"""A corpus pipeline out of five operators; each stage works on all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, all but the last with the columns
of documents. What a stage returns is written as Parquet and read again for the next one, as run()
does; so a stage begins with removing the intermediate tables of the one before it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revtally.llm import byte_bpe, jaccard_trie, mixing, perplexity, suffix_dedup
from revtally.llm.common import collecting, remove, saved, ship


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

_left: list[str] = []


def staged(function: Stage) -> Stage:
    """Removes what the stage before has left, and notes what this one leaves."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove(spark, _left)
        with collecting() as made:
            out = function(spark, docs, sf_dir)
        _left.extend(made)
        return out

    return run_stage


@staged
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or lie outside of their language's band."""
    return perplexity.kept_documents(docs)


@staged
def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of each group of near-duplicates."""
    return jaccard_trie.one_of_each(docs)


@staged
def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated passages out of the texts; every document stays, with what is left of it."""
    return suffix_dedup.cleaned_documents(docs)


@staged
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes every document as often as the mix does."""
    return mixing.mixed(docs)


@staged
def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the texts, and decodes the ids again for a digest of what they stand for."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = docs.select("doc_id", "lang", "source", "text")
    encoded = byte_bpe.encode(rows, path, public_tokenizers.PATTERN, drop_text=True, round_trip=True)
    return encoded.withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("suffix-array dedup", suffix_array_dedup),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", byte_level_bpe),
]

#: SQL can't express the model, the merge of transforms or the encoding; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
