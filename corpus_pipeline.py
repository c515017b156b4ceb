"""A training-data pipeline: quality rules, near and substring de-duplication, mixing, tokens.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next stage's ``docs``.  All but the
last keep the columns of ``documents``.  A stage's intermediate tables are
needed until its output is written, so the next stage removes them first.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readpaths.llm import bpe_queue, quality_kn, raking, simhash_ring, substring_dedup
from readpaths.llm.shared import delete, recorded, shared_path

VOCABULARY = "byte_bpe_50k.tiktoken"
MIX_SHARE = 0.8  # of the tokens that reach the mixing stage


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_LEFT: list[str] = []  # intermediate tables of the last stage


def stage(fn: Stage) -> Stage:
    """``fn``, after removing what the stage before left behind."""

    @functools.wraps(fn)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        delete(spark, _LEFT)
        _LEFT.clear()
        with recorded() as made:
            out = fn(spark, docs, sf_dir)
        _LEFT.extend(made)
        return out

    return run


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality_kn.keep(docs, whole=True)


@stage
def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies."""
    return simhash_ring.keep_one(docs)


@stage
def substring_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that start in an earlier document; ``n_chars`` is that of what is left."""
    kept = substring_dedup.repeats(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


@stage
def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A draw of the documents by raked source, language and topic weights."""
    dims = {"source": F.col("source"), "lang": F.col("lang"), "topic": raking.topic(F.col("text"))}
    return raking.mix(docs, dims, raking.words(F.col("text")), MIX_SHARE).drop("mix")


@stage
def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, with digests of the ids and of what they decode to."""
    path, pattern = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    return bpe_queue.decode(bpe_queue.encode(docs, path, pattern, carry=("doc_id", "lang", "source")), path, pattern)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_repeats),
    ("mixing_sources", mixing_sources),
    ("byte_bpe", byte_bpe),
]

#: Neither the perplexity bands nor BPE can be put as SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, before = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"), []
    for name, apply in STAGES:
        path = shared_path(spark, f"stage-{name}")
        apply(spark, docs, sf_dir).write.parquet(path)
        delete(spark, before)
        docs, before = spark.read.parquet(path), [path]
    return docs
