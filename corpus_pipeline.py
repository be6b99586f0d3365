"""A training corpus in five stages, each an operator of ``tallygrove.llm`` over all that the one before kept.

Every stage takes nulls in any column, empty and very long texts, repeated rows, extra
columns and empty tables; an empty table gives an empty result. What each makes of
them, its docstring and its operator's say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallygrove.llm import decontam, minhash, mixing, quality_classifier, sharding
from tallygrove.llm.common import forget, materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores below 0.3 go; null and empty texts are scored too, repeated rows alike."""
    return quality_classifier.reject_low(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of those whose shingles of five words are linked by a Jaccard similarity of 0.8 (found by SimHash, and by MinHash beyond its four bits), the one with the smallest id; null ids come last, wordless texts are one group."""
    return minhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that mostly consist of them go; null and wordless texts stay as they are."""
    return decontam.remove_overlaps(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the balanced rates, rounded, say; those without words have no weight and come as rounding has it."""
    return mixing.repeat_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with their shard of near equal bytes and their place in it; null texts count as empty, equal rows may be parted."""
    return sharding.assign_shards(docs, keep_rows=True)


STAGES = [("quality_classifier", quality), ("simhash_near_dedup", near_duplicates), ("benchmark_decontamination", decontaminate), ("source_mixing", mix_sources), ("histogram_sharding", shard)]

#: The stages fit a model, hash with XXH64 and iterate: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir))
        forget(before)
    # The last stage reads a written table of its own.
    out = STAGES[-1][1](spark, docs, sf_dir)
    forget(docs)
    return out
