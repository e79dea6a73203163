"""The training-data pipeline: quality, near-duplicates, decontamination, mixing, sharding.

Every stage takes the rows its predecessor kept, as a table with the columns of ``documents``, and returns what it keeps.

Defined cases: null texts are empty; null and repeated ids stay separate rows, each decided by its own text; further columns
pass through all stages whatever their names, but for ``shard``, which the last stage sets; an empty table gives an empty
result. Whole texts are shuffled once by the near-duplicate stage and once by the mix, by the others not at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rillstone.llm import decontamination, mixing, quality, sharding, simhash
from rillstone.llm.common import dropped, table, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, fitted on their labelled part, accepts."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates."""
    return simhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontamination.remove(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: whole epochs are repeated rows, and a source's last document may be shortened."""
    return mixing.apply_mix(docs)


def in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the shard of their id."""
    return sharding.with_shards(docs)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("sharding", in_shards),
]

#: The quality model and the fingerprints have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage keeps is written and read again by the next."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            dropped(before)  # the next stage's table is complete
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
