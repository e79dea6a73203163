"""Event processors: what instances say of the segments that they have claimed.

Rows of ``claims``: processor, client, segment, onePartOf. Rows of ``instances``: processor, client, running, capacity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def warnings(claims: DataFrame) -> DataFrame:
    """For each processor: whether a segment is claimed twice, and whether the segments make up less than the whole."""
    once = claims.groupBy("processor", "segment").agg(F.count(F.lit(1)).alias("n"), F.min("onePartOf").alias("onePartOf"))
    share = F.sum(F.lit(1.0) / F.col("onePartOf"))
    return once.groupBy("processor").agg((F.max("n") > 1).alias("duplicates"), (share < 1).alias("missing"))


def largest(claims: DataFrame) -> DataFrame:
    """The segment to split in each processor: the one with the smallest onePartOf (of equals the lowest number)."""
    return _chosen(claims, F.min_by(F.struct("client", "segment", "onePartOf"), F.struct("onePartOf", "segment", "client")))


def smallest(claims: DataFrame) -> DataFrame:
    """The segment to merge in each processor: the one with the largest onePartOf, and the segment that it merges with.

    Segments of one size differ in their number's highest bit from the one that they were split from.
    """
    found = _chosen(claims, F.max_by(F.struct("client", "segment", "onePartOf"), F.struct("onePartOf", -F.col("segment"), "client")))
    half = F.call_function("div", F.col("onePartOf"), F.lit(2)).cast("int")
    return found.withColumn("mergesWith", F.col("segment").cast("int").bitwiseXOR(half).cast("long"))


def _chosen(claims: DataFrame, by) -> DataFrame:
    return claims.groupBy("processor").agg(by.alias("_s")).select("processor", "_s.*")


def roll_up(instances: DataFrame, claims: DataFrame) -> DataFrame:
    """For each processor: active threads, clients with free threads, and what can be done with it."""
    taken = claims.groupBy("processor", "client").agg(F.count(F.lit(1)).alias("n"), F.min("onePartOf").alias("least"))
    both = instances.join(taken, ["processor", "client"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rolled = both.groupBy("processor").agg(
        F.sum("n").cast("long").alias("activeThreads"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("n") < F.col("capacity"), F.col("client")))), ",").alias("freeClients"),
        F.bool_or("running").alias("canPause"),
        F.bool_or(~F.col("running")).alias("canPlay"),
        F.bool_or("running").alias("canSplit"),
        F.min("least").alias("_least"),
    )
    return rolled.withColumn("canMerge", F.col("canPause") & F.coalesce(F.col("_least") != 1, F.lit(True))).drop("_least")
