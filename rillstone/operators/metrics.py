"""Request metrics over logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sliding_counts(log: DataFrame, bucket_ms: int = 5_000, window_ms: int = 60_000) -> DataFrame:
    """Events in each bucket and in the window that ends with it, by type; only buckets are sorted."""
    buckets = log.groupBy("payloadType", F.floor(F.col("timestamp") / bucket_ms).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    frame = Window.partitionBy("payloadType").orderBy("bucket").rangeBetween(-(window_ms // bucket_ms), 0)
    return buckets.withColumn("inWindow", F.sum("n").over(frame))


def latencies(log: DataFrame, value: str, points: Sequence[float] = (0.5, 0.9, 0.95, 0.99), bins: int = 4096) -> DataFrame:
    """Exact interpolated percentiles of a value by type.

    Counts in ranges of the value (at most ``bins`` rows a type, combined before the shuffle) say in which ranges the wanted
    ranks are; only the values of those few ranges are shuffled, counted and put in order.
    """
    rows = log.select("payloadType", F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    ends = rows.groupBy("payloadType").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n"))
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(F.lit(0)).cast("long")
    placed = rows.join(ends, "payloadType").select("payloadType", "v", place.alias("bin"))
    by_bin = placed.groupBy("payloadType", "bin").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("payloadType").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_bin.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0))).withColumnRenamed("c", "inBin")
    ranks = ends.select("payloadType", F.posexplode(F.array(*[F.lit(float(p)) * (F.col("n") - 1) for p in points])).alias("point", "rank"))
    wanted = ranks.select("payloadType", "point", "rank", F.explode(F.array(F.floor("rank"), F.ceil("rank"))).alias("at"))
    hit = wanted.join(offsets, "payloadType").where((F.col("at") >= F.col("before")) & (F.col("at") < F.col("before") + F.col("inBin"))).select("payloadType", "point", "rank", "at", "bin", "before")
    inside = Window.partitionBy("payloadType", "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    near = placed.join(hit.select("payloadType", "bin").distinct(), ["payloadType", "bin"], "left_semi")
    few = near.groupBy("payloadType", "bin", "v").agg(F.count(F.lit(1)).alias("c")).withColumn("upTo", F.sum("c").over(inside))
    met = hit.join(few, ["payloadType", "bin"]).where((F.col("at") - F.col("before") < F.col("upTo")) & (F.col("at") - F.col("before") >= F.col("upTo") - F.col("c")))
    share = F.max(F.col("rank") - F.floor("rank"))
    values = met.groupBy("payloadType", "point").agg((F.min("v") + (F.max("v") - F.min("v")) * share).alias("x"))
    named = [F.round(F.max(F.when(F.col("point") == i, F.col("x"))), 6).alias(f"p{round(100 * p)}") for i, p in enumerate(points)]
    return values.groupBy("payloadType").agg(*named)


def composite(parts: DataFrame, key: str) -> DataFrame:
    """Merged (count, min, max, mean) rows: the mean is weighted by the counts."""
    return parts.groupBy(key).agg(F.sum("count").alias("count"), F.min("min").alias("min"), F.max("max").alias("max"), F.round(F.sum(F.col("mean") * F.col("count")) / F.sum("count"), 6).alias("mean"))


def silent(log: DataFrame, now_ms: int, after_ms: int) -> DataFrame:
    """Aggregates without an event in the last ``after_ms`` before ``now_ms``."""
    seen = log.groupBy("aggregateIdentifier").agg(F.max("timestamp").alias("lastSeen"))
    return seen.where(F.col("lastSeen") < now_ms - after_ms)


def rates(log: DataFrame, now_ms: int, started_ms: int, windows_s: Sequence[int] = (60, 300, 900), per_s: int = 1, keys: Sequence[str] = ()) -> DataFrame:
    """Events in the last so many seconds (whole ones), divided by them without a rest, or by the uptime if that is shorter."""
    second = F.floor(F.col("timestamp") / 1000)
    uptime = max(1, (now_ms - started_ms) // 1000)
    counts = [F.call_function("div", F.count_if((second >= (now_ms // 1000 - w)) & (F.col("timestamp") <= now_ms)) * per_s, F.lit(min(w, uptime))).alias(f"rate{w}") for w in windows_s]
    return log.groupBy(*keys).agg(*counts)


def timers(log: DataFrame, value: Column, tags: Sequence[str]) -> DataFrame:
    """Count, mean and largest of a time by its tags; combined before the shuffle, so one hot tag is no burden."""
    found = log.withColumn("_t", value).groupBy(*tags).agg(F.count("_t").alias("count"), F.round(F.avg("_t"), 6).alias("mean"), F.max("_t").alias("max"))
    return found


def subscriptions(log: DataFrame, query: str, subscription: str, kind: Column) -> DataFrame:
    """Of ``start``, ``cancel`` and ``update`` rows by query: subscriptions ever started, active ones, and updates.

    A cancellation counts if its subscription was started and not cancelled since.
    """
    rows = log.withColumn("_kind", kind).where("_kind is not null")
    began = rows.where(F.col("_kind") != "update").withColumn("_before", F.lag("_kind").over(Window.partitionBy(query, subscription).orderBy("token")))
    ended = F.count_if((F.col("_kind") == "cancel") & F.coalesce(F.col("_before") == "start", F.lit(False)))
    states = began.groupBy(query).agg(F.count_if(F.col("_kind") == "start").alias("total"), ended.alias("_ended"))
    updates = rows.groupBy(query).agg(F.count_if(F.col("_kind") == "update").alias("updates"))
    return updates.join(states, query, "left").select(query, F.coalesce("total", F.lit(0)).alias("total"), (F.coalesce("total", F.lit(0)) - F.coalesce("_ended", F.lit(0))).alias("active"), "updates")
