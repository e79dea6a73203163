"""Where requests go: handlers by tags, consistent hashing, scatter-gather, and what comes back. All are joins and groupings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stages import running

#: Fixed value: points that a member has on the ring if it doesn't say.
LOAD_FACTOR = 100


def best_handlers(requests: DataFrame, handlers: DataFrame, command: str = "command") -> DataFrame:
    """(request, client, score) of the handlers of each request's command whose tags fit its metadata best, all of equal rank.

    A tag counts 1 if the metadata has its value, -1 if it has another, 0 if it has none. ``handlers`` has command, client
    and a map of tags, ``requests`` has request, command and a map of metadata; they meet by command only.
    """
    pairs = requests.join(handlers, command)
    fits = lambda e: F.when(F.try_element_at("metaData", e["key"]).isNull(), 0).when(F.try_element_at("metaData", e["key"]) == e["value"], 1).otherwise(-1)
    scored = pairs.select("request", "client", F.aggregate(F.transform(F.map_entries("tags"), fits), F.lit(0), lambda a, x: a + x).alias("score"))
    best = scored.groupBy("request").agg(F.max("score").alias("score"))
    return scored.join(best, ["request", "score"]).select("request", "client", "score")


def candidates_of(handlers: DataFrame, candidates: DataFrame) -> DataFrame:
    """The registered handlers among the candidate clients, as one sorted list of clients for each query and component."""
    fit = handlers.join(candidates.select("client").distinct(), "client", "left_semi")
    return fit.groupBy("query", "component").agg(F.sort_array(F.collect_set("client")).alias("clients"))


def ring(members: DataFrame) -> DataFrame:
    """The points of a hash ring: ``loadFactor`` of each member (100 if null), ordered by their digests as text."""
    many = members.select("member", F.coalesce("loadFactor", F.lit(LOAD_FACTOR)).cast("int").alias("_n")).where("_n > 0")
    points = many.select("member", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("i"))
    return points.select("member", F.md5(F.concat("member", F.lit(" #"), F.col("i").cast("string")).cast("binary")).alias("point"))


def route(requests: DataFrame, members: DataFrame, key: str = "key") -> DataFrame:
    """Each request with the member at the first point at or after its key's digest, past the end that of the first point.

    Ring and requests meet by the first two digits of the digest: an arc holds its own points and the one that follows it,
    so a request sees some of the ring only, and the join is on 256 keys at least (hot ones are split by adaptive execution).
    """
    arcs = [f"{i:02x}" for i in range(256)]
    points = ring(members)
    spark = requests.sparkSession
    every = spark.createDataFrame([(a,) for a in arcs], "arc string")
    own = every.join(points.withColumn("arc", F.left("point", F.lit(2))), "arc", "left").groupBy("arc").agg(F.sort_array(F.collect_list(F.when(F.col("point").isNotNull(), F.struct("point", "member")))).alias("own"))
    # 256 rows: each arc's successor is the first point of the next arc that has one, or of the ring
    ahead = Window.orderBy("arc").rowsBetween(1, Window.unboundedFollowing)
    first = F.when(F.size("own") > 0, F.get("own", F.lit(0)))
    following = F.coalesce(F.first(first, ignorenulls=True).over(ahead), F.first(first, ignorenulls=True).over(Window.orderBy("arc").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    arcs_ = own.withColumn("_next", following)
    placed = requests.withColumn("_h", F.md5(F.col(key).cast("string").cast("binary"))).withColumn("arc", F.left("_h", F.lit(2)))
    chosen = F.coalesce(F.get(F.filter("own", lambda p: p["point"] >= F.col("_h")), F.lit(0)), F.col("_next"))
    return placed.join(arcs_, "arc").withColumn("member", chosen["member"]).drop("_h", "arc", "own", "_next")


def scattered(requests: DataFrame, handlers: DataFrame, query: str = "query") -> DataFrame:
    """One handler of each component for every request of a query, in turn: (token, query, component, handler).

    ``requests`` has token and query; their turns are counted in stretches of tokens. ``handlers`` has query, component, handler.
    """
    turns = running(requests.select("token", query), F.lit(1), [query]).select("token", query, (F.col("_n") - 1).alias("_turn"))
    lists = handlers.groupBy(query, "component").agg(F.sort_array(F.collect_set("handler")).alias("_all"))
    return turns.join(lists, query).select("token", query, "component", F.get("_all", (F.col("_turn") % F.size("_all")).cast("int")).alias("handler"))


def merged(responses: DataFrame, request: str, order: str, failed: str, carry: Sequence[str] = ()) -> DataFrame:
    """What a caller gets of the responses to each request: all successes, and the last failure if no success came after it."""
    last_good = responses.where(~F.col(failed)).groupBy(request).agg(F.max(order).alias("_good"))
    last_bad = responses.where(F.col(failed)).groupBy(request).agg(F.max_by(F.struct(order, failed, *carry), order).alias("_bad"))
    left = last_bad.join(last_good, request, "left").where(F.col("_good").isNull() | (F.col(f"_bad.{order}") > F.col("_good")))
    return responses.where(~F.col(failed)).select(request, order, failed, *carry).unionByName(left.select(request, "_bad.*"))
