"""Stages of an event query: each takes and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds in the units that are plain spans of time.
UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
#: Rows that a limit without a number keeps, and that a query without a limit shows.
LIMIT, SHOWN = 1000, 200
#: Tokens that are accumulated together in a running aggregate.
BUCKET_TOKENS = 65_536


def start_of_last(amount: float, unit: str, now: datetime) -> datetime:
    """Start of the last so many units; weeks are cut to whole days, months and years to whole ones."""
    if unit in UNIT_SECONDS:
        return now - timedelta(seconds=int(amount * UNIT_SECONDS[unit]))
    if unit == "week":
        return now - timedelta(days=int(7 * amount))
    months = int(amount) * (12 if unit == "year" else 1)
    at = now.year * 12 + now.month - 1 - months
    year, month = divmod(at, 12)
    last = (datetime(year + (month == 11), (month + 1) % 12 + 1, 1) - timedelta(days=1)).day
    return now.replace(year=year, month=month + 1, day=min(now.day, last))


def last(log: DataFrame, amount: float, unit: str, now: datetime) -> DataFrame:
    """Events of the last so many units before ``now``; the comparison with the stored time reaches the scan."""
    return log.where(F.col("_at") >= F.lit(start_of_last(amount, unit, now).isoformat(sep=" ")).cast("timestamp_ntz"))


def last_of(log: DataFrame, spans: Sequence[tuple[float, str]], now: datetime) -> DataFrame:
    """Events of several time windows at once: the one that starts latest decides."""
    return log.where(F.col("_at") >= F.lit(max(start_of_last(n, unit, now) for n, unit in spans).isoformat(sep=" ")).cast("timestamp_ntz"))


def with_id(log: DataFrame) -> DataFrame:
    """The rows with their hidden identity: ``_id``, by which a limit chooses, and ``_sort``, by which they are shown."""
    return log.withColumns({"_id": F.col("token"), "_sort": F.col("token")})


def project(rows: DataFrame, **columns: Column) -> DataFrame:
    """Named expressions of the rows; the hidden identity is kept."""
    hidden = [c for c in ("_id", "_sort") if c in rows.columns]
    return rows.select(*[c.alias(name) for name, c in columns.items()], *hidden)


def limited(rows: DataFrame, n: int = LIMIT, ids: Sequence[str] = ("token",)) -> DataFrame:
    """The ``n`` rows with the largest ids (the token, or the keys of a group); no full sort. How they are shown plays no part."""
    return rows.orderBy(*[F.col(c).desc() for c in ids]).limit(n)


def answer(rows: DataFrame, ids: Sequence[str] = ("token",), sort: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """What a query shows: the rows with the largest ids, ``SHOWN`` of them if no limit is given, by descending sort keys."""
    return limited(rows, SHOWN if limit is None else limit, ids).orderBy(*[F.col(c).desc() for c in (sort or ids)])


def non_empty(totals: DataFrame, rows: str = "_rows") -> DataFrame:
    """A global aggregate without its row if nothing came in."""
    return totals.where(F.col(rows) > 0).drop(rows)


def stretches(log: DataFrame) -> DataFrame:
    """The rows with the number of their stretch of tokens."""
    return log.withColumn("_stretch", F.floor(F.col("token") / BUCKET_TOKENS))


def running(log: DataFrame, value: Column, group: Sequence[str] = ()) -> DataFrame:
    """``_n`` and ``_sum``: non-null values, and their sum, up to each row by token, in each group.

    Stretches of tokens are summed first and their sums accumulated (one row a stretch); rows are sorted only inside
    their stretch, so neither the whole log nor one hot group is sorted by one task.
    """
    keys = [*group, "_stretch"]
    rows = stretches(log.withColumn("_value", value))
    before = Window.partitionBy(*group).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys).agg(F.count("_value").alias("_c"), F.sum("_value").alias("_s"))
    offsets = sums.select(*keys, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_c0"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"))
    inside = Window.partitionBy(*keys).orderBy("token").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(offsets, keys)
    counted = placed.withColumns({"_n": F.col("_c0") + F.count("_value").over(inside), "_sum": F.col("_s0") + F.coalesce(F.sum("_value").over(inside), F.lit(0))})
    return counted.drop("_value", "_stretch", "_c0", "_s0")


def running_where(log: DataFrame, condition: Callable[[Column], Column]) -> DataFrame:
    """The rows at which a condition on the running count holds: an aggregate inside a filter."""
    return running(log, F.lit(1)).where(condition(F.col("_n"))).drop("_n", "_sum")


def delivered(log: DataFrame, skipped: Column, after: int = 1000) -> DataFrame:
    """The log without skipped events, but for every ``after``-th in a row of them, so that a reader sees progress.

    The count of skipped events starts anew with each event that is delivered. Rows between two events that are not skipped
    are told apart by running counts, so a long stretch of skipped events is not gathered in one task.
    """
    flagged = log.withColumn("_skip", F.coalesce(skipped, F.lit(False)))
    placed = running(flagged, F.when(~F.col("_skip"), F.lit(1))).withColumnRenamed("_n", "_island").drop("_sum")
    ranked = running(placed, F.lit(1)).withColumnRenamed("_n", "_rank").drop("_sum")
    starts = ranked.where(~F.col("_skip")).groupBy("_island").agg(F.min("_rank").alias("_start"))
    placed = ranked.join(starts, "_island", "left").withColumn("_at_skip", F.col("_rank") - F.coalesce("_start", F.lit(0)))
    return placed.where(~F.col("_skip") | (F.col("_at_skip") % after == 0)).drop("_skip", "_island", "_rank", "_start", "_at_skip")


def latest_by_id(updates: DataFrame, ids: Sequence[str], order: str = "token") -> DataFrame:
    """The last row of each id: what a client holds after a stream of updates. Combined before the shuffle."""
    others = [c for c in updates.columns if c not in ids]
    last = updates.groupBy(*ids).agg(F.max_by(F.struct(*others), F.col(order)).alias("_last"))
    return last.select(*ids, "_last.*").select(*updates.columns)


def changes(before: DataFrame, after: DataFrame, ids: Sequence[str]) -> DataFrame:
    """What to send a client that holds ``before``: new and changed rows, and with ``_deleted`` those that are gone; nulls are values."""
    values = [c for c in after.columns if c not in ids]
    old = before.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(ids)], F.struct(*values).alias("_old"), F.lit(True).alias("_was"))
    new = after.select(*ids, F.struct(*values).alias("_new"), F.lit(True).alias("_is"))
    same_id = F.lit(True)
    for i, c in enumerate(ids):
        same_id = same_id & new[c].eqNullSafe(old[f"_k{i}"])
    both = new.join(old, same_id, "full").where(F.col("_is").isNull() | F.col("_was").isNull() | ~F.col("_new").eqNullSafe(F.col("_old")))
    gone = F.col("_is").isNull()
    return both.select(*[F.when(gone, F.col(f"_k{i}")).otherwise(F.col(c)).alias(c) for i, c in enumerate(ids)], *[F.when(~gone, F.col(f"_new.{v}")).alias(v) for v in values], gone.alias("_deleted"))
