"""Reads and checks of an event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.registry import Registry
from ..sources.logs import SEGMENT_TOKENS, write_log
from .stages import stretches


def aggregate_events(log: DataFrame, identifier: str, first: int = 0, before: int | None = None) -> DataFrame:
    """Events of one aggregate with sequence numbers from ``first`` up to but not including ``before``."""
    number = F.col("aggregateSequenceNumber")
    own = log.where((F.col("aggregateIdentifier") == identifier) & (number >= first))
    return own if before is None else own.where(number < before)


def latest_snapshots(snapshots: DataFrame, before: int | None = None) -> DataFrame:
    """For each aggregate the number of its latest snapshot (below ``before``), as ``snapshotNumber``."""
    rows = snapshots if before is None else snapshots.where(F.col("aggregateSequenceNumber") < before)
    return rows.groupBy("aggregateIdentifier").agg(F.max("aggregateSequenceNumber").alias("snapshotNumber"))


def replay(log: DataFrame, snapshots: DataFrame) -> DataFrame:
    """What rebuilds each aggregate: its latest snapshot, if any, and the events after it; ``isSnapshot`` tells them apart."""
    latest = latest_snapshots(snapshots)
    columns = ["aggregateIdentifier", "aggregateSequenceNumber"]
    after = log.join(latest, "aggregateIdentifier", "left").where(F.col("snapshotNumber").isNull() | (F.col("aggregateSequenceNumber") > F.col("snapshotNumber")))
    heads = latest.select("aggregateIdentifier", F.col("snapshotNumber").alias("aggregateSequenceNumber"), F.lit(True).alias("isSnapshot"))
    return heads.unionByName(after.select(*columns, F.lit(False).alias("isSnapshot")))


def highest_numbers(log: DataFrame) -> DataFrame:
    """The highest sequence number of each aggregate."""
    return log.groupBy("aggregateIdentifier").agg(F.max("aggregateSequenceNumber").alias("highest"))


def bounds(log: DataFrame) -> DataFrame:
    """First and last token; -1 if the log is empty."""
    return log.agg(F.coalesce(F.min("token"), F.lit(-1)).cast("long").alias("firstToken"), F.coalesce(F.max("token"), F.lit(-1)).cast("long").alias("lastToken"))


def token_at(log: DataFrame, millis: int) -> DataFrame:
    """Token of the first event at or after an instant; one more than the last token if there is none."""
    found = F.min(F.when(F.col("timestamp") >= millis, F.col("token")))
    return log.agg(F.coalesce(found, F.max("token") + 1, F.lit(-1)).cast("long").alias("token"))


def after_gaps(log: DataFrame) -> DataFrame:
    """Tokens without a predecessor: the first, and one after each gap.

    Tokens are compared inside stretches, and each stretch's first with the last of the stretch before (one row a stretch).
    """
    rows = stretches(log.select("token"))
    inside = rows.withColumn("_before", F.lag("token").over(Window.partitionBy("_stretch").orderBy("token")))
    ends = rows.groupBy("_stretch").agg(F.max("token").alias("_last")).withColumn("_stretch", F.col("_stretch") + 1)
    first = inside.where(F.col("_before").isNull()).join(ends, "_stretch", "left").select("token", F.col("_last").alias("_before"))
    later = inside.where(F.col("_before").isNotNull()).select("token", "_before")
    # a predecessor can only be the last token of the stretch just before
    return later.unionAll(first).where(F.col("_before").isNull() | (F.col("_before") + 1 < F.col("token"))).select("token")


def wrong_numbers(batch: DataFrame, highest: DataFrame | None = None) -> DataFrame:
    """Events that can't be appended: their number is not one more than the one before (in the batch, or ``highest``)."""
    number = F.col("aggregateSequenceNumber")
    rows = batch.withColumn("_previous", F.lag(number).over(Window.partitionBy("aggregateIdentifier").orderBy(number)))
    known = F.lit(-1)
    if highest is not None:
        rows, known = rows.join(highest, "aggregateIdentifier", "left"), F.coalesce("highest", F.lit(-1))
    return rows.withColumn("expected", F.coalesce("_previous", known) + 1).where(number != F.col("expected")).select("aggregateIdentifier", "aggregateSequenceNumber", F.col("expected").cast("long").alias("expected"))


def valid_snapshots(snapshots: DataFrame, log: DataFrame) -> DataFrame:
    """Snapshots that are not ahead of their aggregate's events."""
    return snapshots.join(highest_numbers(log), "aggregateIdentifier").where(F.col("aggregateSequenceNumber") <= F.col("highest")).drop("highest")


def scan(log: DataFrame, first: int | None = None, last: int | None = None, since: str | None = None) -> DataFrame:
    """Events with tokens in a closed range, and not before a time (text in UTC); all bounds reach the scan.

    A log that is stored by segment (``sources.logs.write_log``) is read in the segments of the range only.
    """
    rows = log
    if first is not None:
        rows = rows.where(F.col("token") >= first)
        rows = rows.where(F.col("segment") >= first // SEGMENT_TOKENS) if "segment" in log.columns else rows
    if last is not None:
        rows = rows.where(F.col("token") <= last)
        rows = rows.where(F.col("segment") <= last // SEGMENT_TOKENS) if "segment" in log.columns else rows
    return rows if since is None else rows.where(F.col("_at") >= F.lit(since).cast("timestamp_ntz"))


def default_query(log: DataFrame, limit: int = 200) -> DataFrame:
    """What an empty query reads: the last ``limit`` tokens' range, whose start is never negative."""
    head = log.agg(F.max("token").alias("t")).first()["t"]
    return log.where(F.col("token") >= max((-1 if head is None else head) - limit, 0))


def stream_from(log: DataFrame, token: int, most: int | None = None) -> DataFrame:
    """Events from a token on, in order, at most so many."""
    rows = log.where(F.col("token") >= token)
    return rows if most is None else rows.orderBy("token").limit(most)


def newest_of(log: DataFrame, identifier: str, first: int = 0, highest: int = -1, most: int | None = None) -> DataFrame:
    """Events or snapshots of one aggregate, newest first, from number ``first`` to ``highest`` (-1: no bound), at most so many."""
    own = aggregate_events(log, identifier, first, None if highest < 0 else highest + 1)
    return own if most is None else own.orderBy(F.col("aggregateSequenceNumber").desc()).limit(most)


def latest_rows(log: DataFrame, first: int = 0, before: int | None = None) -> DataFrame:
    """The whole last event or snapshot of each aggregate in a range of numbers, the end exclusive."""
    rows = log.where(F.col("aggregateSequenceNumber") >= first)
    rows = rows if before is None else rows.where(F.col("aggregateSequenceNumber") < before)
    return rows.groupBy("aggregateIdentifier").agg(F.max_by(F.struct(*[c for c in log.columns if c != "aggregateIdentifier"]), "aggregateSequenceNumber").alias("_last")).select("aggregateIdentifier", "_last.*")


def highest_of(log: DataFrame, wanted: DataFrame) -> DataFrame:
    """The highest sequence number of each wanted ``aggregateIdentifier``; -1 if it has no events."""
    known = log.join(wanted.select("aggregateIdentifier").distinct(), "aggregateIdentifier", "left_semi")
    return wanted.join(highest_numbers(known), "aggregateIdentifier", "left").withColumn("highest", F.coalesce("highest", F.lit(-1)).cast("long"))


def transactions(log: DataFrame, transaction: str, first: int, before: int) -> DataFrame:
    """Transactions that start in ``[first, before)``: first token, number of events and their identifiers in order.

    A range that starts inside a transaction is an error.
    """
    grouped = log.groupBy(transaction).agg(F.min("token").alias("firstToken"), F.max("token").alias("_last"), F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("token", "eventIdentifier"))).alias("_events"))
    inside = (F.col("firstToken") < first) & (F.col("_last") >= first)
    checked = F.when(inside, F.raise_error(F.lit(f"token {first} is inside a transaction"))).otherwise(F.col("firstToken"))
    return grouped.where((F.col("_last") >= first) & (F.col("firstToken") < before)).select(checked.cast("long").alias("firstToken"), "n", F.col("_events.eventIdentifier").alias("events"))


def replica_check(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """What a replica does with each event of a batch: ``append`` (it continues the log), ``known`` (stored and equal),
    ``differs`` (stored, but another event) or ``gap``."""
    head = stored.agg((F.coalesce(F.max("token"), F.lit(-1)) + 1).alias("_next"))  # one row
    compared = [c for c in batch.columns if c != "token"]
    own = batch.select("token", F.struct(*compared).alias("_new"))
    known = stored.join(own.select("token"), "token", "left_semi").select("token", F.struct(*compared).alias("_old"))
    gaps = after_gaps(batch).withColumn("_starts", F.lit(True))
    placed = own.join(known, "token", "left").join(F.broadcast(head)).join(gaps, "token", "left")
    # a run of new tokens continues the log if it starts at its end, or before it
    first_bad = placed.where(F.col("_starts") & (F.col("token") > F.col("_next"))).agg(F.min("token").alias("_bad"))
    state = F.when(F.col("token") < F.col("_next"), F.when(F.col("_old").eqNullSafe(F.col("_new")), F.lit("known")).otherwise(F.lit("differs"))).when(F.col("token") >= F.col("_bad"), F.lit("gap")).otherwise(F.lit("append"))
    return placed.join(F.broadcast(first_bad)).select("token", state.alias("state"))


def append(batch: DataFrame, stored: DataFrame | None, path: str, registry: Registry | None = None) -> int:
    """Append a batch to a stored log, whole or not at all; hooks of writing go first. Gives the number of events.

    Every aggregate's numbers must go on where the stored log (or the batch) left off.
    """
    rows = batch if registry is None else registry.passed("write", batch)
    highest = None if stored is None else highest_of(stored, rows.select("aggregateIdentifier").distinct())
    wrong = wrong_numbers(rows, highest).limit(1).collect()
    if wrong:
        raise ValueError(f"aggregate {wrong[0]['aggregateIdentifier']}: number {wrong[0]['aggregateSequenceNumber']} where {wrong[0]['expected']} is next")
    n = rows.count()
    write_log(rows, path)
    return n
