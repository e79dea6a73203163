"""Event logs as DataFrames with one fixed set of columns.

``token`` orders the log; ``aggregateSequenceNumber`` counts an aggregate's events from 0; ``timestamp`` is in epoch
milliseconds; ``metaData`` is a map. ``_at`` is the stored time, which scans can push down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DAY_MS = 86_400_000
#: Tokens in a segment, which is a folder of a stored log.
SEGMENT_TOKENS = 1_000_000


def epoch_millis(at: Column) -> Column:
    """Milliseconds since 1970 of a zoneless time, cut off below; the session's zone plays no part."""
    days = F.datediff(at, F.lit("1970-01-01").cast("date")).cast("long")
    clock = F.hour(at).cast("long") * 3_600_000 + F.minute(at) * 60_000 + F.floor(F.extract(F.lit("SECOND"), at) * 1000)
    return (days * DAY_MS + clock).cast("long")


def events(spark: SparkSession, sf_dir: str, aggregate: str | None = None) -> DataFrame:
    """The ``events`` table: a user is an aggregate. The sequence number needs a shuffle, but only if it is used.

    With an ``aggregate``, only its events are read: the comparison with the stored id reaches the scan. The metadata's key
    is a column of its own beside the map, so that scans can compare it, too.
    """
    raw = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    raw = raw if aggregate is None else raw.where(F.col("user_id") == _whole(aggregate))
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return raw.select(
        F.col("event_id").alias("token"),
        F.col("event_id").cast("string").alias("eventIdentifier"),
        F.col("user_id").cast("string").alias("aggregateIdentifier"),
        number.cast("long").alias("aggregateSequenceNumber"),
        F.lit("User").alias("aggregateType"),
        F.col("event_type").alias("payloadType"),
        F.lit("").alias("payloadRevision"),
        F.col("props").alias("payloadData"),
        epoch_millis(F.col("ts")).alias("timestamp"),
        F.create_map(F.lit("value"), F.col("value")).alias("metaData"),
        F.col("value").alias("metaData.value"),
        F.col("ts").alias("_at"),
    )


def _whole(identifier: str) -> int | None:
    """The stored form of an id; null, which equals none, for text that is no id."""
    return int(identifier) if identifier.isascii() and identifier.isdigit() and str(int(identifier)) == identifier else None


def order_lines(spark: SparkSession, sf_dir: str, aggregate: str | None = None) -> DataFrame:
    """The ``lineitem`` table as a log without tokens: an order is an aggregate, its line number the sequence."""
    raw = spark.read.parquet(f"{sf_dir.rstrip('/')}/lineitem.parquet")
    raw = raw if aggregate is None else raw.where(F.col("l_orderkey") == _whole(aggregate))
    return raw.select(F.col("l_orderkey").cast("string").alias("aggregateIdentifier"), (F.col("l_linenumber").cast("long") - 1).alias("aggregateSequenceNumber"), F.col("l_quantity").alias("quantity"))


def order_snapshots(spark: SparkSession, sf_dir: str, aggregate: str | None = None) -> DataFrame:
    """A snapshot log: every third line of an order stands for its state up to there."""
    lines = order_lines(spark, sf_dir, aggregate)
    return lines.where(F.col("aggregateSequenceNumber") % 3 == 2).withColumn("aggregateType", F.lit("Snapshot"))


def write_log(log: DataFrame, path: str, mode: str = "append") -> None:
    """Store a log by segment, each sorted by token: ranges of tokens are then folders, and row groups have narrow ranges."""
    rows = log.withColumn("segment", F.floor(F.col("token") / SEGMENT_TOKENS)).repartition("segment")
    rows.sortWithinPartitions("segment", "token").write.mode(mode).partitionBy("segment").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A stored log (of events or of snapshots), with its ``segment``; ``operators.log.scan`` bounds it."""
    return spark.read.parquet(path)
