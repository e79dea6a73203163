"""Live queries: the log is read as it grows, and results are kept up to date by key."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.stages import changes, latest_by_id


def follow(spark: SparkSession, folder: str, schema: StructType, first_token: int = 0, files: int | None = None, since_ms: int | None = None) -> DataFrame:
    """Events from a token on, as files arrive in a folder; at most so many files a batch.

    A time bound is worked out once, when the query starts, and holds for the events that are there and for later ones.
    """
    reader = spark.readStream.schema(schema)
    rows = (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(folder).where(F.col("token") >= first_token)
    return rows if since_ms is None else rows.where(F.col("timestamp") >= since_ms)


def live_groups(stream: DataFrame, keys: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """Groups of a stream, to be written in update mode: a batch brings each group it changed once."""
    return stream.groupBy(*keys).agg(*aggregates)


def on_time(stream: DataFrame, clock: str, lateness: str, window: str, keys: Sequence[str] = ()) -> DataFrame:
    """Events in each time window; state older than the lateness allows is dropped."""
    return stream.withWatermark(clock, lateness).groupBy(F.window(clock, window), *keys).agg(F.count(F.lit(1)).alias("n"))


def answer_now(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """The answer of a streaming query over all that is there now; meant for few rows, since the driver holds them."""
    spark, name = stream.sparkSession, f"live_{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    shared = spark.conf.get("spark.checkpoint.dir", None)
    query = (writer.option("checkpointLocation", f"{shared.rstrip('/')}/{name}") if shared else writer).start()
    query.awaitTermination()
    return spark.table(name)


def keep_table(stream: DataFrame, path: str, ids: Sequence[str], checkpoint: str, order: str = "token", interval: str | None = None) -> StreamingQuery:
    """Keep a client's table of a stream of updates: a batch brings each id once, with its last row.

    The table is a folder a batch, so a batch that is repeated after a failure writes the same folder again; ``held`` reads
    the newest. Without an interval the query ends when all that is there has been read.
    """

    def write(batch: DataFrame, number: int) -> None:
        new = latest_by_id(batch, ids, order)
        old = held(batch.sparkSession, path, number)
        table = new if old is None else latest_by_id(old.unionByName(new), ids, order)
        table.write.mode("overwrite").parquet(f"{path}/batch={number:020d}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if interval is None else writer.trigger(processingTime=interval).start()


def held(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest whole table that ``keep_table`` has written (before a batch), or none."""
    jvm, at = spark._jvm, None
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for status in files.listStatus(folder) if files.exists(folder) else []:
        name = status.getPath().getName()
        number = int(name[6:]) if name.startswith("batch=") else -1
        if files.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")) and number >= 0 and (before is None or number < before) and (at is None or number > at):
            at = number
    return None if at is None else spark.read.parquet(f"{path}/batch={at:020d}")


def retractions(spark: SparkSession, path: str, ids: Sequence[str], keeps: Column, since: int, until: int) -> DataFrame:
    """What to send a client between two batches of a kept table: rows that the filter lets through, and ``_deleted`` ones."""
    before, after = (spark.read.parquet(f"{path}/batch={n:020d}").where(keeps) for n in (since, until))
    return changes(before, after, ids)


def initial_and_updates(log: DataFrame, updates: DataFrame, subscription: str, until: int) -> DataFrame:
    """A subscription's answer: the log up to a token as its initial result, and its own later updates, in one table."""
    initial = log.where(F.col("token") <= until).withColumn("isUpdate", F.lit(False))
    later = updates.where((F.col("token") > until) & (F.col("subscription") == subscription)).drop("subscription").withColumn("isUpdate", F.lit(True))
    return initial.unionByName(later)
