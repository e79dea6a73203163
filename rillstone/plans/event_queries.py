"""The event queries over the driver's tables: stages and functions put together. Each takes (spark, sf_dir)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions import scalars as S
from ..functions import structured as D
from ..operators import log as L
from ..operators import metrics as M
from ..operators import stages as T
from ..sources.logs import events, order_lines

#: "Now" of the relative time windows: the tables are of January 2024.
NOW = datetime(2024, 1, 31)
NOON_MS = 1_705_320_000_000  # 2024-01-15 12:00


def group_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("payloadType").agg(F.count(F.lit(1)).alias("n"))


def filter_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("payloadType = 'error'").select("token", "payloadType")


def filter_and_or_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = (F.col("payloadType") == "click") & ((F.col("token") > 100) | S.negated(F.col("aggregateIdentifier") == "8"))
    return events(spark, sf_dir).where(wanted).select("token", "aggregateIdentifier")


def filter_not_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where(S.differs(F.col("payloadType"), F.lit("view")) & (F.col("token") <= 5000)).select("token", "payloadType")


def filter_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where(F.col("payloadType").isin("click", "view")).select("token", "payloadType")


def filter_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where(F.contains("payloadData", F.lit("69"))).select("token", "payloadData")


def filter_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where(S.matches(F.col("payloadType"), "c.*k")).select("token", "payloadType")


def last_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.last(events(spark, sf_dir), 2.5, "day", NOW).select("token", "timestamp")


def last_month_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.last(events(spark, sf_dir), 2, "week", NOW).groupBy("payloadType").agg(F.count(F.lit(1)).alias("n"))


def select_arith(spark: SparkSession, sf_dir: str) -> DataFrame:
    number, token = F.col("aggregateSequenceNumber"), F.col("token")
    return events(spark, sf_dir).select("token", S.divide(number, F.lit(2)).alias("h"), S.modulo(token, F.lit(7)).alias("m"), (token * 3 - number + 1).alias("t"), F.concat(F.lit("x"), "payloadType").alias("s"))


def select_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("payloadType")
    return events(spark, sf_dir).select("token", F.upper(kind).alias("u"), F.lower(kind).alias("w"), S.substring(kind, 1, 4).alias("p"), F.left(kind, F.lit(2)).alias("l"), F.right(kind, F.lit(3)).alias("r"), S.length(F.col("payloadData")).alias("n"))


def concat_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("token", S.joined(F.array("payloadType", "aggregateIdentifier"), "-").alias("c"))


def format_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("token", S.format_date(F.col("timestamp"), "yyyy/MM/dd HH:mm").alias("t"), S.format_date(F.col("timestamp"), "HH:mm", "Asia/Tokyo").alias("tokyo"))


def date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("timestamp")
    return events(spark, sf_dir).select("token", S.year(at).alias("y"), S.month(at).alias("mm"), S.day(at).alias("d"), S.hour(at).alias("hh"), S.week(at).alias("w"))


def json_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("payloadType").agg(F.round(F.avg(D.json_number(F.col("payloadData"), "$.k")), 8).alias("k"))


def metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events(spark, sf_dir)
    return log.where(D.metadata(log, "value") > 50).select("token", D.metadata(log, "value").alias("value"))


def group_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("payloadType", "aggregateIdentifier").agg(F.count(F.lit(1)).alias("n"), F.max("token").alias("mx"), F.min("token").alias("mn"))


def group_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_count(spark, sf_dir).where("n > 2000")


def group_last_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("payloadType").agg(F.max_by("payloadData", "token").alias("lastData"))


def global_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.non_empty(events(spark, sf_dir).agg(F.count(F.lit(1)).alias("count"), F.count(F.lit(1)).alias("_rows")))


def global_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.non_empty(events(spark, sf_dir).agg(A.average(F.col("aggregateSequenceNumber")).alias("avg"), F.count(F.lit(1)).alias("_rows")))


def running_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.running(events(spark, sf_dir), F.col("aggregateSequenceNumber")).select("token", A.rounded_mean(F.col("_sum"), F.col("_n")).alias("a"))


def nested_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    updates = T.running(events(spark, sf_dir).select("token", "aggregateIdentifier"), F.lit(1), ["aggregateIdentifier"])
    return updates.groupBy(F.col("_n").alias("n")).agg(F.count(F.lit(1)).alias("m"))


def limit_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.limited(events(spark, sf_dir), 10).select("token", "payloadType")


def sort_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.answer(events(spark, sf_dir), sort=["payloadType"], limit=10).select("token", "payloadType")


def agg_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.aggregate_events(events(spark, sf_dir, "42"), "42", 3, 20).select("token", "aggregateSequenceNumber")


def agg_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = order_lines(spark, sf_dir).select("aggregateIdentifier", "aggregateSequenceNumber")
    return L.replay(lines, lines.where("aggregateSequenceNumber = 2"))


def highest_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.highest_numbers(events(spark, sf_dir))


def token_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.bounds(events(spark, sf_dir))


def token_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.token_at(events(spark, sf_dir), NOON_MS)


def token_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.after_gaps(events(spark, sf_dir).where("payloadType <> 'error'"))


def seq_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.wrong_numbers(order_lines(spark, sf_dir).where("quantity > 10"))


def snapshot_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = order_lines(spark, sf_dir).select("aggregateIdentifier", "aggregateSequenceNumber")
    heads = lines.where("aggregateSequenceNumber = 0").select("aggregateIdentifier", F.lit(3).cast("long").alias("aggregateSequenceNumber"))
    return L.valid_snapshots(heads, lines)


def rate_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.sliding_counts(events(spark, sf_dir), 3_600_000, 6 * 3_600_000)


def latency_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.latencies(events(spark, sf_dir).withColumnRenamed("metaData.value", "value"), "value")


def composite_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events(spark, sf_dir)
    value = D.metadata(log, "value")
    parts = log.groupBy("aggregateIdentifier", "payloadType").agg(F.count(value).alias("count"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"))
    return M.composite(parts, "payloadType")


def silent_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.silent(events(spark, sf_dir), 1_706_659_200_000, 43_200_000)


ALL = (
    group_count, filter_eq, filter_and_or_not, filter_not_equal, filter_in_list, filter_contains, filter_match, last_window, last_month_groups, select_arith,
    select_strings, concat_list, format_date, date_parts, json_number, metadata_filter, group_multi, group_having, group_last_value, global_count, global_avg,
    running_avg, nested_group, limit_ids, sort_limit, agg_read, agg_snapshot, highest_number, token_bounds, token_at, token_gaps, seq_check, snapshot_check,
    rate_buckets, latency_pct, composite_metric, silent_aggregates,
)
