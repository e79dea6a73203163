"""More event queries: types, lists, documents, hidden ids and limits, log reads, updates, metrics, routing and processors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions import scalars as S
from ..functions import structured as D
from ..functions.registry import Registry
from ..operators import log as L
from ..operators import metrics as M
from ..operators import processors as P
from ..operators import routing as R
from ..operators import stages as T
from ..sources.logs import events, order_snapshots
from ..streaming import live
from .event_queries import NOON_MS, NOW


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    return spark.readStream.schema(_read(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


# Filters and projections


def filter_eq_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text equals a number of the same text; a number never equals text."""
    log = events(spark, sf_dir)
    wanted = S.same(F.col("aggregateIdentifier"), F.lit(42), "text") | S.same(F.col("token"), F.lit("7"), "number", "text")
    return log.where(wanted).select("token", "aggregateIdentifier")


def filter_in_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a list may be columns, and a list may be one item."""
    of_token = (F.col("token") % 150).cast("string")
    log = events(spark, sf_dir).where(S.within(F.col("aggregateIdentifier"), [of_token, F.lit("7")]))
    return log.where(S.negated(S.within(F.col("payloadType"), F.lit("view")))).select("token", "aggregateIdentifier", "payloadType")


def filter_list_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.array(F.col("payloadType"), F.col("aggregateIdentifier"), (F.col("token") % 10).cast("string"))
    return events(spark, sf_dir).where(S.list_contains(items, F.lit(7)) | S.list_contains(items, F.lit("click"))).select("token")


def match_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line end is part of the text."""
    ended = F.when(F.col("token") % 2 == 0, F.concat("payloadType", F.lit("\n"))).otherwise(F.col("payloadType"))
    return events(spark, sf_dir).where(S.matches(ended, "c.*k")).select("token")


def last_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several time windows the one that starts latest decides."""
    return T.last_of(events(spark, sf_dir), [(1, "week"), (2.5, "day"), (1, "month")], NOW).select("token")


def divide_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quotient keeps the dividend's decimal places."""
    lines = _read(spark, sf_dir, "lineitem")
    price, number = F.col("l_extendedprice").cast("decimal(12,2)"), F.col("l_quantity").cast("decimal(5,1)")
    return lines.select("l_orderkey", "l_linenumber", S.divide(price, number, 2, 1).cast("double").alias("each"), S.divide(-price, F.lit(7), 2).cast("double").alias("week"))


def text_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters beyond the basic plane count two."""
    return events(spark, sf_dir).select("token", S.length(F.concat("payloadType", F.lit("\U0001f600"), "payloadData")).alias("n"))


def date_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("timestamp")
    return events(spark, sf_dir).select("token", S.format_date(at, "yyyy-MM-dd F/W/ww u 'at' HH").alias("t"), S.format_date(at, "MM.yyyy 'week' w", "Asia/Tokyo").alias("tokyo"))


def json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists, texts, objects and numbers of a JSON document; booleans and quoted digits are no numbers."""
    k = F.get_json_object("payloadData", "$.k")
    doc = F.concat(F.lit('{"b":[{"t":"'), "payloadType", F.lit('"},{"t":"x"}],"o":{"k":'), k, F.lit('},"n":'), k, F.lit(',"q":"12","f":true}'))
    return events(spark, sf_dir).select(
        "token", F.array_join(D.json_list(doc, "$.b[*].t"), ",").alias("titles"), D.json_text(doc, "$.b[0].t").alias("first"), D.json_text(doc, "$.o").alias("object"),
        D.json_number(doc, "$.n").alias("number"), D.json_number(doc, "$.q").alias("quoted"), D.json_text(doc, "$.f").alias("flag"), D.json_number(doc, "$.none").alias("none"),
    )


def xml_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.concat(F.lit("<e><k>"), F.get_json_object("payloadData", "$.k"), F.lit("</k><k>5</k><t>"), "payloadType", F.lit("</t></e>"))
    found = D.xml_fields(doc, t=("text", "//t"), total=("number", "sum(//k)"), n=("number", "count(//k)"), all=("texts", "//k/text()"), node=("node", "/e/t"))
    return events(spark, sf_dir).select("token", found.alias("x")).select("token", "x.t", "x.total", "x.n", F.array_join("x.all", ",").alias("all"), "x.node")


def map_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("token", D.map_text(F.create_map(F.lit("type"), F.col("payloadType"), F.lit("user"), F.col("aggregateIdentifier"))).alias("m"))


# Limits, hidden ids, aggregates


def select_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A projection keeps the id, so a later limit still takes the newest events."""
    return T.limited(T.project(T.with_id(events(spark, sf_dir)), p=F.col("payloadType"), k=F.col("payloadData")), 25, ["_id"]).select("p", "k")


def group_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After a grouping the ids are its keys, each descending."""
    return T.limited(events(spark, sf_dir).groupBy("payloadType", "aggregateIdentifier").agg(F.count(F.lit(1)).alias("n")), 7, ["payloadType", "aggregateIdentifier"])


def group_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a limit 200 groups are shown, those with the largest keys."""
    return T.answer(events(spark, sf_dir).groupBy((F.col("token") % 500).alias("k")).agg(F.count(F.lit(1)).alias("n")), ["k"])


def limit_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit without a number keeps 1000."""
    return T.limited(events(spark, sf_dir)).select("token")


def limit_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregate after a limit sees the rows that the limit keeps."""
    return T.non_empty(T.limited(events(spark, sf_dir), 10).agg(F.count(F.lit(1)).alias("count"), F.count(F.lit(1)).alias("_rows")))


def count_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions count where they are true, lists by their items that are not null."""
    log = events(spark, sf_dir)
    items = F.array(F.col("payloadType"), F.when(F.col("token") % 3 == 0, F.lit("x")))
    return log.groupBy("payloadType").agg(A.count_true(D.metadata(log, "value") > 50).alias("high"), A.count_items(items).alias("items"), F.count(F.when(F.col("token") % 4 == 0, F.lit(1))).alias("some"))


def mean_half_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means to eight places, halves towards zero; what is no number is left out."""
    number = F.when(F.col("payloadType") == "view", F.lit("none")).otherwise((F.col("token") - 3000).cast("string"))
    return events(spark, sf_dir).groupBy("payloadType").agg(A.average(number).alias("mean"), A.average(F.get_json_object("payloadData", "$.k")).alias("k"))


def running_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A count inside a filter is the running one: the first rows are dropped."""
    return T.running_where(events(spark, sf_dir).select("token", "payloadType"), lambda n: n > 2)


def group_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregates inside expressions."""
    return events(spark, sf_dir).groupBy("payloadType").agg((F.count(F.lit(1)) + 1).alias("n"), (F.max("token") - F.min("token")).alias("span"))


def null_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null keys are a group; numbers that are equal are one key."""
    key = F.when(F.col("payloadType") != "error", F.col("payloadType"))
    return events(spark, sf_dir).groupBy(key.alias("k"), (F.col("token") % 2).cast("double").alias("odd")).agg(F.count(F.lit(1)).alias("n"))


# Log reads


def log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.scan(events(spark, sf_dir), 2000, 7000, "2024-01-15 12:00:00").select("token", "payloadType")


def empty_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.default_query(events(spark, sf_dir)).select("token")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.stream_from(events(spark, sf_dir), 500, 25).select("token", "payloadType")


def agg_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.newest_of(events(spark, sf_dir, "42"), "42", most=4).select("token", "aggregateSequenceNumber")


def snapshot_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_snapshots(spark, sf_dir).where("quantity > 25").select("aggregateIdentifier", "aggregateSequenceNumber")


def snapshot_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.newest_of(order_snapshots(spark, sf_dir, "100"), "100", highest=-1, most=5).select("aggregateSequenceNumber", "quantity")


def latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.latest_rows(events(spark, sf_dir).select("aggregateIdentifier", "aggregateSequenceNumber", "token", "payloadType"), 2, 20)


def highest_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.highest_of(events(spark, sf_dir), spark.range(100, 200).select(F.col("id").cast("string").alias("aggregateIdentifier")))


def transaction_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events(spark, sf_dir).withColumn("tx", F.floor(F.col("token") / 10))
    return L.transactions(log, "tx", 100, 305).select("firstToken", "n", F.array_join("events", ",").alias("events"))


def replica_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events(spark, sf_dir).select("token", "payloadType")
    sent = log.where("token between 480 and 520 and token <> 511").withColumn("payloadType", F.when(F.col("token") % 7 == 0, F.lit("other")).otherwise(F.col("payloadType")))
    return L.replica_check(sent, log.where("token < 500"))


# Updates


def latest_rows_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.latest_by_id(events(spark, sf_dir).select("payloadType", "aggregateIdentifier", "token", "payloadData"), ["payloadType", "aggregateIdentifier"])


def retracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that a filter lets through: those that came or changed, and those that are gone."""
    log = events(spark, sf_dir)
    counted = lambda rows: rows.groupBy("aggregateIdentifier").agg(F.count(F.lit(1)).alias("n")).where("n between 2 and 4")
    return T.changes(counted(log.where("token < 400")), counted(log.where("token < 600")), ["aggregateIdentifier"]).fillna(-1, ["n"])


def blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types that a reader skips still show every fifth of them in a row."""
    return T.delivered(events(spark, sf_dir).select("token", "payloadType"), F.col("payloadType") != "click", 5)


def live_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grouping of a live query, over the log as a stream."""
    stream = _stream(spark, sf_dir).where("event_id >= 100")
    return live.answer_now(live.live_groups(stream.withColumnRenamed("event_type", "payloadType"), ["payloadType"], [F.count(F.lit(1)).alias("n"), F.max("event_id").alias("lastToken")]))


def live_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts in windows of event time, with a bound on lateness."""
    stream = _stream(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp"))
    found = live.answer_now(live.on_time(stream, "at", "1 hour", "1 day", ["event_type"]))
    return found.select(F.datediff(F.col("window.start").cast("timestamp_ntz"), F.lit("2024-01-01").cast("date")).cast("long").alias("day"), F.col("event_type").alias("payloadType"), "n")


def initial_and_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A subscription's initial result, and the updates that are its own."""
    log = events(spark, sf_dir).select("token", "payloadType")
    updates = log.withColumn("subscription", F.when(F.col("token") % 3 == 0, F.lit("a")).otherwise(F.lit("b")))
    return live.initial_and_updates(log, updates, "a", 400)


def extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scalar, an aggregate, a stage and reading hooks that were registered by name."""
    registry = Registry()
    registry.scalar("initial")(lambda c: F.upper(F.left(c, F.lit(1))))
    registry.aggregate("spread")(lambda c: F.max(c) - F.min(c))
    registry.stage("twice")(lambda rows: rows.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))))
    registry.hook("read", 2)(lambda rows: rows.withColumn("payloadType", F.concat("payloadType", F.lit("!"))))
    registry.hook("read", 1)(lambda rows: rows.where("token % 2 = 0"))
    rows = registry.apply(registry.passed("read", events(spark, sf_dir)), "twice")
    return rows.groupBy(registry.call("initial", F.col("payloadType")).alias("k"), "payloadType").agg(registry.call("spread", F.col("token")).alias("spread"), F.count(F.lit(1)).alias("n"))


# Metrics


def rate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the last hour, six hours and day, by day; the log runs for a shorter time than the last window."""
    return M.rates(events(spark, sf_dir), NOON_MS, NOON_MS - 40_000_000, (3600, 21_600, 86_400), 86_400, ["payloadType"])


def timer_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events(spark, sf_dir)
    return M.timers(log, D.metadata(log, "value"), ["payloadType"])


def request_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events(spark, sf_dir).withColumns({"request": F.col("payloadType"), "source": F.col("token") % 3, "target": F.col("token") % 4, "context": F.lit("default")})
    return M.timers(log, D.metadata(log, "value"), ["request", "source", "target", "context"])


def subscription_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("payloadType") == "signup", F.lit("start")).when(F.col("payloadType") == "error", F.lit("cancel")).when(F.col("payloadType") == "click", F.lit("update"))
    log = events(spark, sf_dir).withColumn("query", F.concat(F.lit("q"), F.col("aggregateIdentifier").cast("int") % 4))
    return M.subscriptions(log, "query", "aggregateIdentifier", kind)


# Routing and processors


def tag_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request"), F.left("o_orderpriority", F.lit(1)).alias("command"), F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("region"), (F.col("o_custkey") % 5).cast("string")).alias("metaData"))
    key, region = F.col("n_nationkey"), F.col("n_regionkey").cast("string")
    status = F.create_map(F.lit("status"), F.element_at(F.array(F.lit("F"), F.lit("O"), F.lit("P")), key % 3 + 1), F.lit("zone"), F.lit("x"))
    handlers = _read(spark, sf_dir, "nation").select((key % 5 + 1).cast("string").alias("command"), F.col("n_name").alias("client"), F.when(key % 2 == 0, F.map_concat(status, F.create_map(F.lit("region"), region))).otherwise(status).alias("tags"))
    return R.best_handlers(requests, handlers)


def handler_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = _read(spark, sf_dir, "supplier")
    handlers = suppliers.select((F.col("s_suppkey") % 7).cast("string").alias("query"), F.col("s_nationkey").cast("string").alias("component"), F.col("s_name").alias("client"))
    picked = R.candidates_of(handlers, suppliers.where("s_acctbal > 0").select(F.col("s_name").alias("client")))
    return picked.select("query", "component", F.array_join("clients", ",").alias("clients"))


def hash_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = _read(spark, sf_dir, "nation").select(F.col("n_name").alias("member"), F.when(F.col("n_nationkey") % 2 == 0, F.lit(20)).alias("loadFactor"))
    return R.route(_read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request"), F.col("o_custkey").alias("key")), members).select("request", "member")


def scatter_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = events(spark, sf_dir).select("token", F.col("payloadType").alias("query"))
    suppliers = _read(spark, sf_dir, "supplier").where("s_suppkey < 40")
    types = F.element_at(F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup", "view")]), (F.col("s_suppkey") % 5 + 1).cast("int"))
    handlers = suppliers.select(types.alias("query"), (F.col("s_nationkey") % 3).cast("string").alias("component"), F.col("s_name").alias("handler"))
    return R.scattered(requests, handlers)


def response_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("request"), F.col("l_linenumber").cast("long").alias("no"))
    return R.merged(lines.agg(F.bool_or(F.col("l_returnflag") != "N").alias("failed")), "request", "no", "failed")


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.call_function("shiftleft", F.lit(1), (F.col("s_suppkey") % 4).cast("int")).cast("long")
    return _read(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 5).cast("long").alias("processor"), F.concat(F.lit("c"), (F.col("s_suppkey") % 6)).alias("client"), ((F.col("s_suppkey") % 8) % part).alias("segment"), part.alias("onePartOf"))


def processor_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.warnings(_claims(spark, sf_dir))


def segment_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segment to split and the one to merge of each processor."""
    claims = _claims(spark, sf_dir)
    return P.largest(claims).withColumn("mergesWith", F.lit(-1).cast("long")).unionByName(P.smallest(claims))


def processor_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = _claims(spark, sf_dir)
    clients = _read(spark, sf_dir, "region").select(F.explode(F.sequence(F.lit(0), F.lit(5))).alias("c"), F.col("r_regionkey").alias("r"))
    instances = clients.select(F.col("r").cast("long").alias("processor"), F.concat(F.lit("c"), "c").alias("client"), ((F.col("c") + F.col("r")) % 3 > 0).alias("running"), (F.col("c") + 2).alias("capacity"))
    return P.roll_up(instances, claims)


ALL = (
    filter_eq_types, filter_in_items, filter_list_contains, match_whole, last_latest, divide_decimals, text_length, date_letters, json_values, xml_values, map_text,
    select_limit, group_limit, group_shown, limit_default, limit_count, count_values, mean_half_down, running_filter, group_expression, null_groups,
    log_scan, empty_query, event_stream, agg_newest, snapshot_scan, snapshot_list, latest_event, highest_known, transaction_list, replica_append,
    latest_rows_by_id, retracted, blacklist, live_counts, live_windows, initial_and_updates, extended, rate_windows, timer_snapshot, request_metrics, subscription_metrics,
    tag_routing, handler_candidates, hash_routing, scatter_gather, response_merge, processor_warnings, segment_choice, processor_roll_up,
)
