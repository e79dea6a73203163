"""Event queries against DuckDB, and functions, stages and live queries on small fixtures."""

import math
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from rillstone import queries
from rillstone.functions import aggregates as A
from rillstone.functions import scalars as S
from rillstone.functions import structured as D
from rillstone.functions.registry import Registry
from rillstone.operators import log as L
from rillstone.operators import metrics as M
from rillstone.operators import routing as R
from rillstone.operators import stages as T
from rillstone.sources import logs
from rillstone.streaming import live

SF = "/root/testdata/sf0.001"


def rows(frame):
    def cell(x):
        return None if x is None or (isinstance(x, float) and math.isnan(x)) else round(float(x), 6) if isinstance(x, float) else x

    return sorted(str([cell(x) for x in r]) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("events", "lineitem", "orders", "supplier", "nation", "region"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    ours, theirs = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_division_rounds_halves_away_from_zero(spark):
    for a, b, want in ((7, 2, 4), (1, 3, 0), (-7, 2, -4), (5, -2, -3), (6, 3, 2)):
        assert one(spark, S.divide(F.lit(a), F.lit(b))) == want


def test_dates(spark):
    at = F.lit(1511442724079)
    assert one(spark, S.format_date(at, "dd-MM-yyyy")) == "23-11-2017"
    assert [one(spark, f(at)) for f in (S.day, S.week, S.month, S.year, S.hour)] == ["4", "47", "11", "2017", "13"]
    new_year = F.lit(1735603200000)  # 2024-12-31
    assert one(spark, S.week(new_year)) == "1"


def test_null_rules(spark):
    null = F.lit(None).cast("string")
    assert one(spark, S.differs(null, F.lit("a"))) is True
    assert one(spark, S.negated(F.lit(None).cast("boolean"))) is True
    assert one(spark, S.matches(null, "a")) is False
    assert one(spark, S.matches(F.lit("xax"), "a")) is False
    assert one(spark, S.joined(F.array(F.lit("a"), null), "---")) == "a---<Null>"


def test_start_of_last():
    now = datetime(2024, 3, 31, 12)
    assert T.start_of_last(1, "month", now) == datetime(2024, 2, 29, 12)
    assert T.start_of_last(1, "year", datetime(2024, 2, 29)) == datetime(2023, 2, 28)
    assert T.start_of_last(3, "month", datetime(2024, 3, 15)) == datetime(2023, 12, 15)
    assert T.start_of_last(0.5, "week", now) == datetime(2024, 3, 28, 12)


def test_running_spans_stretches(spark, monkeypatch):
    monkeypatch.setattr(T, "BUCKET_TOKENS", 3)
    log = spark.createDataFrame([(i, "a" if i % 2 else "b", i) for i in range(10)], "token long, k string, v long")
    got = {r["token"]: r["_sum"] for r in T.running(log, F.col("v")).collect()}
    assert got == {i: i * (i + 1) // 2 for i in range(10)}
    got = {r["token"]: r["_n"] for r in T.running(log, F.col("v"), ["k"]).collect()}
    assert got == {i: i // 2 + 1 for i in range(10)}


def test_empty_log(spark):
    empty = spark.createDataFrame([], "token long, timestamp long, aggregateIdentifier string, aggregateSequenceNumber long")
    assert L.bounds(empty).first().asDict() == {"firstToken": -1, "lastToken": -1}
    assert L.token_at(empty, 5).first()["token"] == -1
    assert T.non_empty(empty.agg(F.count(F.lit(1)).alias("n"), F.count(F.lit(1)).alias("_rows"))).count() == 0


def test_append_checks(spark):
    batch = spark.createDataFrame([("NEW", 0), ("OTHER", 11), ("OTHER", 12), ("GAP", 12)], "aggregateIdentifier string, aggregateSequenceNumber long")
    highest = spark.createDataFrame([("OTHER", 10), ("GAP", 10)], "aggregateIdentifier string, highest long")
    assert [tuple(r) for r in L.wrong_numbers(batch, highest).collect()] == [("GAP", 12, 11)]


def test_live_groups(spark, tmp_path):
    folder = str(tmp_path / "log")
    log = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(9)], "token long, payloadType string")
    log.write.parquet(folder)
    stream = live.live_groups(live.follow(spark, folder, log.schema, 1), ["payloadType"], [F.count(F.lit(1)).alias("n")])
    query = stream.writeStream.outputMode("update").format("memory").queryName("live_counts").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {(r["payloadType"], r["n"]) for r in spark.table("live_counts").collect()} == {("a", 6), ("b", 2)}


def test_division_keeps_the_dividends_places(spark):
    for a, places, b, other, want in (("7.0", 1, "2", 0, 3.5), ("1.0", 1, "3", 0, 0.3), ("-1.00", 2, "8", 0, -0.13), ("10", 0, "0.4", 1, 25), ("5", 0, "2.0", 1, 3)):
        left, right = F.lit(a).cast(f"decimal(12,{places})"), F.lit(b).cast(f"decimal(12,{other})")
        assert float(one(spark, S.divide(left, right, places, other))) == want
    for a, b, want in ((7.0, 2.0, 3.5), (1.0, 3.0, 0.3), (-2.25, 2.0, -1.13), (1.5e10, 7.0, 2e9)):
        assert one(spark, S.divide_double(F.lit(a), F.lit(b))) == pytest.approx(want, rel=1e-14)


def test_means_round_halves_towards_zero(spark):
    rows = spark.createDataFrame([("a", "1"), ("a", "2"), ("a", "6"), ("b", "x"), ("b", None), ("c", "1"), ("c", None), ("c", "2")], "k string, v string")
    assert {r.k: r.m for r in rows.groupBy("k").agg(A.average(F.col("v")).alias("m")).collect()} == {"a": 3.0, "b": None, "c": 1.5}
    tiny = spark.createDataFrame([(1, 3), (-1, -3), (5, 1)], "s long, n long").select((F.col("s").cast("decimal(20,9)") / F.lit(10**9).cast("decimal(10,0)")).alias("v"))
    half = spark.range(1).select(A.rounded_mean(F.lit("0.000000005").cast("decimal(20,9)"), F.lit(1).cast("long"), 9).alias("x"), A.rounded_mean(F.lit("-0.000000015").cast("decimal(20,9)"), F.lit(1).cast("long"), 9).alias("y"), A.rounded_mean(F.lit("0.000000016").cast("decimal(20,9)"), F.lit(1).cast("long"), 9).alias("z")).first()
    assert (half.x, half.y, half.z) == (0.0, -1e-8, 2e-8) and tiny.count() == 3


def test_text_rules(spark):
    assert one(spark, S.matches(F.lit("ab\n"), "ab")) is False
    assert one(spark, S.length(F.lit("a\U0001f600b"))) == 4
    assert one(spark, S.substring(F.lit("abcdef"), 1, 4)) == "bcd" and one(spark, S.substring(F.lit("abc"), 1)) == "bc" and one(spark, S.substring(F.lit("abc"), 5, 9)) == ""
    with pytest.raises(Exception, match="past the end"):
        one(spark, S.substring(F.lit("abc"), 4))
    assert one(spark, S.same(F.lit("100"), F.lit(100), "text")) is True and one(spark, S.same(F.lit(100), F.lit("100"), "number", "text")) is False
    assert one(spark, S.same(F.lit(True), F.lit("true"), "boolean", "text")) is True and one(spark, S.same(F.lit(False), F.lit(1), "boolean", "number")) is True
    assert one(spark, S.within(F.lit("b"), [F.lit("a"), F.lit("b"), F.lit(100)])) is True and one(spark, S.within(F.lit(None).cast("string"), [F.lit("a")])) is False


def test_date_letters(spark):
    at = F.lit(1511442724079)
    assert [one(spark, S.format_date(at, p)) for p in ("F", "w", "W", "u", "FF", "yyyy 'w' w")] == ["4", "47", "4", "4", "04", "2017 w 47"]
    with pytest.raises(ValueError, match="'Y'"):
        S.format_date(at, "YYYY")


def test_documents(spark):
    doc = F.lit('{"book":[{"title":"a","price":49.0},{"title":"b"}],"n":"12","ok":true}')
    assert one(spark, D.json_list(doc, "$.book[*].title")) == ["a", "b"]
    assert one(spark, D.json_number(doc, "$.book[0].price")) == 49.0 and one(spark, D.json_number(doc, "$.n")) is None and one(spark, D.json_text(doc, "$.ok")) is None
    assert one(spark, D.json_number(F.lit("{broken"), "$.n")) is None
    xml = F.lit("<root><id>7</id><test><data>1</data><data>2</data></test></root>")
    assert one(spark, D.xml_texts(xml, "//data/text()")) == ["1", "2"] and one(spark, D.xml_number(xml, "count(//data)")) == 2
    assert one(spark, D.xml_node(xml, "//test/data")) == "<data>1</data>" and one(spark, D.xml_node(xml, "/root/none")) is None


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_scan(spark):
    assert "EqualTo(user_id,42)" in plan(queries.QUERIES["agg_read"](spark, SF))
    assert "GreaterThan(value,50.0)" in plan(queries.QUERIES["metadata_filter"](spark, SF))
    scanned = plan(queries.QUERIES["log_scan"](spark, SF))
    assert "GreaterThanOrEqual(event_id,2000), LessThanOrEqual(event_id" in scanned and "Window" not in scanned
    assert logs.events(spark, SF, "no id").count() == 0


def test_stored_log_is_read_by_segment(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(logs, "SEGMENT_TOKENS", 100)
    monkeypatch.setattr(L, "SEGMENT_TOKENS", 100)
    path = str(tmp_path / "log")
    log = spark.range(1000).select(F.col("id").alias("token"), (F.col("id") % 7).cast("string").alias("aggregateIdentifier"), F.floor(F.col("id") / 7).alias("aggregateSequenceNumber"))
    assert L.append(log, None, path) == 1000
    stored = logs.read_log(spark, path)
    part = L.scan(stored, 250, 449)
    assert part.count() == 200 and part.select("segment").distinct().count() == 3 and "PartitionFilters: [isnotnull(segment" in plan(part)
    more = spark.createDataFrame([(1000, "6", 142), (1001, "0", 143)], "token long, aggregateIdentifier string, aggregateSequenceNumber long")
    assert L.append(more.where("token = 1000"), stored, path) == 1
    with pytest.raises(ValueError, match="aggregate 0: number 144"):
        L.append(more.where("token = 1001").withColumn("aggregateSequenceNumber", F.lit(144).cast("long")), stored, path)
    registry = Registry()
    registry.hook("write", 2)(lambda rows: rows.withColumn("payloadRevision", F.lit("2")))
    registry.hook("write", 1)(lambda rows: rows.withColumn("payloadRevision", F.lit("1")))
    assert L.append(more.where("token = 1001"), logs.read_log(spark, path), path, registry) == 1
    assert logs.read_log(spark, path).count() == 1002


def test_transactions_can_not_be_entered_in_the_middle(spark):
    log = spark.range(20).select(F.col("id").alias("token"), F.col("id").cast("string").alias("eventIdentifier"), F.floor(F.col("id") / 5).alias("tx"))
    assert [(r.firstToken, r.events) for r in L.transactions(log, "tx", 5, 11).orderBy("firstToken").collect()] == [(5, list("56789")), (10, ["10", "11", "12", "13", "14"])]
    with pytest.raises(Exception, match="inside a transaction"):
        L.transactions(log, "tx", 7, 11).collect()


def test_gaps_across_stretches(spark, monkeypatch):
    monkeypatch.setattr(T, "BUCKET_TOKENS", 10)
    tokens = [0, 1, 2, 5, 9, 10, 11, 19, 20, 35, 36, 50]
    log = spark.createDataFrame([(t,) for t in tokens], "token long")
    assert sorted(r.token for r in L.after_gaps(log).collect()) == [t for t in tokens if t - 1 not in tokens]
    assert L.after_gaps(log.limit(0)).count() == 0


def test_delivery_goes_on_through_a_blacklist(spark, monkeypatch):
    monkeypatch.setattr(T, "BUCKET_TOKENS", 7)
    log = spark.range(50).select(F.col("id").alias("token"), F.lit("skip").alias("t"))
    assert sorted(r.token for r in T.delivered(log, F.col("t") == "skip", 5).collect()) == list(range(4, 50, 5))  # 50 events, 10 delivered
    some = log.withColumn("t", F.when(F.col("token").isin(7, 8, 30), F.lit("take")).otherwise(F.col("t")))
    want, row = [], 0
    for i in range(50):
        row = 0 if i in (7, 8, 30) else row + 1
        if row % 5 == 0:
            want.append(i)
    assert sorted(r.token for r in T.delivered(some, F.col("t") == "skip", 5).collect()) == want


def test_answer_is_chosen_by_id_and_shown_by_key(spark):
    rows = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(300)], "token long, k string")
    shown = [tuple(r) for r in T.answer(rows, sort=["k"], limit=5).collect()]
    assert [k for _, k in shown] == ["c", "c", "b", "b", "a"] and {t for t, _ in shown} == {295, 296, 297, 298, 299}
    assert T.answer(rows).count() == 200 and T.limited(rows).count() == 300


def test_percentiles_are_exact(spark):
    import random

    random.seed(3)
    values = [random.expovariate(0.1) for _ in range(400)] + [5.0] * 300
    log = spark.createDataFrame([("a", v) for v in values] + [("b", 2.0)] * 3 + [("c", None)], "payloadType string, v double")
    got = {r.payloadType: r for r in M.latencies(log, "v", bins=8).collect()}
    ordered = sorted(values)
    for p in (0.5, 0.9, 0.95, 0.99):
        at = p * (len(ordered) - 1)
        low = math.floor(at)
        assert abs(got["a"][f"p{round(100 * p)}"] - (ordered[low] + (ordered[math.ceil(at)] - ordered[low]) * (at - low))) < 1e-6
    assert got["b"].p50 == got["b"].p99 == 2.0 and "c" not in got


def test_ring_moves_only_what_a_lost_member_had(spark):
    requests = spark.range(3000).select(F.col("id").alias("key"))
    members = spark.createDataFrame([(f"m{i}", None) for i in range(8)], "member string, loadFactor int")
    before = {r.key: r.member for r in R.route(requests, members).collect()}
    after = {r.key: r.member for r in R.route(requests, members.where("member <> 'm3'")).collect()}
    assert len(before) == 3000 and set(before.values()) == {f"m{i}" for i in range(8)}
    assert all(after[k] == m for k, m in before.items() if m != "m3") and "m3" not in after.values()
    assert R.route(requests, members.where("member = 'm1'").withColumn("loadFactor", F.lit(1))).where("member = 'm1'").count() == 3000


def test_extensions(spark):
    registry = Registry()
    registry.scalar("Twice")(lambda c: c * 2)
    registry.aggregate("spread")(lambda c: F.max(c) - F.min(c))
    registry.stage("repeat")(lambda rows, times: rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times)))))
    rows = spark.range(5)
    assert rows.agg(registry.call("SPREAD", registry.call("twice", F.col("id"))).alias("x")).first()["x"] == 8
    assert registry.apply(rows, "repeat", 3).count() == 15
    with pytest.raises(ValueError, match="already"):
        registry.scalar("twice")(lambda c: c)
    with pytest.raises(ValueError, match="no function"):
        registry.call("none")


def test_kept_table_and_retractions(spark, tmp_path):
    folder, table = str(tmp_path / "log"), str(tmp_path / "table")
    log = spark.createDataFrame([(i, f"k{i % 4}", i) for i in range(10)], "token long, k string, n long")
    log.where("token < 5").coalesce(1).write.mode("append").parquet(folder)
    log.where("token >= 5").coalesce(1).write.mode("append").parquet(folder)
    stream = live.follow(spark, folder, log.schema, 1, files=1)
    live.keep_table(stream, table, ["k"], str(tmp_path / "state")).awaitTermination(120)
    want = {r.k: r.n for r in T.latest_by_id(log.where("token >= 1"), ["k"]).collect()}
    assert {r.k: r.n for r in live.held(spark, table).collect()} == want
    sent = {r.k: (r.n, r["_deleted"]) for r in live.retractions(spark, table, ["k"], F.col("n") < 6, 0, 1).collect()}
    first = {r.k: r.n for r in spark.read.parquet(f"{table}/batch={0:020d}").collect() if r.n < 6}
    second = {k: n for k, n in want.items() if n < 6}
    assert sent == {k: (None, True) for k in first if k not in second} | {k: (n, False) for k, n in second.items() if first.get(k) != n}


def test_live_answers_equal_batch_answers(spark, tmp_path):
    log = spark.createDataFrame([(i, i * 1000) for i in range(10)], "token long, timestamp long")
    folder = str(tmp_path / "log")
    log.write.parquet(folder)
    query = live.follow(spark, folder, log.schema, 2, since_ms=4000).writeStream.format("memory").queryName("live_since").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(r.token for r in spark.table("live_since").collect()) == [4, 5, 6, 7, 8, 9]
    updates = spark.createDataFrame([(8, 8, "s"), (12, 12, "s"), (13, 13, "t")], "token long, timestamp long, subscription string")
    got = sorted((r.token, r.isUpdate) for r in live.initial_and_updates(log, updates, "s", 9).collect())
    assert got == [(i, False) for i in range(10)] + [(12, True)]


def test_xml_is_parsed_once_with_the_values_of_xpath(spark):
    docs = [
        "<e><k>7</k><k>5</k><t>view</t></e>", "<e/>", "<e><t/></e>", "<e><k> 1.5\n</k><k>-.5</k><k>2.</k></e>", "<e><k>1e3</k></e>", "<e><k>+1</k><t>a</t></e>", "<e><k/><k>0.1</k></e>",
        "<e><k>0.1</k><k>0.2</k><k>0.3</k><k>1234567890123456789</k></e>", "<e><k>1<k>2</k>3<x>4</x>5</k><t>a<b>b</b>c</t></e>", "<k><e><k>8</k></e><t>&lt;&amp;\U0001f600&#65;</t></k>",
        "<e><k>1<!-- no -->2</k></e>", "<e><k><![CDATA[3]]>4</k></e>", "<?xml version='1.0'?><e><k>9</k></e>", "<e xmlns='urn:x'><k>1</k><t>n</t></e>", "<e k='a:b'><t>12:30</t><k>6</k></e>",
        "<e xmlns:a='urn:a'><a:k>5</a:k><k a:b='c'>6</k></e>", "", None,
    ]
    wanted = {
        "a": ("text", "//t"), "b": ("text", "/e/t/text()"), "c": ("number", "sum(//k)"), "d": ("number", "count(//k)"), "e": ("number", "//k"), "f": ("texts", "//k/text()"),
        "g": ("number", "count(/e/k/text())"), "h": ("text", "//k[2]"), "i": ("texts", "/e//k/text()"), "j": ("text", "count(//k)"), "k": ("number", "/e/k/text()"),
    }
    frame = spark.createDataFrame([(d,) for d in docs], "doc string")
    plainly = {"text": D.xml_text, "number": D.xml_number, "texts": D.xml_texts}
    got = frame.select("doc", D.xml_fields(F.col("doc"), **wanted).alias("x")).select("doc", "x.*").collect()
    want = frame.select("doc", *[plainly[kind](F.col("doc"), path).alias(n) for n, (kind, path) in wanted.items()]).collect()
    assert [repr(r) for r in got] == [repr(r) for r in want]
    for broken in ("<e><k>", "  ", "<e>&none;</e>"):
        with pytest.raises(Exception, match="parse|SAX|XML|ParseError|not well-formed|no element|undefined entity"):
            spark.createDataFrame([(broken,)], "doc string").select(D.xml_fields(F.col("doc"), t=("text", "//t")).alias("x")).collect()
    used = plan(queries.QUERIES["xml_values"](spark, SF))
    assert used.count("ArrowEvalPython [") == 1  # one parse a document
    assert used.count("XPath") == used.count("ELSE invoke(XPath") + used.count("ELSE array_join(invoke(XPath") > 0  # Spark's only for the others
