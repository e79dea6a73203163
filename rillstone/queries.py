"""The registered event-log queries and their SQL."""

from __future__ import annotations

from .plans import event_queries, operator_queries

flagship = event_queries.group_count
QUERIES = {f.__name__: f for f in (*event_queries.ALL, *operator_queries.ALL)}

#: The log that the SQL below reads.
LOG = """WITH log AS (
  SELECT event_id AS token, CAST(user_id AS VARCHAR) AS "aggregateIdentifier", row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS "aggregateSequenceNumber",
         event_type AS "payloadType", props AS "payloadData", epoch_us(ts) // 1000 AS "timestamp", value, ts FROM events
), lines AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS "aggregateIdentifier", CAST(l_linenumber AS BIGINT) - 1 AS "aggregateSequenceNumber", l_quantity AS quantity FROM lineitem
) """



def _mean(total: str, n: str) -> str:
    """A mean of whole numbers to eight places, halves towards zero."""
    return f"CASE WHEN {n} > 0 THEN sign({total}) * CAST((2 * abs(CAST({total} AS HUGEINT)) * 100000000 + {n} - 1) // (2 * {n}) AS DOUBLE) / 1e8 END"


def _quotient(a: str, b: str) -> str:
    """A quotient of whole numbers, halves away from zero."""
    return f"(CASE WHEN ({a} < 0) <> ({b} < 0) THEN -1 ELSE 1 END * ((2 * abs({a}) + abs({b})) // (2 * abs({b}))))"


_ON_LOG = {
    "group_count": 'SELECT "payloadType", count(*) AS n FROM log GROUP BY ALL',
    "filter_eq": """SELECT token, "payloadType" FROM log WHERE "payloadType" = 'error'""",
    "filter_and_or_not": """SELECT token, "aggregateIdentifier" FROM log WHERE "payloadType" = 'click' AND (token > 100 OR "aggregateIdentifier" <> '8')""",
    "filter_not_equal": """SELECT token, "payloadType" FROM log WHERE "payloadType" IS DISTINCT FROM 'view' AND token <= 5000""",
    "filter_in_list": """SELECT token, "payloadType" FROM log WHERE "payloadType" IN ('click', 'view')""",
    "filter_contains": """SELECT token, "payloadData" FROM log WHERE "payloadData" LIKE '%69%'""",
    "filter_match": """SELECT token, "payloadType" FROM log WHERE regexp_full_match("payloadType", 'c.*k')""",
    "last_window": """SELECT token, "timestamp" FROM log WHERE ts >= TIMESTAMP '2024-01-28 12:00:00'""",
    "last_month_groups": """SELECT "payloadType", count(*) AS n FROM log WHERE ts >= TIMESTAMP '2024-01-17' GROUP BY ALL""",
    "select_arith": """SELECT token, CAST(round("aggregateSequenceNumber" / 2) AS BIGINT) AS h, token % 7 AS m, token * 3 - "aggregateSequenceNumber" + 1 AS t, 'x' || "payloadType" AS s FROM log""",
    "select_strings": """SELECT token, upper("payloadType") AS u, lower("payloadType") AS w, "payloadType"[2:4] AS p, left("payloadType", 2) AS l, right("payloadType", 3) AS r, length("payloadData") AS n FROM log""",
    "concat_list": """SELECT token, concat_ws('-', "payloadType", "aggregateIdentifier") AS c FROM log""",
    "format_date": """SELECT token, strftime(ts, '%Y/%m/%d %H:%M') AS t, strftime(ts + INTERVAL 9 HOUR, '%H:%M') AS tokyo FROM log""",
    "date_parts": """SELECT token, strftime(ts, '%Y') AS y, strftime(ts, '%m') AS mm, CAST((day(ts) + 6) // 7 AS VARCHAR) AS d, strftime(ts, '%H') AS hh,
        CAST(CASE WHEN month(ts) = 12 AND day(ts) - dayofweek(ts) >= 26 THEN 1 ELSE (dayofyear(ts) - 1 + dayofweek(date_trunc('year', ts))) // 7 + 1 END AS VARCHAR) AS w FROM log""",
    "json_number": """SELECT "payloadType", round(avg(CAST(json_extract("payloadData", '$.k') AS DOUBLE)), 8) AS k FROM log GROUP BY ALL""",
    "metadata_filter": "SELECT token, value FROM log WHERE value > 50",
    "group_multi": 'SELECT "payloadType", "aggregateIdentifier", count(*) AS n, max(token) AS mx, min(token) AS mn FROM log GROUP BY ALL',
    "group_having": 'SELECT "payloadType", count(*) AS n FROM log GROUP BY ALL HAVING count(*) > 2000',
    "group_last_value": 'SELECT "payloadType", arg_max("payloadData", token) AS "lastData" FROM log GROUP BY ALL',
    "global_count": 'SELECT count(*) AS "count" FROM log HAVING count(*) > 0',
    "global_avg": f'SELECT {_mean("sum(n)", "count(n)")} AS avg FROM (SELECT "aggregateSequenceNumber" AS n FROM log) HAVING count(*) > 0',
    "running_avg": f'SELECT token, {_mean("s", "c")} AS a FROM (SELECT token, sum("aggregateSequenceNumber") OVER w AS s, count("aggregateSequenceNumber") OVER w AS c FROM log WINDOW w AS (ORDER BY token))',
    "nested_group": 'SELECT n, count(*) AS m FROM (SELECT row_number() OVER (PARTITION BY "aggregateIdentifier" ORDER BY token) AS n FROM log) GROUP BY n',
    "limit_ids": 'SELECT token, "payloadType" FROM log ORDER BY token DESC LIMIT 10',
    "sort_limit": 'SELECT * FROM (SELECT token, "payloadType" FROM log ORDER BY token DESC LIMIT 10) ORDER BY "payloadType" DESC',
    "agg_read": """SELECT token, "aggregateSequenceNumber" FROM log WHERE "aggregateIdentifier" = '42' AND "aggregateSequenceNumber" BETWEEN 3 AND 19""",
    "agg_snapshot": """, snap AS (SELECT "aggregateIdentifier" AS a, max("aggregateSequenceNumber") AS s FROM lines WHERE "aggregateSequenceNumber" = 2 GROUP BY 1)
        SELECT a AS "aggregateIdentifier", s AS "aggregateSequenceNumber", true AS "isSnapshot" FROM snap
        UNION ALL SELECT l."aggregateIdentifier", l."aggregateSequenceNumber", false FROM lines l LEFT JOIN snap ON a = l."aggregateIdentifier" WHERE s IS NULL OR l."aggregateSequenceNumber" > s""",
    "highest_number": 'SELECT "aggregateIdentifier", max("aggregateSequenceNumber") AS highest FROM log GROUP BY ALL',
    "token_bounds": 'SELECT coalesce(min(token), -1) AS "firstToken", coalesce(max(token), -1) AS "lastToken" FROM log',
    "token_at": 'SELECT coalesce(min(token) FILTER ("timestamp" >= 1705320000000), max(token) + 1, -1) AS token FROM log',
    "token_gaps": """SELECT token FROM (SELECT token, lag(token) OVER (ORDER BY token) AS p FROM log WHERE "payloadType" <> 'error') WHERE p IS NULL OR p + 1 <> token""",
    "seq_check": """SELECT "aggregateIdentifier", "aggregateSequenceNumber", p + 1 AS expected FROM (
        SELECT *, coalesce(lag("aggregateSequenceNumber") OVER (PARTITION BY "aggregateIdentifier" ORDER BY "aggregateSequenceNumber"), -1) AS p FROM lines WHERE quantity > 10) WHERE "aggregateSequenceNumber" <> p + 1""",
    "snapshot_check": """SELECT h."aggregateIdentifier", CAST(3 AS BIGINT) AS "aggregateSequenceNumber" FROM lines h
        JOIN (SELECT "aggregateIdentifier", max("aggregateSequenceNumber") AS m FROM lines GROUP BY 1) x ON x."aggregateIdentifier" = h."aggregateIdentifier" WHERE h."aggregateSequenceNumber" = 0 AND m >= 3""",
    "rate_buckets": """SELECT "payloadType", bucket, n, CAST(sum(n) OVER (PARTITION BY "payloadType" ORDER BY bucket RANGE BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS "inWindow"
        FROM (SELECT "payloadType", "timestamp" // 3600000 AS bucket, count(*) AS n FROM log GROUP BY ALL)""",
    "latency_pct": """SELECT "payloadType", round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM log GROUP BY ALL""",
    "composite_metric": """SELECT "payloadType", count(value) AS "count", min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean FROM log GROUP BY ALL""",
    "silent_aggregates": 'SELECT "aggregateIdentifier", max("timestamp") AS "lastSeen" FROM log GROUP BY ALL HAVING max("timestamp") < 1706616000000',
}

_CLAIMS = """, claims AS (SELECT CAST(s_nationkey % 5 AS BIGINT) AS processor, 'c' || (s_suppkey % 6) AS client, CAST((s_suppkey % 8) % (1 << CAST(s_suppkey % 4 AS INT)) AS BIGINT) AS segment,
    CAST(1 << CAST(s_suppkey % 4 AS INT) AS BIGINT) AS "onePartOf" FROM supplier) """
_DOC = """'{"k":' || json_extract_string("payloadData", '$.k') || '}'"""
_ON_LOG |= {
    "filter_eq_types": """SELECT token, "aggregateIdentifier" FROM log WHERE "aggregateIdentifier" = '42'""",
    "filter_in_items": """SELECT token, "aggregateIdentifier", "payloadType" FROM log WHERE "aggregateIdentifier" IN (CAST(token % 150 AS VARCHAR), '7') AND "payloadType" <> 'view'""",
    "filter_list_contains": """SELECT token FROM log WHERE list_contains(["payloadType", "aggregateIdentifier", CAST(token % 10 AS VARCHAR)], '7') OR "payloadType" = 'click'""",
    "match_whole": """SELECT token FROM log WHERE "payloadType" = 'click' AND token % 2 = 1""",
    "last_latest": "SELECT token FROM log WHERE ts >= TIMESTAMP '2024-01-28 12:00:00'",
    "divide_decimals": f"""SELECT l_orderkey, l_linenumber, CAST({_quotient("price * 10", "number")} AS DOUBLE) / 100 AS each, CAST({_quotient("-price", "7")} AS DOUBLE) / 100 AS week
        FROM (SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(12, 2)) * 100 AS HUGEINT) AS price, CAST(CAST(l_quantity AS DECIMAL(5, 1)) * 10 AS HUGEINT) AS number FROM lineitem)""",
    "text_length": """SELECT token, CAST(length("payloadType") + 2 + length("payloadData") AS BIGINT) AS n FROM log""",
    "date_letters": """SELECT token, strftime(ts, '%Y-%m-%d ') || ((day(ts) + 6) // 7) || '/' || ((day(ts) + dayofweek(date_trunc('month', ts)) - 1) // 7 + 1) || '/' ||
        lpad(CAST((dayofyear(ts) - 1 + dayofweek(date_trunc('year', ts))) // 7 + 1 AS VARCHAR), 2, '0') || ' ' || isodow(ts) || ' at ' || strftime(ts, '%H') AS t,
        strftime(jp, '%m.%Y') || ' week ' || ((dayofyear(jp) - 1 + dayofweek(date_trunc('year', jp))) // 7 + 1) AS tokyo FROM (SELECT token, ts, ts + INTERVAL 9 HOUR AS jp FROM log)""",
    "json_values": f"""SELECT token, "payloadType" || ',x' AS titles, "payloadType" AS first, {_DOC} AS object, CAST(json_extract("payloadData", '$.k') AS DOUBLE) AS number,
        CAST(NULL AS DOUBLE) AS quoted, CAST(NULL AS VARCHAR) AS flag, CAST(NULL AS DOUBLE) AS none FROM log""",
    "xml_values": """SELECT token, "payloadType" AS t, CAST(k AS DOUBLE) + 5 AS total, CAST(2 AS DOUBLE) AS n, k || ',5' AS "all", '<t>' || "payloadType" || '</t>' AS node
        FROM (SELECT *, json_extract_string("payloadData", '$.k') AS k FROM log)""",
    "map_text": """SELECT token, '{"type":"' || "payloadType" || '","user":"' || "aggregateIdentifier" || '"}' AS m FROM log""",
    "select_limit": 'SELECT "payloadType" AS p, "payloadData" AS k FROM log ORDER BY token DESC LIMIT 25',
    "group_limit": 'SELECT "payloadType", "aggregateIdentifier", count(*) AS n FROM log GROUP BY ALL ORDER BY 1 DESC, 2 DESC LIMIT 7',
    "group_shown": "SELECT token % 500 AS k, count(*) AS n FROM log GROUP BY ALL ORDER BY k DESC LIMIT 200",
    "limit_default": "SELECT token FROM log ORDER BY token DESC LIMIT 1000",
    "limit_count": 'SELECT count(*) AS "count" FROM (SELECT token FROM log ORDER BY token DESC LIMIT 10) HAVING count(*) > 0',
    "count_values": """SELECT "payloadType", count(*) FILTER (value > 50) AS high, count(*) + count(*) FILTER (token % 3 = 0) AS items, count(*) FILTER (token % 4 = 0) AS some FROM log GROUP BY ALL""",
    "mean_half_down": f"""SELECT "payloadType", {_mean("sum(x)", "count(x)")} AS mean, {_mean("sum(k)", "count(k)")} AS k
        FROM (SELECT "payloadType", CASE WHEN "payloadType" <> 'view' THEN token - 3000 END AS x, CAST(json_extract("payloadData", '$.k') AS BIGINT) AS k FROM log) GROUP BY ALL""",
    "running_filter": """SELECT token, "payloadType" FROM log WHERE token NOT IN (SELECT token FROM log ORDER BY token LIMIT 2)""",
    "group_expression": 'SELECT "payloadType", count(*) + 1 AS n, max(token) - min(token) AS span FROM log GROUP BY ALL',
    "null_groups": """SELECT nullif("payloadType", 'error') AS k, CAST(token % 2 AS DOUBLE) AS odd, count(*) AS n FROM log GROUP BY ALL""",
    "log_scan": """SELECT token, "payloadType" FROM log WHERE token BETWEEN 2000 AND 7000 AND "timestamp" >= 1705320000000""",
    "empty_query": "SELECT token FROM log WHERE token >= greatest((SELECT max(token) FROM log) - 200, 0)",
    "event_stream": 'SELECT token, "payloadType" FROM log WHERE token >= 500 ORDER BY token LIMIT 25',
    "agg_newest": """SELECT token, "aggregateSequenceNumber" FROM log WHERE "aggregateIdentifier" = '42' ORDER BY token DESC LIMIT 4""",
    "snapshot_scan": """SELECT "aggregateIdentifier", "aggregateSequenceNumber" FROM lines WHERE "aggregateSequenceNumber" % 3 = 2 AND quantity > 25""",
    "snapshot_list": """SELECT "aggregateSequenceNumber", quantity FROM lines WHERE "aggregateIdentifier" = '100' AND "aggregateSequenceNumber" % 3 = 2 ORDER BY 1 DESC LIMIT 5""",
    "latest_event": """SELECT "aggregateIdentifier", max("aggregateSequenceNumber") AS "aggregateSequenceNumber", max(token) AS token, arg_max("payloadType", token) AS "payloadType"
        FROM log WHERE "aggregateSequenceNumber" BETWEEN 2 AND 19 GROUP BY 1""",
    "highest_known": """SELECT CAST(i AS VARCHAR) AS "aggregateIdentifier", coalesce(max("aggregateSequenceNumber"), -1) AS highest FROM range(100, 200) r(i) LEFT JOIN log ON "aggregateIdentifier" = CAST(i AS VARCHAR) GROUP BY 1""",
    "transaction_list": """SELECT min(token) AS "firstToken", count(*) AS n, string_agg(CAST(token AS VARCHAR), ',' ORDER BY token) AS events FROM log GROUP BY token // 10 HAVING min(token) >= 100 AND min(token) < 305""",
    "replica_append": """SELECT token, CASE WHEN token >= 512 THEN 'gap' WHEN token >= 500 THEN 'append' WHEN token % 7 = 0 THEN 'differs' ELSE 'known' END AS state FROM log WHERE token BETWEEN 480 AND 520 AND token <> 511""",
    "latest_rows_by_id": """SELECT "payloadType", "aggregateIdentifier", max(token) AS token, arg_max("payloadData", token) AS "payloadData" FROM log GROUP BY 1, 2""",
    "retracted": """, b AS (SELECT "aggregateIdentifier" AS i, count(*) AS n FROM log WHERE token < 400 GROUP BY 1 HAVING count(*) BETWEEN 2 AND 4),
        a AS (SELECT "aggregateIdentifier" AS i, count(*) AS n FROM log WHERE token < 600 GROUP BY 1 HAVING count(*) BETWEEN 2 AND 4)
        SELECT i AS "aggregateIdentifier", n, false AS "_deleted" FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT i, -1, true FROM b WHERE i NOT IN (SELECT i FROM a)""",
    "blacklist": """, placed AS (SELECT token, "payloadType", count(*) FILTER ("payloadType" = 'click') OVER (ORDER BY token) AS island FROM log),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY island ORDER BY token) - CASE WHEN island > 0 THEN 1 ELSE 0 END AS r FROM placed)
        SELECT token, "payloadType" FROM ranked WHERE "payloadType" = 'click' OR r % 5 = 0""",
    "live_counts": 'SELECT "payloadType", count(*) AS n, max(token) AS "lastToken" FROM log WHERE token >= 100 GROUP BY 1',
    "live_windows": """SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS day, "payloadType", count(*) AS n FROM log GROUP BY ALL""",
    "initial_and_updates": 'SELECT token, "payloadType", token > 400 AS "isUpdate" FROM log WHERE token <= 400 OR token % 3 = 0',
    "extended": """SELECT upper("payloadType"[1]) AS k, "payloadType" || '!' AS "payloadType", max(token) - min(token) AS spread, count(*) * 2 AS n FROM log WHERE token % 2 = 0 GROUP BY ALL""",
    "rate_windows": """SELECT "payloadType", count(*) FILTER (s >= 1705320000 - 3600 AND "timestamp" <= 1705320000000) * 86400 // 3600 AS rate3600,
        count(*) FILTER (s >= 1705320000 - 21600 AND "timestamp" <= 1705320000000) * 86400 // 21600 AS rate21600,
        count(*) FILTER (s >= 1705320000 - 86400 AND "timestamp" <= 1705320000000) * 86400 // 40000 AS rate86400 FROM (SELECT *, "timestamp" // 1000 AS s FROM log) GROUP BY 1""",
    "timer_snapshot": 'SELECT "payloadType", count(value) AS "count", round(avg(value), 6) AS mean, max(value) AS max FROM log GROUP BY ALL',
    "request_metrics": """SELECT "payloadType" AS request, token % 3 AS source, token % 4 AS target, 'default' AS context, count(value) AS "count", round(avg(value), 6) AS mean, max(value) AS max FROM log GROUP BY ALL""",
    "subscription_metrics": """, k AS (SELECT token, 'q' || (CAST("aggregateIdentifier" AS INT) % 4) AS query, "aggregateIdentifier" AS s, "payloadType" AS t FROM log WHERE "payloadType" IN ('signup', 'error', 'click')),
        b AS (SELECT query, t, lag(t) OVER (PARTITION BY query, s ORDER BY token) AS p FROM k WHERE t <> 'click')
        SELECT query, total, total - ended AS active, updates FROM (SELECT query, count(*) FILTER (t = 'signup') AS total, count(*) FILTER (t = 'error' AND p = 'signup') AS ended FROM b GROUP BY 1)
        JOIN (SELECT query, count(*) FILTER (t = 'click') AS updates FROM k GROUP BY 1) USING (query)""",
    "tag_routing": """, h AS (SELECT CAST(n_nationkey % 5 + 1 AS VARCHAR) AS command, n_name AS client, ['F', 'O', 'P'][n_nationkey % 3 + 1] AS status, CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_regionkey AS VARCHAR) END AS region FROM nation),
        s AS (SELECT o_orderkey AS request, client, CAST(CASE WHEN o_orderstatus = status THEN 1 ELSE -1 END + CASE WHEN region IS NULL THEN 0 WHEN region = CAST(o_custkey % 5 AS VARCHAR) THEN 1 ELSE -1 END AS INT) AS score
              FROM orders JOIN h ON command = left(o_orderpriority, 1))
        SELECT request, client, score FROM s QUALIFY score = max(score) OVER (PARTITION BY request)""",
    "handler_candidates": """SELECT CAST(s_suppkey % 7 AS VARCHAR) AS query, CAST(s_nationkey AS VARCHAR) AS component, string_agg(DISTINCT s_name, ',' ORDER BY s_name) AS clients FROM supplier WHERE s_acctbal > 0 GROUP BY ALL""",
    "hash_routing": """, ring AS (SELECT n_name AS member, md5(n_name || ' #' || i) AS point FROM nation, range(100) t(i) WHERE i < CASE WHEN n_nationkey % 2 = 0 THEN 20 ELSE 100 END),
        keys AS (SELECT o_custkey AS k, md5(CAST(o_custkey AS VARCHAR)) AS h FROM orders GROUP BY ALL),
        owner AS (SELECT k, coalesce(arg_min(member, point) FILTER (point >= h), arg_min(member, point)) AS member FROM keys, ring GROUP BY k)
        SELECT o_orderkey AS request, member FROM orders JOIN owner ON k = o_custkey""",
    "scatter_gather": """, h AS (SELECT ['click', 'error', 'purchase', 'signup', 'view'][s_suppkey % 5 + 1] AS query, CAST(s_nationkey % 3 AS VARCHAR) AS component, list(DISTINCT s_name ORDER BY s_name) AS every FROM supplier WHERE s_suppkey < 40 GROUP BY ALL),
        r AS (SELECT token, "payloadType" AS query, row_number() OVER (PARTITION BY "payloadType" ORDER BY token) - 1 AS turn FROM log)
        SELECT token, query, component, every[turn % len(every) + 1] AS handler FROM r JOIN h USING (query)""",
    "response_merge": """, r AS (SELECT l_orderkey AS request, CAST(l_linenumber AS BIGINT) AS no, bool_or(l_returnflag <> 'N') AS failed FROM lineitem GROUP BY 1, 2)
        SELECT request, no, failed FROM (SELECT *, max(no) FILTER (NOT failed) OVER (PARTITION BY request) AS good, max(no) FILTER (failed) OVER (PARTITION BY request) AS bad FROM r)
        WHERE NOT failed OR (no = bad AND (good IS NULL OR bad > good))""",
    "processor_warnings": _CLAIMS + """SELECT processor, max(n) > 1 AS duplicates, sum(1.0 / part) < 1 AS missing FROM (SELECT processor, segment, count(*) AS n, min("onePartOf") AS part FROM claims GROUP BY ALL) GROUP BY 1""",
    "segment_choice": _CLAIMS + """SELECT processor, client, segment, "onePartOf", CAST(-1 AS BIGINT) AS "mergesWith" FROM claims QUALIFY row_number() OVER (PARTITION BY processor ORDER BY "onePartOf", segment, client) = 1
        UNION ALL SELECT processor, client, segment, "onePartOf", CAST(xor(segment, "onePartOf" // 2) AS BIGINT) FROM claims QUALIFY row_number() OVER (PARTITION BY processor ORDER BY "onePartOf" DESC, segment, client DESC) = 1""",
    "processor_roll_up": _CLAIMS + """, i AS (SELECT CAST(r_regionkey AS BIGINT) AS processor, 'c' || c AS client, (c + r_regionkey) % 3 > 0 AS running, c + 2 AS capacity FROM region, range(6) t(c)),
        t AS (SELECT processor, client, count(*) AS n, min("onePartOf") AS least FROM claims GROUP BY ALL),
        b AS (SELECT i.*, coalesce(n, 0) AS n, least FROM i LEFT JOIN t USING (processor, client))
        SELECT processor, CAST(sum(n) AS BIGINT) AS "activeThreads", coalesce(string_agg(client, ',' ORDER BY client) FILTER (n < capacity), '') AS "freeClients", bool_or(running) AS "canPause", bool_or(NOT running) AS "canPlay",
        bool_or(running) AS "canSplit", bool_or(running) AND coalesce(min(least) <> 1, true) AS "canMerge" FROM b GROUP BY 1""",
}
ORACLES = {name: LOG + sql for name, sql in _ON_LOG.items()}
