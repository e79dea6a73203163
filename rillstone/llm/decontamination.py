"""Benchmark decontamination with a broadcast hash set of normalised word windows; DataFrame functions only.

Benchmark items give every run of ``n`` words (a shorter item its whole sequence). Documents are tokenised once; the
hash of every window is looked up in the broadcast set; a hit counts only if the words themselves are the same. Nothing
but hits, and one marker row a document, leaves the task that read the document.

Defined cases: null or wordless text has no words and no hits; rows with the same id stay separate rows, and ``remove``
and ``cut_spans`` decide each by its own text; texts of any length are searched whole; an empty benchmark gives no hits,
an empty table an empty result; a null item id counts as the empty string; item ids that repeat count once; other columns
pass through ``remove`` and ``cut_spans`` whatever their names (one named ``clean_words`` is replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, boxed, row_keys, settle, table, unboxed

#: The window set is broadcast up to this many windows (about 200 bytes each); beyond, it is joined by a shuffle on the hash.
MAX_BROADCAST_WINDOWS = 1_000_000
#: The keys of contaminated rows are broadcast up to this many (24 bytes each); beyond, documents are joined by a shuffle.
MAX_BROADCAST_ROWS = 1_000_000


def tokens(text: Column) -> Column:
    """Lower-cased runs of digits, a-z and characters beyond ASCII."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def window_hashes(words: Column, n: int) -> Column:
    """A hash of each run of ``n`` items, in order; empty if there are fewer."""
    count = F.size(words) - (n - 1)
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.xxhash64(F.slice(words, i, n)))).otherwise(F.array().cast("array<bigint>"))


def benchmark_windows(benchmark: DataFrame, n: int = 10, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """A row for each distinct window: its words, their number, and the items that have it."""
    words = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), tokens(F.col(text)).alias("words")).where(F.size("words") > 0)
    size = F.least(F.size("words"), F.lit(n))
    runs = words.select("item", size.alias("len"), F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - size + 1), lambda i: F.slice(F.col("words"), i, size))).alias("window"))
    return runs.groupBy("window", "len").agg(F.collect_set("item").alias("items"))


def hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, doc_id: str = "doc_id", text: str = "text", keyed: bool = False) -> DataFrame:
    """A row for each document: ``n_words``, the hit ``spans`` (first word from 1, number of words) and the ``items`` found.

    If ``keyed``, also the two ``row_keys``, which tell rows of the same id apart.

    Beyond ``MAX_BROADCAST_WINDOWS`` each window of a document is a slim row (its hash and its own words) that is shuffled
    to the benchmark's windows of that hash: in proportion to the text, and adaptive execution splits a frequent window.
    """
    windows = benchmark_windows(benchmark, n)
    lengths = sorted(r["len"] for r in windows.groupBy("len").count().collect())  # at most n rows
    known = windows.select(F.xxhash64(F.transform("window", lambda w: F.xxhash64(w))).alias("_h"), F.col("len").alias("_blen"), F.col("window").alias("_window"), F.col("items").alias("_items"))
    small = known.count() <= MAX_BROADCAST_WINDOWS
    own = ["_row", "doc_id", *["_key", "_hash"] * keyed]
    keys = [k.alias(name) for k, name in zip(row_keys(F.col(doc_id), F.col(text)), ("_key", "_hash"))] if keyed else []
    words = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(doc_id).alias("doc_id"), *keys, tokens(F.col(text)).alias("_words"))
    hashed = words.withColumn("_words_h", F.transform("_words", lambda w: F.xxhash64(w)))
    looked = hashed.select(*own, "_words", F.size("_words").alias("n_words"), F.concat(F.array(F.lit(0).cast("long")), *[window_hashes(F.col("_words_h"), k) for k in lengths]).alias("_hashes"))
    # _hashes is never empty; the outer form keeps Spark from inferring a filter that would hash every window twice
    each = looked.select(*own, "_words", "n_words", F.posexplode_outer("_hashes").alias("_pos", "_dh"))
    start, size, first = F.lit(0), F.lit(0), F.lit(1)  # the marker is at 0; then the windows of each length in turn
    for k in lengths:
        count = F.greatest(F.col("n_words") - (k - 1), F.lit(0))
        inside = (F.col("_pos") >= first) & (F.col("_pos") < first + count)
        start, size = F.when(inside, F.col("_pos") - first + 1).otherwise(start), F.when(inside, F.lit(k)).otherwise(size)
        first = first + count
    own_words = lambda start, size: F.slice(F.col("_words"), F.greatest(start, F.lit(1)), size)
    if small:
        marker = docs.sparkSession.range(1).select(F.lit(0).cast("long").alias("_h"), F.lit(0).alias("_blen"), F.array().cast("array<string>").alias("_window"), F.array().cast("array<string>").alias("_items"))
        same = (F.col("_dh") == F.col("_h")) & (F.col("_blen") == size) & ((size == 0) | (own_words(start, size) == F.col("_window")))
        found = each.join(F.broadcast(known.unionAll(marker)), same).select(*own, "n_words", start.alias("start"), size.alias("len"), "_items")
    else:
        # a marker has a hash of its own and no window of length 0 to meet; it is kept as the row of a document without hits
        slim = each.select(*own, "n_words", start.alias("start"), size.alias("len"), F.when(size == 0, F.col("_row")).otherwise(F.col("_dh")).alias("_dh"), own_words(start, size).alias("_own"))
        same = (F.col("_dh") == F.col("_h")) & (F.col("len") == F.col("_blen")) & (F.col("_own") == F.col("_window"))
        met = slim.join(known, same, "left").where((F.col("len") == 0) | F.col("_h").isNotNull())
        found = met.select(*own, "n_words", "start", "len", F.coalesce("_items", F.array().cast("array<string>")).alias("_items"))
    span = F.when(F.col("len") > 0, F.struct("start", "len"))
    return found.groupBy(*own, "n_words").agg(F.array_sort(F.collect_set(span)).alias("spans"), F.array_distinct(F.flatten(F.collect_set("_items"))).alias("items")).drop("_row")


def covered(spans: Column) -> Column:
    """Number of words in the union of sorted spans."""

    def add(state: Column, span: Column) -> Column:
        end = F.greatest(state["end"], span["start"] + span["len"] - 1)
        fresh = end - F.greatest(state["end"], span["start"] - 1)
        return F.struct(end.alias("end"), (state["n"] + F.greatest(fresh, F.lit(0))).alias("n"))

    return F.aggregate(spans, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), add)["n"]


def report(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """A row for each document: words, hit words, items, digest of the item ids, contaminated or not."""
    found = hits(docs, benchmark, n).withColumn("n_hit", covered(F.col("spans")).cast("long"))
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int, doc_id: str, text: str) -> DataFrame:
    """Keys and spans of the rows that hold a window, each pair of keys once (equal texts have equal spans); broadcast if few."""
    bad = hits(docs, benchmark, n, doc_id, text, keyed=True).where(F.size("spans") > 0)
    bad = settle(bad.groupBy(F.col("_key").alias("_bkey"), F.col("_hash").alias("_bhash")).agg(F.max("spans").alias("_spans")))
    return F.broadcast(bad) if bad.count() <= MAX_BROADCAST_ROWS else bad


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    key, hashed = row_keys(F.col(doc_id), F.col(text))
    return boxed(docs, key.alias("_key"), hashed.alias("_hash"), F.col(text).alias("_text"))


def remove(docs: DataFrame, benchmark: DataFrame, n: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without those that hold any benchmark window; each row is decided by its own text, whatever its id."""
    bad = contaminated(docs, benchmark, n, doc_id, text)
    return unboxed(_keyed(docs, doc_id, text).join(bad.select("_bkey", "_bhash"), (F.col("_key") == F.col("_bkey")) & (F.col("_hash") == F.col("_bhash")), "left_anti"))


def cut_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with hit words left out, as ``clean_words``: the normalised words that no hit covers."""
    bad = contaminated(docs, benchmark, n, doc_id, text)
    joined = _keyed(docs, doc_id, text).join(bad, (F.col("_key") == F.col("_bkey")) & (F.col("_hash") == F.col("_bhash")), "left").withColumn("_words", tokens(F.col("_text")))
    # spans are sorted by their start: those of an array of hit positions are looked up by one merge, not once a word
    covered_at = F.array_distinct(F.flatten(F.transform("_spans", lambda s: F.sequence(s["start"], s["start"] + s["len"] - 1))))
    kept = F.array_except(F.sequence(F.lit(1), F.size("_words")), covered_at)
    clean = F.when(F.col("_spans").isNull() | (F.size("_words") == 0), F.col("_words")).otherwise(F.transform(kept, lambda i: F.get(F.col("_words"), i - 1)))
    return unboxed(joined, clean.alias("clean_words"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op6_decontamination``: all documents against all benchmark items."""
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH item AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), win AS (
  SELECT item, least(len(w), 10) AS n, unnest(list_transform(range(1, CAST(len(w) - least(len(w), 10) + 2 AS BIGINT)), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS g
  FROM item WHERE len(w) > 0
), doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), sizes AS (SELECT DISTINCT n FROM win),
dwin AS (
  SELECT r, s.n AS n, unnest(range(1, CAST(len(w) - s.n + 2 AS BIGINT))) AS p,
         unnest(list_transform(range(1, CAST(len(w) - s.n + 2 AS BIGINT)), lambda i: array_to_string(w[i:i + s.n - 1], ' '))) AS g
  FROM doc, sizes s WHERE len(w) >= s.n
), hit AS (SELECT d.r, d.p, d.n, w.item FROM dwin d JOIN win w ON d.g = w.g AND d.n = w.n),
words AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS x FROM (SELECT DISTINCT r, p, n FROM hit)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN words h ON d.r = h.r LEFT JOIN items i ON d.r = i.r
"""
