"""Sharding by jump consistent hashing; DataFrame functions only.

A document's shard depends on its id and the number of shards alone. With one more shard, documents move only into the
new one. Inside a shard, slots are numbered from 0 in the order of the ids' md5 digests.

Defined cases: a null id hashes as key -1, an id that is no whole number by its text; null text has 8 bytes of size and
checksum 0; rows with the same id share a shard and have slots of their own; texts of any length are only measured and
hashed; an empty table gives an empty result; ``place`` does not look at other columns, ``with_shards`` keeps them and
replaces one that is named ``shard``. Slots follow the digest of id and text, so rows without an id are no hot group; only
rows alike in both are numbered by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import boxed, hex_prefix, running_total, settle, table, unboxed

#: Multiplier of the published generator, and 2 to the power of 64.
STEP = 2862933555777941757
WRAP = 18446744073709551616
#: Rows that are numbered together.
BUCKET_ROWS = 512


def jump(key: Column, shards: int, more: int = 0) -> Column:
    """Struct of ``shard`` (of ``shards``) and ``grown`` (of ``shards + more``) for a long key.

    The published loop: the generator advances, and the next jump goes to (b + 1) * 2**31 / (top 31 bits + 1). Jumps only
    grow, so one run to the larger number gives both answers: the last jump below each. Each step costs one decimal
    product modulo 2**64; a key jumps about ln(shards) times.
    """
    start = F.struct(
        F.when(key < 0, key.cast("decimal(38,0)") + F.lit(str(WRAP)).cast("decimal(38,0)")).otherwise(key.cast("decimal(38,0)")).cast("decimal(38,0)").alias("k"),
        F.lit(0).cast("long").alias("j"),
        F.lit(0).cast("long").alias("small"),
        F.lit(0).cast("long").alias("large"),
    )

    def step(state: Column, _: Column) -> Column:
        k = ((state["k"].cast("decimal(20,0)") * F.lit(str(STEP)).cast("decimal(19,0)")).cast("decimal(38,0)") + F.lit("1").cast("decimal(38,0)")).cast("decimal(38,0)") % F.lit(str(WRAP)).cast("decimal(38,0)")
        k = k.cast("decimal(38,0)")
        top = F.floor(k / F.lit("8589934592").cast("decimal(11,0)")).cast("long")
        j = F.floor((state["j"] + 1).cast("double") * (F.lit(float(2**31)) / (top + 1).cast("double"))).cast("long")
        moved = F.struct(k.alias("k"), j.alias("j"), F.when(j < shards, j).otherwise(state["small"]).alias("small"), F.when(j < shards + more, j).otherwise(state["large"]).alias("large"))
        return F.when(state["j"] >= shards + more, state).otherwise(moved)

    end = F.aggregate(F.sequence(F.lit(1), F.lit(shards + more)), start, step)
    return F.struct(end["small"].cast("int").alias("shard"), end["large"].cast("int").alias("grown"))


def stable_key(docs: DataFrame, doc_id: str) -> Column:
    """The long that decides a row's shard: the id, or a hash of its text form if it is no whole number."""
    kind = docs.select(doc_id).schema[0].dataType
    key = F.col(doc_id).cast("long") if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) else F.xxhash64(F.col(doc_id).cast("string"))
    return F.when(F.col(doc_id).isNull(), F.lit(-1)).otherwise(key).cast("long")


def place(docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: size in bytes, text checksum, shard, slot, and the shard with one more shard."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 8).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        jump(stable_key(docs, doc_id), shards, 1).alias("_jump"),
        F.md5(F.concat_ws(":", F.col(doc_id).cast("string"), F.crc32(body).cast("string"), F.octet_length(body).cast("string")).cast("binary")).alias("_md5"),
        F.lit(1).alias("_one"),
    )
    rows = settle(rows.select("doc_id", "size", "text_crc32", F.col("_jump.shard").alias("shard"), F.col("_jump.grown").alias("grown_shard"), "_md5", "_one"))
    counts = F.broadcast(rows.groupBy("shard").agg(F.count(F.lit(1)).alias("_n")))  # one row a shard
    bucketed = rows.join(counts, "shard").withColumn("_bucket", F.floor(hex_prefix(F.col("_md5"), 8) * F.ceil(F.col("_n") / BUCKET_ROWS) / float(2**32)))
    numbered = running_total(bucketed, ["shard"], "_bucket", [F.col("_md5"), F.col("text_crc32"), F.col("size")], "_one", "slot")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def with_shards(docs: DataFrame, shards: int = 24, doc_id: str = "doc_id") -> DataFrame:
    """The documents with their shard, without any shuffle."""
    return unboxed(boxed(docs, jump(stable_key(docs, doc_id), shards)["shard"].alias("_shard")), F.col("_shard").alias("shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op9_sharding``: all documents into 24 shards."""
    return place(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
codes AS (SELECT list(list_reduce(range(8), lambda c, _: xor(c >> 1, 3988292384 * (c & 1)), CAST(i AS BIGINT)) ORDER BY i) AS codes FROM range(256) u(i)),
jump(r, k, j) AS (
  SELECT r, CASE WHEN doc_id IS NULL THEN 18446744073709551615 WHEN doc_id < 0 THEN CAST(doc_id AS HUGEINT) + 18446744073709551616 ELSE CAST(doc_id AS HUGEINT) END, CAST(0 AS BIGINT) FROM doc
  UNION ALL
  SELECT r, n, CAST(floor(CAST(j + 1 AS DOUBLE) * (CAST(2147483648 AS DOUBLE) / CAST(n // 8589934592 + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT r, j, (k * 2862933555777941757 + 1) % 18446744073709551616 AS n FROM jump WHERE j < 25)
), shards AS (SELECT r, CAST(max(j) FILTER (j < 24) AS INT) AS shard, CAST(max(j) FILTER (j < 25) AS INT) AS grown_shard FROM jump GROUP BY r),
sums AS (
  SELECT r, doc_id, CAST(octet_length(encode(t)) AS BIGINT) AS n,
         xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: CAST('0x' || x AS BIGINT)), lambda c, b: xor(codes[(xor(c, b) & 255) + 1], c >> 8), 4294967295)) AS crc
  FROM doc, codes
), placed AS (SELECT *, md5(concat_ws(':', CAST(doc_id AS VARCHAR), CAST(crc AS VARCHAR), CAST(n AS VARCHAR))) AS digest FROM sums JOIN shards USING (r))
SELECT doc_id, n + 8 AS size, CAST(crc AS BIGINT) AS text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY digest, crc, n) - 1 AS slot, grown_shard
FROM placed
"""
