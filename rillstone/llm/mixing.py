"""Mixing sources to target weights by Efraimidis-Spirakis sampling; DataFrame functions only.

Every source gets a share of all words by its weight, at most ``max_epochs`` times its own size; what a capped source
leaves is shared again by weight. A source takes whole epochs of its documents first. The rest of its budget goes to
documents in the order of an exponential key, -ln(u) / quality weight, so that better documents are likelier to come
early; running totals of the words in that order end exactly at the budget, and the document on the border gives its
first words only (``apply_mix`` joins them by single spaces). The number u is made of the digest of id and text.

Defined cases: null text has size 0 and takes 0; a null source is a source of its own, last in order; a null id is
the empty string for the random number; rows alike in id and text are separate rows that draw the same number (they are
interchangeable, and the only ones that must meet in one task); texts of any length are only split into words; an empty
table gives an empty result; ``mix`` looks at id, text and source only, ``apply_mix`` keeps all columns whatever their
names, and sets ``n_chars`` if there is one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blank_words, hex_prefix, running_total, settle, table, unboxed

#: About so many rows are sorted together; a source has as many buckets as it has rows over this.
BUCKET_ROWS = 512
#: The table of targets (one row a source) is broadcast up to this many sources; beyond, it is joined by a shuffle.
MAX_BROADCAST_SOURCES = 100_000


def diversity_weight(words: Column) -> Column:
    """Quality weight in (0, 1]: a twentieth, and the share of a document's words that are distinct."""
    n = F.size(words)
    return F.when(n == 0, F.lit(1.0)).otherwise(0.05 + 0.95 * (F.size(F.array_distinct(words)) / n))


def draws(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", quality: Column | None = None, carry: bool = False) -> DataFrame:
    """A row for each document: id, source, size in words, exponential key; ``_g`` is the source without nulls.

    ``quality`` is a positive weight, else the share of distinct words. If ``carry``, the whole row comes along as ``_doc``.
    """
    drawn = F.md5(F.concat_ws("\x1f", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))).cast("binary"))
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")] * carry
    words = docs.select(
        *whole,
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        ((hex_prefix(drawn, 13) + 0.5) / float(2**52)).alias("_u"),
        F.xxhash64(F.col(text)).alias("_h"),
        blank_words(F.col(text)).alias("_words"),
        (F.lit(None).cast("double") if quality is None else quality).alias("_q"),
    )
    weight = F.coalesce("_q", diversity_weight(F.col("_words")))
    return words.select(
        *["_doc"] * carry,
        "doc_id",
        "source",
        F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source"))).alias("_g"),
        F.size("_words").cast("long").alias("size"),
        (-F.log("_u") / weight).alias("_key"),
        weight.alias("_w"),
        "_h",
    )


def targets(slim: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """One row for each source: its size, weight and target.

    With sources in the order of cap / weight, the level (all words - caps before) / (weights from here) rises while
    sources are capped and falls after, so its highest value is the level at which the shares add up. This table has one
    row a source and is the only thing that is sorted as a whole.
    """
    sources = slim.groupBy("_g", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_n"), F.sum(F.floor(F.col("_w") * 1000)).alias("_w1000"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    weighed = sources.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int")))
    cap = F.col("source_size") * max_epochs
    by_level = Window.orderBy(cap / F.col("weight"), "_g")
    every = Window.partitionBy()
    levels = weighed.withColumns(
        {
            "_left": F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "_over": F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    best = F.max_by(F.struct("_left", "_over"), F.col("_left") / F.col("_over")).over(every)
    share = (F.col("weight") * F.col("_best._left")).cast("double") / F.col("_best._over")
    return levels.withColumn("_best", best).select("_g", "source_size", "_n", "_w1000", F.least(cap.cast("double"), share).alias("target"))


def _placed(rows: DataFrame, slim: DataFrame, goals: DataFrame) -> DataFrame:
    """The drawn rows with ``taken``; ``slim`` has the same rows without what they carry, and is read for the sums."""
    bucket = F.floor((1 - F.exp(-F.col("_key") * F.col("_w1000") / (F.col("_n") * 1000.0))) * F.ceil(F.col("_n") / BUCKET_ROWS))
    goals = F.broadcast(goals) if goals.count() <= MAX_BROADCAST_SOURCES else goals
    # dealt by source and bucket: else the windows take over a join's dealing by source, and a hot source is one task
    dealt = rows.join(goals, "_g").withColumn("_bucket", bucket).repartition("_g", "_bucket")
    sums = None if rows is slim else slim.join(goals, "_g").select("_g", bucket.alias("_bucket"), "size")
    placed = running_total(dealt, ["_g"], "_bucket", [F.col("_key"), F.col("doc_id"), F.col("size"), F.col("_h")], "size", "_before", sums)
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.expr("floor(target + 0.5) div source_size"))
    rest = budget - F.col("_epochs") * F.col("source_size")
    taken = F.col("_epochs") * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0), rest - F.col("_before")))
    return placed.withColumn("_epochs", epochs).withColumn("taken", taken.cast("long"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3, quality: Column | None = None) -> DataFrame:
    """For each document: size, its source's size and target, and ``taken``, the words the mix takes of it (repeats counted)."""
    slim = settle(draws(docs, doc_id, text, source, quality))
    goals = settle(targets(slim, weights, max_epochs))
    return _placed(slim, slim, goals).select("doc_id", "size", "source_size", "target", "taken")


def apply_mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3, quality: Column | None = None) -> DataFrame:
    """The documents as the mix takes them: a row for each whole epoch, and one with the first words of a partial one.

    Whole rows are shuffled once, to their source's bucket, where each is decided; nothing is joined back by id.
    """
    slim = settle(draws(docs, doc_id, text, source, quality))
    goals = settle(targets(slim, weights, max_epochs))
    placed = _placed(draws(docs, doc_id, text, source, quality, carry=True), slim, goals).where("taken > 0")
    copies = F.expr("transform(sequence(1, cast(ceil(taken / size) as int)), i -> i > taken div size)")
    body = F.col(f"_doc.`{text}`")
    cut = F.array_join(F.slice(blank_words(body), 1, F.expr("cast(taken % size as int)")), " ")
    shown = placed.select("_doc", "taken", "size", F.explode(copies).alias("_cut")).withColumn("_text", F.when(F.col("_cut"), cut).otherwise(body))
    length = [F.length("_text").cast(docs.schema["n_chars"].dataType).alias("n_chars")] if "n_chars" in docs.columns else []
    return unboxed(shown, F.col("_text").alias(text), *length)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op7_mixing``: the mix over all documents."""
    return mix(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH words AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), slim AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS size,
         CASE WHEN len(w) = 0 THEN 1.0 ELSE 0.05 + 0.95 * (CAST(len(list_distinct(w)) AS DOUBLE) / len(w)) END AS weight,
         (CAST(('0x' || substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), chr(31), t)), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0 AS u
  FROM words
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight
  FROM slim GROUP BY source
), levels AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
         sum(weight) OVER (ORDER BY 3 * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ovr
  FROM sources
), best AS (
  SELECT arg_max(lft, lft::DOUBLE / ovr) AS lft, arg_max(ovr, lft::DOUBLE / ovr) AS ovr FROM levels
), goals AS (
  SELECT l.source, l.source_size, least(CAST(3 * l.source_size AS DOUBLE), CAST(l.weight * b.lft AS DOUBLE) / CAST(b.ovr AS DOUBLE)) AS target
  FROM levels l, best b
), placed AS (
  SELECT s.doc_id, s.size, g.source_size, g.target,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY -ln(s.u) / s.weight, s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM slim s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
), budget AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS b,
         CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target + 0.5) AS BIGINT) // source_size END AS e FROM placed
)
SELECT doc_id, size, source_size, target,
       CAST(e * size + least(size, greatest(0, b - e * source_size - before)) AS BIGINT) AS taken
FROM budget
"""
