"""Helpers that several corpus operators share. Everything here is a DataFrame or a Column; no Python runs on executors."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The six white-space characters of the word rules, and the two ASCII alphabets for case folding.
BLANKS = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables in a data folder; the folder may be in any store Spark can read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and go on from those files.

    The folder is the session's ``spark.checkpoint.dir``; one of our own is set only where none is (tests, a laptop).
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables; set once a session. A cluster must name one, since its machines share no other."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: later steps read only the columns they need."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table that ``written`` made, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def boxed(docs: DataFrame, *columns: Column) -> DataFrame:
    """The rows as one struct ``_doc`` beside columns of our own, whose names can't clash with theirs; ``unboxed`` opens it."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), *columns)


def unboxed(rows: DataFrame, *columns: Column) -> DataFrame:
    """The rows of ``boxed`` with their own columns, and further ones; one of these replaces a column of the same name."""
    own = rows.select("_doc.*").columns
    if not columns:
        return rows.select(*[F.col(f"_doc.`{c}`") for c in own])
    # ours go into a struct first: beside the documents' columns a name in them could mean either
    both = rows.select("_doc", F.struct(*columns).alias("_ours"))
    ours = both.select("_ours.*").columns
    return both.select(*[F.col(f"_ours.`{c}`" if c in ours else f"_doc.`{c}`") for c in own], *[F.col(f"_ours.`{c}`") for c in ours if c not in own])


def row_keys(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """Two non-null longs that rows with the same id and text share, and no others (but for a collision of both hashes)."""
    return F.xxhash64(doc_id.cast("string"), doc_id.isNull()), F.xxhash64(text, text.isNull())


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def blank_words(text: Column) -> Column:
    """The maximal runs without white space (space, tab to carriage return), in order; null text has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def in_training_part(doc_id: Column) -> Column:
    """False for the third of the documents that is held out of every fit (crc32 of the id as text, modulo 3, is 1)."""
    return ~held_out(doc_id)


def held_out(doc_id: Column) -> Column:
    """The part whose labels no fit reads; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def hex_prefix(digest: Column, digits: int) -> Column:
    """The first hex digits of a digest as a long."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def running_total(rows: DataFrame, group: Sequence[str], bucket: str, order: Sequence[Column], value: str, out: str, slim: DataFrame | None = None) -> DataFrame:
    """``rows`` with the exclusive running total of ``value`` in each group, as column ``out``.

    ``bucket`` must not fall along ``order`` inside a group. A group is summed bucket by bucket first, the sums of a group's
    buckets are accumulated, and rows are only sorted inside their bucket, so a group with most of the rows is spread over
    as many tasks as it has buckets. ``rows`` is read twice: settle it if it is costly, or give the sums' columns as ``slim``.
    """
    keys = [*group, bucket]
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = (rows if slim is None else slim).groupBy(*keys).agg(F.sum(value).alias("_sum"))
    offsets = sums.select(*keys, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(offsets, keys)
    return joined.withColumn(out, F.col("_offset") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_offset")
