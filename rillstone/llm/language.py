"""Language identification: Bayesian fusion of a text likelihood with declared language, address suffix and host prior.

Character trigrams of all labelled documents are counted per language (partial counts in each task, summed by a grouped
aggregation) into a table of a fixed number of slots. A page's visible text gets one log-likelihood per language from it;
trigrams of one text are far from independent, so their evidence counts as that of ``EFFECTIVE`` trigrams at most. The
likelihoods alone give soft language counts; grouped aggregations of those over all pages say how far a declared
language and an address suffix can be trusted, and give each host a prior that is smoothed by that of its registered
domain, which is smoothed by that of all pages. A page is taken out of its own prior. The sum of the four is the answer.

Defined cases: null html is empty, and a page without letters is decided by the other evidence; a null or unreadable url
has the empty host and suffix; no declared language is a value of its own; repeated pages are separate rows; texts of any
length are read whole; without labelled documents there are no languages, and ``lang`` and ``confidence`` are null; more
than ``MAX_LANGUAGES`` stated languages are an error; ties go to the first language by code point; an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, table

#: Slots of the trigram table, pseudo-count of a slot, and the trigrams that one text's evidence is worth at most.
SLOTS, PSEUDO, EFFECTIVE = 1 << 16, 0.5, 40.0
#: Pseudo-counts behind a host's prior (from its domain), a domain's (from all pages), and a declared value or suffix.
HOST_WEIGHT, DOMAIN_WEIGHT, CHANNEL_WEIGHT = 4.0, 8.0, 2.0
#: Most languages: each costs the driver and every task half a megabyte.
MAX_LANGUAGES = 512
#: Labels under which a country's registry sells names, as in example.co.uk.
SECOND_LEVEL = "ac co com edu gob gov gub ltd mil net nic nom or org ne go plc sch".split()
#: Hosts up to this number are broadcast; more are joined by a shuffle, whose hot partitions adaptive execution splits.
MAX_BROADCAST_HOSTS = 100_000


def trigram_slots(text: str) -> np.ndarray:
    """Slot of each trigram of letters and single blanks; other characters count as blanks."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    letter = ((points >= 97) & (points <= 122)) | (points >= 192)
    points = np.where(letter, points, np.uint64(32))
    if len(points):
        points = points[letter | np.concatenate(([True], letter[:-1]))]
    points = np.concatenate((np.full(1, 32, np.uint64), points, np.full(1, 32, np.uint64)))
    mixed = points[:-2] * np.uint64(0x9E3779B1) + points[1:-1] * np.uint64(0x85EBCA77) + points[2:] * np.uint64(0xC2B2AE3D)
    return (((mixed ^ (mixed >> np.uint64(15))) * np.uint64(0x27D4EB2F)) >> np.uint64(9)) % np.uint64(SLOTS) if len(points) > 3 else np.zeros(0, np.uint64)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            have = counts.setdefault(lang, np.zeros(SLOTS, np.int64))
            slots = trigram_slots(text)
            if len(slots) * 8 < SLOTS:
                np.add.at(have, slots.astype(np.int64), 1)
            else:
                have += np.bincount(slots.astype(np.int64), minlength=SLOTS)
    for lang, have in counts.items():
        at = np.flatnonzero(have)
        yield pd.DataFrame({"lang": lang, "slot": at.astype(np.int64), "n": have[at]})


def fit(docs: DataFrame, lang: str = "lang", text: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages in order, and log-probabilities (language, slot), from all documents that state a language.

    At most ``SLOTS`` sums a language reach the driver, however many documents there are.
    """
    labelled = docs.select(F.col(lang).cast("string").alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("lang is not null")
    sums = labelled.mapInPandas(_count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(sums["lang"].unique())
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"{len(langs)} languages are stated, more than the {MAX_LANGUAGES} that fit in memory; map them to fewer")
    counts = np.full((len(langs), SLOTS), PSEUDO)
    counts[sums["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int), sums["slot"].to_numpy(int)] += sums["n"].to_numpy(float)
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def visible_text(html: Column) -> Column:
    """The page without comments, scripts, styles, tags and character references."""
    body = F.coalesce(html, F.lit(""))
    for pattern in (r"(?s)<!--.*?-->", r"(?is)<(script|style)\b.*?</\1\s*>", r"<[^>]*>", r"&#?[A-Za-z0-9]{1,31};"):
        body = F.regexp_replace(body, pattern, " ")
    return body


def declared_language(html: Column) -> Column:
    """First part of the language that the markup states, in lower case; empty if it states none."""
    head = F.regexp_extract(F.coalesce(html, F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,8})", 1)
    meta = F.regexp_extract(F.coalesce(html, F.lit("")), r"(?i)<meta\b[^>]*?content-language[^>]*?content\s*=\s*[\"']?([A-Za-z]{2,8})", 1)
    return F.lower(F.when(head != "", head).otherwise(meta))


def host_of(url: Column) -> Column:
    """Host name in lower case, without user and port."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def registered_domain(host: Column) -> Column:
    """The last two labels of a host, or three if the last two are a country's registry label and its code."""
    under = rf"([^.]+\.(?:{'|'.join(SECOND_LEVEL)})\.[a-z]{{2}})$"
    long = F.regexp_extract(host, under, 1)
    return F.when(long != "", long).otherwise(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1))


def text_evidence(pages: DataFrame, langs: list[str], table_: np.ndarray, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A slim row for each page: the addresses, the declared language and one log-likelihood a language."""
    shared = pages.sparkSession.sparkContext.broadcast(table_)  # languages x SLOTS

    @F.pandas_udf("array<double>")
    def likelihoods(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            slots = trigram_slots(text)
            n = len(slots)
            out.append((shared.value[:, slots.astype(np.int64)].sum(axis=1, dtype=np.float64) * (min(n, EFFECTIVE) / n) if n else np.zeros(len(shared.value))).tolist())
        return pd.Series(out)

    host = host_of(F.col(url))
    return pages.select(
        F.col(page_id).alias("page_id"),
        F.col(url).alias("url"),
        host.alias("host"),
        registered_domain(host).alias("domain"),
        F.regexp_extract(host, r"\.([^.]+)$", 1).alias("suffix"),
        declared_language(F.col(html)).alias("declared"),
        likelihoods(visible_text(F.col(html))).alias("text_ll"),
    )


def normalised(scores: Column) -> Column:
    """Probabilities of an array of log scores."""
    shifted = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    return F.transform(shifted, lambda x: x / F.aggregate(shifted, F.lit(0.0), lambda a, b: a + b))


def soft_counts(rows: DataFrame, keys: list[str], n: int, name: str) -> DataFrame:
    """Sums of the probabilities ``p`` by key, as one array column; combined before the shuffle."""
    return rows.groupBy(*keys).agg(F.array(*[F.sum(F.col("p")[i]) for i in range(n)]).alias(name))


def fuse(evidence: DataFrame, langs: list[str]) -> DataFrame:
    """The language of each page, from ``text_evidence``."""
    if not langs:
        none = F.lit(None).cast("string")
        return evidence.select("page_id", "url", "host", "declared", none.alias("text_lang"), none.alias("lang"), F.lit(None).cast("double").alias("confidence"))
    n, names = len(langs), F.array(*[F.lit(x) for x in langs])
    rows = settle(evidence.withColumn("p", normalised(F.col("text_ll"))))
    everything = soft_counts(rows, [], n, "all_n").first()["all_n"]
    everything = [x or 0.0 for x in everything]
    total = sum(everything)
    base = F.array(*[F.lit((x + 1.0) / (total + n)) for x in everything])
    totals = F.array(*[F.lit(x) for x in everything])
    declared, suffix, domain = (soft_counts(rows, [k], n, f"{k}_n") for k in ("declared", "suffix", "domain"))
    host = soft_counts(rows, ["host", "domain"], n, "host_n").join(domain, "domain").drop("domain")
    host = F.broadcast(host) if host.count() <= MAX_BROADCAST_HOSTS else host
    # values of a declaration are at most those of an eight-letter code, suffixes those of the root zone: joined, not broadcast, if many
    joined = rows.join(host, "host").join(declared, "declared").join(suffix, "suffix")
    size = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    at = lambda a, i: F.get(a, i)
    others = lambda a, i: F.greatest(at(F.col(a), i) - at(F.col("p"), i), F.lit(0.0))
    in_domain = lambda i: (others("domain_n", i) + DOMAIN_WEIGHT * at(base, i)) / (F.greatest(size(F.col("domain_n")) - 1, F.lit(0.0)) + DOMAIN_WEIGHT)
    prior = lambda i: (others("host_n", i) + HOST_WEIGHT * in_domain(i)) / (F.greatest(size(F.col("host_n")) - 1, F.lit(0.0)) + HOST_WEIGHT)
    # P(value | language) up to a factor that all languages share: the value's share of the language's pages, smoothed by its share of all
    given = lambda a, i: (others(a, i) + CHANNEL_WEIGHT * size(F.col(a)) / max(total, 1.0)) / (at(totals, i) + CHANNEL_WEIGHT)
    score = F.transform("text_ll", lambda ll, i: ll + F.log(prior(i)) + F.log(given("declared_n", i)) + F.log(given("suffix_n", i)))
    best = lambda a: F.get(names, F.array_position(a, F.array_max(a)).cast("int") - 1)
    fused = joined.select("page_id", "url", "host", "declared", best(F.col("p")).alias("text_lang"), normalised(score).alias("q"))
    return fused.select("page_id", "url", "host", "declared", "text_lang", best(F.col("q")).alias("lang"), F.array_max("q").alias("confidence"))


def identify(pages: DataFrame, docs: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """For each page: host, declared language, language by text alone, fused language and its probability."""
    langs, logs = fit(docs)
    return fuse(text_evidence(pages, langs, logs, page_id, url, html), langs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op2_language``: all pages, with likelihoods from all documents."""
    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))
