"""Personal data: four checked base patterns, and bootstrapped contextual extraction on top; DataFrame functions only.

Base spans (e-mail, IP address, payment card, phone) come from regular expressions and a check each. Their occurrences, and
runs of 32 and more mixed letters and digits (kind ``secret``), are seeds: the words before a seed, with the signs between,
are lexical patterns. A graph ties patterns to the distinct instances they precede, where other identifier-like tokens are
instances of no kind yet. In each round grouped aggregations score patterns by how many of the instances whose kind is known
are of one kind (short numbers are known to be of none; what is not known yet counts neither way), and instances by their
patterns. Instances above the threshold are trusted in the next round, so they can raise patterns that no seed follows;
rounds end when nothing new is found. Instances found, and secrets, are added as spans; base spans stay as they are.

Defined cases: null text is empty; offsets are in code points, the end exclusive; rows with the same id stay separate
rows; an empty table gives an empty result; a text of any length is searched whole, in time linear in its length but for
its matches; a token that overlaps a base span is not looked at; a pattern's words are looked for in the ``CONTEXT``
characters before a token; if ``ROUNDS`` rounds don't reach the end, the last one's finds are kept; other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, table

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. A look-behind (or the end of the last match) keeps a search from starting again inside a run that
#: has failed, and possessive repetition from trying shorter runs; neither changes what is found.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Identifier-like tokens, between blanks, quotes or brackets: groups of digits set apart by single blanks, or a run of
#: letters, digits and signs with a digit or an at sign. The possessive parts keep a failed run from being tried again.
TOKEN = r"(?<![^\s\"'(<\[=:,;|])(?:\(?[0-9][0-9().+/-]*+(?: \(?[0-9][0-9().+/-]*+)++|[A-Za-z._%+#/-]*+[0-9@][A-Za-z0-9._%+#@/-]*+)"
#: Shorter tokens are plain numbers: known to be no identifier.
SHORTEST = 6
#: Seeds of a kind that has no base pattern: long runs of letters and digits mixed.
SECRET = r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_+/-]{32,}$"
#: One or two words before an occurrence, with up to eight signs between.
BEFORE = (r"(\p{L}+[^\p{L}]{0,8})$", r"(\p{L}+\s+\p{L}+[^\p{L}]{0,8})$")
CONTEXT = 48
#: Trusted instances that a pattern needs, doubt added to them, confidence that adds an instance, and most rounds.
MIN_TRUSTED, DOUBT, THRESHOLD, ROUNDS = 5, 1.0, 0.8, 12


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)  # a function of two would get the index too


def running_sums(lengths: Column, step: int = 256) -> Column:
    """Sum of all items before each item; in blocks, so that long arrays don't cost their square."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    n = F.size(lengths)
    many = F.sequence(F.lit(0), F.floor((n - 1) / step).cast("int"))
    sums = F.transform(many, lambda b: total(F.slice(lengths, b * step + 1, step)))
    before = let(sums, lambda s: F.transform(many, lambda b: total(F.slice(s, F.lit(1), b))))
    at = lambda i: F.floor(i / step).cast("int")
    return let(before, lambda o: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(o, at(i) + 1) + total(F.slice(lengths, at(i) * step + 1, i % step))))


def located(text: Column, pattern: str) -> Column:
    """Array of (start, end, match) of the leftmost non-overlapping matches.

    What lies between the matches gives their places: both lists together spell the text.
    """
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")

    def place(found: Column) -> Column:
        m, gaps = found["m"], found["g"]
        whole = F.transform(m, lambda x, i: F.length(x) + F.length(F.get(gaps, i)))

        def spans(sums: Column) -> Column:
            first = lambda i: F.get(sums, i) + F.length(F.get(gaps, i))
            return F.transform(m, lambda x, i: F.struct(first(i).alias("start"), (first(i) + F.length(x)).alias("end"), x.alias("match")))

        return F.when(F.size(m) == 0, none).otherwise(let(let(whole, running_sums), spans))

    return let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g")), place)


def passes(kind: str, match: Column) -> Column:
    """The check of a base match."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        part = lambda p: let(F.ltrim(p, F.lit("0")), lambda s: (F.length(s) <= 3) & (F.lpad(s, 3, "0") <= "255"))
        return F.forall(F.split(match, r"\."), part)
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def checked_spans(text: Column, no: int, kind: str) -> Column:
    """Array of (start, no, end, kind, match) of a kind's matches that pass its check."""
    good = F.filter(located(text, PATTERNS[kind]), lambda s: passes(kind, s["match"]))
    return F.transform(good, lambda s: F.struct(s["start"].alias("start"), F.lit(no).alias("no"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["match"].alias("match")))


def of_kind(spans: Column, kind: str) -> Column:
    """Number of the spans of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def found_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document: base spans by start and kind, and the other identifier-like tokens, each with its context."""
    body = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    digits = F.col("_t").rlike("[0-9]")
    guards = {"email": F.contains("_t", F.lit("@")), "ip": digits, "card": digits, "phone": F.contains("_t", F.lit("+")) & digits}
    none = F.array().cast("array<struct<start:int,no:int,end:int,kind:string,match:string>>")
    arrays = {}
    for no, kind in enumerate(KINDS):
        arrays[f"_{kind}"] = F.when(guards[kind], checked_spans(F.col("_t"), no, kind)).otherwise(none)
    tokens = F.when(digits | guards["email"], located(F.col("_t"), TOKEN)).otherwise(F.array().cast("array<struct<start:int,end:int,match:string>>"))
    based = body.withColumns(arrays).withColumn("_tokens", tokens)
    based = based.select("_row", "doc_id", "_t", F.array_sort(F.concat(*arrays)).alias("base"), "_tokens")
    ahead = lambda s: F.lower(F.substring("_t", F.greatest(s["start"] - CONTEXT, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT))))
    apart = F.filter("_tokens", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return based.select(
        "_row",
        "doc_id",
        F.transform("base", lambda s: F.struct(s["start"], s["end"], s["kind"], s["match"], s["no"], ahead(s).alias("ahead"))).alias("base"),
        F.transform(apart, lambda s: F.struct(s["start"], s["end"], s["match"], ahead(s).alias("ahead"))).alias("others"),
    )


def graph(spans: DataFrame) -> DataFrame:
    """Edges of the bootstrap: (instance, kind if it is known, pattern), each once; short numbers are of the kind ``plain``."""
    token = F.col("s.match")
    seeds = spans.select(F.explode("base").alias("s")).select(token.alias("instance"), F.col("s.kind").alias("seed"), F.col("s.ahead").alias("ahead"))
    known = F.when(F.length(token) < SHORTEST, F.lit("plain")).when(token.rlike(SECRET), F.lit("secret"))
    others = spans.select(F.explode("others").alias("s")).select(token.alias("instance"), known.alias("seed"), F.col("s.ahead").alias("ahead"))
    patterns = F.explode(F.array(*[F.regexp_extract("ahead", p, 1) for p in BEFORE]))
    return seeds.unionAll(others).select("instance", "seed", patterns.alias("pattern")).where("pattern <> ''").distinct()


def discover(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(instance, kind) of the instances of no known kind that end above the threshold.

    All aggregations combine on the map side, so a pattern that precedes a large share of all instances is no burden to one
    task. A round is two grouped aggregations over the edges; it adds to what is trusted, and an instance keeps its kind.
    """
    edges = settle(edges)
    known = edges.where("seed is not null").select("pattern", F.col("seed").alias("kind"), F.lit(1.0).alias("sure"))
    open_ = edges.where("seed is null").select("instance", "pattern")
    found, n = None, 0
    for _ in range(rounds):
        trusted = known if found is None else known.unionByName(open_.join(found, "instance").select("pattern", "kind", "sure"))
        by_kind = trusted.groupBy("pattern").pivot("kind", [*KINDS, "secret", "plain"]).agg(F.sum("sure"))
        hits = {k: F.coalesce(F.col(k), F.lit(0.0)) for k in (*KINDS, "secret")}
        total = sum(hits.values()) + F.coalesce("plain", F.lit(0.0)) + DOUBT
        best = F.array_max(F.array(*[F.struct(h.alias("hits"), F.lit(k).alias("kind")) for k, h in hits.items()]))
        sure = by_kind.select("pattern", best.alias("best"), total.alias("total")).where(F.col("best.hits") >= MIN_TRUSTED - 1e-9)
        sure = sure.select("pattern", F.col("best.kind").alias("kind"), (F.col("best.hits") / F.col("total")).alias("p")).where("p >= 0.5")
        met = open_.join(sure, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("p"), F.lit(1e-6)))))).alias("sure"))
        fresh = met.where(F.col("sure") >= THRESHOLD).groupBy("instance").agg(F.max_by("kind", F.struct("sure", "kind")).alias("kind"), F.max("sure").alias("sure"))
        found = settle(fresh if found is None else found.unionByName(fresh.join(found, "instance", "left_anti")))
        before, n = n, found.count()
        if n == before:
            break
    return found.select("instance", "kind")


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """For each document: numbers of base spans by kind, their digest, and all spans; ``n_found`` counts the added ones."""
    spans = settle(found_spans(docs, doc_id, text))
    added = discover(graph(spans), rounds)
    kind_no = F.array_position(F.array(*[F.lit(k) for k in (*KINDS, "secret")]), F.col("kind")).cast("int") - 1
    tokens = spans.select("_row", F.explode("others").alias("s")).where(F.length("s.match") >= SHORTEST)
    secrets = tokens.where(F.col("s.match").rlike(SECRET)).withColumn("kind", F.lit("secret"))
    where = tokens.join(added, F.col("s.match") == F.col("instance")).drop("instance").unionByName(secrets)
    extra = where.groupBy("_row").agg(F.collect_list(F.struct(F.col("s.start").alias("start"), kind_no.alias("no"), F.col("s.end").alias("end"), F.col("kind").alias("kind"))).alias("extra"))
    base = F.transform("base", lambda s: F.struct(s["start"], s["no"], s["end"], s["kind"]))
    joined = spans.join(extra, "_row", "left").withColumn("_base", base).withColumn("extra", F.coalesce("extra", F.array().cast("array<struct<start:int,no:int,end:int,kind:string>>")))
    counts = [of_kind(F.col("_base"), k).alias(f"n_{k}") for k in KINDS]
    return joined.select(
        "doc_id",
        *counts,
        F.sha2(listed(F.col("_base")).cast("binary"), 256).alias("base_sha256"),
        listed(F.array_sort(F.concat("_base", "extra"))).alias("spans"),
        F.size("extra").cast("long").alias("n_found"),
        (F.size("_base") + F.size("extra")).cast("long").alias("n_private"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op3_personal_data``: all documents."""
    return report(table(spark, sf_dir, "documents"))
