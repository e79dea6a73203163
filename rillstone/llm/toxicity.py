"""Toxicity: noisy-channel restoration of disguised words, then a score of the restored text.

A character language model (trigram counts over the letters of all documents) is the source model. Disguise is the
channel: digits and symbols for letters, letters drawn out, separators between letters, starred-out letters. Each odd
token, and each run of single characters set apart, is a lattice of readings that a Viterbi search decodes; a plain word
has one reading. Restored words and their stems are weighed by a lexicon learned from labelled rows, and a logistic
curve over a document's weights gives the score.

Defined cases: null text is empty; a text without words is scored from its (zero) weights; tokens, runs and texts of any
length are decoded whole; rows with the same text are scored alike, whatever their ids; without toxic and clean training
rows every score is the share of label 1 (0 without labels); an empty table gives an empty result; ``scored`` keeps the
columns it is asked to, whatever their names (it replaces one named ``score`` or ``predicted``).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, in_training_part, table

#: Labelled rows that a fit reads at most, those with the smallest hash of the id.
MAX_LABELLED = 12_000
#: A lexicon entry needs this share of toxic documents, and this log-likelihood over the base rate.
MIN_SHARE, MIN_EVIDENCE = 0.7, 16.0
STEMS = range(4, 9)
#: Letter classes of the language model: 0 is no letter, 1 to 26 are a to z, 27 is any other letter.
CLASSES = 28

# Letters that digits and symbols stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c"}
SWAP, DROP, DROP_LINK, WILD, SHORTEN, HALVE, SPLIT = 0.7, 8.0, 0.3, 3.0, 1.0, 3.0, 2.5
LINKS = "-._*~'"
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
EDGE_NOISE = "".join(c for c in EDGES if c not in LEET and c != "*")
RUN = re.compile(r"(?<!\S)(?:\S[ ._*-]){2,}\S(?!\S)")
DRAWN = re.compile(r"(\w)\1\1")
#: Repeats have the same readings from three on; of stars each may be a letter, and longer rows of stars are read as this many.
REPEATS, STARS, LONGEST = re.compile(r"([^*])\1{3,}"), re.compile(r"\*{41,}"), 40
LETTERS = re.compile(r"[^\W\d_]+")

BYTE_CLASS = np.zeros(256, np.int64)
BYTE_CLASS[ord("a") : ord("z") + 1] = np.arange(1, 27)
BYTE_CLASS[ord("A") : ord("Z") + 1] = np.arange(1, 27)
BYTE_CLASS[0xC0:] = 27


def _class(ch: str) -> int:
    return ord(ch) - 96 if "a" <= ch <= "z" else 27 if ch.isalpha() else 0


def _trigrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(CLASSES**3, np.int64)
    for batch in batches:
        for start in range(0, len(batch), 256):
            raw = np.frombuffer("  ".join(t or "" for t in batch["text"].iloc[start : start + 256]).encode("utf-8", "surrogatepass"), np.uint8)
            c = BYTE_CLASS[raw[(raw & 0xC0) != 0x80]]
            if len(c) > 2:
                total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
    seen = np.flatnonzero(total)
    yield pd.DataFrame({"code": seen, "n": total[seen]})


def language_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Costs (negative log probabilities) of a letter class after two others, from the trigrams of all texts.

    At most 28 * 28 * 28 counts reach the driver, however many documents there are.
    """
    counts = docs.select(F.col(text).alias("text")).mapInPandas(_trigrams, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    tri = np.zeros(CLASSES**3)
    tri[counts["code"].to_numpy(np.int64)] = counts["n"].to_numpy(np.float64)
    tri = tri.reshape(CLASSES, CLASSES, CLASSES)
    bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1))
    p1 = (uni + 1) / (uni.sum() + CLASSES)
    p2 = (bi + 20 * p1) / (bi.sum(axis=1, keepdims=True) + 20)
    p3 = (tri + 5 * p2) / (tri.sum(axis=2, keepdims=True) + 5)
    return -np.log(p3)


def lattice(token: str, spaced: bool, starred: bool = False) -> list[list[tuple[str, float]]]:
    """The readings of each stretch of a token: (letters, cost). If ``starred``, stars are letters rather than links."""
    out: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(token):
        ch, n = token[i], 1
        while ch != "*" and i + n < len(token) and token[i + n] == ch:
            n += 1
        if ch.isalpha():
            out.append([(ch, 0.0)] if n == 1 else [(ch * 2, 0.0), (ch, HALVE)] if n == 2 else [(ch, SHORTEN), (ch * 2, SHORTEN)])
        else:
            read = [(c, SWAP) for c in LEET.get(ch, "")] + ([(c * 2, 2 * SWAP) for c in LEET.get(ch, "")] if n == 2 else [])
            if ch == "*":
                read += [(chr(c), WILD) for c in range(97, 123)]
            out.append(read + [("", DROP_LINK if ch in LINKS and not (starred and ch == "*") else DROP)] + ([(" ", SPLIT)] if not ch.isalnum() else []))
        if spaced:
            out.append([("", 0.0), (" ", SPLIT)])
        i += n
    return out


#: The costs last decoded with, the same as an array, and what follows two classes at best: (cost, letters) by suffix.
_LAST: list = [None, None, {}]
#: A way through the lattice: its cost, and its letters as a chain (way before, letters) that ways share.
Way = tuple[float, tuple | None]


def _spelt(chain: tuple | None) -> str:
    parts = []
    while chain is not None:
        chain, letters = chain
        parts.append(letters)
    return "".join(reversed(parts))


def _advance(states: dict[tuple[int, int], Way], stretches: list, costs: list) -> dict[tuple[int, int], Way]:
    """The cheapest way to each pair of last classes after some more stretches."""
    for readings in stretches:
        following: dict[tuple[int, int], Way] = {}
        if len(readings) > 26:  # any letter: all states at once
            readings = [r for r in readings if r[1] != WILD]
            known = np.full((CLASSES, CLASSES), np.inf)
            for (a, b), (cost, _) in states.items():
                known[a, b] = cost
            ways = known[:, :, None] + _LAST[1][:, :, 1:27]
            came, least = ways.argmin(axis=0).tolist(), (ways.min(axis=0) + WILD).tolist()
            for b in {b for _, b in states}:
                for z in range(26):
                    following[b, z + 1] = (least[b][z], (states[came[b][z], b][1], chr(97 + z)))
        for (a, b), (cost, chain) in states.items():
            for letters, price in readings:
                x, y, c = a, b, cost + price
                for ch in letters:
                    z = _class(ch)
                    c += costs[x][y][z]
                    x, y = y, z
                if (x, y) not in following or c < following[x, y][0]:
                    following[x, y] = (c, (chain, letters) if letters else chain)
        states = following
    return states


def _end(states: dict[tuple[int, int], Way], costs: list) -> Way:
    return min(((c + costs[x][y][0], chain) for (x, y), (c, chain) in states.items()), key=lambda way: way[0])


def decode(token: str, costs: list, spaced: bool = False, starred: bool = False) -> str:
    """The likeliest plain text behind a lower-case token: one Viterbi pass over the last two letter classes, in time
    linear in its length."""
    if _LAST[0] is not costs:
        _LAST[:] = costs, np.array(costs), {}
    letters = len(token)
    while letters and not token[letters - 1].isalpha():
        letters -= 1
    suffix = token[letters:]
    if spaced or "*" not in suffix:
        return _spelt(_end(_advance({(0, 0): (0.0, None)}, lattice(token, spaced, starred), costs), costs)[1])
    # the readings of a suffix with stars depend on the two classes before it only, and the same suffixes come again
    best, ends = [], _LAST[2]
    for (x, y), (c, chain) in _advance({(0, 0): (0.0, None)}, lattice(token[:letters], False, starred), costs).items():
        key = (x, y, suffix, starred)
        if key not in ends:
            if len(ends) > 100_000:
                ends.clear()
            cost, end = _end(_advance({(x, y): (0.0, None)}, lattice(suffix, False, starred), costs), costs)
            ends[key] = cost, _spelt(end)
        best.append((c + ends[key][0], chain, ends[key][1]))
    _, chain, end = min(best, key=lambda way: way[0])
    return _spelt(chain) + end


def restore(token: str, costs: list) -> list[str]:
    """Lower-case words of one token without white space, disguises undone."""
    low = token.lower()
    short = STARS.sub("*" * LONGEST, REPEATS.sub(r"\1\1\1", low))
    core = short.strip(EDGES)
    if not any(c.isalpha() or c in LEET and c.isalnum() for c in short):
        return LETTERS.findall(low)  # signs alone tell no letter from another
    if core.isalpha() and not DRAWN.search(core):
        words = [core]
    elif core and (DRAWN.search(core) or any(c in LEET or c in LINKS for c in core)):
        words = decode(core, costs).split()
        words += LETTERS.findall(low)  # as it stands, too
    else:
        words = LETTERS.findall(low)
    # signs at the ends, and stars, may stand for letters or for nothing: both readings count
    full = short.strip(EDGE_NOISE)
    if full != core or "*" in core:
        words += decode(full, costs, starred=True).split()
    return words


def runs(text: str, costs: list) -> list[str]:
    """Words behind runs of single characters set apart by blanks or links."""
    out = []
    for m in RUN.finditer(text):
        joined = m[0][::2].lower()
        if sum(c.isalpha() or c in LEET for c in joined) * 2 > len(joined):
            out += decode(joined, costs, spaced=True).split()
    return out


def _features(costs: list):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            for at in range(0, len(batch), 200):
                rows = []
                for text, toxic in zip(batch["text"].iloc[at : at + 200], batch["toxic"].iloc[at : at + 200]):
                    found: set[str] = set(runs(text or "", costs))
                    for token in set((text or "").split()):
                        words = known.get(token)
                        if words is None:
                            if len(known) > 300_000:
                                known.clear()
                            words = known[token] = tuple(restore(token, costs))
                        found.update(words)
                    found = {w for w in found if len(w) >= 3}
                    stems = {w[:n] + "*" for w in found for n in STEMS if len(w) > n}
                    # texts with the same words count once
                    sketch = xxhash.xxh64_intdigest(" ".join(sorted(found)).encode("utf-8", "surrogatepass")) >> 1
                    rows.append((sketch, toxic, sorted(found | stems)))
                yield pd.DataFrame(rows, columns=["sketch", "toxic", "features"])

    return run


class Model:
    """Language-model costs, lexicon (words, and stems ending in a star) and logistic coefficients."""

    def __init__(self, costs: np.ndarray, lexicon: dict[str, float], beta: list[float]):
        self.costs, self.lexicon, self.beta = costs.tolist(), lexicon, beta

    def weight(self, words: list[str]) -> float:
        best = 0.0
        for w in words:
            best = max(best, self.lexicon.get(w, 0.0), *(self.lexicon.get(w[:n] + "*", 0.0) for n in STEMS if len(w) > n), 0.0)
        return best

    def measure(self, text: str | None, known: dict[str, float]) -> tuple[float, float, float]:
        """Highest weight, log of the summed weights, log of the number of words."""
        text = text or ""
        tokens = text.split()
        found = [x for x in (self.weight([w]) for w in set(runs(text, self.costs))) if x]
        for token in set(tokens):
            w = known.get(token)
            if w is None:
                if len(known) > 400_000:
                    known.clear()
                w = known[token] = self.weight(restore(token, self.costs))
            if w:
                found.append(w)
        return max(found, default=0.0), math.log1p(sum(found)), math.log1p(len(tokens))


def _measures(model: Model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, float] = {}
        for batch in batches:
            rows = [model.measure(t, known) for t in batch["_t"]]
            yield batch.drop(columns="_t").assign(_x1=[r[0] for r in rows], _x2=[r[1] for r in rows], _x3=[r[2] for r in rows])

    return run


def measured(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, as ``_k0`` and so on, and the three measures of every text."""
    kept = docs.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)], F.col(text).alias("_t"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.drop("_t").schema)
    return kept.mapInPandas(_measures(model), f"{schema}, _x1 double, _x2 double, _x3 double")


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> list[float]:
    """Newton steps for a logistic regression with an intercept."""
    x = np.column_stack([np.ones(len(x)), x])
    beta, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        beta += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ beta)
    return [float(b) for b in beta]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_labelled: int = MAX_LABELLED, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Language model from all documents; lexicon and curve from the labelled training part, up to ``max_labelled`` rows."""
    costs = language_model(docs, text)
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & in_training_part(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).alias("toxic"))
    chosen = F.broadcast(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))  # bounded by the parameter
    sample = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(chosen, "doc_id").select("text", "toxic")
    seen = sample.mapInPandas(_features(costs.tolist()), "sketch long, toxic int, features array<string>").dropDuplicates(["sketch", "toxic"])
    seen = seen.persist()
    try:
        base = {r["toxic"]: r["n"] for r in seen.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
        t, c = base.get(1, 0), base.get(0, 0)
        if not t or not c:
            share = min(max(t / (t + c) if t + c else 0.0, 1e-6), 1 - 1e-6)
            return Model(costs, {}, [math.log(share / (1 - share)), 0.0, 0.0, 0.0])
        counts = seen.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
        rate, share = t / (t + c), F.col("t") / (F.col("t") + F.col("c"))
        evidence = F.col("t") * F.log(share / rate) + F.when(F.col("c") > 0, F.col("c") * F.log((1 - share) / (1 - rate))).otherwise(0.0)
        odds = F.log((F.col("t") + 0.2) / (t + 0.4)) - F.log((F.col("c") + 0.2) / (c + 0.4))
        entries = counts.where((share >= MIN_SHARE) & (F.col("t") >= 4)).where(evidence >= MIN_EVIDENCE).select("feature", odds.alias("w")).collect()  # at most max_labelled / 4 times a document's words
    finally:
        seen.unpersist()
    model = Model(costs, {r["feature"]: r["w"] for r in entries}, [])
    values = [F.col(c) for c in ("_k0", "_x1", "_x2", "_x3")]
    rows = measured(sample, model, "text", ("toxic",)).select(*values).orderBy(F.xxhash64(*values)).limit(2 * max_labelled).toPandas()  # ids may repeat
    model.beta = _logistic(rows[["_x1", "_x2", "_x3"]].to_numpy(float), rows["_k0"].to_numpy(float))
    return model


def scored(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.7) -> DataFrame:
    """The kept columns with ``score`` and ``predicted``."""
    b = model.beta
    odds = b[0] + b[1] * F.col("_x1") + b[2] * F.col("_x2") + b[3] * F.col("_x3")
    rows = measured(docs, model, text, keep).withColumn("_score", 1 / (1 + F.exp(-odds)))
    own = [F.col(f"_k{i}").alias(c) for i, c in enumerate(keep) if c not in ("score", "predicted")]
    return rows.select(*own, F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op4_toxicity``: the score of every document."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
