"""SimHash near-duplicates with BK-trees.

Fingerprints are 64 majority bits over the hashes of word shingles. Documents with the same fingerprint are one node.
Nodes meet in shards: the 64 bits are cut into ``radius + 2`` blocks, and two fingerprints that differ in at most
``radius`` bits agree in at least two whole blocks, so a shard is a pair of blocks and their values. A shard of more than
``TREE`` fingerprints is split: the bits that its members may still differ in are cut into blocks in turn, until every
shard is small (four blocks leave 32, 16, then 8 free bits, so at most 256 members). A shard's BK-tree (children keyed by
their distance to the parent) is searched along edges within the radius only. A shard reports a spanning set of links, not
all pairs; links of all shards are joined into components by star contraction. Trees grow with the data, so they are not
broadcast but built where their shard's fingerprints are shuffled to.

Defined cases: null or wordless text has fingerprint 0 and is linked like any other; a text of fewer than three words has
one shingle; a text of any length is hashed whole; a null id is never the smallest (a component without any id has a null
id); rows with the same id stay separate rows; an empty table gives an empty result. ``keep_one`` keeps further columns
whatever their names, ``classes`` does not look at them.

``keep_one``, the pipeline's stage, has its own rule: texts whose sets of five-word shingles have a Jaccard similarity of
0.8 are near copies. At that similarity a fingerprint moves by ten bits and often by fifteen, too far for blocks of 64
bits, so its shards are bands of min-hashes. Texts with equal sets are one node; all wordless texts are one. The fingerprints
of each shard are a BK-tree like any other, in which every member looks for its ``NEAREST``, along the edges within the
distance of the farthest found so far, since a fixed radius would lose links (a shard of more than ``SHARD`` members is split
by a second band, and one that is still larger is dealt out in parts that share a member). What is found is checked on the
sets themselves. An exact check of the rest follows: shards whose members are not one component yet are taken up again with
their sets, every pair of such a shard is counted where the shard is gathered (a large one in all pairs of its blocks), and
only links between components leave the task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import boxed, row_keys, settle, table, unboxed

#: Words in a shingle, seed of the hash, and most differing bits of a link.
SHINGLE, SEED, RADIUS = 3, 42, 2
#: Most fingerprints in a shard's tree; larger shards are split.
TREE = 4096
#: The stage: words in a shingle, least similarity, bands and min-hashes in a band (a pair at 0.8 shares no band once in
#: 4,600 times), how many nearest members of its shard a member is compared with at first.
COPY_SHINGLE, SIMILAR, BANDS, ROWS, NEAREST = 5, 0.8, 16, 4, 4
#: Most members of a shard that one task compares, and rows of keys that are broadcast.
SHARD, MAX_BROADCAST_ROWS = 16_384, 1_000_000
#: Shingle hashes that one task holds when it counts all pairs of a shard.
SHARD_HASHES = 1_000_000


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64 majority bits of a text's shingle hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and the six ASCII blanks count
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        ones += np.unpackbits(hashes[at : at + 65536].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).astype(np.int64))


class BKTree:
    """Fingerprints below a root, each child keyed by its distance to the parent."""

    def __init__(self):
        self.root: list | None = None

    def add(self, value: int, radius: int) -> list[int]:
        """Insert, and return what was there within the radius."""
        if self.root is None:
            self.root = [value, {}]
            return []
        near, todo, place = [], [(self.root, True)], None
        while todo:
            node, own = todo.pop()
            d = (node[0] ^ value).bit_count()
            if d <= radius:
                near.append(node[0])
            if own:
                place = (node, d)
            for edge, child in node[1].items():
                if edge == d and own:
                    todo.append((child, True))
                elif d - radius <= edge <= d + radius:
                    todo.append((child, False))
        place[0][1][place[1]] = [value, {}]
        return near

    def nearest(self, values: np.ndarray, places: dict[int, np.ndarray], count: int) -> np.ndarray:
        """For each value the ``count`` nearest places in order, as distance << 32 | place; ``places`` has those of each node.

        All values are searched together. Each goes along the edges within its own radius, which is the distance of the
        farthest place that it holds so far.
        """
        best = np.full((len(values), count), 65 << 32, np.int64)
        todo = [] if self.root is None else [(self.root, 0, np.arange(len(values)), np.zeros(len(values), np.int64))]
        while todo:
            node, edge, who, far = todo.pop()
            who = who[np.abs(far - edge) <= best[who, -1] >> 32]
            far = np.bitwise_count(values[who] ^ np.uint64(node[0])).astype(np.int64)
            met = far[:, None] << 32 | places[node[0]][:count]
            closer = met[:, 0] < best[who, -1]
            best[who[closer]] = np.sort(np.concatenate([best[who[closer]], met[closer]], axis=1), axis=1)[:, :count]
            todo += [(child, edge, who, far) for edge, child in node[1].items()]
        return best


def shard_links(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """(fingerprint, smallest fingerprint it is linked with inside the shard) for each that isn't alone or smallest."""
    parent = {v: v for v in values}

    def top(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    tree = BKTree()
    for v in parent:
        for w in tree.add(v, radius):
            a, b = top(v), top(w)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return [(v, top(v)) for v in parent if top(v) != v]


def finer(mask: int, radius: int) -> list[int]:
    """The masks of a shard's parts: the bits fixed so far, and two of the blocks that the free ones are cut into."""
    free, n = [i for i in range(64) if not mask >> i & 1], radius + 2
    block = [sum(1 << i for i in free[len(free) * k // n : len(free) * (k + 1) // n]) for k in range(n)]
    return [mask | a | b for a, b in combinations(block, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _search(radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for values in batch["values"]:
                out += [(_signed(a), _signed(b)) for a, b in shard_links([int(v) & (2**64 - 1) for v in values], radius)]
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def links(prints: DataFrame, radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints within the radius, from a column ``fp``."""
    spark = prints.sparkSession
    level, small, masks = prints.select("fp").distinct(), None, [0]
    level = level.withColumn("mask", F.lit(0).cast("long"))
    while True:
        # one row a mask that is in use, at most a power of the number of pairs of blocks
        parts = F.broadcast(spark.createDataFrame([(_signed(m), [_signed(f) for f in finer(m, radius)]) for m in masks], "mask long, parts array<long>"))
        level = level.join(parts, "mask").select("fp", F.explode("parts").alias("mask")).distinct() if masks != [0] else level.join(parts, "mask").select("fp", F.explode("parts").alias("mask"))
        level = level.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        large = settle(level.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tree).select("mask", "key"))
        masks = [r["mask"] & (2**64 - 1) for r in large.select("mask").distinct().collect()]
        # with so few free bits a shard can't be too large, if the limit isn't either
        masks = [m for m in masks if 64 - m.bit_count() > max(8, radius + 2)]
        done = level if not masks else level.join(large, ["mask", "key"], "left_anti")
        small = done if small is None else small.unionByName(done)
        if not masks:
            break
        level = settle(level.join(large, ["mask", "key"], "left_semi").select("fp", "mask"))
    met = small.groupBy("mask", "key").agg(F.collect_list("fp").alias("values"))
    return met.where(F.size("values") > 1).select("values").mapInPandas(_search(radius), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b), root the smallest node of its component, by alternating stars."""
    current = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        seen = current.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if seen == state:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = seen
        both = current.unionAll(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b")
        current = settle(small.distinct())


def _placed(docs: DataFrame, doc_id: str, text: str, radius: int) -> tuple[DataFrame, DataFrame]:
    """A row for each document (id, fingerprint), and for each fingerprint its smallest id and its component's root."""
    prints = settle(docs.select(F.col(doc_id).alias("doc_id"), _fingerprints(F.col(text)).alias("fp")))
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(prints, radius))
    return prints, firsts.join(roots, firsts["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """For each document its fingerprint (16 hex digits) and the smallest id of its component."""
    prints, rooted = _placed(docs, doc_id, text, radius)
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_print = rooted.join(smallest, "root").select("fp", "component_id")
    return prints.join(of_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


_MULTIPLIERS = np.random.RandomState(SEED).randint(0, 2**64, BANDS * ROWS, np.uint64) | np.uint64(1)


def shingle_set(text: str | None, shingle: int = COPY_SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)] if words else []
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64))


def min_hashes(hashes: np.ndarray) -> np.ndarray:
    """The least of all hashes under each of the multipliers."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 4096):
        least = np.minimum(least, (_MULTIPLIERS[:, None] * hashes[None, at : at + 4096]).min(axis=1))
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """A key for each band of min-hashes."""
    rows, keys = least.reshape(BANDS, ROWS), np.zeros(BANDS, np.uint64)
    for r in range(ROWS):
        keys = (keys ^ rows[:, r]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys


@F.pandas_udf(T.StructType([T.StructField("node", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("size", T.LongType())]))
def _sketches(texts: pd.Series) -> pd.DataFrame:
    out = []
    for t in texts:
        hashes = shingle_set(t)
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 65536):
            ones += np.unpackbits(hashes[at : at + 65536].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.uint32)
        fp = int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")
        node = xxhash.xxh64_intdigest(hashes.tobytes(), SEED) if len(hashes) else 0
        least = min_hashes(hashes)
        out.append((_signed(node), _signed(fp), band_keys(least).view(np.int64) if len(hashes) else np.zeros(0, np.int64), len(hashes)))
    return pd.DataFrame(out, columns=["node", "fp", "keys", "size"])


@F.pandas_udf(T.ArrayType(T.LongType()))
def _sets(texts: pd.Series) -> pd.Series:
    return pd.Series([shingle_set(t).view(np.int64) for t in texts])


def ranked(fps: np.ndarray, first: int, before: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of members, and of others of their shard: of each the ``first`` to ``before`` nearest by fingerprint, then by place.

    The shard's BK-tree is searched; members with the same fingerprint are one node of it.
    """
    n = len(fps)
    before = min(before, n - 1)
    if first >= before:
        return
    values, which = np.unique(fps, return_inverse=True)
    tree = BKTree()
    for v in values.tolist():
        tree.add(v, -1)  # nothing is within that radius
    places = dict(zip(values.tolist(), np.split(np.argsort(which, kind="stable"), np.cumsum(np.bincount(which))[:-1])))
    best = tree.nearest(values, places, before + 1)[which]
    own = best == np.arange(n)[:, None]
    own[~own.any(axis=1), -1] = True  # a member that isn't among its own nearest leaves out the last of them
    near = best[~own].reshape(n, before)[:, first:] & (1 << 32) - 1
    yield np.repeat(np.arange(n), before - first), near.ravel()


def _candidates(near: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Pairs (smaller, larger node) of each member of a shard with the nearest in the shard's tree; all pairs of few."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [np.zeros((0, 2), np.int64)]
            for members in batch["members"]:
                m = np.stack(list(members)).astype(np.int64)
                m = m[np.argsort(m[:, 1])]
                for one, other in ranked(m[:, 0].astype(np.uint64), 0, near):
                    out.append(np.unique(m[:, 1][np.column_stack([np.minimum(one, other), np.maximum(one, other)])], axis=0))
            yield pd.DataFrame(np.concatenate(out), columns=["a", "b"])

    return run


def _spanning(similar: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Links of a shard that join components; the common hashes of all its pairs are counted through lists of each hash's owners."""

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard, out = shard.sort_values("node"), []
        node, label, sizes = shard["node"].to_numpy(), shard["root"].to_numpy().copy(), shard["set"].map(len).to_numpy()
        distinct, which = np.unique(np.concatenate(shard["set"].to_list()), return_inverse=True)
        ends = np.cumsum(np.bincount(which, minlength=len(distinct)))
        owners = np.split(np.repeat(np.arange(len(node)), sizes)[np.argsort(which, kind="stable")], ends[:-1])
        for i, own in enumerate(np.split(which, np.cumsum(sizes)[:-1])):
            if (label[:i] == label[i]).all():
                continue
            both = np.bincount(np.concatenate([owners[h] for h in own]), minlength=len(node))[:i]
            linked = np.flatnonzero(both >= similar * (sizes[i] + sizes[:i] - both))
            while len(linked := linked[label[linked] != label[i]]):
                out.append((node[linked[0]], node[i]))
                label[label == label[linked[0]]] = label[i]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def banded(nodes: DataFrame, *more: str) -> DataFrame:
    """A row for each node and band: ``shard`` is the band with its key."""
    return nodes.select("node", "fp", "keys", *more, F.posexplode("keys").alias("band", "key")).withColumn("shard", F.xxhash64("band", "key"))


def crowded(nodes: DataFrame, above: int) -> DataFrame:
    """Shards of more than so many members, with their number."""
    return settle(banded(nodes).groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > above))


def copy_shards(nodes: DataFrame, most: int = SHARD, sizes: DataFrame | None = None) -> DataFrame:
    """Arrays ``members`` of (fingerprint, node) that share a band (or two, or a part of them), none much larger than ``most``.

    ``sizes`` has the numbers of members of all shards of more than ``most``, if they are counted already.
    """
    rows = banded(nodes)
    large = (crowded(nodes, most) if sizes is None else sizes).where(F.col("n") > most).select("shard")
    if not large.isEmpty():
        hot = rows.join(large, "shard", "left_semi")
        others = hot.select("node", "fp", "band", "key", F.posexplode("keys").alias("band2", "key2")).where("band <> band2")
        both = F.array_sort(F.array(F.struct(F.col("band").alias("b"), F.col("key").alias("k")), F.struct(F.col("band2").alias("b"), F.col("key2").alias("k"))))
        twice = settle(others.select("node", "fp", F.xxhash64(both).alias("shard")).distinct())
        sizes = twice.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("node", "fp")).alias("first")).where(F.col("n") > most)
        sizes = settle(sizes)
        dealt = twice.join(sizes.select("shard", "n"), "shard").withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / most)))
        shared = sizes.select("first.node", "first.fp", "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / most) - 1)).alias("part"))
        parts = dealt.select("node", "fp", "shard", "part").unionByName(shared).distinct().select("node", "fp", F.xxhash64("shard", "part").alias("shard"))
        rows = rows.join(large, "shard", "left_anti").select("node", "fp", "shard").unionByName(twice.join(sizes, "shard", "left_anti").select("node", "fp", "shard")).unionByName(parts)
    return rows.groupBy("shard").agg(F.collect_list(F.array("fp", "node")).alias("members")).where(F.size("members") > 1).select("members")


def _few(keys: DataFrame) -> DataFrame:
    """A settled table of keys, to be broadcast if it is known to be small."""
    return F.broadcast(keys) if keys.count() <= MAX_BROADCAST_ROWS else keys


def sets_of(docs: DataFrame, nodes: DataFrame, used: DataFrame, text: str = "text") -> DataFrame:
    """(node, set) of the nodes in ``used``; ``docs`` are boxed rows with their keys."""
    wanted = _few(settle(nodes.join(used, "node", "left_semi").select("node", F.col("best._key").alias("_k"), F.col("best._hash").alias("_h"))))
    # the text of a node is that of its best row; rows alike in id and text have the same set
    texts = docs.join(wanted, (F.col("_key") == F.col("_k")) & (F.col("_hash") == F.col("_h"))).select("node", _sets(F.col(f"_doc.`{text}`")).alias("set"))
    return settle(texts.groupBy("node").agg(F.first("set").alias("set")))


def checked(sets: DataFrame, pairs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The pairs (a, b) whose shingle sets have at least the similarity."""
    a, b = sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    compared = pairs.join(a, "a").join(b, "b").select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb")).alias("all"))
    return settle(compared.where(F.col("both") >= similar * (F.col("all") - F.col("both"))).select("a", "b"))


def unsettled(rows: DataFrame, roots: DataFrame, most: int, hashes: int) -> DataFrame:
    """Members, with their roots, of the shards that are not one component; large shards in all pairs of their blocks."""
    placed = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    some = placed.groupBy("shard").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("weight"))
    n = F.when((F.col("n") <= most) & (F.col("weight") <= hashes), F.lit(1)).otherwise(F.ceil(2 * F.greatest(F.col("n") / most, F.col("weight") / hashes)))
    left = settle(some.where("low <> high").select("shard", n.cast("long").alias("blocks")))
    dealt = placed.join(_few(left), "shard").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = dealt.select("node", "root", "shard", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    return settle(dealt.select("node", "root", F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other")).alias("shard")))


def copy_roots(docs: DataFrame, nodes: DataFrame, text: str = "text", similar: float = SIMILAR, near: int = NEAREST, most: int = SHARD, hashes: int = SHARD_HASHES) -> DataFrame:
    """(node, root) of the nodes that are linked; ``docs`` are boxed rows with their keys.

    Every pair that shares a band is in one component after the search of the trees, or counted in the check that follows.
    No pairs but a tree's nearest are written, so a large group of copies does not become all its pairs.
    """
    full = crowded(nodes, near + 1)
    pairs = settle(copy_shards(nodes, most, full).mapInPandas(_candidates(near), "a long, b long").distinct())
    links = checked(sets_of(docs, nodes, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), text), pairs, similar)
    roots = components(links)
    rows = banded(nodes, "size").join(_few(full.select("shard")), "shard").select("shard", "node", "size")
    rows = unsettled(rows, roots, most, hashes)
    if rows.isEmpty():
        return roots
    more = rows.join(sets_of(docs, nodes, rows.select("node").distinct(), text), "node").groupBy("shard").applyInPandas(_spanning(similar), "a long, b long")
    return components(links.unionByName(more))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """One document of each component of near copies: the one with the smallest id (nulls last), of several with that id one by
    hash, of rows alike in both one by the hash of all its columns. Whole rows are shuffled once, to the keys that are kept."""
    key, hashed = row_keys(F.col(doc_id), F.col(text))
    rows = boxed(docs, key.alias("_key"), hashed.alias("_hash"))
    prints = settle(docs.select(F.col(doc_id).alias("doc_id"), key.alias("_key"), hashed.alias("_hash"), _sketches(F.col(text)).alias("s")).select("doc_id", "_key", "_hash", "s.*"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key", "_hash")).alias("best")
    nodes = settle(prints.groupBy("node").agg(best, *[F.first(c).alias(c) for c in ("fp", "keys", "size")]))  # these go with the node
    roots = copy_roots(rows, nodes, text, similar)
    placed = nodes.select("node", "best").join(roots, "node", "left").select("best", F.coalesce("root", "node").alias("root"))
    kept = placed.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best._key").alias("_k"), F.col("best._hash").alias("_h"))
    only = rows.join(kept, (F.col("_key") == F.col("_k")) & (F.col("_hash") == F.col("_h")), "left_semi")
    looks = F.xxhash64(*[F.col(f"_doc.`{f.name}`") for f in docs.schema if not isinstance(f.dataType, T.MapType)])
    return unboxed(only.withColumn("_no", F.row_number().over(Window.partitionBy("_key", "_hash").orderBy(looks))).where("_no = 1"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op8_simhash``: all documents."""
    return classes(table(spark, sf_dir, "documents"))
