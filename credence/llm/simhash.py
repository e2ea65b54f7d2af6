"""SimHash near-duplicates by BK-trees.

1. Every whole text becomes a 64-bit fingerprint (row-local).
2. Distinct fingerprints are dealt to shards: two that differ in at most r bits agree wholly in one of r + 1
   blocks of the bits, so they meet in the shard of that block's value. A shard over SHARD fingerprints is
   dealt again by r + 1 blocks of the bits it has not fixed yet (their difference lies there), up to DEPTH
   times; what is still larger is cut into chunks and every two chunks meet. Nothing is dropped.
3. Each shard (or chunk) becomes a BK-tree: a node's children are keyed by their Hamming distance to it.
   A probe at distance d from a node follows only the edges d - r .. d + r. The trees reach the tasks that
   hold their probes by a join on the shard, at most SHARD keys a tree; no fingerprints pass the driver.
4. A shard emits a spanning forest of its links (fewer rows than fingerprints, however many pairs agree),
   and alternating stars join the forests into components.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm.common import map_texts, stored
from credence.operators.layout import cut_lineage

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
SHARD = 1024
DEPTH = 4
FULL = (1 << 64) - 1


# ---- fingerprints

def fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    """Unsigned fingerprint of a whole text; 0 if it has no words."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, six blanks split
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        hashes = [digest(b" ".join(parts), SEED)]
    else:
        line = b" ".join(parts)
        ends = (np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1).tolist()
        starts = [0, *[e + 1 for e in ends[:-words]]]
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts, ends[words - 1:])]
    n = len(hashes)
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long. A null text has no words."""
    frame = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = frame.schema["doc_id"].dataType.simpleString()
    return map_texts(frame, ["doc_id"], f"doc_id {kind}, fp long", lambda texts: {
        "fp": np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)})


def hex16(column: str):
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))


# ---- BK-trees

class BKTree:
    """A BK-tree over distinct 64-bit keys, grown level by level with numpy."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        edges, kids = [], []
        rest = np.arange(1, len(keys))
        at = np.zeros(len(rest), np.int64)
        while len(rest):
            edge = at * 65 + np.bitwise_count(keys[rest] ^ keys[at])
            slot, first, group = np.unique(edge, return_index=True, return_inverse=True)
            child = rest[first]  # the first key that takes an edge becomes the child; the others go on below it
            edges.append(slot)
            kids.append(child)
            at, down = child[group], np.ones(len(rest), bool)
            down[first] = False
            rest, at = rest[down], at[down]
        edge = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        order = np.argsort(edge)
        self.edges, self.kids = edge[order], (np.concatenate(kids) if kids else edge)[order]

    def within(self, probes: np.ndarray, radius: int, step: int = 256):
        """Yield (probe numbers, node numbers) whose keys differ in at most `radius` bits."""
        for start in range(0, len(probes) if len(self.keys) else 0, step):
            q = np.arange(start, min(start + step, len(probes)))
            node = np.zeros(len(q), np.int64)
            while len(q):
                d = np.bitwise_count(probes[q] ^ self.keys[node]).astype(np.int64)
                hit = d <= radius
                if hit.any():
                    yield q[hit], node[hit]
                low = np.searchsorted(self.edges, node * 65 + np.maximum(d - radius, 0))
                high = np.searchsorted(self.edges, node * 65 + np.minimum(d + radius, 64), "right")
                n = high - low
                q = np.repeat(q, n)
                offset = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
                node = self.kids[np.repeat(low, n) + offset]


def forest(tree: np.ndarray, probes: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (key, least key of its group) of the links between probes and tree keys."""
    keys = tree if same else np.concatenate([tree, probes])
    label = np.arange(len(keys))
    shift = 0 if same else len(tree)
    for q, node in BKTree(tree).within(probes, radius):
        a, b = q + shift, node
        while True:  # merge this block of links into the labels
            la, lb = label[a], label[b]
            differ = la != lb
            if not differ.any():
                break
            hi, lo = np.maximum(la, lb)[differ], np.minimum(la, lb)[differ]
            np.minimum.at(label, hi, lo)
            while (label[label] != label).any():
                label = label[label]
    least = np.full(len(keys), FULL, np.uint64)
    np.minimum.at(least, label, keys)
    root = least[label]
    linked = root != keys
    return keys[linked], root[linked]


# ---- shards

def block_masks(fixed: int, parts: int) -> list[int]:
    """The bits not fixed, in `parts` runs of nearly equal length, each joined to the fixed bits."""
    free = [b for b in range(64) if not fixed >> b & 1]
    cuts = [len(free) * i // parts for i in range(parts + 1)]
    return [fixed | sum(1 << b for b in free[lo:hi]) for lo, hi in zip(cuts, cuts[1:]) if hi > lo]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shard_rows(fps: DataFrame, radius: int, shard: int = SHARD, depth: int = DEPTH) -> DataFrame:
    """(mask, value, chunk, keys): packed shards of two or more fingerprints, chunks of about `shard` keys."""
    masks = block_masks(0, radius + 1)
    rows = fps.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    packed = None
    for level in range(depth):
        rows = rows.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = rows.groupBy("mask", "value").agg(F.count("*").alias("n")).filter("n > 1")
        sized = cut_lineage(rows.join(sizes, ["mask", "value"]))
        last = level + 1 == depth or sized.filter(F.col("n") > shard).isEmpty()
        done = sized if last else sized.filter(F.col("n") <= shard)
        chunked = done.withColumn("chunks", F.ceil(F.col("n") / shard).cast("int")).withColumn(
            "chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
        part = chunked.groupBy("mask", "value", "chunk", "chunks").agg(F.collect_list("fp").alias("keys"))
        packed = part if packed is None else packed.unionByName(part)
        if last:
            return packed
        finer = {m: block_masks(m, radius + 1) for m in masks}
        table = F.create_map(*[x for m, subs in finer.items() for x in (
            F.lit(_signed(m)), F.array(*[F.lit(_signed(s)) for s in subs]))])
        rows = sized.filter(F.col("n") > shard).select("fp", F.explode(table[F.col("mask")]).alias("mask"))
        masks = sorted({s for subs in finer.values() for s in subs})
    return packed


def links(fps: DataFrame, radius: int = MAX_BITS, shard: int = SHARD, depth: int = DEPTH) -> DataFrame:
    """(a, b): spanning links between distinct fingerprints (one column `fp`, no nulls)."""
    packed = cut_lineage(shard_rows(fps, radius, shard, depth))
    own = packed.select(F.col("keys").alias("tree"), F.lit(None).cast("array<long>").alias("probes"))
    large = packed.filter("chunks > 1")
    left, right = large.alias("l"), large.alias("r")
    cross = left.join(right, (F.col("l.mask") == F.col("r.mask")) & (F.col("l.value") == F.col("r.value"))
                      & (F.col("l.chunk") < F.col("r.chunk"))).select(F.col("l.keys").alias("tree"), F.col("r.keys").alias("probes"))

    def run(batches):
        for pdf in batches:
            a, b = [], []
            for tree, probes in zip(pdf["tree"], pdf["probes"]):
                tree = np.asarray(tree, np.int64).view(np.uint64)
                other = tree if probes is None else np.asarray(probes, np.int64).view(np.uint64)
                x, y = forest(tree, other, radius, probes is None)
                a.append(x), b.append(y)
            if a:
                yield pd.DataFrame({"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b).view(np.int64)})

    return own.unionByName(cross).mapInPandas(run, "a long, b long").distinct()


# ---- components

def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each component, by alternating large and small stars.

    `edges` holds longs a != b. Every step keeps at most as many edges as there are; minima are combined
    before they move, and the joins are plain ones that Spark splits when a node is hot.
    """
    def minima(e):
        return e.groupBy("u").agg(F.min("v").alias("m"))

    def state(e):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    stars = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    stars = cut_lineage(stars.filter("u <> v").distinct())
    before = state(stars)
    while before[0]:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = minima(both).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut_lineage(large)
        low = minima(large)
        small = (large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        stars = cut_lineage(small)
        now = state(stars)
        if now == before:
            break
        before = now
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS,
                    radius: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint, component_id, fp, root (a key of the component) for every row.

    Texts without words (null, empty, blank) share fingerprint zero, which links like any other. Rows with
    one doc_id are separate rows that share a component only through their fingerprints. A null doc_id
    takes part, but is a component's name only if all its members have null. Empty table: empty result.
    """
    rows = stored(fingerprints(docs, key, text, words), "fingerprints")
    distinct = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = components(links(distinct.select("fp"), radius))
    rooted = distinct.join(found, distinct["fp"] == found["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = cut_lineage(rooted)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    least = cut_lineage(least)  # else its grouping and the join share an exchange that Spark cannot split
    named = rooted.join(least, "root").select("fp", "component_id", "root")
    return rows.join(named, "fp").select("doc_id", hex16("fp").alias("fingerprint"), "component_id", "fp", "root")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS,
               radius: int = MAX_BITS) -> DataFrame:
    """One row of every component stays, with all its columns: the one with the smallest doc_id.

    Where that doc_id stands on several rows, the one with the least fingerprint stays (of equal texts, one
    row). A component whose doc_ids are all null keeps one row.
    """
    groups = stored(near_duplicates(docs, key, text, words, radius).select("doc_id", "fp", "root", "component_id"), "groups")
    times = groups.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("many"))
    chosen = (groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root", "component_id")
              .agg(F.min("fp").alias("_fp")).select(F.col("component_id").alias("_id"), "_fp"))
    marked = cut_lineage(chosen.join(times, F.col("_id") == F.col("many"), "left").select(
        "_id", "_fp", (F.col("_id").isNull() | F.col("many").isNotNull()).alias("several")))
    kept = docs.join(marked.filter("NOT several"), F.col(key) == F.col("_id"), "left_semi")
    odd = marked.filter("several")
    if odd.isEmpty():
        return kept
    # a doc_id on several rows does not name a row; there the fingerprint must agree as well
    prints = F.pandas_udf(lambda t: pd.Series(np.array(
        [fingerprint("" if x is None else x, words) for x in t.tolist()], np.uint64).view(np.int64)), "long")
    rows = docs.join(odd.select("_id").distinct(), F.col(key).eqNullSafe(F.col("_id")), "left_semi")
    rows = rows.select(F.struct(*docs.columns).alias("_row"), F.col(key).alias("_key"), prints(F.col(text)).alias("_print"))
    first = rows.groupBy("_key", "_print").agg(F.min("_row").alias("_row"))
    match = F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_print") == F.col("_fp"))
    return kept.unionByName(first.join(odd, match, "left_semi").select("_row.*"))
