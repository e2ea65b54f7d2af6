"""Source divergence audit: how far each source's term distribution is from its language's and its peers'.

Terms are the runs of `[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]` (ASCII letters and every non-ASCII code point) after
lower-casing A-Z only. A language keeps the V terms found in at least MIN_DOCS of its documents. Every group -
each occurring (lang, source) and each lang as a whole - prices every kept term, count c >= 0 there and N the
sum of c over kept terms, at p = 1 + floor(10^9 (c + 1) / (N + V)); two prices p, q diverge by
f = floor((p - q)^2 / q). All of it is integer arithmetic (decimals where 10^9 (c + 1) passes a long).

part `pair`: for group (lang, s) and every other source s' of the lang, the sum of f(p_s, p_s') over all kept
terms (0 if V = 0), every other source ranked. part `term`: each kept term with c > 0 in the group and p above
the lang's price q, valued f(p, q), the first TERM_RANKS ranked. Ranks count from 1 within (lang, source, part),
value descending, then item by UTF-8 bytes.

Method (pair part): pair-task sparse merge. Kept terms get ids (hash block, rank in block); each group stores, per
block, its sorted (id, price) arrays of the terms it holds (c > 0). Both groups' arrays of a block are co-grouped
per unordered pair of sources, and a galloping intersection over the two sorted id arrays finds shared terms
(a linear merge where neither array is GALLOP_RATIO times the other, the case galloping cannot shorten);
shared, one-sided (the other side priced at its count-0 price) and absent terms are priced both ways at once.
Absent terms need no rows: value = V f(p0, p0') + sum over held terms of (f - f(p0, p0')). Sources are dealt
into tiles of SOURCES_PER_TILE; a task takes one block of two tiles (or of one) and merges every pair between
them, so each array is copied once per tile of its lang, not once per other source. A task holds at most
2 x SOURCES_PER_TILE arrays of about BLOCK_TERMS entries, whatever the size of a source.

Defined results: null text, lang or source read as ''. A group without kept terms still gets its pair rows; a
lang of one source gets none. Repeated rows count as documents of their own. An empty table gives no rows.
Other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credence.llm.common import small_batches, stored
from credence.operators.layout import broadcast_if_small

# Fixed values of the contract.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
MIN_DOCS = 3
SCALE = 1_000_000_000
TERM_RANKS = 200
# Kept terms in one id block, and sources in one tile: a pair task holds one block of at most two tiles.
BLOCK_TERMS = 4096
SOURCES_PER_TILE = 64
# Galloping takes over from a linear merge once one array is this many times longer than the other.
GALLOP_RATIO = 8


# The ASCII characters outside terms: the complement of TERM's ranges.
BREAKS = "".join(chr(c) for lo, hi in ((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F)) for c in range(lo, hi + 1))


def spaced(text: str = "text"):
    """A text column (null: empty) with A-Z down and everything outside terms as spaces, by one translate."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), UPPER + BREAKS, LOWER + " " * len(BREAKS))


def terms(text: str = "text"):
    """The terms of a text column (null: none): equal to extracting TERM after lower-casing A-Z, at a sixth of the
    regular expression's CPU."""
    return F.array_remove(F.split(spaced(text), " "), "")


# (group, term) entries of documents that a task adds up at once: about 100 MB
ENTRIES = 2_000_000


class _Numbers(dict):
    """Numbers in the order of first sight."""

    def __missing__(self, name):
        number = self[name] = len(self)
        return number


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) rows to (lang, source, term, c, d): occurrences and documents, summed over many documents."""
    groups, names, codes, times, size = _Numbers(), _Numbers(), [], [], 0

    def sums() -> Iterator[pa.RecordBatch]:
        found, place = np.unique(np.concatenate(codes), return_inverse=True)
        c = np.bincount(place, np.concatenate(times), len(found)).astype(np.int64)
        d = np.bincount(place, minlength=len(found)).astype(np.int64)
        keys, words = list(groups), pa.array(list(names), pa.string())
        langs, sources = (pa.array([k[i] for k in keys], pa.string()) for i in (0, 1))
        for at in range(0, len(found), 100_000):
            part = slice(at, at + 100_000)
            group, term = pa.array(found[part] >> 32), pa.array(found[part] & 0xFFFFFFFF)
            yield pa.RecordBatch.from_arrays([langs.take(group), sources.take(group), words.take(term), pa.array(c[part]), pa.array(d[part])],
                                             ["lang", "source", "term", "c", "d"])

    for batch in batches:
        for lang, source, text in zip(*(column.to_pylist() for column in batch.columns)):
            words = [w for w in text.split(" ") if w]
            ids, n = np.unique(np.fromiter(map(names.__getitem__, words), np.int64, len(words)), return_counts=True)
            codes.append((groups[lang, source] << 32) | ids)
            times.append(n)
            size += len(ids)
            if size >= ENTRIES:
                yield from sums()
                groups, names, codes, times, size = _Numbers(), _Numbers(), [], [], 0
    if size:
        yield from sums()


def price(count: str, total: str, v: str):
    """1 + floor(SCALE (count + 1) / (total + v)), exactly."""
    return F.expr(f"1 + (CAST({count} + 1 AS DECIMAL(38,0)) * {SCALE}) div CAST({total} + {v} AS DECIMAL(38,0))")


def diverge(p, q):
    """floor((p - q)^2 / q) for prices below 2^31: the square stays below 2^62."""
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})")


def gallop(small: np.ndarray, big: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in small, in big) of the ids both sorted arrays hold: exponential then binary search from the
    last place found, so the cost is about len(small) log(len(big) / len(small))."""
    found_s, found_b = [], []
    lo, n = 0, len(big)
    for i, x in enumerate(small.tolist()):
        step, hi = 1, lo
        while hi < n and big[hi] < x:
            lo, hi, step = hi, hi + step, step * 2
        at = lo + int(np.searchsorted(big[lo:min(hi + 1, n)], x))
        if at < n and big[at] == x:
            found_s.append(i)
            found_b.append(at)
        lo = at
        if lo >= n:
            break
    return np.asarray(found_s, dtype=np.int64), np.asarray(found_b, dtype=np.int64)


def _f(p: np.ndarray, q) -> np.ndarray:
    return (p - q) * (p - q) // q


def merge_pair(ids_a, p_a, ids_b, p_b, p0_a: int, p0_b: int) -> tuple[int, int]:
    """Sum over the terms either side holds of f - f(p0, p0'), both ways: (a against b, b against a)."""
    ids_a, p_a = np.asarray(ids_a, dtype=np.int64), np.asarray(p_a, dtype=np.int64)
    ids_b, p_b = np.asarray(ids_b, dtype=np.int64), np.asarray(p_b, dtype=np.int64)
    small, big = sorted((len(ids_a), len(ids_b)))
    if small * GALLOP_RATIO > big:
        # sizes alike: galloping would step one by one, so a linear merge in numpy does the same work faster
        _, ia, ib = np.intersect1d(ids_a, ids_b, assume_unique=True, return_indices=True)
    elif len(ids_a) <= len(ids_b):
        ia, ib = gallop(ids_a, ids_b)
    else:
        ib, ia = gallop(ids_b, ids_a)
    only_a = np.ones(len(ids_a), bool)
    only_a[ia] = False
    only_b = np.ones(len(ids_b), bool)
    only_b[ib] = False
    held = len(ia) + int(only_a.sum()) + int(only_b.sum())
    ab = (int(_f(p_a[ia], p_b[ib]).sum()) + int(_f(p_a[only_a], p0_b).sum()) + int(_f(np.int64(p0_a), p_b[only_b]).sum())
          - held * ((p0_a - p0_b) ** 2 // p0_b))
    ba = (int(_f(p_b[ib], p_a[ia]).sum()) + int(_f(np.int64(p0_b), p_a[only_a]).sum()) + int(_f(p_b[only_b], p0_a).sum())
          - held * ((p0_b - p0_a) ** 2 // p0_a))
    return ab, ba


def _tile_pairs(frame: pd.DataFrame) -> pd.DataFrame:
    """Every pair of sources between the two tiles of this task (within the tile if they are one), one block."""
    lo, hi = int(frame["lo"].iloc[0]), int(frame["hi"].iloc[0])
    frame = frame.sort_values("_i")
    empty = np.empty(0, np.int64)
    rows = [(r.source, int(r.tile), int(r.p0), empty if r.ids is None else r.ids, empty if r.ps is None else r.ps)
            for r in frame.itertuples(index=False)]
    left = [r for r in rows if r[1] == lo]
    right = left if lo == hi else [r for r in rows if r[1] == hi]
    out = []
    for i, a in enumerate(left):
        for b in (right[i + 1:] if lo == hi else right):
            if len(a[3]) or len(b[3]):
                out.append((frame["lang"].iloc[0], a[0], b[0], *merge_pair(a[3], a[4], b[3], b[4], a[2], b[2])))
    return pd.DataFrame(out, columns=["lang", "a", "b", "s_ab", "s_ba"])


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank) of every group."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source"),
                       spaced(text).alias("_t"))
    # One pass over the texts, stored once: every later step reads these term tables only. The sums of a (lang, term)
    # meet in one task, where its documents are added up over the sources.
    groups = stored(rows.select("lang", "source").distinct(), "divergence-groups")
    found = (rows.mapInArrow(count_terms, "lang string, source string, term string, c long, d long")
             .repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))
             .withColumn("_docs", F.sum("d").over(Window.partitionBy("lang", "term"))))
    counts = stored(found.where(F.col("_docs") >= MIN_DOCS).select("lang", "term", "source", "c"), "divergence-counts")
    kept = stored(counts.select("lang", "term").distinct(), "divergence-kept")
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    totals = (groups.join(sizes, "lang", "left").join(counts.groupBy("lang", "source").agg(F.sum("c").alias("n")),
                                                      ["lang", "source"], "left")
              .fillna(0, ["v", "n"]).withColumn("p0", F.when(F.col("v") > 0, price("0", "n", "v"))))
    lang_counts = counts.groupBy("lang", "term").agg(F.sum("c").alias("c"))
    lang_totals = lang_counts.groupBy("lang").agg(F.sum("c").alias("n")).join(sizes, "lang")
    priced = counts.join(totals.select("lang", "source", "n", "v"), ["lang", "source"]).withColumn("p", price("c", "n", "v"))

    term_rows = (priced.join(lang_counts.join(lang_totals, "lang").select("lang", "term", price("c", "n", "v").alias("q")),
                             ["lang", "term"])
                 .where(F.col("p") > F.col("q"))
                 .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                         diverge("p", "q").alias("value")))
    term_rows = _ranked(term_rows).where(F.col("rank") <= TERM_RANKS)

    blocks = sizes.select("lang", F.greatest(F.lit(1), F.ceil(F.col("v") / BLOCK_TERMS)).alias("_nb"))
    ids = (kept.join(blocks, "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("_nb")))
           .withColumn("id", F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")))
           .select("lang", "term", "block", "id"))
    arrays = (priced.join(ids, ["lang", "term"]).groupBy("lang", "source", "block")
              .agg(F.array_sort(F.collect_list(F.struct("id", "p"))).alias("_a"))
              .select("lang", "source", "block", F.transform("_a", lambda x: x["id"]).alias("ids"),
                      F.transform("_a", lambda x: x["p"]).alias("ps")))
    pairs = (totals.alias("x").join(totals.alias("y"), (F.col("x.lang") == F.col("y.lang")) & (F.col("x.source") < F.col("y.source")))
             .select(F.col("x.lang").alias("lang"), F.col("x.source").alias("a"), F.col("y.source").alias("b"),
                     F.col("x.p0").alias("p0_a"), F.col("y.p0").alias("p0_b"), F.col("x.v").alias("v")))
    # Sources in tiles of SOURCES_PER_TILE: a task holds one block of two tiles and merges every pair between them.
    tiled = (totals.where(F.col("v") > 0)
             .withColumn("_i", F.row_number().over(Window.partitionBy("lang").orderBy(F.col("source").cast("binary"))) - 1)
             .withColumn("tile", F.floor(F.col("_i") / SOURCES_PER_TILE)))
    last = tiled.groupBy("lang").agg(F.max("tile").alias("_last"))
    dense = (tiled.join(last, "lang").join(blocks, "lang")
             .select("lang", "source", "_i", "tile", "p0", "_last", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)).alias("block"))
             .join(arrays, ["lang", "source", "block"], "left"))
    dealt = dense.select("*", F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("_u")).select(
        "lang", "block", F.least("tile", "_u").alias("lo"), F.greatest("tile", "_u").alias("hi"),
        "source", "_i", "tile", "p0", "ids", "ps")
    sums = stored(dealt.groupBy("lang", "block", "lo", "hi").applyInPandas(_tile_pairs, "lang string, a string, b string, s_ab long, s_ba long")
                  .groupBy("lang", "a", "b").agg(F.sum("s_ab").alias("s_ab"), F.sum("s_ba").alias("s_ba")), "divergence-pairs")
    whole = pairs.join(sums, ["lang", "a", "b"], "left").fillna(0, ["s_ab", "s_ba"])
    both = whole.select("lang", F.col("a").alias("source"), F.col("b").alias("item"),
                        F.when(F.col("v") == 0, 0).otherwise(F.col("v") * diverge("p0_a", "p0_b") + F.col("s_ab")).alias("value")
                        ).unionByName(whole.select(
                            "lang", F.col("b").alias("source"), F.col("a").alias("item"),
                            F.when(F.col("v") == 0, 0).otherwise(F.col("v") * diverge("p0_b", "p0_a") + F.col("s_ba")).alias("value")))
    pair_rows = _ranked(both.withColumn("part", F.lit("pair")))
    return pair_rows.unionByName(term_rows).select(
        "lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))


def _ranked(df: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), F.col("item").cast("binary"))
    return df.withColumn("rank", F.row_number().over(order))
