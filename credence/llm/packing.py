"""Best-fit packing by bin completion.

Documents become token pieces of at most CAPACITY tokens (narrow map). Piece lengths are integers, so the
packing problem is the histogram of lengths: at most CAPACITY counts, whatever the size of the corpus. Bin
completion solves that histogram on the driver: best-fit decreasing gives the incumbent, then branch and
bound enumerates undominated fillings around the largest length left, prunes by waste, and repeats a
filling for as many bins as its lengths allow. The plan is a few thousand patterns with a repeat count.
Spark then numbers the pieces of each length (ranges, no big task) and looks up their place in the plan.
"""
from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credence.llm.common import map_texts, stored
from credence.llm.encoding import encoder
from credence.operators.layout import cut_lineage

CAPACITY = 1024
END_ID = 2
NODES = 2000     # search nodes of branch and bound; the incumbent stands when they are used up
FILLINGS = 6     # undominated fillings tried at a node, least waste first


# ---- pieces

def pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
           end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, tokens): tokens are packed little-endian unsigned 32-bit ids.

    A null text is empty: one piece with the end id. Only longer documents are cut; their first piece takes
    the rest, the others are full.
    """
    end = np.array([end_id], "<u4").tobytes()

    def work(texts):
        out = {"parts": []}
        for ids in encoder(path, "byte").encode(texts):
            ids += end
            n = len(ids) // 4
            cuts = [0, *range(n - (n - 1) // capacity * capacity, n + 1, capacity)]
            out["parts"].append([{"start": a, "length": b - a, "tokens": ids[4 * a:4 * b]} for a, b in zip(cuts, cuts[1:])])
        return out

    frame = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = frame.schema["doc_id"].dataType.simpleString()
    cut = map_texts(frame, ["doc_id"], f"doc_id {kind}, parts array<struct<start:long,length:long,tokens:binary>>", work)
    return cut.select("doc_id", F.posexplode("parts").alias("piece", "_p")).select("doc_id", "piece", "_p.*")


# ---- the plan

def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: (filling, bins) pairs, largest lengths first.

    Each bin takes the largest length left, then always the largest that still fits; equal bins are made
    in one step.
    """
    left = dict(counts)
    sizes = sorted(left)
    plan = []
    while sizes:
        filling, room = [], capacity
        i = len(sizes)
        while i:
            i = bisect_right(sizes, room, 0, i)
            if not i:
                break
            size = sizes[i - 1]
            n = min(room // size, left[size])
            filling += [size] * n
            room -= n * size
            i -= 1
        used = {s: filling.count(s) for s in set(filling)}
        times = min(left[s] // n for s, n in used.items())
        for s, n in used.items():
            left[s] -= n * times
            if not left[s]:
                sizes.remove(s)
                del left[s]
        plan.append((tuple(filling), times))
    return plan


def undominated(largest: int, left: dict[int, int], capacity: int, most: int = FILLINGS) -> list[tuple[int, ...]]:
    """Fillings around `largest`, least waste first, none dominated by another one.

    A filling with one length less, replaced by a longer one that still fits, is dominated; depth-first
    search over lengths from large to small meets fillings in that order and keeps maximal ones only.
    """
    room = capacity - largest
    sizes = [s for s in sorted(left, reverse=True) if s <= room and left[s] - (s == largest) > 0]
    found: list[tuple[int, tuple[int, ...]]] = []
    visits = 0

    def grow(i: int, room: int, chosen: tuple[int, ...]):
        nonlocal visits
        visits += 1
        if visits > 400 or len(found) >= 4 * most or (found and found[0][0] == 0 and len(found) >= most):
            return
        while i < len(sizes) and sizes[i] > room:
            i += 1
        if i == len(sizes):
            found.append((room, chosen))
            return
        s = sizes[i]
        most_here = min(room // s, left[s] - (s == largest))
        for n in range(most_here, -1, -1):
            if n == 0 and room >= s and not any(t > room - s for t in sizes[i + 1:]):
                break  # leaving s out wins only if something longer than the rest beside s can come instead
            grow(i + 1, room - n * s, chosen + (s,) * n)

    grow(0, room, ())
    found.sort(key=lambda f: (f[0], len(f[1]), tuple(-s for s in f[1])))
    kept: list[tuple[int, tuple[int, ...]]] = []
    for waste, filling in found:
        if not any(_dominates(other, filling) for _, other in kept):
            kept.append((waste, filling))
    return [(largest, *f) for _, f in kept[:most]]


def _dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether lengths of b can be matched one to one with lengths of a that are at least as long."""
    return len(a) >= len(b) and all(x >= y for x, y in zip(sorted(a, reverse=True), sorted(b, reverse=True)))


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[tuple[int, ...], int]]:
    """The plan with the fewest bins found: optimal if it meets the bound ceil(total / capacity), or if the
    search ends by itself; otherwise the best incumbent after `nodes` nodes."""
    counts = {s: n for s, n in counts.items() if n}
    best = best_fit(counts, capacity)
    fewest = sum(n for _, n in best)
    total = sum(s * n for s, n in counts.items())
    if not counts or fewest == -(-total // capacity):
        return best
    used = 0

    def search(left: dict[int, int], plan: list, bins: int):
        nonlocal best, fewest, used
        used += 1
        if used > nodes:
            return
        rest = sum(s * n for s, n in left.items())
        if bins + -(-rest // capacity) >= fewest:  # waste bound: even without waste no better
            return
        if not left:
            best, fewest = list(plan), bins
            return
        tail = best_fit(left, capacity)
        if bins + sum(n for _, n in tail) < fewest:
            best, fewest = plan + tail, bins + sum(n for _, n in tail)
            if fewest == -(-total // capacity):
                return
        largest = max(left)
        for filling in undominated(largest, left, capacity):
            need = {s: filling.count(s) for s in set(filling)}
            times = min(left[s] // n for s, n in need.items())
            after = {s: n - need.get(s, 0) * times for s, n in left.items()}
            search({s: n for s, n in after.items() if n}, [*plan, (filling, times)], bins + times)
            if fewest == -(-total // capacity) or used > nodes:
                return

    import sys
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 20_000))
    try:
        search(counts, [], 0)
    finally:
        sys.setrecursionlimit(limit)
    return best


def slots(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first bin, copies in a bin, offset of the first copy): where ranks of a length go."""
    rows, rank, bins = [], {}, 0
    for filling, times in plan:
        offset = 0
        for size in sorted(set(filling), reverse=True):
            n = filling.count(size)
            first = rank.get(size, 0)
            rows.append((size, first, first + n * times, bins, n, offset))
            rank[size] = first + n * times
            offset += n * size
        bins += times
    return rows


def numbered(df: DataFrame, group: str, out: str, spread: int = 64) -> DataFrame:
    """Add a rank from 0 within each `group`, dealt over `spread` x groups ranges so that a hot group is many tasks."""
    cell = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(spread)).cast("int")
    celled = df.withColumn("_cell", cell)
    sums = celled.groupBy(group, "_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(group, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy(group, "_cell").orderBy("doc_id", "piece")
    ranked = celled.withColumn("_in", F.row_number().over(inside) - 1)
    return ranked.join(starts, [group, "_cell"]).withColumn(out, F.col("_in") + F.col("_first")).drop("_cell", "_in", "_first")


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to rows (doc_id, piece, length, ...); `parts` should be stored.

    Every row is placed; sequences are gapless from offset 0. Ties go by doc_id and piece; repeated rows are
    places of their own. Empty table: empty result. Lengths must be 1 .. capacity.
    """
    counts = {int(r["length"]): int(r["count"]) for r in parts.groupBy("length").count().collect()}
    plan = slots(bin_completion(counts, capacity))
    spark = parts.sparkSession
    per_size: dict[int, list] = {}
    for size, first, end, bin_, n, offset in plan:
        per_size.setdefault(size, []).append((first, end, bin_, n, offset))
    table = spark.sparkContext.broadcast({s: np.array(v, np.int64) for s, v in per_size.items()})  # a few thousand rows of plan

    def place(batches):
        for pdf in batches:
            length, rank = pdf["length"].to_numpy(np.int64), pdf["_rank"].to_numpy(np.int64)
            seq, off = np.empty(len(pdf), np.int64), np.empty(len(pdf), np.int64)
            for size in np.unique(length):
                here = length == size
                t = table.value[int(size)]
                r = rank[here]
                row = t[np.searchsorted(t[:, 0], r, "right") - 1]
                k = r - row[:, 0]
                seq[here], off[here] = row[:, 2] + k // row[:, 3], row[:, 4] + k % row[:, 3] * size
            yield pdf.drop(columns="_rank").assign(sequence_id=seq, offset=off)

    ranked = numbered(parts, "length", "_rank")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank")
    return ranked.mapInPandas(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row.

    Null texts are empty; rows that repeat a doc_id are documents of their own; other columns are not read.
    """
    made = pieces(docs, path, key, text, capacity).withColumn("ids_crc32", F.crc32("tokens")).drop("tokens")
    return pack(stored(made, "pieces"), capacity)
