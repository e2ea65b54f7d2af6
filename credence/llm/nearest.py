"""Approximate nearest neighbours by balanced posting lists.

Centroids are fitted on a bounded sample by k-means that charges for crowded clusters. Every distinct vector
goes to its nearest centroid's list, and a boundary vector also to other lists whose centroid is nearly as
near. A query walks an in-memory neighbour graph of the centroids and takes the lists whose centroid is
within a ratio of the nearest one. Lists and the queries they are asked are packed into blocks and joined on the list, so
a crowded or popular list is many bounded tasks; distances are exact, in double precision.
"""
from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credence.llm.common import small_batches, stored

K = 10
SAMPLE = 40_000        # vectors that the centroids are fitted on
LIST_SIZE = 200        # distinct vectors aimed at in a list
MOST_CENTROIDS = 4096
REPLICAS = 4           # lists of a vector at most
BOUNDARY = 1.05        # a list takes a vector within this ratio of its nearest centroid's distance
PROBE = 1.1            # a query takes lists within this ratio of the nearest centroid's distance
LEAST_LISTS = 8        # and this many at least
EF = 96                # breadth of the graph walk
DEGREE = 16
BLOCK_VECTORS = 2048
BLOCK_QUERIES = 128


def square_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of a to rows of b, by products: for choosing lists only, not for results."""
    return np.maximum((a ** 2).sum(1)[:, None] - 2 * a @ b.T + (b ** 2).sum(1)[None], 0.0)


def balanced_centroids(x: np.ndarray, k: int, rounds: int = 12, charge: float = 0.5, seed: int = 3) -> np.ndarray:
    """k-means where a cluster's distance grows with its share of the rows, so crowded clusters shrink."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    size = np.full(k, len(x) / k)
    for _ in range(rounds):
        owner = np.empty(len(x), np.int64)
        near = []
        for s in range(0, len(x), 4096):
            d = square_distances(x[s:s + 4096], c)
            near.append(d.min(1).mean())
            d += charge * near[-1] * (size * k / len(x) - 1)
            owner[s:s + 4096] = d.argmin(1)
        size = np.bincount(owner, minlength=k).astype(float)
        total = np.zeros_like(c)
        np.add.at(total, owner, x)
        full = size > 0
        c[full] = total[full] / size[full, None]
        if not full.all():  # an empty cluster restarts at a random row
            c[~full] = x[rng.choice(len(x), (~full).sum())]
    return c


@dataclass(frozen=True)
class CentroidGraph:
    """Centroids linked to their nearest ones and a few random ones; searched best first."""
    centres: np.ndarray
    links: np.ndarray
    starts: np.ndarray

    @staticmethod
    def build(centres: np.ndarray, degree: int = DEGREE, seed: int = 5) -> "CentroidGraph":
        k = len(centres)
        rng = np.random.default_rng(seed)
        n = min(degree, k - 1)
        near = np.empty((k, n), np.int64)
        for s in range(0, k, 1024):
            d = square_distances(centres[s:s + 1024], centres)
            d[np.arange(len(d)), np.arange(s, s + len(d))] = np.inf
            near[s:s + 1024] = np.argsort(d, axis=1, kind="stable")[:, :n]
        far = rng.integers(0, k, (k, 4))
        return CentroidGraph(centres, np.hstack([near, far]), rng.choice(k, min(k, 8), replace=False))

    def search(self, q: np.ndarray, ef: int = EF) -> tuple[np.ndarray, np.ndarray]:
        """(centroid numbers, distances), nearest first: the best `ef` that the walk meets."""
        def far(i):
            return np.sqrt(((self.centres[i] - q) ** 2).sum(1))

        seen = set(self.starts.tolist())
        d = far(self.starts)
        todo = list(zip(d.tolist(), self.starts.tolist()))
        heapq.heapify(todo)
        best = [(-x, i) for x, i in todo]
        heapq.heapify(best)
        while todo:
            x, i = heapq.heappop(todo)
            if len(best) >= ef and x > -best[0][0]:
                break
            new = [j for j in dict.fromkeys(self.links[i].tolist()) if j not in seen]
            if not new:
                continue
            seen.update(new)
            for y, j in zip(far(np.array(new)).tolist(), new):
                if len(best) < ef or y < -best[0][0]:
                    heapq.heappush(todo, (y, j))
                    heapq.heappush(best, (-y, j))
                    if len(best) > ef:
                        heapq.heappop(best)
        out = sorted((-x, i) for x, i in best)
        return np.array([i for _, i in out]), np.array([x for x, _ in out])


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): distinct rows with a key and a finite, non-zero vector of the most common length, as doubles."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    fine = rows.filter(
        F.col("vec_id").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0))
    sizes = fine.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return fine.filter(F.size("v") == (sizes[0]["n"] if sizes else 0)).distinct()


def _matrix(column) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in column])


def search(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K,
           modulus: int = 100, list_size: int = LIST_SIZE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every query, nearest first, ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by `modulus`. Null, zero and non-finite vectors, null keys and
    vectors of another length than the most common one take no part; equal rows count once; a row is no
    neighbour of its own vec_id. Equal vectors are searched as one, with their k + 1 smallest keys, which is
    all that a result can hold. No usable vectors: empty result.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    out = "query_id long, rank int, vec_id long, score double"
    rows = stored(usable(vectors, key, vector), "vectors")
    order = Window.partitionBy("v").orderBy("vec_id")  # only k + 1 rows of a vector leave each task
    few = rows.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k + 1)
    points = stored(few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "points")
    n = points.count()
    if not n:
        return spark.createDataFrame([], out)
    part = points.filter(F.pmod(F.xxhash64(F.col("ids")[0], F.lit(3)), F.lit(1 << 30)) < min(1.0, SAMPLE / n) * (1 << 30))
    sample = _matrix(r["v"] for r in part.select("v", F.col("ids")[0].alias("i")).orderBy("i").collect())
    if not len(sample):
        sample = _matrix(r["v"] for r in points.select("v").limit(1).collect())
    count = int(min(MOST_CENTROIDS, max(1, n // list_size), len(sample)))
    graph = CentroidGraph.build(balanced_centroids(sample, count))
    shared = spark.sparkContext.broadcast(graph)  # at most MOST_CENTROIDS vectors and their links

    def assign(batches):
        c = shared.value.centres
        for pdf in batches:
            lists = []
            x = _matrix(pdf["v"])
            for s in range(0, len(x), 2048):
                d = np.sqrt(square_distances(x[s:s + 2048], c))
                near = np.argsort(d, axis=1, kind="stable")[:, :REPLICAS]
                dist = np.take_along_axis(d, near, 1)
                lists += [a[b <= BOUNDARY * b[0] + 1e-12].tolist() for a, b in zip(near, dist)]
            yield pd.DataFrame({"ids": pdf["ids"], "v": pdf["v"], "lists": lists})

    placed = points.mapInPandas(assign, "ids array<long>, v array<double>, lists array<int>")
    placed = stored(placed.select(F.explode("lists").alias("list"), "ids", "v"), "postings")
    sizes = {r["list"]: (r["n"], r["keys"]) for r in placed.groupBy("list").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("keys")).collect()}
    table = spark.createDataFrame([(i, -(-m // BLOCK_VECTORS)) for i, (m, _) in sizes.items()], "list int, _blocks int")
    counted = placed.join(F.broadcast(table), "list")  # a row a centroid
    packed = (counted.withColumn("_block", F.pmod(F.xxhash64("v"), F.col("_blocks")).cast("int"))
              .groupBy("list", "_block").agg(F.collect_list(F.struct("ids", "v")).alias("members")))
    keys = {i: m for i, (_, m) in sizes.items()}

    def choose(batches):
        graph = shared.value
        for pdf in batches:
            lists = []
            for q in _matrix(pdf["v"]) if len(pdf) else []:
                i, d = graph.search(q)
                held = np.cumsum([keys.get(int(j), 0) for j in i])
                want = (d <= PROBE * d[0] + 1e-12) | (np.arange(len(i)) < LEAST_LISTS)
                want[1:] |= held[:-1] < 2 * (k + 1)
                lists.append(i[want].tolist())
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "v": pdf["v"], "lists": lists})

    asked = rows.filter(F.col("vec_id") % modulus == 0)
    asked = asked.mapInPandas(choose, "vec_id long, v array<double>, lists array<int>").select(
        F.explode("lists").alias("list"), "vec_id", "v")
    asked = stored(asked, "asked")
    times = asked.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("_parts"))  # a row a centroid
    asks = (asked.join(F.broadcast(times), "list").withColumn("_part", F.pmod(F.xxhash64("vec_id", "v"), F.col("_parts")).cast("int"))
            .groupBy("list", "_part").agg(F.collect_list(F.struct("vec_id", "v")).alias("queries")))

    def compare(batches):
        for pdf in batches:
            got = []
            for members, queries in zip(pdf["members"], pdf["queries"]):
                x = _matrix(m["v"] for m in members)
                ids = [np.asarray(m["ids"], np.int64) for m in members]
                owner = np.repeat(np.arange(len(ids)), [len(i) for i in ids])
                every = np.concatenate(ids)
                for q in queries:
                    d = np.sqrt(((x - np.asarray(q["v"], np.float64)) ** 2).sum(1))[owner]
                    other = every != q["vec_id"]
                    i, d = every[other], d[other]
                    first = np.lexsort((i, d))[:k]
                    got += zip([q["vec_id"]] * len(first), i[first].tolist(), d[first].tolist())
            # of a batch, each query keeps its k nearest: less to shuffle, and no more could be returned
            found = pd.DataFrame(got, columns=["query_id", "vec_id", "score"]).sort_values(["query_id", "score", "vec_id"])
            found = found.drop_duplicates(["query_id", "vec_id"])
            yield found[found.groupby("query_id").cumcount() < k]

    pairs = asks.join(packed, "list").select("members", "queries").mapInPandas(compare, "query_id long, vec_id long, score double")
    best = pairs.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
