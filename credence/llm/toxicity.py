"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Examples are a bounded sample of labelled training rows (EXAMPLES of each class, drawn by hash). Terms are
words and short word beginnings that tell the classes apart (likelihood ratio). The index holds postings by
term in blocks of examples with the largest weight of each term in each block; a query adds up block bounds,
visits blocks from the highest bound down and stops when no bound can reach its K-th neighbour, so the
neighbours are exact. Votes are weighted by distance and class share, and mapped to a probability that is
fitted on the examples themselves, each with its own row left out.
"""
from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm.common import crc32_bucket, map_texts, small_batches, stored

EXAMPLES = 3000      # labelled rows of each class
TERMS = 20_000       # terms of the index at most, by likelihood ratio
LEAST_RATIO = 25.0   # log-likelihood ratio a term needs
PREFIXES = (4, 5)
BLOCK = 64
K = 15
WIDTH = 0.5          # distance at which a vote has lost most of its weight
PRIOR = 0.1          # weight of the overall share in a vote
THRESHOLD = 0.7
WORD = re.compile(r"[^\W\d_]+")


def terms_of(text: str) -> Counter:
    """Counts of words and of word beginnings (marked by ^) of a whole text, lower-cased."""
    words = Counter(WORD.findall(text.lower()))
    out = Counter(words)
    for w, n in words.items():
        for p in PREFIXES:
            if len(w) >= p:
                out["^" + w[:p]] += n
    return out


def term_table(examples: DataFrame) -> pd.DataFrame:
    """(term, toxic, clean): the most telling terms, with the examples of each class that hold them."""
    def split(batches):
        for pdf in batches:
            rows = [(t, int(y)) for text, y in zip(pdf["text"], pdf["label"]) for t in terms_of(text or "")]
            yield pd.DataFrame(rows, columns=["term", "label"])

    sizes = {r["label"]: r["count"] for r in examples.groupBy("label").count().collect()}
    pos, neg = float(sizes.get(1, 0)), float(sizes.get(0, 0))
    if not pos or not neg:
        return pd.DataFrame({"term": [], "toxic": [], "clean": []})
    counts = examples.select("text", "label").mapInPandas(split, "term string, label int").groupBy("term").agg(
        F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))

    def part(n, of, all_):  # n log(n / expected), 0 for none
        return F.when(n > 0, n * F.log(n / (all_ * F.lit(of / (pos + neg))))).otherwise(0.0)

    a, b = F.col("toxic"), F.col("clean")
    ratio = 2 * (part(a, pos, a + b) + part(b, neg, a + b)
                 + part(pos - a, pos, pos + neg - a - b) + part(neg - b, neg, pos + neg - a - b))
    return (counts.filter(a + b >= 3).withColumn("ratio", ratio).filter(F.col("ratio") >= LEAST_RATIO)
            .orderBy(F.desc("ratio"), "term").limit(TERMS).select("term", "toxic", "clean").toPandas())


class BlockMaxIndex:
    """Exact cosine search over unit vectors of examples."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = BLOCK):
        # neighbours in a block share their heaviest term, so bounds are tight
        lead = [int(t[np.argmax(w)]) if len(t) else n_terms for t, w in vectors]
        self.order = np.array(sorted(range(len(vectors)), key=lambda i: (lead[i], i)), np.int64)
        slot = np.concatenate([np.full(len(vectors[i][0]), s, np.int64) for s, i in enumerate(self.order)] or [np.zeros(0, np.int64)])
        term = np.concatenate([vectors[i][0] for i in self.order] or [np.zeros(0, np.int64)]).astype(np.int64)
        weight = np.concatenate([vectors[i][1] for i in self.order] or [np.zeros(0)])
        by_term = np.lexsort((slot, term))
        self.slot, self.weight, term = slot[by_term], weight[by_term], term[by_term]
        self.block, self.n_blocks = block, -(-len(vectors) // block)
        # postings of (term, block) lie between two neighbouring pointers
        cell = term * self.n_blocks + self.slot // block
        self.pointer = np.searchsorted(cell, np.arange(n_terms * self.n_blocks + 1))
        self.most = np.zeros((n_terms, self.n_blocks))
        np.maximum.at(self.most, (term, self.slot // block), self.weight)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(example numbers, cosines) of the k nearest with a positive cosine, ties to the smaller number."""
        bound = weights @ self.most[terms]
        found_i, found_s, least = [], [], 0.0
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or bound[b] < least - 1e-12:
                break
            scores = np.zeros(self.block)
            for t, w in zip(terms, weights):
                lo, hi = self.pointer[t * self.n_blocks + b], self.pointer[t * self.n_blocks + b + 1]
                scores[self.slot[lo:hi] - b * self.block] += w * self.weight[lo:hi]
            at = np.flatnonzero(scores > 0)
            ids = self.order[at + b * self.block]
            keep = ids != skip
            found_i.append(ids[keep])
            found_s.append(scores[at][keep])
            every = np.concatenate(found_s)
            if len(every) >= k:
                least = -np.partition(-every, k - 1)[k - 1]
        if not found_i:
            return np.zeros(0, np.int64), np.zeros(0)
        i, s = np.concatenate(found_i), np.minimum(np.concatenate(found_s), 1.0)
        first = np.lexsort((i, -s.round(12)))[:k]
        return i[first], s[first]


def monotone(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted isotonic fit: (upper ends of x, values) by pooling neighbours that violate the order."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # value x weight, weight, largest x
    for xi, yi, wi in zip(x[order], y[order], w[order]):
        pools.append([yi * wi, wi, xi])
        while len(pools) > 1 and (pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1] or pools[-2][2] == pools[-1][2]):
            v, u, end = pools.pop()
            pools[-1] = [pools[-1][0] + v, pools[-1][1] + u, end]
    return np.array([p[2] for p in pools]), np.array([p[0] / p[1] for p in pools])


@dataclass(frozen=True)
class Model:
    words: dict[str, int]
    idf: np.ndarray
    index: BlockMaxIndex | None
    label: np.ndarray
    ids: list
    share: np.ndarray        # rows that an example of class 0 or 1 stands for
    ends: np.ndarray
    values: np.ndarray
    nothing: float           # probability of a text without a neighbour
    base: float              # overall share of class 1

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        found = sorted((self.words[t], n) for t, n in terms_of(text).items() if t in self.words)
        if not found:
            return np.zeros(0, np.int64), np.zeros(0)
        t, n = np.array([f[0] for f in found]), np.array([f[1] for f in found], float)
        w = (1 + np.log(n)) * self.idf[t]
        return t, w / np.sqrt((w ** 2).sum())

    def neighbours(self, text: str, skip: int = -1, k: int = K):
        t, w = self.vector(text)
        return self.index.search(t, w, k, skip) if len(t) and self.index else (np.zeros(0, np.int64), np.zeros(0))

    def vote(self, i: np.ndarray, s: np.ndarray) -> float:
        """Distance-weighted share of toxic neighbours, drawn to the overall share when all are far away.

        The distance between unit vectors is sqrt(2 - 2 cosine).
        """
        w = self.share[self.label[i]] * np.exp(-(2 - 2 * s) / WIDTH ** 2)
        return float(((w * self.label[i]).sum() + PRIOR * self.base) / (w.sum() + PRIOR))

    def score(self, text: str) -> tuple[float, list[dict]]:
        """(probability, evidence): evidence lists the neighbours with their similarity and label."""
        i, s = self.neighbours(text)
        if not len(i):
            return self.nothing, []
        at = min(int(np.searchsorted(self.ends, self.vote(i, s))), len(self.ends) - 1)
        return float(self.values[at]), [{"doc_id": self.ids[j], "similarity": float(c), "label": int(self.label[j])} for j, c in zip(i, s)]


def draw(labels: DataFrame, examples: int = EXAMPLES) -> tuple[DataFrame, dict[int, int]]:
    """(about `examples` rows of each class by hash of their doc_id, rows of each class) from (doc_id, label)."""
    counts = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
    share = F.create_map(*[x for c in (0, 1) for x in (F.lit(c), F.lit(min(1.0, examples / max(1, counts.get(c, 0)))))])
    part = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < share[F.col("label")] * (1 << 30)
    return labels.filter(part), counts


def fit(drawn: DataFrame, counts: dict[int, int]) -> Model:
    """Fit on example rows (doc_id, text, label in 0/1), given how many labelled rows of each class they stand for."""
    small_batches(drawn.sparkSession)
    total, pos = sum(counts.values()), counts.get(1, 0)
    base = (pos + 1) / (total + 2)
    table = term_table(drawn)
    words = {t: i for i, t in enumerate(table["term"])}
    known = drawn.sparkSession.sparkContext.broadcast(set(words))

    def only_known(texts):  # whole texts stay on the executors; their counts of index terms come back
        return {"found": [[{"t": t, "n": n} for t, n in sorted(terms_of(x).items()) if t in known.value] for x in texts]}

    kind = drawn.schema["doc_id"].dataType.simpleString()
    rows = map_texts(drawn, ["doc_id", "label"], f"doc_id {kind}, label int, found array<struct<t:string,n:long>>", only_known)
    rows = sorted(rows.collect(), key=lambda r: (str(r["doc_id"]), r["label"], r["found"]))
    label = np.array([r["label"] for r in rows], np.int64)
    df = np.zeros(len(words))
    for r in rows:
        for f in r["found"]:
            df[words[f["t"]]] += 1
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    each = np.array([counts.get(c, 0) / max(1, (label == c).sum()) for c in (0, 1)])
    vectors = []
    for r in rows:
        t = np.array([words[f["t"]] for f in r["found"]], np.int64)
        w = (1 + np.log(np.array([f["n"] for f in r["found"]], float))) * idf[t]
        order = np.argsort(t)
        vectors.append((t[order], w[order] / np.sqrt((w ** 2).sum()) if len(w) else w))
    index = BlockMaxIndex(vectors, len(words)) if words else None
    model = Model(words, idf, index, label, [r["doc_id"] for r in rows], each, np.array([1.0]), np.array([base]), base, base)
    if index is None:
        return model
    votes, alone = [], []
    for j, (t, w) in enumerate(vectors):
        i, s = index.search(t, w, K, j) if len(t) else (np.zeros(0, np.int64), None)
        votes.append(model.vote(i, s) if len(i) else np.nan)
    votes = np.array(votes)
    near = ~np.isnan(votes)
    weight = each[label]
    alone = ~near
    nothing = float(((weight * label)[alone].sum() + base) / (weight[alone].sum() + 1))
    ends, values = monotone(votes[near], label[near].astype(float), weight[near]) if near.any() else (np.array([1.0]), np.array([base]))
    return Model(words, idf, index, label, model.ids, each, ends, values, nothing, base)


def classify(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, **options) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence for every row, fitted on labels outside the held-out fold.

    Texts without an index term (null and empty ones too) get the share of toxic examples that have none. Without labelled
    rows of both classes every score is the overall share. Repeated rows and null keys give a row each; a
    document labelled twice counts once for each distinct label; other columns are not read.
    """
    frame = docs.select("doc_id", "text")
    fold = crc32_bucket("doc_id", modulus)
    marked = (labels.select("doc_id", F.col("toxic").cast("int").alias("label"))
              .filter(F.col("label").isin(0, 1) & (fold != held_out)).distinct())
    drawn, counts = draw(marked, **options)
    # copies of an example say nothing new; the draw has a bounded number of rows, so it is broadcast and the texts stay where they are
    model = fit(stored(frame.join(F.broadcast(drawn), "doc_id").groupBy("text", "label").agg(F.min("doc_id").alias("doc_id")), "examples"), counts)
    kind = frame.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts):
        got = [shared.value.score(t) for t in texts]
        return {"score": [g[0] for g in got], "evidence": [g[1] for g in got]}

    schema = f"doc_id {kind}, score double, evidence array<struct<doc_id:{kind},similarity:double,label:int>>"
    scored = map_texts(frame, ["doc_id"], schema, work)
    return scored.select("doc_id", (fold == held_out).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
