"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Per class and length band, mean and covariance come from exact sums over all labelled training rows (one
row-local pass, then a grouped sum of a few hundred numbers). Means are shrunk towards the class, the
covariances towards the class and the pooled one, and cached as Cholesky factors. A score is the logistic
of the difference of the Mahalanobis log-densities plus the log prior of the band.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm.common import crc32_bucket, map_texts, small_batches, stored

FEATURES = ("words", "word_length", "upper", "digits", "closing", "symbols", "bars", "shouts", "lines", "spread",
            "packing", "entropy", "repeats")
# Documents of a few words vary far more than long ones, so each band of word counts has its own moments.
BAND_WORDS = (8, 32, 128, 512, 2048)
MEAN_WEIGHT = 20.0       # labelled rows that the class mean weighs in a band
COV_WEIGHT = 50.0        # labelled rows that the class covariance weighs in a band
POOL_SHARE = 0.1         # share of the pooled covariance in every covariance
RIDGE = 0.02             # added variance, in units of the pooled variance
CLIP = 6.0               # standardised statistics are cut here: one odd number cannot decide alone
PRIOR_ROWS = 2.0         # rows added to each band with the overall class shares
TEMPERATURE = 2.0        # statistics are not independent; differences are softened by this factor
THRESHOLD = 0.7


def _class_table(chars: bytes) -> np.ndarray:
    t = np.zeros(256)
    t[list(chars)] = 1
    return t


UPPER, DIGIT = _class_table(bytes(range(65, 91))), _class_table(b"0123456789")
CLOSING, SYMBOL, BAR, SHOUT = _class_table(b".,;:?"), _class_table(b"#*$%&<>@^~=+_\\/{}[]"), _class_table(b"|"), _class_table(b"!")


def document_statistics(texts: list[str]) -> np.ndarray:
    """A row of transformed statistics per whole text; empty texts get the statistics of no characters."""
    pack = zstandard.ZstdCompressor(level=1, write_content_size=False).compress
    out = np.zeros((len(texts), len(FEATURES)))
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass")
        hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(float)
        words = raw.split()
        n, size = len(words), len(raw)
        counts = np.array([hist @ t for t in (UPPER, DIGIT, CLOSING, SYMBOL, BAR, SHOUT)])
        # share per word, variance-stabilised; half a count keeps zero finite
        rates = np.arcsinh(np.sqrt((counts + 0.1) / (n + 1)))
        share = hist[hist > 0] / max(1, size)
        kinds = len(set(words))
        twice = sum(a == b for a, b in zip(words, words[1:]))
        out[i] = (
            np.log1p(n), np.log1p(sum(map(len, words)) / max(1, n)), *rates,
            np.arcsinh(np.sqrt((hist[10] + 0.1) / (n + 1))),
            np.log((kinds + 1) / (n + 1)), np.log((size + 32) / (len(pack(raw)) + 20)),
            -(share * np.log(share)).sum(), np.arcsinh(np.sqrt((twice + 0.1) / (n + 1))),
        )
    return out


def bands_of(stats: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.array(BAND_WORDS), np.expm1(stats[:, 0]) + 0.5)


def with_statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` and `stats`, an array of doubles."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return map_texts(docs, keep, f"{schema}, stats array<double>",
                     lambda t: {"stats": list(document_statistics(t))}, text)


@dataclass(frozen=True)
class Discriminant:
    """Fitted state: standardisation, and per (band, class) mean, inverse Cholesky factor, log determinant, log prior."""
    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    whiten: np.ndarray
    log_det: np.ndarray
    log_prior: np.ndarray

    def score(self, stats: np.ndarray) -> np.ndarray:
        """P(label 1), 0 to 1."""
        if not len(stats):
            return np.zeros(0)
        z = np.clip((stats - self.centre) / self.scale, -CLIP, CLIP)
        band = bands_of(stats)
        log_density = np.empty((len(z), 2))
        for label in (0, 1):
            white = np.einsum("nij,nj->ni", self.whiten[band, label], z - self.means[band, label])
            log_density[:, label] = -0.5 * ((white ** 2).sum(1) + self.log_det[band, label])
        gap = (log_density[:, 1] - log_density[:, 0]) / TEMPERATURE + self.log_prior[band, 1] - self.log_prior[band, 0]
        return 1 / (1 + np.exp(-np.clip(gap, -500, 500)))


def moments(labelled: DataFrame) -> dict[tuple[int, int], tuple[float, np.ndarray, np.ndarray]]:
    """Exact count, sum and sum of products per (band, class) from rows (stats, label): bounded by d^2 numbers."""
    d = len(FEATURES)

    def partial(batches):
        total: dict = {}
        for pdf in batches:
            x, y = np.array(pdf["stats"].tolist(), float).reshape(-1, d), pdf["label"].to_numpy()
            one = np.hstack([np.ones((len(x), 1)), x])
            band = bands_of(x)
            for key in set(zip(band.tolist(), y.tolist())):
                rows = one[(band == key[0]) & (y == key[1])]
                total[key] = total.get(key, 0) + rows.T @ rows
        for (band, label), m in total.items():
            i, j = np.indices(m.shape)
            yield pd.DataFrame({"band": band, "label": label, "i": i.ravel(), "j": j.ravel(), "v": m.ravel()})

    sums = labelled.select("stats", "label").mapInPandas(partial, "band int, label int, i int, j int, v double")
    out: dict = {}
    for r in sums.groupBy("band", "label", "i", "j").agg(F.sum("v").alias("v")).collect():
        out.setdefault((r["band"], r["label"]), np.zeros((d + 1, d + 1)))[r["i"], r["j"]] = r["v"]
    return {k: (m[0, 0], m[0, 1:], m[1:, 1:]) for k, m in out.items()}


def fit(labelled: DataFrame) -> Discriminant:
    """Fit on rows (stats, label in 0/1). Without rows of a class, its moments are the pooled ones."""
    d, bands = len(FEATURES), len(BAND_WORDS) + 1
    found = moments(labelled)
    nothing = (0.0, np.zeros(d), np.zeros((d, d)))

    def add(keys):
        parts = [found.get(k, nothing) for k in keys]
        return tuple(sum(p[i] for p in parts) for i in range(3))

    every = [(b, c) for b in range(bands) for c in (0, 1)]
    n, s, ss = add(every)
    if not n:
        n, s, ss = 1.0, np.zeros(d), np.eye(d)
    centre = s / n
    scale = np.sqrt(np.maximum(np.diag(ss) / n - centre ** 2, 1e-6))

    def standard(part):
        """Count, mean and scatter of standardised rows (before clipping)."""
        m, t, tt = part
        if not m:
            return 0.0, np.zeros(d), np.zeros((d, d))
        mean = (t / m - centre) / scale
        return m, mean, (tt / m - np.outer(t, t) / m ** 2) / np.outer(scale, scale)

    classes = {c: standard(add([(b, c) for b in range(bands)])) for c in (0, 1)}
    pooled = sum(m * cov for m, _, cov in classes.values()) / max(1.0, sum(m for m, _, _ in classes.values()))
    within = {}
    for c in (0, 1):  # scatter inside the bands, for bands with few rows
        parts = [standard(found.get((b, c), nothing)) for b in range(bands)]
        rows = sum(p[0] for p in parts)
        within[c] = sum(p[0] * p[2] for p in parts) / rows if rows else pooled + np.eye(d)
    band_pool = sum(classes[c][0] * within[c] for c in (0, 1)) / max(1.0, n)
    means, whiten = np.zeros((bands, 2, d)), np.zeros((bands, 2, d, d))
    log_det, log_prior = np.zeros((bands, 2)), np.zeros((bands, 2))
    for b in range(bands):
        here = {c: standard(found.get((b, c), nothing)) for c in (0, 1)}
        total = here[0][0] + here[1][0]
        for c in (0, 1):
            m, mean, cov = here[c]
            other = here[1 - c]
            # a class unseen in a band sits where the band sits, moved by the overall distance of the classes
            shifted = other[1] + classes[c][1] - classes[1 - c][1] if other[0] else classes[c][1]
            means[b, c] = (m * mean + MEAN_WEIGHT * shifted) / (m + MEAN_WEIGHT)
            mixed = (m * cov + COV_WEIGHT * within[c]) / (m + COV_WEIGHT)
            mixed = (1 - POOL_SHARE) * mixed + POOL_SHARE * band_pool + RIDGE * np.eye(d)
            factor = np.linalg.cholesky(mixed)
            whiten[b, c] = np.linalg.inv(factor)
            log_det[b, c] = 2 * np.log(np.diag(factor)).sum()
            share = (classes[c][0] + 1) / (classes[0][0] + classes[1][0] + 2)
            log_prior[b, c] = np.log((m + PRIOR_ROWS * share) / (total + PRIOR_ROWS))
    return Discriminant(centre, scale, means, whiten, log_det, log_prior)


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 4, held_out: int = 2) -> DataFrame:
    """(doc_id, text, label) of labelled rows outside the held-out fold.

    A document labelled several times is one row for each distinct label; null or other labels are left out.
    """
    marked = (labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("label"))
              .filter(F.col("label").isin(0, 1) & (crc32_bucket("doc_id", modulus) != held_out)).distinct())
    return docs.join(marked, "doc_id")


def fit_on(docs: DataFrame, labels: DataFrame, text: str = "text") -> Discriminant:
    """Fit from documents and a label table; only texts and training labels are read."""
    frame = docs.select("doc_id", F.col(text).alias("text"))
    stats = with_statistics(frame, ["doc_id"])
    return fit(training_rows(stats, labels))


def classify(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    Null and empty texts are scored as texts without words. Repeated rows and null keys give a row each;
    other columns are not read; an empty table gives an empty one. Statistics are computed once and stored.
    """
    frame = docs.select("doc_id", F.col(text).alias("text"))
    stats = stored(with_statistics(frame, ["doc_id"]), "statistics")
    model = fit(training_rows(stats, labels))
    scored = F.pandas_udf(lambda s: pd.Series(model.score(np.array(s.tolist(), float).reshape(-1, len(FEATURES)))), "double")
    return stats.select(
        "doc_id", (crc32_bucket("doc_id", 4) == 2).alias("held_out"), scored("stats").alias("score"),
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows scored at least `threshold`, with all their columns; fitted on the labelled rows among `docs`."""
    model = fit_on(docs, labels, text)
    small_batches(docs.sparkSession)
    score = F.pandas_udf(lambda t: pd.Series(
        model.score(document_statistics(["" if x is None else x for x in t.tolist()])), dtype=float), "double")
    return docs.filter(score(F.col(text)) >= threshold)
