"""Language identification by hierarchical discrimination.

Linear support vector machines (one against one, squared hinge) over hashed character n-grams first choose
the language family, then the language among those of the family. They are fitted on the driver from a
bounded sample (SAMPLE rows, shared evenly by the languages, drawn by hash); every whole text is scored in a narrow map.
"""
from __future__ import annotations

import sys
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm.common import crc32_bucket, map_texts, small_batches

# Families of common languages (fixed values); a language not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "sv", "da", "no", "nb", "nn", "is", "fy", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "uralic": ("fi", "et", "hu"), "baltic": ("lt", "lv"), "celtic": ("ga", "cy", "gd", "br"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tt"), "semitic": ("ar", "he", "mt", "am"),
    "indic": ("hi", "bn", "mr", "ne", "gu", "pa", "ur", "si"), "iranian": ("fa", "ku", "ps", "tg"),
    "dravidian": ("ta", "te", "kn", "ml"), "malayic": ("id", "ms", "jv", "su", "tl"),
}
SIZES = (256, 768, 1024)  # hash slots of 1-, 2- and 3-grams
SAMPLE = 8000
PER_LANGUAGE = 1500
UNDETERMINED = "und"
PENALTY = 1e-4


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def ngrams(text: str) -> np.ndarray | None:
    """Root shares of hashed n-grams of the whole text, lower-cased, other characters as one blank; None without letters."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[c]
    if not letter.any():
        return None
    c = np.where(letter, c, 32).astype(np.uint64)
    if len(c) > 1:
        c = c[np.append(True, letter[1:] | letter[:-1])]
    c = np.concatenate([[np.uint64(32)], c, [np.uint64(32)]])
    mix, key, out = np.uint64(0x9E3779B97F4A7C15), c, []
    for n, size in enumerate(SIZES):
        if n:
            key = key[:-1] * np.uint64(1_000_003) + c[n:]
        slot = ((key * mix) >> np.uint64(40)) % np.uint64(size)
        counts = np.bincount(slot.astype(np.int64), minlength=size).astype(np.float64)
        out.append(np.sqrt(counts / max(1.0, counts.sum())))
    return np.concatenate(out).astype(np.float32)


@dataclass(frozen=True)
class Machine:
    """One linear machine between two names, with the slope of its calibrated confidence."""
    first: str
    second: str
    weights: np.ndarray
    bias: float
    slope: float


def _machine(first: str, second: str, x: np.ndarray, sign: np.ndarray) -> Machine:
    """Squared hinge with class-balanced rows, by Nesterov steps; the slope is fitted on a fifth kept aside."""
    aside = np.arange(len(x)) % 5 == 4
    if min((sign[~aside] > 0).sum(), (sign[~aside] < 0).sum()) == 0:
        aside[:] = False
    mean = x[~aside].mean(0)

    def solve(a, y):
        a = np.hstack([(a - mean) * 8.0, np.ones((len(a), 1))])
        weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
        step = 1.0 / (2 * (weight * (a ** 2).sum(1)).sum() + PENALTY)
        w = v = np.zeros(a.shape[1])
        for t in range(300):
            slack = np.maximum(0, 1 - y * (a @ v))
            grad = -2 * a.T @ (weight * slack * y) + PENALTY * v
            nxt = v - step * grad
            v = nxt + t / (t + 3) * (nxt - w)
            w = nxt
        return w[:-1] * 8.0, w[-1] - 8.0 * w[:-1] @ mean

    w, b = solve(x[~aside], sign[~aside])
    judge = aside if aside.any() else ~aside
    margin = sign[judge] * (x[judge] @ w + b)
    slopes = np.array([0.5, 1, 2, 3, 5, 8])
    loss = [np.log1p(np.exp(-np.clip(s * margin, -50, 50))).mean() for s in slopes]
    return Machine(first, second, w, b, float(slopes[int(np.argmin(loss))]))


def _vote(machines: list[Machine], names: list[str], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(winner numbers, confidence): most pairwise wins, then largest summed confidence, then name order."""
    wins, sure = np.zeros((len(x), len(names))), np.zeros((len(x), len(names)))
    least = np.ones((len(x), len(names)))
    at = {n: i for i, n in enumerate(names)}
    for m in machines:
        p = 1 / (1 + np.exp(-np.clip(m.slope * (x @ m.weights + m.bias), -50, 50)))
        i, j = at[m.first], at[m.second]
        wins[:, i] += p >= 0.5
        wins[:, j] += p < 0.5
        sure[:, i] += p
        sure[:, j] += 1 - p
        least[:, i] = np.minimum(least[:, i], p)
        least[:, j] = np.minimum(least[:, j], 1 - p)
    best = np.argmax(wins + sure / (len(names) + 1), axis=1) if len(x) else np.zeros(0, int)
    return best, least[np.arange(len(x)), best]


@dataclass(frozen=True)
class Identifier:
    families: dict[str, list[str]]
    between: list[Machine]
    inside: dict[str, list[Machine]]

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and score of each text; `und` with score 0 for texts without letters or an unfitted model."""
        lang, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        found = [(i, v) for i, v in ((i, ngrams(t)) for i, t in enumerate(texts)) if v is not None]
        if not found or not self.families:
            return lang, score
        rows, x = np.array([i for i, _ in found]), np.array([v for _, v in found], np.float64)
        names = sorted(self.families)
        family, sure = _vote(self.between, names, x)
        for f, name in enumerate(names):
            here = np.flatnonzero(family == f)
            if len(here):
                langs = self.families[name]
                best, p = _vote(self.inside[name], langs, x[here])
                for r, b, q in zip(here, best, p * sure[here]):
                    lang[rows[r]], score[rows[r]] = langs[b], float(q)
        return lang, score


def family_of(lang: str, families: dict[str, tuple[str, ...]] = FAMILIES) -> str:
    return next((f for f, langs in families.items() if lang in langs), f"only {lang}")


def fit(docs: DataFrame, families: dict[str, tuple[str, ...]] = FAMILIES, sample: int = SAMPLE,
        per_language: int = PER_LANGUAGE) -> Identifier:
    """Fit on rows (doc_id, text, lang) with lang not null: about `sample` rows at most reach the driver."""
    small_batches(docs.sparkSession)
    counts = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    if not counts:
        return Identifier({}, [], {})
    each = min(per_language, max(20, sample // len(counts)))
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, each / n)))])
    drawn = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))

    def vectors(texts):
        return {"v": [None if (v := ngrams(t)) is None else v.tobytes() for t in texts]}

    rows = map_texts(drawn, ["lang"], "lang string, v binary", vectors).filter("v IS NOT NULL").orderBy(F.xxhash64("v")).toPandas()
    x = np.array([np.frombuffer(v, np.float32) for v in rows["v"]], np.float64).reshape(len(rows), sum(SIZES))
    langs = rows["lang"].to_numpy()
    family = np.array([family_of(k, families) for k in langs])
    known = {f: sorted({k for k, g in zip(langs, family) if g == f}) for f in sorted(set(family))}

    def against(names, of, part):
        out = []
        for a, b in combinations(names, 2):
            use = part & ((of == a) | (of == b))
            out.append(_machine(a, b, x[use], np.where(of[use] == a, 1.0, -1.0)))
        return out

    return Identifier(known, against(sorted(known), family, np.ones(len(x), bool)),
                      {f: against(names, langs, family == f) for f, names in known.items()})


def identify(docs: DataFrame, modulus: int = 5, held_out: int = 0, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row, fitted on the rows outside the held-out fold.

    Null texts and texts without letters are `und` with score 0, as is everything if no row has a language.
    Repeated rows and null keys give a row each; other columns are not read.
    """
    frame = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    fold = crc32_bucket("doc_id", modulus)
    model = fit(frame.filter(F.col("lang").isNotNull() & (fold != held_out)), **options)
    kind = frame.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # machines x 2048 numbers

    def work(texts):
        lang, score = shared.value.predict(texts)
        return {"lang_pred": lang, "score": score}

    scored = map_texts(frame, ["doc_id"], f"doc_id {kind}, lang_pred string, score double", work)
    return scored.select("doc_id", (fold == held_out).alias("held_out"), "lang_pred", "score")
