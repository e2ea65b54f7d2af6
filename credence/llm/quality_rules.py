"""Quality rules by compression bands.

zstandard ratios (bytes / compressed bytes) over the whole text and over fixed chunks are held against
length-specific limits: text that packs far better than prose of its length repeats itself, text that
packs far worse is not prose. The base counts that every quality rule set shares come with them.
Row-local: one narrow map, no shuffle; any row is judged alone, whatever table it is in.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm.common import map_texts, small_batches

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PCT = 30
CHUNK_BYTES = 4096
LEVEL = 3
# (least bytes, lowest ratio, highest ratio): prose of that length lies well inside. Frames and
# headers weigh on short texts, so these have lower limits.
BANDS = (
    (0, 0.0, 3.0), (128, 0.85, 3.0), (256, 1.05, 3.2), (512, 1.15, 3.4), (1024, 1.25, 3.6),
    (2048, 1.35, 3.8), (4096, 1.4, 4.2), (16384, 1.45, 5.0), (65536, 1.45, 6.0),
)
# Share of a text's whole chunks that may lie outside the band of their length.
MAX_BAD_CHUNKS = 0.5
SYMBOLS = "#*$%&|<>"
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur at least twice in the text, the first occurrence included.

    Windows are compared by a rolling 64-bit hash first; if any hash repeats, by exact ranks of doubled
    prefixes. Equal windows have equal hashes, so nothing is missed and collisions are not counted.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    value = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for i in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + value[i:i + n]
    order = np.sort(mixed)
    if not (order[1:] == order[:-1]).any():
        return 0
    ids: dict[bytes, int] = {}
    rank = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    step = 1
    while step < window:  # window is a power of two
        pair = rank[:-step] * (len(words) + 1) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1]
        step *= 2
    twice = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def duplicate_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def band(n_bytes: int, bands=BANDS) -> tuple[float, float]:
    """Lowest and highest ratio for a length."""
    return next((lo, hi) for least, lo, hi in reversed(bands) if n_bytes >= least)


class Compressor:
    """Ratios of whole texts and their chunks."""

    def __init__(self, chunk: int = CHUNK_BYTES, bands=BANDS, bad_share: float = MAX_BAD_CHUNKS):
        self.pack = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False).compress
        self.chunk, self.bands, self.bad_share = chunk, bands, bad_share

    def judge(self, raw: bytes) -> tuple[float, int, int, bool]:
        """(whole ratio, chunks, chunks outside their band, passed). Empty text: ratio 0, passed.

        Chunks are whole pieces of `chunk` bytes; a shorter tail counts in the whole ratio only.
        """
        if not raw:
            return 0.0, 0, 0, True
        whole = len(raw) / len(self.pack(raw))
        low, high = band(len(raw), self.bands)
        n = len(raw) // self.chunk if len(raw) > self.chunk else 0
        low_c, high_c = band(self.chunk, self.bands)
        bad = sum(not low_c <= self.chunk / len(self.pack(raw[i * self.chunk:(i + 1) * self.chunk])) <= high_c for i in range(n))
        return whole, n, bad, low <= whole <= high and bad <= self.bad_share * n


def statistics(texts: list[str], **limits) -> dict:
    """All counts and the verdict for each text."""
    judge = Compressor(**limits).judge
    out = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "ratio",
                           "n_chunks", "n_bad_chunks", "base_failed", "kept")}
    for text in texts:
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.split()  # bytes are split at exactly the six blanks of the word rule
        n, repeats = len(words), repeated_words(words)
        ratio, chunks, bad, passed = judge(raw)
        failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PCT * n
        row = (n, len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), duplicate_lines(raw),
               repeats, ratio, chunks, bad, failed, passed and not failed)
        for k, v in zip(out, row):
            out[k].append(v)
    return out


SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, "
          "n_chunks long, n_bad_chunks long, base_failed boolean, kept boolean")


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """One row per row of `docs`: counts, compression ratio, verdicts.

    A null text counts as one without words (base_failed). Repeated rows and null keys give a row each.
    Other columns are not read. An empty table gives an empty table.
    """
    frame = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = frame.schema["doc_id"].dataType.simpleString()
    return map_texts(frame, ["doc_id"], f"doc_id {kind}, {SCHEMA}", lambda t: statistics(t, **limits))


def keep_good(docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    """The rows that pass, with all their columns: the verdict is a filter in the scan's own stage."""
    small_batches(docs.sparkSession)
    verdict = F.pandas_udf(_verdicts(limits), "boolean")
    return docs.filter(verdict(F.col(text)))


def _verdicts(limits):
    def kept(texts: pd.Series) -> pd.Series:
        return pd.Series(statistics(["" if t is None else t for t in texts.tolist()], **limits)["kept"], dtype=bool)
    return kept
