"""TF-IDF and other text vectors as long tables (key, term, weight).

Texts are hashed by document before they are exploded. Counting, weighting and normalising a document
then happen where it already lies; only per-term partial counts are shuffled for the vocabulary.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credence.functions.hashing import hash32
from credence.functions.text import blank_if_null
from credence.operators.layout import BROADCAST_ROWS, arrow_batches, broadcast_if_small, cut_lineage, is_small, running_totals
from credence.operators.profile import vector_tokens, word_grams


def model_text(df: DataFrame, prefer: tuple[str, ...] = ("titleplus_text_ns", "title_ns_text", "text_ns_text")) -> Column:
    """The first prepared text column there is, else title [SEP] text."""
    for c in prefer:
        if c in df.columns:
            return blank_if_null(F.col(c))
    title = blank_if_null(F.col("title")) if "title" in df.columns else F.lit("")
    text = blank_if_null(F.col("text")) if "text" in df.columns else F.lit("")
    return F.concat(title, F.lit(" [SEP] "), text)


def by_document(df: DataFrame, key: str) -> DataFrame:
    """Hash rows by document over all shuffle partitions."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), F.col(key))


def word_terms(df: DataFrame, key: str, text: str, low: int = 1, high: int = 2) -> DataFrame:
    """(key, term) rows of word n-grams; words are runs of two or more word characters."""
    tokens = by_document(df.select(key, text), key).select(key, vector_tokens(F.col(text)).alias("tokens"))
    return tokens.select(key, F.explode(word_grams(F.col("tokens"), low, high)).alias("term"))


def char_terms(df: DataFrame, key: str, text: str, low: int = 3, high: int = 5) -> DataFrame:
    """(key, term, n) rows of character n-grams inside space-padded words; a short word counts once.

    A document's words are counted first (they already lie together), so the many n-grams of a word
    are spelled out once per document, with the word's count as n.
    """
    rows = by_document(df.select(key, F.coalesce(text, F.lit("")).alias(text)), key)
    split = F.explode(F.split(F.lower(text), r"(?U)\s+")).alias("w")
    words = rows.select(key, split).filter(F.col("w") != "").groupBy(key, "w").agg(F.count("*").alias("n"))
    padded = words.select(key, F.concat(F.lit(" "), "w", F.lit(" ")).alias("w"), "n")
    grams = ", ".join(
        f"CASE WHEN length(w) > {n} THEN transform(sequence(1, length(w) - {n - 1}), i -> substring(w, i, {n})) "
        "ELSE array() END" for n in range(low, high + 1))
    whole = f"CASE WHEN length(w) <= {high} THEN array(w) ELSE array() END"
    return padded.select(key, F.explode(F.expr(f"concat({grams}, {whole})")).alias("term"), "n")


def term_counts(terms: DataFrame, key: str) -> DataFrame:
    times = F.sum("n") if "n" in terms.columns else F.count("*")
    return terms.groupBy(key, "term").agg(times.alias("tf"))


def fit_vocabulary(counts: DataFrame, n_docs: Column, min_df: int = 5, max_features: int | None = None) -> DataFrame:
    """Terms in at least min_df documents, the most frequent max_features of them, with smooth idf."""
    sums = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    return cut_vocabulary(sums, n_docs, min_df, max_features)


def cut_vocabulary(sums: DataFrame, n_docs: Column, min_df: int, max_features: int | None) -> DataFrame:
    """The same from the documents (df) and occurrences (cf) of every term."""
    vocab = sums.filter(F.col("df") >= min_df)
    if max_features is not None:
        vocab = most_frequent(cut_lineage(vocab), max_features)
    idf = F.log((n_docs + F.lit(1)) / (F.col("df") + 1)) + 1
    return vocab.select("term", "df", "cf", idf.alias("idf"))


def most_frequent(vocab: DataFrame, n: int) -> DataFrame:
    """The n terms with the largest cf, ties by term, of a stored vocabulary.

    The cut-off comes from the running number of terms per cf, so only the terms tied at it are ordered.
    """
    if is_small(vocab, n):
        return vocab
    levels = running_totals(vocab.groupBy("cf").agg(F.count("*").alias("n")), [], "cf", ["n"], ascending=False)
    beyond = levels.filter(F.col("cum_n") > n)
    cut, before = beyond.agg(F.max("cf"), F.max_by(F.col("cum_n") - F.col("n"), "cf")).first()
    tied = vocab.filter(F.col("cf") == cut).orderBy("term").limit(n - before)
    return vocab.filter(F.col("cf") > cut).unionByName(tied)


def weigh(counts: DataFrame, vocabulary: DataFrame, key: str, max_features: int | None = None) -> DataFrame:
    """(1 + ln tf) * idf per known term, scaled to unit length per document."""
    return _unit_weights(counts.join(_known(vocabulary, max_features), "term"), key)


def weigh_terms(terms: DataFrame, vocabulary: DataFrame, key: str, max_features: int | None = None) -> DataFrame:
    """The same from uncounted terms: most n-grams are rare, so unknown ones leave before the count."""
    if max_features is None or max_features > BROADCAST_ROWS:
        return weigh(term_counts(terms, key), vocabulary, key, max_features)
    times = F.sum("n") if "n" in terms.columns else F.count("*")
    kept = terms.join(_known(vocabulary, max_features), "term").groupBy(key, "term", "idf").agg(times.alias("tf"))
    return _unit_weights(kept, key)


def _known(vocabulary: DataFrame, max_features: int | None) -> DataFrame:
    """Terms and idf, broadcast only when the cap proves them small."""
    known = vocabulary.select("term", "idf")
    return F.broadcast(known) if max_features is not None and max_features <= BROADCAST_ROWS else known


def _unit_weights(counted: DataFrame, key: str) -> DataFrame:
    raw = (1 + F.log(F.col("tf").cast("double"))) * F.col("idf")
    length = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(key)))
    return counted.select(key, "term", raw.alias("_w")).select(key, "term", (F.col("_w") / length).alias("weight"))


def tfidf(terms: DataFrame, docs: DataFrame, key: str, min_df: int = 5,
          max_features: int | None = 200_000) -> tuple[DataFrame, DataFrame]:
    """(weights, vocabulary) of a corpus; docs gives the number of documents, empty ones included."""
    counts = term_counts(terms, key)
    vocabulary = fit_vocabulary(counts, docs.agg(F.count("*")).scalar(), min_df, max_features)
    return weigh_terms(terms, vocabulary, key, max_features), vocabulary


def tfidf_word(df: DataFrame, key: str, text: str, high: int = 2, min_df: int = 5, max_features: int | None = 200_000,
               together: bool = False) -> tuple[DataFrame, DataFrame]:
    """(weights, vocabulary) of word n-grams, counted beside their text as those of tfidf_char."""
    if not _capped(max_features):
        return tfidf(word_terms(df, key, text, 1, high), df, key, min_df, max_features)
    return _tfidf_texts(word_texts(df, key, text, in_place=True), df, key, word_grams_of(high), min_df, max_features, together)


def tfidf_char(df: DataFrame, key: str, text: str, low: int = 3, high: int = 5, min_df: int = 5,
               max_features: int | None = 150_000, together: bool = False) -> tuple[DataFrame, DataFrame]:
    """(weights, vocabulary) of character n-grams. Under a cap that proves the vocabulary small, a document's n-grams
    are counted beside its text and never become rows of their own: partial (df, cf) sums leave the first pass,
    weights of known terms the second. `together` hashes the weights by key for a reader that groups them: a document's
    are sent in one piece, which takes less than a row each."""
    if not _capped(max_features):
        return tfidf(char_terms(df, key, text, low, high), df, key, min_df, max_features)
    return _tfidf_texts(char_texts(df, key, text, in_place=True), df, key, char_grams_of(low, high), min_df, max_features, together)


def _capped(max_features: int | None) -> bool:
    return max_features is not None and max_features <= BROADCAST_ROWS


def _tfidf_texts(rows: DataFrame, df: DataFrame, key: str, kind: Kind, min_df: int, cap: int,
                 together: bool) -> tuple[DataFrame, DataFrame]:
    vocabulary = cut_lineage(text_vocabulary(rows, kind, df.agg(F.count("*")).scalar(), min_df, cap))
    return text_weights(rows, vocabulary, key, kind, cap, together), vocabulary


# ---- n-grams counted beside their text ---------------------------------------------------------------


def _texts_by_key(df: DataFrame, key: str, plain: Column, in_place: bool = False) -> DataFrame:
    """(key, _t): the prepared texts of a key; a repeated key is one row.

    Rows are hashed by key. In place, only rows whose key repeats are, and the others stay where they are read.
    """
    if not in_place:
        rows = by_document(df, key).select(key, plain.alias("_t"))
        return rows.groupBy(key).agg(F.collect_list("_t").alias("_t"))
    again = cut_lineage(df.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > 1).select(F.col(key).alias("_again")))
    alone = df.select(key, F.array(plain).alias("_t"))
    if again.isEmpty():
        return alone
    again = broadcast_if_small(again)
    repeats = F.col(key).eqNullSafe(F.col("_again"))
    return alone.join(again, repeats, "left_anti").unionByName(_texts_by_key(df.join(again, repeats, "left_semi"), key, plain))


def char_texts(df: DataFrame, key: str, text: str, in_place: bool = False) -> DataFrame:
    """Lower-cased texts with whitespace as single spaces."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+", " ")
    return _texts_by_key(df.select(key, text), key, plain, in_place)


def word_texts(df: DataFrame, key: str, text: str, in_place: bool = False) -> DataFrame:
    """The words of vector_tokens, joined by spaces."""
    return _texts_by_key(df.select(key, text), key, F.array_join(vector_tokens(F.col(text)), " "), in_place)


def char_grams_of(low: int, high: int) -> Kind:
    return partial(_CharGrams, low, high)


def word_grams_of(high: int) -> Kind:
    return partial(_WordGrams, 1, high)


def text_vocabulary(rows: DataFrame, kind: Kind, n_docs: Column, min_df: int, max_features: int) -> DataFrame:
    """fit_vocabulary over the n-grams of prepared texts: only partial (df, cf) sums leave a task.

    They leave as compressed batches of one hash part each, in the order of the terms: a fraction of the bytes that a row
    a term takes. A part's sums meet in one task.
    """
    spark = rows.sparkSession
    arrow_batches(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    partial_sums = rows.select("_t").mapInArrow(_gram_sums(kind, 4 * tasks), "part int, sums binary")
    sums = partial_sums.repartition(tasks, "part").select("sums").mapInArrow(_met_sums(min_df), "term string, df long, cf long")
    return cut_vocabulary(sums, n_docs, min_df, max_features)


def text_weights(rows: DataFrame, vocabulary: DataFrame, key: str, kind: Kind, max_features: int,
                 together: bool = False) -> DataFrame:
    """(key, term, weight) of prepared texts under a stored vocabulary, laid out as the texts are or hashed by key."""
    known = _sent(vocabulary, max_features)
    if not together:
        return rows.select(key, F.inline(_gram_weights(kind, known)("_t")))
    # no term holds a line break: words and character n-grams end at white space
    sent = by_document(rows.select(key, _joined_weights(kind, known)("_t").alias("_c")), key)
    terms = F.split("_c.terms", "\n")
    return sent.select(key, F.inline(F.arrays_zip(terms.alias("term"), F.col("_c.weights").alias("weight"))).alias("term", "weight"))


def text_vectors(rows: DataFrame, vocabulary: DataFrame, keys: DataFrame, key: str, kind: Kind, max_features: int,
                 out: str = "features") -> DataFrame:
    """to_vectors of text_weights under term_index, without a row per term: one vector per row of keys.

    Keys meet the texts, which are a fraction of their vectors, and vectors are made where they will lie."""
    place, _ = vector_maker(vocabulary, kind, max_features)
    return keys.join(rows.select(key, "_t"), key, "left").withColumn(out, place("_t")).drop("_t")


def vector_maker(vocabulary: DataFrame, kind: Kind, max_features: int):
    """The function that makes the vector of a document's prepared texts, and its length; without texts (null) it is empty."""
    known = _sent(vocabulary, max_features)
    return _gram_places(kind, known), len(known.value[0])


def _sent(vocabulary: DataFrame, max_features: int):
    """Terms in the order of term_index and their idf, broadcast: at most max_features rows pass through the driver."""
    arrow_batches(vocabulary.sparkSession)
    found = vocabulary.select("term", "idf").limit(max_features + 1).toArrow()
    if len(found) > max_features:
        raise ValueError(f"the vocabulary has more than {max_features} terms")
    cells = sorted(zip(found["term"].to_pylist(), found["idf"].to_pylist()))
    known = [t for t, _ in cells], np.array([i for _, i in cells], float)
    return vocabulary.sparkSession.sparkContext.broadcast(known)


# words a task remembers the n-grams of, and n-grams it sums at once; a full memory costs time, not results
WORD_MEMORY = 100_000
GRAM_MEMORY = 500_000


class _Numbers(dict):
    """Numbers in the order of first sight."""

    def __missing__(self, name: str) -> int:
        number = self[name] = len(self)
        return number


class _Grams:
    """Numbers for n-grams: all that are met, or only `known` ones under their given numbers."""

    def __init__(self, low: int, high: int, known: dict[str, int] | None = None):
        self.low, self.high, self.known = low, high, known
        self.ids = _Numbers()

    def numbers(self, grams: list[str]) -> np.ndarray:
        if self.known is None:
            return np.fromiter(map(self.ids.__getitem__, grams), np.int32, len(grams))
        return np.array([i for i in map(self.known.get, grams) if i is not None], np.int32)

    def full(self) -> bool:
        return len(self.ids) >= GRAM_MEMORY


class _WordGrams(_Grams):
    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of a document's n-grams and how often each occurs; none runs over the end of a text."""
        grams: list[str] = []
        for t in texts:
            words = t.split(" ") if t else []
            for n in range(self.low, self.high + 1):
                grams += words if n == 1 else map(" ".join, zip(*(words[i:] for i in range(n))))
        return np.unique(self.numbers(grams), return_counts=True)


class _CharGrams(_Grams):
    """Character n-grams inside space-padded words, remembered word by word."""

    def __init__(self, low: int, high: int, known: dict[str, int] | None = None):
        super().__init__(low, high, known)
        self.words: dict[str, np.ndarray] = {}

    def of(self, word: str) -> np.ndarray:
        found = self.words.get(word)
        if found is None:
            w = f" {word} "
            grams = [w[i:i + n] for n in range(self.low, self.high + 1) if len(w) > n for i in range(len(w) - n + 1)]
            if len(w) <= self.high:
                grams.append(w)
            found = self.words[word] = self.numbers(grams)
        return found

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words = Counter(w for t in texts for w in t.split(" ") if w)
        parts = [self.of(w) for w in words]
        if not parts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        times = np.repeat(np.fromiter(words.values(), np.int64, len(words)), [len(p) for p in parts])
        # number and count in one word: sorting whole numbers is several times faster than ordering pairs
        cells = np.sort((np.concatenate(parts).astype(np.int64) << 32) | times)
        if not len(cells):
            return np.zeros(0, np.int32), times
        ids = (cells >> 32).astype(np.int32)
        starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        return ids[starts], np.add.reduceat(cells & 0xFFFFFFFF, starts)

    def full(self) -> bool:
        return len(self.words) >= WORD_MEMORY or super().full()


# makes an n-gram counter, for all n-grams or for known ones
Kind = Callable[..., _Grams]


def _gram_sums(kind: Kind, parts: int):
    """Documents with each n-gram and its occurrences, summed over the texts a task has seen: one batch of a hash part's
    terms after the other, each compressed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, df, cf = kind(), np.zeros(0, np.int64), np.zeros(0, np.int64)

        def sums() -> Iterator[pa.RecordBatch]:
            if not grams.ids:
                return
            terms = pa.array(grams.ids, pa.string(), size=len(grams.ids))
            order = pc.array_sort_indices(terms).to_numpy()
            part = (pd.util.hash_array(np.array(list(grams.ids), object), categorize=False) % np.uint64(parts)).astype(np.int64)
            order = order[np.argsort(part[order], kind="stable")]
            yield from in_parts(part[order], pa.RecordBatch.from_arrays(
                [terms.take(pa.array(order)), pa.array(df[order]), pa.array(cf[order])], ["term", "df", "cf"]))

        for batch in batches:
            for texts in batch.column(0):
                ids, times = grams.counts(texts.as_py())
                if len(grams.ids) > len(df):
                    grown = max(len(grams.ids), 2 * len(df))
                    df, cf = np.pad(df, (0, grown - len(df))), np.pad(cf, (0, grown - len(cf)))
                df[ids] += 1
                cf[ids] += times
                if grams.full():
                    yield from sums()
                    grams, df, cf = kind(), np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield from sums()
    return run


def in_parts(part: np.ndarray, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(part, sums): rows that lie part by part, one compressed batch for each part."""
    ends = np.flatnonzero(np.diff(part, append=-1)) + 1
    for at, end in zip([0, *ends[:-1]], ends):
        cells = pa.BufferOutputStream()
        with pa.ipc.new_stream(cells, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_batch(rows.slice(at, end - at))
        yield pa.RecordBatch.from_arrays(
            [pa.array([part[at]], pa.int32()), pa.array([cells.getvalue().to_pybytes()], pa.binary())], ["part", "sums"])


def met_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """What in_parts has compressed."""
    for batch in batches:
        for cells in batch.column(0):
            yield pa.ipc.open_stream(cells.as_buffer()).read_all()


def _met_sums(min_df: int):
    """Sums of the parts' partial sums; terms in fewer than min_df documents leave."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: list[pa.Table] = []
        waiting, summed = 0, 0

        def together() -> pa.Table:
            sums = pa.concat_tables(met).group_by("term").aggregate([("df", "sum"), ("cf", "sum")])
            return sums.select(["term", "df_sum", "cf_sum"]).rename_columns(["term", "df", "cf"])

        for sums in met_parts(batches):
            met.append(sums)
            waiting += len(sums)
            if waiting > max(GRAM_MEMORY, summed):
                met[:] = [together()]
                waiting, summed = 0, len(met[0])
        if met:
            kept = together()
            yield from kept.filter(pc.greater_equal(kept["df"], min_df)).combine_chunks().to_batches(max_chunksize=100_000)
    return run


def _unit_cells(kind: Kind, known, batches: Iterator[pa.Array]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per batch of texts: offsets of the documents, then numbers and (1 + ln tf) * idf, at unit length, of their known n-grams."""
    places, idf = {t: i for i, t in enumerate(known.value[0])}, known.value[1]
    grams = kind(known=places)
    for batch in batches:
        numbers, weights, ends = [np.zeros(0, np.int32)], [np.zeros(0)], [0]
        for texts in batch:
            ids, times = grams.counts(texts.as_py() or [])
            raw = (1 + np.log(times)) * idf[ids]
            numbers.append(ids)
            weights.append(raw / np.sqrt(raw @ raw) if len(ids) else raw)
            ends.append(ends[-1] + len(ids))
            if grams.full():
                grams = kind(known=places)
        yield np.array(ends, np.int32), np.concatenate(numbers), np.concatenate(weights)


def _gram_weights(kind: Kind, known):
    @F.arrow_udf("array<struct<term:string,weight:double>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = pa.array(known.value[0], pa.string())
        for ends, numbers, weights in _unit_cells(kind, known, batches):
            cells = pa.StructArray.from_arrays([names.take(pa.array(numbers)), pa.array(weights)], ["term", "weight"])
            yield pa.ListArray.from_arrays(pa.array(ends), cells)
    return run


def _joined_weights(kind: Kind, known):
    """A document's known n-grams in one text, a line each, and their weights; without any, null."""
    @F.arrow_udf("struct<terms:string,weights:array<double>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = pa.array(known.value[0], pa.string())
        for ends, numbers, weights in _unit_cells(kind, known, batches):
            terms, cells = (pa.ListArray.from_arrays(pa.array(ends), x) for x in (names.take(pa.array(numbers)), pa.array(weights)))
            lines = pc.if_else(pa.array(np.diff(ends) > 0), pc.binary_join(terms, "\n"), None)
            yield pa.StructArray.from_arrays([lines, cells], ["terms", "weights"])
    return run


def _gram_places(kind: Kind, known):
    @F.arrow_udf(VectorUDT())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for ends, numbers, weights in _unit_cells(kind, known, batches):
            yield _sparse_cells(len(known.value[0]), ends, numbers, weights)
    return run


def _sparse_cells(size: int, ends: np.ndarray, numbers: np.ndarray, weights: np.ndarray) -> pa.Array:
    """Sparse MLlib vectors as Arrow holds them, of numbers that rise inside each vector."""
    n = len(ends) - 1
    lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x)) for x in (numbers.astype(np.int32), weights)]
    return pa.StructArray.from_arrays([pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), *lists],
                                      ["type", "size", "indices", "values"])


def word_vocabulary(df: DataFrame, key: str, text: str, high: int = 2, min_df: int = 5, max_features: int = 200_000) -> DataFrame:
    """fit_vocabulary of the word n-grams of all rows, counted beside their texts."""
    texts = word_texts(df, key, text, in_place=True)
    return text_vocabulary(texts, word_grams_of(high), df.agg(F.count("*")).scalar(), min_df, max_features)


def transform(df: DataFrame, vocabulary: DataFrame, key: str, text: str, high: int = 2,
              max_features: int | None = 200_000) -> DataFrame:
    """Weights of new texts under a fitted (stored or cheap) vocabulary."""
    if not _capped(max_features):
        return weigh_terms(word_terms(df, key, text, 1, high), vocabulary, key, max_features)
    return text_weights(word_texts(df, key, text), vocabulary, key, word_grams_of(high), max_features)


def concat_blocks(blocks: dict[str, DataFrame]) -> DataFrame:
    """Several long tables side by side: terms carry the name of their block."""
    parts = [w.withColumn("term", F.concat(F.lit(f"{name}:"), "term")) for name, w in blocks.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def numeric_columns(df: DataFrame, skip: tuple[str, ...] = ("label",)) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def numeric_rows(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Numeric columns as long rows as they are; nulls and zeros are left out."""
    pairs = F.array(*[F.struct(F.lit(c).alias("term"), F.col(c).cast("double").alias("weight")) for c in columns])
    return df.select(key, F.inline(pairs)).filter(F.col("weight") != 0)


def largest(rows: DataFrame) -> DataFrame:
    """(term, top): the largest absolute value of every column of long rows. Fitted on training rows."""
    return rows.groupBy("term").agg(F.max(F.abs("weight")).alias("top"))


def scale_by(rows: DataFrame, tops: DataFrame, key: str) -> DataFrame:
    """Long rows divided by fitted maxima (one row a column, so broadcast); a column without one is 0."""
    return rows.join(F.broadcast(tops), "term").select(key, "term", (F.col("weight") / F.col("top")).alias("weight"))


def numeric_block(df: DataFrame, key: str, columns: list[str], tops: DataFrame | None = None) -> DataFrame:
    """Numeric columns as long rows, zeros left out, scaled by given maxima or by those of df itself."""
    rows = numeric_rows(df, key, columns)
    return scale_by(rows, largest(rows) if tops is None else tops, key)


def max_abs_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """Divide by the largest absolute value of the column; null counts as 0."""
    top = df.agg(F.struct(*[F.max(F.abs(F.col(c).cast("double"))).alias(c) for c in columns])).scalar()
    return df.withColumns({
        c: F.coalesce(F.try_divide(F.col(c).cast("double"), top[c]), F.lit(0.0)) for c in columns})


def std_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """Divide by the population standard deviation without centring; constant columns stay."""
    spread = df.agg(F.struct(*[F.stddev_pop(F.col(c).cast("double")).alias(c) for c in columns])).scalar()
    return df.withColumns({
        c: F.col(c).cast("double") / F.when(spread[c] > 0, spread[c]).otherwise(F.lit(1.0)) for c in columns})


def term_index(vocabulary: DataFrame, max_features: int) -> DataFrame:
    """Column number per term; a table longer than the vocabulary's cap is an error, never cut."""
    if not is_small(vocabulary, max_features):
        raise ValueError(f"the vocabulary has more than {max_features} terms")
    return vocabulary.select("term", (F.row_number().over(Window.orderBy("term")) - 1).alias("index"))


def to_vectors(weights: DataFrame, index: DataFrame, keys: DataFrame, key: str, size: int,
               out: str = "features") -> DataFrame:
    """Sparse MLlib vectors, one per row of keys; a document's terms bound what is collected."""
    arrow_batches(keys.sparkSession)

    @F.arrow_udf(VectorUDT())
    def sparse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for cells in batches:
            ends = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(cells), 0).to_numpy())]
            numbers, values = (cells.flatten().field(f).to_numpy() for f in ("index", "weight"))
            rises = np.diff(numbers) > 0
            rises[ends[(ends > 0) & (ends < len(numbers))] - 1] = True
            if not rises.all():
                raise ValueError("a document has two weights of one term")
            yield _sparse_cells(size, ends, numbers, values)

    cells = (
        weights.join(broadcast_if_small(index), "term")
        .groupBy(key).agg(F.array_sort(F.collect_list(F.struct("index", "weight"))).alias("_cells"))
    )
    return keys.join(cells, key, "left").withColumn(out, sparse("_cells")).drop("_cells")


def hashed_embedding(df: DataFrame, key: str, text: str, dims: int = 64) -> DataFrame:
    """(key, dim, value): signed projection of the words to `dims` slots, scaled to unit length."""
    hashed = word_terms(df, key, text, 1, 1).select(key, hash32(F.col("term"), 11).alias("_h"))
    h = F.col("_h")
    sign = F.when(F.pmod(F.floor(h / dims), F.lit(2)) == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    # words add up in their slots without a count of their own: a task holds at most `dims` sums a document
    slots = hashed.select(key, F.pmod(h, F.lit(dims)).cast("int").alias("dim"), sign.alias("v"))
    sums = slots.groupBy(key, "dim").agg(F.sum("v").alias("v")).filter(F.col("v") != 0)
    length = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(key)))
    return sums.select(key, "dim", (F.col("v") / length).alias("value"))


def dense(slots: DataFrame, keys: DataFrame, key: str, dims: int, out: str = "embedding") -> DataFrame:
    """(key, dim, value) rows as one array of fixed length per row of keys; missing slots are 0."""
    maps = slots.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("dim", "value"))).alias("_map"))
    value = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at("_map", i), F.lit(0.0)))
    return keys.join(maps, key, "left").withColumn(out, value).drop("_map")


def unit_vectors(df: DataFrame, vector: str) -> DataFrame:
    """Scale an array column to unit length; a zero vector stays."""
    wide = F.transform(F.col(vector), lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    scaled = df.withColumn("_length", length)
    return scaled.withColumn(vector, F.transform(wide, lambda x: F.when(F.col("_length") > 0, x / F.col("_length")).otherwise(x))).drop("_length")


def embed_text(df: DataFrame, key: str, text: str, encode: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """Batch inference hook: `encode` turns a batch of texts into vectors, which come back at unit length."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = encode(batch[text].fillna("").tolist())
            yield pd.DataFrame({key: batch[key], "embedding": [list(map(float, v)) for v in vectors]})

    kind = df.schema[key].dataType.simpleString()
    return unit_vectors(df.select(key, text).mapInPandas(run, f"{key} {kind}, embedding array<double>"), "embedding")
