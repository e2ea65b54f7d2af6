"""Language by ranked character-trigram profiles and the out-of-place distance, as joins.

A text's trigrams come from its lower-cased letter runs, each padded with one space on both sides (" ab " gives
" ab" and "ab "; a one-letter word gives one trigram). A profile is the PROFILE_SIZE most frequent trigrams of a
language's training texts, ranked from 0 by count, ties by trigram (UTF-8 order); a document keeps its own
PROFILE_SIZE most frequent the same way. Out-of-place distance of a document to a language: over the document's
kept trigrams, |rank in document - rank in language|, or PROFILE_SIZE for a trigram outside the language's
profile. The nearest language wins, ties by code.

Spark work: words are counted per language (or document) with map-side partial sums and cut into trigrams once
each; the profile table (languages x PROFILE_SIZE rows) is stored once and broadcast only under a checked size,
else joined by shuffle; a document's trigrams are counted where the document lies. No stop-word list is needed, so any labelled language can be told apart.
Defined results: a null or letterless text has no trigrams and gets a null language and distance; training rows
with a null or empty lang are left out; an empty training table gives null for every document.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credence.operators.layout import broadcast_if_small, cut_lineage
from credence.operators.vectors import by_document

PROFILE_SIZE = 300
LETTERS = r"\p{L}+"


def words(text: Column) -> Column:
    """Lower-cased letter runs of a text, repeats kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(LETTERS), 0)


def trigram_counts(rows: DataFrame, group: str) -> DataFrame:
    """(group, gram, n) of (group, word) rows: words are counted first, so a word is cut up once a group."""
    counted = rows.groupBy(group, "word").agg(F.count(F.lit(1)).alias("_w")).withColumn(
        "_p", F.concat(F.lit(" "), "word", F.lit(" ")))
    grams = F.transform(F.sequence(F.lit(1), F.length("_p") - 2), lambda i: F.substring(F.col("_p"), i, 3))
    return counted.select(group, "_w", F.explode(grams).alias("gram")).groupBy(group, "gram").agg(F.sum("_w").alias("n"))


def _ranked(counts: DataFrame, group: str, size: int) -> DataFrame:
    order = Window.partitionBy(group).orderBy(F.col("n").desc(), F.col("gram").cast("binary"))
    return counts.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < size).drop("n")


def fit_profiles(train: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE_SIZE) -> DataFrame:
    """(lang, gram, rank): each language's `size` most frequent trigrams."""
    rows = train.where(F.col(lang).isNotNull() & (F.col(lang) != "")).select(
        F.col(lang).alias("lang"), F.explode(words(F.col(text))).alias("word"))
    return _ranked(trigram_counts(rows, "lang"), "lang", size)


def detect(docs: DataFrame, profiles: DataFrame, key: str, text: str = "text", size: int = PROFILE_SIZE) -> DataFrame:
    """(key, lang_pred, distance) for every row of docs."""
    # texts are hashed by document once; counting, ranking and scoring then happen where a document lies
    rows = by_document(docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")), "_k").select(
        "_k", F.explode(words(F.col("_t"))).alias("word"))
    own = _ranked(trigram_counts(rows, "_k"), "_k", size)
    own = own.withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy("_k")))
    profiles = cut_lineage(profiles)
    # one pass: trigrams outside every profile stay with a null language, so that a document keeps its count _m
    near = (own.join(broadcast_if_small(profiles.withColumnRenamed("rank", "_r")), "gram", "left")
            .groupBy("_k", "lang").agg(F.sum(size - F.abs(F.col("rank") - F.col("_r"))).alias("_saved"), F.max("_m").alias("_m")))
    # A language sharing a trigram saves at least 1, so it beats every language sharing none; when none shares
    # one, all are at the full distance and the first code wins: no pairing of documents with languages.
    distance = (F.col("_m") * size - F.col("_saved")).cast("long").alias("distance")
    whole = near.groupBy("_k").agg(
        F.max("_m").alias("_m"), F.min(F.when(F.col("lang").isNotNull(), F.struct(distance, "lang"))).alias("_b"))
    first = profiles.agg(F.min("lang")).first()[0]
    fallback = F.struct((F.col("_m") * size).cast("long").alias("distance"), F.lit(first).cast("string").alias("lang"))
    whole = whole.select("_k", F.when(F.lit(first is not None), F.coalesce("_b", fallback)).alias("_b"))
    return (docs.select(F.col(key).alias("_k")).join(whole, "_k", "left")
            .select(F.col("_k").alias(key), F.col("_b.lang").alias("lang_pred"), F.col("_b.distance").alias("distance")))
