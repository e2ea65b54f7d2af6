"""Profiling and corpus statistics."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credence.functions import text as T
from credence.functions.labels import keyword_flag, super_category, url_risk
from credence.functions.urls import domain_extension


def profile_columns(df: DataFrame, columns: list[str] | None = None, samples: int = 20) -> DataFrame:
    """Nulls, distinct values (null counts as one) and up to `samples` smallest values per column.

    All columns are counted together as (column, value) pairs: one shuffle of map-side distinct pairs.
    """
    columns = columns or df.columns
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns
    ])).alias("p")).select("p.column_name", "p.value")
    counts = pairs.groupBy("column_name", "value").agg(F.count("*").alias("n"))
    totals = counts.groupBy("column_name").agg(
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(F.lit(0))).alias("n_null"),
        F.count("*").alias("n_distinct"))
    first = Window.partitionBy("column_name").orderBy("value")
    picked = (
        counts.filter("value IS NOT NULL").withColumn("r", F.row_number().over(first))
        .filter(F.col("r") <= samples)
        .groupBy("column_name")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "value"))), lambda s: s["value"]).alias("samples"))
    )
    return totals.join(picked, "column_name", "left")


SKETCH_LG_K = 14  # HLL registers 2^14: about 0.8 % relative error
SKETCH_SAMPLES = 20


def _column_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns
    ])).alias("p")).select("p.column_name", "p.value")


def profile_sketches(df: DataFrame, columns: list[str] | None = None, k: int = SKETCH_SAMPLES,
                     lg_k: int = SKETCH_LG_K) -> DataFrame:
    """Mergeable profile per column: n_rows, n_null, an HLL sketch of the values and a bottom-k sample.

    The sample is the k distinct values with the smallest 64-bit hash (ties by value): a uniform sample of the
    distinct values that two increments merge exactly. Only values under a hash threshold are shuffled; the
    threshold starts at about 4k values by the sketch's estimate and widens until k are found or none is left
    out, so no text but those few values crosses the network, however many distinct values a column has.
    """
    columns = columns or df.columns
    pairs = _column_pairs(df, columns)
    stats = pairs.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("value").isNull().cast("long")).alias("n_null"),
        F.hll_sketch_agg("value", lg_k).alias("sketch"))
    # one small row a column: kept on the driver so the columns are read once for the counts
    stats = df.sparkSession.createDataFrame(stats.collect(), stats.schema)
    estimates = {r["column_name"]: r["e"] for r in stats.select("column_name", F.hll_sketch_estimate("sketch").alias("e")).collect()}
    hashed = pairs.where(F.col("value").isNotNull()).withColumn("h", F.xxhash64("value"))
    share = {c: min(1.0, 4.0 * k / max(1, e)) for c, e in estimates.items()}
    found: dict[str, DataFrame] = {}
    while share:
        limits = F.create_map(*[x for c, f in share.items() for x in (F.lit(c), F.lit(_hash_limit(f)))])
        picked = (hashed.where(F.col("column_name").isin(list(share)) & (F.col("h") <= F.element_at(limits, F.col("column_name"))))
                  .select("column_name", "h", "value").distinct())
        order = Window.partitionBy("column_name").orderBy("h", "value")
        best = picked.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")
        best = best.sparkSession.createDataFrame(best.collect(), "column_name string, h long, value string")
        sizes = {r["column_name"]: r["n"] for r in best.groupBy("column_name").agg(F.count(F.lit(1)).alias("n")).collect()}
        done = [c for c, f in share.items() if sizes.get(c, 0) >= k or f >= 1.0]
        for c in done:
            found[c] = best.where(F.col("column_name") == c)
        share = {c: min(1.0, f * 8) for c, f in share.items() if c not in done}
    samples = None
    for part in found.values():
        samples = part if samples is None else samples.unionByName(part)
    if samples is None:
        return stats.withColumn("samples", F.array().cast("array<struct<h:bigint,value:string>>"))
    grouped = samples.groupBy("column_name").agg(F.array_sort(F.collect_list(F.struct("h", "value"))).alias("samples"))
    return stats.join(grouped, "column_name", "left").withColumn(
        "samples", F.coalesce("samples", F.array().cast("array<struct<h:bigint,value:string>>")))


def _hash_limit(share: float) -> int:
    """The signed 64-bit hash below which about `share` of all hashes lie."""
    return min(2 ** 63 - 1, -(2 ** 63) + int(share * 2 ** 64))


def merge_profiles(parts: DataFrame, k: int = SKETCH_SAMPLES) -> DataFrame:
    """Stored profiles of increments merged: counts add, sketches unite, bottom-k samples meet and are cut to k."""
    return parts.groupBy("column_name").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_null").alias("n_null"), F.hll_union_agg("sketch").alias("sketch"),
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("samples")))), 1, k).alias("samples"))


def profile_report(profiles: DataFrame) -> DataFrame:
    """column_name, n_rows, n_null, n_distinct (estimate; null counts as one value) and the samples joined by '|'."""
    return profiles.select(
        "column_name", "n_rows", "n_null",
        (F.hll_sketch_estimate("sketch") + (F.col("n_null") > 0).cast("long")).alias("n_distinct"),
        F.array_join(F.transform("samples", lambda s: s["value"]), "|").alias("samples"))


def code_frequencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """Value counts of several code columns in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
                      for c in columns])
    return (
        df.select(F.explode(pairs).alias("p")).groupBy("p.column_name", "p.value")
        .agg(F.count("*").alias("n"))
    )


def missing_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null, blank and valid values per column from one aggregate row."""
    def blank(c: str) -> Column:
        return F.regexp_replace(F.col(c).cast("string"), r"(?U)\s+", "") == ""

    counted = df.agg(*[F.struct(
        F.lit(c).alias("column_name"),
        F.count_if(F.col(c).isNull()).alias("n_null"),
        F.count_if(blank(c)).alias("n_blank"),
        (F.count("*") - F.count_if(F.col(c).isNull()) - F.count_if(blank(c))).alias("n_valid"),
    ).alias(c) for c in columns])
    return counted.select(F.inline(F.array(*columns)))


def text_missing(text: str = "text", url: str = "url") -> Column:
    """No text but a link to fetch it from."""
    return (F.col(text).isNull() | (F.col(text) == "")) & F.col(url).isNotNull() & (F.col(url) != "")


def recoverable_rows(df: DataFrame) -> DataFrame:
    return df.filter(text_missing()).agg(F.count("*").alias("n_recoverable"))


def top_words(df: DataFrame, label: int, stop_words: list[str], top_n: int = 25,
              text: str = "text") -> DataFrame:
    """Most frequent letters-only words of a label; equal counts in word order."""
    tokens = T.space_tokens(T.letters_only(F.col(text))).alias("tokens")
    return (
        df.filter(F.col("label") == label).select(tokens)
        .select(F.explode(T.without("tokens", stop_words)).alias("word"))
        .groupBy("word").agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "word").limit(top_n)
    )


def word_grams(tokens: Column, low: int, high: int) -> Column:
    """All n-grams of low..high neighbouring tokens.

    Tokens are read by place: slicing copies the whole array for every gram, quadratic in a long text.
    """
    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(tokens) - (n - 1))
        grams = F.transform(starts, lambda i: F.concat_ws(" ", *[F.element_at(tokens, i + k) for k in range(n)]))
        return F.when(F.size(tokens) >= n, grams).otherwise(F.array().cast("array<string>"))
    parts = [tokens if n == 1 else of(n) for n in range(low, high + 1)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def vector_tokens(c: Column) -> Column:
    """Lower-cased runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(T.blank_if_null(c)), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def ngram_frequencies(df: DataFrame, key: str, text: str, stop_words: list[str], low: int = 2, high: int = 2,
                      min_df: int = 1, max_df: float = 1.0) -> DataFrame:
    """Corpus frequency of n-grams after boilerplate and stop words are gone.

    Rows are laid out by document before the n-grams are taken, so counting per document needs no
    shuffle of its own; only (gram, partial counts) move afterwards.
    """
    n_docs = df.agg(F.count("*")).scalar()
    tokens = df.repartition(F.col(key)).select(
        key, vector_tokens(T.remove_boilerplate(F.col(text))).alias("tokens")
    ).select(key, T.without("tokens", stop_words).alias("tokens"))
    grams = tokens.select(key, F.explode(word_grams(F.col("tokens"), low, high)).alias("gram"))
    per_doc = grams.groupBy(key, "gram").agg(F.count("*").alias("tf"))
    return (
        per_doc.groupBy("gram").agg(F.sum("tf").alias("n"), F.count("*").alias("n_docs"))
        .filter((F.col("n_docs") >= min_df) & (F.col("n_docs") <= n_docs * F.lit(max_df)))
    )


def label_distribution(df: DataFrame, score: str) -> DataFrame:
    return df.groupBy("label").agg(
        F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.stddev_pop(score).alias("std_score"))


def one_hot(df: DataFrame, columns: list[str], max_values: int = 1000) -> DataFrame:
    """One 0/1 column per value, named column_value; a null row is 0 everywhere.

    The value list becomes the schema, so it must fit it: too many values are an error, never cut.
    """
    added = {}
    for c in columns:
        rows = df.select(c).filter(F.col(c).isNotNull()).distinct().limit(max_values + 1).collect()
        if len(rows) > max_values:
            raise ValueError(f"{c} has more than {max_values} values; encode it as a sparse vector")
        for v in sorted(r[0] for r in rows):
            added[f"{c}_{v}"] = F.coalesce((F.col(c) == v).cast("int"), F.lit(0))
    return df.withColumns(added)


def enrich(df: DataFrame) -> DataFrame:
    """Keyword flags, domain extension and risk, super-category, one-hot category and type."""
    out = df.withColumns({
        "title_has_keyword": keyword_flag(F.col("title")),
        "text_has_keyword": keyword_flag(F.col("text")),
        "domain_ext": domain_extension(F.col("url")),
        "domain_risk": url_risk(F.col("url")),
        "super_category": super_category(F.col("category")),
    })
    return one_hot(out, ["category", "type"]).drop("category", "type")
