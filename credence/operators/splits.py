"""Sampling, splitting and weighting by hashes of the row key: repeatable on any layout."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.functions.dates import lenient_timestamp
from credence.functions.hashing import hash32, uniform
from credence.operators.layout import broadcast_if_small, lookup_join, n_buckets, ranked


def _hash_rank(df: DataFrame, key: str, strata: list[str], seed: int) -> DataFrame:
    """Rank by hash inside each stratum; hash ranges are even by construction."""
    n = n_buckets(df)
    return ranked(df, strata, uniform(F.col(key), seed), [key], "_rank", bounds=[i / n for i in range(1, n)])


def stratified_split(df: DataFrame, key: str, label: str | None = "label", fraction: float = 0.2,
                     seed: int = 42, exact: bool = False) -> DataFrame:
    """Add `is_val`. Per-row draw without a shuffle, or (exact) the same share of every label."""
    if not exact:
        return df.withColumn("is_val", uniform(F.col(key), seed) < fraction)
    out = _hash_rank(df, key, [label] if label else [], seed)
    return out.withColumn("is_val", F.col("_rank") <= F.round(F.col("_rank_of") * fraction)).drop("_rank", "_rank_of")


def shuffled_split(df: DataFrame, key: str, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """A shuffled order cut at (1 - fraction) of the rows; the tail validates."""
    out = _hash_rank(df, key, [], seed)
    return out.withColumn("is_val", F.col("_rank") > F.floor(F.col("_rank_of") * (1.0 - fraction))).drop("_rank", "_rank_of")


def stratified_folds(df: DataFrame, key: str, label: str = "label", k: int = 5, seed: int = 42,
                     exact: bool = False) -> DataFrame:
    """Add `fold` in 0..k-1; exact deals every label evenly to the folds."""
    if not exact:
        return df.withColumn("fold", F.pmod(hash32(F.col(key), seed), F.lit(k)).cast("int"))
    out = _hash_rank(df, key, [label], seed)
    return out.withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).drop("_rank", "_rank_of")


def group_folds(df: DataFrame, group: str, k: int = 4) -> DataFrame:
    """Add `fold` so that no group is in two folds; at most as many folds as groups, at least two.

    Groups are dealt to the folds back and forth by falling size.
    """
    named = df.withColumn("_group", F.coalesce(F.col(group), F.lit("UNK")))
    sizes = named.groupBy("_group").agg(F.count("*").alias("_size"))
    order = ranked(sizes, [], -F.col("_size"), ["_group"], "_r")
    folds = F.least(F.lit(k), F.greatest(F.lit(2), F.col("_r_of"))).cast("bigint")
    turn, place = F.floor((F.col("_r") - 1) / folds), F.pmod(F.col("_r") - 1, folds)
    fold = F.when(turn % 2 == 0, place).otherwise(folds - 1 - place).cast("int")
    return lookup_join(named, order.select("_group", fold.alias("fold")), "_group").drop("_group")


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Add `weight` = n / (classes * n_class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    totals = counts.agg(F.struct(F.sum("_n").alias("n"), F.count("*").alias("k"))).scalar()
    weights = counts.select(label, (totals["n"] / (totals["k"] * F.col("_n"))).alias("weight"))
    # one row a class: broadcast after a look at the size, as hashing rows by two labels would fill two tasks
    return df.join(broadcast_if_small(weights), label, "left")


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows drawn uniformly: those with the n smallest hashes.

    Rows whose hash is too large for the sample leave first, so what meets in the last task is about n
    rows and not n of every task. Should fewer than n pass, all rows are ordered instead.
    """
    share = (n + 6 * n ** 0.5 + 10) / max(1, df.count())
    if share < 1:
        near = df.filter(uniform(F.col(key), seed) < share)
        if near.limit(n).count() == n:
            df = near
    return df.orderBy(hash32(F.col(key), seed), key).limit(n)


def time_order(df: DataFrame, key: str, date: str = "date_published") -> DataFrame:
    """Add `time_rank` (1-based) by publication time; undated rows come first."""
    ts = F.coalesce(F.unix_timestamp(lenient_timestamp(F.col(date))), F.lit(0))
    return ranked(df, [], ts, [key], "time_rank")


def time_split(df: DataFrame, key: str, date: str = "date_published", fraction: float = 0.2) -> DataFrame:
    """The latest rows validate."""
    out = time_order(df, key, date)
    return out.withColumn("is_val", F.col("time_rank") > F.floor(F.col("time_rank_of") * (1.0 - fraction))).drop("time_rank_of")
