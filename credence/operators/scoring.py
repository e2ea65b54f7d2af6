"""P(FAKE) from fitted coefficients, and verdicts."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence import constants as K
from credence.operators.layout import broadcast_if_small


def verdict(p_fake: Column, threshold: float = 0.5) -> Column:
    return F.when(p_fake >= threshold, F.lit("FAKE")).otherwise(F.lit("REAL"))


def verdict_with_abstain(p_fake: Column, low: float = K.DEFAULT_TAU_LOW, high: float = K.DEFAULT_TAU_HIGH) -> Column:
    return (F.when(p_fake < low, F.lit("REAL")).when(p_fake > high, F.lit("FAKE")).otherwise(F.lit("ABSTAIN")))


def sigmoid(margin: Column) -> Column:
    return 1 / (1 + F.exp(-margin))


def linear_margin(weights: DataFrame, coefficients: DataFrame, keys: DataFrame, key: str,
                  intercept: float) -> DataFrame:
    """Margin towards FAKE per document: sum of weight * coefficient; documents without terms get the intercept.

    `coefficients` is a stored table; it is broadcast when it is short enough.
    """
    sums = (
        weights.join(broadcast_if_small(coefficients.select("term", "coef")), "term")
        .groupBy(key).agg(F.sum(F.col("weight") * F.col("coef")).alias("_sum"))
    )
    return keys.select(key).join(sums, key, "left").select(
        key, (F.coalesce("_sum", F.lit(0.0)) + F.lit(intercept)).alias("margin"))


def score_tfidf(weights: DataFrame, coefficients: DataFrame, keys: DataFrame, key: str,
                intercept: float = 0.0) -> DataFrame:
    """Verdict and P(FAKE) of the linear term model; the embedding column stays null."""
    p = linear_margin(weights, coefficients, keys, key, intercept).withColumn("prob_fake", sigmoid(F.col("margin")))
    return p.select(key, F.lit("tfidf").alias("model_used"), verdict(F.col("prob_fake")).alias("verdict"), "prob_fake",
                    F.col("prob_fake").alias("prob_fake_tfidf"), F.lit(None).cast("double").alias("prob_fake_emb"))


def dot(vector: Column, coefficients: list[float]) -> Column:
    """Dot product of an array column with constants of the same, small, length."""
    parts = F.zip_with(vector, F.array(*[F.lit(float(c)) for c in coefficients]), lambda a, b: a.cast("double") * b)
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def score_embedding(df: DataFrame, key: str, vector: str, coefficients: list[float],
                    intercept: float = 0.0) -> DataFrame:
    p = sigmoid(dot(F.col(vector), coefficients) + F.lit(intercept))
    return df.select(key, p.alias("prob_fake")).select(
        key, F.lit("emb").alias("model_used"), verdict(F.col("prob_fake")).alias("verdict"), "prob_fake",
        F.lit(None).cast("double").alias("prob_fake_tfidf"), F.col("prob_fake").alias("prob_fake_emb"))


def score_fusion(tfidf: DataFrame, emb: DataFrame, key: str, w_tfidf: float, w_emb: float,
                 intercept: float) -> DataFrame:
    """Meta logistic over the two base probabilities of FAKE."""
    both = tfidf.select(key, "prob_fake_tfidf").join(emb.select(key, "prob_fake_emb"), key)
    margin = F.col("prob_fake_tfidf") * w_tfidf + F.col("prob_fake_emb") * w_emb + F.lit(intercept)
    return both.withColumn("prob_fake", sigmoid(margin)).select(
        key, F.lit("fusion").alias("model_used"), verdict(F.col("prob_fake")).alias("verdict"), "prob_fake",
        "prob_fake_tfidf", "prob_fake_emb")
