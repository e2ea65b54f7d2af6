"""Evaluation as aggregates: confusion, curves, rewards, degradation."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credence import constants as K
from credence.operators.layout import cut_lineage, running_totals


def _share(a: Column, b: Column) -> Column:
    """a / b, 0 when b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def predicted_label(p_fake: Column, threshold: float = 0.5, strict: bool = True) -> Column:
    """FAKE above the threshold (at it too when not strict), else REAL."""
    fake = p_fake > threshold if strict else p_fake >= threshold
    return F.when(fake, F.lit(K.FAKE)).otherwise(F.lit(K.REAL))


def confusion_counts(df: DataFrame, label: str = "label", predicted: str = "predicted",
                     groups: list[str] | None = None) -> DataFrame:
    """Counts, accuracy, precision, recall and F1 with FAKE as the positive class, in one aggregate."""
    y, h = F.col(label), F.col(predicted)
    return confusion_shares(df.groupBy(*(groups or [])).agg(
        F.count("*").alias("n"),
        F.count_if((h == K.FAKE) & (y == K.FAKE)).alias("tp"),
        F.count_if((h == K.FAKE) & (y == K.REAL)).alias("fp"),
        F.count_if((h == K.REAL) & (y == K.FAKE)).alias("fn"),
        F.count_if((h == K.REAL) & (y == K.REAL)).alias("tn"),
    ))


def confusion_shares(counted: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 beside the counts."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counted.withColumns({
        "accuracy": _share(tp + tn, F.col("n")),
        "precision": _share(tp, tp + fp),
        "recall": _share(tp, tp + fn),
        "f1": _share(2 * tp, 2 * tp + fp + fn),
    })


def class_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class, and the support-weighted row `weighted`.

    The confusion pairs are counted first; everything after works on that small table.
    """
    pairs = df.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    sides = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("class"), F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(F.lit(0)).alias("hit"),
                 F.col("n").alias("support"), F.lit(0).cast("bigint").alias("called")),
        F.struct(F.col("p").alias("class"), F.lit(0).cast("bigint").alias("hit"),
                 F.lit(0).cast("bigint").alias("support"), F.col("n").alias("called")),
    )).alias("s")).select("s.*")
    per_class = sides.groupBy("class").agg(
        F.sum("hit").alias("hit"), F.sum("support").alias("support"), F.sum("called").alias("called"))
    per_class = per_class.select(
        F.col("class").cast("string").alias("class"),
        _share(F.col("hit"), F.col("called")).alias("precision"),
        _share(F.col("hit"), F.col("support")).alias("recall"),
        _share(2 * F.col("hit"), F.col("called") + F.col("support")).alias("f1"), "support")
    weighted = per_class.agg(
        F.lit("weighted").alias("class"),
        *[_share(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in ("precision", "recall", "f1")],
        F.sum("support").alias("support"))
    return per_class.unionByName(weighted)


def score_counts(df: DataFrame, score: str, label: str, groups: list[str]) -> DataFrame:
    """Rows (n), positives (FAKE) and negatives per distinct score: ties, and hot scores, become one row."""
    return df.groupBy(*groups, F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == K.FAKE).alias("pos"), F.count_if(F.col(label) == K.REAL).alias("neg"),
        F.count("*").alias("n"))


def curve_points(df: DataFrame, score: str = "p_fake", label: str = "label",
                 groups: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """Per distinct score: rows with it (pos, neg) and rows at or above it (cum_pos, cum_neg)."""
    groups = groups or []
    return cumulated(score_counts(df, score, label, groups), groups, buckets).drop("n")


def cumulated(counts: DataFrame, groups: list[str], buckets: int | None = None) -> DataFrame:
    return running_totals(counts, groups, "score", ["pos", "neg"], ascending=False, buckets=buckets)


def rank_quality(points: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Step-wise average precision and ROC-AUC in one pass over the curve.

    pr_auc: sum of precision times the recall gained at each score, 0 without positives.
    roc_auc: share of (positive, negative) pairs in the right order, ties half; null for one class.
    """
    precision = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    pairs = F.sum("pos") * F.sum("neg")
    wrong = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2))
    return points.groupBy(*(groups or [])).agg(
        _share(F.sum(F.col("pos") * precision), F.sum("pos")).alias("pr_auc"),
        F.when(pairs > 0, 1 - F.try_divide(wrong, pairs)).alias("roc_auc"))


def average_precision(points: DataFrame, groups: list[str] | None = None) -> DataFrame:
    return rank_quality(points, groups).drop("roc_auc")


def roc_auc(points: DataFrame, groups: list[str] | None = None) -> DataFrame:
    return rank_quality(points, groups).drop("pr_auc")


def roc_curve(points: DataFrame) -> DataFrame:
    """(threshold, fpr, tpr) per distinct score, plus the starting point with no threshold."""
    totals = points.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    p, n = totals.select("p").scalar(), totals.select("n").scalar()
    curve = points.select(
        F.col("score").alias("threshold"), F.try_divide(F.col("cum_neg"), n).alias("fpr"),
        F.try_divide(F.col("cum_pos"), p).alias("tpr"))
    start = totals.select(F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return curve.unionByName(start)


def evaluate_scores(df: DataFrame, score: str = "p_fake", label: str = "label",
                    groups: list[str] | None = None) -> DataFrame:
    """n, accuracy, F1 of FAKE at 0.5, PR-AUC and ROC-AUC (per group).

    The rows are read once, into counts per distinct score; everything after works on those.
    """
    keys = groups or []
    counts = cut_lineage(score_counts(df, score, label, keys))
    fake = predicted_label(F.col("score")) == K.FAKE

    def total(column: str, when: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, F.col(column))), F.lit(0))

    table = confusion_shares(counts.groupBy(*keys).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), total("pos", fake).alias("tp"), total("neg", fake).alias("fp"),
        total("pos", ~fake).alias("fn"), total("neg", ~fake).alias("tn")))
    # both sides are one row a group, so they are stacked and folded instead of joined
    found = ["n", "accuracy", "f1", "pr_auc", "roc_auc"]
    stacked = table.unionByName(rank_quality(cumulated(counts, keys), keys), allowMissingColumns=True)
    return stacked.groupBy(*keys).agg(*[F.max(c).alias(c) for c in found]).select(
        *keys, F.col("n").alias("n_val"), "accuracy", F.col("f1").alias("f1_fake"),
        F.col("pr_auc").alias("pr_auc_fake"), F.col("roc_auc").alias("roc_auc_fake"))


def area_under_degradation(df: DataFrame, metric: str = "pr_auc", name: str = "noise",
                           intensity: str = "intensity", baseline: str = "clean") -> DataFrame:
    """Per noise: trapezoid area of (clean metric - metric) over intensity."""
    missing = {metric, name, intensity} - set(df.columns)
    if missing:
        raise KeyError(f"missing columns: {sorted(missing)}")
    base = df.filter(F.col(name) == baseline).agg(F.first(metric)).scalar()
    order = Window.partitionBy(name).orderBy(intensity)
    drop = df.filter(F.col(name) != baseline).withColumn("_drop", base - F.col(metric))
    width = F.col(intensity) - F.lag(intensity).over(order)
    height = (F.col("_drop") + F.lag("_drop").over(order)) / 2
    return (
        drop.withColumn("_area", F.coalesce(width * height, F.lit(0.0)))
        .groupBy(name).agg(F.sum("_area").alias("area_under_degradation"))
    )


def cost_of(p: Column, label: Column, low: Column, high: Column, ok: float = 1.0, c_fp: float = 5.0,
            c_fn: float = 2.0, c_abstain: float = 0.5) -> Column:
    """Reward of one decision: below low says REAL, above high says FAKE, between abstains."""
    says_fake, says_real = p > high, p < low
    return (
        F.when(says_fake, F.when(label == K.FAKE, F.lit(ok)).otherwise(F.lit(-c_fp)))
        .when(says_real, F.when(label == K.REAL, F.lit(ok)).otherwise(F.lit(-c_fn)))
        .otherwise(F.lit(-c_abstain))
    )


def cost_reward(df: DataFrame, low: float, high: float, score: str = "p_fake", label: str = "label",
                groups: list[str] | None = None, **costs: float) -> DataFrame:
    value = cost_of(F.col(score), F.col(label), F.lit(low), F.lit(high), **costs)
    return df.groupBy(*(groups or [])).agg(F.avg(value).alias("reward"))


def margin_reward(said: Column, p_fake: Column, p_real: Column, gold: Column, ok: float = 1.0,
                  c_fp: float = 4.0, c_fn: float = 2.0, gamma: float = 0.2) -> Column:
    """Reward of a generated tag plus a share of the margin; other tags earn the margin only."""
    base = (
        F.when(said == K.TAG_FAKE, F.when(gold == K.FAKE, F.lit(ok)).otherwise(F.lit(-c_fp)))
        .when(said == K.TAG_REAL, F.when(gold == K.REAL, F.lit(ok)).otherwise(F.lit(-c_fn)))
        .otherwise(F.lit(0.0))
    )
    return base + gamma * F.abs(p_fake - p_real)


def model_comparison(scores: DataFrame, label: str = "label") -> DataFrame:
    """Accuracy, F1 and ROC-AUC per model of a long (model, label, p_fake) table."""
    return evaluate_scores(scores, "p_fake", label, ["model"])


def batch_history(scores: DataFrame, batch: str = "batch") -> DataFrame:
    """Validation accuracy and F1 after every batch."""
    judged = scores.withColumn("_hat", predicted_label(F.col("p_fake"), strict=False))
    return confusion_counts(judged, "label", "_hat", [batch]).select(
        batch, F.col("accuracy").alias("val_accuracy"), F.col("f1").alias("val_f1"))
