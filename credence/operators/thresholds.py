"""Context keys, abstention thresholds per context, and their evaluation."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence import constants as K
from credence.functions.dates import age_days, bin_edges, lenient_timestamp
from credence.operators.layout import cut_lineage, lookup_join
from credence.operators.metrics import cost_of
from credence.operators.splits import stratified_split

GLOBAL = "*"


@dataclass(frozen=True)
class Costs:
    ok: float = 1.0
    c_fp: float = 5.0
    c_fn: float = 2.0
    c_abstain: float = 0.5

    def as_args(self) -> dict[str, float]:
        return {"ok": self.ok, "c_fp": self.c_fp, "c_fn": self.c_fn, "c_abstain": self.c_abstain}


def context_bins(df: DataFrame, today=None) -> DataFrame:
    """One column per context key; absent columns count as UNK, 0 or undated."""
    def has(c: str) -> bool:
        return c in df.columns

    def text_of(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("UNK")) if has(c) else F.lit("UNK")

    def number(c: str) -> Column:
        return F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if has(c) else F.lit(0.0)

    if has("text_n_tokens"):
        length = number("text_n_tokens")
    else:
        length = F.length(F.coalesce(F.col("text"), F.lit(""))) if has("text") else F.lit(0)
    stamp = lenient_timestamp(F.col("date_published")) if has("date_published") else F.lit(None).cast("timestamp")
    dated = df.withColumn("_ts", stamp)
    reference = F.lit(today).cast("timestamp") if today is not None else dated.agg(F.max("_ts")).scalar()
    return dated.withColumns({
        "ctx_source": text_of("source"),
        "ctx_category": text_of("category"),
        "ctx_len_bin": bin_edges(length, *K.LENGTH_BINS),
        "ctx_punc_bin": bin_edges(number("text_exclaim_qm_per_token"), *K.PUNCTUATION_BINS),
        "ctx_clickbait": F.when(number("title_clickbait_hits") > 0, F.lit("CB1")).otherwise(F.lit("CB0")),
        "ctx_hour_bin": bin_edges(F.coalesce(F.hour("_ts"), F.lit(-1)), *K.HOUR_BINS),
        "ctx_dow_bin": bin_edges(F.coalesce(F.extract(F.lit("DAYOFWEEK_ISO"), F.col("_ts")), F.lit(-1)), *K.WEEKDAY_BINS),
        "ctx_age_bin": bin_edges(age_days(F.col("_ts"), reference, K.UNKNOWN_AGE_DAYS), *K.AGE_BINS),
    }).drop("_ts")


def build_context(df: DataFrame, keys: tuple[str, ...] = K.CONTEXT_KEYS, today=None) -> DataFrame:
    """Add `ctx`, e.g. SOU=site|CAT=politics|LEN=M for the chosen keys."""
    parts = [F.concat(F.lit(f"{k[:3].upper()}="), F.col(f"ctx_{k}")) for k in keys]
    out = context_bins(df, today).withColumn("ctx", F.concat_ws("|", *parts))
    return out.drop(*[f"ctx_{k}" for k in K.CONTEXT_KEYS])


def grid_counts(df: DataFrame, groups: list[str], score: str = "p_fake", label: str = "label") -> DataFrame:
    """Per group: how many FAKE / REAL rows lie below every low and above every high threshold.

    The reward of a (low, high) pair is separable into these counts, so the whole grid costs one
    aggregate with map-side combine, whatever the number of pairs.
    """
    p, y = F.col(score), F.col(label)
    sides = {"lf": [(p < t) & (y == K.FAKE) for t in K.GRID_LOWS], "lr": [(p < t) & (y == K.REAL) for t in K.GRID_LOWS],
             "hf": [(p > t) & (y == K.FAKE) for t in K.GRID_HIGHS], "hr": [(p > t) & (y == K.REAL) for t in K.GRID_HIGHS]}
    counts = [F.count_if(c).alias(f"{s}{i}") for s, cs in sides.items() for i, c in enumerate(cs)]
    return df.groupBy(*groups).agg(F.count("*").alias("n"), *counts)


def best_pair(counts: DataFrame, costs: Costs) -> DataFrame:
    """Best pair of a row of grid counts; equal rewards go to the lower low, then the lower high."""
    arrays = {s: "array(" + ", ".join(f"{s}{i}" for i in range(10)) + ")" for s in ("lf", "lr", "hf", "hr")}
    pairs = ", ".join(
        f"named_struct('i', {i}, 'j', {j}, 'lo', {lo!r}D, 'hi', {hi!r}D)"
        for i, lo in enumerate(K.GRID_LOWS) for j, hi in enumerate(K.GRID_HIGHS) if lo < hi)
    gained = (f"(_lr[g.i] + _hf[g.j]) * {costs.ok!r}D - _hr[g.j] * {costs.c_fp!r}D - _lf[g.i] * {costs.c_fn!r}D "
              f"- (n - _lf[g.i] - _lr[g.i] - _hf[g.j] - _hr[g.j]) * {costs.c_abstain!r}D")
    covered = "(_lf[g.i] + _lr[g.i] + _hf[g.j] + _hr[g.j]) / n"
    best = (f"array_max(transform(array({pairs}), g -> named_struct('reward', ({gained}) / n, "
            f"'lo', -g.lo, 'hi', -g.hi, 'coverage', {covered})))")
    return counts.withColumns({f"_{s}": F.expr(a) for s, a in arrays.items()}).withColumn("_best", F.expr(best))


def search_thresholds(df: DataFrame, ctx: str = "ctx", score: str = "p_fake", label: str = "label",
                      min_samples: int = 100, costs: Costs = Costs()) -> DataFrame:
    """Thresholds per context, and the global ones as context '*'; small contexts use the global ones."""
    counts = grid_counts(df, [ctx], score, label)
    total = counts.agg(*[F.sum(c).alias(c) for c in counts.columns if c != ctx])
    overall = best_pair(total, costs)
    g = overall.select("_best").scalar()
    own = F.col("n") >= min_samples
    b = F.col("_best")
    per_context = best_pair(counts, costs).select(
        F.col(ctx).alias("ctx"),
        F.when(own, -b["lo"]).otherwise(-g["lo"]).alias("tau_low"),
        F.when(own, -b["hi"]).otherwise(-g["hi"]).alias("tau_high"),
        "n", F.when(own, F.lit("context")).otherwise(F.lit("global_fallback")).alias("used"),
        F.when(own, b["reward"]).alias("reward_best"), F.when(own, b["coverage"]).alias("coverage"))
    whole = overall.select(
        F.lit(GLOBAL).alias("ctx"), (-b["lo"]).alias("tau_low"), (-b["hi"]).alias("tau_high"), "n",
        F.lit("global").alias("used"), b["reward"].alias("reward_best"), b["coverage"].alias("coverage"))
    return per_context.unionByName(whole)


def lookup_thresholds(df: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Thresholds of a row's context, else the global ones."""
    pair = F.struct("tau_low", "tau_high")
    overall = thresholds.filter(F.col("ctx") == GLOBAL).agg(F.first(pair)).scalar()
    own = thresholds.filter(F.col("ctx") != GLOBAL).select("ctx", "tau_low", "tau_high")
    return lookup_join(df, own, "ctx").withColumns({
        c: F.coalesce(F.col(c), overall[c]) for c in ("tau_low", "tau_high")})


def decide(p: Column, low: Column, high: Column) -> Column:
    """0 FAKE, 1 REAL, -1 abstain; a score on a threshold abstains."""
    return F.when(p < low, F.lit(K.REAL)).when(p > high, F.lit(K.FAKE)).otherwise(F.lit(K.ABSTAIN))


def apply_thresholds(df: DataFrame, thresholds: DataFrame, score: str = "p_fake") -> DataFrame:
    out = lookup_thresholds(df, thresholds)
    out = out.withColumn("y_hat", decide(F.col(score), F.col("tau_low"), F.col("tau_high")))
    return out.withColumn("abstained", F.col("y_hat") == K.ABSTAIN)


def decision_summary(df: DataFrame, score: str = "p_fake", label: str = "label",
                     costs: Costs = Costs()) -> DataFrame:
    """Coverage, accuracy on covered rows, error counts and mean reward of applied thresholds."""
    h, y = F.col("y_hat"), F.col(label)
    covered = F.count_if(~F.col("abstained"))
    tp, fp = F.count_if((h == K.FAKE) & (y == K.FAKE)), F.count_if((h == K.FAKE) & (y == K.REAL))
    fn, correct = F.count_if((h == K.REAL) & (y == K.FAKE)), F.count_if(h == y)
    reward = cost_of(F.col(score), y, F.col("tau_low"), F.col("tau_high"), **costs.as_args())
    return df.agg(
        F.count("*").alias("n_val"),
        F.coalesce(F.try_divide(covered, F.count("*")), F.lit(0.0)).alias("coverage"),
        F.coalesce(F.try_divide(correct, covered), F.lit(0.0)).alias("accuracy_on_covered"),
        F.coalesce(F.try_divide(correct, F.count("*")), F.lit(0.0)).alias("effective_accuracy"),
        F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1_fake_on_covered"),
        fp.alias("fp"), fn.alias("fn"), F.count_if(F.col("abstained")).alias("abstain"),
        F.avg(reward).alias("reward_estimate"))


def calibrate(df: DataFrame, key: str, context_keys: tuple[str, ...] = K.CALIBRATION_KEYS,
              min_samples: int = 100, fraction: float = 0.2, seed: int = 42,
              costs: Costs = Costs()) -> tuple[DataFrame, DataFrame]:
    """(thresholds, validation summary) from the validation rows of a scored, featured table.

    The four columns the search needs are checkpointed, so the features are computed once.
    """
    val = build_context(stratified_split(df, key, fraction=fraction, seed=seed).filter("is_val"), context_keys)
    val = cut_lineage(val.select(key, "label", "p_fake", "ctx"))
    thresholds = cut_lineage(search_thresholds(val, min_samples=min_samples, costs=costs))
    return thresholds, decision_summary(apply_thresholds(val, thresholds), costs=costs)


def eval_with_thresholds(df: DataFrame, thresholds: DataFrame, key: str,
                         context_keys: tuple[str, ...] = K.CALIBRATION_KEYS,
                         fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Apply stored thresholds to the validation rows and summarise."""
    val = build_context(stratified_split(df, key, fraction=fraction, seed=seed).filter("is_val"), context_keys)
    val = cut_lineage(val.select(key, "label", "p_fake", "ctx"))
    return decision_summary(apply_thresholds(val, thresholds)).drop("reward_estimate")


def thresholds_report(thresholds: DataFrame) -> DataFrame:
    """One JSON document per context for the report sink."""
    return thresholds.select(F.to_json(F.struct(*thresholds.columns)).alias("report"))
