"""Fitting and scoring classifiers with MLlib. Labels stay 0 FAKE / 1 REAL; scores are P(FAKE)."""
from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier,
)
from pyspark.ml.feature import (
    IDF, CountVectorizer, IndexToString, OneHotEncoder, RegexTokenizer, StringIndexer, VectorAssembler,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from credence import constants as K
from credence.functions.hashing import hash32
from credence.operators import augment as A
from credence.operators import metrics as M
from credence.operators import splits as G
from credence.operators import vectors as V
from credence.operators.backfill import feedback_join
from credence.operators.layout import arrow_batches, broadcast_if_small, cut_lineage, solver_rows, stored
from credence.operators.scoring import linear_margin, sigmoid


def p_fake_of(probability: str = "probability", classes: tuple[int, ...] = (K.FAKE, K.REAL)) -> Column:
    """P(FAKE) picked by the order of the classes, not by a fixed column."""
    return F.element_at(vector_to_array(F.col(probability)), classes.index(K.FAKE) + 1)


def logit(features: str = "features", reg: float = 1e-5, weight: str | None = "weight", max_iter: int = 100) -> LogisticRegression:
    lr = LogisticRegression(featuresCol=features, labelCol="label", regParam=reg, maxIter=max_iter)
    return lr.setWeightCol(weight) if weight else lr


# ---- linear model on terms -----------------------------------------------------------------------


@dataclass
class TermModel:
    """A linear term model as tables: what batch scoring and explanations join with."""
    vocabulary: DataFrame
    coefficients: DataFrame
    intercept: float
    max_features: int
    # (term, mean): mean weight in the training texts, the background of explanations
    background: DataFrame | None = None

    def weights(self, df: DataFrame, key: str, text: str) -> DataFrame:
        return V.transform(df, self.vocabulary, key, text, max_features=self.max_features)


def fit_tfidf_logit(train: DataFrame, key: str, text: str, max_features: int = 200_000, min_df: int = 5,
                    fraction: float = 0.7, reg: float = 1e-5, seed: int = 42, max_iter: int = 100) -> TermModel:
    """Balanced log-loss linear model on the texts and their noised copies."""
    spark = train.sparkSession
    docs = train.select(key, text, "label")
    vocabulary = cut_lineage(V.word_vocabulary(docs, key, text, 2, min_df, max_features))
    index = V.term_index(vocabulary, max_features)
    noised = A.augment(docs, key, text, fraction=fraction, seed=seed)
    both = docs.select(F.concat(F.col(key).cast("string"), F.lit("#0")).alias("_row"), text, "label").unionByName(
        noised.select(F.concat(F.col(key).cast("string"), F.lit("#1")).alias("_row"), text, "label"))
    labelled = G.class_weights(both.select("_row", "label"))
    texts = V.word_texts(both, "_row", text)
    rows = solver_rows(cut_lineage(V.text_vectors(texts, vocabulary, labelled, "_row", V.word_grams_of(2), max_features)))
    model = logit(reg=reg, max_iter=max_iter).fit(rows)
    means = rows.filter(F.endswith("_row", F.lit("#0"))).agg(Summarizer.mean(F.col("features"))).first()[0]
    # the vocabulary cap bounds what passes through the driver here
    values = [(i, -float(c), float(m)) for i, (c, m) in enumerate(zip(model.coefficients.toArray(), means.toArray()))]
    fitted = spark.createDataFrame(values, "index long, coef double, mean double")
    terms = cut_lineage(index.join(fitted, "index").select("term", "coef", "mean"))
    return TermModel(vocabulary, terms.select("term", "coef"), -float(model.intercept), max_features,
                     terms.select("term", "mean"))


def term_margin(model: TermModel, df: DataFrame, key: str, text: str) -> DataFrame:
    return linear_margin(model.weights(df, key, text), model.coefficients, df, key, model.intercept)


def score_terms(model: TermModel, df: DataFrame, key: str, text: str) -> DataFrame:
    return term_margin(model, df, key, text).select(key, sigmoid(F.col("margin")).alias("p_fake"))


# ---- mini-batch updates ----------------------------------------------------------------------------


def sgd_step(coefficients: DataFrame, bias: float, weights: DataFrame, labels: DataFrame, key: str,
             rate: float, alpha: float = 1e-5) -> tuple[DataFrame, float]:
    """One log-loss gradient step towards FAKE: margins by document, gradient by term, both plain aggregates."""
    joined = weights.join(broadcast_if_small(coefficients), "term", "left")
    margins = joined.groupBy(key).agg(F.sum(F.col("weight") * F.coalesce("coef", F.lit(0.0))).alias("_m"))
    error = labels.join(margins, key, "left").select(
        key, (F.col("weight") * (sigmoid(F.coalesce("_m", F.lit(0.0)) + F.lit(bias))
                                 - (F.col("label") == K.FAKE).cast("double"))).alias("_e"))
    error = cut_lineage(error)
    n, total = error.agg(F.count("*"), F.coalesce(F.sum("_e"), F.lit(0.0))).first()
    if n == 0:
        return coefficients, bias
    gradient = weights.join(error, key).groupBy("term").agg((F.sum(F.col("weight") * F.col("_e")) / n).alias("_g"))
    updated = coefficients.join(gradient, "term", "left").select(
        "term", (F.col("coef") * (1 - rate * alpha) - rate * F.coalesce("_g", F.lit(0.0))).alias("coef"))
    return cut_lineage(updated), bias - rate * total / n


def fit_incremental(batches: list[DataFrame], validation: DataFrame, key: str, text: str, vocabulary: DataFrame,
                    max_features: int, rate: float = 5.0, arm: str | None = None,
                    seed: int = 42) -> tuple[TermModel, DataFrame]:
    """Update a term model batch by batch (texts plus noised copies); returns it with the validation curve."""
    coefficients = vocabulary.select("term", F.lit(0.0).alias("coef"))
    bias, curve = 0.0, None
    val_weights = cut_lineage(V.transform(validation, vocabulary, key, text, max_features=max_features))
    for number, batch in enumerate(batches, 1):
        noised = A.augment(batch, key, text, arm, seed=seed + number)
        for rows in (batch, noised):
            w = cut_lineage(V.transform(rows, vocabulary, key, text, max_features=max_features))
            labels = G.class_weights(rows.select(key, "label"))
            coefficients, bias = sgd_step(coefficients, bias, w, labels, key, rate)
        model = TermModel(vocabulary, coefficients, bias, max_features)
        margin = linear_margin(val_weights, coefficients, validation, key, bias)
        scored = validation.select(key, "label").join(margin, key).select(
            F.lit(number).alias("batch"), "label", sigmoid(F.col("margin")).alias("p_fake"))
        point = cut_lineage(M.batch_history(scored))
        curve = point if curve is None else curve.unionByName(point)
    return model, curve


# ---- embeddings, margins, trees ----------------------------------------------------------------------


def embedding_rows(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.select(key, "label", array_to_vector(F.transform(F.col(vector), lambda x: x.cast("double"))).alias("features"))


def fit_embedding_logit(train: DataFrame, reg: float = 1e-4, max_iter: int = 100):
    return logit(reg=reg, max_iter=max_iter).fit(G.class_weights(train))


@dataclass
class CalibratedSvm:
    """A linear margin with a sigmoid fitted on margins of rows the margin did not see."""
    svm: object
    sigmoid: object

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.svm.transform(df).withColumn("_margin", F.element_at(vector_to_array("rawPrediction"), 2))
        out = out.drop("prediction", "rawPrediction").withColumn("_cell", array_to_vector(F.array("_margin")))
        scored = self.sigmoid.transform(out)
        return scored.withColumn("p_fake", p_fake_of()).drop("_cell", "_margin", "rawPrediction", "probability", "prediction")


def fit_calibrated_svm(train: DataFrame, key: str, c: float = 1.0, inner: int = 3, max_iter: int = 50, seed: int = 7,
                       vectors: Callable[[DataFrame], DataFrame] | None = None) -> CalibratedSvm:
    """Balanced linear SVM; Platt's sigmoid on out-of-fold margins. `vectors` adds the features to rows of (key, label)
    once they are dealt to the folds, so that the deal moves keys and labels only."""
    dealt = G.stratified_folds(G.class_weights(train), key, k=inner, seed=seed, exact=True).withColumnRenamed("fold", "_inner")
    rows = solver_rows(cut_lineage(vectors(cut_lineage(dealt)) if vectors else dealt))
    reg = 1.0 / (c * max(1, rows.count()))
    svc = LinearSVC(labelCol="label", weightCol="weight", regParam=reg, maxIter=max_iter)

    def margins(i: int) -> DataFrame:
        model = svc.fit(rows.filter(F.col("_inner") != i))
        return model.transform(rows.filter(F.col("_inner") == i)).select(
            "label", "weight", array_to_vector(F.array(F.element_at(vector_to_array("rawPrediction"), 2))).alias("_cell"))

    with ThreadPoolExecutor(inner) as pool:
        parts = list(pool.map(margins, range(inner)))
    held_out = parts[0]
    for part in parts[1:]:
        held_out = held_out.unionByName(part)
    platt = LogisticRegression(featuresCol="_cell", labelCol="label", maxIter=50).fit(held_out)
    return CalibratedSvm(svc.fit(rows), platt)


def fit_boosted_trees(train: DataFrame, rounds: int = 400, depth: int = 6, rate: float = 0.1, rows: float = 0.8,
                      columns: float = 0.8, seed: int = 42):
    return GBTClassifier(labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=rows,
                         featureSubsetStrategy=str(columns), seed=seed).fit(train)


def sketch(weights: DataFrame, key: str, dims: int) -> DataFrame:
    """Random projection of term weights to `dims` slots by a signed hash: no fit, one pass."""
    h = hash32(F.col("term"), 23)
    sign = F.when(F.pmod(F.floor(h / dims), F.lit(2)) == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    return (
        weights.select(key, F.pmod(h, F.lit(dims)).alias("_slot"), (sign * F.col("weight")).alias("_v"))
        .groupBy(key, "_slot").agg(F.sum("_v").alias("weight"))
        .select(key, F.concat(F.lit("slot"), F.col("_slot")).alias("term"), "weight")
    )


def truncated_svd(rows: DataFrame, key: str, k: int, features: str = "features") -> tuple[DataFrame, np.ndarray]:
    """Top-k right singular vectors by MLlib's distributed solver, and the rows projected on them.

    The (vocabulary cap x k) matrix is the only thing the driver holds.
    """
    spark, rows = rows.sparkSession, cut_lineage(rows.select(key, features))
    # handed over as a frame, the rows stay in the JVM and in memory for the solver's passes
    kept = MLUtils.convertVectorColumnsFromML(rows.select(features), features).persist(StorageLevel.MEMORY_AND_DISK)
    svd = RowMatrix(kept).computeSVD(k, computeU=False)
    kept.unpersist()
    right = svd.V.toArray()
    rank = right.shape[1]
    shared = spark.sparkContext.broadcast(right)

    @F.arrow_udf("array<double>")
    def project(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for cells in batches:
            out = np.zeros((len(cells), rank))
            ends = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(cells.field("indices")), 0).to_numpy())]
            indices, values = (cells.field(f).flatten().to_numpy() for f in ("indices", "values"))
            for i, (at, end) in enumerate(zip(ends, ends[1:])):
                out[i] = values[at:end] @ shared.value[indices[at:end]]
            yield pa.array(list(out))

    arrow_batches(spark)
    return rows.select(key, project(features).alias("components")), np.asarray(svd.s.toArray())


# ---- late fusion and stacking -------------------------------------------------------------------------


def meta_rows(scores: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features").transform(scores)


def fit_meta(scores: DataFrame, columns: list[str], balanced: bool = False):
    """Logistic meta model over base probabilities of FAKE."""
    rows = meta_rows(scores, columns)
    return logit(reg=1e-4, weight="weight" if balanced else None).fit(G.class_weights(rows) if balanced else rows)


def score_meta(model, scores: DataFrame, columns: list[str]) -> DataFrame:
    return model.transform(meta_rows(scores, columns)).withColumn("p_fake", p_fake_of()).drop(
        "features", "rawPrediction", "probability", "prediction")


def late_fusion(train: DataFrame, val: DataFrame, tfidf: str = "p_tfidf", emb: str = "p_emb") -> tuple[object, DataFrame]:
    """Meta model on two base probabilities, and the comparison of the three on the validation rows."""
    model = fit_meta(train, [tfidf, emb])
    fused = score_meta(model, val, [tfidf, emb])
    rows = F.array(*[F.struct(F.lit(n).alias("model"), F.col(c).alias("p_fake"))
                     for n, c in (("tfidf", tfidf), ("emb", emb), ("fusion", "p_fake"))])
    return model, M.model_comparison(fused.select("label", F.inline(rows)))


@dataclass
class StackConfig:
    char_range: tuple[int, int] = (3, 5)
    max_char: int = 150_000
    max_word: int = 100_000
    min_df: int = 5
    dims: int = 300
    rounds: int = 400
    depth: int = 6
    folds: int = 5
    max_iter: int = 50
    parallel: int = 3
    seed: int = 42


BASES = ["p_svm", "p_trees", "p_emb"]


@dataclass
class Stack:
    """Fitted base learners and meta model; `score` is batch scoring of new rows."""
    config: StackConfig
    char_vocabulary: DataFrame
    word_vocabulary: DataFrame
    svm: CalibratedSvm
    trees: object
    emb: object
    meta: object = None
    numeric: list[str] = field(default_factory=list)
    # (term, top): largest absolute number per column of the training rows
    tops: DataFrame | None = None

    def base_scores(self, df: DataFrame, key: str, tables: dict[str, DataFrame]) -> DataFrame:
        cfg = self.config
        keys = df.select(key)
        char = _vectors(tables["char"], self.char_vocabulary, keys, key, cfg)
        word = _sketched(tables["word"], self.word_vocabulary, tables.get("numeric"), self.tops, keys, key, cfg, self.numeric)
        emb = keys.join(tables["emb"], key)
        scored = [
            self.svm.transform(char).select(key, F.col("p_fake").alias("p_svm")),
            self.trees.transform(word).select(key, p_fake_of().alias("p_trees")),
            self.emb.transform(emb).select(key, p_fake_of().alias("p_emb")),
        ]
        out = scored[0]
        for s in scored[1:]:
            out = out.join(s, key)
        return out

    def score(self, df: DataFrame, key: str, tables: dict[str, DataFrame]) -> DataFrame:
        return score_meta(self.meta, self.base_scores(df, key, tables), BASES)


def _char_kind(cfg: StackConfig) -> V.Kind:
    return V.char_grams_of(*cfg.char_range)


def _vectors(texts: DataFrame, vocabulary: DataFrame, keys: DataFrame, key: str, cfg: StackConfig) -> DataFrame:
    return V.text_vectors(texts, vocabulary, keys, key, _char_kind(cfg), cfg.max_char)


def _of(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of some keys; few keys are sent to the rows."""
    return rows.join(broadcast_if_small(keys.select(key)), key, "left_semi")


def _sketched(texts: DataFrame, vocabulary: DataFrame, numeric: DataFrame | None, tops: DataFrame | None,
              keys: DataFrame, key: str, cfg: StackConfig, names: list[str]) -> DataFrame:
    """Projected word weights followed by the numeric columns under fitted maxima; missing numbers are 0."""
    known = _of(texts, keys, key)
    weights = sketch(V.text_weights(known, vocabulary, key, V.word_grams_of(2), cfg.max_word), key, cfg.dims)
    if numeric is not None and names:
        weights = weights.unionByName(V.scale_by(_of(numeric, keys, key), tops, key))
    columns = [f"slot{i}" for i in range(cfg.dims)] + names
    index = keys.sparkSession.createDataFrame([(t, i) for i, t in enumerate(columns)], "term string, index long")
    return V.to_vectors(weights, index, keys, key, len(columns))


def stack_tables(df: DataFrame, key: str, text: str, vector: str, numeric: list[str], cfg: StackConfig) -> dict[str, DataFrame]:
    """Prepared texts, embeddings and numbers of the rows: computed once, shared by all folds. N-grams are counted beside
    their text where a vocabulary or vectors are made, as a row for each would be many times the texts."""
    docs = df.select(key, text)
    tables = {
        "char": stored(V.char_texts(docs, key, text, in_place=True)),
        "word": stored(V.word_texts(docs, key, text, in_place=True)),
        "emb": cut_lineage(df.select(key, array_to_vector(F.transform(F.col(vector), lambda x: x.cast("double"))).alias("features"))),
    }
    if numeric:
        tables["numeric"] = cut_lineage(V.numeric_rows(df, key, numeric))
    return tables


def fit_bases(rows: DataFrame, key: str, tables: dict[str, DataFrame], numeric: list[str], cfg: StackConfig) -> Stack:
    """Three base learners on the given rows; vocabularies and number maxima see these rows only."""
    rows = cut_lineage(rows.select(key, "label"))
    keys, n = rows.select(key), rows.agg(F.count("*")).scalar()
    vocabularies = [
        cut_lineage(V.text_vocabulary(_of(tables[t], keys, key), kind, n, cfg.min_df, cap))
        for t, kind, cap in (("char", _char_kind(cfg), cfg.max_char), ("word", V.word_grams_of(2), cfg.max_word))]
    tops = cut_lineage(V.largest(_of(tables["numeric"], keys, key))) if numeric else None
    word = cut_lineage(_sketched(tables["word"], vocabularies[1], tables.get("numeric"), tops, rows, key, cfg, numeric))
    emb = rows.join(tables["emb"], key)
    return Stack(
        cfg, *vocabularies,
        svm=fit_calibrated_svm(rows, key, max_iter=cfg.max_iter, vectors=lambda some: _vectors(tables["char"], vocabularies[0], some, key, cfg)),
        trees=fit_boosted_trees(word, cfg.rounds, cfg.depth, seed=cfg.seed),
        emb=fit_embedding_logit(emb, max_iter=cfg.max_iter), numeric=numeric, tops=tops)


def stacking_oof(df: DataFrame, key: str, text: str, vector: str, numeric: list[str],
                 cfg: StackConfig = StackConfig()) -> tuple[Stack, DataFrame, dict[str, DataFrame]]:
    """(stack refitted on all rows, out-of-fold base scores, shared tables).

    Folds are independent Spark jobs, submitted by a few threads.
    """
    tables = stack_tables(df, key, text, vector, numeric, cfg)
    rows = cut_lineage(G.stratified_folds(df.select(key, "label"), key, k=cfg.folds, seed=cfg.seed, exact=True))

    def fold(i: int) -> DataFrame:
        fitted = fit_bases(rows.filter(F.col("fold") != i), key, tables, numeric, cfg)
        held = rows.filter(F.col("fold") == i)
        return cut_lineage(held.join(fitted.base_scores(held, key, tables), key))

    with ThreadPoolExecutor(cfg.parallel) as pool:
        parts = list(pool.map(fold, range(cfg.folds)))
    oof = parts[0]
    for part in parts[1:]:
        oof = oof.unionByName(part)
    stack = fit_bases(rows, key, tables, numeric, cfg)
    stack.meta = fit_meta(oof, BASES, balanced=True)
    return stack, oof, tables


def retrain_meta(feedback: DataFrame, base_scores: DataFrame, key: str, columns: list[str]) -> tuple[object, DataFrame]:
    """Meta model refitted on labelled log rows; returns it with its accuracy and F1 on them."""
    rows = feedback.select(key, "label").join(base_scores, key)
    model = fit_meta(rows, columns)
    judged = score_meta(model, rows, columns).withColumn("predicted", M.predicted_label(F.col("p_fake")))
    return model, M.confusion_counts(judged)


def retrain_from_log(log: DataFrame, labels: DataFrame, stack: Stack, key: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Refit the meta model of a stored stack on logged texts whose labels arrived; base scores are computed here.

    log holds (key, text), labels (text, label). Changes stack.meta and returns its confusion counts.
    """
    known = cut_lineage(feedback_join(log, labels).select(key, "label"))
    scores = cut_lineage(stack.base_scores(known, key, tables))
    stack.meta, counts = retrain_meta(known, scores, key, BASES)
    return counts


# ---- augmentation bandit -----------------------------------------------------------------------------------


def augmentation_bandit(train: DataFrame, validation: DataFrame, key: str, text: str, vocabulary: DataFrame,
                        max_features: int, steps: int = 30, batch: int = 4096, fraction: float = 0.7,
                        rate: float = 5.0, alpha: float = 0.2, seed: int = 42) -> tuple[TermModel, DataFrame]:
    """Choose a noise, update the model on a noised sample, reward the noise by the validation PR-AUC.

    Returns the model and the history (mini_epoch, arm, reward, eps, value, n): one row a step, so the
    driver may keep it. value and n are those of the arm after its reward.
    """
    spark, history = train.sparkSession, []
    columns = "mini_epoch int, arm string, reward double, eps double, value double, n long"
    weights = cut_lineage(V.transform(validation, vocabulary, key, text, max_features=max_features))
    truth = cut_lineage(validation.select(key, "label"))
    coefficients, bias = vocabulary.select("term", F.lit(0.0).alias("coef")), 0.0
    arms = spark.createDataFrame([(a,) for a in A.ARMS], "arm string")
    for step in range(steps):
        eps = A.epsilon(step, steps)
        rewards = spark.createDataFrame(history, columns).select("arm", "mini_epoch", "reward")
        values = arms.join(A.arm_values(rewards, "arm", "mini_epoch", "mini_epoch", "reward", alpha), "arm", "left").select(
            "arm", F.coalesce("value", F.lit(0.0)).alias("value"), F.coalesce("n", F.lit(0)).alias("n"))
        chosen = A.choose_arm(values, "arm", step, eps, seed).first()
        sample = cut_lineage(G.sample_rows(train.select(key, text, "label"), key, batch, seed + step))
        noised = A.augment(sample, key, text, chosen["arm"], fraction, seed + step)
        known = cut_lineage(V.transform(noised, vocabulary, key, text, max_features=max_features))
        coefficients, bias = sgd_step(coefficients, bias, known, G.class_weights(sample.select(key, "label")), key, rate)
        margin = linear_margin(weights, coefficients, truth, key, bias)
        scored = cut_lineage(truth.join(margin, key).select("label", sigmoid(F.col("margin")).alias("p_fake")))
        reward = float(M.average_precision(M.curve_points(scored)).first()[0] or 0.0)
        history.append((step, chosen["arm"], reward, eps, (1 - alpha) * chosen["value"] + alpha * reward, chosen["n"] + 1))
    return TermModel(vocabulary, coefficients, bias, max_features), spark.createDataFrame(history, columns)


# ---- candidate search ------------------------------------------------------------------------------------

# fixed values: bounds of the search space
CHAR_PAIRS = [(3, 5), (4, 6)]
SPACE = {"word_high": (1, 2), "char_pair": (0, 1), "min_df": (2, 20), "log_c": (-3.0, 2.0),
         "use_numeric": (0, 1), "tau_low": (0.2, 0.5), "tau_high": (0.5, 0.8)}
IMPOSSIBLE = -1e12


# fixed values: how crossed thresholds are moved apart, and the pair used when that is not enough
TAU_GAP, TAU_LOW_MAX, TAU_HIGH_MIN, TAU_FALLBACK = 0.05, 0.49, 0.51, (0.3, 0.7)


def repair(candidate: dict) -> dict:
    """Clamp every gene to its bounds and round the whole-number ones; thresholds with low >= high are moved
    apart around their middle (low at most TAU_LOW_MAX, high at least TAU_HIGH_MIN), else set to TAU_FALLBACK."""
    out = {}
    for name, (low, high) in SPACE.items():
        value = min(max(candidate[name], low), high)
        out[name] = int(round(value)) if isinstance(low, int) else float(value)
    if out["tau_low"] >= out["tau_high"]:
        mid = 0.5 * (out["tau_low"] + out["tau_high"])
        out["tau_low"] = max(SPACE["tau_low"][0], min(TAU_LOW_MAX, mid - TAU_GAP))
        out["tau_high"] = min(SPACE["tau_high"][1], max(TAU_HIGH_MIN, mid + TAU_GAP))
        if out["tau_low"] >= out["tau_high"]:
            out["tau_low"], out["tau_high"] = TAU_FALLBACK
    return out


def repaired(candidates: DataFrame) -> DataFrame:
    """The same as column expressions, for a table of candidates; `possible` says the thresholds are ordered."""
    def gene(name: str, low, high) -> Column:
        value = F.least(F.greatest(F.col(name).cast("double"), F.lit(float(low))), F.lit(float(high)))
        return F.bround(value).cast("int") if isinstance(low, int) else value
    fixed = candidates.withColumns({n: gene(n, *b) for n, b in SPACE.items()})
    crossed = F.col("tau_low") >= F.col("tau_high")
    mid = (F.col("tau_low") + F.col("tau_high")) * 0.5
    low = F.greatest(F.lit(SPACE["tau_low"][0]), F.least(F.lit(TAU_LOW_MAX), mid - TAU_GAP))
    high = F.least(F.lit(SPACE["tau_high"][1]), F.greatest(F.lit(TAU_HIGH_MIN), mid + TAU_GAP))
    moved = fixed.withColumns({"_lo": F.when(crossed, low).otherwise(F.col("tau_low")),
                               "_hi": F.when(crossed, high).otherwise(F.col("tau_high"))})
    still = F.col("_lo") >= F.col("_hi")
    out = moved.withColumns({"tau_low": F.when(still, F.lit(TAU_FALLBACK[0])).otherwise(F.col("_lo")),
                             "tau_high": F.when(still, F.lit(TAU_FALLBACK[1])).otherwise(F.col("_hi"))}).drop("_lo", "_hi")
    return out.withColumn("possible", F.col("tau_low") < F.col("tau_high"))


def fit_candidate(rows: DataFrame, key: str, tables: dict[str, DataFrame], genes: dict, max_features: int, max_iter: int):
    """Margin model of one candidate on the given rows; returns a function from keys to vectors and the model."""
    keys, n = rows.select(key), rows.agg(F.count("*")).scalar()
    # blocks in this order, each by term, give the columns of one index over the terms of all blocks
    blocks = {"c": (tables["char"], V.char_grams_of(*CHAR_PAIRS[genes["char_pair"]]), 5),
              "w": (tables["word"], V.word_grams_of(genes["word_high"]), genes["min_df"])}
    vocabularies = {b: cut_lineage(V.text_vocabulary(_of(t, keys, key), kind, n, m, max_features)) for b, (t, kind, m) in blocks.items()}
    makers = {b: V.vector_maker(vocabularies[b], kind, max_features) for b, (_, kind, _) in blocks.items()}
    numbers = bool(genes["use_numeric"] and "numeric" in tables)
    if numbers:
        tops = cut_lineage(V.largest(_of(tables["numeric"], keys, key)))
        index = cut_lineage(V.term_index(tops, max_features))
        size = index.count()
        numbers = size > 0
    joined = VectorAssembler(inputCols=["_c", *(["_n"] if numbers else []), "_w"], outputCol="features")

    def vectors(some: DataFrame) -> DataFrame:
        # texts and numbers meet their key first: they are a fraction of the vectors made of them
        out = some
        for b, (t, _, _) in blocks.items():
            out = out.join(t.select(key, F.col("_t").alias(f"_{b}")), key, "left")
        if numbers:
            out = V.to_vectors(V.scale_by(_of(tables["numeric"], some, key), tops, key), index, out, key, size, "_n")
        out = out.withColumns({f"_{b}": place(f"_{b}") for b, (place, _) in makers.items()})
        # the assembler runs a job to find lengths it is not told
        for column, length in [*((f"_{b}", n) for b, (_, n) in makers.items()), *([("_n", size)] if numbers else [])]:
            out = out.withMetadata(column, {"ml_attr": {"num_attrs": length}})
        # and names every column of the vectors: each task of the solver would be sent all the names
        return joined.transform(out).drop("_c", "_n", "_w").withMetadata("features", {})

    model = fit_calibrated_svm(rows, key, 10.0 ** genes["log_c"], inner=2, max_iter=max_iter, vectors=vectors)
    return vectors, model


def search_tables(df: DataFrame, key: str, text: str, numeric: list[str], candidates: list[dict]) -> dict[str, DataFrame]:
    """Prepared texts that all candidates share, and the numbers if any candidate asks for them."""
    docs = df.select(key, text)
    tables = {"char": stored(V.char_texts(docs, key, text, in_place=True)), "word": stored(V.word_texts(docs, key, text, in_place=True))}
    if numeric and any(g["use_numeric"] for g in candidates):
        tables["numeric"] = cut_lineage(V.numeric_rows(df, key, numeric))
    return tables


def search_pipeline(df: DataFrame, key: str, text: str, candidates: list[dict], numeric: list[str] | None = None,
                    mode: str = "pr_auc", k: int = 4, max_features: int = 100_000, max_iter: int = 30,
                    parallel: int = 3, group: str | None = None) -> DataFrame:
    """Cross-validated fitness per candidate: PR-AUC of the held-out rows, or their mean cost reward.

    Folds with one class are left out; a candidate without a usable fold, or with low >= high, is
    impossible. Candidates that differ in thresholds only share their fits, and one aggregate rewards all
    their pairs. Fits and folds are jobs of a small thread pool.
    """
    genes = [repair(c) for c in candidates]
    tables = search_tables(df, key, text, numeric or [], genes)
    base = df.select(key, "label", *([group] if group else []))
    rows = cut_lineage(G.group_folds(base, group, k) if group else G.stratified_folds(base, key, k=k, exact=True))
    seen = {(r["fold"], r["label"]) for r in rows.select("fold", "label").distinct().collect()}
    folds = sorted({f for f, _ in seen})
    usable = [f for f in folds if len({y for g, y in seen if g == f}) == 2 and len({y for g, y in seen if g != f}) == 2]

    def fitness(job: tuple[tuple, int]) -> dict[int, float]:
        members, fold = shared[job[0]], job[1]
        g = genes[members[0]]
        vectors, model = fit_candidate(rows.filter(F.col("fold") != fold), key, tables, g, max_features, max_iter)
        scored = model.transform(vectors(rows.filter(F.col("fold") == fold))).select("label", "p_fake")
        if mode == "pr_auc":
            found = M.average_precision(M.curve_points(cut_lineage(scored))).first()[0]
            return dict.fromkeys(members, found)
        rewards = [F.avg(M.cost_of(F.col("p_fake"), F.col("label"), F.lit(genes[i]["tau_low"]), F.lit(genes[i]["tau_high"])))
                   for i in members]
        return dict(zip(members, scored.agg(*rewards).first()))

    shared: dict[tuple, list[int]] = {}
    for i, g in enumerate(genes):
        if g["tau_low"] < g["tau_high"]:
            shared.setdefault(tuple(v for n, v in g.items() if not n.startswith("tau")), []).append(i)
    jobs = [(kind, f) for kind in shared for f in usable]
    with ThreadPoolExecutor(parallel) as pool:
        results = list(pool.map(fitness, jobs))
    table = []
    for i, g in enumerate(genes):
        values = [r[i] for r in results if i in r]
        table.append((i, *[float(g[n]) for n in SPACE], len(values), float(np.mean(values)) if values else IMPOSSIBLE))
    return df.sparkSession.createDataFrame(
        table, "candidate int, " + ", ".join(f"{n} double" for n in SPACE) + ", n_folds int, fitness double")


def fit_best(df: DataFrame, key: str, text: str, results: DataFrame, numeric: list[str] | None = None,
             max_features: int = 100_000, max_iter: int = 30):
    """Refit the best candidate on all rows: (vectors function, model, its settings)."""
    best = results.orderBy(F.desc("fitness"), "candidate").first()
    genes = repair({n: best[n] for n in SPACE})
    tables = search_tables(df, key, text, numeric or [], [genes])
    vectors, model = fit_candidate(cut_lineage(df.select(key, "label")), key, tables, genes, max_features, max_iter)
    return vectors, model, genes


# ---- imputing codes -----------------------------------------------------------------------------------------


def code_pipeline(text_columns: list[str], code_columns: list[str], target: str, vocabulary: int = 300,
                  trees: int = 30, depth: int = 6, seed: int = 42) -> Pipeline:
    """TF-IDF per text column, one-hot codes (unseen codes ignored), multi-class forest, decoded label."""
    stages = []
    for c in text_columns:
        stages += [RegexTokenizer(inputCol=c, outputCol=f"{c}_w", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False),
                   CountVectorizer(inputCol=f"{c}_w", outputCol=f"{c}_tf", vocabSize=vocabulary),
                   IDF(inputCol=f"{c}_tf", outputCol=f"{c}_v")]
    indexed = [f"{c}_i" for c in code_columns]
    stages += [StringIndexer(inputCols=code_columns, outputCols=indexed, handleInvalid="keep"),
               OneHotEncoder(inputCols=indexed, outputCols=[f"{c}_h" for c in code_columns]),
               VectorAssembler(inputCols=[f"{c}_v" for c in text_columns] + [f"{c}_h" for c in code_columns],
                               outputCol="features")]
    labels = StringIndexer(inputCol=target, outputCol="label_i", handleInvalid="keep", stringOrderType="alphabetAsc")
    forest = RandomForestClassifier(labelCol="label_i", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[labels, *stages, forest])


def impute_codes(df: DataFrame, key: str, target: str, text_columns: list[str], code_columns: list[str],
                 **kw) -> tuple[DataFrame, object, DataFrame]:
    """(predictions for rows with an unknown code, fitted pipeline, per-class report on held-out rows).

    The known rows' texts are cut into words once and counted once: what the forest and the report go through again and
    again are short count vectors, in the rows' own layout. Fitted step by step, the stages are those of code_pipeline.
    """
    filled = df.withColumns({c: F.coalesce(c, F.lit("")) for c in text_columns}).withColumns(
        {c: F.coalesce(c, F.lit("unknown")) for c in code_columns}).withColumn(target, F.lower(F.coalesce(target, F.lit("unknown"))))
    filled = cut_lineage(filled.select(key, target, *text_columns, *code_columns))
    stages = code_pipeline(text_columns, code_columns, target, **kw).getStages()
    cutters, counters = ([s for s in stages if isinstance(s, kind)] for kind in (RegexTokenizer, CountVectorizer))
    known = G.stratified_split(filled.filter(F.col(target) != "unknown"), key, target, exact=True)
    for cut in cutters:
        known = cut.transform(known).drop(cut.getInputCol())
    words = [cut.getOutputCol() for cut in cutters]
    # words hold no space: joined, they take less room than as arrays
    known = cut_lineage(known.withColumns({w: F.array_join(w, " ") for w in words})).withColumns(
        {w: F.when(F.col(w) == "", F.array().cast("array<string>")).otherwise(F.split(w, " ")) for w in words})
    fitted = {c.uid: c.fit(known.filter("NOT is_val")) for c in counters}
    for counter in counters:
        known = fitted[counter.uid].transform(known).drop(counter.getInputCol())
    known = cut_lineage(known)
    rest = Pipeline(stages=[s for s in stages if s not in cutters and s not in counters])
    counted = rest.fit(known.filter("NOT is_val"))
    fitted |= {s.uid: m for s, m in zip(rest.getStages(), counted.stages)} | {cut.uid: cut for cut in cutters}
    model = PipelineModel([fitted[s.uid] for s in stages])
    decode = IndexToString(inputCol="prediction", outputCol=f"{target}_pred", labels=model.stages[0].labels)
    predicted = decode.transform(model.transform(filled.filter(F.col(target) == "unknown"))).select(key, f"{target}_pred")
    checked = decode.transform(counted.transform(known.filter("is_val")))
    return predicted, model, M.class_report(checked, target, f"{target}_pred")
