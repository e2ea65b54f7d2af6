"""Fitted operators on a planted signal: better than the majority, repeatable, additive."""
import pytest
from pyspark.sql import functions as F

from credence.operators import explain as E
from credence.operators import metrics as M
from credence.operators import models as MD
from credence.operators import scoring as S
from credence.operators import vectors as V
from credence.operators.profile import vector_tokens


@pytest.fixture(scope="module")
def planted(spark):
    """FAKE texts say 'hoax', REAL ones 'report'; a tenth says the opposite."""
    rows = []
    for i in range(240):
        label = int(i % 3 != 0)
        word = ("hoax", "report")[label ^ (i % 10 == 7)]
        rows.append((i, label, f"{word} {word} filler{i % 5} story number{i % 7}"))
    return spark.createDataFrame(rows, "doc_id long, label int, mt string").repartition(4).persist()


def majority(df):
    n = {r["label"]: r["count"] for r in df.groupBy("label").count().collect()}
    return max(n.values()) / sum(n.values())


def test_term_model_beats_the_majority_and_explains_itself(spark, planted):
    model = MD.fit_tfidf_logit(planted, "doc_id", "mt", max_features=200, reg=1e-3, max_iter=20)
    scores = MD.score_terms(model, planted, "doc_id", "mt")
    assert M.evaluate_scores(scores.join(planted, "doc_id")).first()["accuracy"] > majority(planted) + 0.1
    coef = {r["term"]: r["coef"] for r in model.coefficients.collect()}
    assert coef["hoax"] > 0 > coef["report"]

    weights = model.weights(planted, "doc_id", "mt")
    effects = E.linear_contributions(weights, model.coefficients, planted, "doc_id")
    sums = effects.groupBy("doc_id").agg(F.sum("effect").alias("s"))
    margins = S.linear_margin(weights, model.coefficients, planted, "doc_id", 0.0)
    gaps = sums.join(margins, "doc_id").select((F.col("margin") - F.col("s")).alias("g"))
    low, high = gaps.agg(F.min("g"), F.max("g")).first()
    assert high - low < 1e-9

    tokens = planted.select("doc_id", vector_tokens(F.col("mt")).alias("tokens"))
    local = E.perturbation_explain(weights, model.coefficients, tokens, "doc_id", model.intercept, samples=60)
    hoax = local.filter("term = 'hoax'").agg(F.min("effect")).first()[0]
    assert hoax > 0
    again = E.perturbation_explain(weights.repartition(3), model.coefficients, tokens, "doc_id", model.intercept, samples=60)
    key = ["doc_id", "term"]
    assert [r["effect"] for r in local.orderBy(*key).collect()] == pytest.approx(
        [r["effect"] for r in again.orderBy(*key).collect()])


def test_incremental_learns(spark, planted):
    counts = V.term_counts(V.word_terms(planted, "doc_id", "mt"), "doc_id")
    vocabulary = V.fit_vocabulary(counts, planted.agg(F.count("*")).scalar(), 2, 200)
    parts = [planted.filter(F.col("doc_id") % 2 == i) for i in (0, 1)]
    _, curve = MD.fit_incremental(parts, planted, "doc_id", "mt", vocabulary, 200)
    got = {r["batch"]: r["val_accuracy"] for r in curve.collect()}
    assert len(got) == 2 and got[2] > 0.85


def test_calibrated_svm(spark, planted):
    weights, vocabulary = V.tfidf_word(planted, "doc_id", "mt", min_df=2, max_features=100)
    vocabulary = vocabulary.persist()
    rows = V.to_vectors(weights, V.term_index(vocabulary, 100), planted.select("doc_id", "label"), "doc_id", vocabulary.count())
    got = MD.fit_calibrated_svm(rows, "doc_id", max_iter=10).transform(rows)
    assert M.evaluate_scores(got).first()["accuracy"] > majority(planted) + 0.1
    low, high = got.agg(F.min("p_fake"), F.max("p_fake")).first()
    assert 0 <= low < 0.5 < high <= 1


def test_late_fusion_is_no_worse(spark, planted):
    scores = planted.select("doc_id", "label", ((1 - F.col("label")) * 0.5 + (F.col("doc_id") % 7) / 14).alias("p_tfidf"),
                            ((F.col("doc_id") % 5) / 5).alias("p_emb"))
    table = {r["model"]: r for r in MD.late_fusion(scores, scores)[1].collect()}
    assert set(table) == {"tfidf", "emb", "fusion"}
    assert table["fusion"]["roc_auc_fake"] >= table["emb"]["roc_auc_fake"]
