"""Bindings of the fitted operators. They have no SQL; tests/test_models.py checks their quality.

Vocabularies, sample counts and forests are the operators' defaults. The stack, the boosted trees, the candidate
search and the bandit repeat many small Spark jobs whose time does not shrink with the table, so they run with
the fewer rounds, folds, slots and iterations given here. The rows are always the whole labelled table.
"""
from __future__ import annotations

from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from catalog.evaluation import evaluated
from catalog.fixtures import CANON, canonical, scored, table
from catalog.profile import prediction_log
from catalog.registry import query, r6, r6s
from credence.functions.hashing import uniform
from credence.operators import backfill as B
from credence.operators import features as X
from credence.operators import metrics as M
from credence.operators import model_store as MS
from credence.operators import models as MD
from credence.operators import splits as G
from credence.operators import vectors as V
from credence.operators.layout import cut_lineage
from credence.session import work_path

WORD_CAP, CHAR_CAP = 200_000, 150_000
NUMBERS = ["text_n_chars", "text_n_tokens", "text_exc_qm", "text_upper_ratio", "text_ttr"]
ROUNDS, DEPTH = 8, 4
CONFIG = MD.StackConfig(dims=32, rounds=ROUNDS, depth=DEPTH, folds=3, max_iter=20)


def labelled(spark, sf_dir):
    df = canonical(spark, sf_dir).filter("label IS NOT NULL")
    return df.select("doc_id", "label", V.model_text(df).alias("mt"))


def full_rows(spark, sf_dir):
    """Label, text, five numbers and a hashed embedding per labelled article, stored once."""
    df = X.build_text_features(canonical(spark, sf_dir).filter("label IS NOT NULL"), drop_intermediate=False)
    df = df.select("doc_id", "label", V.model_text(df).alias("mt"), *NUMBERS)
    df = cut_lineage(df)
    return cut_lineage(V.dense(V.hashed_embedding(df, "doc_id", "mt"), df, "doc_id", 64))


def halves(df):
    split = cut_lineage(G.stratified_split(df, "doc_id", exact=True))
    return split.filter("NOT is_val").drop("is_val"), split.filter("is_val").drop("is_val")


@query("fit_tfidf_logit")
def fit_tfidf_logit(spark, sf_dir):
    train, val = halves(labelled(spark, sf_dir))
    model = MD.fit_tfidf_logit(train, "doc_id", "mt")
    return evaluated(M.evaluate_scores(MD.score_terms(model, val, "doc_id", "mt").join(val, "doc_id")))


@query("fit_incremental")
def fit_incremental(spark, sf_dir):
    train, val = halves(labelled(spark, sf_dir))
    vocabulary = cut_lineage(V.word_vocabulary(train, "doc_id", "mt", max_features=WORD_CAP))
    parts = G.stratified_folds(train, "doc_id", k=3, seed=9)
    batches = [parts.filter(F.col("fold") == i).drop("fold") for i in range(3)]
    return evaluated(MD.fit_incremental(batches, val, "doc_id", "mt", vocabulary, WORD_CAP)[1])


@query("fit_embedding_logit")
def fit_embedding_logit(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").selectExpr("vec_id AS doc_id", "embedding", "CAST(label % 2 AS INT) AS label")
    train, val = halves(MD.embedding_rows(df, "doc_id", "embedding"))
    scores = MD.fit_embedding_logit(train).transform(val).withColumn("p_fake", MD.p_fake_of())
    return evaluated(M.evaluate_scores(scores))


def char_vectors(spark, sf_dir, keyed=lambda df: df):
    """Character vectors of the labelled articles; `keyed` adds columns to keys and labels before the vectors join them."""
    df = labelled(spark, sf_dir)
    weights, vocabulary = V.tfidf_char(df, "doc_id", "mt", 3, 5, max_features=CHAR_CAP, together=True)
    vocabulary = cut_lineage(vocabulary)
    return V.to_vectors(weights, V.term_index(vocabulary, CHAR_CAP), keyed(df.select("doc_id", "label")), "doc_id", vocabulary.count())


@query("fit_calibrated_svm")
def fit_calibrated_svm(spark, sf_dir):
    # split before the vectors are made: ranks move keys and labels only
    rows = cut_lineage(char_vectors(spark, sf_dir, lambda df: G.stratified_split(df, "doc_id", exact=True)))
    train, val = rows.filter("NOT is_val").drop("is_val"), rows.filter("is_val").drop("is_val")
    return evaluated(M.evaluate_scores(MD.fit_calibrated_svm(train, "doc_id").transform(val)))


@query("fit_boosted_trees")
def fit_boosted_trees(spark, sf_dir):
    df = full_rows(spark, sf_dir)
    index = spark.createDataFrame(list(zip(NUMBERS, range(len(NUMBERS)))), "term string, index long")
    rows, new = halves(df)
    tops = cut_lineage(V.largest(V.numeric_rows(rows, "doc_id", NUMBERS)))
    train, val = (V.to_vectors(V.numeric_block(part, "doc_id", NUMBERS, tops), index, part.select("doc_id", "label"),
                               "doc_id", len(NUMBERS)) for part in (rows, new))
    scores = MD.fit_boosted_trees(train, rounds=ROUNDS, depth=DEPTH).transform(val).withColumn("p_fake", MD.p_fake_of())
    return evaluated(M.evaluate_scores(scores))


@query("proba_fake")
def proba_fake(spark, sf_dir):
    """P(FAKE) is the column of class 0, whatever the order of the classes."""
    df = table(spark, sf_dir, "embeddings").selectExpr("vec_id AS doc_id", "embedding", "CAST(label % 2 AS INT) AS label")
    scores = MD.fit_embedding_logit(MD.embedding_rows(df, "doc_id", "embedding")).transform(
        MD.embedding_rows(df, "doc_id", "embedding"))
    return scores.select("doc_id", MD.p_fake_of().alias("p_fake"), F.element_at(vector_to_array("probability"), 2).alias("p_real"))


def two_scores(spark, sf_dir):
    df = scored(spark, sf_dir).select("doc_id", "label", F.col("p_fake").alias("p_tfidf"))
    return df.withColumn("p_emb", uniform(F.col("doc_id"), 7) * 0.8 + (1 - F.col("label")) * 0.2)


@query("late_fusion")
def late_fusion(spark, sf_dir):
    train, val = halves(two_scores(spark, sf_dir))
    return evaluated(MD.late_fusion(train, val)[1])


@query("retrain_meta")
def retrain_meta(spark, sf_dir):
    feedback = B.feedback_join(prediction_log(spark, sf_dir), canonical(spark, sf_dir).select("text", "label"))
    base = two_scores(spark, sf_dir).drop("label")
    return evaluated(MD.retrain_meta(feedback, base, "doc_id", ["p_tfidf", "p_emb"])[1])


@query("stacking_oof")
def stacking_oof(spark, sf_dir):
    stack, oof, _ = MD.stacking_oof(full_rows(spark, sf_dir), "doc_id", "mt", "embedding", NUMBERS, CONFIG)
    both = cut_lineage(MD.score_meta(stack.meta, oof, MD.BASES))
    rows = F.array(*[F.struct(F.lit(c).alias("model"), F.col(c).alias("p_fake")) for c in (*MD.BASES, "p_fake")])
    return evaluated(M.model_comparison(both.select("label", F.inline(rows))))


@query("score_stacked")
def score_stacked(spark, sf_dir):
    """Unseen articles scored by a stack that was fitted out of fold on the others, stored and loaded again."""
    train, new = halves(full_rows(spark, sf_dir))
    fitted, _, _ = MD.stacking_oof(train, "doc_id", "mt", "embedding", NUMBERS, CONFIG)
    stack = MS.load_stack(spark, MS.save_stack(fitted, work_path(spark, "stack")))
    tables = MD.stack_tables(new, "doc_id", "mt", "embedding", NUMBERS, CONFIG)
    return evaluated(stack.score(new, "doc_id", tables).select("doc_id", *MD.BASES, "p_fake"))


@query("retrain_from_log")
def retrain_from_log(spark, sf_dir):
    """A stored stack's meta model refitted on logged texts, whose base scores are computed from the stored bases."""
    rows = full_rows(spark, sf_dir)
    old, logged = halves(rows)
    tables = MD.stack_tables(old, "doc_id", "mt", "embedding", NUMBERS, CONFIG)
    path = MS.save_stack(MD.fit_bases(old, "doc_id", tables, NUMBERS, CONFIG), work_path(spark, "stack"))
    stack = MS.load_stack(spark, path)
    log = logged.select("doc_id", F.col("mt").alias("text"))
    labels = logged.select(F.col("mt").alias("text"), "label")
    return evaluated(MD.retrain_from_log(log, labels, stack, "doc_id",
                                         MD.stack_tables(logged, "doc_id", "mt", "embedding", NUMBERS, CONFIG)))


@query("stored_term_model")
def stored_term_model(spark, sf_dir):
    """Scores of a term model before and after it was stored."""
    train, new = halves(labelled(spark, sf_dir))
    model = MD.fit_tfidf_logit(train, "doc_id", "mt")
    loaded = MS.load_term_model(spark, MS.save_term_model(model, work_path(spark, "term-model")))
    again = MD.score_terms(loaded, new, "doc_id", "mt").withColumnRenamed("p_fake", "p_loaded")
    return evaluated(MD.score_terms(model, new, "doc_id", "mt").join(again, "doc_id"))


@query("augmentation_bandit")
def augmentation_bandit(spark, sf_dir):
    train, new = halves(labelled(spark, sf_dir))
    vocabulary = cut_lineage(V.word_vocabulary(train, "doc_id", "mt", max_features=WORD_CAP))
    return evaluated(MD.augmentation_bandit(train, new, "doc_id", "mt", vocabulary, WORD_CAP, steps=6)[1])


CANDIDATES = [
    {"word_high": 1, "char_pair": 0, "min_df": 2, "log_c": 0.0, "use_numeric": 1, "tau_low": 0.3, "tau_high": 0.7},
    {"word_high": 2.2, "char_pair": 0, "min_df": 30, "log_c": -2.0, "use_numeric": 0, "tau_low": 0.5, "tau_high": 0.5},
]


@query("search_pipeline")
def search_pipeline(spark, sf_dir):
    return evaluated(MD.search_pipeline(full_rows(spark, sf_dir), "doc_id", "mt", CANDIDATES, NUMBERS, k=2, max_iter=10))


@query("fit_best")
def fit_best(spark, sf_dir):
    df = full_rows(spark, sf_dir)
    results = MD.search_pipeline(df, "doc_id", "mt", CANDIDATES, NUMBERS, "cost", k=2, max_iter=10)
    vectors, fitted, genes = MD.fit_best(df, "doc_id", "mt", results, NUMBERS, max_iter=10)
    model, genes = MS.load_best(spark, MS.save_best(fitted, genes, spark, work_path(spark, "best")))
    scores = model.transform(vectors(df.select("doc_id", "label")))
    return scores.select("doc_id", r6("p_fake").alias("p_fake"), F.lit(genes["tau_low"]).alias("tau_low"), F.lit(genes["tau_high"]).alias("tau_high"))


_GENES = {"word_high": "doc_id % 5 / 2.0", "char_pair": "doc_id % 4 - 1", "min_df": "doc_id % 31", "log_c": "doc_id % 9 - 4.4",
          "use_numeric": "doc_id % 2", "tau_low": "(doc_id % 10) / 12.5", "tau_high": "(doc_id % 7) / 8.0"}


def _gene_sql(name):
    low, high = MD.SPACE[name]
    value = f"least(greatest(CAST({_GENES[name]} AS DOUBLE), {low}::DOUBLE), {high}::DOUBLE)"
    return f"CAST(round_even({value}, 0) AS INTEGER) AS {name}" if isinstance(low, int) else f"{value} AS {name}"


_MOVE = f"""m AS (SELECT *, CASE WHEN tau_low >= tau_high THEN greatest(0.2::DOUBLE, least({MD.TAU_LOW_MAX}::DOUBLE,
      (tau_low + tau_high) * 0.5 - {MD.TAU_GAP}::DOUBLE)) ELSE tau_low END AS lo,
    CASE WHEN tau_low >= tau_high THEN least(0.8::DOUBLE, greatest({MD.TAU_HIGH_MIN}::DOUBLE,
      (tau_low + tau_high) * 0.5 + {MD.TAU_GAP}::DOUBLE)) ELSE tau_high END AS hi FROM g),
  r AS (SELECT * EXCLUDE (tau_low, tau_high, lo, hi), CASE WHEN lo >= hi THEN {MD.TAU_FALLBACK[0]}::DOUBLE ELSE lo END AS tau_low,
    CASE WHEN lo >= hi THEN {MD.TAU_FALLBACK[1]}::DOUBLE ELSE hi END AS tau_high FROM m)"""


@query("repair_candidates", f"""WITH g AS (SELECT doc_id, {', '.join(_gene_sql(n) for n in MD.SPACE)} FROM documents), {_MOVE}
    SELECT doc_id, word_high, char_pair, min_df, {r6s('log_c')} AS log_c, use_numeric, {r6s('tau_low')} AS tau_low,
    {r6s('tau_high')} AS tau_high, tau_low < tau_high AS possible FROM r""")
def repair_candidates(spark, sf_dir):
    raw = table(spark, sf_dir, "documents").selectExpr("doc_id", *[f"CAST({e} AS DOUBLE) AS {n}" for n, e in _GENES.items()])
    return evaluated(MD.repaired(raw))


def coded(spark, sf_dir):
    return canonical(spark, sf_dir).withColumn("category", F.when(F.col("doc_id") % 10 == 0, F.lit("unknown")).otherwise(F.col("category")))


@query("impute_codes")
def impute_codes(spark, sf_dir):
    df = coded(spark, sf_dir)
    predicted, _, _ = MD.impute_codes(df, "doc_id", "category", ["title", "text"], ["source", "type"])
    return B.inject_predictions(df, predicted, "doc_id", "category", "category_pred").select("doc_id", "category")


@query("impute_codes_report")
def impute_codes_report(spark, sf_dir):
    return evaluated(MD.impute_codes(coded(spark, sf_dir), "doc_id", "category", ["title", "text"], ["source", "type"])[2])


@query("categorical_encode", f"""WITH {CANON}, c AS (SELECT doc_id, coalesce(category, 'unknown') AS category FROM canon),
    r AS (SELECT doc_id, category, CAST(dense_rank() OVER (ORDER BY category) - 1 AS INTEGER) AS index FROM c)
    SELECT doc_id, category, index, array_to_string(list_transform(range((SELECT count(DISTINCT category) FROM c)),
      lambda i: CASE WHEN i = index THEN '1' ELSE '0' END), ',') AS hot FROM r""")
def categorical_encode(spark, sf_dir):
    df = canonical(spark, sf_dir).select("doc_id", F.coalesce("category", F.lit("unknown")).alias("category"))
    indexed = StringIndexer(inputCol="category", outputCol="index", handleInvalid="keep", stringOrderType="alphabetAsc").fit(df).transform(df)
    hot = OneHotEncoder(inputCol="index", outputCol="hot").fit(indexed).transform(indexed)
    return hot.select("doc_id", "category", F.col("index").cast("int").alias("index"),
                      F.array_join(F.transform(vector_to_array("hot"), lambda x: x.cast("int").cast("string")), ",").alias("hot"))


@query("truncated_svd")
def truncated_svd(spark, sf_dir):
    rows, _ = MD.truncated_svd(char_vectors(spark, sf_dir), "doc_id", 8)
    return rows.select("doc_id", F.size("components").alias("n_components"),
                       r6(F.sqrt(F.aggregate("components", F.lit(0.0), lambda s, x: s + x * x))).alias("length"))
