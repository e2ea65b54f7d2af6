"""Fitted operators without SQL, on a planted signal small enough to fit in seconds."""
import pytest
from pyspark.sql import functions as F

from credence.operators import augment as A
from credence.operators import layout as Y
from credence.operators import metrics as M
from credence.operators import model_store as MS
from credence.operators import models as MD
from credence.operators import vectors as V
from credence.plans import pipelines as P
from credence.session import work_path
from credence.sources import adapters as AD

SMALL = MD.StackConfig(max_char=300, max_word=200, min_df=2, dims=8, rounds=2, depth=2, folds=2, max_iter=5, parallel=2)


@pytest.fixture(scope="module")
def planted(spark):
    """FAKE texts say 'hoax', REAL ones 'report'; n and the vector follow the label too, the source does not."""
    rows = [(i, int(i % 2), f"{('hoax', 'report')[i % 2]} filler{i % 5} story number{i % 7}", float(i % 2 * 5 + i % 3),
             [float(i % 2), float(i % 5)], f"s{i % 4}") for i in range(80)]
    schema = "doc_id long, label int, mt string, n double, emb array<double>, source string"
    return spark.createDataFrame(rows, schema).repartition(2).persist()


def test_boosted_trees_find_the_planted_number(spark, planted):
    index = spark.createDataFrame([("n", 0)], "term string, index long")
    rows = V.to_vectors(V.numeric_block(planted, "doc_id", ["n"]), index, planted.select("doc_id", "label"), "doc_id", 1)
    got = MD.fit_boosted_trees(rows, rounds=2, depth=2).transform(rows).withColumn("p_fake", MD.p_fake_of())
    assert M.evaluate_scores(got).first()["accuracy"] == 1.0


def test_truncated_svd_matches_numpy(spark, planted):
    import numpy as np
    weights, vocabulary = V.tfidf_word(planted, "doc_id", "mt", high=1, min_df=2, max_features=100)
    vocabulary = vocabulary.persist()
    rows = V.to_vectors(weights, V.term_index(vocabulary, 100), planted.select("doc_id"), "doc_id", vocabulary.count())
    projected, singular = MD.truncated_svd(rows, "doc_id", 3)
    matrix = np.array([r["features"].toArray() for r in rows.orderBy("doc_id").collect()])
    assert singular == pytest.approx(np.linalg.svd(matrix, compute_uv=False)[:3], rel=1e-4)
    found = np.array([r["components"] for r in projected.orderBy("doc_id").collect()])
    assert np.sqrt((found ** 2).sum(0)) == pytest.approx(singular, rel=1e-4)


def test_stack_is_scored_on_unseen_rows_and_survives_storage(spark, planted):
    rows = planted.filter("doc_id < 60").select("doc_id", "label", "mt", "n", "emb")
    new = planted.filter("doc_id >= 60").select("doc_id", "label", "mt", "n", "emb")
    stack, oof, _ = MD.stacking_oof(rows, "doc_id", "mt", "emb", ["n"], SMALL)
    assert sorted(r["doc_id"] for r in oof.select("doc_id").collect()) == list(range(60))
    assert oof.filter(" OR ".join(f"{c} NOT BETWEEN 0 AND 1" for c in MD.BASES)).count() == 0

    def scores(model, part):
        tables = MD.stack_tables(part, "doc_id", "mt", "emb", ["n"], SMALL)
        return {r["doc_id"]: r["p_fake"] for r in model.score(part, "doc_id", tables).collect()}

    whole = scores(stack, new)
    assert len(whole) == 20 and all((p > 0.5) == (i % 2 == 0) for i, p in whole.items())
    loaded = MS.load_stack(spark, MS.save_stack(stack, work_path(spark, "stack")))
    # a row scored alone, by the loaded stack, equals the row scored in its batch
    assert scores(loaded, new.filter("doc_id = 61"))[61] == pytest.approx(whole[61])

    log = new.select("doc_id", F.col("mt").alias("text")).dropDuplicates(["text"])
    labels = new.select(F.col("mt").alias("text"), "label").dropDuplicates(["text"])
    counts = MD.retrain_from_log(log, labels, loaded, "doc_id", MD.stack_tables(new, "doc_id", "mt", "emb", ["n"], SMALL))
    assert counts.first()["accuracy"] == 1.0


def test_repair_moves_crossed_thresholds_apart():
    genes = {"word_high": 1.4, "char_pair": 3, "min_df": 0, "log_c": 9.0, "use_numeric": 0.6}
    assert MD.repair(genes | {"tau_low": 0.9, "tau_high": 0.1}) == pytest.approx(
        {"word_high": 1, "char_pair": 1, "min_df": 2, "log_c": 2.0, "use_numeric": 1, "tau_low": 0.45, "tau_high": 0.55})
    assert MD.repair(genes | {"tau_low": 0.25, "tau_high": 0.75})["tau_low"] == 0.25


def test_search_prefers_the_possible_and_shares_fits(spark, planted, monkeypatch):
    base = {"word_high": 1, "char_pair": 0, "min_df": 2, "log_c": 0.0, "use_numeric": 0}
    candidates = [base | {"tau_low": 0.3, "tau_high": 0.7}, base | {"tau_low": 0.2, "tau_high": 0.8},
                  base | {"tau_low": 0.5, "tau_high": 0.5}]
    fits, fit = [], MD.fit_candidate
    monkeypatch.setattr(MD, "fit_candidate", lambda *a: fits.append(1) or fit(*a))
    got = MD.search_pipeline(planted, "doc_id", "mt", candidates, mode="cost", k=2, max_features=200, max_iter=5)
    rows = {r["candidate"]: r for r in got.collect()}
    # crossed thresholds are moved apart around their middle and share the fits of their kind
    assert len(fits) == 2 and (rows[2]["tau_low"], rows[2]["tau_high"]) == pytest.approx((0.45, 0.55))
    assert rows[2]["n_folds"] == 2 and rows[2]["fitness"] > 0
    # the wider band abstains at least as often, and every decision here is right
    assert rows[0]["fitness"] >= rows[1]["fitness"] > 0
    vectors, model, genes = MD.fit_best(planted, "doc_id", "mt", got, max_features=200, max_iter=5)
    assert genes["tau_low"] == pytest.approx(rows[0]["tau_low"])
    assert M.evaluate_scores(model.transform(vectors(planted.select("doc_id", "label")))).first()["accuracy"] == 1.0


def test_codes_are_imputed_from_the_text(spark, planted):
    code = F.when(F.col("doc_id") % 8 == 3, F.lit(None)).when(F.col("label") == 0, F.lit("a")).otherwise(F.lit("b"))
    df = planted.withColumn("category", code.cast("string"))
    got, _, report = MD.impute_codes(df, "doc_id", "category", ["mt"], ["source"], trees=5, depth=3)
    assert {r["doc_id"]: r["category_pred"] for r in got.collect()} == {i: "b" for i in range(80) if i % 8 == 3}
    assert report.filter("class = 'weighted'").first()["f1"] == 1.0


def test_known_texts_are_cut_into_words_once(spark, planted):
    odd = spark.createDataFrame([(100 + i, 0, t, 0.0, [0.0, 0.0], "s0") for i, t in enumerate([None, "", "!! ..", "hoax"])], planted.schema)
    df = planted.unionByName(odd).withColumn("category", F.when(F.col("label") == 0, "a").otherwise("b"))
    got, model, report = MD.impute_codes(df, "doc_id", "category", ["mt"], ["source"], trees=5, depth=3)
    # the report stands on count vectors: neither texts nor words are in its plan
    plan = report._jdf.queryExecution().toString()
    assert "mt_tf" in plan and "mt_w" not in plan
    assert report.filter("class = 'weighted'").first()["support"] == 17 and got.count() == 0
    # the stages of the pipeline, in its order, serve raw rows
    want = MD.code_pipeline(["mt"], ["source"], "category").getStages()
    assert [type(m).__name__.removesuffix("Model") for m in model.stages] == [
        type(s).__name__.replace("RandomForestClassifier", "RandomForestClassification") for s in want]
    new = spark.createDataFrame([("Hoax! Hoax", "s1", "a"), ("a report", "s9", "b")], "mt string, source string, category string")
    assert [r["prediction"] for r in model.transform(new).collect()] == [0.0, 1.0]


def test_meta_model_is_refitted_on_labelled_log_rows(spark, planted):
    base = planted.select("doc_id", (1 - F.col("label") * 0.8).alias("a"), F.lit(0.5).alias("b"))
    _, counts = MD.retrain_meta(planted.select("doc_id", "label").filter("doc_id < 30"), base, "doc_id", ["a", "b"])
    assert (counts.first()["n"], counts.first()["accuracy"]) == (30, 1.0)


def test_arm_with_the_best_value_is_chosen_without_exploring(spark):
    values = spark.createDataFrame([("x", 0.1, 3), ("y", 0.9, 2), ("z", 0.9, 1)], "arm string, value double, n long")
    assert A.choose_arm(values, "arm", 0, 0.0, 1).first()["arm"] in ("y", "z")
    drawn = {A.choose_arm(values, "arm", step, 1.0, 1).first()["arm"] for step in range(12)}
    assert len(drawn) > 1


def test_rank_cuts_one_crowded_value_by_its_ties(spark):
    # two thirds of the rows share one order value; ties are strings, one of them null
    df = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(F.lit(7)).alias("v"),
        F.when(F.col("id") != 4, F.format_string("k%05d", F.pmod(F.xxhash64("id"), F.lit(9000)))).alias("k")).persist()
    got = {r["id"]: r["rank"] for r in Y.ranked(df, [], "v", ["k", "id"], buckets=16).collect()}
    want = sorted(df.collect(), key=lambda r: (r["v"], r["k"] is not None, r["k"] or "", r["id"]))
    assert got == {r["id"]: i for i, r in enumerate(want, 1)}
    ranged = Y.split_ties(df.withColumn("_by", F.col("v")).withColumn("_bucket", (F.col("v") > 7).cast("double")), ["k", "id"], 16)
    sizes = [r["count"] for r in ranged.groupBy("_bucket", "_part").count().collect()]
    assert sum(sizes) == 3000 and max(sizes) < 900


def test_scores_of_no_rows(spark):
    none = spark.createDataFrame([], "label int, p_fake double")
    assert M.evaluate_scores(none).first()["n_val"] == 0
    assert M.evaluate_scores(none.withColumn("g", F.lit("x")), groups=["g"]).count() == 0


def test_copies_in_two_sources_keep_their_own_key(spark):
    df = spark.createDataFrame([("t", "some text", "REAL"), ("t", "some text", "REAL"), ("u", "other", "FAKE")],
                               "title string, text string, label string")
    part = AD.adapt_string_label(df)
    stored = P.feature_table([part, part], work_path(spark, "features"))
    assert (stored.count(), stored.select("doc_id").distinct().count()) == (6, 6)
