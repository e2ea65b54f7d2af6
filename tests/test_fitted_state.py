"""What a fit learned stays with the model: scores and explanations do not depend on the batch, and survive storage."""
import pytest
from pyspark.sql import functions as F

from credence.functions import text as T
from credence.operators import explain as E
from credence.operators import model_store as MS
from credence.operators import models as MD
from credence.operators import splits as G
from credence.operators import vectors as V
from credence.session import work_path
from credence.sources import sinks as W


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, int(i % 3 != 0), f"{'report' if i % 3 else 'hoax'} filler{i % 5} story number{i % 7}", float(i % 9)) for i in range(90)]
    return spark.createDataFrame(rows, "doc_id long, label int, mt string, n double").repartition(3).persist()


def by_key(df, value):
    return {r["doc_id"]: r[value] for r in df.collect()}


def test_numbers_keep_the_scale_of_the_training_rows(spark, texts):
    tops = V.largest(V.numeric_rows(texts, "doc_id", ["n"]))
    whole = by_key(V.numeric_block(texts, "doc_id", ["n"], tops), "weight")
    alone = by_key(V.numeric_block(texts.filter("doc_id = 4"), "doc_id", ["n"], tops), "weight")
    assert alone == {4: whole[4]} and whole[4] == 0.5
    assert V.numeric_block(texts.filter("doc_id < 0"), "doc_id", ["n"], tops).count() == 0


def test_term_model_survives_storage_and_explains_rows_alone(spark, texts):
    model = MD.fit_tfidf_logit(texts, "doc_id", "mt", max_features=50, min_df=2, reg=1e-3, max_iter=10)
    loaded = MS.load_term_model(spark, MS.save_term_model(model, work_path(spark, "model")))
    assert by_key(MD.score_terms(model, texts, "doc_id", "mt"), "p_fake") == pytest.approx(
        by_key(MD.score_terms(loaded, texts, "doc_id", "mt"), "p_fake"))

    def effects(rows):
        found = E.linear_contributions(loaded.weights(rows, "doc_id", "mt"), loaded.coefficients, rows, "doc_id", loaded.background)
        return {r["term"]: r["effect"] for r in found.filter("doc_id = 7").collect()}
    assert effects(texts.filter("doc_id = 7")) == pytest.approx(effects(texts))


def test_most_frequent_terms_equal_a_full_sort(spark):
    rows = [(f"t{i:03d}", 1 + i % 7, 1 + i % 7) for i in range(100)]
    vocab = spark.createDataFrame(rows, "term string, df long, cf long")
    for n in (1, 14, 15, 40, 99, 100, 200):
        want = [t for t, _, _ in sorted(rows, key=lambda r: (-r[2], r[0]))[:n]]
        assert sorted(r["term"] for r in V.most_frequent(vocab, n).collect()) == sorted(want)


def test_sample_equals_the_smallest_hashes(spark):
    df = spark.range(3000).withColumnRenamed("id", "k")
    want = [r["k"] for r in df.orderBy(G.hash32(F.col("k"), 3), "k").limit(20).collect()]
    assert [r["k"] for r in G.sample_rows(df, "k", 20, 3).collect()] == want
    # one key on every row: all or none pass the filter
    same = spark.range(500).select(F.lit(1).alias("k"))
    assert G.sample_rows(same, "k", 20, 3).count() == 20


def test_keys_without_rows_are_computed_once(spark):
    path, asked = work_path(spark, "cache"), []

    def compute(keys):
        asked.append(sorted(r["k"] for r in keys.select("k").collect()))
        return keys.filter("k % 2 = 0").select("k", (F.col("k") * 10).alias("v"))

    first = W.cached_rows(spark.createDataFrame([(1,), (2,)], "k long"), path, ["k"], compute)
    assert [tuple(r) for r in first.collect()] == [(2, 20)]
    again = W.cached_rows(spark.createDataFrame([(1,), (2,), (4,)], "k long"), path, ["k"], compute)
    assert sorted(tuple(r) for r in again.collect()) == [(2, 20), (4, 40)]
    assert asked == [[1, 2], [4]]


def test_language_by_script(spark):
    rows = [("he", "שלום עולם"), ("bn", "আমার সোনার"),
            ("en", "the cat and the dog ש"), (None, "123 !"), (None, ""), (None, None)]
    df = spark.createDataFrame(rows, "want string, t string").select("want", T.profile_tokens(F.col("t")).alias("tokens"))
    got = df.select("want", T.detect_lang("tokens", T.stop_word_profiles(["de", "en"])).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_bandit_history_follows_its_recursion(spark, texts):
    counts = V.term_counts(V.word_terms(texts, "doc_id", "mt"), "doc_id")
    vocabulary = V.fit_vocabulary(counts, texts.agg(F.count("*")).scalar(), 2, 50)
    _, history = MD.augmentation_bandit(texts, texts, "doc_id", "mt", vocabulary, 50, steps=3, batch=40)
    values = {}
    for r in history.orderBy("mini_epoch").collect():
        value, n = values.get(r["arm"], (0.0, 0))
        values[r["arm"]] = (0.8 * value + 0.2 * r["reward"], n + 1)
        assert 0 <= r["reward"] <= 1 and (r["value"], r["n"]) == pytest.approx(values[r["arm"]])
