"""What is written between the stages of a job, seen in the plans and the rows sent, with the results beside it."""
from pyspark.sql import functions as F

from credence.functions.hashing import position_hash, position_uniform
from credence.operators import augment as A
from credence.operators import explain as E
from credence.operators import models as MD
from credence.operators import vectors as V
from credence.operators import word_vectors as WV

ODD = [(1, "Aa bb aa, bb cc"), (1, "aa x bb"), (None, "aa bb"), (None, "bb dd"), (2, None), (3, " "), (4, "ÄÖ aa bb"), (5, "cc bb dd")]


def exchanges(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.count("Exchange hashpartitioning")


def odd(spark):
    return spark.createDataFrame(ODD, "id long, t string")


def cells(df):
    return sorted((str(r.id), r.term, round(r.weight, 9)) for r in df.collect())


def test_gram_sums_leave_in_compressed_parts(spark):
    texts = spark.createDataFrame([(i, f"same words w{i} again and again") for i in range(3000)], "id long, t string")
    rows = V.word_texts(texts.coalesce(1), "id", "t", in_place=True).select("_t")
    sums = rows.mapInArrow(V._gram_sums(V.word_grams_of(2), 3), "part int, sums binary").collect()
    assert sorted(r.part for r in sums) == [0, 1, 2]
    assert sum(len(r.sums) for r in sums) < 12 * 9000
    met = {r.term: (r.df, r.cf) for r in V.text_vocabulary(rows, V.word_grams_of(2), F.lit(3000), 2, 100).collect()}
    assert met["same"] == (3000, 3000) and met["again"] == (3000, 6000) and not any(t.startswith("w1") for t in met)


def test_texts_of_single_keys_stay_where_they_are(spark):
    single = odd(spark).filter("id > 1")
    assert exchanges(V.word_texts(single, "id", "t", in_place=True)) == 0
    for kind in (V.word_texts, V.char_texts):
        here, there = ({str(r.id): sorted(r._t) for r in kind(odd(spark), "id", "t", in_place=x).collect()} for x in (True, False))
        assert here == there and len(here["1"]) == 2 and len(here["None"]) == 2


def test_weights_of_a_document_are_sent_in_one_piece(spark):
    for fit in (V.tfidf_word, V.tfidf_char):
        (rows, _), (packed, vocabulary) = (fit(odd(spark), "id", "t", min_df=1, max_features=40, together=x) for x in (False, True))
        assert cells(rows) == cells(packed)
    coefficients = vocabulary.select("term", F.length("term").cast("double").alias("coef"))
    single = odd(spark).filter("id > 1")
    weights = V.tfidf_word(single, "id", "t", min_df=1, max_features=40, together=True)[0]
    assert exchanges(weights) == exchanges(E.occlusion(weights, coefficients, "id")) == 1


def test_svd_passes_stay_in_the_jvm(spark, monkeypatch):
    given = []
    solver = MD.RowMatrix
    monkeypatch.setattr(MD, "RowMatrix", lambda rows: given.append(rows) or solver(rows))
    weights, vocabulary = V.tfidf_word(odd(spark).filter("id > 1"), "id", "t", min_df=1, max_features=40)
    index = V.term_index(vocabulary, 40)
    vectors = V.to_vectors(weights, index, spark.createDataFrame([(2,), (4,), (5,)], "id long"), "id", index.count())
    rows, values = MD.truncated_svd(vectors, "id", 2)
    found = {r.id: r.components for r in rows.collect()}
    assert found[2] == [0.0, 0.0] and abs(sum(x * x for x in found[4]) - 1) < 1e-9 and len(values) == 2
    assert given[0].columns == ["features"]


def test_pairs_and_ids_need_no_join(spark, monkeypatch):
    texts = ["aa bb aa cc", "bb aa bb", "aa aa cc bb zz", None, "", "cc"] * 3
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    whole = sorted((r.word, r.context, r.n, round(r.ppmi, 9)) for r in WV.cooccurrence_ppmi(df, "text").collect())
    assert whole and not any("zz" in r[:2] for r in whole)
    monkeypatch.setattr(WV, "TOKENS", 3)
    monkeypatch.setattr(WV, "PAIRS", 2)
    ppmi = WV.cooccurrence_ppmi(df.repartition(3), "text")
    assert sorted((r.word, r.context, r.n, round(r.ppmi, 9)) for r in ppmi.collect()) == whole
    assert "Join" not in ppmi._jdf.queryExecution().optimizedPlan().toString()


def test_als_lets_go_of_its_shuffles(spark, monkeypatch):
    given = {}
    als = WV.ALS
    monkeypatch.setattr(WV, "ALS", lambda **kw: given.update(kw) or als(**kw))
    ppmi = spark.createDataFrame([("aa", "bb", 2, 0.5), ("bb", "aa", 2, 0.5), ("bb", "bb", 1, 0.2)], "word string, context string, n long, ppmi double")
    found = {r.word: r.vector for r in WV.fit_word_vectors(ppmi, rank=2, iterations=3).collect()}
    assert set(found) == {"aa", "bb"} and all(len(v) == 2 for v in found.values())
    assert given["checkpointInterval"] == WV.CHECKPOINTS < 5


def test_typos_of_all_characters_are_drawn_side_by_side(spark, monkeypatch):
    def one_by_one(c, seed, p):
        def change(ch, i):
            u = position_uniform(seed, i)
            return (F.when(u < p / 3, F.lit("")).when(u < 2 * p / 3, F.concat(ch, ch))
                    .when(u < p, A.pick(A.K.TYPO_ALPHABET, position_hash(seed, i, 1))).otherwise(ch))
        return F.array_join(F.transform(F.split(c, ""), change), "")

    monkeypatch.setattr(A, "DRAWS", 50)
    texts = ["", "a", "a\U0001F600b", "שלום hello world " * 9, None, "x\ty\nz"]
    df = spark.createDataFrame([(i, texts[i % 6]) for i in range(120)], "id long, t string")
    seed = F.when(F.col("id") % 11 > 0, F.col("id") * 7919 + 3)
    for p in (0.03, 0.9, F.when(F.col("id") % 5 > 0, F.lit(0.4))):
        got = df.select("id", "t", A.keyboard_typos(F.col("t"), seed, p).alias("got"), one_by_one(F.col("t"), seed, p).alias("want"))
        assert got.filter("NOT got <=> want").count() == 0
    assert got.filter("NOT got <=> t").count() > 30
    assert "lambdafunction" not in A.augment(df, "id", "t", "keyboard_typos")._jdf.queryExecution().optimizedPlan().toString()


def test_the_solver_is_not_sent_the_names_of_its_columns(spark, monkeypatch):
    given = []
    fit = MD.LinearSVC.fit
    monkeypatch.setattr(MD.LinearSVC, "fit", lambda self, rows, *a: given.append(rows) or fit(self, rows, *a))
    texts = [(i, i % 2, f"{'bad news' if i % 2 else 'good day'} number {i % 5}", float(i % 3)) for i in range(40)]
    df = spark.createDataFrame(texts, "id long, label int, t string, x double")
    genes = MD.repair({"word_high": 2, "char_pair": 0, "min_df": 2, "log_c": 0.0, "use_numeric": 1, "tau_low": 0.3, "tau_high": 0.7})
    tables = MD.search_tables(df, "id", "t", ["x"], [genes])
    vectors, model = MD.fit_candidate(df.select("id", "label"), "id", tables, genes, 300, 5)
    assert len(given) == 3 and all(rows.schema["features"].metadata == {} for rows in given)
    scored = model.transform(vectors(df.select("id", "label"))).collect()
    assert len(scored) == 40 and sum((r.p_fake > 0.5) == (r.label == 0) for r in scored) == 40


def test_the_deal_to_the_folds_moves_no_vectors(spark, monkeypatch):
    dealt = []
    deal = MD.G.stratified_folds
    monkeypatch.setattr(MD.G, "stratified_folds", lambda df, *a, **kw: dealt.append(df.columns) or deal(df, *a, **kw))
    df = spark.createDataFrame([(i, i % 2, ["bad news", "good day"][i % 2], [1.0, float(i % 2)]) for i in range(60)],
                               "id long, label int, t string, v array<double>")
    cfg = MD.StackConfig(dims=4, rounds=2, depth=2, folds=2, max_iter=5, min_df=1)
    tables = MD.stack_tables(df, "id", "t", "v", [], cfg)
    stack = MD.fit_bases(df.select("id", "label"), "id", tables, [], cfg)
    assert dealt and not any("features" in columns for columns in dealt)
    assert stack.base_scores(df, "id", tables).count() == 60
