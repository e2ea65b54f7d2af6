"""Work that must not grow faster than the input, seen in the plans, with the results beside it."""
from collections import Counter

from pyspark.sql import functions as F

from catalog import augment as CA
from credence.operators import backfill as B
from credence.operators import lang_profiles as LP
from credence.operators import profile as P
from credence.operators import vectors as V
from credence.operators import word_vectors as WV
from credence.operators.layout import solver_rows


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_word_grams_read_tokens_by_place(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["x"]), (3, [])], "id long, t array<string>")
    got = df.select("id", P.word_grams(F.col("t"), 1, 3).alias("g"))
    assert {r.id: r.g for r in got.collect()} == {1: ["a", "b", "c", "a b", "b c", "a b c"], 2: ["x"], 3: []}
    assert "slice(" not in plan(got)


def test_sweep_scores_each_text_once(spark, tmp_path):
    rows = [(i, f"text {i}! what? and more words", "en", "s", 10) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = CA.augmentation_sweep(spark, str(tmp_path))
    assert out.count() == 6
    assert "md5" not in plan(out)


def test_backfill_compares_only_asked_links(spark):
    df = spark.createDataFrame([(1, "u1", None), (2, "u1", ""), (3, "u2", "own"), (4, None, ""), (5, "u9", None)],
                               "id long, url string, text string")
    fetched = spark.createDataFrame([("u1", "ab"), ("u1", "abc"), ("u1", None), ("u2", "longer text")], "url string, scraped_text string")
    out = B.backfill_text(df, fetched)
    assert {r.id: r.text for r in out.collect()} == {1: "abc", 2: "abc", 3: "own", 4: None, 5: None}
    assert out.columns == ["id", "url", "text"]
    assert "LeftSemi" in plan(out)


def test_detect_reads_texts_once(spark):
    train = spark.createDataFrame([("the cat the cat", "en"), ("der hund der hund", "de")], "text string, lang string")
    docs = spark.createDataFrame([(1, "the cat"), (2, "hund"), (3, "12"), (4, None), (5, "zzz")], "id long, text string")
    out = LP.detect(docs, LP.fit_profiles(train), "id")
    found = {r.id: (r.lang_pred, r.distance) for r in out.collect()}
    assert found[1][0] == "en" and found[2][0] == "de" and found[3] == found[4] == (None, None)
    assert found[5] == ("de", 3 * LP.PROFILE_SIZE)
    assert plan(out).count("regexp_extract_all") == 1


def test_pairs_are_counted_by_ids_once(spark, monkeypatch):
    kept, store = [], WV.stored
    monkeypatch.setattr(WV, "stored", lambda df: kept.append(store(df)) or kept[-1])
    texts = ["aa bb aa cc", "bb aa bb", "aa aa cc bb", None, ""]
    got = {(r.word, r.context): r.n for r in WV.cooccurrence_ppmi(
        spark.createDataFrame([(t,) for t in texts], "text string"), "text", min_count=1).collect()}
    want = Counter()
    for t in texts:
        w = (t or "").split()
        for i in range(len(w)):
            for j in range(i + 1, min(len(w), i + 3)):
                want[w[i], w[j]] += 1
                want[w[j], w[i]] += 1
    assert got and all(want[k] == n for k, n in got.items())
    assert [f.dataType.simpleString() for f in kept[0].schema.fields] == ["int", "int", "bigint"]
    assert kept[0].filter("a > b").count() == 0


def test_hashed_embedding_has_no_word_counts(spark):
    df = spark.createDataFrame([(1, "aa bb aa"), (2, None), (1, "cc")], "id long, t string")
    out = V.hashed_embedding(df, "id", "t", 8)
    assert abs(sum(r.value ** 2 for r in out.collect()) - 1) < 1e-9
    assert "count(1)" not in plan(out)


def test_char_grams_are_counted_beside_the_text(spark, monkeypatch):
    rows = [(1, "Abc  de\tabc"), (1, "a abc"), (None, "abc xyz"), (2, None), (3, " "), (4, "xyz ÄÖabcd"), (2 ** 60 + 1, "abc")]
    df = spark.createDataFrame(rows, "id long, t string")
    want, want_voc = V.tfidf(V.char_terms(df, "id", "t", 3, 5), df, "id", 2, 12)
    calls = []
    monkeypatch.setattr(V, "char_terms", lambda *a: calls.append(a))
    for memory in (V.WORD_MEMORY, 1):
        monkeypatch.setattr(V, "WORD_MEMORY", memory)
        got, voc = V.tfidf_char(df, "id", "t", 3, 5, min_df=2, max_features=12)
        assert sorted(map(tuple, voc.collect())) == sorted(map(tuple, want_voc.collect()))
        rounded = [sorted((str(r.id), r.term, round(r.weight, 9)) for r in x.collect()) for x in (got, want)]
        assert rounded[0] == rounded[1] and len(rounded[0]) > 12
    assert not calls


def test_embeddings_are_summed_in_place(spark):
    docs = spark.createDataFrame([(1, "aa bb aa"), (2, "zz"), (3, None), (None, "bb")], "id long, t string")
    vectors = spark.createDataFrame([("aa", [1.0, 0.0]), ("bb", [0.0, 2.0])], "word string, vector array<float>")
    out = WV.embed_documents(docs, "id", "t", vectors)
    found = {r.id: r.embedding for r in out.collect()}
    assert found[2] is None and found[3] is None and all(0 < x < 1 for x in found[1])
    assert "collect_list" not in plan(out)
    assert [r.embedding for r in WV.embed_documents(docs, "id", "t", vectors.limit(0)).collect()] == [None] * 4


def test_word_grams_are_counted_beside_the_text(spark, monkeypatch):
    rows = [(1, "Aa bb aa, bb cc"), (1, "aa x bb"), (None, "aa bb"), (2, None), (3, " "), (4, "ÄÖ aa bb"), (2 ** 60 + 1, "cc bb")]
    df = spark.createDataFrame(rows, "id long, t string")
    want, want_voc = V.tfidf(V.word_terms(df, "id", "t"), df, "id", 2, 4)
    index = V.term_index(want_voc, 4)
    want_vectors = V.to_vectors(want, index, df.select("id"), "id", 4)
    calls = []
    monkeypatch.setattr(V, "word_terms", lambda *a: calls.append(a))
    for memory in (V.GRAM_MEMORY, 1):
        monkeypatch.setattr(V, "GRAM_MEMORY", memory)
        got, voc = V.tfidf_word(df, "id", "t", min_df=2, max_features=4)
        assert sorted(map(tuple, voc.collect())) == sorted(map(tuple, want_voc.collect()))
        for weights in (got, V.transform(df, voc, "id", "t", max_features=4)):
            rounded = [sorted((str(r.id), r.term, round(r.weight, 9)) for r in x.collect()) for x in (weights, want)]
            assert rounded[0] == rounded[1] and len(rounded[0]) > 8
        vectors = V.text_vectors(V.word_texts(df, "id", "t"), voc, df.select("id"), "id", V.word_grams_of(2), 4)
        cells = [sorted((str(r.id), r.features.indices.tolist(), r.features.values.round(9).tolist()) for r in x.collect())
                 for x in (vectors, want_vectors)]
        assert cells[0] == cells[1]
    assert not calls


def test_solvers_run_in_few_tasks(spark):
    rows = spark.range(1000).repartition(64)
    cores = spark.sparkContext.defaultParallelism
    assert solver_rows(rows).rdd.getNumPartitions() == cores
    assert solver_rows(rows, 100).rdd.getNumPartitions() == max(10, cores)
    assert solver_rows(rows).count() == 1000
