"""Trigram profiles: invented languages without stop-word lists, held-out accuracy, odd rows."""
import random

from pyspark.sql import functions as F

from credence.operators import lang_profiles as LP


def invented(spark):
    rng = random.Random(7)
    syllables = {"xa": ["zu", "kro", "vak", "zin"], "xb": ["lei", "aum", "oia", "elu"], "xc": ["þor", "ðan", "þea", "ðil"]}
    rows = []
    for i in range(150):
        lang = sorted(syllables)[i % 3]
        words = ["".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(4, 12))]
        rows.append((i, " ".join(words).capitalize(), lang if i % 5 else None))
    rows += [(900, None, "xa"), (901, "1234 !!", "xb"), (902, "", None), (903, "a", "")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_invented_languages_are_told_apart(spark):
    docs = invented(spark)
    profiles = LP.fit_profiles(docs.where(F.col("doc_id") % 5 != 0))
    assert {r.lang for r in profiles.select("lang").distinct().collect()} == {"xa", "xb", "xc"}
    assert profiles.groupBy("lang").agg(F.max("rank")).where("max(rank) >= 300").count() == 0
    got = {r.doc_id: r for r in LP.detect(docs, profiles, "doc_id").collect()}
    held = [i for i in range(150) if i % 5 == 0]
    right = sum(got[i].lang_pred == sorted(["xa", "xb", "xc"])[i % 3] for i in held)
    assert right == len(held)
    assert got[900].lang_pred is None and got[901].lang_pred is None and got[902].distance is None
    assert got[903].lang_pred is not None and got[903].distance > 0


def test_distance_by_hand(spark):
    profiles = spark.createDataFrame([("aa", " ab", 0), ("aa", "ab ", 1), ("bb", "ab ", 0)], "lang string, gram string, rank long")
    docs = spark.createDataFrame([(1, "ab ab"), (2, "zz")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.distance) for r in LP.detect(docs, profiles, "doc_id", size=300).collect()}
    # doc 1 keeps " ab" (rank 0) and "ab " (rank 1): aa costs 0 + 0, bb costs 300 + 1
    assert got[1] == ("aa", 0)
    # doc 2 shares nothing: every language at full distance, the first code wins
    assert got[2] == ("aa", 600)
    empty = spark.createDataFrame([], "lang string, gram string, rank long")
    assert {r.lang_pred for r in LP.detect(docs, empty, "doc_id").collect()} == {None}
