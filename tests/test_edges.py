"""Hand-computed edge rows and brute-force checks."""
import random

import pytest
from pyspark.sql import functions as F

from credence import constants as K
from credence.functions import dates as D
from credence.functions import labels as L
from credence.functions import text as T
from credence.functions import urls as U
from credence.operators import augment as A
from credence.operators import backfill as B
from credence.operators import features as X
from credence.operators import layout as Y
from credence.operators import metrics as M
from credence.operators import models as MD
from credence.operators import thresholds as H
from credence.operators import vectors as V
from credence.sources import canonical as C


def one(spark, expr, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(expr.alias("x")).first()[0]


def features_of(spark, title, text):
    df = spark.createDataFrame([(title, text)], "title string, text string")
    return X.without_stop_words(X.build_text_features(df, drop_intermediate=False)).first().asDict()


def test_empty_text_has_one_empty_token(spark):
    f = features_of(spark, None, "   ")
    assert f["text_n_tokens"] == 1 and f["title_text_jaccard"] == 1.0
    assert f["text_n_sentences_est"] == 1 and f["text_avg_word_len"] == 0.0


def test_punctuation_and_runs(spark):
    f = features_of(spark, "!!! ???", "aaa bb cccc ... 🔥🔥🔥 !!! ???")
    assert f["title_exc_qm"] == 6 and f["text_exc_qm"] == 6
    assert f["text_char_repeat_3plus"] == 6
    assert (f["text_ellipsis"], f["text_multi_exclaim"], f["text_multi_qmark"]) == (1, 1, 1)


def test_numbers_digits_and_hebrew(spark):
    f = features_of(spark, "שָׁלוֹם", "١٢ 3.14 x7 1.2.3 ₪5 של")
    assert f["text_n_digits"] == 2 + 3 + 1 + 3 + 1
    assert f["text_n_numbers"] == 1 + 1 + 2 + 1
    assert f["text_currency"] == 1 and f["title_norm"] == "שלום"
    assert "של" not in f["text_tokens_ns"]


def test_accents_split_words_before_lower_casing(spark):
    assert features_of(spark, "Étion Café", "x")["title_tokens"] == ["tion", "caf"]


@pytest.mark.parametrize("url, netloc, title, date", [
    ("https://u:p@a.b.co:80/2024/01/31/big-news_now;x=1?q=2#f", "u:p@a.b.co:80", "big news now", "2024-01-31"),
    ("a.com/x", "", "x", ""),
    (None, "", "", ""),
    ("http://a.com/", "a.com", "", ""),
])
def test_urls(spark, url, netloc, title, date):
    df = spark.createDataFrame([(url,)], "u string")
    got = df.select(U.netloc(F.col("u")), U.title_from_url(F.col("u")), U.date_from_url(F.col("u"))).first()
    assert tuple(got) == (netloc, title, date)


def test_author_and_channel(spark):
    assert one(spark, U.author_from_title(F.col("t")), t="Jane Doe-Smith : what now") == "Jane Doe-Smith"
    assert one(spark, U.author_from_title(F.col("t")), t="no colon") == "unknown"
    assert one(spark, U.channel_name(F.col("t")), t="x by BBC News 3 years ago") == "BBC News"


def test_codes_fold_case_unless_strict(spark):
    assert one(spark, L.normalize_code(F.col("c"), K.CATEGORY_CODES), c=" US_News ") == "US"
    assert one(spark, L.normalize_code(F.col("c"), K.CATEGORY_CODES, strict_keys=True), c="US_News") == "unknown"
    assert one(spark, L.normalize_code(F.lit(None).cast("string"), K.TYPE_CODES)) == "unknown"


def test_boilerplate_is_word_bounded(spark):
    got = one(spark, T.remove_boilerplate(F.col("t")), t="Subscribe now, unsubscribed NEWSLETTER newsletters")
    assert got == " now, unsubscribed  newsletters"


@pytest.mark.parametrize("value, name", [(49, "S"), (50, "M"), (149, "M"), (150, "L"), (400, "XL")])
def test_bins_are_left_closed(spark, value, name):
    assert one(spark, D.bin_edges(F.col("v"), *K.LENGTH_BINS), v=value) == name


def test_scores_on_a_threshold_abstain(spark):
    for p, want in ((0.3, -1), (0.7, -1), (0.2999, 1), (0.7001, 0)):
        assert one(spark, H.decide(F.col("p"), F.lit(0.3), F.lit(0.7)), p=p) == want


def test_threshold_grid_has_ninety_pairs():
    assert sum(lo < hi for lo in K.GRID_LOWS for hi in K.GRID_HIGHS) == 90


@pytest.mark.parametrize("n, used", [(99, "global_fallback"), (100, "context")])
def test_small_contexts_fall_back(spark, n, used):
    rows = [("c", i % 2, (i * 37 % 101) / 101) for i in range(n)] + [("d", i % 2, i / 300) for i in range(300)]
    df = spark.createDataFrame(rows, "ctx string, label int, p_fake double")
    got = {r["ctx"]: r for r in H.search_thresholds(df).collect()}
    assert got["c"]["used"] == used and got["*"]["n"] == n + 300


def test_lookup_join_with_hot_and_null_keys(spark):
    keys = ["hot"] * 3000 + [None] * 1500 + [f"k{i % 400}" for i in range(4000)]
    left = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id long, k string")
    right = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 400, 2)], "k string, v long")
    want = {"hot": 1, **{f"k{i}": i for i in range(0, 400, 2)}}
    got = Y.lookup_join(left, right, "k").collect()
    assert len(got) == len(keys) and len({r["id"] for r in got}) == len(keys)
    assert all(r["v"] == want.get(r["k"]) for r in got)
    assert [r[0] for r in Y.hot_keys(left, "k").collect()] == ["hot"]


def test_running_totals_and_ranks_match_brute_force(spark):
    rng = random.Random(1)
    rows = [(g, s, rng.randint(0, 5)) for g in (None, "a", "b") for s in rng.sample(range(10000), 500)]
    df = spark.createDataFrame([(g, float(s), v) for g, s, v in rows], "g string, s double, v long")
    got = {(r["g"], r["s"]): r["cum_v"] for r in Y.running_totals(df, ["g"], "s", ["v"], ascending=False, buckets=16).collect()}
    assert len(got) == len(rows)
    for g, s, _ in rows:
        assert got[(g, float(s))] == sum(v for h, t, v in rows if h == g and t >= s)
    for r in Y.ranked(df, ["g"], "s", ["v"], buckets=16).collect():
        mine = sorted(t for h, t, _ in rows if h == r["g"])
        assert r["rank"] == mine.index(r["s"]) + 1 and r["rank_of"] == 500


def ap_auc(rows):
    pos = [p for p, y in rows if y == 0]
    neg = [p for p, y in rows if y == 1]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    ap, seen = 0.0, 0
    for t in sorted({p for p, _ in rows}, reverse=True):
        above = [y for p, y in rows if p >= t]
        gained = above.count(0) - seen
        seen = above.count(0)
        ap += gained / len(pos) * seen / len(above)
    return ap, auc


def test_rank_quality_with_ties(spark):
    rng = random.Random(2)
    rows = [(round(rng.random(), 1), rng.randint(0, 1)) for _ in range(400)]
    df = spark.createDataFrame(rows, "p_fake double, label int")
    got = M.evaluate_scores(df).first()
    ap, auc = ap_auc(rows)
    assert got["pr_auc_fake"] == pytest.approx(ap) and got["roc_auc_fake"] == pytest.approx(auc)
    warped = M.evaluate_scores(df.withColumn("p_fake", F.col("p_fake") ** 3)).first()
    assert warped["pr_auc_fake"] == pytest.approx(ap) and warped["roc_auc_fake"] == pytest.approx(auc)


def test_one_class_has_no_auc(spark):
    df = spark.createDataFrame([(0.4, 0), (0.6, 0)], "p_fake double, label int")
    assert M.evaluate_scores(df).first()["roc_auc_fake"] is None


def test_degradation_needs_its_columns(spark):
    with pytest.raises(KeyError):
        M.area_under_degradation(spark.createDataFrame([("clean", 0.5)], "noise string, pr_auc double"))


def test_noise_ignores_the_layout(spark):
    df = spark.createDataFrame([(i, f"Some text! No {i}? yes... ok") for i in range(50)], "id long, t string")
    a = {r["id"]: r["t"] for r in A.augment(df, "id", "t").collect()}
    b = {r["id"]: r["t"] for r in A.augment(df.repartition(7), "id", "t").collect()}
    assert a == b and any(a[i] != f"Some text! No {i}? yes... ok" for i in a)


def test_arm_values_equal_the_recursion(spark):
    rows = [(("x", "y")[i % 3 == 0], i, (i * 7919 % 97) / 97) for i in range(700)]
    df = spark.createDataFrame(rows, "arm string, i long, r double")
    got = {r["arm"]: r for r in A.arm_values(df, "arm", "i", "i", "r").collect()}
    for arm in ("x", "y"):
        v = 0.0
        for a, _, r in rows:
            v = 0.8 * v + 0.2 * r if a == arm else v
        assert got[arm]["value"] == pytest.approx(v) and got[arm]["n"] == sum(a == arm for a, *_ in rows)


def char_wb(text, low, high):
    out = []
    for w in text.lower().split():
        w = f" {w} "
        out += [w[i:i + n] for n in range(low, high + 1) if n < len(w) for i in range(len(w) - n + 1)]
        out += [w] if len(w) <= high else []
    return sorted(out)


def test_char_grams_count_short_words_once(spark):
    text = "a bc defgh bc \n ijklmnop"
    df = spark.createDataFrame([(1, text)], "id long, t string")
    got = sorted(t for r in V.char_terms(df, "id", "t", 3, 5).collect() for t in [r["term"]] * r["n"])
    assert got == char_wb(text, 3, 5)


def test_backfill_does_not_multiply_rows(spark):
    df = spark.createDataFrame([("u", ""), ("u", "kept"), ("v", None), (None, "")], "url string, text string")
    fetched = spark.createDataFrame([("u", "short"), ("u", "longer text"), ("w", "x")], "url string, scraped_text string")
    got = sorted((r["url"] or "", r["text"] or "") for r in B.backfill_text(df, fetched).collect())
    assert got == [("", ""), ("u", "kept"), ("u", "longer text"), ("v", "")]


def test_page_text(spark):
    html = "<html><style>p{}</style><!-- x --><script>var a='</p>'</script><p>A &amp;lt; B</p><br>C&nbsp;D</html>"
    assert one(spark, B.page_text(F.col("h")), h=html) == "A &lt; B C D"


def test_target_mean_defaults(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), (None, 1), ("b", None)], "k string, label int")
    got = sorted(((r["k"] or "", r["rating"]) for r in C.target_mean(df, "k").collect()))
    assert got == [("", 0.5), ("a", 0.5), ("a", 0.5), ("b", 0.5)]


def test_repair_clamps_genes():
    fixed = MD.repair({"word_high": 9, "char_pair": -1, "min_df": 3.4, "log_c": -9, "use_numeric": 0.6, "tau_low": 0.1, "tau_high": 0.9})
    assert fixed == {"word_high": 2, "char_pair": 0, "min_df": 3, "log_c": -3.0, "use_numeric": 1, "tau_low": 0.2, "tau_high": 0.8}
