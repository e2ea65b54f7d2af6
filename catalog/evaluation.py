"""Bindings of splits, metrics and thresholds."""
from __future__ import annotations

from pyspark.sql import functions as F

from catalog import sqlfn as S
from catalog.features import FEATS
from catalog.fixtures import CANON, P_FAKE, SCORED, SCORED_TIES, canonical, hash32_sql, scored, uniform_sql
from catalog.registry import query, r6, r6s
from credence import constants as K
from credence.functions import dates as D
from credence.operators import features as X
from credence.operators import metrics as M
from credence.operators import splits as G
from credence.operators import thresholds as L
from credence.operators.layout import cut_lineage

U, U7 = uniform_sql("doc_id"), uniform_sql("doc_id", 7)

# ---- splits ----------------------------------------------------------------------------------


@query("stratified_split", f"WITH {SCORED} SELECT doc_id, label, {U} < 0.2 AS is_val FROM scored")
def stratified_split(spark, sf_dir):
    return G.stratified_split(scored(spark, sf_dir), "doc_id").select("doc_id", "label", "is_val")


@query("stratified_split_exact", f"""WITH {SCORED}, r AS (SELECT doc_id, label,
      row_number() OVER (PARTITION BY label ORDER BY {U}, doc_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM scored)
    SELECT doc_id, label, r <= round(n * CAST(0.2 AS DOUBLE)) AS is_val FROM r""")
def stratified_split_exact(spark, sf_dir):
    return G.stratified_split(scored(spark, sf_dir), "doc_id", exact=True).select("doc_id", "label", "is_val")


@query("stratified_folds", f"WITH {SCORED} SELECT doc_id, label, CAST({hash32_sql('doc_id')} % 5 AS INTEGER) AS fold FROM scored")
def stratified_folds(spark, sf_dir):
    return G.stratified_folds(scored(spark, sf_dir), "doc_id").select("doc_id", "label", "fold")


@query("stratified_folds_exact", f"""WITH {SCORED} SELECT doc_id, label,
    CAST((row_number() OVER (PARTITION BY label ORDER BY {U}, doc_id) - 1) % 5 AS INTEGER) AS fold FROM scored""")
def stratified_folds_exact(spark, sf_dir):
    return G.stratified_folds(scored(spark, sf_dir), "doc_id", exact=True).select("doc_id", "label", "fold")


@query("group_folds", f"""WITH {CANON}, s AS (SELECT source, count(*) AS n FROM canon GROUP BY source),
    r AS (SELECT source, row_number() OVER (ORDER BY n DESC, source) - 1 AS r, count(*) OVER () AS g FROM s),
    f AS (SELECT source, r, least(4, greatest(2, g)) AS k FROM r)
    SELECT doc_id, f.source, CAST(CASE WHEN (r // k) % 2 = 0 THEN r % k ELSE k - 1 - r % k END AS INTEGER) AS fold
    FROM canon JOIN f ON canon.source = f.source""")
def group_folds(spark, sf_dir):
    return G.group_folds(canonical(spark, sf_dir), "source").select("doc_id", "source", "fold")


@query("shuffled_split", f"""WITH {CANON}, r AS (SELECT doc_id, row_number() OVER (ORDER BY {U}, doc_id) AS r,
      count(*) OVER () AS n FROM canon) SELECT doc_id, r > floor(n * CAST(0.8 AS DOUBLE)) AS is_val FROM r""")
def shuffled_split(spark, sf_dir):
    return G.shuffled_split(canonical(spark, sf_dir), "doc_id").select("doc_id", "is_val")


@query("class_weights", f"""WITH {SCORED}, c AS (SELECT label, count(*) AS n FROM scored GROUP BY label)
    SELECT doc_id, scored.label, {r6s('CAST((SELECT sum(n) FROM c) AS DOUBLE) / ((SELECT count(*) FROM c) * c.n)')} AS weight
    FROM scored JOIN c ON scored.label = c.label""")
def class_weights(spark, sf_dir):
    return G.class_weights(scored(spark, sf_dir)).select("doc_id", "label", r6("weight").alias("weight"))


@query("sample_rows", f"WITH {CANON} SELECT doc_id, source FROM canon ORDER BY {hash32_sql('doc_id', 7)}, doc_id LIMIT 100")
def sample_rows(spark, sf_dir):
    return G.sample_rows(canonical(spark, sf_dir), "doc_id", 100, seed=7).select("doc_id", "source")


TS = S.timestamp("date_published")


@query("time_order", f"""WITH {CANON} SELECT doc_id, row_number() OVER (ORDER BY coalesce({TS}, TIMESTAMP '1970-01-01'), doc_id) AS time_rank
    FROM canon""")
def time_order(spark, sf_dir):
    return G.time_order(canonical(spark, sf_dir), "doc_id").select("doc_id", "time_rank")


@query("time_split", f"""WITH {CANON}, r AS (SELECT doc_id, row_number() OVER (ORDER BY coalesce({TS}, TIMESTAMP '1970-01-01'), doc_id) AS time_rank,
      count(*) OVER () AS n FROM canon) SELECT doc_id, time_rank, time_rank > floor(n * CAST(0.8 AS DOUBLE)) AS is_val FROM r""")
def time_split(spark, sf_dir):
    return G.time_split(canonical(spark, sf_dir), "doc_id").select("doc_id", "time_rank", "is_val")


# ---- metrics ---------------------------------------------------------------------------------

CONFUSION = """count(*) AS n, count(*) FILTER (h = 0 AND label = 0) AS tp, count(*) FILTER (h = 0 AND label = 1) AS fp,
    count(*) FILTER (h = 1 AND label = 0) AS fn, count(*) FILTER (h = 1 AND label = 1) AS tn"""


def div(a, b):
    return f"coalesce(({a}) / nullif(CAST({b} AS DOUBLE), 0), 0)"


SCORES = f"{div('tp + tn', 'n')} AS accuracy, {div('tp', 'tp + fp')} AS precision, {div('tp', 'tp + fn')} AS recall, {div('2 * tp', '2 * tp + fp + fn')} AS f1"
HAT = "CASE WHEN p_fake > 0.5 THEN 0 ELSE 1 END"


@query("confusion_counts", f"""WITH {SCORED}, j AS (SELECT *, {HAT} AS h FROM scored), c AS (SELECT {CONFUSION} FROM j),
    m AS (SELECT *, {SCORES} FROM c) SELECT n, tp, fp, fn, tn, {', '.join(f'{r6s(x)} AS {x}' for x in ('accuracy', 'precision', 'recall', 'f1'))} FROM m""")
def confusion_counts(spark, sf_dir):
    df = scored(spark, sf_dir).withColumn("predicted", M.predicted_label(F.col("p_fake")))
    out = M.confusion_counts(df)
    return out.withColumns({c: r6(c) for c in ("accuracy", "precision", "recall", "f1")})


_GUESS = "CASE WHEN doc_id % 4 = 0 THEN 'US_News' WHEN doc_id % 9 = 0 THEN 'sports' ELSE coalesce(category, 'unknown') END"


@query("class_report", f"""WITH {CANON}, g AS (SELECT coalesce(category, 'unknown') AS a, {_GUESS} AS p FROM canon),
    k AS (SELECT a AS class FROM g UNION SELECT p FROM g),
    s AS (SELECT class, (SELECT count(*) FROM g WHERE a = class AND p = class) AS hit, (SELECT count(*) FROM g WHERE a = class) AS support,
      (SELECT count(*) FROM g WHERE p = class) AS called FROM k),
    r AS (SELECT class, {div('hit', 'called')} AS precision, {div('hit', 'support')} AS recall, {div('2 * hit', 'called + support')} AS f1, support FROM s),
    u AS (SELECT * FROM r UNION ALL SELECT 'weighted', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
      sum(f1 * support) / sum(support), sum(support) FROM r)
    SELECT class, {r6s('precision')} AS precision, {r6s('recall')} AS recall, {r6s('f1')} AS f1, CAST(support AS BIGINT) AS support FROM u""")
def class_report(spark, sf_dir):
    df = canonical(spark, sf_dir).select(
        F.coalesce("category", F.lit("unknown")).alias("a"), F.expr(_GUESS).alias("p"))
    return M.class_report(df, "a", "p").withColumns({c: r6(c) for c in ("precision", "recall", "f1")})


POINTS = """pts AS (SELECT p_fake AS score, count(*) FILTER (label = 0) AS pos, count(*) FILTER (label = 1) AS neg FROM scored GROUP BY 1),
  cum AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS cp, sum(neg) OVER (ORDER BY score DESC) AS cn FROM pts)"""
AP = "sum(pos * (cp / CAST(cp + cn AS DOUBLE))) / sum(pos)"
AUC = "1 - sum(pos * (cn - neg / 2.0::DOUBLE)) / (sum(pos) * sum(neg))"


@query("average_precision", f"WITH {SCORED_TIES}, {POINTS} SELECT {r6s(AP)} AS pr_auc FROM cum")
def average_precision(spark, sf_dir):
    return M.average_precision(M.curve_points(scored(spark, sf_dir, 1))).withColumn("pr_auc", r6("pr_auc"))


@query("roc_auc", f"WITH {SCORED_TIES}, {POINTS} SELECT {r6s(AUC)} AS roc_auc FROM cum")
def roc_auc(spark, sf_dir):
    return M.roc_auc(M.curve_points(scored(spark, sf_dir, 1))).withColumn("roc_auc", r6("roc_auc"))


@query("roc_curve", f"""WITH {SCORED}, {POINTS} SELECT {r6s('score')} AS threshold, {r6s('cn / CAST((SELECT sum(neg) FROM pts) AS DOUBLE)')} AS fpr,
      {r6s('cp / CAST((SELECT sum(pos) FROM pts) AS DOUBLE)')} AS tpr FROM cum
    UNION ALL SELECT CAST(NULL AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)""")
def roc_curve(spark, sf_dir):
    out = M.roc_curve(M.curve_points(scored(spark, sf_dir)))
    return out.select(*[r6(c).alias(c) for c in ("threshold", "fpr", "tpr")])


EVAL = f"""SELECT n AS n_val, {r6s('accuracy')} AS accuracy, {r6s('f1')} AS f1_fake, (SELECT {r6s(AP)} FROM cum) AS pr_auc_fake,
    (SELECT {r6s(AUC)} FROM cum) AS roc_auc_fake FROM m"""


def evaluated(df):
    return df.withColumns({c: r6(c) for c in df.columns if df.schema[c].dataType.typeName() == "double"})


@query("eval_plain", f"""WITH {CANON}, scored AS (SELECT *, {P_FAKE} AS p_fake FROM canon WHERE label IS NOT NULL AND {U} < 0.2), {POINTS},
    j AS (SELECT *, {HAT} AS h FROM scored), c AS (SELECT {CONFUSION} FROM j), m AS (SELECT *, {SCORES} FROM c) {EVAL}""")
def eval_plain(spark, sf_dir):
    val = G.stratified_split(scored(spark, sf_dir), "doc_id").filter("is_val")
    return evaluated(M.evaluate_scores(val))


NOISES = [("typos", 0.25), ("typos", 0.5), ("typos", 1.0), ("emoji", 0.2), ("emoji", 0.9)]


def noisy(spark, sf_dir):
    """Scores under growing noise: a second hash pulls the score away from the truth."""
    from credence.functions.hashing import uniform
    base = scored(spark, sf_dir).select("doc_id", "label", "p_fake")
    cases = F.array(F.struct(F.lit("clean").alias("noise"), F.lit(0.0).alias("intensity")),
                    *[F.struct(F.lit(n).alias("noise"), F.lit(i).alias("intensity")) for n, i in NOISES])
    wide = base.withColumn("c", F.explode(cases)).select("*", "c.*").drop("c")
    p = F.col("p_fake") * (1 - F.col("intensity")) + uniform(F.col("doc_id"), 7) * F.col("intensity")
    return wide.withColumn("p_fake", p)


NOISY = f"""{SCORED}, cases(noise, intensity) AS (VALUES ('clean', CAST(0 AS DOUBLE)), {', '.join(f"('{n}', CAST({i} AS DOUBLE))" for n, i in NOISES)}),
  noisy AS (SELECT doc_id, label, noise, intensity, p_fake * (1 - intensity) + {U7} * intensity AS p_fake FROM scored, cases),
  npts AS (SELECT noise, intensity, p_fake AS score, count(*) FILTER (label = 0) AS pos, count(*) FILTER (label = 1) AS neg FROM noisy GROUP BY ALL),
  ncum AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn FROM npts WINDOW w AS (PARTITION BY noise, intensity ORDER BY score DESC)),
  metric AS (SELECT noise, intensity, {AP} AS pr_auc FROM ncum GROUP BY ALL)"""


@query("area_under_degradation", f"""WITH {NOISY}, d AS (SELECT noise, intensity, (SELECT pr_auc FROM metric WHERE noise = 'clean') - pr_auc AS d FROM metric WHERE noise <> 'clean'),
    t AS (SELECT noise, (intensity - lag(intensity) OVER w) * (d + lag(d) OVER w) / 2 AS a FROM d WINDOW w AS (PARTITION BY noise ORDER BY intensity))
    SELECT noise, {r6s('coalesce(sum(a), 0)')} AS area_under_degradation FROM t GROUP BY noise""")
def area_under_degradation(spark, sf_dir):
    points = M.curve_points(noisy(spark, sf_dir), groups=["noise", "intensity"])
    out = M.area_under_degradation(M.average_precision(points, ["noise", "intensity"]))
    return out.withColumn("area_under_degradation", r6("area_under_degradation"))


def cost_sql(lo, hi, p="p_fake"):
    return (f"CASE WHEN {p} > {hi} THEN CASE WHEN label = 0 THEN 1.0 ELSE -5.0 END WHEN {p} < {lo} THEN "
            f"CASE WHEN label = 1 THEN 1.0 ELSE -2.0 END ELSE -0.5 END::DOUBLE")


@query("cost_reward", f"WITH {SCORED} SELECT source, {r6s('avg(' + cost_sql('0.3::DOUBLE', '0.7::DOUBLE') + ')')} AS reward FROM scored GROUP BY source")
def cost_reward(spark, sf_dir):
    return M.cost_reward(scored(spark, sf_dir), 0.3, 0.7, groups=["source"]).withColumn("reward", r6("reward"))


_SAID = "CASE WHEN doc_id % 5 = 0 THEN 'maybe' WHEN p_fake > 0.5 THEN '<FAKE>' ELSE '<REAL>' END"


@query("margin_reward", f"""WITH {SCORED}, s AS (SELECT *, {_SAID} AS said, (1 - p_fake) * CAST(0.9 AS DOUBLE) AS p_real FROM scored)
    SELECT doc_id, said, {r6s('''CASE said WHEN '<FAKE>' THEN CASE WHEN label = 0 THEN 1.0 ELSE -4.0 END
      WHEN '<REAL>' THEN CASE WHEN label = 1 THEN 1.0 ELSE -2.0 END ELSE 0.0 END::DOUBLE + CAST(0.2 AS DOUBLE) * abs(p_fake - p_real)''')} AS reward FROM s""")
def margin_reward(spark, sf_dir):
    df = scored(spark, sf_dir).withColumn("said", F.expr(_SAID)).withColumn("p_real", (1 - F.col("p_fake")) * 0.9)
    return df.select("doc_id", "said", r6(M.margin_reward(
        F.col("said"), F.col("p_fake"), F.col("p_real"), F.col("label"))).alias("reward"))


MODELS = {"tfidf": "p_fake", "emb": "p_noise", "fusion": "(p_fake + p_noise) / 2"}


def model_scores(spark, sf_dir):
    from credence.functions.hashing import uniform
    df = scored(spark, sf_dir).withColumn("p_noise", uniform(F.col("doc_id"), 7) * 0.8 + (1 - F.col("label")) * 0.2)
    rows = F.array(*[F.struct(F.lit(m).alias("model"), F.expr(e).alias("p_fake")) for m, e in MODELS.items()])
    return df.select("label", F.explode(rows).alias("r")).select("label", "r.*")


_LONG = " UNION ALL ".join(f"SELECT label, '{m}' AS model, {e} AS p_fake FROM two" for m, e in MODELS.items())


@query("model_comparison", f"""WITH {SCORED}, two AS (SELECT *, {U7} * CAST(0.8 AS DOUBLE) + (1 - label) * CAST(0.2 AS DOUBLE) AS p_noise FROM scored),
    long AS ({_LONG}), j AS (SELECT *, {HAT} AS h FROM long), c AS (SELECT model, {CONFUSION} FROM j GROUP BY model), m AS (SELECT *, {SCORES} FROM c),
    mp AS (SELECT model, p_fake AS score, count(*) FILTER (label = 0) AS pos, count(*) FILTER (label = 1) AS neg FROM long GROUP BY ALL),
    mc AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn FROM mp WINDOW w AS (PARTITION BY model ORDER BY score DESC)),
    q AS (SELECT model, {AP} AS ap, {AUC} AS auc FROM mc GROUP BY model)
    SELECT m.model, n AS n_val, {r6s('accuracy')} AS accuracy, {r6s('f1')} AS f1_fake, {r6s('ap')} AS pr_auc_fake, {r6s('auc')} AS roc_auc_fake
    FROM m JOIN q ON m.model = q.model""")
def model_comparison(spark, sf_dir):
    return evaluated(M.model_comparison(model_scores(spark, sf_dir)))


@query("batch_history", f"""WITH {SCORED}, j AS (SELECT *, CAST({hash32_sql('doc_id', 3)} % 6 AS INTEGER) AS batch, CASE WHEN p_fake >= 0.5 THEN 0 ELSE 1 END AS h FROM scored),
    c AS (SELECT batch, {CONFUSION} FROM j GROUP BY batch), m AS (SELECT *, {SCORES} FROM c)
    SELECT batch, {r6s('accuracy')} AS val_accuracy, {r6s('f1')} AS val_f1 FROM m""")
def batch_history(spark, sf_dir):
    df = G.stratified_folds(scored(spark, sf_dir), "doc_id", k=6, seed=3).withColumnRenamed("fold", "batch")
    return evaluated(M.batch_history(df))


# ---- contexts and thresholds ------------------------------------------------------------------


def bins_sql(v, edges, names):
    whens = " ".join(f"WHEN {v} < {e} THEN '{n}'" for e, n in zip(edges, names))
    return f"CASE {whens} ELSE '{names[-1]}' END"


@query("bin_edges", f"""WITH {SCORED} SELECT doc_id, {bins_sql('length(text)', *K.LENGTH_BINS)} AS len_bin,
    {bins_sql('doc_id % 24', *K.HOUR_BINS)} AS hour_bin, {bins_sql('round(p_fake, 3) / 10', *K.PUNCTUATION_BINS)} AS punc_bin FROM scored""")
def bin_edges(spark, sf_dir):
    return scored(spark, sf_dir).select(
        "doc_id", D.bin_edges(F.length("text"), *K.LENGTH_BINS).alias("len_bin"),
        D.bin_edges(F.col("doc_id") % 24, *K.HOUR_BINS).alias("hour_bin"),
        D.bin_edges(F.round("p_fake", 3) / 10, *K.PUNCTUATION_BINS).alias("punc_bin"))


_SPELLED = """CASE doc_id % 5 WHEN 0 THEN strftime(CAST(coalesce(try_cast(date_published AS TIMESTAMP), TIMESTAMP '2020-01-02 03:04:05') AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S')
  WHEN 1 THEN strftime(coalesce(try_cast(date_published AS TIMESTAMP), TIMESTAMP '2020-01-02 03:04:05'), '%d/%m/%Y')
  WHEN 2 THEN strftime(coalesce(try_cast(date_published AS TIMESTAMP), TIMESTAMP '2020-01-02 03:04:05'), '%B %-d, %Y') ELSE date_published END"""


@query("lenient_dates", f"WITH {CANON}, d AS (SELECT doc_id, {_SPELLED} AS spelled FROM canon) SELECT doc_id, spelled, strftime({S.timestamp('spelled')}, '%Y-%m-%d %H:%M:%S') AS ts FROM d")
def lenient_dates(spark, sf_dir):
    ts = F.coalesce(F.expr("try_cast(date_published AS TIMESTAMP)"), F.lit("2020-01-02 03:04:05").cast("timestamp"))
    i = F.col("doc_id") % 5
    spelled = (F.when(i == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).when(i == 1, F.date_format(ts, "dd/MM/yyyy"))
               .when(i == 2, F.date_format(ts, "MMMM d, yyyy")).otherwise(F.col("date_published")))
    df = canonical(spark, sf_dir).select("doc_id", spelled.alias("spelled"))
    return df.withColumn("ts", F.date_format(D.lenient_timestamp(F.col("spelled")), "yyyy-MM-dd HH:mm:ss"))


AGE = f"coalesce(CAST(floor((epoch((SELECT max({TS}) FROM canon)) - epoch({TS})) / 86400) AS INTEGER), 9999)"


@query("age_days", f"WITH {CANON} SELECT doc_id, {AGE} AS age_days FROM canon")
def age_days(spark, sf_dir):
    df = canonical(spark, sf_dir).select("doc_id", D.lenient_timestamp(F.col("date_published")).alias("ts"))
    return df.select("doc_id", D.age_days(F.col("ts"), df.agg(F.max("ts")).scalar(), K.UNKNOWN_AGE_DAYS).alias("age_days"))


CTX_PARTS = {
    "source": "coalesce(source, 'UNK')", "category": "coalesce(category, 'UNK')",
    "len_bin": bins_sql("text_n_tokens", *K.LENGTH_BINS), "punc_bin": bins_sql("text_exclaim_qm_per_token", *K.PUNCTUATION_BINS),
    "clickbait": "CASE WHEN title_clickbait_hits > 0 THEN 'CB1' ELSE 'CB0' END",
    "hour_bin": bins_sql(f"coalesce(hour({TS}), -1)", *K.HOUR_BINS), "dow_bin": bins_sql(f"coalesce(isodow({TS}), -1)", *K.WEEKDAY_BINS),
    "age_bin": bins_sql(AGE, *K.AGE_BINS),
}


def ctx_sql(keys):
    return " || '|' || ".join(f"'{k[:3].upper()}=' || {CTX_PARTS[k]}" for k in keys)


@query("build_context", f"WITH {FEATS} SELECT doc_id, {ctx_sql(K.CONTEXT_KEYS)} AS ctx FROM feats")
def build_context(spark, sf_dir):
    df = X.build_text_features(canonical(spark, sf_dir), drop_intermediate=False)
    return L.build_context(df).select("doc_id", "ctx")


def grid_sql(rows: str, min_samples: int) -> str:
    """Row-wise rewards of all pairs per context: the brute-force form of the search."""
    lows = ", ".join(f"CAST({v!r} AS DOUBLE)" for v in K.GRID_LOWS)
    highs = ", ".join(f"CAST({v!r} AS DOUBLE)" for v in K.GRID_HIGHS)
    return f"""pairs AS (SELECT lo, hi FROM (SELECT unnest([{lows}]) AS lo), (SELECT unnest([{highs}]) AS hi) WHERE lo < hi),
      gx AS (SELECT ctx, lo, hi, count(*) AS n, avg({cost_sql('lo', 'hi')}) AS r, avg(CASE WHEN p_fake < lo OR p_fake > hi THEN 1.0 ELSE 0.0 END::DOUBLE) AS cov
        FROM (SELECT ctx, p_fake, label FROM {rows} UNION ALL SELECT '*', p_fake, label FROM {rows}), pairs GROUP BY ctx, lo, hi),
      gb AS (SELECT * FROM gx QUALIFY row_number() OVER (PARTITION BY ctx ORDER BY r DESC, lo, hi) = 1),
      th AS (SELECT b.ctx, CASE WHEN b.n >= {min_samples} THEN b.lo ELSE g.lo END AS tau_low, CASE WHEN b.n >= {min_samples} THEN b.hi ELSE g.hi END AS tau_high,
        b.n, CASE WHEN b.ctx = '*' THEN 'global' WHEN b.n >= {min_samples} THEN 'context' ELSE 'global_fallback' END AS used,
        CASE WHEN b.ctx = '*' OR b.n >= {min_samples} THEN b.r END AS reward_best, CASE WHEN b.ctx = '*' OR b.n >= {min_samples} THEN b.cov END AS coverage
        FROM gb b, (SELECT * FROM gb WHERE ctx = '*') g)"""


# 399 labelled rows: contexts of two keys and a small minimum show both branches
KEYS2, MIN2 = ("category", "clickbait"), 40
SCORED_FEATS = f"{FEATS}, sf AS (SELECT *, {P_FAKE} AS p_fake FROM feats WHERE label IS NOT NULL)"
CTX2 = f"{SCORED_FEATS}, cx AS (SELECT *, {ctx_sql(KEYS2)} AS ctx FROM sf)"


def scored_features(spark, sf_dir):
    return X.build_text_features(scored(spark, sf_dir), drop_intermediate=False)


def with_context(spark, sf_dir):
    df = L.build_context(scored_features(spark, sf_dir), KEYS2)
    return cut_lineage(df.select("doc_id", "label", "p_fake", "ctx"))


@query("search_thresholds", f"""WITH {CTX2}, {grid_sql('cx', MIN2)} SELECT ctx, {r6s('tau_low')} AS tau_low, {r6s('tau_high')} AS tau_high, n, used,
    {r6s('reward_best')} AS reward_best, {r6s('coverage')} AS coverage FROM th""")
def search_thresholds(spark, sf_dir):
    return evaluated(L.search_thresholds(with_context(spark, sf_dir), min_samples=MIN2))


APPLIED = f"""ap AS (SELECT cx.doc_id, cx.label, cx.p_fake, cx.ctx, coalesce(t.tau_low, g.tau_low) AS tau_low, coalesce(t.tau_high, g.tau_high) AS tau_high
    FROM cx LEFT JOIN th t ON t.ctx = cx.ctx, (SELECT * FROM th WHERE ctx = '*') g),
  dec AS (SELECT *, CASE WHEN p_fake < tau_low THEN 1 WHEN p_fake > tau_high THEN 0 ELSE -1 END AS y_hat FROM ap)"""


@query("apply_thresholds", f"""WITH {CTX2}, {grid_sql('cx', MIN2)}, {APPLIED}
    SELECT doc_id, ctx, {r6s('tau_low')} AS tau_low, {r6s('tau_high')} AS tau_high, y_hat, y_hat = -1 AS abstained FROM dec""")
def apply_thresholds(spark, sf_dir):
    df = with_context(spark, sf_dir)
    out = L.apply_thresholds(df, cut_lineage(L.search_thresholds(df, min_samples=MIN2)))
    return evaluated(out.select("doc_id", "ctx", "tau_low", "tau_high", "y_hat", "abstained"))


@query("lookup_thresholds", f"""WITH {CTX2}, {grid_sql('cx', MIN2)}, known AS (SELECT * FROM th WHERE ctx NOT LIKE '%UNK%'),
    g AS (SELECT * FROM th WHERE ctx = '*')
    SELECT doc_id, {r6s('coalesce(k.tau_low, g.tau_low)')} AS tau_low, {r6s('coalesce(k.tau_high, g.tau_high)')} AS tau_high
    FROM cx LEFT JOIN known k ON k.ctx = cx.ctx, g""")
def lookup_thresholds(spark, sf_dir):
    df = with_context(spark, sf_dir)
    known = cut_lineage(L.search_thresholds(df, min_samples=MIN2)).filter("ctx NOT LIKE '%UNK%'")
    return evaluated(L.lookup_thresholds(df, known).select("doc_id", "tau_low", "tau_high"))


SUMMARY = f"""SELECT count(*) AS n_val, {r6s(div('count(*) FILTER (y_hat <> -1)', 'count(*)'))} AS coverage,
    {r6s(div('count(*) FILTER (y_hat = label)', 'count(*) FILTER (y_hat <> -1)'))} AS accuracy_on_covered,
    {r6s(div('count(*) FILTER (y_hat = label)', 'count(*)'))} AS effective_accuracy,
    {r6s(div('2 * count(*) FILTER (y_hat = 0 AND label = 0)', '2 * count(*) FILTER (y_hat = 0 AND label = 0) + count(*) FILTER (y_hat = 0 AND label = 1) + count(*) FILTER (y_hat = 1 AND label = 0)'))} AS f1_fake_on_covered,
    count(*) FILTER (y_hat = 0 AND label = 1) AS fp, count(*) FILTER (y_hat = 1 AND label = 0) AS fn, count(*) FILTER (y_hat = -1) AS abstain"""
VAL = f"{SCORED_FEATS}, cx AS (SELECT *, {ctx_sql(KEYS2)} AS ctx FROM sf WHERE {U} < 0.2)"


@query("calibrate", f"""WITH {VAL}, {grid_sql('cx', 10)}, {APPLIED} {SUMMARY},
    {r6s('avg(' + cost_sql('tau_low', 'tau_high') + ')')} AS reward_estimate FROM dec""")
def calibrate(spark, sf_dir):
    _, summary = L.calibrate(scored_features(spark, sf_dir), "doc_id", KEYS2, min_samples=10)
    return evaluated(summary)


@query("eval_with_thresholds", f"""WITH {SCORED_FEATS}, cx AS (SELECT *, {ctx_sql(KEYS2)} AS ctx FROM sf), {grid_sql('cx', MIN2)},
    {APPLIED} {SUMMARY} FROM dec WHERE {uniform_sql('doc_id')} < 0.2""")
def eval_with_thresholds(spark, sf_dir):
    stored = cut_lineage(L.search_thresholds(with_context(spark, sf_dir), min_samples=MIN2))
    return evaluated(L.eval_with_thresholds(scored_features(spark, sf_dir), stored, "doc_id", KEYS2))


@query("score_with_abstain", f"""WITH {SCORED} SELECT doc_id, {r6s('p_fake')} AS prob_fake,
    CASE WHEN p_fake < 0.3::DOUBLE THEN 'REAL' WHEN p_fake > 0.7::DOUBLE THEN 'FAKE' ELSE 'ABSTAIN' END AS verdict FROM scored""")
def score_with_abstain(spark, sf_dir):
    from credence.operators.scoring import verdict_with_abstain
    return scored(spark, sf_dir).select("doc_id", r6("p_fake").alias("prob_fake"),
                                        verdict_with_abstain(F.col("p_fake")).alias("verdict"))
