"""Bindings of sources, sinks, caches and streams. Files go below the session's shared folder."""
from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from catalog import sqlfn as S
from catalog.adapters import VERDICT, fact_checks
from catalog.augment import ARM_VALUES
from catalog.evaluation import CTX2, KEYS2, MIN2, evaluated, grid_sql, with_context
from catalog.features import _ALL, FEATS, _cols, _sel
from catalog.fixtures import CANON, canonical, documents, table, uniform_sql
from catalog.models import halves
from catalog.registry import ORACLES, query, r6, r6s
from catalog.vectors import INTERCEPT, MT, N_TERMS, SCORE, coefficients
from credence import constants as K
from credence.functions.hashing import uniform
from credence.operators import metrics as M
from credence.operators import models as MD
from credence.operators import scoring as C
from credence.operators import splits as G
from credence.operators import thresholds as L
from credence.operators import vectors as V
from credence.operators.layout import cut_lineage
from credence.session import work_path
from credence.sources import readers as R
from credence.sources import sinks as W
from credence.streaming import jobs as J

ARTICLES = f"""SELECT title, text, url, source, category, author, date_published, {r6s('doc_id % 3')} AS rating, type, label FROM canon"""


def articles(spark, sf_dir):
    df = canonical(spark, sf_dir).withColumn("rating", (F.col("doc_id") % 3).cast("double"))
    return df.select(*K.ARTICLE_COLUMNS)


@query("read_articles", f"WITH {CANON} {ARTICLES}")
def read_articles(spark, sf_dir):
    path = work_path(spark, "articles")
    W.write_csv(articles(spark, sf_dir), path)
    return evaluated(R.read_articles(spark, path))


@query("read_articles_split", f"WITH {CANON} {ARTICLES}")
def read_articles_split(spark, sf_dir):
    """The same file read by many tasks: records cut where the quote parity of all lines before them is even."""
    path = work_path(spark, "articles")
    W.write_csv(articles(spark, sf_dir), path)
    return evaluated(R.read_csv_split(spark, path, R.ARTICLE_SCHEMA))


@query("read_fact_checks", f"""WITH {CANON} SELECT CAST(doc_id AS VARCHAR) AS id, {VERDICT} AS label, text AS statement,
    CAST(doc_id % 7 AS INTEGER) AS barely_true_c, CAST(CASE WHEN doc_id % 10 <> 3 THEN doc_id % 2 END AS INTEGER) AS pants_on_fire_c FROM canon""")
def read_fact_checks(spark, sf_dir):
    path = work_path(spark, "facts")
    parts = fact_checks(spark, sf_dir)
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    W.write_csv(whole, path, sep="\t", header=False)
    return R.read_fact_checks(spark, path).select("id", "label", "statement", "barely_true_c", "pants_on_fire_c")


@query("read_table", "SELECT doc_id, lang, source FROM documents")
def read_table(spark, sf_dir):
    return R.read_table(spark, f"{sf_dir}/documents.parquet", columns=["doc_id", "lang", "source"])


@query("read_columns", f"WITH {CANON} SELECT title, label FROM canon")
def read_columns(spark, sf_dir):
    path = work_path(spark, "articles")
    W.write_csv(articles(spark, sf_dir), path)
    return R.read_articles(spark, path, columns=["title", "label"])


_LINE_LABEL = "CASE WHEN event_id % 50 = 7 THEN NULL WHEN event_id % 50 = 8 THEN 'maybe' ELSE CAST(event_id % 2 AS STRING) END"


@query("read_labelled_jsonl", f"""SELECT event_type || ' ' || props AS text_ns_text, CAST(event_id % 2 AS INTEGER) AS label
    FROM events WHERE event_id % 1000 <> 5 AND event_id % 50 NOT IN (7, 8)""")
def read_labelled_jsonl(spark, sf_dir):
    path = work_path(spark, "lines")
    rows = table(spark, sf_dir, "events").selectExpr("event_id", f"concat(event_type, ' ', props) AS text_ns_text", f"{_LINE_LABEL} AS label")
    line = F.to_json(F.struct("text_ns_text", "label"))
    broken = F.when(F.col("event_id") % 1000 == 5, F.concat(F.lit("{broken "), line)).otherwise(line)
    rows.select(broken.alias("value")).write.text(path)
    return R.read_labelled_jsonl(spark, path, "text_ns_text", "label")


@query("bad_jsonl_lines", "SELECT count(*) AS n_bad FROM events WHERE event_id % 1000 = 5")
def bad_jsonl_lines(spark, sf_dir):
    path = work_path(spark, "lines")
    rows = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct("event_type", "value")).alias("line"))
    rows.select(F.when(F.col("event_id") % 1000 == 5, F.lit("{not json")).otherwise(F.col("line")).alias("value")).write.text(path)
    lines = R.read_jsonl(spark, path, "event_type string, value double").cache()
    return lines.filter(F.col(R.BAD_LINE).isNotNull()).agg(F.count("*").alias("n_bad"))


@query("write_features_csv", f"WITH {CANON} SELECT count(*) AS n_rows, count(title) AS n_titles, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM canon")
def write_features_csv(spark, sf_dir):
    path = work_path(spark, "merged")
    W.write_csv(articles(spark, sf_dir), path)
    back = R.read_articles(spark, path)
    return back.agg(F.count("*").alias("n_rows"), F.count("title").alias("n_titles"), F.sum(F.length("text")).alias("n_chars"))


@query("log_predictions", f"""WITH {CANON} SELECT md5(text) AS text_key, CASE WHEN {uniform_sql('doc_id')} >= 0.5 THEN 'FAKE' ELSE 'REAL' END AS verdict,
    {r6s(uniform_sql('doc_id'))} AS prob_fake, true AS stamped FROM canon""")
def log_predictions(spark, sf_dir):
    """Two appends to one log, read back with the log schema."""
    path = work_path(spark, "log")
    p = uniform(F.col("doc_id"), 42)
    df = canonical(spark, sf_dir).select("doc_id", "text", F.struct(C.verdict(p).alias("label"), p.alias("prob_fake")).alias("result"))
    for part in (0, 1):
        rows = df.filter(F.col("doc_id") % 2 == part)
        W.log_predictions(rows.select(*W.prediction_record(F.col("text"), F.col("result"))), path)
    log = spark.read.schema(R.LOG_SCHEMA).json(path)
    return log.select(F.md5("text").alias("text_key"), F.col("result.label").alias("verdict"),
                      r6("result.prob_fake").alias("prob_fake"), F.col("timestamp").isNotNull().alias("stamped"))


@query("write_report", f"""WITH {CTX2}, {grid_sql('cx', MIN2)} SELECT ctx, {r6s('tau_low')} AS tau_low, {r6s('tau_high')} AS tau_high, n, used FROM th""")
def write_report(spark, sf_dir):
    path = work_path(spark, "report")
    W.write_report(L.search_thresholds(with_context(spark, sf_dir), min_samples=MIN2), path)
    back = spark.read.schema("ctx string, tau_low double, tau_high double, n bigint, used string").json(path)
    return evaluated(back)


@query("embedding_cache", ORACLES["hashed_embedding"])
def embedding_cache(spark, sf_dir):
    """The cache is filled for some articles first; the second call computes the missing ones only."""
    df = canonical(spark, sf_dir)
    texts = df.select("doc_id", V.model_text(df).alias("mt"))
    path = work_path(spark, "embeddings")

    def compute(keys):
        return V.hashed_embedding(texts.join(keys, "doc_id", "left_semi"), "doc_id", "mt")

    keys = texts.select("doc_id")
    W.cached_rows(keys.filter("doc_id % 3 = 1"), path, ["doc_id"], compute)
    return evaluated(W.cached_rows(keys, path, ["doc_id"], compute))


@query("materialize_once", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def materialize_once(spark, sf_dir):
    path = work_path(spark, "once")
    W.materialize_once(spark, path, lambda: documents(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n")))
    return W.materialize_once(spark, path, lambda: 1 / 0)


@query("save_load_model")
def save_load_model(spark, sf_dir):
    """A saved and reloaded pipeline scores like the one in memory."""
    df = table(spark, sf_dir, "embeddings").selectExpr("vec_id AS doc_id", "embedding", "CAST(label % 2 AS INT) AS label")
    rows = MD.embedding_rows(df, "doc_id", "embedding")
    model = Pipeline(stages=[MD.logit(weight=None, max_iter=10)]).fit(rows)
    path = W.save_model(model, f"{W.run_path(work_path(spark, 'models'))}/logit")
    loaded: PipelineModel = W.load_model(path)
    a = model.transform(rows).select("doc_id", MD.p_fake_of().alias("p_fake"))
    b = loaded.transform(rows).select("doc_id", MD.p_fake_of().alias("p_loaded"))
    return evaluated(a.join(b, "doc_id"))


# ---- streams ------------------------------------------------------------------------------------

ARTICLE_STREAM = "doc_id long, title string, text string, label int"


def landed(df, spark, parts=3, order="doc_id"):
    """Write rows as JSON files, one append per part."""
    path = work_path(spark, "landing")
    ranked = cut_lineage(df.withColumn("_part", F.pmod(F.col(order), F.lit(parts))))
    for i in range(parts):
        ranked.filter(F.col("_part") == i).drop("_part").coalesce(2).write.mode("append").json(path)
    return path


@query("stream_chunks", "SELECT count(*) AS n_rows, CAST(sum(length(text)) AS BIGINT) AS n_chars, true AS chunked FROM documents")
def stream_chunks(spark, sf_dir):
    path, out, cp = landed(documents(spark, sf_dir).select("doc_id", "text"), spark), work_path(spark, "chunks"), work_path(spark, "cp")
    J.stream_chunks(J.arriving(spark, path, "doc_id long, text string", 2), out, cp,
                    lambda b: b.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("c")))
    back = spark.read.parquet(f"{out}/chunk-*")
    return back.agg(F.sum("n").alias("n_rows"), F.sum("c").alias("n_chars"), (F.count_distinct("chunk") >= 3).alias("chunked"))


@query("stream_features", f"WITH {FEATS} SELECT doc_id, label, {_sel(_ALL)} FROM feats")
def stream_features(spark, sf_dir):
    source = canonical(spark, sf_dir).select("doc_id", "title", "text", "label")
    path, out, cp = landed(source, spark), work_path(spark, "features"), work_path(spark, "cp")
    J.stream_features(J.arriving(spark, path, ARTICLE_STREAM, 2), out, cp)
    return spark.read.parquet(out).select("doc_id", "label", *_cols(_ALL))


@query("stream_score", f"""WITH {SCORE} SELECT doc_id, CASE WHEN doc_id % 17 = 3 THEN NULL WHEN p >= 0.5 THEN 'FAKE' ELSE 'REAL' END AS verdict,
    CASE WHEN doc_id % 17 <> 3 THEN {r6s('p')} END AS prob_fake, CASE WHEN doc_id % 17 = 3 THEN 'missing ''text''' END AS error FROM pf""")
def stream_score(spark, sf_dir):
    df = canonical(spark, sf_dir)
    keys = df.select("doc_id", V.model_text(df).alias("text"))
    vocabulary = cut_lineage(V.tfidf_word(keys, "doc_id", "text", max_features=N_TERMS)[1])
    coef = cut_lineage(coefficients(vocabulary))

    def score(batch):
        weights = V.transform(batch, vocabulary, "doc_id", "text", max_features=N_TERMS)
        return C.score_tfidf(weights, coef, batch, "doc_id", INTERCEPT)

    requests = keys.withColumn("text", F.when(F.col("doc_id") % 17 == 3, F.lit(" \n ")).otherwise(F.col("text")))
    path, out, cp = landed(requests, spark), work_path(spark, "scored"), work_path(spark, "cp")
    J.stream_score(J.arriving(spark, path, "doc_id long, text string", 2), score, "doc_id", out, cp)
    back = spark.read.schema("doc_id long, verdict string, prob_fake double, error string").json(f"{out}/batch-*")
    return evaluated(back)


@query("stream_fit")
def stream_fit(spark, sf_dir):
    """Validation quality of the last stored version of a term model trained on an arriving stream."""
    df = canonical(spark, sf_dir).filter("label IS NOT NULL")
    train, val = halves(df.select("doc_id", "label", V.model_text(df).alias("text")))
    vocabulary = cut_lineage(V.word_vocabulary(train, "doc_id", "text"))

    def step(coef, bias, batch):
        weights = cut_lineage(V.transform(batch, vocabulary, "doc_id", "text", max_features=200_000))
        return MD.sgd_step(coef, bias, weights, G.class_weights(batch.select("doc_id", "label")), "doc_id", 5.0)

    path, state, cp = landed(train, spark), work_path(spark, "coef"), work_path(spark, "cp")
    J.stream_fit(J.arriving(spark, path, "doc_id long, label int, text string", 2), state, cp,
                 lambda: (vocabulary.select("term", F.lit(0.0).alias("coef")), 0.0), step)
    last = J.latest_version(spark, state)
    bias = last.filter("term IS NULL").first()["coef"]
    model = MD.TermModel(vocabulary, last.filter("term IS NOT NULL"), bias, 200_000)
    scores = MD.score_terms(model, val, "doc_id", "text").join(val, "doc_id")
    return evaluated(M.evaluate_scores(scores))


@query("stream_arm_values", f"WITH {ARM_VALUES} SELECT arm, {r6s('v')} AS value, n FROM arms")
def stream_arm_values(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("arm"), "event_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    path, state, cp = work_path(spark, "rewards"), work_path(spark, "arms"), work_path(spark, "cp")
    cuts = [None, *events.select(F.percentile_approx("at", [0.33, 0.67])).first()[0], None]
    for low, high in zip(cuts, cuts[1:]):
        part = events.filter((F.lit(low is None) | (F.col("at") >= (low or 0))) & (F.lit(high is None) | (F.col("at") < (high or 0))))
        part.write.mode("append").json(path)
        # each period is drained before the next arrives, in one batch however many files it has
        J.stream_arm_values(J.arriving(spark, path, "arm string, event_id long, value double, at long", 1_000_000),
                            state, cp, "arm", "at", "event_id", "value")
    return J.latest_version(spark, state).withColumn("value", r6("value"))


_MON = f"""log AS (SELECT event_id AS request_id, ts AS timestamp, CASE WHEN {uniform_sql('event_id')} >= 0.5 THEN 'FAKE' ELSE 'REAL' END AS verdict,
    {uniform_sql('event_id')} AS prob_fake FROM events), w AS (SELECT time_bucket(INTERVAL 1 HOUR, timestamp) AS s, * FROM log)"""


def monitored(spark, sf_dir):
    p = uniform(F.col("event_id"), 42)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("timestamp"),
        C.verdict(p).alias("verdict"), p.alias("prob_fake"))


def shown(df):
    fmt = "yyyy-MM-dd HH:mm:ss"
    return df.select(F.date_format("window_start", fmt).alias("window_start"), "verdict", "n", r6("mean_prob_fake").alias("mean_prob_fake"))


_MON_OUT = f"SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, verdict, count(*) AS n, {r6s('avg(prob_fake)')} AS mean_prob_fake FROM w"


@query("prediction_monitor", f"WITH {_MON} {_MON_OUT} GROUP BY s, verdict")
def prediction_monitor(spark, sf_dir):
    log = monitored(spark, sf_dir)
    return shown(J.monitor(log.unionByName(log)))


@query("stream_monitor", f"""WITH {_MON} {_MON_OUT} WHERE s + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY s, verdict""")
def stream_monitor(spark, sf_dir):
    """Windows the watermark has passed; every request is sent twice."""
    path, out, cp = work_path(spark, "log"), work_path(spark, "monitor"), work_path(spark, "cp")
    log = monitored(spark, sf_dir)
    log.unionByName(log).coalesce(4).write.parquet(path)
    schema = spark.read.parquet(path).schema
    J.stream_monitor(J.arriving(spark, path, schema, 100, "parquet"), out, cp)
    return shown(spark.read.parquet(out))
