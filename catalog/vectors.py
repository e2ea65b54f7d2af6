"""Bindings of vectors, linear scores and explanations."""
from __future__ import annotations

from pyspark.sql import functions as F

from catalog import sqlfn as S
from catalog.fixtures import CANON, canonical, documents, hash32_sql, table, uniform_sql
from catalog.registry import query, r6, r6s
from catalog.scalars import PROFILE_CODES, memory, translated_sql
from credence.functions import text as T
from credence.functions.hashing import uniform
from credence.operators import explain as E
from credence.operators import features as X
from credence.operators import scoring as C
from credence.operators import vectors as V
from credence.operators import word_vectors as WV
from credence.operators.layout import cut_lineage, stored
from credence.operators.profile import vector_tokens
from credence.operators.translation import translate

MT = "coalesce(title, '') || ' [SEP] ' || coalesce(text, '')"
N_TERMS = 200_000
N_CHAR_TERMS = 150_000


def texts(spark, sf_dir):
    df = canonical(spark, sf_dir)
    return df.select("doc_id", V.model_text(df).alias("mt"))


@query("model_text", f"WITH {CANON} SELECT doc_id, {MT} AS plain, substr({MT}, 1, 0) || coalesce(title, '') AS preferred FROM canon")
def model_text(spark, sf_dir):
    df = canonical(spark, sf_dir)
    prepared = df.withColumn("title_ns_text", F.col("title"))
    return prepared.select("doc_id", V.model_text(df).alias("plain"), V.model_text(prepared).alias("preferred"))


def word_sql(high: int, rows: str = "canon") -> str:
    grams = "k" if high == 1 else "list_concat(k, list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1]))"
    return f"tok AS (SELECT doc_id, {S.vector_tokens(MT)} AS k FROM {rows}), trm AS (SELECT doc_id, unnest({grams}) AS term FROM tok)"


def tfidf_sql(min_df: int, cap: int) -> str:
    return f"""tf AS (SELECT doc_id, term, count(*) AS tf FROM trm GROUP BY ALL),
      voc AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, ln((CAST((SELECT count(*) FROM canon) AS DOUBLE) + 1) / (count(*) + 1)) + 1 AS idf
        FROM tf GROUP BY term HAVING count(*) >= {min_df} ORDER BY cf DESC, term LIMIT {cap}),
      raw AS (SELECT doc_id, term, (1 + ln(CAST(tf AS DOUBLE))) * idf AS w FROM tf JOIN voc USING (term)),
      wts AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw)"""


TFIDF = f"{CANON}, {word_sql(2)}, {tfidf_sql(5, N_TERMS)}"


def fitted(spark, sf_dir):
    return V.tfidf_word(texts(spark, sf_dir), "doc_id", "mt", max_features=N_TERMS)


@query("tfidf_vocabulary", f"WITH {TFIDF} SELECT term, df, cf, {r6s('idf')} AS idf FROM voc")
def tfidf_vocabulary(spark, sf_dir):
    return fitted(spark, sf_dir)[1].withColumn("idf", r6("idf"))


@query("tfidf_word", f"WITH {TFIDF} SELECT doc_id, term, {r6s('weight')} AS weight FROM wts")
def tfidf_word(spark, sf_dir):
    return fitted(spark, sf_dir)[0].withColumn("weight", r6("weight"))


def char_sql(low: int, high: int) -> str:
    words = f"list_transform(list_filter(regexp_split_to_array(lower({MT}), '{S.WS}+'), lambda w: w <> ''), lambda w: ' ' || w || ' ')"
    grams = ", ".join(f"flatten(list_transform(list_filter(ws, lambda w: length(w) > {n}), lambda w: list_transform(range(1, length(w) - {n} + 2), lambda i: substr(w, i, {n}))))"
                      for n in range(low, high + 1))
    return (f"wrd AS (SELECT doc_id, {words} AS ws FROM canon), trm AS (SELECT doc_id, "
            f"unnest(flatten([{grams}, list_filter(ws, lambda w: length(w) <= {high})])) AS term FROM wrd)")


@query("tfidf_char", f"WITH {CANON}, {char_sql(3, 5)}, {tfidf_sql(5, N_CHAR_TERMS)} SELECT doc_id, term, {r6s('weight')} AS weight FROM wts")
def tfidf_char(spark, sf_dir):
    return V.tfidf_char(texts(spark, sf_dir), "doc_id", "mt", 3, 5, max_features=N_CHAR_TERMS)[0].withColumn("weight", r6("weight"))


@query("tfidf_transform", f"""WITH {TFIDF}, newtok AS (SELECT doc_id, {S.vector_tokens('text')} AS k FROM documents),
    newtrm AS (SELECT doc_id, unnest(list_concat(k, list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1]))) AS term FROM newtok),
    ntf AS (SELECT doc_id, term, count(*) AS tf FROM newtrm GROUP BY ALL),
    nraw AS (SELECT doc_id, term, (1 + ln(CAST(tf AS DOUBLE))) * idf AS w FROM ntf JOIN voc USING (term))
    SELECT doc_id, term, {r6s('w / sqrt(sum(w * w) OVER (PARTITION BY doc_id))')} AS weight FROM nraw""")
def tfidf_transform(spark, sf_dir):
    vocabulary = fitted(spark, sf_dir)[1]
    out = V.transform(documents(spark, sf_dir), vocabulary, "doc_id", "text", max_features=N_TERMS)
    return out.withColumn("weight", r6("weight"))


SCALED = ["text_n_chars", "text_n_tokens", "text_n_digits", "text_url_count"]


def _numbers(spark, sf_dir):
    return X.build_text_features(canonical(spark, sf_dir)).select("doc_id", *SCALED)


def _numbers_sql():
    from catalog.features import FEATS
    return f"{FEATS}, num AS (SELECT doc_id, {', '.join(SCALED)} FROM feats)"


@query("max_abs_scale", lambda: f"WITH {_numbers_sql()} SELECT doc_id, " + ", ".join(
    r6s(f"coalesce({c} / nullif(CAST((SELECT max(abs({c})) FROM num) AS DOUBLE), 0), 0)") + f" AS {c}" for c in SCALED) + " FROM num")
def max_abs_scale(spark, sf_dir):
    return V.max_abs_scale(_numbers(spark, sf_dir), SCALED).select("doc_id", *[r6(c).alias(c) for c in SCALED])


@query("std_scale", lambda: f"WITH {_numbers_sql()} SELECT doc_id, " + ", ".join(
    r6s(f"{c} / CASE WHEN (SELECT stddev_pop({c}) FROM num) > 0 THEN (SELECT stddev_pop({c}) FROM num) ELSE 1 END") + f" AS {c}" for c in SCALED) + " FROM num")
def std_scale(spark, sf_dir):
    return V.std_scale(_numbers(spark, sf_dir), SCALED).select("doc_id", *[r6(c).alias(c) for c in SCALED])


@query("feature_blocks", lambda: f"""WITH {_numbers_sql()}, {word_sql(2)}, {tfidf_sql(5, N_TERMS)}
    SELECT doc_id, 'word:' || term AS term, {r6s('weight')} AS weight FROM wts UNION ALL """ + " UNION ALL ".join(
    f"SELECT doc_id, 'num:{c}', {r6s(f'{c} / CAST((SELECT max(abs({c})) FROM num) AS DOUBLE)')} FROM num WHERE {c} <> 0" for c in SCALED))
def feature_blocks(spark, sf_dir):
    weights = fitted(spark, sf_dir)[0]
    numbers = V.numeric_block(_numbers(spark, sf_dir), "doc_id", SCALED)
    return V.concat_blocks({"word": weights, "num": numbers}).withColumn("weight", r6("weight"))


@query("numeric_columns", "SELECT unnest(['doc_id', " + ", ".join(f"'{c}'" for c in X.FEATURE_COLUMNS) + "]) AS column_name, (SELECT count(*) FROM documents) AS n_rows")
def numeric_columns(spark, sf_dir):
    df = X.article_features(canonical(spark, sf_dir))
    names = F.array(*[F.lit(c) for c in V.numeric_columns(df)])
    return df.agg(F.count("*").alias("n_rows")).select(F.explode(names).alias("column_name"), "n_rows")


@query("hashed_embedding", f"""WITH {CANON}, {word_sql(1)}, tf AS (SELECT doc_id, term, count(*) AS tf FROM trm GROUP BY ALL),
    sl AS (SELECT doc_id, CAST({hash32_sql('term', 11)} % 64 AS INTEGER) AS dim,
      sum(CASE WHEN ({hash32_sql('term', 11)} // 64) % 2 = 0 THEN tf ELSE -tf END) AS v FROM tf GROUP BY ALL)
    SELECT doc_id, dim, {r6s('v / sqrt(sum(CAST(v * v AS DOUBLE)) OVER (PARTITION BY doc_id))')} AS value FROM sl WHERE v <> 0""")
def hashed_embedding(spark, sf_dir):
    return V.hashed_embedding(texts(spark, sf_dir), "doc_id", "mt").withColumn("value", r6("value"))


@query("unit_vectors", f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 3) AS v FROM embeddings),
    n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS len FROM e)
    SELECT vec_id, unnest(range(64)) AS pos, {r6s('unnest(v) / len')} AS value FROM n""")
def unit_vectors(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").withColumn("v", F.transform("embedding", lambda x: x.cast("double") * 3))
    out = V.unit_vectors(df.select("vec_id", "v"), "v").select("vec_id", F.posexplode("v").alias("pos", "value"))
    return out.select("vec_id", F.col("pos").cast("bigint").alias("pos"), r6("value").alias("value"))


@query("embed_text", """WITH c AS (SELECT doc_id, list_transform(['a','e','i','o','n','s','t',' '], lambda ch: CAST(length(text) - length(replace(text, ch, '')) AS DOUBLE)) AS v FROM documents),
    n AS (SELECT doc_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS len FROM c)
    SELECT doc_id, array_to_string(list_transform(v, lambda x: CAST(CAST(floor(CASE WHEN len > 0 THEN x / len ELSE x END * 1000 + 0.5) AS BIGINT) AS VARCHAR)), ',') AS embedding FROM n""")
def embed_text(spark, sf_dir):
    def letter_counts(batch):
        return [[float(t.count(ch)) for ch in "aeionst "] for t in batch]

    out = V.embed_text(documents(spark, sf_dir), "doc_id", "text", letter_counts)
    milli = F.transform("embedding", lambda x: F.floor(x * 1000 + 0.5).cast("string"))
    return out.select("doc_id", F.array_join(milli, ",").alias("embedding"))


# ---- scores and explanations -------------------------------------------------------------------

COEF = f"coef AS (SELECT term, ({uniform_sql('term', 5)} - 0.5::DOUBLE) * 4 AS coef FROM voc)"
INTERCEPT = 0.1
SCORE = f"""{TFIDF}, {COEF}, mg AS (SELECT c.doc_id, coalesce(s, 0) + {INTERCEPT}::DOUBLE AS margin FROM canon c LEFT JOIN
    (SELECT doc_id, sum(weight * coef) AS s FROM wts JOIN coef USING (term) GROUP BY doc_id) q ON c.doc_id = q.doc_id),
  pf AS (SELECT doc_id, 1 / (1 + exp(-margin)) AS p FROM mg)"""


def coefficients(vocabulary):
    return vocabulary.select("term", ((uniform(F.col("term"), 5) - 0.5) * 4).alias("coef"))


def linear(spark, sf_dir, once=False):
    """Texts, their stored weights and hashed stand-in coefficients. Weights that are read once are not stored but
    hashed by document."""
    keys = texts(spark, sf_dir)
    weights, vocabulary = V.tfidf_word(keys, "doc_id", "mt", max_features=N_TERMS, together=once)
    return keys, weights if once else stored(weights), cut_lineage(coefficients(vocabulary))


PROBS = ["prob_fake", "prob_fake_tfidf", "prob_fake_emb"]


def rounded(df):
    return df.withColumns({c: r6(c) for c in PROBS})


@query("score_tfidf", f"""WITH {SCORE} SELECT doc_id, 'tfidf' AS model_used, CASE WHEN p >= 0.5 THEN 'FAKE' ELSE 'REAL' END AS verdict,
    {r6s('p')} AS prob_fake, {r6s('p')} AS prob_fake_tfidf, CAST(NULL AS DOUBLE) AS prob_fake_emb FROM pf""")
def score_tfidf(spark, sf_dir):
    keys, weights, coef = linear(spark, sf_dir)
    return rounded(C.score_tfidf(weights, coef, keys, "doc_id", INTERCEPT))


EMB_COEF = [((i * 37) % 64 - 31.5) / 8 for i in range(64)]
EMB_P = (f"1 / (1 + exp(-(list_sum(list_transform(list_zip(embedding, [{', '.join(f'{c}::DOUBLE' for c in EMB_COEF)}]), "
         f"lambda z: CAST(z[1] AS DOUBLE) * z[2])) - 0.2::DOUBLE)))")


@query("score_embedding", f"""WITH p AS (SELECT vec_id, {EMB_P} AS p FROM embeddings) SELECT vec_id, 'emb' AS model_used,
    CASE WHEN p >= 0.5 THEN 'FAKE' ELSE 'REAL' END AS verdict, {r6s('p')} AS prob_fake, CAST(NULL AS DOUBLE) AS prob_fake_tfidf, {r6s('p')} AS prob_fake_emb FROM p""")
def score_embedding(spark, sf_dir):
    return rounded(C.score_embedding(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", EMB_COEF, -0.2))


@query("score_fusion", f"""WITH {SCORE}, em AS (SELECT vec_id, {EMB_P} AS e FROM embeddings), b AS (SELECT doc_id, p, e FROM pf JOIN em ON vec_id = doc_id),
    f AS (SELECT *, 1 / (1 + exp(-(p * 3::DOUBLE + e * 2::DOUBLE - 2.4::DOUBLE))) AS q FROM b)
    SELECT doc_id, 'fusion' AS model_used, CASE WHEN q >= 0.5 THEN 'FAKE' ELSE 'REAL' END AS verdict, {r6s('q')} AS prob_fake,
      {r6s('p')} AS prob_fake_tfidf, {r6s('e')} AS prob_fake_emb FROM f""")
def score_fusion(spark, sf_dir):
    keys, weights, coef = linear(spark, sf_dir)
    tfidf = C.score_tfidf(weights, coef, keys, "doc_id", INTERCEPT)
    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    emb = C.score_embedding(vectors, "doc_id", "embedding", EMB_COEF, -0.2)
    return rounded(C.score_fusion(tfidf, emb, "doc_id", 3.0, 2.0, -2.4))


CONTRIB = f"""{SCORE}, mean AS (SELECT term, coef, coef * coalesce(m, 0) AS base FROM coef LEFT JOIN
      (SELECT term, sum(weight) / (SELECT count(*) FROM canon) AS m FROM wts GROUP BY term) USING (term)),
    pres AS (SELECT doc_id, term, coef * weight - base AS effect, base FROM wts JOIN mean USING (term)),
    con AS (SELECT doc_id, term, effect FROM pres UNION ALL SELECT c.doc_id, '{E.ABSENT}',
      coalesce((SELECT sum(base) FROM pres q WHERE q.doc_id = c.doc_id), 0) - (SELECT sum(base) FROM mean) FROM canon c)"""


def contributions(spark, sf_dir):
    keys, weights, coef = linear(spark, sf_dir)
    return E.linear_contributions(weights, coef, keys, "doc_id")


@query("linear_contributions", f"WITH {CONTRIB} SELECT doc_id, term, {r6s('effect')} AS effect FROM con")
def linear_contributions(spark, sf_dir):
    return contributions(spark, sf_dir).withColumn("effect", r6("effect"))


OCC = f"""{SCORE}, oc AS (SELECT doc_id, term, weight, weight * coef AS part, sum(weight * coef) OVER (PARTITION BY doc_id) AS s FROM wts JOIN coef USING (term)),
    occ AS (SELECT doc_id, term, 1 / (1 + exp(-(s + {INTERCEPT}::DOUBLE))) - 1 / (1 + exp(-(CASE WHEN greatest(1 - weight * weight, 0) > 1e-12
      THEN (s - part) / sqrt(greatest(1 - weight * weight, 0)) ELSE 0 END + {INTERCEPT}::DOUBLE))) AS effect FROM oc)"""


@query("occlusion_explain", f"WITH {OCC} SELECT doc_id, term, {r6s('effect')} AS effect FROM occ")
def occlusion_explain(spark, sf_dir):
    _, weights, coef = linear(spark, sf_dir, once=True)
    return E.occlusion(weights, coef, "doc_id", INTERCEPT).withColumn("effect", r6("effect"))


@query("perturbation_explain")
def perturbation_explain(spark, sf_dir):
    keys, weights, coef = linear(spark, sf_dir)
    tokens = keys.select("doc_id", vector_tokens(F.col("mt")).alias("tokens"))
    return E.perturbation_explain(weights, coef, tokens, "doc_id", INTERCEPT)


TOP = f"""tk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY abs(effect) DESC, term) AS r FROM con WHERE term <> '{E.ABSENT}'),
    top AS (SELECT doc_id, string_agg(term || ':' || CASE WHEN effect > 0 THEN 'FAKE' ELSE 'REAL' END, '|' ORDER BY r) AS tokens,
      {r6s('sum(abs(effect))')} AS mass FROM tk WHERE r <= 10 GROUP BY doc_id)"""


def joined_tokens(c="top_tokens"):
    return F.array_join(F.transform(c, lambda t: F.concat(t["token"], F.lit(":"), t["towards"])), "|")


@query("top_tokens", f"WITH {CONTRIB}, {TOP} SELECT doc_id, tokens, mass FROM top")
def top_tokens(spark, sf_dir):
    out = E.top_tokens(contributions(spark, sf_dir), "doc_id")
    mass = F.aggregate("top_tokens", F.lit(0.0), lambda s, t: s + F.abs(t["weight"]))
    return out.select("doc_id", joined_tokens().alias("tokens"), r6(mass).alias("mass"))


@query("highlight_tokens", f"""WITH {CONTRIB}, {TOP}, pc AS (SELECT doc_id, regexp_extract_all({MT}, '\\p{{L}}+|\\p{{Nd}}+') AS ps FROM canon),
    ex AS (SELECT doc_id, unnest(range(len(ps))) AS pos, unnest(ps) AS piece FROM pc)
    SELECT ex.doc_id, CAST(pos AS INTEGER) AS pos, piece, CASE WHEN effect > 0 THEN 'FAKE' ELSE 'REAL' END AS towards, {r6s('effect')} AS weight
    FROM ex JOIN (SELECT * FROM tk WHERE r <= 10) k ON k.doc_id = ex.doc_id AND k.term = lower(piece)
    JOIN pf ON pf.doc_id = ex.doc_id WHERE (effect > 0) = (p >= 0.5)""")
def highlight_tokens(spark, sf_dir):
    keys, weights, coef = linear(spark, sf_dir)
    tokens = E.top_tokens(E.linear_contributions(weights, coef, keys, "doc_id"), "doc_id")
    scores = C.score_tfidf(weights, coef, keys, "doc_id", INTERCEPT).select("doc_id", "verdict")
    out = E.highlight_tokens(keys.join(scores, "doc_id"), tokens, "doc_id", "mt")
    return out.withColumn("weight", r6("weight"))


@query("explain_batch", lambda: f"""{translated_sql()}, {CONTRIB}, {TOP} SELECT pf.doc_id, 'tfidf' AS model_used, 'linear' AS explainer,
    CASE WHEN p >= 0.5 THEN 'FAKE' ELSE 'REAL' END AS verdict, {r6s('p')} AS prob_fake, coalesce(tokens, '') AS tokens,
    tr IS NOT NULL AS did_translate, det AS src_lang, 'en' AS tgt_lang FROM pf LEFT JOIN top USING (doc_id) LEFT JOIN joined ON joined.doc_id = pf.doc_id""")
def explain_batch(spark, sf_dir):
    keys, weights, coef = linear(spark, sf_dir)
    tokens = E.top_tokens(E.linear_contributions(weights, coef, keys, "doc_id"), "doc_id")
    scores = C.score_tfidf(weights, coef, keys, "doc_id", INTERCEPT)
    translated = translate(documents(spark, sf_dir), "text", memory(spark, sf_dir), T.stop_word_profiles(PROFILE_CODES))
    info = translated.selectExpr("doc_id", "text_did_translate AS did_translate", "text_lang AS src_lang", "'en' AS tgt_lang")
    r = F.col("result")
    return E.explain_batch(scores, tokens, "doc_id", "linear", info).select(
        "doc_id", r["model_used"].alias("model_used"), r["explainer"].alias("explainer"), r["label"].alias("verdict"),
        r6(r["prob_fake"]).alias("prob_fake"), joined_tokens(r["top_tokens"]).alias("tokens"),
        r["translation"]["did_translate"].alias("did_translate"), r["translation"]["src_lang"].alias("src_lang"),
        r["translation"]["tgt_lang"].alias("tgt_lang"))


_PAIRS = ("flatten(list_transform(range(1, {w} + 1), lambda d: list_transform(range(1, len(t) - d + 1), "
          "lambda i: {{'word': t[i], 'context': t[i + d]}})))")


@query("word_ppmi", f"""WITH t AS (SELECT {S.vector_tokens('text')} AS t FROM documents),
  voc AS (SELECT w AS word FROM (SELECT unnest(t) AS w FROM t) GROUP BY w HAVING count(*) >= {WV.MIN_COUNT}),
  f AS (SELECT {_PAIRS.format(w=WV.WINDOW)} AS f FROM t WHERE len(t) > 1),
  p AS (SELECT unnest(list_concat(f, list_transform(f, lambda x: {{'word': x.context, 'context': x.word}}))) AS x FROM f),
  c AS (SELECT x.word AS word, x.context AS context, count(*) AS n FROM p
        WHERE x.word IN (SELECT word FROM voc) AND x.context IN (SELECT word FROM voc) GROUP BY ALL),
  m AS (SELECT word, sum(n) AS nw FROM c GROUP BY word),
  s AS (SELECT c.word, c.context, c.n, ln(CAST(c.n AS DOUBLE) * CAST((SELECT sum(n) FROM c) AS DOUBLE)
        / (CAST(m1.nw AS DOUBLE) * m2.nw)) AS ppmi FROM c JOIN m m1 ON m1.word = c.word JOIN m m2 ON m2.word = c.context)
SELECT word, context, n, {r6s('ppmi')} AS ppmi FROM s WHERE ppmi > 0""")
def word_ppmi(spark, sf_dir):
    return WV.cooccurrence_ppmi(table(spark, sf_dir, "documents"), "text").withColumn("ppmi", r6("ppmi"))


@query("word_vectors")
def word_vectors(spark, sf_dir):
    return WV.fit_word_vectors(WV.cooccurrence_ppmi(table(spark, sf_dir, "documents"), "text"))


@query("embed_fitted")
def embed_fitted(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    vectors = cut_lineage(WV.fit_word_vectors(WV.cooccurrence_ppmi(docs, "text")))
    return WV.embed_documents(docs, "doc_id", "text", vectors)
