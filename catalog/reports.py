"""Bindings of whole jobs."""
from __future__ import annotations

from pyspark.sql import functions as F

from catalog.adapters import bot_news, string_labelled
from catalog.evaluation import evaluated
from catalog.features import FEATS
from catalog.fixtures import canonical
from catalog.models import halves, labelled
from catalog.registry import query, r6s
from catalog.scalars import PROFILE_CODES, memory
from credence.functions import text as T
from credence.operators import models as MD
from credence.plans import pipelines as P
from credence.session import work_path
from credence.sources import adapters as A


@query("credibility_report", f"""WITH {FEATS}, s AS (SELECT source, count(*) AS articles, avg(text_ttr) AS a, avg(text_stopword_ratio) AS b,
      avg(CASE WHEN title_clickbait_hits + text_clickbait_hits > 0 THEN 1.0 ELSE 0.0 END::DOUBLE) AS c,
      avg(CASE label WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 END::DOUBLE) AS d FROM feats GROUP BY source)
    SELECT source, articles, {r6s('a')} AS mean_ttr, {r6s('b')} AS mean_stopword_ratio, {r6s('c')} AS clickbait_rate, {r6s('d')} AS fake_share
    FROM s ORDER BY c DESC, source LIMIT 20""")
def credibility_report(spark, sf_dir):
    return evaluated(P.credibility_report(canonical(spark, sf_dir)))


@query("feature_table", f"""WITH {FEATS}, u AS (SELECT label, text_n_tokens AS n FROM feats WHERE label IS NOT NULL UNION ALL
      SELECT label, text_n_tokens FROM feats WHERE label IS NOT NULL)
    SELECT label, count(*) AS n_rows, count(*) AS n_keys, CAST(sum(n) AS BIGINT) AS n_tokens FROM u GROUP BY label""")
def feature_table(spark, sf_dir):
    parts = [A.adapt_string_label(string_labelled(spark, sf_dir)), A.adapt_bot_news(bot_news(spark, sf_dir))]
    stored = P.feature_table(parts, work_path(spark, "features"))
    return stored.groupBy("label").agg(F.count("*").alias("n_rows"), F.countDistinct("doc_id").alias("n_keys"),
                                         F.sum("text_n_tokens").alias("n_tokens"))


@query("score_and_explain")
def score_and_explain(spark, sf_dir):
    """Every article scored, explained and recorded by a model fitted on the labelled ones."""
    train, _ = halves(labelled(spark, sf_dir))
    model = MD.fit_tfidf_logit(train, "doc_id", "mt")
    requests = canonical(spark, sf_dir).select("doc_id", "text")
    out = P.score_and_explain(requests, model, "doc_id", memory(spark, sf_dir), T.stop_word_profiles(PROFILE_CODES))
    return out.select("doc_id", F.to_json("result").alias("result"))
