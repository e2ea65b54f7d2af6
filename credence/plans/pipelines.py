"""Whole jobs put together from the operators."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence import constants as K
from credence.operators import explain as E
from credence.operators.features import article_features
from credence.operators.layout import cut_lineage
from credence.operators.models import TermModel
from credence.operators.scoring import score_tfidf
from credence.operators.translation import translate
from credence.sources.canonical import content_id, merge_sources


def feature_table(parts: list[DataFrame], path: str) -> DataFrame:
    """Adapted sources to the stored feature table: merge, key, features, Parquet.

    The key is made of the content and the row's number in this write, so copies of an article in several
    sources stay rows of their own. It is fixed by the table that is written.
    """
    merged = merge_sources(parts).withColumn("_row", F.monotonically_increasing_id())
    keyed = merged.withColumn("doc_id", content_id("title", "text", "url", "_row")).drop("_row")
    article_features(keyed).write.mode("overwrite").parquet(path)
    return merged.sparkSession.read.parquet(path)


def credibility_report(articles: DataFrame, top: int = 20) -> DataFrame:
    """Sources graded by their articles: the `top` sources with most click-bait per article.

    Features are narrow and the source is pre-aggregated map-side, so one small shuffle moves a few
    numbers per (task, source), however large a source is.
    """
    features = article_features(articles)
    hits = F.col("title_clickbait_hits") + F.col("text_clickbait_hits")
    return (
        features.groupBy("source").agg(
            F.count("*").alias("articles"),
            F.avg("text_ttr").alias("mean_ttr"),
            F.avg("text_stopword_ratio").alias("mean_stopword_ratio"),
            F.avg((hits > 0).cast("double")).alias("clickbait_rate"),
            F.avg((F.col("label") == K.FAKE).cast("double")).alias("fake_share"),
        )
        .orderBy(F.desc("clickbait_rate"), "source").limit(top)
    )


def score_and_explain(requests: DataFrame, model: TermModel, key: str, memory: DataFrame,
                      profiles: dict[str, list[str]], target_lang: str = "en", k: int = 10) -> DataFrame:
    """Batch form of a prediction request: translate, score, explain, one record per request."""
    used = cut_lineage(translate(requests, "text", memory, profiles, target_lang, out="text_used"))
    docs = used.select(key, F.col("text_used").alias("text"))
    weights = cut_lineage(model.weights(docs, key, "text"))
    scores = score_tfidf(weights, model.coefficients, docs, key, model.intercept)
    tokens = E.top_tokens(E.linear_contributions(weights, model.coefficients, docs, key, model.background), key, k)
    info = used.select(key, F.col("text_did_translate").alias("did_translate"),
                       F.col("text_lang").alias("src_lang"), F.lit(target_lang).alias("tgt_lang"))
    return E.explain_batch(scores, tokens, key, "linear", info)
