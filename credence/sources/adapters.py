"""One adapter per raw dataset shape; each returns the canonical article columns."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence import constants as K
from credence.functions import labels as L
from credence.functions import urls as U
from credence.functions.text import blank_if_null
from credence.operators.translation import translate
from credence.sources.canonical import conform, distinct_rows, target_mean, union_articles


def adapt_claim_urls(gossip_fake: DataFrame, gossip_real: DataFrame,
                     political_fake: DataFrame, political_real: DataFrame) -> DataFrame:
    """Claim lists with a link and a headline: each file has its own label and category."""
    tagged = [
        (gossip_fake, K.FAKE, "gossip"), (gossip_real, K.REAL, "gossip"),
        (political_fake, K.FAKE, "political"), (political_real, K.REAL, "political"),
    ]
    claims = union_articles([
        df.drop("tweet_ids").withColumns({"label": F.lit(label), "category": F.lit(category)})
        for df, label, category in tagged])
    claims = claims.withColumnsRenamed({"news_url": "url"}).withColumns({
        "source": U.netloc(F.col("url")),
        "author": U.author_from_title(F.col("title")),
        "date_published": U.date_from_url(F.col("url")),
    })
    return conform(claims, {"text": "", "type": "unknown", "rating": 0.5})


def adapt_two_file(fake: DataFrame, true: DataFrame) -> DataFrame:
    """One file of fake and one of true articles."""
    both = union_articles([fake.withColumn("label", F.lit(K.FAKE)), true.withColumn("label", F.lit(K.REAL))])
    return conform(
        both.withColumn("url", U.url_from_text(F.col("text"))),
        {"source": "", "author": "unknown", "type": "unknown", "rating": 0.5},
        {"subject": "category", "date": "date_published"})


def adapt_string_label(df: DataFrame) -> DataFrame:
    """Articles labelled by the words FAKE and REAL."""
    out = df.withColumns({"label": L.string_label(F.col("label")), "url": U.url_from_text(F.col("text"))})
    return conform(out, {"type": "unknown", "author": "unknown", "rating": 0.5})


def adapt_author_rated(df: DataFrame) -> DataFrame:
    """Articles rated by the mean label of their author."""
    out = df.withColumnsRenamed({"site_url": "url"})
    out = out.withColumns({"label": L.string_label(F.col("label")), "source": U.netloc(F.col("url"))})
    return conform(target_mean(out, "author"), {"category": "articles"})


def adapt_fact_check(parts: list[DataFrame]) -> DataFrame:
    """Statements with a six-way verdict and the speaker's verdict history.

    rating = 0.7 * weighted history scaled to [0, 1] over the table + 0.3 * mean label of the speaker.
    """
    df = union_articles(parts)
    history = sum(
        (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w for c, w in K.FACT_CHECK_WEIGHTS.items()),
        F.lit(0.0))
    df = df.withColumns({
        "label": F.when(F.col("label").isin(K.FACT_CHECK_FAKE), F.lit(K.FAKE)).otherwise(F.lit(K.REAL)),
        "_history": history,
    })
    lowest, highest = (df.agg(f("_history")).scalar() for f in (F.min, F.max))
    df = target_mean(df, "speaker", out="_speaker_mean")
    df = df.withColumns({
        "rating": F.try_divide(F.col("_history") - lowest, highest - lowest) * 0.7
        + F.col("_speaker_mean") * 0.3,
        "title": F.coalesce(F.col("subject"), F.lit("unknown")),
        "text": F.col("statement"),
    })
    df = df.withColumns({
        "url": U.url_from_text(F.col("text")), "author": U.author_from_title(F.col("title"))})
    return conform(df, {"type": "unknown"})


def adapt_story_urls(df: DataFrame) -> DataFrame:
    """A list of links to fake stories: headline and source come from the link."""
    out = df.withColumnsRenamed({"URL of article": "url"})
    out = out.withColumns({
        "title": U.title_from_url(F.col("url")), "source": U.netloc(F.col("url")),
        "category": F.lit("stories"), "label": F.lit(K.FAKE)})
    return conform(out, {"author": "unknown", "rating": 0.5})


def adapt_video(df: DataFrame) -> DataFrame:
    """Annotated videos: undecided ones dropped, rating by channel, duplicates removed."""
    out = df.filter(F.col("normalized_annotation") != 0).withColumns({
        "label": F.when(F.col("normalized_annotation") == -1, F.lit(K.FAKE))
        .when(F.col("normalized_annotation") == 1, F.lit(K.REAL)),
        "source": U.channel_name(F.col("aria-label")),
    })
    out = out.withColumn("rating", L.channel_risk(F.col("source")))
    return distinct_rows(conform(
        out, {"text": "", "author": "unknown", "category": "Videos"},
        {"vid_title": "title", "vid_url": "url", "topic": "type"}))


def adapt_social_check(df: DataFrame) -> DataFrame:
    """Fact-checked posts with a four-level rating; only 'mostly true' counts as REAL."""
    low = F.lower(F.col("Rating"))
    rated = L.code_lookup(low, K.SOCIAL_RATINGS, None)
    true = F.coalesce((low == "mostly true").cast("int"), F.lit(K.FAKE))
    out = df.withColumns({"_rating": rated, "label": true}).drop("Rating")
    return conform(
        out, {"author": "unknown", "type": "unknown"},
        {"Category": "category", "Post URL": "url", "Page": "source", "Date Published": "date_published",
         "_rating": "rating"})


def adapt_multilingual(parts: list[DataFrame], memory: DataFrame, profiles: dict[str, list[str]],
                       target_lang: str = "en") -> DataFrame:
    """Articles of several languages: type filled from the label, title and text translated."""
    df = union_articles(parts).withColumnsRenamed(
        {"domain": "source", "date": "date_published", "headline": "title", "content": "text"})
    df = df.withColumn("type", F.when(F.col("F-type").isNull() & (F.col("label") == K.FAKE), F.lit("Fake"))
                       .when(F.col("F-type").isNull() & (F.col("label") == K.REAL), F.lit("unknown"))
                       .otherwise(F.col("F-type")))
    out = df
    for column in ("title", "text"):
        out = translate(out, column, memory, profiles, target_lang, out=column, counted=df)
    return conform(out, {"author": "unknown", "url": "", "rating": 0.5})


def adapt_bot_news(df: DataFrame) -> DataFrame:
    """Author-rated articles with gaps in author, title and text."""
    out = target_mean(df, "author")
    out = out.withColumns({
        "author": F.coalesce("author", F.lit("unknown")),
        "title": blank_if_null(F.col("title")), "text": blank_if_null(F.col("text"))})
    return conform(
        out.withColumn("url", U.url_from_text(F.col("text"))),
        {"category": "unknown", "type": "unknown"})


def adapt_typed_crawl(df: DataFrame) -> DataFrame:
    """A crawl whose type column decides the label; types without a verdict are left out."""
    out = df.withColumnsRenamed(
        {"domain": "source", "scraped_at": "date_published", "authors": "author", "content": "text"})
    out = out.withColumn("label", L.type_verdict(F.col("type"))).filter(F.col("label") != -1)
    out = target_mean(out, "author")
    out = out.withColumns({
        "author": F.coalesce("author", F.lit("unknown")), "title": blank_if_null(F.col("title")),
        "url": U.url_from_text(F.col("text")), "category": F.lit("unknow")})
    return conform(out)
