"""Bindings of the source adapters: the canonical articles are projected to each raw shape and adapted back."""
from __future__ import annotations

from pyspark.sql import functions as F

from catalog import sqlfn as S
from catalog.fixtures import CANON, canonical
from catalog.registry import query, r6, r6s
from catalog.scalars import _ARIA, PROFILE_CODES, aria_label
from credence import constants as K
from credence.functions import text as T
from credence.sources import adapters as A
from credence.sources import canonical as C

COLS = ", ".join(K.ARTICLE_COLUMNS)


def out(df):
    return df.withColumn("rating", r6("rating"))


def select(**values) -> str:
    """Canonical columns of an adapter, in SQL."""
    casts = {"rating": r6s(values.get("rating", "0.5")), "label": f"CAST({values['label']} AS INTEGER)"}
    return "SELECT " + ", ".join(f"{casts.get(c, values.get(c, chr(39) * 2))} AS {c}" for c in K.ARTICLE_COLUMNS)


def claim_files(spark, sf_dir):
    """The articles dealt to the four claim files."""
    raw = canonical(spark, sf_dir).select(
        F.col("doc_id").alias("id"), F.col("url").alias("news_url"), "title", F.lit("1 2 3").alias("tweet_ids"))
    return [raw.filter(F.col("id") % 4 == i) for i in range(4)]


CLAIM = select(title="title", url="url", source=S.netloc("url"),
               category="CASE WHEN doc_id % 4 < 2 THEN 'gossip' ELSE 'political' END", author=S.author("title"),
               date_published=S.date_from_url("url"), type="'unknown'", label="doc_id % 2") + " FROM canon"


@query("adapt_claim_urls", f"WITH {CANON} {CLAIM}")
def adapt_claim_urls(spark, sf_dir):
    return out(A.adapt_claim_urls(*claim_files(spark, sf_dir)))


def two_files(spark, sf_dir):
    raw = canonical(spark, sf_dir).selectExpr("doc_id", "title", "text", "category AS subject", "date_published AS date")
    return [raw.filter(F.col("doc_id") % 2 == i).drop("doc_id") for i in (0, 1)]


TWO = select(title="title", text="text", url=S.url_from_text("text"), category="category", author="'unknown'",
             date_published="date_published", type="'unknown'", label="doc_id % 2") + " FROM canon"


@query("adapt_two_file", f"WITH {CANON} {TWO}")
def adapt_two_file(spark, sf_dir):
    return out(A.adapt_two_file(*two_files(spark, sf_dir)))


WORD_LABEL = "CASE label WHEN 0 THEN 'FAKE' WHEN 1 THEN 'Real' ELSE 'unsure' END"


def string_labelled(spark, sf_dir):
    return canonical(spark, sf_dir).selectExpr("doc_id AS `Unnamed: 0`", "title", "text", f"{WORD_LABEL} AS label")


STRING = select(title="title", text="text", url=S.url_from_text("text"), author="'unknown'", type="'unknown'",
                label="label") + " FROM canon"


@query("adapt_string_label", f"WITH {CANON} {STRING}")
def adapt_string_label(spark, sf_dir):
    return out(A.adapt_string_label(string_labelled(spark, sf_dir)))


def author_rated(spark, sf_dir):
    return canonical(spark, sf_dir).selectExpr(
        "author", "date_published AS published", "title", "text", "url AS site_url", "type",
        f"{WORD_LABEL} AS label", "1 AS hasImage")


def mean_sql(key, label="label", table="canon"):
    return f"(SELECT {key} AS mk, avg({label}) AS m FROM {table} WHERE {key} IS NOT NULL GROUP BY {key})"


AUTHOR = select(title="title", text="text", url="url", source=S.netloc("url"), category="'articles'", author="author",
                rating="coalesce(m, 0.5)", type="type", label="label") + f" FROM canon LEFT JOIN {mean_sql('author')} ON author = mk"


@query("adapt_author_rated", f"WITH {CANON} {AUTHOR}")
def adapt_author_rated(spark, sf_dir):
    return out(A.adapt_author_rated(author_rated(spark, sf_dir)))


VERDICT = ("CASE doc_id % 7 WHEN 0 THEN 'false' WHEN 1 THEN 'pants-fire' WHEN 2 THEN 'barely-true' "
           "WHEN 3 THEN 'half-true' WHEN 4 THEN 'mostly-true' WHEN 5 THEN 'true' END")


def fact_checks(spark, sf_dir):
    raw = canonical(spark, sf_dir).selectExpr(
        "doc_id AS id", f"{VERDICT} AS label", "text AS statement", "title AS subject", "author AS speaker",
        "'' AS job", "'' AS state", "'' AS party", "doc_id % 7 AS barely_true_c", "doc_id % 5 AS false_c",
        "doc_id % 3 AS half_true_c", "doc_id % 4 AS mostly_true_c",
        "CASE WHEN doc_id % 10 <> 3 THEN doc_id % 2 END AS pants_on_fire_c", "'' AS venue")
    return [raw.filter(F.col("id") % 3 == i) for i in range(3)]


FACT = f"""fc AS (SELECT *, CASE WHEN {VERDICT} IN ('false', 'pants-fire', 'barely-true') THEN 0 ELSE 1 END AS y,
    CAST(coalesce(CASE WHEN doc_id % 10 <> 3 THEN doc_id % 2 END, 0) * -2.0 + (doc_id % 5) * -1.5 + (doc_id % 7) * -1.0
      + (doc_id % 3) * 0.5 + (doc_id % 4) * 1.0 AS DOUBLE) AS h FROM canon),
  fr AS (SELECT *, (h - (SELECT min(h) FROM fc)) / ((SELECT max(h) FROM fc) - (SELECT min(h) FROM fc)) AS scaled FROM fc)"""
FACT_SELECT = select(title="coalesce(title, 'unknown')", text="text", url=S.url_from_text("text"),
                     author=S.author("coalesce(title, 'unknown')"), rating="scaled * 0.7 + coalesce(m, 0.5) * 0.3",
                     type="'unknown'", label="y") + f" FROM fr LEFT JOIN {mean_sql('author', 'y', 'fc')} ON author = mk"


@query("adapt_fact_check", f"WITH {CANON}, {FACT} {FACT_SELECT}")
def adapt_fact_check(spark, sf_dir):
    return out(A.adapt_fact_check(fact_checks(spark, sf_dir)))


def story_links(spark, sf_dir):
    return canonical(spark, sf_dir).selectExpr("'Fake' AS `Fake or Satire?`", "url AS `URL of article`")


STORY = select(title=S.title_from_url("url"), url="url", source=S.netloc("url"), category="'stories'",
               author="'unknown'", label="0") + " FROM canon"


@query("adapt_story_urls", f"WITH {CANON} {STORY}")
def adapt_story_urls(spark, sf_dir):
    return out(A.adapt_story_urls(story_links(spark, sf_dir)))


def videos(spark, sf_dir):
    df = canonical(spark, sf_dir).withColumn("aria-label", aria_label()).selectExpr(
        "url AS vid_url", "title AS vid_title", "`aria-label`", "doc_id % 3 - 1 AS normalized_annotation", "type AS topic")
    return df.unionByName(df)


_CH = S.channel(_ARIA)
VIDEO = select(title="title", url="url", source=_CH, category="'Videos'", author="'unknown'",
               rating=S.channel_risk(_CH), type="type", label="CASE doc_id % 3 WHEN 0 THEN 0 ELSE 1 END"
               ) + " FROM canon WHERE doc_id % 3 <> 1"


@query("adapt_video", f"WITH {CANON} {VIDEO}")
def adapt_video(spark, sf_dir):
    return out(A.adapt_video(videos(spark, sf_dir)))


SOCIAL_RATING = ("CASE doc_id % 5 WHEN 0 THEN 'Mostly True' WHEN 1 THEN 'mixture of true and false' "
                 "WHEN 2 THEN 'no factual content' WHEN 3 THEN 'mostly false' END")


def posts(spark, sf_dir):
    return canonical(spark, sf_dir).selectExpr(
        "category AS Category", "url AS `Post URL`", "source AS Page", "date_published AS `Date Published`",
        f"{SOCIAL_RATING} AS Rating")


SOCIAL = select(url="url", source="source", category="category", author="'unknown'", date_published="date_published",
                rating="CASE doc_id % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.25 WHEN 3 THEN 0.0 END",
                type="'unknown'", label="CASE doc_id % 5 WHEN 0 THEN 1 ELSE 0 END") + " FROM canon"


@query("adapt_social_check", f"WITH {CANON} {SOCIAL}")
def adapt_social_check(spark, sf_dir):
    return out(A.adapt_social_check(posts(spark, sf_dir)))


def multilingual_files(spark, sf_dir):
    raw = canonical(spark, sf_dir).selectExpr(
        "doc_id", "source AS domain", "date_published AS date", "category", "title AS headline", "text AS content",
        "CAST(doc_id % 2 AS INT) AS label", "type AS `F-type`")
    return [raw.filter(F.col("doc_id") % 4 == i).drop("doc_id") for i in range(4)]


def article_memory(spark, sf_dir):
    """Known translations: the text of every third article under its dominant language."""
    df = canonical(spark, sf_dir).filter("doc_id % 3 = 0")
    return df.selectExpr("text", "lang AS src", "'en' AS tgt", "concat('[en] ', text) AS translation")


def multi_tables() -> str:
    return f"""tagged AS (SELECT *, {S.detect_lang('title')} AS dt, {S.detect_lang('text')} AS dx FROM canon),
      tm AS (SELECT text AS k, lang AS src, min('[en] ' || text) AS tr FROM canon WHERE doc_id % 3 = 0 GROUP BY 1, 2),
      j AS (SELECT g.*, a.tr AS title_tr, b.tr AS text_tr FROM tagged g
        LEFT JOIN tm a ON dt <> 'en' AND a.k = title AND a.src = dt
        LEFT JOIN tm b ON dx <> 'en' AND b.k = g.text AND b.src = dx)"""


def multi_select() -> str:
    return select(
        title="coalesce(title_tr, title)", text="coalesce(text_tr, text)", source="source", category="category",
        author="'unknown'", date_published="date_published",
        type="CASE WHEN type IS NULL AND doc_id % 2 = 0 THEN 'Fake' WHEN type IS NULL THEN 'unknown' ELSE type END",
        label="doc_id % 2") + " FROM j"


@query("adapt_multilingual", lambda: f"WITH {CANON}, {multi_tables()} {multi_select()}")
def adapt_multilingual(spark, sf_dir):
    return out(A.adapt_multilingual(multilingual_files(spark, sf_dir), article_memory(spark, sf_dir),
                                    T.stop_word_profiles(PROFILE_CODES)))


def bot_news(spark, sf_dir):
    return canonical(spark, sf_dir).select("author", "title", "text", "label")


BOT = select(title="coalesce(title, '')", text="coalesce(text, '')", url=S.url_from_text("text"), category="'unknown'",
             author="coalesce(author, 'unknown')", rating="coalesce(m, 0.5)", type="'unknown'", label="label"
             ) + f" FROM canon LEFT JOIN {mean_sql('author')} ON author = mk"


@query("adapt_bot_news", f"WITH {CANON} {BOT}")
def adapt_bot_news(spark, sf_dir):
    return out(A.adapt_bot_news(bot_news(spark, sf_dir)))


def typed_crawl(spark, sf_dir):
    return canonical(spark, sf_dir).selectExpr(
        "source AS domain", "date_published AS scraped_at", "author AS authors", "title", "text AS content", "type")


CRAWL_ROWS = f"tc AS (SELECT * FROM (SELECT *, {S.type_verdict('type')} AS y FROM canon) WHERE y <> -1)"
CRAWL = select(title="coalesce(title, '')", text="text", url=S.url_from_text("text"), source="source",
               category="'unknow'", author="coalesce(author, 'unknown')", date_published="date_published",
               rating="coalesce(m, 0.5)", type="type", label="y"
               ) + f" FROM tc LEFT JOIN {mean_sql('author', 'y', 'tc')} ON author = mk"


@query("adapt_typed_crawl", f"WITH {CANON}, {CRAWL_ROWS} {CRAWL}")
def adapt_typed_crawl(spark, sf_dir):
    return out(A.adapt_typed_crawl(typed_crawl(spark, sf_dir)))


@query("conform", f"""WITH {CANON} SELECT doc_id, title, text, url, '' AS source, category, 'unknown' AS author,
    date_published, {r6s('0.25')} AS rating, '' AS type, label FROM canon""")
def conform(spark, sf_dir):
    raw = canonical(spark, sf_dir).selectExpr("doc_id", "title AS headline", "text", "url", "category", "date_published", "label")
    return out(C.conform(raw, {"author": "unknown", "rating": 0.25, "category": "ignored"}, {"headline": "title"}, ["doc_id"]))


MERGE = " UNION ALL ".join(f"({p})" for p in (CLAIM, TWO, STRING, AUTHOR, FACT_SELECT, STORY, VIDEO, SOCIAL, BOT, CRAWL))


@query("merge_sources", lambda: f"""WITH {CANON}, {multi_tables()}, {FACT}, {CRAWL_ROWS}, u AS ({MERGE} UNION ALL ({multi_select()}))
    SELECT title, text, url, source, {S.normalize('category', K.CATEGORY_CODES)} AS category, author, date_published,
      rating, {S.normalize('type', K.TYPE_CODES)} AS type, label
    FROM u WHERE label IS NOT NULL AND text IS NOT NULL AND text <> ''""")
def merge_sources(spark, sf_dir):
    parts = [
        A.adapt_claim_urls(*claim_files(spark, sf_dir)), A.adapt_two_file(*two_files(spark, sf_dir)),
        A.adapt_string_label(string_labelled(spark, sf_dir)), A.adapt_author_rated(author_rated(spark, sf_dir)),
        A.adapt_fact_check(fact_checks(spark, sf_dir)), A.adapt_story_urls(story_links(spark, sf_dir)),
        A.adapt_video(videos(spark, sf_dir)), A.adapt_social_check(posts(spark, sf_dir)),
        A.adapt_bot_news(bot_news(spark, sf_dir)), A.adapt_typed_crawl(typed_crawl(spark, sf_dir)),
        A.adapt_multilingual(multilingual_files(spark, sf_dir), article_memory(spark, sf_dir), T.stop_word_profiles(PROFILE_CODES)),
    ]
    return out(C.merge_sources(parts))


@query("target_mean", f"""WITH {CANON} SELECT doc_id, {r6s('coalesce(m, 0.5)')} AS rating
    FROM canon LEFT JOIN {mean_sql('author')} ON author = mk""")
def target_mean(spark, sf_dir):
    df = C.target_mean(canonical(spark, sf_dir).select("doc_id", "author", "label"), "author")
    return df.select("doc_id", r6("rating").alias("rating"))


@query("target_mean_leave_one_out", f"""WITH {CANON}, s AS (SELECT author AS mk, sum(label) AS t, count(label) AS c
      FROM canon WHERE author IS NOT NULL GROUP BY author)
    SELECT doc_id, {r6s('coalesce((t - coalesce(label, 0)) / nullif(CAST(c - (label IS NOT NULL)::INTEGER AS DOUBLE), 0), 0.5)')} AS rating
    FROM canon LEFT JOIN s ON author = mk""")
def target_mean_loo(spark, sf_dir):
    df = C.target_mean(canonical(spark, sf_dir).select("doc_id", "author", "label"), "author", leave_one_out=True)
    return df.select("doc_id", r6("rating").alias("rating"))


@query("normalize_codes", f"""WITH {CANON} SELECT doc_id, {S.normalize('category', K.CATEGORY_CODES)} AS category,
    {S.normalize('type', K.TYPE_CODES)} AS type, {S.normalize('category', K.CATEGORY_CODES, True)} AS category_strict FROM canon""")
def normalize_codes(spark, sf_dir):
    df = canonical(spark, sf_dir).withColumn("category_strict", F.col("category"))
    df = C.normalize_codes(C.normalize_codes(df, "category", K.CATEGORY_CODES), "type", K.TYPE_CODES)
    df = C.normalize_codes(df, "category_strict", K.CATEGORY_CODES, strict_keys=True)
    return df.select("doc_id", "category", "type", "category_strict")


@query("row_ids", f"""WITH {CANON} SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS index_id,
    md5(concat_ws(chr(31), coalesce(title, ''), coalesce(text, ''), coalesce(url, ''))) AS content_id FROM canon""")
def row_ids(spark, sf_dir):
    return canonical(spark, sf_dir).select(
        "doc_id", C.index_id("doc_id").alias("index_id"), C.content_id("title", "text", "url").alias("content_id"))


@query("distinct_rows", "SELECT DISTINCT text, lang FROM documents")
def distinct_rows(spark, sf_dir):
    from catalog.fixtures import documents
    return C.distinct_rows(documents(spark, sf_dir).select("text", "lang"))
