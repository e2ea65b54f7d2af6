"""Bindings of profiling, corpus statistics, backfill and keyed lookups."""
from __future__ import annotations

from pyspark.sql import functions as F

from catalog import sqlfn as S
from catalog.fixtures import CANON, SCORED, canonical, scored, table
from catalog.registry import query, quoted, r6, r6s
from credence import constants as K
from credence.functions import text as T
from credence.operators import backfill as B
from credence.operators import profile as P
from credence.operators.layout import cut_lineage
from credence.sources.canonical import add_defaults

PROFILED = ["title", "text", "url", "source", "category", "author", "date_published", "type", "label", "lang"]
_PAIRS = " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM canon" for c in PROFILED)


@query("profile_columns", f"""WITH {CANON}, pairs AS ({_PAIRS}),
    counts AS (SELECT column_name, value, count(*) AS n FROM pairs GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY value) AS r FROM counts WHERE value IS NOT NULL),
    s AS (SELECT column_name, string_agg(value, '|' ORDER BY r) AS samples FROM r WHERE r <= 20 GROUP BY 1)
    SELECT c.column_name, CAST(sum(CASE WHEN value IS NULL THEN n ELSE 0 END) AS BIGINT) AS n_null,
      count(*) AS n_distinct, any_value(samples) AS samples
    FROM counts c LEFT JOIN s ON c.column_name = s.column_name GROUP BY 1""")
def profile_columns(spark, sf_dir):
    out = P.profile_columns(canonical(spark, sf_dir), PROFILED)
    return out.withColumn("samples", F.array_join("samples", "|"))


@query("profile_sketches")
def profile_sketches(spark, sf_dir):
    """Sketch profile of the article columns: estimates, bottom-k samples by hash."""
    return P.profile_report(P.profile_sketches(canonical(spark, sf_dir), PROFILED))


@query("profile_increments")
def profile_increments(spark, sf_dir):
    """The same profile from two stored increments of the articles (split by a hash of doc_id), merged."""
    df = canonical(spark, sf_dir)
    half = F.xxhash64("doc_id") % 2 == 0
    parts = [cut_lineage(P.profile_sketches(df.where(cond), PROFILED)) for cond in (half, ~half)]
    return P.profile_report(P.merge_profiles(parts[0].unionByName(parts[1])))


@query("code_frequencies", f"""WITH {CANON} SELECT 'type' AS column_name, type AS value, count(*) AS n FROM canon GROUP BY type
    UNION ALL SELECT 'category', category, count(*) FROM canon GROUP BY category""")
def code_frequencies(spark, sf_dir):
    return P.code_frequencies(canonical(spark, sf_dir), ["type", "category"])


def gaps(spark, sf_dir):
    """The articles with blanks: every ninth text is gone, some categories are spaces."""
    i = F.col("doc_id")
    return canonical(spark, sf_dir).withColumns({
        "text": F.when(i % 9 == 0, F.when(i % 2 == 0, F.lit("")).otherwise(F.lit(None))).otherwise(F.col("text")),
        "category": F.when(i % 10 == 4, F.lit(" \t ")).otherwise(F.col("category")),
    })


GAPS = f"""{CANON}, gaps AS (SELECT doc_id, title, url, source, author, type, label, lang,
    CASE WHEN doc_id % 9 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN '' END ELSE text END AS text,
    CASE WHEN doc_id % 10 = 4 THEN ' ' || chr(9) || ' ' ELSE category END AS category FROM canon)"""
MISSING = ["title", "text", "url", "category", "author", "type"]


def _missing(c):
    blank = f"count(*) FILTER (regexp_replace({c}, '{S.WS}+', '', 'g') = '')"
    null = f"count(*) FILTER ({c} IS NULL)"
    return f"SELECT '{c}' AS column_name, {null} AS n_null, {blank} AS n_blank, count(*) - {null} - {blank} AS n_valid FROM gaps"


@query("missing_report", f"WITH {GAPS} " + " UNION ALL ".join(_missing(c) for c in MISSING))
def missing_report(spark, sf_dir):
    return P.missing_report(gaps(spark, sf_dir), MISSING)


@query("recoverable_rows", f"""WITH {GAPS} SELECT count(*) AS n_recoverable FROM gaps
    WHERE (text IS NULL OR text = '') AND url IS NOT NULL AND url <> ''""")
def recoverable_rows(spark, sf_dir):
    return P.recoverable_rows(gaps(spark, sf_dir))


@query("top_words", lambda: f"""WITH {CANON}, w AS (SELECT unnest({S.space_tokens(S.letters_only('text'))}) AS word
      FROM canon WHERE label = 1)
    SELECT word, count(*) AS n FROM w WHERE word NOT IN ({quoted(S.stop_words("english"))}) GROUP BY word ORDER BY n DESC, word LIMIT 25""")
def top_words(spark, sf_dir):
    return P.top_words(canonical(spark, sf_dir), K.REAL, T.default_stop_words())


@query("ngram_frequencies", lambda: f"""WITH {CANON},
    t AS (SELECT doc_id, list_filter({S.vector_tokens(S.boilerplate('text'))}, lambda t: t NOT IN ({quoted(S.stop_words("english"))})) AS k FROM canon),
    g AS (SELECT doc_id, unnest(list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1])) AS gram FROM t),
    d AS (SELECT doc_id, gram, count(*) AS tf FROM g GROUP BY ALL)
    SELECT gram, CAST(sum(tf) AS BIGINT) AS n, count(*) AS n_docs FROM d GROUP BY gram
    HAVING count(*) >= 2 AND count(*) <= 0.5 * (SELECT count(*) FROM canon)""")
def ngram_frequencies(spark, sf_dir):
    return P.ngram_frequencies(canonical(spark, sf_dir), "doc_id", "text", T.default_stop_words(), 2, 2, 2, 0.5)


@query("label_distribution", f"""WITH {SCORED} SELECT label, count(*) AS n, {r6s('avg(p_fake)')} AS mean_score,
    {r6s('stddev_pop(p_fake)')} AS std_score FROM scored GROUP BY label""")
def label_distribution(spark, sf_dir):
    out = P.label_distribution(scored(spark, sf_dir), "p_fake")
    return out.withColumns({"mean_score": r6("mean_score"), "std_score": r6("std_score")})


_TEXT = "html"
for _p in ("(?s)<!--.*?-->", *B.HIDDEN_ELEMENTS, B.TAGS):
    _TEXT = f"regexp_replace({_TEXT}, '{_p}', ' ', 'g')"
for _k, _v in B.ENTITIES.items():
    _TEXT = f"replace({_TEXT}, '{_k}', '{_v.replace(chr(39), chr(39) * 2)}')"
_TEXT = f"trim(regexp_replace({_TEXT}, '{S.WS}+', ' ', 'g'))"


def _plain_sql(c):
    out = f"regexp_replace({c}, '{B.TAGS}', ' ', 'g')"
    for _k, _v in B.ENTITIES.items():
        out = f"replace({out}, '{_k}', '{_v.replace(chr(39), chr(39) * 2)}')"
    return f"trim(regexp_replace({out}, '{S.WS}+', ' ', 'g'))"


_CLEAN = "coalesce(html, '')"
for _p in B.NO_TEXT:
    _CLEAN = f"regexp_replace({_CLEAN}, '{_p}', ' ', 'g')"


@query("page_main_text", f"""WITH b AS (SELECT page_id, unnest(regexp_split_to_array({_CLEAN}, '{B.BLOCK_BREAK}')) AS b,
      unnest(range(1, len(regexp_split_to_array({_CLEAN}, '{B.BLOCK_BREAK}')) + 1)) AS i FROM pages),
  m AS (SELECT page_id, i, {_plain_sql('b')} AS t,
      list_sum(list_transform(regexp_extract_all(b, '{B.LINKS}', 1), lambda a: length({_plain_sql('a')}))) AS l FROM b),
  c AS (SELECT page_id, i, t, len(string_split(t, ' ')) AS w, coalesce(l, 0) / length(t) AS d FROM m WHERE t <> ''),
  k AS (SELECT *, CASE WHEN w >= {B.GOOD_WORDS} AND d <= {B.MAX_LINK_DENSITY} THEN 'good'
      WHEN d > {B.MAX_LINK_DENSITY} THEN 'bad' ELSE 'short' END AS cls FROM c),
  n AS (SELECT *, last_value(CASE WHEN cls <> 'short' THEN cls END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY i
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
      first_value(CASE WHEN cls <> 'short' THEN cls END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY i
        ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM k),
  f AS (SELECT *, coalesce(cls = 'good' OR (cls = 'short' AND before = 'good' AND after = 'good'), false) AS keep FROM n),
  g AS (SELECT page_id, count(*) AS n_blocks, sum(CAST(keep AS BIGINT)) AS n_kept,
      coalesce(string_agg(CASE WHEN keep THEN t END, ' ' ORDER BY i), '') AS main_text FROM f GROUP BY page_id)
SELECT p.page_id, coalesce(g.main_text, '') AS main_text, CAST(coalesce(g.n_blocks, 0) AS BIGINT) AS n_blocks,
  CAST(coalesce(g.n_kept, 0) AS BIGINT) AS n_kept FROM pages p LEFT JOIN g USING (page_id)""")
def page_main_text(spark, sf_dir):
    return B.main_text(table(spark, sf_dir, "pages"))


@query("extract_page_text", f"SELECT page_id, url, {_TEXT} AS scraped_text FROM pages")
def extract_page_text(spark, sf_dir):
    return B.extract_page_text(table(spark, sf_dir, "pages")).drop("html")


@query("backfill_candidates", f"""WITH {GAPS} SELECT doc_id, url, title FROM gaps
    WHERE (text IS NULL OR text = '') AND url IS NOT NULL AND url <> ''""")
def backfill_candidates(spark, sf_dir):
    return B.backfill_candidates(gaps(spark, sf_dir)).select("doc_id", "url", "title")


@query("backfill_text", f"""WITH {GAPS}, page AS (SELECT page_id, {_TEXT} AS scraped_text FROM pages),
    fetched AS (SELECT c.url, p.scraped_text FROM canon c JOIN page p ON c.doc_id % 250 = p.page_id % 250),
    best AS (SELECT url, max_by(scraped_text, (length(scraped_text), scraped_text)) AS f FROM fetched GROUP BY url)
    SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN f ELSE text END AS text
    FROM gaps LEFT JOIN best ON gaps.url = best.url""")
def backfill_text(spark, sf_dir):
    pages = B.extract_page_text(table(spark, sf_dir, "pages")).selectExpr("page_id % 250 AS slot", "scraped_text")
    # the longest text of a link is the longest of its slots' longest ones: pages are compared before the join
    pages = pages.filter(F.col("scraped_text").isNotNull()).groupBy("slot").agg(
        F.max(F.struct(F.length("scraped_text"), "scraped_text"))["scraped_text"].alias("scraped_text"))
    fetched = (canonical(spark, sf_dir).selectExpr("doc_id % 250 AS slot", "url").join(pages, "slot").drop("slot"))
    return B.backfill_text(gaps(spark, sf_dir), fetched).select("doc_id", "text")


_PRED = "CASE WHEN doc_id % 20 = 0 THEN 'Politics' WHEN doc_id % 20 = 10 AND doc_id % 3 > 0 THEN 'Sports' END"


@query("inject_predictions", f"""WITH {CANON}, c AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'Unknown' ELSE category END AS category,
      {_PRED} AS pred FROM canon)
    SELECT doc_id, CASE WHEN lower(category) = 'unknown' AND pred IS NOT NULL THEN pred ELSE category END AS category FROM c""")
def inject_predictions(spark, sf_dir):
    df = canonical(spark, sf_dir).withColumn(
        "category", F.when(F.col("doc_id") % 10 == 0, F.lit("Unknown")).otherwise(F.col("category")))
    predicted = df.select("doc_id", F.expr(_PRED).alias("category_pred")).filter("category_pred IS NOT NULL")
    return B.inject_predictions(df, predicted, "doc_id", "category", "category_pred").select("doc_id", "category")


def prediction_log(spark, sf_dir):
    """Every article as one logged request with its fixed score."""
    df = canonical(spark, sf_dir)
    from catalog.fixtures import H
    p = H.uniform(F.col("doc_id"), 42)
    return df.select("doc_id", "text", p.alias("prob_fake"),
                     F.when(p >= 0.5, F.lit("FAKE")).otherwise(F.lit("REAL")).alias("verdict"))


@query("feedback_join", lambda: f"""WITH {CANON}, {_log_sql()}, truth AS (SELECT md5(text) AS k, max(label) AS label FROM canon GROUP BY 1)
    SELECT doc_id, md5(text) AS text_key, verdict, {r6s('prob_fake')} AS prob_fake, label
    FROM log JOIN truth ON md5(log.text) = k WHERE label IS NOT NULL""")
def feedback_join(spark, sf_dir):
    labels = canonical(spark, sf_dir).select("text", "label")
    out = B.feedback_join(prediction_log(spark, sf_dir), labels)
    return out.select("doc_id", "text_key", "verdict", r6("prob_fake").alias("prob_fake"), "label")


def _log_sql() -> str:
    from catalog.fixtures import uniform_sql
    u = uniform_sql("doc_id")
    return f"log AS (SELECT doc_id, text, {u} AS prob_fake, CASE WHEN {u} >= 0.5 THEN 'FAKE' ELSE 'REAL' END AS verdict FROM canon)"
