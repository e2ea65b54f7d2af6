"""Bindings of the scalar functions."""
from __future__ import annotations

from pyspark.sql import functions as F

from catalog import sqlfn as S
from catalog.fixtures import CANON, canonical, documents, table
from catalog.registry import quoted, query
from credence import constants as K
from credence.functions import labels as L
from credence.functions import text as T
from credence.functions import urls as U
from credence.operators import lang_profiles as LP
from credence.operators import profile as P
from credence.operators.translation import translate, translation_misses

PROFILE_CODES = ["de", "en", "es", "fr"]

URLS = ("(SELECT 'c' || doc_id AS row_id, url FROM canon UNION ALL SELECT 'p' || page_id, url FROM pages)")


def urls(spark, sf_dir):
    a = canonical(spark, sf_dir).select(F.concat(F.lit("c"), "doc_id").alias("row_id"), "url")
    b = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id").alias("row_id"), "url")
    return a.unionByName(b)


@query("extract_author", f"WITH {CANON} SELECT doc_id, {S.author('title')} AS author FROM canon")
def extract_author(spark, sf_dir):
    return canonical(spark, sf_dir).select("doc_id", U.author_from_title(F.col("title")).alias("author"))


URL_FUNCTIONS = {
    "date_from_url": (U.date_from_url, S.date_from_url),
    "title_from_url": (U.title_from_url, S.title_from_url),
    "url_source": (U.netloc, S.netloc),
    "domain_extension": (U.domain_extension, S.extension),
    "domain_risk": (L.url_risk, lambda c: S.domain_risk(S.extension(c))),
}
for _name, (_fn, _sql) in URL_FUNCTIONS.items():
    query(_name, f"WITH {CANON} SELECT row_id, {_sql('url')} AS {_name} FROM {URLS}")(
        lambda spark, sf_dir, name=_name, fn=_fn: urls(spark, sf_dir).select("row_id", fn(F.col("url")).alias(name)))


@query("url_from_text", f"WITH {CANON} SELECT doc_id, {S.url_from_text('text')} AS url FROM canon")
def url_from_text(spark, sf_dir):
    return canonical(spark, sf_dir).select("doc_id", U.url_from_text(F.col("text")).alias("url"))


CHANNELS = ["CNN", "Reductress", "BBC News", "My Channel", "The Hummus News"]
_ARIA = f"(coalesce(title, '') || ' by ' || [{quoted(CHANNELS)}][doc_id % 5 + 1] || ' 3 years ago')"


def aria_label():
    return F.concat(F.coalesce("title", F.lit("")), F.lit(" by "),
                    F.element_at(F.array(*[F.lit(c) for c in CHANNELS]), (F.col("doc_id") % 5 + 1).cast("int")),
                    F.lit(" 3 years ago"))


@query("channel_risk", f"""WITH {CANON}, v AS (SELECT doc_id, {S.channel(_ARIA)} AS channel FROM canon)
    SELECT doc_id, channel, CAST({S.channel_risk('channel')} AS DOUBLE) AS channel_risk FROM v""")
def channel_risk(spark, sf_dir):
    df = canonical(spark, sf_dir).select("doc_id", U.channel_name(aria_label()).alias("channel"))
    return df.withColumn("channel_risk", L.channel_risk(F.col("channel")))


@query("type_verdict", f"WITH {CANON} SELECT doc_id, {S.type_verdict('type')} AS verdict FROM canon")
def type_verdict(spark, sf_dir):
    return canonical(spark, sf_dir).select("doc_id", L.type_verdict(F.col("type")).alias("verdict"))


_PLATFORM = "CASE doc_id % 4 WHEN 0 THEN source || ' Facebook page' WHEN 1 THEN 'Official ' || source WHEN 2 THEN source END"


@query("platform_risk", f"WITH {CANON}, p AS (SELECT doc_id, {_PLATFORM} AS platform FROM canon) "
                        f"SELECT doc_id, {S.platform_risk('platform')} AS platform_risk FROM p")
def platform_risk(spark, sf_dir):
    return canonical(spark, sf_dir).select("doc_id", L.platform_risk(F.expr(_PLATFORM)).alias("platform_risk"))


@query("keyword_flags", f"""WITH {CANON} SELECT doc_id, {S.keyword_flag('title')} AS title_has_keyword,
    {S.keyword_flag('text')} AS text_has_keyword FROM canon""")
def keyword_flags(spark, sf_dir):
    return canonical(spark, sf_dir).select(
        "doc_id", L.keyword_flag(F.col("title")).alias("title_has_keyword"),
        L.keyword_flag(F.col("text")).alias("text_has_keyword"))


@query("super_category", f"WITH {CANON} SELECT doc_id, {S.super_category('category')} AS super_category FROM canon")
def super_category(spark, sf_dir):
    return canonical(spark, sf_dir).select("doc_id", L.super_category(F.col("category")).alias("super_category"))


_HOT = ", ".join(
    [f"coalesce(CAST(category = '{v}' AS INTEGER), 0) AS \"category_{v}\"" for v in ("politics", "left-news", "US_News")]
    + [f"coalesce(CAST(type = '{v}' AS INTEGER), 0) AS type_{v}" for v in ("fake", "reliable", "bias", "satire", "bs")])


@query("enrich", f"""WITH {CANON} SELECT doc_id, {S.keyword_flag('title')} AS title_has_keyword,
    {S.keyword_flag('text')} AS text_has_keyword, {S.extension('url')} AS domain_ext,
    {S.domain_risk(S.extension('url'))} AS domain_risk, {S.super_category('category')} AS super_category, {_HOT} FROM canon""")
def enrich(spark, sf_dir):
    return P.enrich(canonical(spark, sf_dir)).drop(
        "title", "text", "url", "source", "author", "date_published", "label", "lang")


@query("clean_text", f"WITH {CANON} SELECT doc_id, {S.letters_only('text')} AS cleaned FROM canon")
def clean_text(spark, sf_dir):
    return canonical(spark, sf_dir).select("doc_id", T.letters_only(F.col("text")).alias("cleaned"))


@query("remove_boilerplate", f"WITH {CANON} SELECT doc_id, {S.boilerplate('text')} AS cleaned FROM canon")
def remove_boilerplate(spark, sf_dir):
    return canonical(spark, sf_dir).select("doc_id", T.remove_boilerplate(F.col("text")).alias("cleaned"))


@query("detect_lang", lambda: f"SELECT doc_id, {S.detect_lang('text')} AS detected FROM documents")
def detect_lang(spark, sf_dir):
    df = documents(spark, sf_dir).select("doc_id", T.profile_tokens(F.col("text")).alias("tokens"))
    return df.select("doc_id", T.detect_lang("tokens", T.stop_word_profiles(PROFILE_CODES)).alias("detected"))


_GRAMS = ("flatten(list_transform(regexp_extract_all(lower(coalesce(text, '')), '\\p{L}+'), "
          "lambda x: list_transform(range(1, length(x) + 1), lambda i: substr(' ' || x || ' ', i, 3))))")


@query("detect_lang_profile", f"""WITH g AS (SELECT doc_id, lang, unnest({_GRAMS}) AS gram FROM documents),
  prof AS (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY n DESC, encode(gram)) - 1 AS r
    FROM (SELECT lang, gram, count(*) AS n FROM g WHERE lang IS NOT NULL AND lang <> '' GROUP BY ALL) QUALIFY r < {LP.PROFILE_SIZE}),
  own AS (SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, encode(gram)) - 1 AS rank
    FROM (SELECT doc_id, gram, count(*) AS n FROM g GROUP BY ALL) QUALIFY rank < {LP.PROFILE_SIZE}),
  kept AS (SELECT doc_id, count(*) AS m FROM own GROUP BY doc_id),
  near AS (SELECT doc_id, lang, sum({LP.PROFILE_SIZE} - abs(rank - r)) AS saved FROM own JOIN prof USING (gram) GROUP BY ALL),
  best AS (SELECT doc_id, lang, m * {LP.PROFILE_SIZE} - saved AS distance FROM near JOIN kept USING (doc_id)
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY m * {LP.PROFILE_SIZE} - saved, lang) = 1)
SELECT d.doc_id, CASE WHEN k.m IS NOT NULL THEN coalesce(b.lang, (SELECT min(lang) FROM prof)) END AS lang_pred,
  CAST(CASE WHEN k.m IS NOT NULL AND (SELECT min(lang) FROM prof) IS NOT NULL THEN coalesce(b.distance, k.m * {LP.PROFILE_SIZE}) END AS BIGINT) AS distance
FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN best b USING (doc_id)""")
def detect_lang_profile(spark, sf_dir):
    """Trigram profiles fitted on the labelled documents, every document told by out-of-place distance."""
    docs = documents(spark, sf_dir)
    return LP.detect(docs, LP.fit_profiles(docs), "doc_id")


# the documents' letters written in other scripts
_ABC = "abcdefghijklmnopqrstuv"
_OTHER = {1: "".join(chr(0x05D0 + i) for i in range(22)), 2: "".join(chr(0x0995 + i) for i in range(19)) + "রলশ",
          3: "".join(chr(0x03B1 + i) for i in range(22)), 4: "".join(chr(0x4E00 + i) for i in range(22))}
_SCRIPTED = "CASE doc_id % 6 " + " ".join(
    f"WHEN {k} THEN translate(lower(text), '{_ABC}', '{v}')" for k, v in _OTHER.items()) + " ELSE text END"


@query("detect_lang_scripts", lambda: f"SELECT doc_id, {S.detect_lang('t')} AS detected FROM (SELECT doc_id, {_SCRIPTED} AS t FROM documents)")
def detect_lang_scripts(spark, sf_dir):
    df = documents(spark, sf_dir).select("doc_id", T.profile_tokens(F.expr(_SCRIPTED)).alias("tokens"))
    return df.select("doc_id", T.detect_lang("tokens", T.stop_word_profiles(PROFILE_CODES)).alias("detected"))


_LANG = "CASE doc_id % 6 WHEN 0 THEN 'he-IL' WHEN 1 THEN 'ZH' WHEN 2 THEN 'zh-Hant' WHEN 3 THEN NULL ELSE upper(lang) END"


@query("normalize_lang", f"""WITH l AS (SELECT doc_id, {_LANG} AS code FROM documents)
    SELECT doc_id, CASE WHEN code IS NULL OR code = '' THEN 'auto'
      WHEN lower(code) IN ('he', 'he-il', 'heb', 'hebrew') THEN 'iw' WHEN lower(code) IN ('zh', 'zh-cn') THEN 'zh-CN'
      WHEN lower(code) IN ('zh-tw', 'zh-hant') THEN 'zh-TW' ELSE lower(code) END AS lang_code FROM l""")
def normalize_lang(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.normalize_lang(F.expr(_LANG)).alias("lang_code"))


def memory(spark, sf_dir):
    """A translation memory that knows the texts of a third of the documents."""
    return documents(spark, sf_dir).filter("doc_id % 3 = 0").select(
        "text", F.col("lang").alias("src"), F.lit("en").alias("tgt"),
        F.concat(F.lit("[en] "), "text").alias("translation"))


def translated_sql() -> str:
    return f"""WITH tagged AS (SELECT doc_id, text, {S.detect_lang('text')} AS det FROM documents),
      tm AS (SELECT md5(text) AS k, lang AS src, min('[en] ' || text) AS tr FROM documents WHERE doc_id % 3 = 0 GROUP BY 1, 2),
      joined AS (SELECT doc_id, text, det, tr FROM tagged LEFT JOIN tm
        ON det <> 'en' AND tm.k = md5(text) AND tm.src = det)"""


@query("translate_column", lambda: translated_sql() + """
    SELECT doc_id, det AS text_lang, coalesce(tr, text) AS text_used, tr IS NOT NULL AS text_did_translate FROM joined""")
def translate_column(spark, sf_dir):
    out = translate(documents(spark, sf_dir), "text", memory(spark, sf_dir), T.stop_word_profiles(PROFILE_CODES))
    return out.select("doc_id", "text_lang", "text_used", "text_did_translate")


@query("translation_misses", lambda: translated_sql() + """
    SELECT text, det AS src, count(*) AS n_rows, 'en' AS tgt FROM joined
    WHERE det IS NOT NULL AND det <> 'en' AND tr IS NULL GROUP BY text, det""")
def misses(spark, sf_dir):
    out = translate(documents(spark, sf_dir), "text", memory(spark, sf_dir), T.stop_word_profiles(PROFILE_CODES))
    return translation_misses(out, "text")


@query("remove_stop_words", lambda: f"""SELECT doc_id, array_to_string(list_filter({S.space_tokens('text')},
    lambda t: lower(t) NOT IN ({quoted(S.stop_words("english"))})), ' ') AS kept FROM documents""")
def remove_stop_words(spark, sf_dir):
    return T.remove_stop_words(documents(spark, sf_dir), "text", T.default_stop_words(), "kept").select("doc_id", "kept")


@query("remove_hebrew_stop_words", f"""WITH {CANON} SELECT doc_id, array_to_string(list_filter({S.space_tokens('text')},
    lambda t: t NOT IN ({quoted(K.HEBREW_STOP_WORDS)})), ' ') AS kept FROM canon""")
def remove_hebrew_stop_words(spark, sf_dir):
    return T.remove_hebrew_stop_words(canonical(spark, sf_dir), "text", "kept").select("doc_id", "kept")
