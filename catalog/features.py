"""Bindings of the article feature operators."""
from __future__ import annotations

from pyspark.sql import functions as F

from catalog.fixtures import CANON, canonical
from catalog.registry import quoted, query, r6, r6s
from credence import constants as K
from credence.operators import features as X

# Unicode whitespace and word characters spelled out: RE2 classes are ASCII.
WS = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NWS = WS.replace("[", "[^", 1)
WORD = r"[\p{L}\p{M}\p{Nd}\p{Pc}]"


def n(pattern: str, col: str = "text_norm", ci: bool = False) -> str:
    pattern = pattern.replace("'", "''")
    flags = "(?i)" if ci else ""
    return f"CAST(len(regexp_extract_all({col}, '{flags}{pattern}')) AS INTEGER)"


def norm_sql(col: str) -> str:
    return f"trim(regexp_replace(regexp_replace(coalesce({col}, ''), '[\\x{{0591}}-\\x{{05C7}}]', '', 'g'), '{WS}+', ' ', 'g'))"


def tokens_sql(col: str) -> str:
    keep = WS[1:-1]
    return (f"string_split(trim(regexp_replace(lower(regexp_replace({col}, "
            f"'[^0-9A-Za-z\\x{{0590}}-\\x{{05FF}}{keep}]', ' ', 'g')), '{WS}+', ' ', 'g')), ' ')")


RUNS = ("CAST(list_sum(list_transform(range(3, length(text_norm) + 1), lambda i: CASE WHEN chars[i] = chars[i-1] "
        "AND chars[i] = chars[i-2] AND (i = 3 OR chars[i-3] <> chars[i]) THEN 1 ELSE 0 END)) AS INTEGER)")
NUMBERS = ("CAST(len(regexp_extract_all(regexp_replace(regexp_replace(text_norm, "
           f"'{WORD}*[\\p{{L}}\\p{{M}}\\p{{Pc}}]{WORD}*', 'x', 'g'), '\\p{{Nd}}+', 'd', 'g'), 'd(\\.d)?')) AS INTEGER)")
CLICK = "(" + "|".join(K.CLICKBAIT_PHRASES) + ")"
STOP = quoted(X.STOP_WORDS)


def _ratio(a: str, b: str) -> str:
    return f"CAST({a} AS DOUBLE) / greatest({b}, 1)"


def _jac(a: str, b: str) -> str:
    return (f"CAST(len(list_intersect({a}, {b})) AS DOUBLE) / "
            f"greatest(len(list_distinct(list_concat({a}, {b}))), 1)")


FEATS = f"""{CANON},
f1 AS (SELECT *, {norm_sql('title')} AS title_norm, {norm_sql('text')} AS text_norm FROM canon),
f2 AS (SELECT *, {tokens_sql('title_norm')} AS title_tokens, {tokens_sql('text_norm')} AS text_tokens,
  string_split(text_norm, '') AS chars FROM f1),
f3 AS (SELECT *,
  CAST(length(title_norm) AS INTEGER) AS title_n_chars, CAST(length(text_norm) AS INTEGER) AS text_n_chars,
  CAST(len(title_tokens) AS INTEGER) AS title_n_tokens, CAST(len(text_tokens) AS INTEGER) AS text_n_tokens,
  CAST(len(list_distinct(title_tokens)) AS INTEGER) AS title_n_unique,
  CAST(len(list_distinct(text_tokens)) AS INTEGER) AS text_n_unique,
  {n('[!?]', 'title_norm')} AS title_exc_qm, {n('[!?]')} AS text_exc_qm,
  {n('[.][.][.]+')} AS text_ellipsis, {n('!!+')} AS text_multi_exclaim, {n('[?][?]+')} AS text_multi_qmark,
  coalesce({RUNS}, 0) AS text_char_repeat_3plus,
  {n('[p]').replace('[p]', chr(92) + 'p{Nd}')} AS text_n_digits, {NUMBERS} AS text_n_numbers,
  {n('[$₪€£]')} AS text_currency,
  {n('(https?://' + NWS + '+|www[.]' + NWS + '+)')} AS text_url_count,
  {n('[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}')} AS text_email_count,
  {n(CLICK, 'title_norm', True)} AS title_clickbait_hits, {n(CLICK, 'text_norm', True)} AS text_clickbait_hits,
  {n('[A-Za-z]')} AS text_latin_letters, {n('[A-Z]')} AS text_upper_letters,
  {n('[' + chr(92) + 'x{0590}-' + chr(92) + 'x{05FF}]')} AS text_hebrew_chars,
  greatest(1, {n('[.!?]+')}) AS text_n_sentences_est,
  list_filter(title_tokens, lambda t: t NOT IN ({STOP})) AS title_tokens_ns,
  list_filter(text_tokens, lambda t: t NOT IN ({STOP})) AS text_tokens_ns
  FROM f2),
f4 AS (SELECT *,
  {_ratio('title_n_unique', 'title_n_tokens')} AS title_ttr, {_ratio('text_n_unique', 'text_n_tokens')} AS text_ttr,
  {_ratio('text_upper_letters', 'text_latin_letters')} AS text_upper_ratio,
  {_ratio('text_hebrew_chars', 'text_n_chars')} AS text_hebrew_char_ratio,
  {_ratio('text_latin_letters', 'text_n_chars')} AS text_latin_char_ratio,
  {_ratio('text_n_tokens', 'text_n_sentences_est')} AS text_avg_tokens_per_sentence,
  {_ratio('title_n_chars', 'text_n_chars')} AS title_text_char_ratio,
  {_ratio('title_n_tokens', 'text_n_tokens')} AS title_text_token_ratio,
  {_ratio('text_n_digits', 'text_n_chars')} AS text_digit_char_ratio,
  {_ratio('text_n_numbers', 'text_n_tokens')} AS text_number_token_ratio,
  {_ratio('text_exc_qm', 'text_n_tokens')} AS text_exclaim_qm_per_token,
  {_jac('title_tokens', 'text_tokens')} AS title_text_jaccard,
  CASE WHEN text_n_tokens > 0 THEN CAST(list_sum(list_transform(text_tokens, lambda t: length(t))) AS DOUBLE) / text_n_tokens ELSE 0 END AS text_avg_word_len,
  CASE WHEN title_n_tokens > 0 THEN CAST(list_sum(list_transform(title_tokens, lambda t: length(t))) AS DOUBLE) / title_n_tokens ELSE 0 END AS title_avg_word_len,
  CAST(len(title_tokens_ns) AS INTEGER) AS title_n_tokens_ns, CAST(len(text_tokens_ns) AS INTEGER) AS text_n_tokens_ns,
  CAST(len(list_distinct(title_tokens_ns)) AS INTEGER) AS title_n_unique_ns,
  CAST(len(list_distinct(text_tokens_ns)) AS INTEGER) AS text_n_unique_ns,
  {_jac('title_tokens_ns', 'text_tokens_ns')} AS title_text_jaccard_ns,
  array_to_string(title_tokens_ns, ' ') AS title_ns_text, array_to_string(text_tokens_ns, ' ') AS text_ns_text
  FROM f3),
feats AS (SELECT *,
  {_ratio('title_n_unique_ns', 'title_n_tokens_ns')} AS title_ttr_ns,
  {_ratio('text_n_unique_ns', 'text_n_tokens_ns')} AS text_ttr_ns,
  1 - {_ratio('text_n_tokens_ns', 'text_n_tokens')} AS text_stopword_ratio,
  1 - {_ratio('title_n_tokens_ns', 'title_n_tokens')} AS title_stopword_ratio,
  title_ns_text || ' ' || text_ns_text AS titleplus_text_ns
  FROM f4)"""

RATIOS = {c for c in X.FEATURE_COLUMNS if "ratio" in c or "ttr" in c or "jaccard" in c or "avg" in c
          or c.endswith("per_token")}


def _sel(cols: list[str]) -> str:
    return ", ".join(f"{r6s(c)} AS {c}" if c in RATIOS else c for c in cols)


def _cols(cols: list[str]):
    return [r6(c).alias(c) if c in RATIOS else F.col(c) for c in cols]


def _full(spark, sf_dir):
    return X.without_stop_words(X.build_text_features(canonical(spark, sf_dir), drop_intermediate=False))


GROUPS = {
    "normalized_text": ["title_norm", "text_norm"],
    "token_counts": ["title_n_chars", "text_n_chars", "title_n_tokens", "text_n_tokens",
                     "title_n_unique", "text_n_unique"],
    "punctuation_counts": ["title_exc_qm", "text_exc_qm", "text_ellipsis", "text_multi_exclaim",
                           "text_multi_qmark"],
    "character_runs": ["text_char_repeat_3plus"],
    "number_counts": ["text_n_digits", "text_n_numbers", "text_currency"],
    "link_counts": ["text_url_count", "text_email_count"],
    "clickbait_counts": ["title_clickbait_hits", "text_clickbait_hits"],
    "letter_counts": ["text_latin_letters", "text_upper_letters", "text_hebrew_chars"],
    "sentence_estimate": ["text_n_sentences_est"],
    "surface_ratios": ["title_ttr", "text_ttr", "text_upper_ratio", "text_hebrew_char_ratio",
                       "text_latin_char_ratio", "text_avg_tokens_per_sentence", "title_text_char_ratio",
                       "title_text_token_ratio", "text_digit_char_ratio", "text_number_token_ratio",
                       "text_exclaim_qm_per_token"],
    "title_text_jaccard": ["title_text_jaccard"],
    "mean_word_length": ["text_avg_word_len", "title_avg_word_len"],
    "stop_word_ratios": ["title_ttr_ns", "text_ttr_ns", "text_stopword_ratio", "title_stopword_ratio"],
    "title_text_jaccard_ns": ["title_text_jaccard_ns"],
    "stop_word_free_texts": X.TEXT_COLUMNS,
}
for _name, _columns in GROUPS.items():
    query(_name, f"WITH {FEATS} SELECT doc_id, {_sel(_columns)} FROM feats")(
        lambda spark, sf_dir, cols=_columns: _full(spark, sf_dir).select("doc_id", *_cols(cols)))


@query("token_lists", f"""WITH {FEATS} SELECT doc_id, array_to_string(title_tokens, '|') AS title_tokens,
    array_to_string(text_tokens, '|') AS text_tokens FROM feats""")
def token_lists(spark, sf_dir):
    df = X.tokenized(X.normalized(canonical(spark, sf_dir)))
    return df.select("doc_id", *[F.array_join(c, "|").alias(c) for c in ("title_tokens", "text_tokens")])


@query("tokens_without_stop_words", f"""WITH {FEATS} SELECT doc_id,
    array_to_string(title_tokens_ns, '|') AS title_tokens_ns, array_to_string(text_tokens_ns, '|') AS text_tokens_ns,
    title_n_tokens_ns, text_n_tokens_ns, title_n_unique_ns, text_n_unique_ns FROM feats""")
def tokens_without_stop_words(spark, sf_dir):
    return _full(spark, sf_dir).select(
        "doc_id", *[F.array_join(c, "|").alias(c) for c in ("title_tokens_ns", "text_tokens_ns")],
        "title_n_tokens_ns", "text_n_tokens_ns", "title_n_unique_ns", "text_n_unique_ns")


_ALL = X.FEATURE_COLUMNS + X.TEXT_COLUMNS


@query("article_features", f"""WITH {FEATS} SELECT doc_id, url, source, category, author, date_published,
    type, label, lang, {_sel(_ALL)} FROM feats""")
def article_features(spark, sf_dir):
    out = X.article_features(canonical(spark, sf_dir))
    return out.select(*[c for c in out.columns if c not in _ALL], *_cols(_ALL))
