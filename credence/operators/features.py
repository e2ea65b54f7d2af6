"""Article features: 43 numbers and 3 stop-word-free texts per article.

Every step is a narrow, native projection. Token arrays and normalised texts are computed one
projection below their users, so Catalyst keeps them as shared columns instead of repeating the
regular expressions.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence import constants as K
from credence.functions import text as T

STOP_WORDS = K.HEBREW_STOP_WORDS + K.ENGLISH_STOP_WORDS

TEXT_COLUMNS = ["title_ns_text", "text_ns_text", "titleplus_text_ns"]
FEATURE_COLUMNS = [
    "title_n_chars", "text_n_chars", "title_n_tokens", "text_n_tokens",
    "title_n_unique", "text_n_unique",
    "title_exc_qm", "text_exc_qm", "text_ellipsis", "text_multi_exclaim", "text_multi_qmark",
    "text_char_repeat_3plus", "text_n_digits", "text_n_numbers", "text_currency",
    "text_url_count", "text_email_count", "title_clickbait_hits", "text_clickbait_hits",
    "text_n_sentences_est",
    "title_ttr", "text_ttr", "text_upper_ratio", "text_hebrew_char_ratio",
    "text_latin_char_ratio", "text_avg_tokens_per_sentence", "title_text_char_ratio",
    "title_text_token_ratio", "text_digit_char_ratio", "text_number_token_ratio",
    "text_exclaim_qm_per_token", "title_text_jaccard", "text_avg_word_len", "title_avg_word_len",
    "title_n_tokens_ns", "text_n_tokens_ns", "title_n_unique_ns", "text_n_unique_ns",
    "title_ttr_ns", "text_ttr_ns", "text_stopword_ratio", "title_stopword_ratio",
    "title_text_jaccard_ns",
]
INTERMEDIATE = [
    "title_norm", "text_norm", "title_tokens", "text_tokens",
    "text_latin_letters", "text_upper_letters", "text_hebrew_chars",
]


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b with the denominator lifted to one."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return a / F.greatest(b, F.lit(1))


def jaccard(a: str, b: str, n_a: str, n_b: str) -> Column:
    """Shared over all distinct tokens; the union's size follows from the distinct counts at hand."""
    shared = F.array(F.size(F.array_intersect(a, b)))
    return F.transform(shared, lambda s: ratio(s, F.col(n_a) + F.col(n_b) - s))[0]


def mean_length(tokens: str, count: str) -> Column:
    """Mean token length: the joined length is the sum of the lengths."""
    return F.when(F.col(count) > 0, F.length(F.array_join(tokens, "")) / F.col(count)).otherwise(F.lit(0.0))


def normalized(df: DataFrame, title: str = "title", text: str = "text") -> DataFrame:
    return df.withColumns({
        "title_norm": T.normalize_text(F.col(title)),
        "text_norm": T.normalize_text(F.col(text)),
    })


def tokenized(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "title_tokens": T.word_tokens(F.col("title_norm")),
        "text_tokens": T.word_tokens(F.col("text_norm")),
    })


def surface_counts(df: DataFrame) -> DataFrame:
    title, text = F.col("title_norm"), F.col("text_norm")
    return df.withColumns({
        "title_n_chars": F.length(title),
        "text_n_chars": F.length(text),
        "title_n_tokens": F.size("title_tokens"),
        "text_n_tokens": F.size("text_tokens"),
        "title_n_unique": F.size(F.array_distinct("title_tokens")),
        "text_n_unique": F.size(F.array_distinct("text_tokens")),
        "title_exc_qm": T.sign_count(title, "!?"),
        "text_exc_qm": T.sign_count(text, "!?"),
        "text_ellipsis": T.guarded_count(text, r"\.\.\.+", ["..."]),
        "text_multi_exclaim": T.guarded_count(text, r"!!+", ["!!"]),
        "text_multi_qmark": T.guarded_count(text, r"\?\?+", ["??"]),
        "text_char_repeat_3plus": T.match_count(text, r"(?s)(.)\1\1+"),
        "text_n_digits": T.char_count(text, r"\p{Nd}"),
        "text_n_numbers": T.match_count(text, K.NUMBER_PATTERN),
        "text_currency": T.sign_count(text, K.CURRENCY_SIGNS),
        "text_url_count": T.guarded_count(text, K.URL_PATTERN, ["http", "www."]),
        "text_email_count": T.guarded_count(text, K.EMAIL_PATTERN, ["@"]),
        "title_clickbait_hits": T.clickbait_count(title),
        "text_clickbait_hits": T.clickbait_count(text),
        "text_latin_letters": T.char_count(text, "A-Za-z"),
        "text_upper_letters": T.char_count(text, "A-Z"),
        "text_hebrew_chars": T.char_count(text, r"֐-׿"),
        "text_n_sentences_est": F.greatest(F.lit(1), T.match_count(text, r"[.!?]+")),
    })


def surface_ratios(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "title_ttr": ratio("title_n_unique", "title_n_tokens"),
        "text_ttr": ratio("text_n_unique", "text_n_tokens"),
        "text_upper_ratio": ratio("text_upper_letters", "text_latin_letters"),
        "text_hebrew_char_ratio": ratio("text_hebrew_chars", "text_n_chars"),
        "text_latin_char_ratio": ratio("text_latin_letters", "text_n_chars"),
        "text_avg_tokens_per_sentence": ratio("text_n_tokens", "text_n_sentences_est"),
        "title_text_char_ratio": ratio("title_n_chars", "text_n_chars"),
        "title_text_token_ratio": ratio("title_n_tokens", "text_n_tokens"),
        "text_digit_char_ratio": ratio("text_n_digits", "text_n_chars"),
        "text_number_token_ratio": ratio("text_n_numbers", "text_n_tokens"),
        "text_exclaim_qm_per_token": ratio("text_exc_qm", "text_n_tokens"),
        "title_text_jaccard": jaccard("title_tokens", "text_tokens", "title_n_unique", "text_n_unique"),
        "text_avg_word_len": mean_length("text_tokens", "text_n_tokens"),
        "title_avg_word_len": mean_length("title_tokens", "title_n_tokens"),
    })


def without_stop_words(df: DataFrame, stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """Token lists without stop words, their counts and ratios, and the three joined texts."""
    return (
        df.withColumns({
            "title_tokens_ns": T.without("title_tokens", stop_words),
            "text_tokens_ns": T.without("text_tokens", stop_words),
        })
        .withColumns({
            "title_n_tokens_ns": F.size("title_tokens_ns"),
            "text_n_tokens_ns": F.size("text_tokens_ns"),
            "title_n_unique_ns": F.size(F.array_distinct("title_tokens_ns")),
            "text_n_unique_ns": F.size(F.array_distinct("text_tokens_ns")),
            "title_ns_text": F.array_join("title_tokens_ns", " "),
            "text_ns_text": F.array_join("text_tokens_ns", " "),
        })
        .withColumns({
            "title_text_jaccard_ns": jaccard(
                "title_tokens_ns", "text_tokens_ns", "title_n_unique_ns", "text_n_unique_ns"),
            "title_ttr_ns": ratio("title_n_unique_ns", "title_n_tokens_ns"),
            "text_ttr_ns": ratio("text_n_unique_ns", "text_n_tokens_ns"),
            "text_stopword_ratio": 1 - ratio("text_n_tokens_ns", "text_n_tokens"),
            "title_stopword_ratio": 1 - ratio("title_n_tokens_ns", "title_n_tokens"),
            "titleplus_text_ns": F.concat("title_ns_text", F.lit(" "), "text_ns_text"),
        })
    )


def build_text_features(df: DataFrame, title: str = "title", text: str = "text",
                        drop_intermediate: bool = True) -> DataFrame:
    out = surface_ratios(surface_counts(tokenized(normalized(df, title, text))))
    return out.drop(*INTERMEDIATE) if drop_intermediate else out


def article_features(df: DataFrame, title: str = "title", text: str = "text") -> DataFrame:
    """Input columns without title and text, plus the 43 numbers and 3 texts."""
    full = without_stop_words(build_text_features(df, title, text, drop_intermediate=False))
    passed = [c for c in df.columns if c not in (title, text)]
    return full.select(*passed, *FEATURE_COLUMNS, *TEXT_COLUMNS)
