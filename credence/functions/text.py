"""Text cleaning and tokenising as native column expressions."""
from __future__ import annotations

import pathlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence import constants as K


def blank_if_null(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def collapse_space(c: Column) -> Column:
    """Runs of Unicode whitespace become one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_text(c: Column) -> Column:
    """Null to '', Hebrew marks out, whitespace collapsed."""
    return collapse_space(F.regexp_replace(blank_if_null(c), K.HEBREW_MARKS, ""))


def word_tokens(normalized: Column) -> Column:
    """Letters, digits and Hebrew kept; all else splits. Lower-cased after the split characters go."""
    kept = F.regexp_replace(normalized, K.NON_WORD_CHARS, " ")
    return F.split(collapse_space(F.lower(kept)), " ")


def space_tokens(c: Column) -> Column:
    """Whitespace-separated tokens; an empty text has none."""
    return F.filter(F.split(blank_if_null(c), r"(?U)\s+"), lambda t: t != F.lit(""))


def word_list(words: list[str]) -> str:
    """Words as a SQL list: one parsed string is far cheaper to plan than one literal call per word."""
    return ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in words)


def without(tokens: str, words: list[str]) -> Column:
    """Tokens of an array column that are not in a list (a hash lookup per token)."""
    return F.expr(f"filter({tokens}, t -> t NOT IN ({word_list(words)}))")


def within(tokens: str, words: list[str]) -> Column:
    return F.expr(f"filter({tokens}, t -> t IN ({word_list(words)}))")


def match_count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def guarded_count(c: Column, pattern: str, hints: list[str]) -> Column:
    """match_count for patterns that need one of some literals: texts without any skip the regex."""
    hit = F.contains(c, F.lit(hints[0]))
    for hint in hints[1:]:
        hit = hit | F.contains(c, F.lit(hint))
    return F.when(hit, match_count(c, pattern)).otherwise(F.lit(0))


def may_contain(c: Column, phrases: list[str]) -> Column:
    """Cheap test that is true wherever a case-insensitive match of a phrase is possible.

    The long s and the Kelvin sign fold to s and k but do not lower-case to them.
    """
    def hit(low: Column) -> Column:
        found = F.contains(c, F.lit("\u017f")) | F.contains(c, F.lit("\u212a"))
        for phrase in phrases:
            found = found | F.contains(low, F.lit(phrase.lower()))
        return found
    # the one-element transform lower-cases a text once for all phrases
    return F.transform(F.array(F.lower(c)), hit)[0]


def sign_count(c: Column, signs: str) -> Column:
    """How many of a few given characters there are, by plain byte search."""
    return sum((F.length(c) - F.length(F.replace(c, F.lit(s), F.lit(""))) for s in signs), F.lit(0))


def char_count(c: Column, char_class: str) -> Column:
    """How many characters belong to a class: drop the rest in bulk and take the length."""
    return F.length(F.regexp_replace(c, f"[^{char_class}]+", ""))


def any_of(phrases: list[str], flags: str = "(?iu)") -> str:
    return flags + "(" + "|".join(re.escape(p).replace("\\ ", " ") for p in phrases) + ")"


CLICKBAIT_PATTERN = any_of(K.CLICKBAIT_PHRASES)
BOILERPLATE_PATTERN = r"(?iuU)\b" + any_of(K.BOILERPLATE, "") + r"\b"


def letters_only(c: Column) -> Column:
    """Lower-case, then only a-z and whitespace stay."""
    return F.regexp_replace(F.lower(c), r"(?U)[^a-z\s]", "")


def remove_boilerplate(c: Column) -> Column:
    return F.when(may_contain(c, K.BOILERPLATE), F.regexp_replace(c, BOILERPLATE_PATTERN, "")).otherwise(c)


def clickbait_count(c: Column) -> Column:
    return F.when(may_contain(c, K.CLICKBAIT_PHRASES), match_count(c, CLICKBAIT_PATTERN)).otherwise(F.lit(0))


def default_stop_words(language: str = "english") -> list[str]:
    """The list in credence/data/stopwords, which MLlib uses too; needs neither a session nor a jar."""
    path = pathlib.Path(__file__).resolve().parents[1] / "data" / "stopwords" / f"{language}.txt"
    return [w for w in path.read_text(encoding="utf-8").split("\n") if w.strip()]


def remove_stop_words(df: DataFrame, column: str, words: list[str], out: str) -> DataFrame:
    """Drop stop words without regard to case, keep order, join by one space."""
    kept = F.expr(f"array_join(filter(_tokens, t -> lower(t) NOT IN ({word_list(words)})), ' ')")
    return df.withColumn("_tokens", space_tokens(F.col(column))).withColumn(out, kept).drop("_tokens")


def remove_hebrew_stop_words(df: DataFrame, column: str, out: str) -> DataFrame:
    kept = F.array_join(without("_tokens", K.HEBREW_STOP_WORDS), " ")
    return df.withColumn("_tokens", space_tokens(F.col(column))).withColumn(out, kept).drop("_tokens")


# ---- language -----------------------------------------------------------------------------
# fixed values: ISO code of every language with a stop-word profile in MLlib
PROFILE_LANGUAGES = {
    "da": "danish", "de": "german", "en": "english", "es": "spanish", "fi": "finnish",
    "fr": "french", "hu": "hungarian", "it": "italian", "nl": "dutch", "no": "norwegian",
    "pt": "portuguese", "ru": "russian", "sv": "swedish", "tr": "turkish",
}


def stop_word_profiles(codes: list[str]) -> dict[str, list[str]]:
    return {c: sorted(set(default_stop_words(PROFILE_LANGUAGES[c]))) for c in codes}


def profile_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(blank_if_null(c)), F.lit(r"([\p{L}']+)"), F.lit(1))


# fixed values: languages told by their letters alone, as code ranges
SCRIPT_RANGES = {
    "he": r"\x{0590}-\x{05FF}", "ar": r"\x{0600}-\x{06FF}", "hi": r"\x{0900}-\x{097F}", "bn": r"\x{0980}-\x{09FF}",
    "th": r"\x{0E00}-\x{0E7F}", "el": r"\x{0370}-\x{03FF}", "ja": r"\x{3040}-\x{30FF}", "ko": r"\x{AC00}-\x{D7AF}",
    "zh-cn": r"\x{4E00}-\x{9FFF}",
}
# letters of languages told by their words: Latin and Cyrillic
PROFILE_LETTERS = r"\x{0000}-\x{036F}\x{0400}-\x{052F}"


def script_lang(letters: Column) -> Column:
    """Language whose script holds more than half of the letters, else null."""
    def half(char_class: str) -> Column:
        return char_count(letters, char_class) * 2 > F.length(letters)
    first, *rest = SCRIPT_RANGES.items()
    found = F.when(half(first[1]), F.lit(first[0]))
    for code, char_class in rest:
        found = found.when(half(char_class), F.lit(code))
    # most texts are in Latin or Cyrillic letters: one look spares them the others
    return F.when(~half(PROFILE_LETTERS), found)


def detect_lang(tokens: str, profiles: dict[str, list[str]]) -> Column:
    """Language by script where one script says it, else the one whose profile words cover most tokens.

    Null without a hit; ties by code order. Row-local, so it needs neither a join nor a shuffle.
    """
    scored = [
        F.struct(
            F.size(within(tokens, words)).alias("hits"),
            F.lit(-rank).alias("order"),
            F.lit(code).alias("code"),
        )
        for rank, (code, words) in enumerate(sorted(profiles.items()))
    ]
    # a one-element transform evaluates the costly scores once for both uses of the winner
    best = F.array(F.array_max(F.array(*scored)))
    by_words = F.transform(best, lambda b: F.when(b["hits"] > 0, b["code"]))[0]
    # likewise the joined letters, which every script test reads
    by_script = F.transform(F.array(F.array_join(tokens, "")), script_lang)[0]
    return F.coalesce(by_script, by_words)


def normalize_lang(c: Column) -> Column:
    """Language names as the translation service spells them."""
    low = F.lower(c)
    return (
        F.when(c.isNull() | (c == ""), F.lit("auto"))
        .when(low.isin("he", "he-il", "heb", "hebrew"), F.lit("iw"))
        .when(low.isin("zh", "zh-cn"), F.lit("zh-CN"))
        .when(low.isin("zh-tw", "zh-hant"), F.lit("zh-TW"))
        .otherwise(low)
    )
