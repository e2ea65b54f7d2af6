"""DuckDB spellings of the scalar functions."""
from __future__ import annotations

from catalog.features import WORD, WS
from catalog.registry import quoted
from credence import constants as K
from credence.functions.labels import folded
from credence.functions.text import PROFILE_LETTERS, SCRIPT_RANGES, default_stop_words

NWS = WS.replace("[", "[^", 1)
W_IN, S_IN = r"\p{L}\p{N}_", WS[1:-1]
STRIP = f"'^{WS}+|{WS}+$', '', 'g'"


def stop_words(language: str) -> list[str]:
    return default_stop_words(language)


def author(c):
    name = f"regexp_replace(regexp_extract(coalesce({c}, ''), '^([{W_IN}{S_IN}\\-]+):', 1), {STRIP})"
    return f"CASE WHEN {name} = '' THEN 'unknown' ELSE {name} END"


def date_from_url(c):
    p = "'/([0-9]{4})/([0-9]{2})/([0-9]{2})'"
    g = [f"regexp_extract(coalesce({c}, ''), {p}, {i})" for i in (1, 2, 3)]
    return f"CASE WHEN {g[0]} = '' THEN '' ELSE {g[0]} || '-' || {g[1]} || '-' || {g[2]} END"


def url_from_text(c):
    return f"regexp_extract(coalesce({c}, ''), 'https?://{NWS}+', 0)"


def title_from_url(c):
    path = f"regexp_replace(regexp_extract(coalesce({c}, ''), '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?(?://[^/?#]*)?([^?#]*)', 1), ';[^/]*$', '')"
    slug = f"list_last(string_split(regexp_replace({path}, '^/+|/+$', '', 'g'), '/'))"
    return f"trim(regexp_replace({slug}, '[-_]+', ' ', 'g'))"


def netloc(c):
    return f"regexp_extract(coalesce({c}, ''), '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//([^/?#]*)', 1)"


def extension(c):
    return f"list_last(string_split({netloc(c)}, '.'))"


def channel(c):
    return f"regexp_replace(regexp_extract(coalesce({c}, ''), 'by (.+?) \\p{{Nd}}', 1), {STRIP})"


def any_in(c, words):
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


def channel_risk(c):
    low = f"lower({c})"
    return (f"CASE WHEN {c} IS NULL OR {c} = '' THEN CAST(0.5 AS DOUBLE) "
            f"WHEN {any_in(low, [w.lower() for w in K.TRUSTED_CHANNELS])} THEN 1.0 "
            f"WHEN {any_in(low, [w.lower() for w in K.SATIRE_CHANNELS])} THEN 0.0 ELSE 0.5 END")


def platform_risk(c):
    return (f"CASE WHEN {c} IS NULL THEN 1 WHEN {any_in(f'lower({c})', K.HIGH_RISK_PLATFORMS)} THEN 2 "
            f"WHEN {any_in(f'lower({c})', K.LOW_RISK_PLATFORMS)} THEN 0 ELSE 1 END")


def keyword_flag(c):
    return f"coalesce(CAST({any_in(f'lower({c})', K.HEADLINE_KEYWORDS)} AS INTEGER), 0)"


def domain_risk(ext):
    return (f"CASE WHEN {ext} IN ({quoted(K.RISKY_EXTENSIONS)}) THEN 2 "
            f"WHEN {ext} IN ({quoted(K.TRUSTED_EXTENSIONS)}) THEN 0 ELSE 1 END")


def lookup(c, codes, default):
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in codes.items())
    return f"CASE {c} {whens} ELSE {default} END"


def normalize(c, codes, strict=False):
    return lookup(f"lower(regexp_replace({c}, {STRIP}))", codes if strict else folded(codes), "'unknown'")


def super_category(c):
    return lookup(f"lower({c})", folded(K.CATEGORY_CODES), "'other'")


def string_label(c):
    return f"CAST(CASE lower({c}) WHEN 'fake' THEN 0 WHEN 'real' THEN 1 END AS INTEGER)"


def type_verdict(c):
    return f"CASE WHEN {c} IN ({quoted(K.FAKE_TYPES)}) THEN 0 WHEN {c} IN ({quoted(K.REAL_TYPES)}) THEN 1 ELSE -1 END"


def space_tokens(c):
    return f"list_filter(regexp_split_to_array(coalesce({c}, ''), '{WS}+'), lambda t: t <> '')"


def letters_only(c):
    return f"regexp_replace(lower({c}), '[^a-z{S_IN}]', '', 'g')"


def remove_boilerplate(c):
    """Word-bounded phrases without lookaround: mark word runs, so that a boundary is a character."""
    phrases = "|".join(K.BOILERPLATE)
    return (f"replace(regexp_replace(regexp_replace({c}, '({WORD}+)', chr(1) || '\\1' || chr(2), 'g'), "
            f"chr(1) || '(?i:' || replace('{phrases}', ' ', chr(2) || ' ' || chr(1)) || ')' || chr(2), '', 'g')"
            f", chr(1), '')")


def boilerplate(c):
    return f"replace({remove_boilerplate(c)}, chr(2), '')"


def vector_tokens(c):
    return f"regexp_extract_all(lower(coalesce({c}, '')), '[{W_IN}]{{2,}}')"


def profile_hits(c, words):
    return (f"len(list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}'']+'), "
            f"lambda t: t IN ({quoted(words)})))")


LANGS = {"de": "german", "en": "english", "es": "spanish", "fr": "french"}


def detect_lang(c):
    hits = {k: profile_hits(c, stop_words(v)) for k, v in LANGS.items()}
    listed = "[" + ", ".join(hits[k] for k in LANGS) + "]"
    best = f"list_max({listed})"
    letters = f"array_to_string(regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}'']+'), '')"
    half = lambda r: f"length(regexp_replace({letters}, '[^{r}]+', '', 'g')) * 2 > length({letters})"
    scripts = " ".join(f"WHEN NOT {half(PROFILE_LETTERS)} AND {half(r)} THEN '{code}'" for code, r in SCRIPT_RANGES.items())
    return f"CASE {scripts} WHEN {best} > 0 THEN ['de', 'en', 'es', 'fr'][list_position({listed}, {best})] END"


def timestamp(c):
    formats = ["%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d", "%Y/%m/%d", "%d/%m/%Y", "%B %d, %Y", "%b %d, %Y"]
    return f"try_strptime({c}, [{quoted(formats)}])"
