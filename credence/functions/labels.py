"""Lookups and risk grades."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from credence import constants as K
from credence.functions.urls import domain_extension


def contains_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def code_lookup(c: Column, codes: dict, default: str | None) -> Column:
    """Look a value up in a constant table."""
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    found = F.try_element_at(table, c)
    return found if default is None else F.coalesce(found, F.lit(default))


def folded(codes: dict[str, str]) -> dict[str, str]:
    """The code table with lower-cased keys (the first spelling of a key decides)."""
    out: dict[str, str] = {}
    for key, value in codes.items():
        out.setdefault(key.lower(), value)
    return out


def normalize_code(c: Column, codes: dict[str, str], default: str = "unknown",
                   strict_keys: bool = False) -> Column:
    """Trim, lower, look up. strict_keys leaves mixed-case keys unreachable, as they once were."""
    value = F.lower(F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", ""))
    return code_lookup(value, codes if strict_keys else folded(codes), default)


def super_category(c: Column) -> Column:
    return code_lookup(F.lower(c), folded(K.CATEGORY_CODES), "other")


def string_label(c: Column) -> Column:
    """'fake' to 0, 'real' to 1, anything else to null."""
    low = F.lower(c)
    return F.when(low == "fake", F.lit(K.FAKE)).when(low == "real", F.lit(K.REAL)).cast("int")


def type_verdict(c: Column) -> Column:
    return (
        F.when(c.isin(K.FAKE_TYPES), F.lit(K.FAKE))
        .when(c.isin(K.REAL_TYPES), F.lit(K.REAL))
        .otherwise(F.lit(-1))
    )


def channel_risk(c: Column) -> Column:
    low = F.lower(c)
    return (
        F.when(c.isNull() | (c == ""), F.lit(0.5))
        .when(contains_any(low, [w.lower() for w in K.TRUSTED_CHANNELS]), F.lit(1.0))
        .when(contains_any(low, [w.lower() for w in K.SATIRE_CHANNELS]), F.lit(0.0))
        .otherwise(F.lit(0.5))
    )


def platform_risk(c: Column) -> Column:
    low = F.lower(c)
    return (
        F.when(c.isNull(), F.lit(1))
        .when(contains_any(low, K.HIGH_RISK_PLATFORMS), F.lit(2))
        .when(contains_any(low, K.LOW_RISK_PLATFORMS), F.lit(0))
        .otherwise(F.lit(1))
    )


def keyword_flag(c: Column) -> Column:
    return F.coalesce(contains_any(F.lower(c), K.HEADLINE_KEYWORDS).cast("int"), F.lit(0))


def domain_risk(extension: Column) -> Column:
    return (
        F.when(extension.isin(K.RISKY_EXTENSIONS), F.lit(2))
        .when(extension.isin(K.TRUSTED_EXTENSIONS), F.lit(0))
        .otherwise(F.lit(1))
    )


def url_risk(url: Column) -> Column:
    return domain_risk(domain_extension(url))
