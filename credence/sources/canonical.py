"""The canonical article table: conforming, merging, keys and target means."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence import constants as K
from credence.functions.labels import normalize_code
from credence.operators.layout import HOT_SHARE, cut_lineage, lookup_join

TYPES = {"rating": "double", "label": "int"}


def add_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """Constant columns, only where the column is absent."""
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})


def conform(df: DataFrame, defaults: dict | None = None, rename: dict[str, str] | None = None,
            keep: list[str] | None = None) -> DataFrame:
    """Rename, fill in defaults, then exactly the canonical columns in their order and types.

    A column that is still missing becomes '' (null for the two numeric ones).
    """
    out = add_defaults(df.withColumnsRenamed(rename or {}), defaults or {})

    def column(c: str) -> Column:
        if c in out.columns:
            return F.col(c).cast(TYPES.get(c, "string")).alias(c)
        return (F.lit(None) if c in TYPES else F.lit("")).cast(TYPES.get(c, "string")).alias(c)

    return out.select(*(keep or []), *[column(c) for c in K.ARTICLE_COLUMNS])


def union_articles(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def normalize_codes(df: DataFrame, column: str, codes: dict[str, str], strict_keys: bool = False) -> DataFrame:
    return df.withColumn(column, normalize_code(F.col(column), codes, strict_keys=strict_keys))


def merge_sources(parts: list[DataFrame], strict_keys: bool = False) -> DataFrame:
    """All sources as one table: labelled rows with a text, type and category normalised."""
    merged = union_articles(parts).filter(
        F.col("label").isNotNull() & F.col("text").isNotNull() & (F.col("text") != ""))
    merged = normalize_codes(merged, "type", K.TYPE_CODES, strict_keys)
    return normalize_codes(merged, "category", K.CATEGORY_CODES, strict_keys)


def target_mean(df: DataFrame, key: str, label: str = "label", out: str = "rating",
                default: float = 0.5, leave_one_out: bool = False) -> DataFrame:
    """Mean label of a row's key as a feature; `default` for null keys and keys without labels.

    The means come from a map-side combined aggregate and return by a skew-safe lookup; no window
    over the key, so a key with a third of the rows is never sorted in one task. The same aggregate
    tells the hot keys, so the rows are read twice: for the means and for the lookup.
    """
    counts = cut_lineage(df.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.sum(label).alias("_sum"), F.count(label).alias("_cnt"), F.count("*").alias("_n")))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    hot = counts.filter(F.col("_n") >= total * HOT_SHARE).select(key)
    joined = lookup_join(df, counts.drop("_n"), key, hot)
    if leave_one_out:
        own = F.coalesce(F.col(label), F.lit(0))
        seen = F.col(label).isNotNull().cast("long")
        mean = F.try_divide(F.col("_sum") - own, F.col("_cnt") - seen)
    else:
        mean = F.try_divide(F.col("_sum"), F.col("_cnt"))
    return joined.withColumn(out, F.coalesce(mean, F.lit(default))).drop("_sum", "_cnt")


def content_id(*columns: str) -> Column:
    """Row key from content, since a distributed table has no row number: md5 of the joined values."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.md5(F.concat_ws("\u001f", *parts))


def index_id(index: str | Column) -> Column:
    """md5 of a row index written as text, where the table has one."""
    c = F.col(index) if isinstance(index, str) else index
    return F.md5(c.cast("string"))


def distinct_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.dropDuplicates(columns) if columns else df.distinct()
