"""Translation as a join with a translation memory; what the memory lacks is emitted as work."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.functions import text as T
from credence.operators.layout import hot_keys, lookup_join


def memory_index(memory: DataFrame, target_lang: str) -> DataFrame:
    """(text, src, tgt, translation) rows as one row per text: source language to translation.

    The smallest of several translations stays; a map has one entry per source language at most.
    """
    single = memory.filter(F.col("tgt") == target_lang).groupBy(F.md5("text").alias("_tm_key"), "src").agg(
        F.min("translation").alias("translation"))
    return single.groupBy("_tm_key").agg(
        F.map_from_entries(F.collect_list(F.struct("src", "translation"))).alias("_tm"))


def translate(df: DataFrame, column: str, memory: DataFrame, profiles: dict[str, list[str]],
              target_lang: str = "en", out: str = "text_used", counted: DataFrame | None = None) -> DataFrame:
    """Translate a column. Same language, unknown language, null and misses keep the text.

    Adds `<column>_lang` and `<column>_did_translate`. Copies of one text share a key, so the join is
    the skew-safe lookup; `counted` is the table to count copies in when df is costly to read twice.
    """
    key = F.md5(F.col(column))
    hot = hot_keys((counted if counted is not None else df).select(key.alias("_tm_key")), "_tm_key")
    joined = lookup_join(df.withColumn("_tm_key", key), memory_index(memory, target_lang), "_tm_key", hot)
    lang = F.col(f"{column}_lang")
    found = F.when(lang != target_lang, F.try_element_at("_tm", lang))
    return (
        joined.withColumn("_tm_tokens", T.profile_tokens(F.col(column)))
        .withColumn(f"{column}_lang", T.detect_lang("_tm_tokens", profiles))
        .withColumn("_tm_text", found)
        .withColumn(f"{column}_did_translate", F.coalesce(F.trim("_tm_text") != "", F.lit(False)))
        .withColumn(out, F.when(F.col(f"{column}_did_translate"), F.col("_tm_text")).otherwise(F.col(column)))
        .drop("_tm_key", "_tm", "_tm_tokens", "_tm_text")
    )


def translation_misses(translated: DataFrame, column: str, target_lang: str = "en") -> DataFrame:
    """Distinct texts that still need a translation, with the number of rows waiting for each."""
    lang = F.col(f"{column}_lang")
    return (
        translated.filter(lang.isNotNull() & (lang != target_lang) & ~F.col(f"{column}_did_translate"))
        .groupBy(F.col(column).alias("text"), lang.alias("src"))
        .agg(F.count("*").alias("n_rows"))
        .withColumn("tgt", F.lit(target_lang))
    )
