"""Prompt and label datasets."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence import constants as K
from credence.functions.text import blank_if_null
from credence.operators.layout import lookup_join


def label_prompt(text: Column, title: Column | None = None) -> Column:
    """Instruction, (title,) text and an open label."""
    headline = [] if title is None else [F.lit("Title: "), blank_if_null(title), F.lit("\n")]
    return F.concat(F.lit(K.PROMPT_INSTRUCTION + "\n"), *headline, F.lit("Text: "), blank_if_null(text), F.lit("\nLabel:"))


def label_prompts(df: DataFrame, text: str = "text", title: str | None = None) -> DataFrame:
    return df.withColumn("prompt", label_prompt(F.col(text), None if title is None else F.col(title)))


def sft_examples(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """Prompt with its gold tag; the target is 1 for FAKE."""
    fake = F.col(label) == K.FAKE
    return label_prompts(df, text).withColumns({
        "target": fake.cast("int"),
        "example": F.concat("prompt", F.lit(" "), F.when(fake, F.lit(K.TAG_FAKE)).otherwise(F.lit(K.TAG_REAL))),
    })


def context_request(text: Column, max_chars: int = 800, text_limit: int = 4000) -> Column:
    """Request for neutral background on an article."""
    head = K.BACKGROUND_REQUEST.format(max_chars=max_chars)
    return F.concat(F.lit(head + '"""'), F.substring(blank_if_null(text), 1, text_limit), F.lit('"""'))


def add_background(df: DataFrame, background: DataFrame, text: str = "text", max_chars: int = 800) -> DataFrame:
    """Append stored background to the texts it was written for, matched by the hash of the text."""
    best = background.groupBy(F.md5("text").alias("_bg_key")).agg(F.min("background").alias("_bg"))
    cut = F.when(F.length("_bg") > max_chars,
                 F.concat(F.rtrim(F.substring("_bg", 1, max_chars)), F.lit("…"))).otherwise(F.col("_bg"))
    joined = lookup_join(df.withColumn("_bg_key", F.md5(text)), best, "_bg_key")
    return joined.withColumn(text, F.concat(F.col(text), F.lit(" || "), F.substring(F.coalesce(cut, F.lit("")), 1, max_chars))).drop("_bg_key", "_bg")
