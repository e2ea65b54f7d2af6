"""The driver tables as news articles, once as DataFrames and once as SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.functions import hashing as H
from credence.operators.layout import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


# Endings put after a document by doc_id % 8, so that every text pattern occurs in the corpus.
ENDINGS = {
    1: " Continue reading the main story: SHOCKING $5.50 or 3.14 at https://www.example.org/a?b=1 "
       "www.sample.net/q, write to me@site.co.uk!!! Subscribe",
    2: " לא תאמינו שָׁלוֹם של הבית בלעדי ₪20 1.2.3 4x5 v2.0",
    3: " aaa bb cccc ... !!! ??? 🔥🔥🔥 ١٢ x7",
    4: "  watch now… NEWSLETTER special offers https://t.example.info/2024",
}
HEADLINES = {
    3: " !!! You won't believe what happened next??",
    5: " צפו... SHOCKING exclusive",
}


def _case_sql(modulus: int, texts: dict[int, str]) -> str:
    whens = " ".join(f"WHEN {k} THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in texts.items())
    return f"CASE doc_id % {modulus} {whens} ELSE '' END"


def _case(modulus: int, texts: dict[int, str]):
    out = F.lit("")
    for key, value in texts.items():
        out = F.when(F.col("doc_id") % modulus == key, F.lit(value)).otherwise(out)
    return out


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as one article row; unlabelled documents keep a null label."""
    docs = documents(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    i = F.col("doc_id")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (i % 365).cast("int"))
    stamp = F.concat(day.cast("string"), F.lit(" "), F.lpad((i % 24).cast("string"), 2, "0"), F.lit(":30:00"))
    types = ["fake", "reliable", "bias", "satire", "bs"]
    type_col = F.lit(None).cast("string")
    for n, t in enumerate(types):
        type_col = F.when(i % 6 == n, F.lit(t)).otherwise(type_col)
    return (
        docs.join(labels, "doc_id", "left")
        .select(
            "doc_id",
            F.when(i % 31 == 7, F.lit(None)).otherwise(F.concat(
                F.when(i % 5 == 0, F.concat("source", F.lit(" desk-1: "))).otherwise(F.lit("")),
                F.split_part("text", F.lit("\n"), F.lit(1)), _case(7, HEADLINES))).alias("title"),
            F.concat("text", _case(8, ENDINGS)).alias("text"),
            F.concat(F.lit("https://www."), "source", F.lit(".com/2024/"),
                     F.lpad((i % 12 + 1).cast("string"), 2, "0"), F.lit("/"),
                     F.lpad((i % 28 + 1).cast("string"), 2, "0"), F.lit("/item-"), i).alias("url"),
            "source",
            F.when(F.col("lang") == "en", "politics").when(F.col("lang") == "fr", "left-news")
            .when(F.col("lang") == "de", "US_News").alias("category"),
            F.when(i % 11 != 0, F.concat(F.lit("a"), i % 37)).alias("author"),
            F.when(i % 13 == 0, "n/a").when(i % 2 == 0, stamp).otherwise(day.cast("string"))
            .alias("date_published"),
            type_col.alias("type"),
            F.col("label").cast("int").alias("label"),
            "lang",
        )
    )


_DAY = "CAST(DATE '2024-01-01' + CAST(d.doc_id % 365 AS INTEGER) AS VARCHAR)"
CANON = f"""canon AS (
  SELECT d.doc_id,
    CASE WHEN d.doc_id % 31 = 7 THEN NULL ELSE
      (CASE WHEN d.doc_id % 5 = 0 THEN source || ' desk-1: ' ELSE '' END)
      || split_part(d.text, chr(10), 1) || ({_case_sql(7, HEADLINES).replace('doc_id', 'd.doc_id')}) END AS title,
    d.text || ({_case_sql(8, ENDINGS).replace('doc_id', 'd.doc_id')}) AS text,
    'https://www.' || source || '.com/2024/' || lpad(CAST(d.doc_id % 12 + 1 AS VARCHAR), 2, '0') || '/'
      || lpad(CAST(d.doc_id % 28 + 1 AS VARCHAR), 2, '0') || '/item-' || d.doc_id AS url,
    source,
    CASE lang WHEN 'en' THEN 'politics' WHEN 'fr' THEN 'left-news' WHEN 'de' THEN 'US_News' END AS category,
    CASE WHEN d.doc_id % 11 <> 0 THEN 'a' || (d.doc_id % 37) END AS author,
    CASE WHEN d.doc_id % 13 = 0 THEN 'n/a'
      WHEN d.doc_id % 2 = 0 THEN {_DAY} || ' ' || lpad(CAST(d.doc_id % 24 AS VARCHAR), 2, '0') || ':30:00'
      ELSE {_DAY} END AS date_published,
    CASE d.doc_id % 6 WHEN 0 THEN 'fake' WHEN 1 THEN 'reliable' WHEN 2 THEN 'bias' WHEN 3 THEN 'satire'
      WHEN 4 THEN 'bs' END AS type,
    CAST(l.quality AS INTEGER) AS label,
    lang
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def scored(spark: SparkSession, sf_dir: str, decimals: int | None = None) -> DataFrame:
    """Labelled articles with a fixed score that leans towards the truth."""
    u = H.uniform(F.col("doc_id"), 42)
    p = u * 0.6 + (1 - F.col("label")) * 0.4
    if decimals is not None:
        p = F.round(p, decimals)
    return canonical(spark, sf_dir).filter("label IS NOT NULL").withColumn("p_fake", p)


def hash32_sql(key: str, seed: int | str = 42) -> str:
    return f"CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || '|{seed}'), 1, 8) AS BIGINT)"


def uniform_sql(key: str, seed: int | str = 42) -> str:
    return f"({hash32_sql(key, seed)} / CAST(4294967296 AS DOUBLE))"


P_FAKE = f"({uniform_sql('doc_id')} * CAST(0.6 AS DOUBLE) + (1 - label) * CAST(0.4 AS DOUBLE))"
SCORED = f"""{CANON},
scored AS (SELECT *, {P_FAKE} AS p_fake FROM canon WHERE label IS NOT NULL)"""
SCORED_TIES = f"""{CANON},
scored AS (SELECT *, round({P_FAKE}, 1) AS p_fake FROM canon WHERE label IS NOT NULL)"""
