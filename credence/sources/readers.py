"""Scans with explicit schemas."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credence import constants as K
from credence.operators.layout import cut_lineage

ARTICLE_SCHEMA = T.StructType([
    T.StructField(c, {"rating": T.DoubleType(), "label": T.IntegerType()}.get(c, T.StringType()))
    for c in K.ARTICLE_COLUMNS])
FACT_CHECK_SCHEMA = T.StructType([
    T.StructField(c, T.IntegerType() if c.endswith("_c") else T.StringType()) for c in K.FACT_CHECK_COLUMNS])
TOKEN = "struct<token:string,weight:double,towards:string>"
RESULT = (f"struct<label:string,prob_fake:double,top_tokens:array<{TOKEN}>,explainer:string,"
          "translation:struct<enabled:boolean,did_translate:boolean,src_lang:string,tgt_lang:string>,"
          "model_used:string,prob_fake_tfidf:double,prob_fake_emb:double>")
LOG_SCHEMA = f"timestamp string, text string, result {RESULT}"
BAD_LINE = "_bad_line"


def read_csv(spark: SparkSession, path: str, schema, n_rows: int | None = None,
             columns: list[str] | None = None, sep: str = ",", header: bool = True,
             multi_line: bool = True) -> DataFrame:
    """CSV with quoted line breaks; n_rows is the caller's row cap, columns the ones to parse.

    A file with quoted line breaks cannot be split, so it is one task: where no field holds one, pass
    multi_line=False; else read it once and keep it with `materialize_once`.
    """
    df = (
        spark.read.schema(schema).option("header", header).option("sep", sep)
        .option("quote", '"').option("escape", '"').option("multiLine", multi_line).csv(path)
    )
    if columns:
        df = df.select(*columns)
    return df if n_rows is None else df.limit(n_rows)


def read_csv_split(spark: SparkSession, path: str, schema, sep: str = ",", header: bool = True) -> DataFrame:
    """CSV with quoted line breaks, read by many tasks instead of one a file.

    Lines are read split by split (byte ranges cut at line ends, as for text). A line's quote count decides
    whether a record continues past it: the quote parity before a line is the sum of all quotes before it in its
    file, from a small table of per-split totals (a row a split) plus a running sum inside the split. A line with
    even parity before it starts a record; the lines of a record, wherever they were read, are joined with '\n'
    and parsed by `from_csv` with the file's options. The header (first record of each file) and empty records
    are dropped, as the CSV reader does. Line ends inside quotes come back as '\n' (a '\r\n' in a field
    becomes '\n'). Only the records' lines are shuffled, once, to meet by record.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"),
        F.monotonically_increasing_id().alias("_p"), F.col("value").alias("_line"))
    lines = lines.withColumn("_q", F.length("_line") - F.length(F.regexp_replace("_line", '"', "")))
    lines = cut_lineage(lines)
    blocks = lines.groupBy("_f", "_b").agg(F.sum("_q").alias("_bq"))
    in_file = Window.partitionBy("_f").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_bq").over(in_file), F.lit(0)))
    in_block = Window.partitionBy("_f", "_b").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    placed = (lines.join(F.broadcast(blocks.select("_f", "_b", "_before")), ["_f", "_b"])
              .withColumn("_start", ((F.col("_before") + F.coalesce(F.sum("_q").over(in_block), F.lit(0))) % 2) == 0))
    placed = cut_lineage(placed)
    starts = placed.groupBy("_f", "_b").agg(F.sum(F.col("_start").cast("long")).alias("_bs"))
    starts = starts.withColumn("_sbefore", F.coalesce(F.sum("_bs").over(in_file), F.lit(0)))
    upto = Window.partitionBy("_f", "_b").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    numbered = (placed.join(F.broadcast(starts.select("_f", "_b", "_sbefore")), ["_f", "_b"])
                .withColumn("_rec", F.col("_sbefore") + F.sum(F.col("_start").cast("long")).over(upto) - 1))
    records = numbered.groupBy("_f", "_rec").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_b", "_p", "_line"))), lambda x: x["_line"]),
                     "\n").alias("_text"))
    if header:
        records = records.where(F.col("_rec") > 0)
    ddl = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    options = {"sep": sep, "quote": '"', "escape": '"'}
    return records.where(F.col("_text") != "").select(F.from_csv("_text", ddl, options).alias("r")).select("r.*")


def read_articles(spark: SparkSession, path: str, schema=ARTICLE_SCHEMA, n_rows: int | None = None,
                  columns: list[str] | None = None) -> DataFrame:
    return read_csv(spark, path, schema, n_rows, columns)


def read_tsv(spark: SparkSession, path: str, schema, header: bool = True) -> DataFrame:
    return read_csv(spark, path, schema, sep="\t", header=header)


def read_fact_checks(spark: SparkSession, path: str) -> DataFrame:
    """The headerless 14-column fact-check table."""
    return read_tsv(spark, path, FACT_CHECK_SCHEMA, header=False)


def read_table(spark: SparkSession, path: str, schema=None, columns: list[str] | None = None) -> DataFrame:
    """Parquet or CSV by extension; selected columns become the read schema."""
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
        return df.select(*columns) if columns else df
    return read_csv(spark, path, schema, columns=columns)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; `_bad_line` holds the lines that do not parse."""
    return (
        spark.read.schema(f"{schema}, {BAD_LINE} string").option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", BAD_LINE).json(path)
    )


def read_labelled_jsonl(spark: SparkSession, path: str, text: str, label: str) -> DataFrame:
    """Training rows: malformed lines, and rows without text or integer label, are left out."""
    df = read_jsonl(spark, path, f"{text} string, {label} string")
    good = df.filter(F.col(BAD_LINE).isNull()).drop(BAD_LINE)
    return good.withColumn(label, F.expr(f"try_cast({label} AS INT)")).na.drop(subset=[text, label])
