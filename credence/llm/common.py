"""Shared by the operators: reading tables, storing intermediate tables, ranges, work on Arrow batches."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.session import work_path

# Characters of text that one step of Python work holds at a time.
STEP_CHARS = 2_000_000
# Rows of an Arrow batch to a Python worker: whole texts can be long, so the default of 10 000 rows is too many.
BATCH_ROWS = 500
BATCH_BYTES = "32m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: computed once, safe against lost executors."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, unless its user has set their size."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def text_steps(batches: Iterator[pd.DataFrame], column: str = "text") -> Iterator[tuple[pd.DataFrame, list[str]]]:
    """Slices of the batches with their texts (null: empty), cut so that few characters are held at once."""
    for batch in batches:
        texts = ["" if t is None else t for t in batch[column].tolist()]
        start = size = 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= STEP_CHARS or i + 1 == len(texts):
                yield batch.iloc[start:i + 1], texts[start:i + 1]
                start, size = i + 1, 0


def map_texts(df: DataFrame, keep: list[str], schema: str, work: Callable[[list[str]], dict],
              text: str = "text") -> DataFrame:
    """Narrow map: `work` turns texts into columns; the columns `keep` pass. `schema` lists keep + new."""
    def run(batches):
        for rows, texts in text_steps(batches, "_text"):
            out = {c: rows[c] for c in keep}
            made = work(texts)
            yield pd.DataFrame(out | {k: pd.Series(v, index=rows.index) for k, v in made.items()})

    small_batches(df.sparkSession)
    return df.select(*keep, F.col(text).alias("_text")).mapInPandas(run, schema)


def crc32_bucket(column: str | Column, modulus: int) -> Column:
    """crc32(key as text) mod `modulus`: the folds of the held-out rows. A null key counts as empty text."""
    key = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def range_bounds(df: DataFrame, key: str, weight: str, target: float, pieces: int = 1024) -> list[int]:
    """Exact, layout-independent bounds that cut an integer key into ranges of about `target` weight.

    Ranges over the target are cut into `pieces` equal parts by key and counted again, so clustered keys
    are cut as finely as needed; a single key is never cut. The driver gets one row per counted part of an
    overfull range: at most `pieces` x (total / target) a round.
    """
    facts = df.agg(F.min(key), F.max(key)).first()
    if facts[0] is None:
        return []
    open_ranges, closed = [(int(facts[0]), int(facts[1]))], []
    keyed = df.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("_k"), F.col(weight).alias("_w"))
    while open_ranges:
        spans = [(i, a, max(1, -(-(b - a + 1) // pieces)), b) for i, (a, b) in enumerate(sorted(open_ranges))]
        frame = df.sparkSession.createDataFrame(spans, "_r int, _a long, _step long, _b long")
        parts = (
            with_range(keyed, "_k", [a for _, a, _, _ in spans[1:]], "_r").join(F.broadcast(frame), "_r")
            .filter((F.col("_k") >= F.col("_a")) & (F.col("_k") <= F.col("_b")))
            .groupBy("_a", "_step", "_b", F.expr("(_k - _a) div _step").alias("_p")).agg(F.sum("_w").alias("_w"))
            .collect())
        open_ranges = []
        for row in parts:
            lo = row["_a"] + row["_p"] * row["_step"]
            hi = min(row["_b"], lo + row["_step"] - 1)
            if (row["_w"] or 0) > target and hi > lo:
                open_ranges.append((lo, hi))
            else:
                closed.append((lo, row["_w"] or 0))
    bounds, total = [], 0.0
    for lo, weight_here in sorted(closed):
        if total and total + weight_here > target:
            bounds.append(lo)
            total = 0.0
        total += weight_here
    return bounds


def with_range(df: DataFrame, key: str, bounds: list[int], out: str) -> DataFrame:
    """Add how many of the sorted bounds are at most the key (null key: 0).

    A short list is one literal array; a long one is searched by Bucketizer, whose doubles keep the order.
    """
    if len(bounds) <= 512:
        marks = F.lit(0) if not bounds else F.size(F.filter(
            F.array(*[F.lit(int(b)).cast("long") for b in bounds]), lambda b: b <= F.col(key)))
        return df.withColumn(out, F.when(F.col(key).isNull(), 0).otherwise(marks).cast("int"))
    splits = [float("-inf"), *sorted({float(b) for b in bounds}), float("inf")]
    keyed = df.withColumn("_range_key", F.coalesce(F.col(key).cast("double"), F.lit(float("-inf"))))
    return Bucketizer(splits=splits, inputCol="_range_key", outputCol=out).transform(keyed).drop("_range_key").withColumn(out, F.col(out).cast("int"))
