"""Sinks, caches and saved artefacts. Paths belong to the caller and must be visible to all executors."""
from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.operators.layout import cut_lineage


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", sep: str = ",", header: bool = True) -> None:
    """CSV that the readers take back unchanged: spaces at the ends stay, null and '' differ."""
    (df.write.mode(mode).option("header", header).option("sep", sep).option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def prediction_record(text: Column, result: Column) -> list[Column]:
    """(timestamp, text, result) with the UTC time of the run."""
    stamp = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()),
                          "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return [stamp.alias("timestamp"), text.alias("text"), result.alias("result")]


def log_predictions(df: DataFrame, path: str) -> None:
    """Append records to the prediction log."""
    df.write.mode("append").json(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small report (metrics, thresholds) as JSON lines in one file."""
    df.repartition(1).write.mode("overwrite").json(path)


def cached_rows(keys: DataFrame, path: str, key: list[str],
                compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of a growing table: only keys that are not stored yet are computed and appended.

    Keys that were computed are kept beside the rows, so a key that yields no row is not computed again. They
    are written after the rows: keys of a run that died in between are known by their rows.
    """
    spark, done = keys.sparkSession, f"{path.rstrip('/')}.keys"
    new = keys.select(*key).distinct()
    for stored in (path, done):
        if path_exists(spark, stored):
            new = new.join(spark.read.parquet(stored).select(*key), key, "left_anti")
    # fixed before rows are appended, as its own plan reads them
    new = cut_lineage(new)
    compute(keys.join(new, key, "left_semi")).write.mode("append").parquet(path)
    new.write.mode("append").parquet(done)
    return spark.read.parquet(path).join(keys.select(*key), key, "left_semi")


def materialize_once(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Build and write a dataset the first time, read it ever after."""
    if not path_exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def run_path(base: str) -> str:
    """A time-stamped run folder."""
    return f"{base.rstrip('/')}/run_{datetime.now(timezone.utc).strftime('%Y%m%d-%H%M%S-%f')}"


def save_model(model, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
