"""Structured Streaming jobs. All of them drain what has arrived and end (availableNow).

Sinks that need joins or aggregates per micro-batch write one folder per batch id and overwrite it, so
that a replayed batch changes nothing.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from credence.operators.augment import arm_values
from credence.operators.features import article_features
from credence.operators.scoring import verdict
from credence.sources.sinks import path_exists


def arriving(spark: SparkSession, path: str, schema, files_per_batch: int = 1000, fmt: str = "json") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def drain(writer) -> StreamingQuery:
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def each_batch(stream: DataFrame, checkpoint: str, work: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return drain(stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(work))


def stream_chunks(stream: DataFrame, out: str, checkpoint: str, summary: Callable[[DataFrame], DataFrame]) -> None:
    """Chunked scan: `summary` of every chunk, tagged with its number."""
    def work(batch: DataFrame, number: int) -> None:
        summary(batch).withColumn("chunk", F.lit(number)).write.mode("overwrite").parquet(f"{out}/chunk-{number}")
    each_batch(stream, checkpoint, work)


def stream_features(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Feature rows of arriving articles: the batch expressions on a stream, no state."""
    drain(article_features(stream).writeStream.format("parquet").option("path", out)
          .option("checkpointLocation", checkpoint).outputMode("append"))


def stream_score(stream: DataFrame, score: Callable[[DataFrame], DataFrame], key: str, out: str, checkpoint: str) -> None:
    """Score arriving requests; blank texts become error records instead.

    `score` maps (key, text) rows to (key, prob_fake) rows.
    """
    def work(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        blank = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", "") == ""
        scored = score(batch.filter(~blank).select(key, "text")).select(
            key, verdict(F.col("prob_fake")).alias("verdict"), "prob_fake", F.lit(None).cast("string").alias("error"))
        refused = batch.filter(blank).select(
            key, F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("double").alias("prob_fake"),
            F.lit("missing 'text'").alias("error"))
        records = scored.unionByName(refused).withColumn("timestamp", F.current_timestamp())
        records.write.mode("overwrite").json(f"{out}/batch-{number}")
        batch.unpersist()
    each_batch(stream, checkpoint, work)


def stream_fit(stream: DataFrame, state: str, checkpoint: str,
               start: Callable[[], tuple[DataFrame, float]],
               step: Callable[[DataFrame, float, DataFrame], tuple[DataFrame, float]]) -> None:
    """Mini-batch training: version n of the coefficients is version n-1 updated with batch n.

    Every version is a stored table (coefficients and bias), so a retried batch starts from the same one.
    """
    def work(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = f"{state}/version={number - 1}"
        if path_exists(spark, before):
            coefficients = spark.read.parquet(before)
            bias = coefficients.filter("term IS NULL").first()["coef"]
            coefficients = coefficients.filter("term IS NOT NULL")
        else:
            coefficients, bias = start()
        coefficients, bias = step(coefficients, bias, batch)
        row = spark.createDataFrame([(None, float(bias))], "term string, coef double")
        coefficients.select("term", "coef").unionByName(row).write.mode("overwrite").parquet(f"{state}/version={number}")
    each_batch(stream, checkpoint, work)


def stream_arm_values(stream: DataFrame, state: str, checkpoint: str, arm: str, order: str, key: str, reward: str,
                      alpha: float = 0.2) -> None:
    """Arm values over an arriving reward log: the stored (value, n) decays by the batch's count, then
    the batch's own weighted sum is added. Version n builds on version n-1."""
    def work(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = arm_values(batch, arm, order, key, reward, alpha)
        before = f"{state}/version={number - 1}"
        if path_exists(spark, before):
            old = spark.read.parquet(before).select(arm, F.col("value").alias("_v"), F.col("n").alias("_n"))
            both = old.join(fresh, arm, "full")
            zero = F.lit(0)
            fresh = both.select(
                arm,
                (F.coalesce("_v", F.lit(0.0)) * F.pow(F.lit(1 - alpha), F.coalesce("n", zero)) + F.coalesce("value", F.lit(0.0))).alias("value"),
                (F.coalesce("_n", zero) + F.coalesce("n", zero)).alias("n"))
        fresh.write.mode("overwrite").parquet(f"{state}/version={number}")
    each_batch(stream, checkpoint, work)


def latest_version(spark: SparkSession, state: str) -> DataFrame:
    """The newest version of a state table; older ones are pruned by their partition."""
    versions = spark.read.parquet(state)
    newest = versions.select("version").agg(F.max("version")).scalar()
    return versions.filter(F.col("version") == newest).drop("version")


def monitor(log: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Verdict counts and mean score per window; replayed requests count once.

    Works on a stream (windows are emitted when the watermark passes them) and on a static log.
    """
    if log.isStreaming:
        log = log.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["request_id"])
    else:
        log = log.dropDuplicates(["request_id"])
    return log.groupBy(F.window("timestamp", width).alias("w"), "verdict").agg(
        F.count("*").alias("n"), F.avg("prob_fake").alias("mean_prob_fake")
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "verdict", "n", "mean_prob_fake")


def stream_monitor(stream: DataFrame, out: str, checkpoint: str, width: str = "1 hour", delay: str = "10 minutes") -> None:
    drain(monitor(stream, width, delay).writeStream.format("parquet").option("path", out)
          .option("checkpointLocation", checkpoint).outputMode("append"))
