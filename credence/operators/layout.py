"""How rows are laid out over tasks: spreading, skew-safe lookups, distributed ranks and running sums."""
from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from credence.session import shared_root, work_path

# A key is hot when it holds at least this share of the rows, so at most 1 / HOT_SHARE keys are.
HOT_SHARE = 1 / 256
# Longest term or coefficient table that is sent to every task: a few tens of MB.
BROADCAST_ROWS = 500_000


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows over all cores when the input has fewer splits than cores (few, heavy files).

    Inputs with enough splits pass untouched: no shuffle is added on a large table.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE) -> DataFrame:
    """Keys holding at least `share` of the non-null rows: never more than 1 / share of them."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    return counts.filter(F.col("_n") >= total * F.lit(share)).select(key)


def lookup_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame | None = None) -> DataFrame:
    """Left join to a table that is unique in a string `key`, safe when one key holds most rows.

    Hot keys (at most 1 / share rows of the right side) are joined by broadcast. All other rows go
    through an ordinary join that Spark broadcasts or shuffles by the measured size; there, hot and
    null keys carry a row-hash instead of the key, so they spread over the tasks and match nothing.
    `hot` may come from hot_keys over a cheaper table with the same keys; by default left is counted.
    """
    values = [c for c in right.columns if c != key]
    hot = hot_keys(left.select(key), key) if hot is None else hot
    hot_right = right.join(F.broadcast(hot), key, "left_semi").select(
        F.col(key), F.struct(*values).alias("_hot"))
    cold_right = right.select(F.col(key).alias("_cold_key"), F.struct(*values).alias("_cold"))
    kept = [c for c in left.columns if c not in values]
    joined = (
        left.select(*kept)
        .join(F.broadcast(hot_right), key, "left")
        .withColumn("_cold_key", F.when(
            F.col(key).isNotNull() & F.col("_hot").isNull(), F.col(key)
        ).otherwise(F.concat(F.lit("\u0000"), F.xxhash64(*kept).cast("string"))))
        .join(cold_right, "_cold_key", "left")
    )
    return joined.select(
        *kept, *[F.coalesce(F.col("_hot")[v], F.col("_cold")[v]).alias(v) for v in values])


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a (stored or cheap) table has at most `rows` rows; counting stops there."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint after a look at the size; a larger table is left to an ordinary join."""
    return F.broadcast(df) if is_small(df, rows) else df


def join_on(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner equi-join that also matches null keys, with the keys once in the result."""
    renamed = right.select(*[F.col(c).alias(f"_k_{c}") if c in keys else F.col(c) for c in right.columns])
    match = F.lit(True)
    for k in keys:
        match = match & left[k].eqNullSafe(renamed[f"_k_{k}"])
    return left.join(renamed, match).drop(*[f"_k_{k}" for k in keys])


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder: a costly frame with several readers is computed once, and a
    lost executor does not send its readers back to the source."""
    shared_root(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The same as Parquet: columns of numbers take a fraction of a checkpoint's bytes, but the layout is lost."""
    path = work_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that texts reach Python in, unless the session's user has set their size."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def solver_rows(rows: DataFrame, per_task: int = 40_000) -> DataFrame:
    """Stored rows in as few tasks as there are cores, or as hold `per_task` rows: in every iteration of a solver each
    task sends a gradient as long as the vocabulary."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // per_task))
    return rows.coalesce(tasks)


def n_buckets(df: DataFrame) -> int:
    """Ranges used to cut an order into parallel pieces."""
    return max(16, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def quantile_bounds(df: DataFrame, column: str, buckets: int) -> list[float]:
    """Range bounds from approximate quantiles: at most `buckets` numbers reach the driver."""
    points = [i / buckets for i in range(1, buckets)]
    found = df.select(F.percentile_approx(F.col(column).cast("double"), points, 10000)).first()[0]
    return sorted(set(found or []))


def bucketed(df: DataFrame, column: str, bounds: list[float]) -> DataFrame:
    """Add `_bucket`, the range a value falls into; a pure function of the value."""
    splits = [float("-inf"), *bounds, float("inf")]
    if len(splits) < 3:
        return df.withColumn("_bucket", F.lit(0.0))
    keyed = df.withColumn("_order_value", F.col(column).cast("double"))
    stage = Bucketizer(splits=splits, inputCol="_order_value", outputCol="_bucket")
    return stage.transform(keyed).drop("_order_value")


def running_totals(df: DataFrame, groups: list[str], column: str, values: list[str],
                   ascending: bool = True, buckets: int | None = None) -> DataFrame:
    """Inclusive running sums of `values` in the order of a numeric column, without one big task.

    The order is cut into ranges; ranges are summed, the few range sums are accumulated, and rows
    are accumulated inside their range only. `column` must be unique within a group.
    """
    buckets = buckets or n_buckets(df)
    ranged = bucketed(df, column, quantile_bounds(df, column, buckets))
    sums = cut_lineage(ranged.groupBy(*groups, "_bucket").agg(*[F.sum(v).alias(f"_s_{v}") for v in values]))
    step = F.col("_bucket").asc() if ascending else F.col("_bucket").desc()
    before = Window.partitionBy(*groups).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *groups, "_bucket",
        *[F.coalesce(F.sum(f"_s_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in values])
    order = F.col(column).asc() if ascending else F.col(column).desc()
    inside = (Window.partitionBy(*groups, "_bucket").orderBy(order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        join_on(ranged.withColumns({f"_r_{v}": F.sum(v).over(inside) for v in values}),
                broadcast_if_small(offsets), [*groups, "_bucket"])
        .withColumns({f"cum_{v}": F.col(f"_r_{v}") + F.col(f"_o_{v}") for v in values})
        .drop("_bucket", *[f"_r_{v}" for v in values], *[f"_o_{v}" for v in values])
    )


def split_ties(ranged: DataFrame, ties: list[str], buckets: int) -> DataFrame:
    """Add `_part`: ranges that hold more than 4 / buckets of the rows are cut again by (_by, ties).

    The cuts are taken from about 16 sampled rows a part, drawn by a hash of the ties, so they stay few and
    any repeat of the work finds the same ones. Only rows equal in (_by, ties) stay together.
    """
    counts = {r["_bucket"]: r["count"] for r in ranged.groupBy("_bucket").count().collect()}
    total = sum(counts.values())
    heavy = [b for b, n in counts.items() if n * buckets > 4 * total]
    if not heavy:
        return ranged.withColumn("_part", F.lit(0))
    place = F.struct("_by", *ties)
    share = min(1.0, 16 * buckets / total)
    drawn = ranged.filter(F.col("_bucket").isin(heavy) & (F.pmod(F.xxhash64(*ties), F.lit(1 << 30)) < share * (1 << 30)))
    cuts = drawn.groupBy("_bucket").agg(F.array_sort(F.collect_set(place)).alias("_cuts")).select(
        "_bucket", F.expr("filter(_cuts, (c, i) -> i % 16 = 15)").alias("_cuts"))
    below = F.size(F.filter("_cuts", lambda c: c < place))
    return ranged.join(F.broadcast(cut_lineage(cuts)), "_bucket", "left").withColumn(
        "_part", F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(below)).drop("_cuts")


def ranked(df: DataFrame, groups: list[str], column: str | Column, ties: list[str], out: str = "rank",
           bounds: list[float] | None = None, buckets: int | None = None) -> DataFrame:
    """1-based rank by (column, ties) inside every group, plus the group size, from range-local ranks.

    `bounds` cut the order into ranges; for a uniform hash they are known without looking at the data.
    Without them, ranges crowded by one value are cut again by the ties.
    """
    buckets = buckets or n_buckets(df)
    keyed = df.withColumn("_by", F.col(column) if isinstance(column, str) else column)
    if bounds is None:
        ranged = split_ties(bucketed(keyed, "_by", quantile_bounds(keyed, "_by", buckets)), ties, buckets)
    else:
        ranged = bucketed(keyed, "_by", bounds).withColumn("_part", F.lit(0))
    place = [*groups, "_bucket", "_part"]
    sums = cut_lineage(ranged.groupBy(*place).agg(F.count("*").alias("_n")))
    whole = Window.partitionBy(*groups)
    before = whole.orderBy("_bucket", "_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *place,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(whole).alias(f"{out}_of"))
    inside = Window.partitionBy(*place).orderBy("_by", *ties)
    return (
        join_on(ranged.withColumn("_inside", F.row_number().over(inside)), broadcast_if_small(offsets), place)
        .withColumn(out, F.col("_inside") + F.col("_offset"))
        .drop("_by", "_bucket", "_part", "_inside", "_offset")
    )
