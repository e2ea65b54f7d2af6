"""Sketch profiles: estimates near the exact counts, increments merge to the whole, nulls and empty tables."""
from pyspark.sql import functions as F

from credence.operators import profile as P


def frame(spark):
    rows = [(i, f"v{i % 20000}", None if i % 7 else "x", None) for i in range(30000)]
    return spark.createDataFrame(rows, "id long, many string, few string, nothing string")


def test_estimates_and_samples(spark):
    df = frame(spark)
    got = {r.column_name: r for r in P.profile_sketches(df, ["many", "few", "nothing"], k=20).collect()}
    est = {c: r for c, r in ((r.column_name, r) for r in P.profile_report(P.profile_sketches(df, ["many", "few", "nothing"])).collect())}
    assert abs(est["many"].n_distinct - 20000) <= 0.02 * 20000
    assert est["few"].n_distinct == 2 and est["few"].n_null == 30000 - len(range(0, 30000, 7))
    assert est["nothing"].n_distinct == 1 and est["nothing"].samples == "" and est["nothing"].n_rows == 30000
    # the sample is exactly the 20 distinct values of smallest hash
    want = (df.select(F.col("many").alias("value")).distinct().withColumn("h", F.xxhash64("value"))
            .orderBy("h", "value").limit(20).collect())
    assert [(s.h, s.value) for s in got["many"].samples] == [(r.h, r.value) for r in want]


def test_increments_merge_to_the_whole(spark):
    df = frame(spark)
    whole = {r.column_name: r for r in P.profile_report(P.profile_sketches(df, ["many", "few"])).collect()}
    parts = [P.profile_sketches(df.where(F.col("id") < 9000), ["many", "few"]),
             P.profile_sketches(df.where(F.col("id") >= 9000), ["many", "few"])]
    merged = {r.column_name: r for r in P.profile_report(P.merge_profiles(parts[0].unionByName(parts[1]))).collect()}
    for c in ("many", "few"):
        assert merged[c].samples == whole[c].samples and merged[c].n_rows == whole[c].n_rows
        assert merged[c].n_null == whole[c].n_null and abs(merged[c].n_distinct - whole[c].n_distinct) <= 0.005 * whole[c].n_distinct


def test_empty_table(spark):
    empty = spark.createDataFrame([], "a string")
    assert P.profile_sketches(empty, ["a"]).count() == 0
