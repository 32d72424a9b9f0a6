"""Hot-key-safe window helpers equal plain windows."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowlens.operators.windows import (exact_quantiles, global_rank, last_before, running_sum, size_buckets,
                                        sliding_frame)


def _df(spark):
    rows = [(h, t, float((t * 7) % 13), (None if t % 3 else t)) for h in ("a", "b") for t in range(0, 200)]
    return spark.createDataFrame(rows, "h string, t long, x double, v long")


def test_running_sum_and_rank(spark):
    df = _df(spark)
    got = running_sum(df, ["h"], ["t"], "x", "rs", time_col="t", bucket_us=7)
    got = global_rank(got, ["h"], ["t"], "rk", time_col="t", bucket_us=11)
    w = Window.partitionBy("h").orderBy("t")
    ref = df.select("h", "t", F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("rs"),
                    F.row_number().over(w).alias("rk"))
    a = got.select("h", "t", F.col("rs").cast("double").alias("rs"), F.col("rk").cast("long").alias("rk"))
    assert a.exceptAll(ref.select("h", "t", F.col("rs").cast("double"), F.col("rk").cast("long"))).count() == 0


def test_sliding_frame_with_tiny_chunks(spark):
    df = _df(spark)
    got = sliding_frame(df, ["h"], ["t"], 16, {"m": F.avg("x"), "n": F.count("x")}, time_col="t",
                        bucket_us=5, chunk_rows=17)
    w = Window.partitionBy("h").orderBy("t").rowsBetween(-15, 0)
    ref = df.select("h", "t", F.avg("x").over(w).alias("m"), F.count("x").over(w).alias("n"))
    assert got.select("h", "t", "m", "n").exceptAll(ref).count() == 0


def test_last_before(spark):
    df = _df(spark)
    got = last_before(df, ["h"], ["t"], {"lv": F.col("v")}, "t", bucket_us=4)
    w = Window.partitionBy("h").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    ref = df.select("h", "t", F.last("v", ignorenulls=True).over(w).alias("lv"))
    assert got.select("h", "t", "lv").exceptAll(ref).count() == 0


def test_exact_quantiles_match_numpy(spark):
    xs = [float(v) for v in np.random.default_rng(3).normal(size=501).round(2)] + [1.0] * 50
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = {r["p"]: r["value"] for r in exact_quantiles(df, "x", [0.25, 0.5, 0.99]).collect()}
    for p in (0.25, 0.5, 0.99):
        assert abs(got[p] - float(np.quantile(xs, p))) < 1e-9


def test_one_hour_of_one_host_uses_many_tasks(spark):
    df = spark.range(4000).select(F.lit("h").alias("h"), (F.col("id") * 10).alias("t"))
    sizes = [r["count"] for r in size_buckets(df, "t", 16).groupBy("h", "_bkt").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 500
    got = global_rank(df, ["h"], ["t"], "rk", total="n")
    assert got.filter((F.col("rk") != F.col("t") / 10 + 1) | (F.col("n") != 4000)).count() == 0


def test_size_buckets_keep_null_nan_ties_and_empty(spark):
    xs = [None, float("nan"), float("-inf"), float("inf"), 1.0, 1.0, 2.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = size_buckets(df, "x", 4).orderBy("x").collect()
    assert [r._bkt for r in got] == sorted(r._bkt for r in got) and len(got) == len(xs)
    assert size_buckets(df.limit(0), "x", 4).count() == 0


def test_exact_quantiles_by_group(spark):
    rng = np.random.default_rng(5)
    rows = [("small", float(v)) for v in rng.random(300)] + [("big", float(v)) for v in rng.normal(size=77) * 1e9]
    df = spark.createDataFrame([*rows, ("one", 3.0), ("none", None)], "g string, x double")
    got = {(r["g"], r["p"]): r["value"] for r in exact_quantiles(df, "x", [0.0, 0.3, 1.0], "g").collect()}
    assert len(got) == 9
    for g in ("small", "big"):
        xs = [x for k, x in rows if k == g]
        for p in (0.0, 0.3, 1.0):
            assert np.isclose(got[g, p], np.quantile(xs, p), rtol=1e-12)
    assert got["one", 0.3] == 3.0
