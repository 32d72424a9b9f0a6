"""Scalar column functions (P3, P4, P6) and settings updates."""

import math

from pyspark.sql import functions as F

from flowlens.functions.scalar import finite, protocol_name, to_number
from flowlens.settings import Policy, Thresholds


def test_threshold_updates_ignore_unknown_and_bad_values():
    t = Thresholds().updated(xgb_attack="0.9", transformer="high", bogus=1)
    assert t.xgb_attack == 0.9 and t.transformer == 0.5 and not hasattr(t, "bogus")
    p = Policy().updated(block_threshold=3, nope=True)
    assert p.block_threshold == 3 and p.dry_run is True


def test_protocol_name(spark):
    vals = ["6", "17", " 1 ", "6.7", "47", "abc", None, "nan"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in df.select(protocol_name(F.col("v"))).collect()]
    assert got == ["TCP", "UDP", "ICMP", "TCP", "47", "ip", "ip", "ip"]


def test_to_number(spark):
    vals = [" 0x1F ", "0x", "0xzz", "1,5", "nan", "None", "", None, "abc", "1e3", "inf", "-2.25"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in df.select(to_number(F.col("v"))).collect()]
    assert got == [31.0, 0.0, 0.0, 1.5, 0.0, 0.0, 0.0, 0.0, 0.0, 1000.0, 0.0, -2.25]


def test_finite(spark):
    df = spark.createDataFrame([(1.5,), (math.nan,), (math.inf,), (-math.inf,), (None,)], "x double")
    assert [r[0] for r in df.select(finite("x")).collect()] == [1.5, 0.0, 0.0, 0.0, 0.0]


def test_sql_functions_equal_the_columns(spark):
    from pyspark.sql import functions as F

    from flowlens.functions.scalar import finite, protocol_name, to_number
    from flowlens.functions.sql import register_functions

    register_functions(spark)
    texts = [None, "", " ", "6", " 17 ", "1.9", "-3", "abc", "NaN", "none", "null", "inf", "-Infinity", "0x1F", "0XfF", "0xg", "0x", "1,5",
             "1e3", "1,2,3", "255", "0", "99999999999999999999", "0xffffffffffffffff", "1e400"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    small = df.where("t IS NULL OR t NOT IN ('99999999999999999999', '0xffffffffffffffff')")
    for name, own, rows in (("protocol_name", protocol_name, small), ("text_number", to_number, df)):
        both = rows.select(own(F.col("t")).alias("a"), F.expr(f"{name}(t)").alias("b"))
        assert both.where("NOT (a <=> b)").isEmpty(), both.collect()
    x = spark.createDataFrame([(v,) for v in (None, 1.5, float("nan"), float("inf"), -0.0)], "x double")
    assert x.select(finite(F.col("x")).alias("a"), F.expr("finite_number(x)").alias("b")).where("NOT (a <=> b)").isEmpty()
    assert spark.sql("SELECT protocol_name(17), protocol_name('x'), text_number('0x10')").first()[:] == ("UDP", "ip", 16.0)
