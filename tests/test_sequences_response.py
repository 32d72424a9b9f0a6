"""Sequences per host (W2) and block intervals (R2/R3/R4) on hand-made tables."""

from pyspark.sql import functions as F

from flowlens.operators.response import block_intervals, block_intervals_fixed
from flowlens.operators.sequences import build_sequences
from flowlens.schema import FEATURES
from flowlens.settings import Policy


def test_windows_per_host(spark):
    rows = []
    for host, n in (("h1", 1), ("h16", 16), ("h19", 19), ("h20", 20)):
        for i in range(n):
            rows.append((host, i * 1000, i, 1 if (host == "h20" and i == 19) else 0))
    df = spark.createDataFrame(rows, "src_ip string, emit_us long, pos long, label int")
    df = df.select("*", *[F.lit(1.0).alias(f) for f in FEATURES])
    seqs = build_sequences(df, 16, 4, "src_ip", order_cols=["emit_us", "pos"], time_col="emit_us")
    got = {h: sorted((r["start_pos"], r["label"]) for r in seqs.filter(F.col("host") == h).collect())
           for h in ("h1", "h16", "h19", "h20")}
    assert got == {"h1": [(0, 0)], "h16": [(0, 0)], "h19": [(0, 0)], "h20": [(0, 0), (4, 1)]}
    short = seqs.filter(F.col("host") == "h1").first()["window"]
    assert len(short) == 16 and short[-1][0] == 1.0 and short[0][0] == 0.0   # left padding


def _actions(spark, times):
    rows = [("1.2.3.4", t * 1_000_000, i + 1, "block") for i, t in enumerate(times)]
    return spark.createDataFrame(rows, "src_ip string, emit_us long, alert_count long, action_type string")


def test_renewing_and_fixed_blocks(spark):
    acts = _actions(spark, [0, 100, 250, 700, 1000])
    p = Policy(auto_block=True, block_duration_seconds=300)
    iv = sorted((r["blocked_us"] // 1_000_000, r["expires_us"] // 1_000_000, r["renewals"])
                for r in block_intervals(acts, p).collect())
    # 1000 - 700 = 300 s: the block expired exactly then (expires <= now), so a new one starts
    assert iv == [(0, 550, 3), (700, 1000, 1), (1000, 1300, 1)]
    fx = sorted((r["blocked_us"] // 1_000_000, r["expires_us"] // 1_000_000)
                for r in block_intervals_fixed(acts, p).collect())
    assert fx == [(0, 300), (700, 1000), (1000, 1300)]


def test_unblock_command_cuts_interval(spark):
    acts = _actions(spark, [0, 100, 200])
    cmds = spark.createDataFrame([("1.2.3.4", 150 * 1_000_000, "unblock"), ("5.6.7.8", 10 * 1_000_000, "block")],
                                 "ip string, t_us long, command string")
    p = Policy(auto_block=True, block_duration_seconds=300)
    iv = sorted((r["ip"], r["blocked_us"] // 1_000_000, r["expires_us"] // 1_000_000, r["reason"])
                for r in block_intervals(acts, p, cmds).collect())
    assert iv == [("1.2.3.4", 0, 150, "2 alerts"), ("1.2.3.4", 200, 500, "3 alerts"), ("5.6.7.8", 10, 310, "manual")]
