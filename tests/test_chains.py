"""Chains of starts over blocks, against plain folds; hot keys and hot sources give what the fold of one task gives."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowlens.operators import assemble, chains
from flowlens.operators.response import block_intervals_fixed
from flowlens.schema import KEY_COLS
from flowlens.settings import DEFAULT_FLOW, Policy
from helpers import ACK, FIN, RST, packets, pk


def fold(rows, width):
    """(t, ref, forced, hit) in order -> indices of the starts."""
    starts, first, hits = [], None, 0
    for k, (_, ref, forced, hit) in enumerate(rows):
        if first is None or forced or hits >= 2 or ref >= rows[first][0] + width:
            starts.append(k)
            first, hits = k, 0
        hits += hit
    return starts


@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 3), st.booleans(), st.integers(0, 1)), min_size=1, max_size=40),
       st.integers(1, 12))
@settings(max_examples=200, deadline=None)
def test_next_start_in_a_block(steps, width):
    t = np.cumsum([s[0] for s in steps])
    ref = np.maximum(t - [s[1] for s in steps], np.r_[-9, t[:-1]])
    forced = np.array([s[2] and s[3] == 1 for s in steps])
    hit = np.array([s[3] for s in steps])
    nxt, _ = chains.block_next(t, ref, forced, hit, width)
    at, found = 0, []
    while at < len(t):
        found.append(at)
        at = int(nxt[at])
    assert found == fold(list(zip(t, ref, forced, hit, strict=True)), width)


@pytest.mark.parametrize("buckets", [1, 7, 60])
def test_mark_starts(spark, buckets):
    """Dense and sparse stretches, equal times, long stretches of forced starts and hits and none, two parts."""
    rng = np.random.default_rng(buckets)
    rows, want = [], []
    for part in (0, 1, 2):
        n = (1500, 700, 1)[part]
        t = np.cumsum(np.r_[rng.integers(0, 3, n // 2), rng.integers(0, 40, n - n // 2)])
        ref = np.maximum(t - rng.integers(0, 5, n), np.r_[-9, t[:-1]])
        forced = rng.random(n) < (0.01, 0, 0)[part]
        hit = ((rng.random(n) < 0.05) & (t % 200 < 60)).astype(int)
        start = set(fold(list(zip(t, ref, forced, hit, strict=True)), 50))
        rows += [(part, int(t[k]), k, int(ref[k]), bool(forced[k]), int(hit[k]), k in start) for k in range(n)]
    df = spark.createDataFrame(rows, "p long, t long, k long, r long, f boolean, h int, want boolean").repartition(5)
    got = chains.mark_starts(df, "p", ["t", "k"], 50, "r", "f", "h", buckets)
    assert got.count() == len(rows) and got.where("is_start <> want").isEmpty()
    plain = chains.mark_starts(df.where("p = 0"), "p", ["t", "k"], 50, buckets=buckets).where("is_start").count()
    assert plain == len(fold([(r[1], r[1], False, 0) for r in rows if r[0] == 0], 50))


def hot_table(spark):
    rng = np.random.default_rng(8)
    rows, ts = [], 0.0
    for k in range(2500):  # one key that never idles for long, FINs in clusters, few resets, both directions
        ts += float(rng.choice([0.001, 0.4, 3.0, 14.9], p=[.3, .4, .28, .02]))
        ends = ("10.0.0.1", "10.0.0.2", 1000, 80) if k % 3 else ("10.0.0.2", "10.0.0.1", 80, 1000)
        flags = RST if k % 611 == 5 else FIN if k % 97 in (3, 9, 40) else ACK
        rows.append(pk(k, ts, *ends, flags=flags))
        if k % 4 == 0:
            rows.append(pk(100000 + k, ts + 0.3, "10.0.0.3", "10.0.0.4", 7, 7, proto=17))
        if k % 11 == 0:
            rows.append(pk(200000 + k, ts + 16.0, "10.0.0.9", f"10.0.1.{k % 7}", 5, 5))
    return packets(spark, rows)


@pytest.mark.parametrize("clock", ["key", "capture"])
def test_hot_keys_equal_the_fold(spark, clock):
    df = hot_table(spark)
    cols = [*KEY_COLS, "seq", "fwd", "flow_no", "gap_all", "gap_dir"]
    want = sorted(map(tuple, assemble.assign_flows(df, clock=clock, hot_rows=None).select(cols).collect()), key=lambda r: r[6])
    got = sorted(map(tuple, assemble.assign_flows(df, clock=clock, hot_rows=500).select(cols).collect()), key=lambda r: r[6])
    assert want == got and max(r[8] for r in want) > 30


def test_no_task_holds_a_hot_key(spark):
    """Packets are dealt by key and block, only the carry tables by key; no block has more than a share of the key."""
    df = hot_table(spark)
    hot = assemble.hot_keys(df, 2000)
    assert hot.count() == 1
    p = assemble.with_flow_key(df).withColumns({"fin_bit": F.lit(0), "rst_bit": F.lit(0), "_hot": F.lit(0).cast("long")})
    plan = assemble.spread_keys(p, DEFAULT_FLOW, "key")._jdf.queryExecution().executedPlan().toString().split("\n")
    dealt = [k for k, line in enumerate(plan) if "Exchange hashpartitioning" in line]
    by_key = [k for k in dealt if "_bkt" not in plan[k] and "_k" not in plan[k]]
    assert len(dealt) > len(by_key) and all("Aggregate" in " ".join(plan[k + 1:k + 5]) for k in by_key), "\n".join(plan)  # carry tables
    splits = chains.bucket_splits(df, "ts_us", 32)
    size = chains.with_bucket(df.where("src_port = 1000"), "ts_us", splits).groupBy("_bkt").count().agg(F.max("count")).first()[0]
    assert size < 2500 / 32 * 4


def test_hot_sources_equal_the_fold(spark):
    rng = np.random.default_rng(3)
    rows = [(f"10.0.0.{k % 9 // 4}", int(t), k, "block") for k, t in enumerate(np.cumsum(rng.integers(0, 90_000_000, 1200)))]
    acts = spark.createDataFrame(rows, "src_ip string, emit_us long, alert_count long, action_type string")
    p = Policy(block_duration_seconds=300)
    want = sorted(map(tuple, block_intervals_fixed(acts, p, hot_rows=None).collect()))
    assert want == sorted(map(tuple, block_intervals_fixed(acts, p, hot_rows=200).collect())) and len(want) > 50
