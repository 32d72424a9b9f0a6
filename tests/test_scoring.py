"""Verdict mix at sf0.01 (FIXTURES.md) and the verdict truth table."""

import itertools

from pyspark.sql import functions as F

from flowlens.operators.scoring import with_verdict
from flowlens.plans import context as C

from conftest import SF01


def test_verdict_mix_matches_fixture_expectation(spark):
    e = C.events(spark, SF01)
    got = {(r["capture_id"], r["status"]): r["count"] for r in e.groupBy("capture_id", "status").count().collect()}
    assert got == {("normal", "NORMAL"): 574, ("normal", "SUSPICIOUS"): 77, ("portscan", "SUSPICIOUS"): 633,
                   ("portscan", "ATTACK"): 9, ("slowdos", "ATTACK"): 6, ("synflood", "ATTACK"): 1,
                   ("udpflood", "SUSPICIOUS"): 1}


def test_threat_separation(spark):
    e = C.events(spark, SF01)
    m = {r["label"]: r["m"] for r in e.groupBy("label").agg(F.avg("threat_score").alias("m")).collect()}
    assert m[1] > m[0]


def test_truth_table(spark):
    levels = {"null": None, "low": 0.1, "mid": 0.7, "high": 0.95}
    rows = []
    for (rn, r), (an, a), (cn, c), padded in itertools.product(levels.items(), levels.items(), levels.items(),
                                                               (True, False)):
        hist = 5 if padded else 16
        rows.append((rn, an, cn, padded, r, None if a is None else a / 10, c, hist))
    df = spark.createDataFrame(rows, "rn string, an string, cn string, pad boolean, routine_score double, "
                                     "anomaly_score double, ctx_raw double, history_len int")
    out = {(r["rn"], r["an"], r["cn"], r["pad"]): r for r in with_verdict(df).collect()}

    def expect(r, a, c, pad):
        needs = (r is not None and r >= 0.6) or (a is not None and a >= 0.05)
        ctx = c if needs else None
        if ctx is not None and ctx >= 0.5:
            return "SUSPICIOUS" if pad else "ATTACK"
        xa, xs, an = r is not None and r >= 0.85, r is not None and r >= 0.6, a is not None and a >= 0.05
        if xa:
            return "ATTACK"
        if an or xs:
            return "SUSPICIOUS"
        if r is None and a is None and ctx is None:
            return "UNKNOWN"
        return "NORMAL"

    for (rn, an, cn, pad), row in out.items():
        r, a, c = levels[rn], levels[an], levels[cn]
        assert row["status"] == expect(r, None if a is None else a / 10, c, pad), (rn, an, cn, pad)
        cands = [x for x in (r, c if row["context_score"] is not None else None,
                             None if a is None else min(a / 10 / 0.1, 1.0)) if x is not None]
        assert abs(row["threat_score"] - round(max(cands) if cands else 0.0, 4)) < 1e-9
