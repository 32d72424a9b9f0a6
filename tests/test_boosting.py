"""Boosted trees: against a brute force over all cuts, with and without the L2 term; saved, read back and scored with."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.operators import boosting as B
from flowlens.operators import models as MD
from flowlens.operators.blocks import merged
from flowlens.operators.evaluation import roc_auc
from flowlens.plans import context as C
from flowlens.session import ensure_checkpoint_dir
from flowlens.streaming.replay import work_dir

from conftest import SF001

NAMES = ("f0", "f1", "f2", "f3")


def brute(x, y, w, rounds, depth, step, lam, least):
    """Margins of the rows: every cut at every value of every column, in plain loops."""
    margin = np.zeros(len(x))

    def grow(idx, g, h, level):
        G, H = g[idx].sum(), h[idx].sum()
        best = None
        if level < depth:
            for f in range(x.shape[1]):
                for c in np.unique(x[:, f])[:-1]:
                    left, right = idx[x[idx, f] <= c], idx[x[idx, f] > c]
                    hl, hr = h[left].sum(), h[right].sum()
                    if not len(left) or not len(right) or hl < least or hr < least:
                        continue
                    gain = g[left].sum() ** 2 / (hl + lam) + g[right].sum() ** 2 / (hr + lam) - G * G / (H + lam)
                    if gain > 1e-9 and (best is None or gain > best[0] * (1 + 1e-12)):
                        best = gain, left, right
        if best is None:
            margin[idx] += -step * G / (H + lam)
        else:
            grow(best[1], g, h, level + 1)
            grow(best[2], g, h, level + 1)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grow(np.arange(len(x)), w * (p - y), w * p * (1 - p), 0)
    return 1 / (1 + np.exp(-margin))


def table(spark, n=120, seed=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, len(NAMES))), 3)
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(n) < 0.1)).astype(int)
    rows = [(*map(float, r), int(t), i) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, ", ".join(f"{f} double" for f in NAMES) + ", label int, row int")
    return x, y, df.repartition(5)


@pytest.mark.parametrize("lam", [0.0, 1.0])
def test_equals_a_brute_force(spark, lam):
    x, y, df = table(spark)
    args = dict(rounds=5, depth=3, step=0.3, reg_lambda=lam, min_weight=1.0)
    model = B.train_boosted(df, **args, subsample=1.0, column_share=1.0, bins=256, features=NAMES)
    got = {r.row: r.routine_score for r in B.boosted_scores(model, df).collect()}
    heavy = (y == 0).sum() / (y == 1).sum()
    want = brute(x, y, np.where(y == 1, heavy, 1.0), 5, 3, 0.3, lam, 1.0)
    assert np.allclose([got[i] for i in range(len(x))], want, atol=1e-9)
    other = brute(x, y, np.where(y == 1, heavy, 1.0), 5, 3, 0.3, 1.0 - lam, 1.0)
    assert np.abs(want - other).max() > 0.01


def test_margins_written_between_rounds_change_nothing(spark, monkeypatch):
    _, _, df = table(spark)
    args = dict(rounds=7, depth=3, step=0.3, bins=32, features=NAMES, subsample=1.0, column_share=0.5)
    whole = B.train_boosted(df, **args)
    monkeypatch.setattr(B, "KEEP", 2)
    cut = B.train_boosted(df, **args)
    a, b = ({r.row: r.routine_score for r in B.boosted_scores(m, df).collect()} for m in (whole, cut))
    assert all(abs(a[k] - b[k]) < 1e-9 for k in a)
    used = [{f for _, f, *_ in t if f >= 0} for t in whole.trees]
    assert all(len(u) <= 2 for u in used) and len(set(map(frozenset, used))) > 1  # columns are drawn for each tree


def test_rounds_scan_no_table(spark, monkeypatch):
    """Rows are written and read as a table once; a level walks its own tree, not those of the rounds before it."""
    _, _, df = table(spark)
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    before, held = set(os.listdir(folder)), len(spark.sparkContext._jsc.getPersistentRDDs())
    monkeypatch.setattr(B, "KEEP", 2)
    model = B.train_boosted(df, rounds=7, depth=3, bins=32, features=NAMES)
    assert len(model.trees) == 7
    assert len([f for f in set(os.listdir(folder)) - before if f.startswith("boost-rows")]) == 1
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == held


def test_small_blocks_are_joined():
    parts = [(np.arange(n), np.ones((n, 2))) for n in (3, 1, 4, 1, 5)]
    out = list(merged(iter(parts), 4))
    assert [len(b[0]) for b in out] == [4, 4, 6] and all(len(b[0]) == len(b[1]) for b in out)
    assert np.concatenate([b[0] for b in out]).tolist() == np.concatenate([b[0] for b in parts]).tolist()


def test_unlike_rows_and_tables(spark):
    _, _, df = table(spark)
    odd = df.withColumn("f1", F.when(F.col("row") % 7 == 0, None).when(F.col("row") % 7 == 1, float("nan")).otherwise(F.col("f1")))
    odd = odd.withColumn("f3", F.lit(2.0)).withColumn("label", F.when(F.col("row") % 11 != 0, F.col("label")))
    odd = odd.withColumn("routine_score", F.lit("x")).withColumn("id", F.lit("clash"))
    model = B.train_boosted(odd, rounds=3, depth=3, features=NAMES)
    rows = B.boosted_scores(model, odd).collect()
    assert len(rows) == 120 and all(0 <= r.routine_score <= 1 for r in rows) and rows[0].id == "clash"
    assert all(f != 3 for t in model.trees for _, f, *_ in t)  # a constant column has no cut
    none = B.train_boosted(df.where("row < 0"), rounds=3, features=NAMES)
    assert none.trees == () and {r.routine_score for r in B.boosted_scores(none, df).collect()} == {0.5}
    one = B.train_boosted(df.where("label = 0"), rounds=2, depth=2, features=NAMES)
    assert all(r.routine_score < 0.5 for r in B.boosted_scores(one, df).collect())


def test_saved_and_scored_with(spark):
    flows = C.flows(spark, SF001)
    train, test = MD.holdout(flows, 0.2, 42, F.concat_ws("|", "capture_id", "a_ip", "a_port", "b_ip", "b_port", "flow_no"))
    model = B.train_boosted(train, rounds=30, depth=4, step=0.2)
    path = work_dir(spark, "test-boosted")
    MD.save_detectors(spark, MD.Detectors(model), path)
    back = MD.read_detectors(spark, path)
    assert back.routine == model
    assert abs(sum(model.importances().values()) - 1) < 1e-9
    scored = MD.score_with_models(flows, C.profile(spark, SF001), back)
    assert scored.count() == flows.count() and scored.where("routine_score < 0 OR routine_score > 1").count() == 0
    gbt = MD.routine_scores(MD.train_routine(train, max_iter=30, max_depth=4), test)
    mine = B.boosted_scores(model, test)
    auc = [roc_auc(s, "label", "routine_score") for s in (mine, gbt)]
    auc = [a if isinstance(a, float) else a.first()[0] for a in auc]
    assert auc[0] >= auc[1] - 0.05
