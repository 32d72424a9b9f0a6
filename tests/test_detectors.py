"""Trained detectors: saved, read back and scored with."""

import os

import numpy as np
from pyspark.sql import functions as F

from flowlens.operators import models as MD
from flowlens.operators.evaluation import roc_auc
from flowlens.operators.networks import AttentionNet, Autoencoder
from flowlens.operators.scoring import EMIT_ORDER
from flowlens.operators.sequences import build_sequences
from flowlens.plans import context as C
from flowlens.schema import FEATURES
from flowlens.streaming.replay import work_dir

from conftest import SF001, SF01


def test_saved_models_reach_the_verdict(spark):
    f = C.flows(spark, SF001)
    prof = C.profile(spark, SF001)
    made = MD.Detectors(MD.train_routine(f, max_iter=3, max_depth=3), MD.train_anomaly(f, 4))
    path = work_dir(spark, "test-detectors")
    MD.save_detectors(spark, made, path)
    health = {r["name"]: r["mode"] for r in MD.load_detectors(spark, path).collect()}
    assert health == {"routine_xgboost": "model", "context_transformer": "surrogate", "zero_day_autoencoder": "model"}
    back = MD.read_detectors(spark, path)
    assert back.anomaly == made.anomaly
    e = MD.score_with_models(f, prof, back)
    assert e.count() == f.count()
    # the verdict takes the models' scores and the threshold saved with the anomaly model
    over = (F.col("routine_score") >= 0.85) & (F.col("anomaly_score") >= made.anomaly.threshold)
    assert e.filter(over & (F.col("status") != "ATTACK") & ~F.col("padded")).count() == 0
    assert e.filter((F.col("anomaly_state") == "ALERT") != (F.col("anomaly_score") >= made.anomaly.threshold)).count() == 0


def test_no_saved_models_take_the_surrogates(spark):
    none = MD.read_detectors(spark, os.path.join(work_dir(spark, "test-none"), "absent"))
    assert none == MD.Detectors(None, None)
    f, prof = C.flows(spark, SF001), C.profile(spark, SF001)
    cols = ["capture_id", "a_ip", "flow_no", "status", "threat_score"]
    a = MD.score_with_models(f, prof, none).select(cols)
    assert a.exceptAll(C.events(spark, SF001).select(cols)).count() == 0


def windows(spark, n, seed):
    """Windows that differ in the order of two rows only: the label is 1 where the first pattern comes first."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x, label = rng.normal(0, 0.3, (16, len(FEATURES))), int(rng.random() < 0.5)
        a, b = sorted(rng.choice(15, 2, replace=False))
        a, b = (a, b) if label else (b, a)
        x[a, :5] += 2
        x[b, 5:10] += 2
        rows.append((f"h{i}", i, x.tolist(), label))
    return spark.createDataFrame(rows, "host string, seq_no int, window array<array<double>>, label int").repartition(4)


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    for net in (AttentionNet(5, 4, 3, 3), Autoencoder(6, 5, 2)):
        theta, n = net.start(1), net.features * getattr(net, "length", 1)
        x, y, w = rng.normal(size=(7, n)), (rng.random(7) < 0.5).astype(float), rng.random(7) + 0.5
        g, step = net.gradient(theta, x, y, w)[1], 1e-6
        for i in range(net.size):
            e = np.zeros(net.size)
            e[i] = step
            diff = (net.gradient(theta + e, x, y, w)[0] - net.gradient(theta - e, x, y, w)[0]) / (2 * step)
            assert abs(diff - g[i]) < 1e-6


def test_attention_sees_the_order(spark):
    train, test = windows(spark, 700, 1), windows(spark, 300, 2)
    model = MD.train_attention(train, rounds=50)
    auc = roc_auc(MD.attention_scores(model, test), "label", "context_score").first()[0]
    pooled = roc_auc(MD.context_scores(MD.train_context(train, max_iter=30), test), "label", "context_score").first()[0]
    assert auc > 0.9 > pooled + 0.2


def test_gradient_sums_do_not_depend_on_partitions(spark):
    data = windows(spark, 60, 3)
    a = MD.train_attention(data.coalesce(1), rounds=3)
    b = MD.train_attention(data.repartition(7), rounds=3)
    assert np.allclose(a.theta, b.theta, atol=1e-8)


def test_autoencoder_reconstructs_better_than_components(spark):
    """Error on held-out normal flows under that of the linear reconstruction it starts from."""
    f = C.flows(spark, SF01)
    train, test = MD.holdout(f, 0.3, 7)
    normal = test.filter("label = 0")
    linear, net = MD.train_anomaly(train, 4), MD.train_autoencoder(train, 4, rounds=60)
    error = [MD.reconstruction_error(normal, m).agg(F.avg("anomaly_error")).first()[0] for m in (linear, net)]
    assert error[1] < error[0] and net.threshold < linear.threshold


def test_three_saved_models_reach_the_verdict(spark):
    f, prof = C.flows(spark, SF001), C.profile(spark, SF001)
    seqs = build_sequences(f, 16, 4, "src_ip")
    made = MD.Detectors(MD.train_routine(f, max_iter=2, max_depth=2), MD.train_autoencoder(f, 4, 8, rounds=3), MD.train_attention(seqs, rounds=3))
    path = work_dir(spark, "test-three")
    MD.save_detectors(spark, made, path)
    assert {r["mode"] for r in MD.load_detectors(spark, path).collect()} == {"model"}
    back = MD.read_detectors(spark, path)
    assert back.anomaly == made.anomaly and back.context == made.context
    e = MD.score_with_models(f, prof, back)
    assert e.count() == f.count()
    # the context score of a flow is the network's on the host's last 16 flows, and only where the gate is open
    scored = [r for r in e.collect()]
    by_host = {}
    for r in sorted(scored, key=lambda r: tuple(r[c] for c in EMIT_ORDER)):
        own = by_host.setdefault(r.src_ip, [])
        own.append([float(r[c]) for c in FEATURES])
        if r.context_score is None:
            assert not r.needs_context or len(own) < 3
            continue
        x = np.zeros((16, len(FEATURES)))
        last = own[-16:]
        x[16 - len(last):] = last
        x = (x - np.array(back.context.mean)) / np.array(back.context.sd)
        assert abs(back.context.net.predict(np.array(back.context.theta), x.reshape(1, -1))[0] - r.context_score) < 1e-9
    assert sum(r.context_score is not None for r in scored) > 20
