"""The ordered stream's processor without Spark: arrays of packets against packets applied one by one, and how state is held."""

import random
from decimal import Decimal
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest

from flowlens.settings import FlowConfig
from flowlens.streaming.flows import _INT_AGGS, BASE_US, _add, _new
from flowlens.streaming.ordered import FlowProcessor

COLUMNS = ["ts_us", "seq", "fwd", "length", "header_len", "tcp_flags"]


class Held:
    """A value or list of a key's state; ``written``: values given to it so far."""

    def __init__(self):
        self.value, self.written = None, 0

    def exists(self):
        return self.value is not None

    def get(self):
        return iter(self.value) if isinstance(self.value, list) else self.value

    def put(self, values):
        self.value, self.written = list(values), self.written + len(values)

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


def processor(cfg, reorder, interim):
    p = FlowProcessor(cfg, reorder, interim)
    p.init(SimpleNamespace(getValueState=lambda *a: Held(), getListState=lambda *a: Held(),
                           registerTimer=lambda at: None, deleteTimer=lambda at: None))
    return p


def one_by_one(packets, tcp, cfg):
    """Rows of all packets of a key in the order of time, and of the flow that is left open."""
    rows, s = [], None
    due = lambda s: min(s["last_us"] + cfg.idle_us, s["first_us"] + cfg.active_us)
    row = lambda s, reason, at: (*[s[k] for k in _INT_AGGS], at, reason)
    expired = lambda s: row(s, "idle" if s["last_us"] + cfg.idle_us <= s["first_us"] + cfg.active_us else "active", due(s))
    for t, _, fwd, length, header, flags in sorted(packets):
        if s is not None and t >= due(s):
            rows.append(expired(s))
            s = None
        s = _new(t) if s is None else s
        _add(s, t, fwd, length, header, flags)
        if tcp and (s["c_rst"] > 0 or s["c_fin"] >= 2):
            rows.append(row(s, "tcp_close", s["last_us"]))
            s = None
        elif s["n"] >= cfg.interim_min_packets and (s["n"] - cfg.interim_min_packets) % cfg.interim_step == 0:
            rows.append(row(s, None, s["last_us"]))
    return rows + ([expired(s)] if s is not None else [])


def run(p, proto, batches, watermarks):
    out = []
    for batch, wm in zip(batches, watermarks, strict=True):
        frame = pd.DataFrame(batch, columns=COLUMNS)
        times = SimpleNamespace(getCurrentWatermarkInMs=lambda wm=wm: (BASE_US + wm) // 1000)
        key = ("c", "10.0.0.1", 1, "10.0.0.2", 2, proto)
        frames = p.handleInputRows(key, iter([frame[:3], frame[3:]]), times) if batch else p.handleExpiredTimer(key, times, None)
        for f in frames:
            values = [[None if v is pd.NA else int(v) for v in f[c].tolist()] for c in [*_INT_AGGS, "emit_us"]]
            out += zip(*values, f["close_reason"].tolist(), strict=True)
            assert (f["final"] == f["close_reason"].notna()).all()
    return out


@pytest.mark.parametrize("seed", range(40))
def test_arrays_of_packets_are_packets_one_by_one(seed):
    r = random.Random(seed)
    cfg = FlowConfig(idle_s=r.choice([2, 15, 4000]), active_s=r.choice([5, 60, 9_000_000]))
    wide, t, packets = r.choice([3_000_000, 200, 5_000_000_000]), 0, []
    for k in range(r.choice([5, 400])):
        t += r.randrange(wide) if r.random() < 0.9 else 0
        packets.append((t, k, r.random() < r.choice([0, 0.5, 1]), r.randrange(1500), r.choice([28, 40]), r.choice([0, 2, 16, 16, 24, 17, 20, 63])))
    packets[-1] = (*packets[-1][:5], 16)
    proto, end = r.choice([6, 17]), t + 10 * (cfg.active_us + wide)
    # each packet arrives late by up to ``delay``; a batch's watermark is that of what came before it
    delay = 5 * wide
    arrived = sorted((p[0] + r.randrange(delay), p) for p in packets)
    size = r.choice([1, 7, 100])
    batches = [[p for _, p in arrived[i:i + size]] for i in range(0, len(arrived), size)]
    marks = [0] + [(max(p[0] for b in batches[:i + 1] for p in b) - delay) // 1000 * 1000 for i in range(len(batches) - 1)]
    got = run(processor(cfg, True, True), proto, [*batches, [], []], [*np.maximum(marks, 0).tolist(), t // 1000 * 1000 + 1000, end])
    want = one_by_one(packets, proto == 6, cfg)
    key = lambda x: tuple((v is None, v or 0) if not isinstance(v, str) else (False, v) for v in (x[-2], x[-1] or "", *x[:-2]))
    assert sorted(got, key=key) == sorted((tuple(int(v) if isinstance(v, Decimal) else v for v in row) for row in want), key=key)


def test_waiting_packets_are_few_values():
    """A key's packets that wait are held as parts of many packets, not one value each."""
    p = processor(FlowConfig(), True, True)
    packets = [(k * 100, k, k % 3 > 0, 60, 40, 16) for k in range(50_000)]
    assert run(p, 6, [packets], [0]) == []
    assert p.waiting.written <= 8
    got = run(p, 6, [[]], [600_000_000])
    assert len(got) == len(one_by_one(packets, True, FlowConfig())) > 8_000 and not p.waiting.exists()


def test_state_partitions_follow_the_rows(spark):
    from flowlens.streaming.ordered import STATE_ROWS, rocksdb_state, state_partitions

    key, before = "spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(key, "200")
    try:
        cores = spark.sparkContext.defaultParallelism
        assert [state_partitions(spark, n) for n in (0, 1000, 40 * STATE_ROWS, 4000 * STATE_ROWS)] == [cores, cores, 40, 200]
        with rocksdb_state(spark, 7):
            assert spark.conf.get(key) == "7"
        assert spark.conf.get(key) == "200"
    finally:
        spark.conf.set(key, before)
