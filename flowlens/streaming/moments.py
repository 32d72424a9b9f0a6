"""Running moments of a key's flows over an array of packets: the numbers of :mod:`.flows`, for many packets at once.

Packets are a structured array (:data:`PACKET`) in the order of time; an open flow comes in and goes out as the state of T1.
Flows are cut by the key-clock rule one after another; the moments at any packet of a flow are differences of sums over the
array, and least and largest values so far, so a packet costs no Python step. All sums are exact.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd

from ..settings import FlowConfig
from .flows import _INT_AGGS, SQUARES

#: A waiting packet; :data:`NONE` stands for a null length or sequence number.
PACKET = np.dtype([("ts_us", "<i8"), ("seq", "<i8"), ("fwd", "?"), ("length", "<i8"), ("header_len", "<i8"), ("tcp_flags", "<i4")])
NONE = np.iinfo(np.int64).min
_FLAGS = (("fin", 1), ("syn", 2), ("rst", 4), ("psh", 8), ("ack", 16), ("urg", 32))


def from_pandas(pdf: pd.DataFrame) -> np.ndarray:
    """Packets of a frame; those without a time are left out, null header lengths and flags are 0."""
    out = np.empty(len(pdf), PACKET)
    for name, null in (("ts_us", NONE), ("seq", NONE), ("fwd", False), ("length", NONE), ("header_len", 0), ("tcp_flags", 0)):
        column = pdf[name]
        out[name] = (column.fillna(null) if column.hasnans else column).to_numpy().astype(PACKET[name])
    return out[out["ts_us"] != NONE]


def in_order(packets: np.ndarray) -> np.ndarray:
    return packets[np.lexsort([packets[c] for c in ("tcp_flags", "header_len", "length", "fwd", "seq", "ts_us")])]


def expiry(first_us: int, last_us: int, cfg: FlowConfig) -> int:
    return min(last_us + cfg.idle_us, first_us + cfg.active_us)


def cut_flows(packets: np.ndarray, tcp: bool, cfg: FlowConfig, s: dict | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, closed by TCP) of each flow; the first one goes on from ``s``, if that is given and hasn't expired."""
    t, flags = packets["ts_us"], packets["tcp_flags"]
    cuts = np.diff(t) >= cfg.idle_us
    rst = (flags & 4 > 0) & tcp
    cut = np.r_[np.flatnonzero(cuts | rst[:-1]) + 1, len(t)]
    fin = np.flatnonzero((flags & 1 > 0) & tcp)
    starts, ends, start = [], [], 0
    while start < len(t):
        own = s if start == 0 else None
        end = int(cut[np.searchsorted(cut, start, "right")])
        second = np.searchsorted(fin, start) + (1 if own is None else 1 - own["c_fin"])
        if tcp and second < len(fin):
            end = min(end, int(fin[second]) + 1)
        first = int(t[start]) if own is None else own["first_us"]
        end = min(end, max(start + 1, int(np.searchsorted(t, first + cfg.active_us))))
        starts.append(start)
        ends.append(end)
        start = end
    start, end = np.array(starts), np.array(ends)
    fins = np.searchsorted(fin, end) - np.searchsorted(fin, start)
    if tcp and s is not None:
        fins[0] += s["c_fin"]
    return start, end, rst[end - 1] | (fins >= 2)


class Moments:
    """The moments of flows at places ``at``, each counted from its flow's start; the first flow goes on from ``s``."""

    def __init__(self, packets: np.ndarray, start: np.ndarray, s: dict | None, at: np.ndarray):
        self.s, self.at = s, at
        self.flow = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(packets)]))
        self.start = start[self.flow]
        self.carried = (self.flow[at] == 0) if s is not None else np.zeros(len(at), bool)
        t, fwd, length = (packets[c] for c in ("ts_us", "fwd", "length"))
        known, every = length != NONE, np.ones(len(t), bool)
        length = np.where(known, length, 0)
        self.columns = out = {"first_us": np.where(self.carried, s["first_us"] if s else 0, t[self.start[at]]), "last_us": t[at]}
        out["n"], out["nf"] = self.sum(every, "n"), self.sum(fwd, "nf")
        for side, mine in (("f", fwd), ("b", ~fwd)):
            out[f"b{side}"], out[f"h{side}"] = self.sum(length * mine, f"b{side}"), self.sum(packets["header_len"] * mine, f"h{side}")
            out[f"s{side}2"] = self.sum(length * length * mine, f"s{side}2")
        index = np.arange(len(t))
        for side, mine in (("a", every), ("f", fwd), ("b", ~fwd)):
            out[f"{side}max"], out[f"{side}min"] = self.most(length, mine & known, f"{side}max"), self.least(length, mine & known, f"{side}min")
            # the packet before, of the same direction
            last = np.maximum.accumulate(np.where(mine, index, -1))
            before = np.r_[-1, last[:-1]]
            held = s[{"a": "last_us", "f": "lf_us", "b": "lb_us"}[side]] if s is not None else None
            gap = np.where(before >= self.start, t - t[before], 0 if held is None else t - (held or 0))
            there = mine & ((before >= self.start) | ((self.flow == 0) & (held is not None)))
            gap = np.where(there, gap, 0)
            wide = gap.astype(float)
            squares = gap * gap if float(wide @ wide) < 4e18 else gap.astype(object) ** 2
            out[f"g{side}_n"], out[f"g{side}_s"], out[f"g{side}_s2"] = (
                self.sum(there, f"g{side}_n"), self.sum(gap, f"g{side}_s"), self.sum(squares, f"g{side}_s2"))
            out[f"g{side}_max"], out[f"g{side}_min"] = self.most(gap, there, f"g{side}_max"), self.least(gap, there, f"g{side}_min")
            if side != "a":
                mine_at = last[at] >= self.start[at]
                out[f"l{side}_us"] = self._null(np.where(mine_at, t[last[at]], held or 0), ~mine_at & ~(self.carried & (held is not None)))
        for name, bit in _FLAGS:
            out[f"c_{name}"] = self.sum((packets["tcp_flags"] & bit) > 0, f"c_{name}")

    def sum(self, x: np.ndarray, name: str) -> np.ndarray:
        x = x if x.dtype == object else x.astype(np.int64)
        total = np.concatenate([np.zeros(1, x.dtype), np.cumsum(x)])
        out = total[self.at + 1] - total[self.start[self.at]]
        if self.s is None:
            return out
        carry = int(self.s[name])
        if out.dtype != object and abs(carry) > 1 << 62:
            out = out.astype(object)
        return out + np.where(self.carried, carry, 0)

    @staticmethod
    def _null(x: np.ndarray, null: np.ndarray):
        return pd.arrays.IntegerArray(x.astype(np.int64), null) if null.any() else x

    def most(self, x: np.ndarray, of: np.ndarray, name: str, sign: int = 1):
        """The largest ``x`` so far of the packets ``of`` a flow; null where there is none."""
        held = self.s[name] if self.s is not None else None
        if of.any():
            x = x * sign
            low = int(x[of].min()) - 1
            v = np.where(of, x - low, 0)
            step = int(v.max()) + 1
            if len(v) and step * (int(self.flow[-1]) + 1) < 1 << 62:  # each flow's numbers are above those of the flows before
                out = np.maximum.accumulate(v + self.flow * step)[self.at] - self.flow[self.at] * step
            else:
                first = np.flatnonzero(np.r_[True, np.diff(self.flow) > 0])
                out = np.concatenate([np.maximum.accumulate(p) for p in np.split(v, first[1:])])[self.at]
            null, out = out == 0, out + low
        else:
            null, out = np.ones(len(self.at), bool), np.zeros(len(self.at), np.int64)
        if held is not None:
            out = np.where(self.carried, np.where(null, held * sign, np.maximum(out, held * sign)), out)
            null = null & ~self.carried
        return self._null(out * sign, null)

    def least(self, x: np.ndarray, of: np.ndarray, name: str):
        return self.most(x, of, name, -1)

    def state(self, i: int) -> dict:
        """The moments at the place ``at[i]`` as the state of an open flow."""
        s = {k: None if (v := c[i]) is pd.NA else int(v) for k, c in self.columns.items()}
        return s | {k: Decimal(s[k]) for k in SQUARES}

    def rows(self, stop: int) -> dict:
        """Columns of the first ``stop`` places."""
        return {k: [Decimal(int(x)) for x in self.columns[k][:stop]] if k in SQUARES else self.columns[k][:stop] for k in _INT_AGGS}
