"""Property test: Spark flow assignment equals a plain packet-by-packet
simulation of the flow rules on random small captures, for both clocks."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from flowlens.operators.assemble import assign_flows

from helpers import ACK, FIN, RST, SYN, packets

IDLE, ACTIVE = 15_000_000, 120_000_000
GAPS_US = [0, 1, 500_000, 5_000_000, 14_999_999, 15_000_000, 15_000_001, 60_000_000, 119_999_999, 120_000_000]
ENDPOINTS = [("10.0.0.1", 1000, "10.0.0.2", 80, 6), ("10.0.0.2", 80, "10.0.0.1", 1000, 6),
             ("10.0.0.3", 53, "10.0.0.1", 5353, 17), ("9.9.9.9", 22, "10.10.2.10", 40000, 6)]


def _key(src, sport, dst, dport, proto):
    a, b = (src, sport), (dst, dport)
    lo, hi = (a, b) if a <= b else (b, a)
    return (lo[0], lo[1], hi[0], hi[1], proto)


def simulate(rows, clock):
    """rows: (seq, ts, src, sport, dst, dport, proto, flags) -> {seq: flow id}."""
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    out, open_flows, counter = {}, {}, [0]

    def new_flow(k, t):
        counter[0] += 1
        open_flows[k] = {"id": counter[0], "first": t, "last": t, "fin": 0, "closed": False}

    prev = None
    for seq, t, src, sport, dst, dport, proto, flags in rows:
        k = _key(src, sport, dst, dport, proto)
        f = open_flows.get(k)
        if clock == "key":
            if f is None or f["closed"] or t - f["last"] >= IDLE or t - f["first"] >= ACTIVE:
                new_flow(k, t)
        else:
            # the tracker: a flow swept at the previous packet's time is gone
            if f is not None and prev is not None and (f["closed"] or prev - f["last"] >= IDLE
                                                       or prev - f["first"] >= ACTIVE):
                f = None
            if f is None:
                new_flow(k, t)
        f = open_flows[k]
        f["last"] = t
        f["fin"] += 1 if flags & FIN else 0
        if proto == 6 and (flags & RST or f["fin"] >= 2):
            f["closed"] = True
        if clock == "capture" and t - f["first"] >= ACTIVE:
            f["closed"] = True
        out[seq] = f["id"]
        prev = t
    return out


packet_lists = st.lists(
    st.tuples(st.sampled_from(GAPS_US), st.sampled_from(range(len(ENDPOINTS))),
              st.sampled_from([ACK, ACK, ACK | FIN, RST, SYN])),
    min_size=1, max_size=30)


def _partition(mapping):
    groups = {}
    for seq, fid in mapping.items():
        groups.setdefault(fid, set()).add(seq)
    return sorted(tuple(sorted(g)) for g in groups.values())


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(packet_lists, st.sampled_from(["key", "capture"]))
def test_assignment_matches_simulation(spark, draws, clock):
    t, rows, table = 0, [], []
    for i, (gap, e, flags) in enumerate(draws):
        t += gap
        src, sport, dst, dport, proto = ENDPOINTS[e]
        fl = flags if proto == 6 else 0
        rows.append((i, t, src, sport, dst, dport, proto, fl))
        table.append((i, "c", t, 100, proto, src, dst, sport, dport, 40, fl))
    fp = assign_flows(packets(spark, table), clock=clock)
    got = {}
    for r in fp.select("seq", "a_ip", "a_port", "b_ip", "b_port", "proto", "flow_no").collect():
        got[r["seq"]] = (r["a_ip"], r["a_port"], r["b_ip"], r["b_port"], r["proto"], r["flow_no"])
    assert _partition(got) == _partition(simulate(rows, clock))
