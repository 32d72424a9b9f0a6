"""Plan shape: exchanges of the flow pipeline, no single-partition steps."""

import re

from flowlens.operators.assemble import assign_flows
from flowlens.operators import windows
from flowlens.operators.features import flow_features
from flowlens.operators.flows import build_flows
from flowlens.operators.response import block_intervals, with_action
from flowlens.operators.scoring import score_flows
from flowlens.operators.sequences import build_sequences
from flowlens.plans import context as C
from flowlens.sources.fixtures import manifest_from_packets, read_packets

from conftest import SF001


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_flow_features_exchanges(spark):
    plan = _plan(flow_features(assign_flows(read_packets(spark, SF001))))
    exchanges = re.findall(r"Exchange (\w+)", plan)
    # one hash exchange of packets on the key, one of per-flow partial aggregates
    assert exchanges.count("hashpartitioning") == 2, exchanges
    assert "SinglePartition" not in plan
    assert "MapInArrow" in plan and "HashAggregate" in plan


def test_scan_prunes_columns(spark):
    plan = _plan(assign_flows(read_packets(spark, SF001)))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert "user_id" in schema and "event_type" in schema   # only the columns the view needs


def test_scoring_has_no_single_partition(spark):
    plan = _plan(score_flows(C.flows(spark, SF001), C.profile(spark, SF001)))
    assert "SinglePartition" not in plan


def test_uncached_chains_fold_flows_once(spark, monkeypatch):
    written = []
    whole = windows.materialised

    def recorded(df, name):
        written.append(_plan(df))
        return whole(df, name)

    monkeypatch.setattr(windows, "materialised", recorded)
    packets = read_packets(spark, SF001).filter("seq >= 0")   # not the plan that other tests persist
    flows = build_flows(packets, manifest=manifest_from_packets(packets))
    prof = C.profile(spark, SF001)
    for build in (lambda: with_action(score_flows(flows, prof)),
                  lambda: block_intervals(with_action(score_flows(flows, prof))),
                  lambda: build_sequences(flows)):
        written.clear()
        plans = [_plan(build()), *written]
        assert sum(p.count("MapInArrow") for p in plans) == 1
