"""Shared inputs for registered queries: packets, flows, profile, events.

Flows, events, actions and block intervals are written once per session, scale
and clock to the shared folder, as tables that later queries scan: each reads
its own columns only, the number of files follows the size of the data and not
the number of shuffle partitions, and a lost executor re-reads files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.flows import build_flows
from ..operators.profile import Profile, fit_profile
from ..operators.scoring import score_flows
from ..session import materialised
from ..settings import DEFAULT_FLOW, DEFAULT_THRESHOLDS
from ..sources.fixtures import manifest_from_packets, read_packets

_CACHE: dict[tuple, object] = {}


def _key(spark: SparkSession, sf_dir: str, *extra) -> tuple:
    return (id(spark), spark.sparkContext.applicationId, sf_dir, *extra)


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_packets(spark, sf_dir)


def flows(spark: SparkSession, sf_dir: str, clock: str = "key") -> DataFrame:
    k = _key(spark, sf_dir, "flows", clock)
    if k not in _CACHE:
        p = read_packets(spark, sf_dir)
        _CACHE[k] = materialised(build_flows(p, DEFAULT_FLOW, clock, manifest_from_packets(p)), "flows")
    return _CACHE[k]


def profile(spark: SparkSession, sf_dir: str, clock: str = "key") -> Profile:
    k = _key(spark, sf_dir, "profile", clock)
    if k not in _CACHE:
        _CACHE[k] = fit_profile(flows(spark, sf_dir, clock))
    return _CACHE[k]


def events(spark: SparkSession, sf_dir: str, clock: str = "key") -> DataFrame:
    """Scored flows (finals), the events table of the analytics queries.

    Later operators scan the table instead of re-planning the scoring chain.
    """
    k = _key(spark, sf_dir, "events", clock)
    if k not in _CACHE:
        scored = score_flows(flows(spark, sf_dir, clock), profile(spark, sf_dir, clock),
                             DEFAULT_THRESHOLDS, DEFAULT_FLOW)
        _CACHE[k] = materialised(scored, "events")
    return _CACHE[k]


def actions(spark: SparkSession, sf_dir: str, policy, clock: str = "key") -> DataFrame:
    """Events with the R1 action columns (a table for each policy)."""
    from ..operators.response import with_action

    k = _key(spark, sf_dir, "actions", clock, policy)
    if k not in _CACHE:
        _CACHE[k] = materialised(with_action(events(spark, sf_dir, clock), policy), "actions")
    return _CACHE[k]


def clear() -> None:
    _CACHE.clear()


def block_intervals(spark: SparkSession, sf_dir: str, policy, clock: str = "key") -> DataFrame:
    """R2 intervals for a policy (a table: read by the interval join J2 and the as-of lookup)."""
    from ..operators.response import block_intervals as build

    k = _key(spark, sf_dir, "intervals", clock, policy)
    if k not in _CACHE:
        _CACHE[k] = materialised(build(actions(spark, sf_dir, policy, clock), policy), "intervals")
    return _CACHE[k]
