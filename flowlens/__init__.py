"""Spark-native network-flow assembly, scoring and analytics.

Typical use::

    from flowlens import build_flows, fit_profile, score_flows, top_sources
    flows = build_flows(packets, manifest=manifest)
    events = score_flows(flows, fit_profile(flows))
    top_sources(events).show()
"""

from .operators.analytics import alert_feed, status_summary, throughput, top_sources
from .operators.assemble import assign_flows
from .operators.features import flow_features
from .operators.flows import build_flows, label_flows
from .operators.profile import fit_profile, profile_table
from .operators.response import block_intervals, flag_blocked, with_action
from .operators.scoring import score_flows, score_table
from .settings import FlowConfig, Policy, Thresholds

__all__ = ["alert_feed", "assign_flows", "block_intervals", "build_flows", "fit_profile", "flag_blocked",
           "flow_features", "label_flows", "profile_table", "score_flows", "score_table", "status_summary",
           "throughput", "top_sources", "with_action", "FlowConfig", "Policy", "Thresholds"]
