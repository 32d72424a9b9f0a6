"""Registered queries vs their DuckDB oracle SQL at sf0.001."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF001

NAMES = ["packets_keyed", "flow_split_key", "flow_split_capture", "flow_features", "flow_features_capture",
         "flow_close", "flow_close_capture", "labelled_flows", "normal_profile", "surrogate_scores", "verdicts",
         "host_context", "status_summary", "recent_rate", "by_protocol", "barrier_alerts", "top_sources",
         "alert_feed", "host_latest", "throughput", "status_by_minute", "separation", "response_actions",
         "block_intervals", "block_commands", "block_fixed", "flag_blocked", "interim_flows", "dq_missing",
         "dq_duplicates", "dq_describe", "dq_cardinality", "dq_correlated_pairs", "merge_flows", "replay_selection",
         "stratified_split", "sequence_members", "legacy_packets", "legacy_to_number", "legacy_sequences",
         "anomaly_threshold", "standard_scaled", "evaluate_verdicts", "finite_guard", "score_table",
         "flows_csv_roundtrip", "events_ndjson", "dq_schema", "flow_sequences", "sequences_csv_roundtrip",
         "stream_flows", "stream_scores", "stream_status", "stream_response", "stream_fanout", "stream_reordered",
         "stream_interim", "stream_chain"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{os.path.join(SF001, 'events.parquet')}')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    import sys
    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))
    from check_oracle import digest

    s = digest(E.queries()[name](spark, SF001).toPandas())
    d = digest(duck.execute(E.oracle_sql()[name]).df())
    assert s[:3] == d[:3]


def test_entry_contract(spark):
    df = E.entry(spark)
    assert df.columns == ["ip", "total", "attacks", "suspicious", "last_seen_us"]
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
