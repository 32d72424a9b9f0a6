"""Test inputs derived from the driver's ``events`` table.

The ``packets`` view maps events onto sixteen hosts (four attack captures,
twelve normal hosts) with compressed time. One SQL template renders for
both Spark and DuckDB so the oracle sees exactly the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table_path

_PACKETS_SQL = """
WITH e AS (
  SELECT event_id, event_type, value, CAST(user_id % 16 AS INT) AS hst,
         CAST({k} AS INT) AS k, {off} AS off_us
  FROM {events}),
c AS (
  SELECT event_id AS seq, hst,
    CASE WHEN hst IN (1, 2) THEN off_us {idiv} 72000 ELSE off_us {idiv} 3600 END AS ts_us,
    CASE hst WHEN 0 THEN 'portscan' WHEN 1 THEN 'synflood' WHEN 2 THEN 'udpflood'
             WHEN 3 THEN 'slowdos' ELSE 'normal' END AS capture_id,
    CASE WHEN hst IN (0, 1, 3) THEN 0 WHEN hst = 2 THEN 2 ELSE k % 4 END AS srv,
    hst NOT IN (0, 1) AND event_id % 5 IN (1, 3) AS bwd,
    CASE WHEN hst IN (0, 1) THEN 40 WHEN hst = 3 THEN 60 ELSE CAST(40 + floor(value * 3) AS INT) END AS length,
    CASE WHEN hst = 0 THEN CAST(1 + event_id % 997 AS INT) WHEN hst IN (1, 3) THEN 80 WHEN hst = 2 THEN 53
         ELSE CASE k % 4 WHEN 0 THEN 443 WHEN 1 THEN 22 WHEN 2 THEN 53 ELSE 0 END END AS sport,
    CASE WHEN hst IN (0, 1) THEN 2 WHEN hst = 3 THEN 24 WHEN event_type = 'signup' THEN 2
         WHEN event_type = 'error' AND k < 20 THEN 20 WHEN event_type = 'purchase' AND k < 50 THEN 17
         WHEN event_type = 'view' THEN 24 ELSE 16 END AS flags
  FROM e),
s AS (
  SELECT *, concat('10.10.2.', CAST(hst + 5 AS {str})) AS cip,
    CASE srv WHEN 0 THEN '10.10.0.5' WHEN 1 THEN '9.9.9.9' WHEN 2 THEN '10.10.0.53' ELSE '10.10.2.10' END AS sip,
    CASE srv WHEN 3 THEN 0 ELSE 40000 + hst END AS cport,
    CASE srv WHEN 2 THEN 17 WHEN 3 THEN 1 ELSE 6 END AS proto
  FROM c)
SELECT CAST(seq AS BIGINT) AS seq, capture_id, CAST(ts_us AS BIGINT) AS ts_us,
  CAST(length AS INT) AS length, CAST(proto AS INT) AS proto,
  CASE WHEN bwd THEN sip ELSE cip END AS src_ip, CASE WHEN bwd THEN cip ELSE sip END AS dst_ip,
  CAST(CASE WHEN bwd THEN sport ELSE cport END AS INT) AS src_port,
  CAST(CASE WHEN bwd THEN cport ELSE sport END AS INT) AS dst_port,
  CAST(CASE WHEN proto = 6 THEN 40 ELSE 28 END AS INT) AS header_len,
  CAST(CASE WHEN proto = 6 THEN flags ELSE 0 END AS INT) AS tcp_flags
FROM s
"""

# Offset from 2024-01-01 in µs, independent of the session time zone: a
# wall-clock (NTZ) column is differenced against an NTZ literal; an instant
# column (LTZ) is converted with unix_micros.
_OFF_NTZ = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)"
_OFF_LTZ = "unix_micros(ts) - 1704067200000000"

_SPARK = {
    "off": _OFF_NTZ,
    "k": "get_json_object(props, '$.k')",
    "idiv": "div",
    "events": "{events}",
    "str": "STRING",
}
_DUCK = {
    "off": "epoch_us(ts) - 1704067200000000",
    "k": "json_extract_string(props, '$.k')",
    "idiv": "//",
    "events": "events",
    "str": "VARCHAR",
}


def packets_sql(dialect: str = "duckdb", ts_ntz: bool = True) -> str:
    """The packets view as SQL text for ``spark`` or ``duckdb``."""
    subs = dict(_SPARK if dialect == "spark" else _DUCK)
    if dialect == "spark" and not ts_ntz:
        subs["off"] = _OFF_LTZ
    return _PACKETS_SQL.format(**subs)


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, "events"))


def packets_from_events(events: DataFrame) -> DataFrame:
    """Derive the ``packets`` table from an ``events`` DataFrame."""
    from pyspark.sql.types import TimestampNTZType

    ntz = isinstance(events.schema["ts"].dataType, TimestampNTZType)
    return events.sparkSession.sql(packets_sql("spark", ntz), events=events)


def read_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets_from_events(read_events(spark, sf_dir))


_MANIFEST_SQL = """
SELECT capture_id,
       CAST(CASE WHEN capture_id = 'normal' THEN 0 ELSE 1 END AS INT) AS label,
       CASE WHEN capture_id = 'normal' THEN '' ELSE capture_id END AS attack_type
FROM (SELECT DISTINCT capture_id FROM {packets})
"""


def manifest_sql(packets_ref: str = "packets") -> str:
    return _MANIFEST_SQL.format(packets=packets_ref)


def manifest_from_packets(packets: DataFrame) -> DataFrame:
    """Capture manifest: ``normal`` is label 0, every other capture label 1."""
    return packets.sparkSession.sql(manifest_sql("{packets}"), packets=packets.select("capture_id"))
