"""P3 and P6 as SQL functions: the bodies are SQL, so that queries stay in the JVM and need no Python function.

``register_functions(spark)`` makes ``protocol_name(text)``, ``text_number(text)`` and ``finite_number(double)`` known to
the session; they give what ``protocol_name``, ``to_number`` and ``finite`` of :mod:`flowlens.functions.scalar` give (Spark
has a ``to_number`` of its own, which no session function may replace).
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_NUMBER = "try_cast(trim(v) AS DOUBLE)"
_ENDLESS = "double('infinity')"
_LOW = "lower(trim(v))"
_TEXT_NUMBER = f"""CASE
  WHEN v IS NULL OR trim(v) = '' OR {_LOW} IN ('nan', 'none', 'null') THEN 0D
  WHEN startswith({_LOW}, '0x') THEN
    CASE WHEN rlike(substring({_LOW}, 3), '^[0-9a-f]+$') THEN try_cast(conv(substring({_LOW}, 3), 16, 10) AS DOUBLE) ELSE 0D END
  ELSE try_cast(replace(trim(v), ',', '.') AS DOUBLE) END"""

#: name -> (parameter, result type, body)
FUNCTIONS = {
    "finite_number": ("v DOUBLE", "DOUBLE", f"CASE WHEN v IS NULL OR isnan(v) OR abs(v) = {_ENDLESS} THEN 0D ELSE v END"),
    "protocol_name": ("v STRING", "STRING", f"""CASE
  WHEN {_NUMBER} IS NULL OR isnan({_NUMBER}) OR abs({_NUMBER}) = {_ENDLESS} THEN 'ip'
  WHEN CAST({_NUMBER} AS BIGINT) = 1 THEN 'ICMP'
  WHEN CAST({_NUMBER} AS BIGINT) = 6 THEN 'TCP'
  WHEN CAST({_NUMBER} AS BIGINT) = 17 THEN 'UDP'
  ELSE CAST(CAST({_NUMBER} AS BIGINT) AS STRING) END"""),
    "text_number": ("v STRING", "DOUBLE", f"""CASE
  WHEN ({_TEXT_NUMBER}) IS NULL OR isnan({_TEXT_NUMBER}) OR abs({_TEXT_NUMBER}) = {_ENDLESS} THEN 0D
  ELSE ({_TEXT_NUMBER}) END"""),
}


def register_functions(spark: SparkSession) -> None:
    """(Re)create the functions in the session."""
    for name, (parameter, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameter}) RETURNS {result} RETURN {body}")
