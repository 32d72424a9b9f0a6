"""Column-level functions (all built-in expressions, whole-stage codegen).

P1 canonical flow key, P2 TCP flag decode, P3 protocol name, P4 finite
guard, P5 feature alignment, P6/P6b numeric coercion, P8 rounding,
P12 binary verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import FEATURES, TCP_FLAGS


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# -- P1 ---------------------------------------------------------------------
def with_flow_key(packets: DataFrame) -> DataFrame:
    """Add ``a_ip, a_port, b_ip, b_port`` (ordered endpoints) and ``fwd``.

    Endpoints compare as (ip text, port int); the smaller endpoint is ``a``
    and a packet from ``a`` to ``b`` is forward. Missing ip -> '', port -> 0.
    """
    src = F.struct(F.coalesce(F.col("src_ip"), F.lit("")).alias("ip"),
                   F.coalesce(F.col("src_port"), F.lit(0)).cast("int").alias("port"))
    dst = F.struct(F.coalesce(F.col("dst_ip"), F.lit("")).alias("ip"),
                   F.coalesce(F.col("dst_port"), F.lit(0)).cast("int").alias("port"))
    fwd = src <= dst
    lo = F.when(fwd, src).otherwise(dst)
    hi = F.when(fwd, dst).otherwise(src)
    return (packets
            .withColumn("fwd", fwd)
            .withColumn("a_ip", lo["ip"]).withColumn("a_port", lo["port"])
            .withColumn("b_ip", hi["ip"]).withColumn("b_port", hi["port"])
            .withColumn("proto", F.coalesce(F.col("proto"), F.lit(0)).cast("int")))


# -- P2 ---------------------------------------------------------------------
def flag_bit(flags, name: str) -> Column:
    """1 when the named TCP flag bit is set, else 0."""
    mask = TCP_FLAGS[name]
    return (F.coalesce(_c(flags), F.lit(0)).bitwiseAND(F.lit(mask)) != 0).cast("int")


def with_tcp_flags(df: DataFrame, flags_col: str = "tcp_flags") -> DataFrame:
    return df.withColumns({f"{n}_bit": flag_bit(flags_col, n) for n in TCP_FLAGS})


# -- P3 ---------------------------------------------------------------------
def protocol_name(value) -> Column:
    """1/6/17 -> ICMP/TCP/UDP, another number -> its integer text, else 'ip'."""
    as_double = F.trim(_c(value).cast("string")).try_cast("double")
    as_int = as_double.cast("bigint")  # truncates toward zero
    return (F.when(as_double.isNull() | F.isnan(as_double) | (F.abs(as_double) == float("inf")), F.lit("ip"))
            .when(as_int == 1, F.lit("ICMP"))
            .when(as_int == 6, F.lit("TCP"))
            .when(as_int == 17, F.lit("UDP"))
            .otherwise(as_int.cast("string")))


# -- P4 ---------------------------------------------------------------------
def finite(x) -> Column:
    """NaN, +-inf and null become 0.0."""
    c = _c(x).cast("double")
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(c)


# -- P5 ---------------------------------------------------------------------
def align_features(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Project to the 52 features in order; missing columns become 0.0."""
    have = set(df.columns)
    cols = [F.col(c) for c in (keep or []) if c in have]
    for name in FEATURES:
        cols.append((finite(name) if name in have else F.lit(0.0)).alias(name))
    return df.select(*cols)


def align_feature_array(arr) -> Column:
    """Array form of P5: pad with zeros / cut to exactly 52 doubles."""
    a = F.transform(_c(arr), lambda x: finite(x))
    padded = F.concat(a, F.array_repeat(F.lit(0.0), len(FEATURES)))
    return F.slice(padded, 1, len(FEATURES))


# -- P6 ---------------------------------------------------------------------
def to_number(x) -> Column:
    """Lenient numeric coercion of text.

    null / blank / 'nan' / 'none' / 'null' -> 0; '0x..' hex -> integer value;
    comma decimal -> dot; anything unparseable -> 0; infinities -> 0.
    """
    t = F.trim(_c(x).cast("string"))
    low = F.lower(t)
    hex_digits = low.substr(F.lit(3), F.length(low))
    hex_ok = hex_digits.rlike("^[0-9a-f]+$")
    hex_val = F.conv(hex_digits, 16, 10).try_cast("double")
    dec_val = F.regexp_replace(t, ",", ".").try_cast("double")
    val = (F.when(t.isNull() | (t == "") | low.isin("nan", "none", "null"), F.lit(0.0))
           .when(low.startswith("0x"), F.when(hex_ok, hex_val).otherwise(F.lit(0.0)))
           .otherwise(dec_val))
    return finite(val)


def hex_or_zero(x) -> Column:
    """Legacy sequence-builder flags: '0x..' -> int, other text -> 0 (null -> 0)."""
    t = F.coalesce(_c(x).cast("string"), F.lit("0"))
    digits = t.substr(F.lit(3), F.length(t))
    return F.when(t.startswith("0x") & digits.rlike("^[0-9a-fA-F]+$"),
                  F.conv(digits, 16, 10).try_cast("double")).otherwise(F.lit(0.0))


def hex_or_int(x) -> Column:
    """Legacy forest flags: null -> '0x0'; '0x..' -> hex value, else integer text."""
    t = F.coalesce(_c(x).cast("string"), F.lit("0x0"))
    digits = t.substr(F.lit(3), F.length(t))
    return F.when(t.startswith("0x"), F.conv(digits, 16, 10).try_cast("double")) \
            .otherwise(t.try_cast("double"))


def clean_packets(df: DataFrame, mode: str = "lenient", label: str = "label") -> DataFrame:
    """Coerce every legacy packet column to DOUBLE.

    ``lenient`` applies :func:`to_number`; ``sequence`` is the legacy sequence
    builder (hex-or-0 flags, numeric-or-0 rest); ``forest`` is the legacy
    forest script (hex-or-int flags with null -> 0x0, comma decimals).
    """
    out = []
    for c in df.columns:
        col = F.col(f"`{c}`")
        if c == label:
            out.append(to_number(col).cast("int").alias(c))
        elif mode == "sequence":
            v = hex_or_zero(col) if c == "tcp.flags" else finite(col.cast("string").try_cast("double"))
            out.append(v.alias(c))
        elif mode == "forest":
            if c == "tcp.flags":
                v = hex_or_int(col)
            elif c == "mqtt.msgtype":
                v = F.coalesce(F.regexp_replace(col.cast("string"), ",", ".").try_cast("double"), F.lit(0.0))
            else:
                v = F.regexp_replace(col.cast("string"), ",", ".").try_cast("double")
            out.append(v.alias(c))
        else:
            out.append(to_number(col).alias(c))
    return df.select(*out)


# -- P8 ---------------------------------------------------------------------
def round_sql(x: str, digits: int = 4) -> str:
    """Half-up rounding as one IEEE formula, ``floor(x * 10^d + 0.5) / 10^d``.

    Spark's ``round`` (decimal HALF_UP) and other engines break exact ties
    (common for microsecond values) differently; this text evaluates to the
    same bits everywhere. Values beyond 1e14 are returned unchanged.
    """
    s = f"1e{digits}"
    return f"(CASE WHEN abs(({x})) < 1e14 THEN CAST(floor(({x}) * {s} + 5e-1) AS DOUBLE) / {s} ELSE ({x}) END)"


def round_half_up(x, digits: int = 4) -> Column:
    name = x if isinstance(x, str) else None
    if name is None:
        raise TypeError("round_half_up takes a column name")
    return F.expr(round_sql(f"`{name}`", digits))


def round_features(df: DataFrame, digits: int = 4, cols: list[str] | None = None) -> DataFrame:
    targets = set(cols or FEATURES)
    return df.select(*[round_half_up(c, digits).alias(c) if c in targets else F.col(c)
                       for c in df.columns])


# -- P12 --------------------------------------------------------------------
def binary_verdict(df: DataFrame, proba_col: str = "attack_proba", cut: float = 0.55) -> DataFrame:
    """Attack when P(attack) > cut; the score is the chosen class's probability."""
    p = F.col(proba_col)
    return df.withColumns({
        "pred": F.when(p > cut, 1).otherwise(0),
        "pred_score": F.when(p > cut, p).otherwise(1 - p),
    })
