"""Response: alert counting, actions, block intervals.

Times are emission times (``emit_us``); "now" for expiry is an explicit
as-of argument. Per-source ordered state (running alert count, previous
block, last unblock) uses the bucketed window helpers, so one source with a
large share of all alerts is still spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialised
from ..settings import DEFAULT_POLICY, Policy
from .chains import mark_starts
from .scoring import EMIT_ORDER
from .windows import HOUR_US, last_before, running_sum

ALERT_STATUSES = ("ATTACK", "SUSPICIOUS")
# fixed values: action messages
MSG_NO_SOURCE = "No source IP available."
MSG_BELOW = "Below response threshold."


def is_alert(host_col: str = "src_ip"):
    return F.col(host_col).isNotNull() & F.col("status").isin(*ALERT_STATUSES)


# -- W5 / R1 ----------------------------------------------------------------
def with_alert_count(events: DataFrame, host_col: str = "src_ip", bucket_us: int | None = None) -> DataFrame:
    """Running alert count per source in emission order (never reset)."""
    return running_sum(events, [host_col], EMIT_ORDER, is_alert(host_col).cast("int"), "alert_count",
                       time_col="emit_us", bucket_us=bucket_us)


def with_action(events: DataFrame, policy: Policy = DEFAULT_POLICY, host_col: str = "src_ip",
                bucket_us: int | None = None) -> DataFrame:
    """``action_type`` observe / watch / block and ``action_message``."""
    df = with_alert_count(events, host_col, bucket_us)
    src = F.col(host_col)
    block = F.lit(bool(policy.auto_block)) & (F.col("alert_count") >= int(policy.block_threshold))
    kind = (F.when(src.isNull(), F.lit("observe"))
            .when(~is_alert(host_col), F.lit("observe"))
            .when(block, F.lit("block"))
            .otherwise(F.lit("watch")))
    msg = (F.when(src.isNull(), F.lit(MSG_NO_SOURCE))
           .when(~is_alert(host_col), F.lit(MSG_BELOW))
           .when(block, F.concat(F.lit("Block registered for "), src, F.lit(".")))
           .otherwise(F.concat(F.col("alert_count").cast("string"), F.lit(" alert(s) from source."))))
    return df.withColumn("action_type", kind).withColumn("action_message", msg)


def block_events(actions: DataFrame, host_col: str = "src_ip") -> DataFrame:
    """Block actions as ``ip, t_us, n, reason`` (one per renewing alert;
    ``n`` is the source's running alert count, increasing in emission order)."""
    return (actions.filter(F.col("action_type") == "block")
            .select(F.col(host_col).alias("ip"), F.col("emit_us").alias("t_us"),
                    F.col("alert_count").cast("long").alias("n"),
                    F.concat(F.col("alert_count").cast("string"), F.lit(" alerts")).alias("reason")))


# -- R2 / R3 ----------------------------------------------------------------
def block_intervals(actions: DataFrame, policy: Policy = DEFAULT_POLICY, commands: DataFrame | None = None,
                    host_col: str = "src_ip", bucket_us: int | None = None) -> DataFrame:
    """R2 (+R3): merged block intervals ``ip, reason, dry_run, blocked_us,
    expires_us, renewals``.

    Every block renews the expiry to ``t + duration``; a block at or after the
    previous expiry starts a new interval. Manual ``commands`` (``t_us, ip,
    command`` block/unblock) join in: a manual block behaves like an alert
    block with reason ``manual``; an unblock ends the current interval.
    """
    dur = int(policy.block_duration_seconds) * 1_000_000
    ev = block_events(actions, host_col).select("ip", "t_us", "n", "reason", F.lit(0).alias("kind"))
    if commands is not None:
        cmd = commands.select("ip", "t_us", F.lower("command").alias("command"))
        ev = ev.unionByName(cmd.filter(F.col("command") == "block")
                            .select("ip", "t_us", F.lit(0).cast("long").alias("n"), F.lit("manual").alias("reason"),
                                    F.lit(0).alias("kind")))
        ev = ev.unionByName(cmd.filter(F.col("command") == "unblock")
                            .select("ip", "t_us", F.lit(0).cast("long").alias("n"),
                                    F.lit(None).cast("string").alias("reason"), F.lit(1).alias("kind")))
    order = ["t_us", "kind", "n"]
    is_b = F.col("kind") == 0
    ev = last_before(ev, ["ip"], order, {"_prev_b": F.when(is_b, F.col("t_us")),
                                         "_prev_u": F.when(~is_b, F.col("t_us"))}, "t_us", bucket_us)
    new = is_b & (F.col("_prev_b").isNull() | (F.col("t_us") - F.col("_prev_b") >= dur)
                  | (F.col("_prev_u").isNotNull() & (F.col("_prev_u") >= F.col("_prev_b"))))
    ev = running_sum(ev, ["ip"], order, new.cast("int"), "_island", "t_us", bucket_us)
    last_b = F.max(F.when(is_b, F.col("t_us")))
    agg = (ev.filter(F.col("_island") > 0).groupBy("ip", "_island").agg(
        F.min(F.when(is_b, F.col("t_us"))).alias("blocked_us"),
        last_b.alias("_last_b"),
        F.min(F.when(~is_b, F.col("t_us"))).alias("_cut"),
        F.max(F.when(is_b, F.struct("t_us", "n", "reason")))["reason"].alias("reason"),
        F.count_if(is_b).alias("renewals")))
    end = F.col("_last_b") + dur
    expires = F.when(F.col("_cut").isNotNull() & (F.col("_cut") < end), F.col("_cut")).otherwise(end)
    return agg.select("ip", "reason", F.lit(bool(policy.dry_run)).alias("dry_run"), "blocked_us",
                      expires.cast("long").alias("expires_us"), F.col("renewals").cast("long").alias("renewals"))


def active_blocks(blocks: DataFrame, as_of_us: int) -> DataFrame:
    """R2: blocks in force at ``as_of_us`` (expired ones are dropped when polled)."""
    t = F.lit(int(as_of_us))
    return blocks.filter((F.col("blocked_us") <= t) & (t < F.col("expires_us")))


# -- R4 ---------------------------------------------------------------------
def _chain_fold(span_us: int):
    def fold(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        cur_ip, cur_end = None, None
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            ips = batch.column("ip").to_pylist()
            ts = batch.column("t_us").to_numpy(zero_copy_only=False).astype(np.int64)
            start = np.zeros(n, dtype=bool)
            i = 0
            while i < n:
                j = i
                while j < n and ips[j] == ips[i]:
                    j += 1
                seg = ts[i:j]
                if ips[i] != cur_ip:
                    cur_ip, cur_end = ips[i], None
                k = 0 if cur_end is None else int(np.searchsorted(seg, cur_end, side="left"))
                while k < len(seg):
                    start[i + k] = True
                    cur_end = int(seg[k]) + span_us
                    k = int(np.searchsorted(seg, cur_end, side="left"))
                i = j
            yield pa.RecordBatch.from_arrays(list(batch.columns) + [pa.array(start)],
                                             names=list(batch.schema.names) + ["starts"])
    return fold


#: Block actions of one source beyond which it is spread over many tasks.
HOT_SOURCE = 1_000_000


def block_intervals_fixed(actions: DataFrame, policy: Policy = DEFAULT_POLICY,
                          host_col: str = "src_ip", hot_rows: int | None = HOT_SOURCE) -> DataFrame:
    """R4 (legacy): blocks do not renew; alerts during a block are ignored and
    the block ends after the duration; the next qualifying alert re-blocks.

    The greedy chain (next block = first qualifying alert at or after the
    previous end) runs as a sorted streaming ``mapInArrow`` pass per source.
    Sources with more than ``hot_rows`` such alerts are spread over blocks of
    time instead, their chains by pointer doubling (``chains.mark_starts``);
    None counts nothing and passes every source.
    """
    dur = int(policy.block_duration_seconds) * 1_000_000
    ev = block_events(actions, host_col)
    hot = None
    if hot_rows is not None:
        ev = materialised(ev, "block-events")
        many = ev.groupBy(F.col("ip").alias("_ip")).count().filter(F.col("count") > hot_rows)
        hot = materialised(many.select("_ip", F.monotonically_increasing_id().alias("_hot")), "hot-sources")
        hot = None if hot.isEmpty() else hot
    cool = ev if hot is None else ev.join(hot, F.col("ip") == F.col("_ip"), "left_anti")
    cool = cool.repartition("ip").sortWithinPartitions("ip", "t_us", "n")
    schema = T.StructType(ev.schema.fields + [T.StructField("starts", T.BooleanType())])
    marked = cool.mapInArrow(_chain_fold(dur), schema).filter("starts").drop("starts")
    if hot is not None:
        spread = mark_starts(ev.join(hot, F.col("ip") == F.col("_ip")), "_hot", ["t_us", "n"], dur)
        marked = marked.unionByName(spread.filter("is_start").select(*ev.columns))
    return marked.select("ip", "reason", F.lit(bool(policy.dry_run)).alias("dry_run"),
                         F.col("t_us").alias("blocked_us"), (F.col("t_us") + dur).cast("long").alias("expires_us"))


# -- J2 ---------------------------------------------------------------------
def flag_blocked(events: DataFrame, blocks: DataFrame, host_col: str = "src_ip",
                 bucket_us: int = HOUR_US) -> DataFrame:
    """``blocked`` = the event's source was blocked at its emission time.

    Range join by time bucket: intervals are exploded into the buckets they
    cover, then an equi-join on (ip, bucket) plus the interval predicate.
    Merged intervals are disjoint per ip, so an event matches at most one.
    """
    iv = (blocks.select(F.col("ip").alias("_ip"), "blocked_us", "expires_us")
          .filter(F.col("expires_us") > F.col("blocked_us"))
          .withColumn("_bkt", F.explode(F.sequence(
              F.floor(F.col("blocked_us") / bucket_us).cast("long"),
              F.floor((F.col("expires_us") - 1) / bucket_us).cast("long"))))
          .withColumnRenamed("blocked_us", "_from").withColumnRenamed("expires_us", "_to"))
    ev = events.withColumn("_bkt", F.floor(F.col("emit_us") / bucket_us).cast("long"))
    cond = ((F.col(host_col) == F.col("_ip")) & (F.col("_bkt") == F.col("_ibkt"))
            & (F.col("_from") <= F.col("emit_us")) & (F.col("emit_us") < F.col("_to")))
    joined = ev.join(iv.withColumnRenamed("_bkt", "_ibkt"), cond, "left")
    return (joined.withColumn("blocked", F.col("_ip").isNotNull())
            .drop("_ip", "_ibkt", "_bkt", "_from", "_to"))
