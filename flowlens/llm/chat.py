"""Chat formatting by multi-party perspective rotation: every participant in turn is the assistant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shuffle_partitions, written

START, END = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"
UNKNOWN = "unknown"
#: Turn numbers in a part of a long dialogue, and rows for each of them that a slice of it takes, on average.
PART_TURNS, TIE_ROWS = 512, 512
#: Bytes of turns in a slice, but for its last turn.
SLICE_BYTES = 256 << 20


def positions(rows: DataFrame) -> DataFrame:
    """``rows`` with ``place``: 0, 1, ... in the order of turn, role and text within a conversation and part, and ``ahead``:
    the bytes of the turns before.

    Ranges of that order are dealt out, with a number of its own for each row, so that equal rows part too; the rows of a
    range are numbered, and the counts of the ranges before (a row for each part and range) are added.
    """
    spark = rows.sparkSession
    order = ["conv_id", "turn", "role", "said", "own_no"]
    dealt = rows.withColumn("own_no", F.monotonically_increasing_id()).repartitionByRange(shuffle_partitions(spark), *order)
    # written, so that a row keeps its range wherever it is read
    dealt = written(dealt.withColumn("range", F.spark_partition_id()), "turns")
    size = F.octet_length("said") + F.octet_length("role") + 64
    counts = dealt.groupBy("conv_id", "part", "range").agg(F.count("*").alias("n"), F.sum(size).alias("b"))
    earlier = Window.partitionBy("conv_id", "part").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("conv_id", "part", "range", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(x)
                                                         for c, x in (("n", "before"), ("b", "before_b"))]).alias("c")
    within = Window.partitionBy("conv_id", "part", "range").orderBy("turn", "role", "said", "own_no")
    numbered = dealt.withColumns({"place": F.row_number().over(within) - 1, "ahead": F.coalesce(
        F.sum(size).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))}).alias("r")
    same = F.col("r.conv_id").eqNullSafe(F.col("c.conv_id")) & (F.col("r.part") == F.col("c.part")) & (F.col("r.range") == F.col("c.range"))
    return numbered.join(counts, same).select(*[f"r.{c}" for c in rows.columns], (F.col("place") + F.col("before")).alias("place"),
                                               (F.col("ahead") + F.col("before_b")).alias("ahead"))


def rotate_perspectives(turns: DataFrame, part_turns: int = PART_TURNS, tie_rows: int = TIE_ROWS,
                        slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` -> conv_id, speaker, part, slice, n_turns, text, mask.

    For every participant of a conversation (each role but ``system``) the dialogue is rendered once: the turns of that
    speaker as assistant, those of ``system`` as system, the others as users with their names. ``mask`` lists the spans
    [start, end) of code points to learn from: what the assistant says, with the end mark. A conversation that has only
    system turns is rendered once, for a null speaker and with an empty mask.

    Turns go by number, then role and text; a null number comes first. Dialogues are cut into parts of ``part_turns``
    turn numbers, and parts into slices by their place in that order, repeated rows too: a new one after every
    ``part_turns * tie_rows`` rows and every ``slice_bytes`` bytes of turns, so that no task holds more of a long one (but
    for one turn); the texts by part and slice, one after another, are the whole. A part of no more is slice 0 only; slice
    numbers may leave some out.

    A null or blank role is ``unknown``; white space and the characters < > | in names become _; a null text is empty,
    and <| in a text becomes < | so that it can't end a turn. Rows with a null conv_id are one conversation. Repeated
    rows are repeated turns. Other columns are ignored, and no rows give no rows.
    """
    name = F.regexp_replace(F.trim("role"), r"[\s<>|]+", "_")
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(F.coalesce(name, F.lit("")) == "", UNKNOWN).otherwise(name).alias("role"),
        F.regexp_replace(F.coalesce("text", F.lit("")), r"<\|", "< |").alias("said"))
    rows = rows.withColumn("part", F.when(F.col("turn").isNull(), -1).otherwise(F.floor(F.col("turn") / part_turns)).cast("long"))
    rows = positions(rows).withColumn("slice", (
        F.floor(F.col("place") / (part_turns * tie_rows)) + F.floor(F.col("ahead") / slice_bytes)).cast("long")).drop("ahead")
    who = rows.groupBy("conv_id").agg(F.collect_set(F.when(F.col("role") != SYSTEM, F.col("role"))).alias("who"))
    who = who.select("conv_id", F.explode_outer("who").alias("speaker"))
    seen = rows.alias("r").join(who.alias("w"), F.col("r.conv_id").eqNullSafe(F.col("w.conv_id"))).select("r.*", "speaker")
    own = F.coalesce(F.col("role") == F.col("speaker"), F.lit(False))
    head = F.when(own, "assistant").when(F.col("role") == SYSTEM, SYSTEM).otherwise(F.concat(F.lit("user name="), F.col("role")))
    seen = seen.withColumns({"own": own, "head": F.concat(F.lit(START), head, F.lit("\n"))})
    seen = seen.withColumn("segment", F.concat("head", "said", F.lit(END + "\n")))
    group = ["conv_id", "speaker", "part", "slice"]
    order = Window.partitionBy(*group).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    seen = seen.withColumn("at", F.coalesce(F.sum(F.length("segment")).over(order), F.lit(0)))
    begin = F.col("at") + F.length("head")
    parts = seen.groupBy(*group).agg(
        F.count("*").alias("n_turns"), F.array_sort(F.collect_list(F.struct("at", "segment"))).alias("s"),
        F.array_sort(F.collect_list(F.when(F.col("own"), F.struct(
            begin.alias("start"), (begin + F.length("said") + len(END)).alias("end"))))).alias("mask"))
    return parts.select(*group, "n_turns", F.array_join(F.col("s.segment"), "").alias("text"), "mask")
