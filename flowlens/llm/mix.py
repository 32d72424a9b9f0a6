"""Mixing sources to target weights by Pfair scheduling. DataFrame functions only.

Time runs in slots of one block. With weight w, block j = 1, 2, ... of a source is released at floor((j - 1) / w) and
due at ceil(j / w). Of the released blocks the one with the earliest deadline takes the slot. The weights are whole
shares of their sum Q and sum up to one, so every deadline is met, and at any time t the source has had more than
t w - 1 and fewer than t w + 1 blocks. The schedule repeats after Q slots, so only one period is worked out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shuffle_partitions

BLOCK_DOCS = 8
MAX_PERIOD = 100_000
#: Documents that one task ranks.
RANK_ROWS = 50_000


def period_schedule(spark: SparkSession, shares: list[int]) -> DataFrame:
    """(cls, j, at): the slot within a period, from 0, of block j (from 0) of each class with that share of the period."""
    q, s = sum(shares), len(shares)
    if not shares or min(shares) < 1 or q > MAX_PERIOD:
        raise ValueError(f"shares are positive and sum up to {MAX_PERIOD} at most")
    u = F.array(*[F.lit(x) for x in shares])

    def step(state, t):
        done = state["done"]
        due = F.transform(F.sequence(F.lit(0), F.lit(s - 1)), lambda i: F.struct(
            F.ceil((F.get(done, i) + 1) * q / F.get(u, i)).cast("long").alias("deadline"), i.alias("cls"),
            F.floor(F.get(done, i) * q / F.get(u, i)).cast("long").alias("release")))
        pick = F.array_min(F.filter(due, lambda x: x["release"] <= t))["cls"]
        return F.struct(F.transform(done, lambda x, i: F.when(i == pick, x + 1).otherwise(x)).alias("done"),
                        F.concat(state["out"], F.array(F.struct(pick.alias("cls"), F.get(done, pick).alias("j"), t.alias("at")))).alias("out"))

    start = F.struct(F.array(*[F.lit(0)] * s).alias("done"), F.expr("CAST(array() AS array<struct<cls:int,j:int,at:int>>)").alias("out"))
    run = F.aggregate(F.sequence(F.lit(0), F.lit(q - 1)), start, step)
    return spark.range(1).select(F.explode(run["out"]).alias("b")).select("b.cls", "b.j", "b.at")


def mix_sources(docs: DataFrame, weights: dict[str, int], other: int, block_docs: int = BLOCK_DOCS,
                seed: str = "mix", rank_rows: int = RANK_ROWS) -> DataFrame:
    """All rows and columns of ``docs`` with their place in the mix: _fl_block, _fl_slot, _fl_pos, _fl_class.

    ``weights`` are whole shares by source; sources that it doesn't name, and null, form one class with the share
    ``other``. Within a class, documents are put in the order of a seeded hash of doc_id (of the text, if that is null)
    and cut into blocks of ``block_docs``; block ``_fl_block`` (from 0) takes slot ``_fl_slot`` and a document's place
    in it is ``_fl_pos``. Until a class runs dry its blocks stay within one block of its target at any slot; its later
    slots stay empty, and the others keep their pace among themselves. Every row is kept, repeated rows and null ids
    too, and (_fl_slot, _fl_pos) is different for each. No rows give no rows.

    A class is ranked in hash ranges of ``rank_rows`` rows of the table or fewer, with counted offsets, so that a hot source is many tasks.
    """
    spark = docs.sparkSession
    names = sorted(weights)
    shares = [weights[n] for n in names] + [other]
    cls = F.lit(len(names))
    for i, n in enumerate(names):
        cls = F.when(F.col("source") == n, i).otherwise(cls)
    ranges = max(4 * shuffle_partitions(spark), -(-docs.count() // rank_rows))
    rows = docs.withColumns({
        "_fl_class": cls, "_fl_order": F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")))),
        "_fl_tie": F.xxhash64("text")})
    rows = rows.withColumn("_fl_range", F.shiftright(F.conv(F.substring("_fl_order", 1, 7), 16, 10).cast("long") * ranges, 28))
    counts = rows.groupBy("_fl_class", "_fl_range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("_fl_class").orderBy("_fl_range").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_fl_class", "_fl_range", before.alias("_fl_before"))
    within = Window.partitionBy("_fl_class", "_fl_range").orderBy("_fl_order", "doc_id", "_fl_tie")
    ranked = rows.withColumn("_fl_rank", F.row_number().over(within) - 1).join(offsets, ["_fl_class", "_fl_range"])
    ranked = ranked.withColumn("_fl_rank", F.col("_fl_rank") + F.col("_fl_before"))
    ranked = ranked.withColumns({"_fl_block": F.floor(F.col("_fl_rank") / block_docs).cast("long"),
                                 "_fl_pos": F.pmod("_fl_rank", F.lit(block_docs)).cast("int")})
    share = F.get(F.array(*[F.lit(x) for x in shares]), F.col("_fl_class"))
    ranked = ranked.withColumns({"_fl_j": F.pmod("_fl_block", share).cast("int"), "_fl_turn": F.floor(F.col("_fl_block") / share).cast("long")})
    period = period_schedule(spark, shares).select(F.col("cls").alias("_fl_class"), F.col("j").alias("_fl_j"), "at")
    # at most MAX_PERIOD rows, whatever the table
    placed = ranked.join(F.broadcast(period), ["_fl_class", "_fl_j"])
    return placed.select(*docs.columns, "_fl_class", "_fl_block", (F.col("_fl_turn") * sum(shares) + F.col("at")).alias("_fl_slot"), "_fl_pos")
