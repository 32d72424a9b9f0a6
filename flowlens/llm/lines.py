"""Line dedup with levelled sorted runs of line hashes. DataFrame functions only.

Documents come in batches of ascending doc_id. The lines of a batch are reduced to (hash, smallest doc_id), joined by
sort-merge with the runs of earlier batches (the anti-join part is the batch's own new run, sorted and written), and
equal-sized runs are compacted into one of the next level. A run row carries the document that keeps the line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, new_path, written

SPACES = " \t\n\x0b\f\r"
MIN_CHARS = 10
BATCHES = 4
FANOUT = 2
_LAST = (1 << 63) - 1
KEY = ["k1", "k2"]


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(did, th, pos, k1, k2): a row for each line whose key is long enough; two 64-bit hashes name the key."""
    line = docs.select("did", "th", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    key = line.select("did", "th", "pos", F.btrim("line", F.lit(SPACES)).alias("key")).where(F.length("key") >= min_chars)
    key = key.withColumn("key", ascii_lower(F.col("key")))
    return key.select("did", "th", "pos", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(1), "key").alias("k2"))


def _bounds(docs: DataFrame, batches: int) -> list[int]:
    if batches < 2:
        return []
    cut = docs.where("doc_id IS NOT NULL").approxQuantile("did", [i / batches for i in range(1, batches)], 0.01)
    return sorted({int(c) for c in cut})


def _run(rows: DataFrame, name: str) -> DataFrame:
    return written(rows.sortWithinPartitions(*KEY), name)


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``docs(doc_id, did, th, text)`` -> (did, th, pos): the lines to drop."""
    spark = docs.sparkSession
    bounds = _bounds(docs, batches)
    batch = F.lit(0)
    for b in bounds:
        batch = batch + (F.col("did") > b).cast("int")
    path = new_path(spark, "lines")
    _lines(docs, min_chars).withColumn("batch", batch).write.partitionBy("batch").parquet(path)
    schema = "did long, th long, pos int, k1 long, k2 long, batch int"
    lines = spark.read.schema(schema).parquet(path)
    levels: list[list[DataFrame]] = []
    drops = None
    for b in range(len(bounds) + 1):
        own = lines.where(F.col("batch") == b).drop("batch")
        firsts = own.groupBy(*KEY).agg(F.min("did").alias("first"), F.max("did").alias("last"))
        runs = [r for level in levels for r in level]
        if runs:
            old = runs[0]
            for r in runs[1:]:
                old = old.union(r)
            met = firsts.join(old.withColumnRenamed("first", "keep").hint("merge"), KEY, "left")
        else:
            met = firsts.withColumn("keep", F.lit(None).cast("long"))
        met = _run(met, "run")
        again = met.where("keep IS NOT NULL OR last > first").select(*KEY, F.coalesce("keep", "first").alias("keep"))
        out = own.join(again.hint("merge"), KEY).where("did > keep").select("did", "th", "pos")
        drops = out if drops is None else drops.union(out)
        new, level = met.where("keep IS NULL").select(*KEY, "first"), 0
        while b < len(bounds):  # levels of runs for the batches to come
            if len(levels) == level:
                levels.append([])
            levels[level].append(new)
            if len(levels[level]) < fanout:
                break
            merged = levels[level][0]
            for r in levels[level][1:]:
                merged = merged.union(r)
            levels[level], level = [], level + 1
            new = _run(merged.repartition(*KEY), "run")
    return drops


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES,
                        fanout: int = FANOUT) -> DataFrame:
    """All columns of ``docs``, with the kept text in ``text``, and _fl_lines and _fl_dropped: its lines, those dropped.

    A line's key is the line without white space at its ends, A-Z in lower case. Keys of at least ``min_chars`` code
    points that two or more documents hold lose all their lines but those of the smallest doc_id. A null or empty text
    is one empty line, kept as ''. Rows with equal doc_id are one document; rows with a null doc_id are one document
    after all others. Repeated rows stay, each with the same lines dropped. No rows give no rows.
    """
    docs = docs.withColumns({
        "_fl_text": F.coalesce("text", F.lit("")), "_fl_did": F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))})
    docs = docs.withColumn("_fl_th", F.xxhash64("_fl_text"))
    drops = dropped_lines(docs.select(
        "doc_id", F.col("_fl_did").alias("did"), F.col("_fl_th").alias("th"), F.col("_fl_text").alias("text")),
        min_chars, batches, fanout)
    by_text = drops.groupBy(F.col("did").alias("_fl_did"), F.col("th").alias("_fl_th")).agg(F.collect_set("pos").alias("_fl_pos"))
    out = docs.join(by_text.hint("merge"), ["_fl_did", "_fl_th"], "left")
    lines = F.split("_fl_text", "\n")
    out = out.withColumn("_fl_all", lines).withColumn("_fl_lines", F.size("_fl_all").cast("long"))
    left = F.array_except(F.sequence(F.lit(0), (F.col("_fl_lines") - 1).cast("int")), F.col("_fl_pos"))
    kept = F.array_join(F.transform(left, lambda i: F.get(F.col("_fl_all"), i)), "\n")
    names = [c for c in docs.columns if not c.startswith("_fl_")]
    return out.select(
        *[F.when(F.col("_fl_pos").isNull(), F.col("_fl_text")).otherwise(kept).alias("text") if c == "text" else F.col(c) for c in names],
        "_fl_lines", F.coalesce(F.size("_fl_pos"), F.lit(0)).cast("long").alias("_fl_dropped"))
