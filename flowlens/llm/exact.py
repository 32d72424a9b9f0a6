"""Exact dedup over an extendible-hash index on shared files.

Entries. A task reads its part of the documents and keeps one entry for each distinct text it meets: the text's 63-bit
hash, its bytes and the doc_ids that hold it (a posting list). So a text that a third of all rows hold is one entry for
each task. Entries go to the shared folder; all later steps read that table.

Directory. Buckets hold the entries whose hash another entry has too; they are named by the first bits of the hash. All
start at the depth that gives half-full buckets; a bucket that is over its capacity is split by the next bit, in rounds of
directory doubling that touch overfull buckets only. A bucket of one hash value can't be split: its entries form an
overflow chain, which is folded page by page first.

Owners. Each owner task takes a contiguous range of keys: the entries and the directory rows of its buckets, in the order
of the hash. It fills one bucket at a time, chains entries with equal hash and compares their bytes. The entry of a
hash that no other entry has is a class of its own; its text isn't moved, and it has no part in the number of owners.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, shuffle_partitions, text_batches, written

KEY_BITS = 63
#: Bytes of text that a bucket or a page of an overflow chain holds.
BUCKET_BYTES = 16 << 20
#: A page of an overflow chain has this many entries on average at least, so that every round shortens the chain.
PAGE_ENTRIES = 16
#: Bytes of distinct texts, and doc_ids, that a task holds before it writes its entries out.
HELD_BYTES, HELD_IDS = 32 << 20, 1 << 20
_OUT_BYTES = 4 << 20


def text_key(text: bytes, bits: int = KEY_BITS) -> tuple[int, bytes]:
    """(hash of ``bits`` bits left-aligned in 63, sha256) of a text."""
    digest = hashlib.sha256(text).digest()
    key = int.from_bytes(digest[:8], "big") >> 1
    return key >> (KEY_BITS - bits) << (KEY_BITS - bits), digest


def index_entries(docs: DataFrame, key_bits: int = KEY_BITS, held_bytes: int = HELD_BYTES) -> DataFrame:
    """``docs(doc_id, text)`` -> (entry, h, sha, n_bytes, text, ids): an entry for each distinct text of a task's part."""
    prepare(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        held: dict[bytes, list] = {}
        size = count = made = 0

        def flush():
            nonlocal made
            rows, weight = [], 0
            for text, ids in held.items():
                rows.append((first + made, *text_key(text, key_bits), len(text), text, ids))
                made += 1
                weight += len(text) + 8 * len(ids)
                if weight > _OUT_BYTES:
                    yield batch(rows)
                    rows, weight = [], 0
            if rows:
                yield batch(rows)

        def batch(rows) -> pa.RecordBatch:
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ENTRY, strict=True)]
            return pa.RecordBatch.from_arrays(cols, names=["entry", "h", "sha", "n_bytes", "text", "ids"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                t = t.as_py()
                ids = held.get(t)
                if ids is None:
                    held[t] = [i]
                    size += len(t)
                else:
                    ids.append(i)
                count += 1
                if size > held_bytes or count > HELD_IDS:
                    yield from flush()
                    held, size, count = {}, 0, 0
        yield from flush()

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return src.mapInArrow(run, "entry long, h long, sha binary, n_bytes long, text binary, ids array<long>")


_ENTRY = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64())]


def _slot(depth) -> F.Column:
    """The first ``depth`` bits of the hash."""
    return F.shiftright("h", KEY_BITS - depth)


def build_directory(weights: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, int]:
    """``weights(h, bytes)``, a row for each hash -> (start, depth, keys, bytes) for each bucket, and the first depth.

    ``start`` is the smallest hash of the bucket. A round doubles the directory: overfull buckets of the present depth
    are split by one more bit, counted anew from their own keys; all others keep their depth.
    """
    total = weights.agg(F.sum("bytes")).first()[0] or 0
    depth = first = max(0, math.ceil(math.log2(max(1.0, 2 * total / bucket_bytes))))

    def counted(keys: DataFrame, depth: int) -> DataFrame:
        per = keys.groupBy(_slot(depth).alias("slot")).agg(F.count("*").alias("keys"), F.sum("bytes").alias("bytes"))
        return per.select(F.shiftleft("slot", KEY_BITS - depth).alias("start"), F.lit(depth).alias("depth"), "keys", "bytes")

    level = written(counted(weights, depth), "directory")
    full = (F.col("bytes") > bucket_bytes) & (F.col("keys") > 1)
    done = level.where(~full)
    while depth < KEY_BITS and not (over := level.where(full).select(F.shiftright("start", KEY_BITS - depth).alias("slot"))).isEmpty():
        keys = weights.withColumn("slot", _slot(depth)).join(over, "slot", "left_semi").drop("slot")
        depth += 1
        level = written(counted(keys, depth), "directory")
        done = done.union(level.where(~full))
    if depth == KEY_BITS:
        done = done.union(level.where(full))
    return written(done, "directory"), first


def _compared(rows: DataFrame) -> DataFrame:
    """Rows (h, entry, text) in the order of h -> (entry, class, bucket). A row without entry opens its bucket.

    Equal texts get the entry that comes first as their class. Memory: the distinct texts of one bucket.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, chains = None, {}
        for b in batches:
            found = [], [], []
            for h, entry, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if entry is None:
                    bucket, chains = h, {}
                    continue
                text = text.as_py()
                chain = chains.setdefault(h, [])
                for kind, other in chain:
                    if other == text:
                        break
                else:
                    kind = entry
                    chain.append((entry, text))
                for out, x in zip(found, (entry, kind, bucket), strict=True):
                    out.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["entry", "class", "bucket"])

    return rows.mapInArrow(run, "entry long, class long, bucket long")


def _shared_hashes(entries: DataFrame) -> DataFrame:
    """(h, bytes, n) of each hash that several entries have."""
    per = entries.groupBy("h").agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("n"))
    return written(per.where("n > 1"), "shared-hashes")


def _fold_chains(entries: DataFrame, shared: DataFrame, bucket_bytes: int) -> list[DataFrame]:
    """Overflow chains, shortened: (entry, class) by round, over the entries that the round before left as classes.

    The entries of a hash that doesn't fit a bucket are dealt into pages; each page keeps one entry for each text.
    """
    steps: list[DataFrame] = []
    live = entries.select("entry", "h", "n_bytes")
    while True:
        pages = F.least(F.ceil(F.col("bytes") / bucket_bytes), F.ceil(F.col("n") / PAGE_ENTRIES))
        heavy = shared.where(F.col("bytes") > bucket_bytes).select("h", pages.alias("pages")).where("pages > 1")
        if heavy.isEmpty():
            return steps
        page = F.pmod(F.xxhash64("entry", F.lit(len(steps))), F.col("pages"))
        dealt = live.join(heavy, "h").select("entry", page.alias("page"))
        rows = entries.select("entry", "h", "text").join(dealt, "entry").repartition("h", "page")
        rows = rows.sortWithinPartitions("h", "page", "entry")
        mark = F.struct("h", "page")  # a page is a bucket of its own: its rows are compared among themselves only
        rows = rows.withColumn("h", F.xxhash64(mark)).select("h", "entry", "text")
        steps.append(written(_compared(rows).select("entry", "class"), "pages"))
        again = steps[-1].where("entry = class").select("entry")
        live = written(live.join(again, "entry", "left_semi"), "live")
        shared = _shared_hashes(live)


def exact_classes(entries: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Entries -> (entry, class): the same class for entries whose bytes are equal; an entry that isn't named is alone."""
    spark = entries.sparkSession
    shared = _shared_hashes(entries)
    steps = _fold_chains(entries, shared, bucket_bytes)
    gone = None
    for step in steps:
        moved = step.where("entry <> class").select("entry")
        gone = moved if gone is None else gone.union(moved)
    left = entries.select("h", "entry", "n_bytes", "text")
    if gone is not None:
        left = left.join(gone, "entry", "left_anti").select(*left.columns)
        shared = _shared_hashes(left)
    directory, depth = build_directory(shared, bucket_bytes)
    left = left.join(shared, "h", "left_semi")
    bits = min(depth, max(1, math.ceil(math.log2(4 * shuffle_partitions(spark)))) if depth else 0)
    opening = directory.select(F.col("start").alias("h"), F.lit(None).cast("long").alias("entry"),
                               F.lit(None).cast("binary").alias("text"))
    rows = left.select("h", "entry", "text").union(opening)
    owner = _slot(bits).cast("int") if bits else F.lit(0)
    rows = rows.repartitionById(1 << bits, owner).sortWithinPartitions("h", F.col("entry").asc_nulls_first())
    classes = written(_compared(rows).select("entry", "class"), "classes")
    for step in reversed(steps):  # the class of a page's class
        up = classes.select(F.col("entry").alias("class"), F.col("class").alias("top"))
        folded = step.where("entry <> class").join(up, "class").select("entry", F.col("top").alias("class"))
        classes = classes.union(folded)
    return written(classes, "entry-classes") if steps else classes


def exact_dedup(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, key_bits: int = KEY_BITS,
                held_bytes: int = HELD_BYTES) -> DataFrame:
    """``docs(doc_id, text)`` -> (doc_id, keep_id, group_size, kept, text_sha256), a row per document.

    Texts are equal when their bytes are; a null text counts as empty. Of equal texts the largest doc_id stays. Rows that
    repeat it stay with it; a null doc_id is never the largest, and its rows stay only if no row of the group has one
    (keep_id is null then). Other columns are ignored. No rows give no rows. ``key_bits`` under 63 makes unlike texts
    collide; results don't depend on it.
    """
    with text_batches(docs.sparkSession):
        entries = written(index_entries(docs, key_bits, held_bytes), "entries")
        classes = exact_classes(entries, bucket_bytes)
    held = entries.select("entry", "sha", "ids").join(classes, "entry", "left").withColumn("class", F.coalesce("class", "entry"))
    group = held.groupBy("class").agg(
        F.max(F.array_max("ids")).alias("keep_id"), F.sum(F.size("ids")).cast("long").alias("group_size"))
    out = held.join(group, "class").select(F.explode("ids").alias("doc_id"), "keep_id", "group_size", "sha")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                      F.lower(F.hex("sha")).alias("text_sha256"))
