"""SimHash near-dedup: fingerprints of word shingles, linked by multi-index hashing.

A link needs at most ``max_bits`` = 4 differing bits. The 64 bits are cut into three segments; if two fingerprints
differ in at most four bits then the first or the second segment differs in at most one bit, or the third in none. So a
fingerprint goes into the table once for each segment, and looks up the Hamming ball of radius 1 around its first and
its second segment, and the third as it is. Every match is verified over all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, shuffle_partitions, written
from .graph import connected_components

SEED = 42
#: (first bit, bits, radius) by level; the second level cuts the bits that the first one left over.
SEGMENTS = ((0, 22, 1), (22, 21, 1), (43, 21, 0))
REST = ((0, 15, 1), (15, 14, 1), (29, 14, 0))
MAX_BITS = 4
#: Rows of one table key that a task compares at once; larger groups are cut again by the remaining bits.
GROUP_ROWS = 8192
_PAIRS = 1 << 20


def fingerprint(text: bytes | None, shingle: int) -> int:
    """64-bit SimHash of a UTF-8 text: majority of the bits of the XXH64 of its word shingles (no word: 0)."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and exactly the separators \x20 \x09-\x0D
    n = len(words)
    if n == 0:
        return 0
    line = b" ".join(words)
    if n < shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    length = np.fromiter(map(len, words), np.int64, n)
    end = np.cumsum(length + 1) - 1
    start = (end - length)[:n - shingle + 1].tolist()
    end = end[shingle - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    count, total = np.zeros(64, np.int64), len(start)
    for k in range(0, total, 65536):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(start[k:k + 65536], end[k:k + 65536], strict=True)], ">u8")
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > total).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text as a signed long; a null text counts as empty."""
    prepare(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            fp = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return src.mapInArrow(run, "doc_id long, fp long")


def _keyed(rows: DataFrame, value, segments, keep: list[str], first: int = 0) -> DataFrame:
    """A table row (own) for each segment of ``value``, and a visiting row for each key in its Hamming ball."""
    entries = []
    for s, (start, bits, radius) in enumerate(segments):
        tag = (first + s) << 40
        key = F.shiftrightunsigned(value, start).bitwiseAND((1 << bits) - 1).bitwiseOR(F.lit(tag).cast("long"))
        entries.append(F.array(F.struct(key.alias("key"), F.lit(True).alias("own"))))
        if radius:
            entries.append(F.array(*[F.struct(key.bitwiseXOR(F.lit(1 << i).cast("long")).alias("key"),
                                              F.lit(False).alias("own")) for i in range(bits)]))
    return rows.select(*keep, F.explode(F.concat(*entries)).alias("e")).select(*keep, "e.key", "e.own")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges between the nodes ``a`` and ``b`` -> as few edges with the same components (node, smallest node)."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(label[x], label[y]):
            break
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def group_links(fp: np.ndarray, own: np.ndarray, start: np.ndarray, end: np.ndarray,
                max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within groups [start, end) of rows, own rows first: own with every later row, verified; as a forest."""
    members = np.add.reduceat(own.astype(np.int64), start) if len(start) else start
    group = np.repeat(np.arange(len(start)), members)
    first = np.arange(len(group)) - np.repeat(np.cumsum(members) - members, members) + start[group]
    later = end[group] - first - 1
    found_a, found_b, held = [], [], 0
    k = 0
    ends = np.cumsum(later)
    while k < len(first):
        stop = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + _PAIRS, "right")))
        n = later[k:stop]
        i = np.repeat(first[k:stop], n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        x = fp[i] ^ fp[j]
        hit = (x != 0) & (np.bitwise_count(x) <= max_bits)
        found_a.append(fp[i[hit]])
        found_b.append(fp[j[hit]])
        held += len(found_a[-1])
        if held > _PAIRS:
            a, b = forest(np.concatenate(found_a), np.concatenate(found_b))
            found_a, found_b, held = [a], [b], 0
        k = stop
    if not found_a:
        return fp[:0], fp[:0]
    return forest(np.concatenate(found_a), np.concatenate(found_b))


def _matched(rows: DataFrame, max_bits: int, group_rows: int | None) -> DataFrame:
    """Rows (outer, key, fp, own) -> (outer, a, b): links as a forest, b set; rows of groups that are too large, b null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(o, a, b) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(o), pa.array(a.view(np.int64)), b], names=["outer", "a", "b"])

        def links(o, k, fp, own):
            if not len(k):
                return
            start = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (o[1:] != o[:-1])])
            a, b = group_links(fp, own, start, np.r_[start[1:], len(k)], max_bits)
            if len(a):
                yield out(np.zeros(len(a), np.int64), a, pa.array(b.view(np.int64)))

        held: list[tuple] = []
        large = None  # the group that is being passed on
        for batch in batches:
            o, k, fp, own = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            held.append((o, k, fp.view(np.uint64), own))
            o, k, fp, own = (np.concatenate(x) for x in zip(*held, strict=True))
            if not len(k):
                held = []
                continue
            if large is not None:
                more = int(np.argmin((k == large[0]) & (o == large[1]))) if not ((k == large[0]) & (o == large[1])).all() else len(k)
                if more:
                    yield out(k[:more].copy(), fp[:more], pa.nulls(more, pa.int64()))
                o, k, fp, own = o[more:], k[more:], fp[more:], own[more:]
                if not len(k):
                    held = []
                    continue
                large = None
            last = int(np.flatnonzero((k != k[-1]) | (o != o[-1]))[-1]) + 1 if ((k != k[-1]) | (o != o[-1])).any() else 0
            yield from _split(o[:last], k[:last], fp[:last], own[:last], links, out)
            o, k, fp, own = o[last:], k[last:], fp[last:], own[last:]
            if group_rows and len(k) > group_rows:
                yield out(k.copy(), fp, pa.nulls(len(k), pa.int64()))
                large, held = (k[0], o[0]), []
            else:
                held = [(o, k, fp, own)]
        for o, k, fp, own in held:
            yield from _split(o, k, fp, own, links, out)

    def _split(o, k, fp, own, links, out):
        if not group_rows or len(k) <= group_rows:
            yield from links(o, k, fp, own)
            return
        start = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (o[1:] != o[:-1])])
        n = np.diff(np.r_[start, len(k)])
        big = np.repeat(n > group_rows, n)
        if big.any():
            yield out(k[big], fp[big], pa.nulls(int(big.sum()), pa.int64()))
        yield from links(o[~big], k[~big], fp[~big], own[~big])

    parts = max(shuffle_partitions(rows.sparkSession), 1)
    dealt = rows.repartition(parts, "outer", "key").sortWithinPartitions("outer", "key", F.col("own").desc())
    return dealt.mapInArrow(run, "outer long, a long, b long")


def link_fingerprints(fps: DataFrame, max_bits: int = MAX_BITS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``fps(fp)``, distinct -> (a, b): edges that connect just the fingerprints linked at ``max_bits`` or fewer bits.

    Tasks read their part of the table key by key. A key with more than ``group_rows`` rows is not compared there: its
    rows go on to a second table, by the key and the segments of the bits outside it, so that no task compares all rows
    of a frequent segment with each other. Only a spanning forest of the links leaves a task, never all pairs.
    """
    if max_bits > 4:
        raise ValueError("the segments guarantee links of at most 4 differing bits")
    prepare(fps)
    first = _keyed(fps, F.col("fp"), SEGMENTS, ["fp"]).select(F.lit(0).cast("long").alias("outer"), "key", "fp", "own")
    found = written(_matched(first, max_bits, group_rows), "links")
    left = found.where("b IS NULL").select(F.col("outer"), F.col("a").alias("fp")).distinct()
    links = found.where("b IS NOT NULL").select("a", "b")
    if left.isEmpty():
        return links
    segment = F.shiftright("outer", 40)
    rest = (F.when(segment == 0, F.shiftrightunsigned("fp", 22))
            .when(segment == 1, F.col("fp").bitwiseAND((1 << 22) - 1).bitwiseOR(
                F.shiftleft(F.shiftrightunsigned("fp", 43), 22)))
            .otherwise(F.col("fp").bitwiseAND((1 << 43) - 1)))
    again = _keyed(left.withColumn("rest", rest), F.col("rest"), REST, ["outer", "fp"]).select("outer", "key", "fp", "own")
    return links.union(_matched(again, max_bits, None).where("b IS NOT NULL").select("a", "b"))


def simhash_components(docs: DataFrame, shingle: int = 4, max_bits: int = MAX_BITS,
                       group_rows: int = GROUP_ROWS) -> DataFrame:
    """``docs(doc_id, text)`` -> (doc_id, fingerprint, component_id), a row per document.

    The component is the smallest doc_id reachable over links of at most ``max_bits`` bits. Null or empty texts have
    fingerprint zero and link like any other. Rows with equal doc_id stay rows of their own; a null doc_id is never the
    smallest (a component of null ids only has a null component_id). Other columns are ignored; no rows give no rows.
    """
    fp = written(fingerprints(docs, shingle), "fingerprints")
    distinct = written(fp.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    roots = connected_components(link_fingerprints(distinct.select("fp"), max_bits, group_rows))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "rooted")
    low = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = written(rooted.join(low, "root").select("fp", "component_id"), "named")
    return fp.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, shingle: int = 4, max_bits: int = MAX_BITS) -> DataFrame:
    """Keep the document with the smallest doc_id of every component, with all its columns.

    Rows that repeat that doc_id stay with it; rows without a doc_id stay only if no row of their component has one.
    """
    keep = simhash_components(docs, shingle, max_bits).where("doc_id <=> component_id").select("doc_id").distinct()
    return docs.join(keep.withColumnRenamed("doc_id", "_fl_keep"), F.col("doc_id").cast("long").eqNullSafe(
        F.col("_fl_keep")), "left_semi")
