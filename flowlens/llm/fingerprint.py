"""Document fingerprints by consistent weighted sampling over the words of a text, weighted by their counts.

For sample k and term x with weight w: r and c are Gamma(2, 1), beta is uniform, t = floor(ln w / r + beta) and
ln a = ln c - r (t - beta + 1). The smallest a over all terms is the sample. Two texts agree in a sample with a
probability of their generalised Jaccard similarity (sum of smaller counts by sum of larger counts). Equal (x, t) give
the same a, and different ones give different values, so a itself, cut to 16 bits, stands for the pair.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Rows
from .common import prepare, shuffle_partitions

SAMPLES = 64
SEED = 20240131
#: Terms whose samples a worker remembers (256 bytes each), and terms in one numpy step.
KNOWN, STEP = 1 << 17, 1 << 12


def _mixed(z: np.ndarray) -> np.ndarray:
    """64-bit finalizer of SplitMix64, in place."""
    z ^= z >> np.uint64(30)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z


def _uniform(x: np.ndarray) -> np.ndarray:
    """float32 in (0, 1] of 24-bit numbers."""
    return (x.astype(np.uint32) + np.uint32(1)).astype(np.float32) * np.float32(2.0 ** -24)


class Sampler:
    """Signatures of texts. A term's r, c and beta for sample k are drawn from 128 bits hashed from the term and k."""

    def __init__(self, samples: int = SAMPLES, seed: int = SEED):
        self.k = samples
        self.key = np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, (2, samples), np.uint64)
        self._forget()

    def _forget(self) -> None:
        self.row = Rows()
        self.h = np.empty(0, np.uint64)
        self.once = np.empty((0, self.k), np.float32)

    def _values(self, h: np.ndarray, lnw: np.ndarray | np.float32) -> np.ndarray:
        low, part = np.uint64((1 << 24) - 1), np.uint64(24)
        x, y = _mixed(h[:, None] ^ self.key[0]), _mixed(h[:, None] ^ self.key[1])
        r = -np.log(_uniform(x & low) * _uniform(x >> part & low)) + np.float32(1e-6)
        lnc = np.log(-np.log(_uniform(y & low) * _uniform(y >> part & low)) + np.float32(1e-12))
        beta = _uniform(x >> np.uint64(48) << np.uint64(8) | y >> np.uint64(56))
        t = np.floor(lnw / r + beta) if isinstance(lnw, np.ndarray) else np.floor(beta)
        return lnc - r * ((t - beta) + np.float32(1))

    def _learn(self) -> None:
        if not self.row.new:
            return
        h = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), SEED) for w in self.row.new], np.uint64)
        self.row.new = []
        self.h = np.concatenate([self.h, h])
        once = [self._values(h[k:k + STEP], np.float32(0)) for k in range(0, len(h), STEP)]
        self.once = np.concatenate([self.once, *once])

    def _lowest(self, terms: list[Counter]) -> np.ndarray:
        """The smallest value of each sample for every bag of terms; +inf for an empty bag."""
        find, n = self.row.__getitem__, sum(map(len, terms))
        at = np.fromiter((i for c in terms for i in map(find, c)), np.int64, n)
        count = np.fromiter((f for c in terms for f in c.values()), np.int64, n)
        of = np.repeat(np.arange(len(terms)), [len(c) for c in terms])
        self._learn()
        low = np.full((len(terms), self.k), np.inf, np.float32)
        one = count == 1
        self._reduce(low, of[one], at[one], None)
        self._reduce(low, of[~one], at[~one], np.log(count[~one].astype(np.float64)).astype(np.float32))
        return low

    def _reduce(self, low, of, at, lnw) -> None:
        for k in range(0, len(at), STEP):
            i, d = at[k:k + STEP], of[k:k + STEP]
            v = self.once[i] if lnw is None else self._values(self.h[i], lnw[k:k + STEP, None])
            first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
            low[d[first]] = np.minimum(low[d[first]], np.minimum.reduceat(v, first, axis=0))

    def signatures(self, texts: list[str]) -> np.ndarray:
        """uint16 (texts, samples)."""
        out, bags, held = [], [], 0
        for t in texts:
            bags.append(Counter(t.lower().split()))
            held += len(bags[-1])
            if held > 1 << 18:
                out.append(self._lowest(bags))
                bags, held = [], 0
            if len(self.row) > KNOWN:
                out.append(self._lowest(bags)) if bags else None
                bags, held = [], 0
                self._forget()
        if bags:
            out.append(self._lowest(bags))
        low = np.concatenate(out) if out else np.empty((0, self.k), np.float32)
        bits = low.view(np.uint32).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (bits >> np.uint64(48)).astype(np.uint16)


_SAMPLERS: dict[int, Sampler] = {}


def worker_sampler(samples: int) -> Sampler:
    """The sampler of this Python worker, with the terms that earlier tasks met."""
    if samples not in _SAMPLERS:
        _SAMPLERS.clear()
        _SAMPLERS[samples] = Sampler(samples)
    return _SAMPLERS[samples]


def _buckets(docs: DataFrame) -> tuple[list[float], int | None, bool, int]:
    """Ascending ids that end about equal ranges of doc_id, the largest id, whether ids are null, ranges for those."""
    spark = docs.sparkSession
    n, known, top = docs.agg(F.count("*"), F.count("doc_id"), F.max("doc_id")).first()
    ranges = max(4 * shuffle_partitions(spark), n // 20_000, 1)
    ends = docs.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.1 / ranges) if known else []
    return sorted({e for e in ends if e < float(top)}), top, known < n, ranges


def _below(docs: DataFrame, ends: list[float], out: str, end: bool) -> DataFrame:
    """Add the number of ``ends`` under doc_id (``end``: not over it), by binary search."""
    if not ends:
        return docs.withColumn(out, F.lit(0))
    if end:
        splits, x, count = [float("-inf"), *ends, float("inf")], F.col("doc_id").cast("double"), F.col(out)
    else:  # from above: how many are not under it
        splits, x = [float("-inf"), *[-e for e in reversed(ends)], float("inf")], -F.col("doc_id").cast("double")
        count = F.lit(len(ends)) - F.col(out)
    cut = Bucketizer(splits=splits, inputCol="_id", outputCol=out, handleInvalid="keep")
    return cut.transform(docs.withColumn("_id", x)).withColumn(out, count.cast("int")).drop("_id")


def document_fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprint of every whole text, of its edited text, and their likeness (see the columns below).

    The edited text has the last floor(n / 3) code points replaced by the first as many (or all) of the next document's,
    in descending doc_id; after the last comes the first. Rows with equal doc_id follow each other by text. A row with a
    null doc_id is nobody's next; its own next is the first document (itself, if all ids are null). Null texts are
    empty; an empty text has a fingerprint of its own, alike 1 to empty texts and 0 to others. Other columns are
    ignored, and no rows give no rows.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (4 hex digits a sample), near_edited, near_next.
    """
    prepare(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ends, top, nulls, spare = _buckets(docs)
    # an id that ends a range (ids are those of rows) is the largest of it; range 0 has the largest ids of all
    docs = _below(_below(docs, ends, "_under", False), ends, "_upto", True)
    null = F.col("doc_id").isNull()
    docs = docs.withColumn("bucket", F.when(null, -1 - F.pmod(F.xxhash64("text"), F.lit(spare)).cast("int")).otherwise(
        F.lit(len(ends)) - F.col("_under")))
    # the rows with the largest id of a range also go, as lent rows, to the range before; the very first to the last
    # range, and to those of null ids
    first = F.array(F.lit(len(ends)), *([F.lit(-1 - k) for k in range(spare)] if nulls else []))
    goes = F.when(F.col("doc_id") == F.lit(top).cast("long"), first).when(F.col("_upto") > F.col("_under"), F.array(F.col("bucket") - 1))
    rows = docs.select("doc_id", "text", "bucket", F.lit(False).alias("lent")).unionByName(docs.where(~null).select(
        "doc_id", "text", F.explode(goes).alias("bucket"), F.lit(True).alias("lent")))
    ahead = F.when(F.col("bucket") < 0, ~F.col("lent")).otherwise(F.col("lent"))  # lent rows come last, for null ids first
    rows = rows.withColumn("late", ahead).repartition(shuffle_partitions(docs.sparkSession), "bucket").sortWithinPartitions(
        "bucket", "late", F.col("doc_id").desc(), "text").select("bucket", "lent", "doc_id", "text")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = worker_sampler(samples)
        carry: list[tuple] = []  # the row that waits for its next
        first: tuple | None = None  # for null ids: the first document

        def out(pairs: list[tuple[tuple, tuple]]) -> pa.RecordBatch:
            rows = list({id(x): x for p in pairs for x in p}.values())
            edited = [a[3][:len(a[3]) - len(a[3]) // 3] + b[3][:len(a[3]) // 3] for a, b in pairs]
            sig = sampler.signatures([x[3] for x in rows])
            of = {id(x): i for i, x in enumerate(rows)}
            esig = sampler.signatures(edited)
            own, nxt = sig[[of[id(a)] for a, _ in pairs]], sig[[of[id(b)] for _, b in pairs]]
            hexed = lambda s: [x.tobytes().hex() for x in s.astype(">u2")]
            return pa.RecordBatch.from_arrays([
                pa.array([a[2] for a, _ in pairs], pa.int64()), pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                pa.array(hexed(own), pa.string()), pa.array(hexed(esig), pa.string()),
                pa.array((own == esig).mean(axis=1)), pa.array((own == nxt).mean(axis=1))], names=names)

        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                pairs = []
                for row in zip(*[c.to_pylist() for c in batch.slice(k, 2000).columns], strict=True):
                    if row[0] < 0:
                        if row[1]:
                            first = row if first is None or first[0] != row[0] else first
                        else:
                            pairs.append((row, first if first is not None and first[0] == row[0] else row))
                        continue
                    if carry and carry[0][0] == row[0]:
                        pairs.append((carry[0], row))
                    carry = [] if row[1] else [row]
                if pairs:
                    yield out(pairs)

    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                "edited_fingerprint string, near_edited double, near_next double")
