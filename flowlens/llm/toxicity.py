"""Toxicity: a factorization machine over hashed terms.

score = sigmoid(b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j) over the distinct terms of a text: beside a weight for
each term, pairs of terms (an insult with the mention of a group) have a learned weight of their own. Terms of the model
are those that tell the label alone, and those that tell it in a pair, whatever they tell alone.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import FMClassifier
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import prepare, written

HASH_BITS = 22
#: Bounds of the fit: labelled rows used, terms of the model, factors of a term.
TRAIN_ROWS, TERMS, FACTORS = 20_000, 4096, 4
#: Labelled documents that a term of the model is in, at least.
MIN_DOCS = 5
#: Least chi-squared of a term against the label; below it a rare term is as likely chance.
LEAST_CHI = 15.0
#: Terms whose pairs are tested (the most frequent ones), labelled documents that each of a pair's four cells has at least,
#: and the least squared z of its interaction. There are two million pairs, and copies among the documents.
PAIR_TERMS, PAIR_DOCS, LEAST_PAIR = 2048, 20, 60.0
ROUNDS, STEP, DECAY = 60, 0.05, 1e-4
_WORDS = re.compile(r"[^\W\d_]+").findall
#: Words that a worker remembers.
KNOWN = 1 << 19


def hashed(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) & ((1 << HASH_BITS) - 1)


@dataclass
class Model:
    """The machine: a column for each term hash, and its parameters."""

    terms: list[int]
    bias: float
    weight: np.ndarray
    factor: np.ndarray


class Scorer(dict):
    """Scores of texts; the dictionary maps words to columns of the model, -1 for others."""

    def __init__(self, model: Model):
        self.model = model
        self.column = {t: i for i, t in enumerate(model.terms)}
        self.square = (model.factor ** 2).sum(axis=1)

    def __missing__(self, word: str) -> int:
        if len(self) > KNOWN:
            self.clear()
        self[word] = i = self.column.get(hashed(word), -1)
        return i

    def score(self, text: str) -> float:
        at = set(map(self.__getitem__, set(_WORDS(text.lower()))))
        at.discard(-1)
        z = self.model.bias
        if at:
            i = np.array(sorted(at))
            v = self.model.factor[i].sum(axis=0)
            z += self.model.weight[i].sum() + 0.5 * ((v * v).sum() - self.square[i].sum())
        return 1.0 / (1.0 + math.exp(-min(max(z, -700.0), 700.0)))


def held_out() -> F.Column:
    """Whether crc32 of doc_id as text leaves no remainder by 5; false for a null doc_id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(toxic, terms): labelled documents that are not held out, their distinct term hashes.

    If there are more than ``train_rows`` labels, those with the smallest hash of doc_id are taken.
    """
    prepare(docs)
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("double").alias("toxic"))
    ids = ids.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = text.join(F.broadcast(ids), "doc_id").select("toxic", "text")  # at most train_rows short rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms = [sorted({hashed(w) for w in set(_WORDS(t.lower()))}) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(terms, pa.list_(pa.int32()))], names=["toxic", "terms"])

    return rows.mapInArrow(run, "toxic double, terms array<int>")


def pair_terms(rows: DataFrame, frequent: list[int], least: float = LEAST_PAIR) -> list[int]:
    """Terms of ``frequent`` in a pair whose interaction tells the label of the training rows.

    For a pair, the documents with both, one, the other and neither have shares of the label p11, p10, p01 and p00; an
    additive model has p11 - p10 - p01 + p00 = 0. One task counts all pairs, by products of term matrices; its work is
    bounded by the training rows and ``frequent``.
    """
    spark = prepare(rows)
    order = np.sort(np.array(frequent, np.int64))
    shared = spark.sparkContext.broadcast(order)  # PAIR_TERMS numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        k, n, pos = len(terms), 0.0, 0.0
        both, hits = np.zeros((k, k), np.float32), np.zeros((k, k), np.float32)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                lists = part.column(1)
                own = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                term = lists.flatten().to_numpy(zero_copy_only=False)
                col = np.minimum(np.searchsorted(terms, term), k - 1)
                known = terms[col] == term
                x = np.zeros((part.num_rows, k), np.float32)
                x[own[known], col[known]] = 1
                y = part.column(0).to_numpy(zero_copy_only=False).astype(np.float32)
                both += x.T @ x
                hits += x[y > 0].T @ x[y > 0]
                n, pos = n + part.num_rows, pos + float(y.sum())
        found: list[int] = []
        if k and 0 < pos < n:
            one, one_hit = np.diag(both).copy(), np.diag(hits).copy()
            cells = [(both, hits), (one[:, None] - both, one_hit[:, None] - hits), (one[None, :] - both, one_hit[None, :] - hits),
                     (n - one[:, None] - one[None, :] + both, pos - one_hit[:, None] - one_hit[None, :] + hits)]
            with np.errstate(divide="ignore", invalid="ignore"):
                share = [h / c for c, h in cells]
                z = (share[0] - share[1] - share[2] + share[3]) ** 2 / (pos / n * (1 - pos / n) * sum(1 / c for c, _ in cells))
            tested = np.minimum.reduce([c for c, _ in cells]) >= PAIR_DOCS
            found = terms[(np.where(tested, z, 0.0) >= least).any(axis=1)].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["term"])

    return sorted(r[0] for r in rows.select("toxic", "terms").coalesce(1).mapInArrow(run, "term long").collect())


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, terms: int = TERMS) -> Model:
    """Fit on at most ``train_rows`` labelled documents, over the ``terms`` term hashes that tell the labels apart best, and
    those of the ``PAIR_TERMS`` most frequent ones that do so in a pair.

    Without a label of either kind the model gives every text the same score: 0, or 1 if all labels are 1.
    """
    rows = written(training_rows(docs, labels, train_rows), "training")
    n, pos = rows.agg(F.count("*"), F.sum("toxic")).first()
    if not n or not pos or pos == n:
        return Model([], 700.0 if n and pos == n else -700.0, np.zeros(0), np.zeros((0, FACTORS)))
    share = pos / n
    seen = rows.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(
        F.count("*").alias("n"), F.sum("toxic").alias("pos")).where(F.col("n") >= MIN_DOCS)
    # chi-squared of the term against the label
    chi = n * F.pow(F.col("pos") - F.col("n") * share, 2) / (F.col("n") * share * (1 - share) * (n - F.col("n")))
    best = [r[0] for r in seen.where((F.col("n") < n) & (chi >= LEAST_CHI)).orderBy(chi.desc(), "term").limit(terms).select("term").collect()]
    frequent = [r[0] for r in seen.where(F.col("n") < n).orderBy(F.col("n").desc(), "term").limit(PAIR_TERMS).select("term").collect()]
    best += sorted(set(pair_terms(rows, frequent)) - set(best))
    if not best:
        return Model([], math.log(share / (1 - share)), np.zeros(0), np.zeros((0, FACTORS)))
    column = {t: i for i, t in enumerate(best)}
    vector = F.udf(lambda ts: Vectors.sparse(len(column), {column[t]: 1.0 for t in ts if t in column}), VectorUDT())
    data = written(rows.select(F.col("toxic").alias("label"), vector("terms").alias("features")), "vectors").coalesce(12).persist()
    fm = FMClassifier(factorSize=FACTORS, maxIter=ROUNDS, stepSize=STEP, regParam=DECAY, solver="adamW", seed=7, tol=1e-7)
    model = fm.fit(data)
    data.unpersist()
    return Model(best, float(model.intercept), model.linear.toArray(), model.factors.toArray())


def score_column(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with _fl_score: all its rows and columns, in the partitions they are in."""
    spark = prepare(docs)
    shared = spark.sparkContext.broadcast(model)  # TERMS x (FACTORS + 1) numbers
    at = docs.columns.index("text")
    names = [*docs.columns, "_fl_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            score = [scorer.score(t or "") for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, pa.float64())], names=names)

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("_fl_score", DoubleType())]))


def toxicity_scores(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from a score of 0.5) of every document.

    Null and empty texts get the model's bias as any text without known terms. Repeated rows and null ids are rows like
    others (a null id is not held out and never trained on); other columns are ignored; no rows give no rows.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = score_column(src, train(docs, labels, train_rows))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("_fl_score").alias("score"),
                         (F.col("_fl_score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with all their columns."""
    return score_column(docs, train(docs, labels)).where("_fl_score < 0.5").drop("_fl_score")
