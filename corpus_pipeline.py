"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir). All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import bpe, lines, mix, queries, simhash, toxicity
from flowlens.llm.common import read_table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores at 0.5 or more go."""
    return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay in the smallest doc_id only; a document that loses all its lines stays, empty."""
    kept = lines.drop_repeated_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by SimHash fingerprints (4-word shingles, 4 bits) the smallest doc_id stays."""
    return simhash.drop_near_copies(docs, shingle=4, max_bits=4)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix: sorted files, as a reader takes them."""
    mixed = mix.mix_sources(docs, queries.SHARES, queries.OTHER_SHARE)
    return mixed.orderBy("_fl_slot", "_fl_pos").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of the ids and of the text they decode to, and its place in the mix.

    Readers pack files by size, so the order of the mix is worked out again: a place depends on the rows alone.
    """
    mixed = mix.mix_sources(docs, queries.SHARES, queries.OTHER_SHARE)
    placed = mixed.select("doc_id", "text", F.col("_fl_slot").alias("slot"), F.col("_fl_pos").alias("pos"))
    return bpe.encode_documents(placed, public_tokenizers.path(queries.TOKENIZER), public_tokenizers.PATTERN, keep=["slot", "pos"])


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("simhash_near_dedup", drop_near_copies),
          ("mix_sources", mix_sources), ("byte_bpe", encode)]

#: The toxicity stage trains a model, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
