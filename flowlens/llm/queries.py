"""The registered queries of this subpackage, with production parameters, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, exact, fingerprint, lines, merkle, mix, simhash, spelling, sql, substring, toxicity, warc
from .common import new_path, read_table

TOKENIZER = "byte_bpe_multi_50k.tiktoken"
#: Shares of the mix by source; all other sources together get OTHER_SHARE.
SHARES = {"src0": 48, "src1": 16, "src2": 16, "src3": 16, "src4": 16, "src5": 12, "src6": 12, "src7": 12, "src8": 12,
          "src9": 12, "src10": 10, "src11": 10, "src12": 10, "src13": 10, "src14": 10, "src15": 8, "src16": 8,
          "src17": 8, "src18": 8, "src19": 8}
OTHER_SHARE = 8


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(read_table(spark, sf_dir, "documents"), shingle=4, max_bits=4)


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.document_fingerprints(read_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER),
                                public_tokenizers.PATTERN).drop("ids")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.drop_repeated_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", F.col("_fl_lines").alias("n_lines"), F.col("_fl_dropped").alias("n_dropped"),
                       F.sha2("text", 256).alias("kept_sha256"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_warc(read_table(spark, sf_dir, "pages"), path)
    page = lambda c: F.regexp_extract(c, "^<urn:x-page:(.*)>$", 1).try_cast("long")
    return warc.read_warc(spark, path, payload=False).select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix.mix_sources(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), SHARES, OTHER_SHARE)
    return mixed.select("doc_id", "source", F.col("_fl_block").alias("block"), F.col("_fl_slot").alias("slot"),
                        F.col("_fl_pos").alias("pos"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(read_table(spark, sf_dir, "embeddings"), every=20, k=20)


def op9_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["start"], m["end"])), ",")
    return chat.rotate_perspectives(read_table(spark, sf_dir, "conversations")).select(
        "conv_id", "speaker", "part", "slice", "n_turns", "text", spans.alias("mask"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(read_table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read_table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.merkle_manifest(read_table(spark, sf_dir, "documents"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_simhash_near_dedup, op2_document_fingerprints, op3_toxicity, op4_byte_bpe, op5_line_dedup,
        op6_warc, op7_mix_sources, op8_nearest_neighbours, op9_chat_perspectives, op10_substring_dedup,
        op11_spelling_variants, op12_merkle_manifest, op13_exact_dedup)}

#: DuckDB SQL for the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op5_line_dedup": sql.LINE_DEDUP, "op9_chat_perspectives": sql.CHAT,
    "op7_mix_sources": sql.mix(SHARES, OTHER_SHARE, mix.BLOCK_DOCS, "mix"),
    "op11_spelling_variants": sql.SPELLING, "op12_merkle_manifest": sql.MERKLE, "op13_exact_dedup": sql.EXACT}
