"""The queries of this subpackage: one per operator, over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keytide.llm import blockdedup, idpack, interleave, licenses, linefreq, mixture, oracle, packing, simhash, tokcount, warc


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return warc.read_files(*warc.write_files(warc.derivatives(warc.responses(pages))))


def op2_bit_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idpack.read_ids(*idpack.write_ids(_docs(spark, sf_dir)))


def op3_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linefreq.judge(_docs(spark, sf_dir))


def op4_interleaved_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave.of_documents(_docs(spark, sf_dir))


def op5_simhash_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_docs(spark, sf_dir))


def op6_fixed_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blockdedup.remove_repeats(_docs(spark, sf_dir)).drop("spans")


def op7_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op8_heap_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokcount.token_counts(_docs(spark, sf_dir))


def op9_order_preserving_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir), with_ids=False)


def op10_signature_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_docs(spark, sf_dir)).drop("detections")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_warc_derivatives, op2_bit_packed_ids, op3_line_frequency, op4_interleaved_sequences, op5_simhash_segments, op6_fixed_block_anchors, op7_water_filling, op8_heap_token_counts,
        op9_order_preserving_packing, op10_signature_rules,
    )
}

#: The others are beyond SQL (tokenizers, PNG, XXH64, ordered patterns); tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op3_line_frequency": oracle.OP3_LINE_FREQUENCY, "op6_fixed_block_anchors": oracle.OP6_FIXED_BLOCK_ANCHORS, "op7_water_filling": oracle.OP7_WATER_FILLING,
}
