"""The corpus pipeline: quality rules, near-dedup, substring dedup, mixing and packing, each by an operator of keytide.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read as the next stage's
docs. All but the last return the columns of documents, and any others that docs came with.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytide.llm import blockdedup, linefreq, mixture, packing, simhash
from keytide.llm.common import stored


def _restored(rows: DataFrame, docs: DataFrame, text: str | None = None) -> DataFrame:
    """The columns of docs from the struct `row`; with text, a column of rows that takes the text's place, and its length n_chars."""
    columns = []
    for c in docs.columns:
        if text and c == "text":
            columns.append(F.col(text).alias("text"))
        elif text and c == "n_chars":
            columns.append(F.when(F.col(text).isNotNull(), F.length(text)).cast(docs.schema[c].dataType).alias("n_chars"))
        else:
            columns.append(F.col("row").getField(c).alias(c))
    return rows.select(*columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; the others lose the lines that are too frequent on their host."""
    judged = linefreq.judge(docs, copies_once=True, keep_rows=True).where("kept")
    return _restored(judged, docs, "clean_text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id: sets of 5-word shingles with a similarity of 0.8 or more."""
    return _restored(simhash.near_duplicates(docs, shingle=5, similarity=0.8, keep_rows=True).where("first"), docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go, at every place; documents of which nothing is left go too."""
    cut = blockdedup.remove_repeats(docs, keep_rows=True).where("n_removed < n_words OR n_words = 0")
    return _restored(cut, docs, "clean_text")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix holds it."""
    mixed = mixture.mix(docs, keep_rows=True).where("copies > 0")
    return _restored(mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens, with their ids."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing", mixing),
    ("packing", packed),
]

#: Byte-pair encoding, minimum-cost packing and components of a graph are beyond SQL: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"), "snappy")
    return STAGES[-1][1](spark, docs, sf_dir)
