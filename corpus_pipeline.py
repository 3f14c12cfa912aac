"""A corpus run: documents pass quality, near-duplicate, repeated-text and benchmark stages and are encoded at the end."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paywright.llm import decontaminate, ngram_join, piece_codec, quality, suffix_dedup
from paywright.llm.common import ship, table
from paywright.session import scratch_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; those without a text go."""
    ship(spark)
    scored = quality.score(docs, table(spark, sf_dir, "labels"), keep=COLUMNS)
    return scored.where((F.col("predicted") == 1) & (F.length("text") > 0)).select(*COLUMNS)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies; rows that repeat it go, rows without an id stay."""
    ship(spark)
    first = ngram_join.similar(docs.where(F.col("doc_id").isNotNull())).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where(F.col("doc_id").isNull())).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 100 bytes that stand earlier; those of which nothing is left go."""
    ship(spark)
    cut = suffix_dedup.dedup_texts(docs.select(*COLUMNS))
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).where("n_chars > 0").select(*COLUMNS)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    ship(spark)
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and their decoding, as digests."""
    ship(spark)
    return piece_codec.code_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("near-duplicates", keep_distinct),
    ("repeated-text", cut_repeats),
    ("decontamination", keep_clean),
    ("encoding", encode),
]

#: No stage can be stated in SQL; the tests compare the run with brute force on a small fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written to the shared folder and read again by the next one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
