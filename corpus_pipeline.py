"""From raw documents to encoded training text, in stages that each write a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlens.llm import bpe, mixing, near_dedup, quality_rules, secret_scan
from chatlens.llm.queries import tokenizer_path
from chatlens.llm.texts import table
from chatlens.session import materialise, remove_stored, scratch_path, stored_tables

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood threshold; the others go."""
    judged = quality_rules.judge(docs.select(*DOCUMENT), table(spark, sf_dir, "labels"))
    return judged.filter("kept").select(*DOCUMENT)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates; rows without an id stay.

    Of rows with one id and one text, one stays.
    """
    gone = near_dedup.near_duplicates(docs).filter(~F.col("kept")).select("doc_id")
    kept = docs.select(*DOCUMENT).join(gone, "doc_id", "left_anti")
    repeated = materialise(
        docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "pipeline-repeated")
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id", "text").agg(
        F.min(F.struct(*DOCUMENT[2:])).alias("_rest")).select("doc_id", "text", "_rest.*")
    return kept.join(repeated, "doc_id", "left_anti").unionByName(once)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with each secret replaced by a mark and n_chars counted anew where one was."""
    found = secret_scan.redact(secret_scan.find_secrets(docs.select(*DOCUMENT)))
    masked = F.when(F.size("spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", masked).select(*DOCUMENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix takes, as often as it takes them."""
    return mixing.mix(docs.select(*DOCUMENT))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row's text, and whether they decode to it."""
    coded = bpe.encode_and_decode(docs.select(*DOCUMENT), tokenizer_path())
    return coded.select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", drop_low_quality),
    ("near_dedup", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("bpe", encode_texts),
]

# Hashed likelihood ratios and balanced sampling have no SQL form; tests/llm compares the
# pipeline with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored and read by the next stage.

    What a stage stores on the way is deleted with its end, and its result when the next one is
    there; only the input of the last stage stays.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        with stored_tables(spark):
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
        if before:
            remove_stored(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
