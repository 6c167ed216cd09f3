"""Which messages take part in topic modelling, and later corrections to assignments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens import fixed_values as fv
from chatlens.functions.text import clean_message, evaluated_once, is_assistant_like, is_blank, token_count
from chatlens.operators.cleaning import cap_per_role, nonblank
from chatlens.sources.tables import with_row_index

TOPIC = ["message_role", "topic_id"]


def topic_eligible(
    long: DataFrame,
    min_tokens: int = fv.MIN_MESSAGE_TOKENS,
    short_responses: Sequence[str] = fv.SHORT_RESPONSES,
    max_docs: int | None = None,
    dictionary: DataFrame | None = None,
) -> DataFrame:
    """Clean the role-long table and keep the messages worth modelling.

    The cap counts non-blank messages, before cleaning.
    """
    rows = nonblank(long, "text")
    if max_docs is not None:
        rows = cap_per_role(rows, max_docs)
    cleaned = F.col("cleaned")
    if dictionary is None:
        done = clean_message(rows, "text")
    else:
        done = clean_message(with_row_index(rows, "_row"), "text", dictionary=dictionary, id_col="_row").drop("_row")
    return done.filter(
        ~is_blank(cleaned)
        & ~cleaned.isin(list(short_responses))
        & ~is_assistant_like(cleaned)
        & (token_count(cleaned) >= min_tokens)
    )


def filter_trivial(
    docs: DataFrame, text_col: str, min_tokens: int = fv.MIN_MESSAGE_TOKENS,
    short_responses: Sequence[str] = fv.SHORT_RESPONSES,
) -> DataFrame:
    """Short or stock messages become outliers."""
    text = F.coalesce(text_col, F.lit(""))
    trivial = (token_count(text) < min_tokens) | text.isin(list(short_responses))
    return docs.withColumn("topic_id", F.when(trivial, F.lit(-1)).otherwise(F.col("topic_id")))


def topic_quality(docs: DataFrame, text_col: str) -> DataFrame:
    """Per topic: mean tokens of non-blank messages, share of assistant-like ones, and the verdict."""
    sized = evaluated_once(
        docs.filter(F.col("topic_id") != -1), _k=token_count(F.col(text_col)), _a=is_assistant_like(F.col(text_col)).cast("int")
    )
    quality = sized.groupBy(*TOPIC).agg(
        F.coalesce(F.avg(F.when(F.col("_k") > 0, F.col("_k"))), F.lit(0.0)).alias("avg_tokens"),
        F.avg("_a").alias("assistant_share"),
    )
    low = (F.col("avg_tokens") < fv.LOW_QUALITY_TOKENS) | (F.col("assistant_share") > fv.LOW_QUALITY_ASSISTANT_SHARE)
    return quality.withColumn("low_quality", low)
