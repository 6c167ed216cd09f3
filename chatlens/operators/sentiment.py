"""Sentiment per message and its summaries."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlens import fixed_values as fv
from chatlens.functions.text import count_in, evaluated_once, latin_words
from chatlens.operators.cleaning import nonblank
from chatlens.operators.joins import exact_median
from chatlens.operators.scoring import WordTokenizer, score_texts

MODEL_RESULT = T.StructType([
    T.StructField("sentiment_label", T.StringType()), T.StructField("sentiment_score", T.DoubleType()),
])
OUTPUT = ["role", "whatsapp_id", "datetime", "message", "sentiment_label", "sentiment_score", "sentiment_stars"]


def stars_of(label: Column) -> Column:
    """The number in front of a label such as ``4 stars``; null if there is none."""
    return F.get(F.split(label, r"\s+"), F.lit(0)).try_cast("int")


def score_by_words(
    messages: DataFrame, text_col: str,
    positive: Sequence[str] = fv.POSITIVE_WORDS, negative: Sequence[str] = fv.NEGATIVE_WORDS,
) -> DataFrame:
    """The built-in scorer: label and confidence from two word lists."""
    df = evaluated_once(messages, _words=latin_words(F.col(text_col)))
    df = evaluated_once(df, _p=count_in(F.col("_words"), positive), _n=count_in(F.col("_words"), negative))
    hits = F.col("_p") + F.col("_n")
    df = df.withColumn("_polarity", F.when(hits == 0, 0.0).otherwise((F.col("_p") - F.col("_n")) / hits))
    stars = (F.lit(3) + F.round(F.col("_polarity") * 2)).cast("int").cast("string")
    label = F.when(stars == "1", "1 star").otherwise(F.concat(stars, F.lit(" stars")))
    return df.withColumn("sentiment_label", label).withColumn(
        "sentiment_score", (F.abs("_polarity") + 1) / 2
    ).drop("_words", "_p", "_n", "_polarity")


def sentiment_messages(
    long: DataFrame,
    load_model: Callable[[], Any] | None = None,
    batch_size: int = fv.SENTIMENT_BATCH_SIZE,
    max_tokens: int | None = fv.SENTIMENT_MAX_TOKENS,
    load_tokenizer: Callable[[], Any] = WordTokenizer,
    **word_lists: Sequence[str],
) -> DataFrame:
    """Score every non-blank message; with no model the word lists are used.

    A model sees at most ``max_tokens`` tokens of a message, counted by its tokenizer; the word
    lists look at the whole message.
    """
    rows = nonblank(long, "text")
    scored = (
        score_by_words(rows, "text", **word_lists) if load_model is None
        else score_texts(rows, "text", load_model, MODEL_RESULT, batch_size, max_tokens=max_tokens, load_tokenizer=load_tokenizer)
    )
    return scored.withColumn("sentiment_stars", stars_of(F.col("sentiment_label"))).withColumnRenamed(
        "text", "message"
    ).select(OUTPUT)


def sentiment_counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy("role", "sentiment_label").agg(F.count("*").alias("messages"))


def sentiment_overview(scored: DataFrame, labels: Sequence[str] = fv.SENTIMENT_LABELS) -> DataFrame:
    """Per role: rows, mean and median score, mean stars, one count column per label.

    The exact median needs several passes, so pass a stored table.
    """
    rows = nonblank(scored, "message")
    label_counts = [
        F.nullif(F.count_if(F.col("sentiment_label") == label), F.lit(0)).alias("count_" + label.replace(" ", "_"))
        for label in labels
    ]
    means = rows.groupBy("role").agg(
        F.count("*").alias("messages"),
        F.avg("sentiment_score").alias("mean_score"),
        F.avg("sentiment_stars").alias("mean_stars"),
        *label_counts,
    )
    median = exact_median(rows, ["role"], "sentiment_score", "median_score")
    order = ["role", "messages", "mean_score", "median_score", "mean_stars"]
    return means.join(median, "role", "left").select(*order, *[c for c in means.columns if c not in order])


def sentiment_top_labels(scored: DataFrame, top: int = 3) -> DataFrame:
    """The most frequent labels of each role and their share."""
    counts = sentiment_counts(scored)
    role = Window.partitionBy("role")
    return (
        counts.withColumn("share", F.col("messages").cast("double") / F.sum("messages").over(role))
        .withColumn("rank", F.row_number().over(role.orderBy(F.desc("messages"), "sentiment_label")))
        .filter(F.col("rank") <= top)
    )
