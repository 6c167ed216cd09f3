"""Agency per message, its summary, histogram and examples."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlens import fixed_values as fv
from chatlens.functions.text import count_in, escape_cell, evaluated_once, is_blank, latin_words, strip, truncate_tokens
from chatlens.operators.joins import exact_median
from chatlens.operators.scoring import score_texts

MODEL_RESULT = T.StructType([T.StructField("agency_score", T.DoubleType())])


def score_by_words(
    messages: DataFrame, text_col: str,
    agentic: Sequence[str] = fv.AGENTIC_WORDS, passive: Sequence[str] = fv.PASSIVE_WORDS,
    scale: float = fv.AGENCY_SCALE,
) -> DataFrame:
    """The built-in scorer: scaled share of agentic minus passive words in -1 … 1."""
    df = evaluated_once(messages, _words=latin_words(F.col(text_col)))
    df = evaluated_once(df, _p=count_in(F.col("_words"), agentic), _n=count_in(F.col("_words"), passive))
    raw = (F.col("_p") - F.col("_n")) / F.greatest(F.size("_words"), F.lit(1)) * scale
    score = F.when(~is_blank(F.col(text_col)), F.greatest(F.least(raw, F.lit(1.0)), F.lit(-1.0)))
    return df.withColumn("agency_score", score).drop("_words", "_p", "_n")


def agency_messages(
    long: DataFrame,
    load_model: Callable[[], Any] | None = None,
    batch_size: int = fv.AGENCY_BATCH_SIZE,
    max_tokens: int = fv.AGENCY_MAX_TOKENS,
    high: float = fv.AGENCY_HIGH,
    low: float = fv.AGENCY_LOW,
    **word_lists: Sequence[str],
) -> DataFrame:
    """Score every message of the role-long table; blank messages get null score and flags."""
    rows = evaluated_once(long, _input=truncate_tokens(strip(F.col("text")), max_tokens))
    if load_model is None:
        scored = score_by_words(rows, "_input", **word_lists)
    else:
        rows = rows.withColumn("_input", F.nullif("_input", F.lit("")))
        scored = score_texts(rows, "_input", load_model, MODEL_RESULT, batch_size)
    return scored.select(
        F.concat_ws("_", "role", F.col("row_index").cast("string")).alias("message_id"),
        "row_index", F.col("role").alias("message_role"),
        *[c for c in ("datetime", "whatsapp_id") if c in long.columns],
        "text_original", F.col("text").alias("text_translated"), "agency_score",
        (F.col("agency_score") >= high).alias("is_high"),
        (F.col("agency_score") <= low).alias("is_low"),
    )


def agency_summary(scored: DataFrame) -> DataFrame:
    """Per role: messages, scored messages, mean, median, share high and low.

    The exact median needs several passes, so pass a stored table.
    """
    def share(flag: str):
        return F.round(F.avg(F.col(flag).cast("int")) * 100, 1)

    base = scored.groupBy("message_role").agg(
        F.count("message_id").alias("total_messages"),
        F.count("agency_score").alias("scored_messages"),
        F.round(F.avg("agency_score"), 3).alias("mean_agency"),
        share("is_high").alias("pct_high"),
        share("is_low").alias("pct_low"),
    )
    median = exact_median(scored, ["message_role"], "agency_score", "median_agency")
    return base.join(median, "message_role", "left").select(
        F.initcap("message_role").alias("message_role"), "total_messages", "scored_messages", "mean_agency",
        F.round("median_agency", 3).alias("median_agency"), "pct_high", "pct_low",
    )


def agency_histogram(scored: DataFrame, bins: int = fv.HISTOGRAM_BINS) -> DataFrame:
    """Messages per role and equal-width bin over the joint range; the last bin is closed.

    Reads ``scored`` twice (range, then bins), so pass a stored table.
    """
    rows = scored.filter(F.col("agency_score").isNotNull())
    bounds = rows.agg(F.struct(F.min("agency_score").alias("low"), F.max("agency_score").alias("high"))).scalar()
    low, high = bounds["low"], bounds["high"]
    width = (high - low) / bins
    position = F.when(high == low, 1).otherwise(F.least(F.floor((F.col("agency_score") - low) / width) + 1, F.lit(bins)))
    return rows.groupBy("message_role", position.cast("int").alias("bin")).agg(F.count("*").alias("messages"))


def _ranked(rows: DataFrame, order: list, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("message_role").orderBy(*order))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= n).select(
        "message_role", "rank", "message_id", "agency_score", escape_cell(F.col("text_translated")).alias("message")
    )


def agency_top(scored: DataFrame, n: int = 5, lowest: bool = False) -> DataFrame:
    """The ``n`` messages of each role with the highest (or lowest) score."""
    rows = scored.filter(F.col("agency_score").isNotNull())
    first = F.asc("agency_score") if lowest else F.desc("agency_score")
    return _ranked(rows, [first, F.asc("row_index")], n)


def agency_neutral_sample(
    scored: DataFrame, n: int = 5, band: float = fv.AGENCY_NEUTRAL_BAND, seed: int = fv.SAMPLE_SEED
) -> DataFrame:
    """A repeatable random sample of near-neutral messages per role.

    The order is a hash of seed and message id, so it does not depend on how
    the rows are partitioned.
    """
    rows = scored.filter(F.abs("agency_score") <= band)
    shuffle = F.md5(F.concat_ws(":", F.lit(str(seed)), "message_id"))
    return _ranked(rows, [shuffle, F.asc("row_index")], n)


def concat_roles(*frames: DataFrame) -> DataFrame:
    """Stack role tables; a column missing in one of them becomes null."""
    out, *rest = frames
    for frame in rest:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out
