"""Timelines, per-user and per-state counts, message lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens import schemas
from chatlens.functions.text import is_blank, iso_datetime, token_count
from chatlens.operators.cleaning import valid_datetime
from chatlens.sources.tables import empty_table


def messages_by_date(messages: DataFrame, column: str = "datetime") -> DataFrame:
    dated = valid_datetime(messages, column)
    return dated.groupBy(F.to_date(column).alias("date")).agg(F.count("*").alias("messages"))


def messages_by_hour(messages: DataFrame, column: str = "datetime") -> DataFrame:
    dated = valid_datetime(messages, column)
    return dated.groupBy(F.hour(column).alias("hour")).agg(F.count("*").alias("messages"))


def datetime_overview(messages: DataFrame) -> DataFrame:
    """One row: totals, first and last time, day span, and the counts by date.

    The dates are aggregated first, so the nested list holds one entry per
    calendar day and the distinct users come from a two-stage aggregate.
    """
    when = F.col("datetime").try_cast("timestamp_ntz")
    totals = messages.agg(
        F.count("*").alias("total_messages"),
        F.count_distinct("whatsapp_id").alias("unique_users"),
        F.min(when).alias("_first"),
        F.max(when).alias("_last"),
    )
    by_date = messages_by_date(messages).agg(
        F.array_sort(F.collect_list(F.struct(F.col("date").cast("string").alias("date"), "messages")))
    ).scalar()
    return totals.select(
        "total_messages", "unique_users",
        iso_datetime(F.col("_first")).alias("start_datetime"),
        iso_datetime(F.col("_last")).alias("end_datetime"),
        (F.extract(F.lit("DAY"), F.col("_last") - F.col("_first")) + 1).cast("int").alias("total_days"),
        by_date.alias("messages_by_date"),
    )


def cal_state_by_user(messages: DataFrame) -> DataFrame:
    if not {"cal_state", "whatsapp_id"} <= set(messages.columns):
        return empty_table(messages.sparkSession, schemas.CAL_STATE_BY_USER)
    state = F.coalesce("cal_state", F.lit("Unknown")).alias("cal_state")
    return messages.groupBy("whatsapp_id", state).agg(F.count("*").alias("message_count"))


def cal_state_sorted(counts: DataFrame) -> DataFrame:
    """The order of the exported table: by user, then by count downwards."""
    return counts.orderBy("whatsapp_id", F.desc("message_count"), "cal_state")


def cal_state_share(by_user: DataFrame) -> DataFrame:
    """Messages per state and their share in percent."""
    total = by_user.agg(F.sum("message_count")).scalar()
    counts = by_user.groupBy("cal_state").agg(F.sum("message_count").alias("message_count"))
    return counts.withColumn("share_pct", F.col("message_count").cast("double") / total * 100)


def message_stats(long: DataFrame) -> DataFrame:
    """Per role: non-blank messages, mean and median characters and tokens.

    Blank messages count as length 0. The exact medians keep one counter per
    distinct length, and lengths are bounded by the longest message.
    """
    text = F.coalesce("text", F.lit(""))
    sized = long.select(
        "role", is_blank(text).alias("_blank"), F.length(text).alias("_chars"), token_count(text).alias("_tokens")
    )
    return sized.groupBy("role").agg(
        F.count_if(~F.col("_blank")).alias("messages"),
        F.avg("_chars").alias("avg_characters"),
        F.median("_chars").alias("median_characters"),
        F.avg("_tokens").alias("avg_tokens"),
        F.median("_tokens").alias("median_tokens"),
    )
