"""Summaries that grow with each export: mergeable states instead of a new pass over old messages.

A state is a small stored table. The state of old messages and that of new ones add up to the state
of both, and every summary table is computed from a state alone. What is counted distinct (users)
stays exact, because the state keeps one row per day, user and state of the conversation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.functions.text import iso_datetime

DAY_KEYS = ("date", "whatsapp_id", "cal_state")
MOOD_KEYS = ("date", "role", "sentiment_label")


def message_state(messages: DataFrame) -> DataFrame:
    """``date, whatsapp_id, cal_state, n, first, last``: messages per day, user and state.

    Messages without a readable time are kept under a null date; absent columns count as null.
    """
    null = F.lit(None).cast("string")
    when = F.col("datetime").try_cast("timestamp_ntz")
    rows = messages.select(
        F.to_date(when).alias("date"), *[(F.col(c) if c in messages.columns else null).alias(c) for c in DAY_KEYS[1:]], when.alias("_t"))
    return rows.groupBy(*DAY_KEYS).agg(F.count("*").alias("n"), F.min("_t").alias("first"), F.max("_t").alias("last"))


def mood_state(scored: DataFrame) -> DataFrame:
    """``date, role, sentiment_label, n``: scored messages per day, role and label."""
    day = F.to_date(F.col("datetime").try_cast("timestamp_ntz")).alias("date")
    return scored.groupBy(day, *MOOD_KEYS[1:]).agg(F.count("*").alias("n"))


def merged(states: Sequence[DataFrame]) -> DataFrame:
    """The state of all messages that any of ``states`` (of one kind) stands for.

    Merging is associative and takes states in any order. The messages of two states must be
    different ones, as those of two exports are.
    """
    rows = states[0]
    for more in states[1:]:
        rows = rows.unionByName(more)
    keys = [c for c in rows.columns if c not in ("n", "first", "last")]
    ends = [F.min("first").alias("first"), F.max("last").alias("last")] if "first" in rows.columns else []
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"), *ends)


def overview_of(state: DataFrame) -> DataFrame:
    """The overview row (see ``summary.datetime_overview``) from a message state."""
    totals = state.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_messages"), F.count_distinct("whatsapp_id").alias("unique_users"),
        F.min("first").alias("_first"), F.max("last").alias("_last"))
    days = state.filter(F.col("date").isNotNull()).groupBy("date").agg(F.sum("n").alias("messages"))
    by_date = days.agg(F.array_sort(F.collect_list(F.struct(F.col("date").cast("string").alias("date"), "messages")))).scalar()
    return totals.select(
        "total_messages", "unique_users", iso_datetime(F.col("_first")).alias("start_datetime"),
        iso_datetime(F.col("_last")).alias("end_datetime"),
        (F.extract(F.lit("DAY"), F.col("_last") - F.col("_first")) + 1).cast("int").alias("total_days"), by_date.alias("messages_by_date"))


def cal_state_of(state: DataFrame) -> DataFrame:
    """Messages per user and state (see ``summary.cal_state_by_user``) from a message state."""
    return state.groupBy("whatsapp_id", F.coalesce("cal_state", F.lit("Unknown")).alias("cal_state")).agg(F.sum("n").alias("message_count"))


def sentiment_counts_of(state: DataFrame) -> DataFrame:
    """Messages per role and label (see ``sentiment.sentiment_counts``) from a mood state."""
    return state.groupBy("role", "sentiment_label").agg(F.sum("n").alias("messages"))
