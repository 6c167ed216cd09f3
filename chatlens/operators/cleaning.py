"""From the raw export to typed messages, and row-level filters on messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlens.functions.text import is_blank
from chatlens.sources.tables import ensure_column, require_columns

# The form of a session id and the names given to export columns.
_SESSION_TIME = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"
EXPORT_NAMES = {
    "Question": "user_msg",
    "Category": "user_msg_category",
    "Response": "ai_msg",
    "translated_answer": "ai_msg_en",
}
DROPPED_NAMES = ("session_id", "cal_role")
ROLE_COLUMNS = {"user": ("user_msg", "user_msg_en"), "assistant": ("ai_msg", "ai_msg_en")}


def session_time(session_id: Column) -> Column:
    """The timestamp in the first 19 characters, or null. No time zone is involved."""
    text = F.substring(session_id, 1, 19)
    return F.when(text.rlike(_SESSION_TIME), text.try_cast("timestamp_ntz"))


def session_user(session_id: Column) -> Column:
    return F.substring(session_id, 20, 2_000_000_000)


def clean_export(raw: DataFrame, strict: bool = True) -> DataFrame:
    """Split the session id, rename the export columns and put time and user first.

    With ``strict`` a session id without a valid time fails the job; otherwise
    its ``datetime`` is null (see :func:`quarantine`).
    """
    require_columns(raw, "session_id")
    when = session_time(F.col("session_id"))
    if strict:
        when = F.coalesce(
            when,
            F.raise_error(F.concat(F.lit("no valid time in session id "), F.coalesce("session_id", F.lit("null"))))
            .cast("timestamp_ntz"),
        )
    renames = {old: new for old, new in EXPORT_NAMES.items() if old in raw.columns}
    kept = [c for c in raw.columns if c not in DROPPED_NAMES]
    return raw.select(
        when.alias("datetime"), session_user(F.col("session_id")).alias("whatsapp_id"),
        *[F.col(c).alias(renames.get(c, c)) for c in kept],
    )


def quarantine(raw: DataFrame) -> DataFrame:
    """The export rows whose session id holds no valid time."""
    require_columns(raw, "session_id")
    return raw.filter(session_time(F.col("session_id")).isNull())


def place_after(df: DataFrame, name: str, value: Column, after: str) -> DataFrame:
    """Put a column right behind another one, replacing a column of that name."""
    order = [c for c in df.columns if c != name]
    at = order.index(after) + 1
    return df.select(*order[:at], value.alias(name), *order[at:])


def role_long(messages: DataFrame, keep: Sequence[str] = ("row_index", "datetime", "whatsapp_id")) -> DataFrame:
    """One row per message instead of per exchange, in one pass over the table.

    Columns: the kept ones, ``role``, ``text_original`` and ``text`` (English).
    A role whose English column is missing is left out; a missing original
    column becomes the empty string.
    """
    roles = {role: cols for role, cols in ROLE_COLUMNS.items() if cols[1] in messages.columns}
    for original, _ in roles.values():
        messages = ensure_column(messages, original, F.lit(""))
    entries = [
        F.struct(F.lit(role).alias("role"), F.col(original).alias("text_original"), F.col(english).alias("text"))
        for role, (original, english) in roles.items()
    ]
    present = [c for c in keep if c in messages.columns]
    return messages.select(*present, F.inline(F.array(*entries)))


def nonblank(df: DataFrame, text_col: str) -> DataFrame:
    return df.filter(~is_blank(F.col(text_col)))


def cap_per_role(df: DataFrame, limit: int, role_col: str = "role", order_col: str = "row_index") -> DataFrame:
    """The first ``limit`` rows of each role, whatever the roles are (the debug cap of a run).

    The rank filter is applied before the shuffle as well: every task hands on
    at most ``limit`` rows of a role. Rows without a role are a role of their own.
    """
    rank = F.row_number().over(Window.partitionBy(role_col).orderBy(order_col))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= limit).drop("_rank")


def valid_datetime(df: DataFrame, column: str = "datetime") -> DataFrame:
    """Coerce to a timestamp and drop the rows where that fails."""
    return df.withColumn(column, F.col(column).try_cast("timestamp_ntz")).filter(F.col(column).isNotNull())


def dedup_first(df: DataFrame, keys: Sequence[str], order_col: str = "row_index") -> DataFrame:
    """Keep the first row of each key; null keys are equal.

    The rank filter is applied before the shuffle as well, so a key shared by a
    third of the rows sends one row per map task.
    """
    present = [k for k in keys if k in df.columns]
    if not present:
        return df
    rank = F.row_number().over(Window.partitionBy(*present).orderBy(order_col))
    return df.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")
