"""Translation of user messages: one call per distinct text, cache, one retry."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens import fixed_values as fv
from chatlens.functions.text import clip, flag_retranslation, is_blank, strip
from chatlens.operators.cleaning import dedup_first, place_after
from chatlens.operators.joins import HOT_ROWS, attach_by_key, text_key
from chatlens.operators.scoring import TEXTS_PER_COMMIT, as_model, distinct_texts, run_model, run_resumable
from chatlens.schemas import TRANSLATION_RESULT
from chatlens.session import materialise

TEXT_CODEC = "zstd"  # of the stored texts, which are most of what a run writes
DEDUP_KEYS = ("datetime", "whatsapp_id", "user_msg")


class WordTranslator:
    """The built-in translator: replaces listed words and keeps all others."""

    def __init__(self, words: Mapping[str, str]):
        self.words = dict(words)

    def __call__(self, texts: list[str]) -> list[tuple[str, int, int]]:
        out = []
        for text in texts:
            parts = text.split()
            out.append((" ".join(self.words.get(p, p) for p in parts), len(parts), len(parts)))
        return out


def _guarded(load: Callable[[], Any]) -> Callable[[], Any]:
    """A text whose call fails keeps its original wording at no cost and is marked as failed."""
    def load_guarded():
        model = as_model(load())

        def one(text: str):
            try:
                answer = model([text])[0]
            except Exception:  # noqa: BLE001
                return text, 0, 0, True
            return (answer[0] or "").strip(), answer[1], answer[2], False

        def call(texts: list[str]):
            try:
                answers = list(model(texts))
            except Exception:  # noqa: BLE001
                answers = []
            if len(answers) != len(texts):
                return [one(t) for t in texts]
            return [((a[0] or "").strip(), a[1], a[2], False) for a in answers]

        return call

    return load_guarded


def normalised(messages: DataFrame, column: str = "user_msg") -> DataFrame:
    """Add the trimmed text that translations are looked up by; blank becomes null."""
    return messages.withColumn("_text", F.nullif(strip(F.col(column)), F.lit("")))


def work_list(messages: DataFrame, column: str = "user_msg") -> DataFrame:
    """``(text, n_rows, first_row)`` for each distinct non-blank text."""
    rows = normalised(messages, column).filter(F.col("_text").isNotNull())
    return distinct_texts(rows, "_text", "row_index").withColumn("text_key", text_key(F.col("text")))


def cached_answers(cache: DataFrame) -> DataFrame:
    """``(text_key, cached_en)`` of a cache ``(text, text_en)``, one row per text.

    Texts are trimmed as messages are. Of several answers to one text the first
    in alphabetical order counts; blank texts and missing answers are left out.
    """
    rows = normalised(cache, "text").filter(F.col("_text").isNotNull() & F.col("text_en").isNotNull())
    return rows.groupBy(text_key(F.col("_text")).alias("text_key")).agg(F.min("text_en").alias("cached_en"))


def translation_misses(messages: DataFrame, cache: DataFrame, column: str = "user_msg") -> DataFrame:
    """The distinct texts that the cache ``(text, text_en)`` does not answer."""
    return work_list(messages, column).join(cached_answers(cache).select("text_key"), "text_key", "left_anti")


def cache_from_previous(previous: DataFrame) -> DataFrame:
    """Acceptable translations of an earlier run, the first one per text."""
    rows = normalised(previous).filter(F.col("_text").isNotNull()).withColumn("_en", strip(F.col("user_msg_en")))
    good = flag_retranslation(rows, "_text", "_en").filter(~F.col("needs_retranslation"))
    return good.groupBy(F.col("_text").alias("text")).agg(F.min_by("_en", "row_index").alias("text_en"))


def same_messages(previous: DataFrame, messages: DataFrame) -> DataFrame:
    """One row saying whether an earlier run saw exactly these messages in this order."""
    a = previous.select("row_index", strip(F.col("user_msg")).alias("_a"))
    b = messages.select("row_index", strip(F.col("user_msg")).alias("_b"))
    return a.join(b, "row_index", "full").agg(
        F.count("_a").alias("previous_rows"), F.count("_b").alias("current_rows"),
        F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("mismatches"),
    ).withColumn("reusable", F.col("mismatches") == 0)


@dataclass
class TranslationRun:
    """The tables of one run. ``texts`` has one row per distinct text."""

    messages: DataFrame
    texts: DataFrame


def translate_messages(
    messages: DataFrame,
    load_translator: Callable[[], Any] | None,
    load_retry: Callable[[], Any] | None = None,
    cache: DataFrame | None = None,
    batch_size: int = 32,
    partitions: int | None = None,
    hot_rows: int = HOT_ROWS,
    resume: str | None = None,
    texts_per_commit: int = TEXTS_PER_COMMIT,
) -> TranslationRun:
    """Add ``user_msg_en`` behind ``user_msg``.

    Distinct texts that are not cached go to the translator; answers that are
    not acceptable English go once more to ``load_retry`` (the same translator,
    told to insist on English). A failed retry keeps the first answer. With no
    translator each text is its own translation.

    With a folder ``resume`` the answers are kept there as they come, and a run that was stopped goes
    on where it was: only texts without an answer, or whose call failed, are called.
    """
    work = work_list(messages)
    if load_translator is None:
        same = place_after(messages, "user_msg_en", strip(F.col("user_msg")), "user_msg")
        texts = work.select("text_key", "text", "n_rows", "first_row", F.col("text").alias("text_en"),
                            F.lit("identity").alias("source"))
        return TranslationRun(same, texts)

    if cache is not None:
        work = materialise(work.join(cached_answers(cache), "text_key", "left"), "translation-work", TEXT_CODEC)
    else:
        work = materialise(work.withColumn("cached_en", F.lit(None).cast("string")), "translation-work", TEXT_CODEC)

    def called_once(texts: DataFrame, load: Callable[[], Any], name: str) -> DataFrame:
        if resume is None:
            return run_model(texts, _guarded(load), TRANSLATION_RESULT, batch_size, partitions, stored=True)
        return run_resumable(
            texts, _guarded(load), TRANSLATION_RESULT, batch_size, f"{resume}/{name}", texts_per_commit, partitions, ~F.col("failed"), stored=True)

    misses = work.filter(F.col("cached_en").isNull()).select("text_key", "text")
    # Of the texts, only those that are called again are stored beside their answers.
    first = materialise(flag_retranslation(called_once(misses, load_translator, "first"), "text", "text_en").withColumn(
        "text", F.when(F.col("needs_retranslation"), F.col("text"))), "translation-first", TEXT_CODEC)
    flagged = first.filter("needs_retranslation").select("text_key", "text")
    again = materialise(
        flag_retranslation(called_once(flagged, load_retry or load_translator, "retry"), "text", "text_en").drop("text"), "translation-retry", TEXT_CODEC)
    second = again.select(
        "text_key", F.col("text_en").alias("retry_en"), F.col("input_tokens").alias("retry_input_tokens"),
        F.col("output_tokens").alias("retry_output_tokens"), (~F.col("needs_retranslation") & ~F.col("failed")).alias("retry_ok"),
    )
    called = first.select(
        "text_key", F.col("text_en").alias("first_en"), "input_tokens", "output_tokens", "needs_retranslation", "failed"
    )
    answers = called.join(second, "text_key", "left")
    # Joined from stored tables whenever it is read, since most readers need no more than one of its texts.
    texts = work.join(answers, "text_key", "left").withColumn(
        "text_en", F.coalesce("cached_en", F.when(F.col("retry_ok"), F.col("retry_en")), "first_en")
    ).withColumn("source", F.when(F.col("cached_en").isNotNull(), "cache").otherwise("model"))
    keyed = normalised(messages).withColumn("text_key", text_key(F.col("_text"))).drop("_text")
    joined = attach_by_key(
        keyed.drop("user_msg_en"), texts.select("text_key", "text_en"), "text_key",
        work.select("text_key", "n_rows"), ("row_index",), hot_rows,
    )
    placed = place_after(joined, "user_msg_en", F.coalesce("text_en", F.lit("")), "user_msg")
    return TranslationRun(placed.drop("text_key", "text_en"), texts)


def translated_table(run: TranslationRun) -> DataFrame:
    """The stored form of a run: duplicate messages removed, the earliest kept."""
    return dedup_first(run.messages, DEDUP_KEYS)


def translation_stats(run: TranslationRun) -> DataFrame:
    """One row of counts, tokens and cost of a run with a translator."""
    original, english = strip(F.col("user_msg")), strip(F.col("user_msg_en"))
    rows = run.messages.agg(
        F.count("*").alias("total_rows"),
        F.count_if(original != english).alias("changed_rows"),
        F.count_if(~is_blank(F.col("user_msg"))).alias("non_empty_inputs"),
    )
    retried = F.col("retry_ok").isNotNull()
    calls = run.texts.agg(
        F.count("first_en").alias("first_calls"),
        F.count_if("failed").alias("failed_calls"),
        F.count_if(retried).alias("retries"),
        F.count_if(F.col("retry_ok")).alias("retries_ok"),
        (F.coalesce(F.sum("input_tokens"), F.lit(0)) + F.coalesce(F.sum("retry_input_tokens"), F.lit(0)))
        .alias("input_tokens"),
        (F.coalesce(F.sum("output_tokens"), F.lit(0)) + F.coalesce(F.sum("retry_output_tokens"), F.lit(0)))
        .alias("output_tokens"),
    )
    # Two one-row tables, put side by side as scalar subqueries of a struct.
    call = calls.select(F.struct("*")).scalar()
    both = rows.withColumn("_c", call)
    cost = (F.col("_c.input_tokens") / 1e6 * fv.INPUT_COST_PER_1M
            + F.col("_c.output_tokens") / 1e6 * fv.OUTPUT_COST_PER_1M)
    api_calls = F.col("_c.first_calls") + F.col("_c.retries")
    share = lambda part: part.cast("double") / F.nullif("total_rows", F.lit(0)) * 100
    return both.select(
        "total_rows", "changed_rows", (F.col("total_rows") - F.col("changed_rows")).alias("unchanged_rows"),
        share(F.col("changed_rows")).alias("changed_pct"),
        share(F.col("total_rows") - F.col("changed_rows")).alias("unchanged_pct"),
        "non_empty_inputs", (F.col("non_empty_inputs") - F.col("_c.first_calls")).alias("cache_served_rows"),
        api_calls.alias("api_calls"), F.col("_c.input_tokens").alias("input_tokens"),
        F.col("_c.output_tokens").alias("output_tokens"), cost.alias("total_cost"),
        (cost / F.nullif(api_calls, F.lit(0))).alias("cost_per_call"),
        F.col("_c.retries").alias("retries"), F.col("_c.retries_ok").alias("retries_ok"),
        (F.col("_c.retries") - F.col("_c.retries_ok")).alias("retries_failed"),
        F.col("_c.failed_calls").alias("failed_calls"),
    )


def failed_retry_preview(run: TranslationRun, n: int = 10) -> DataFrame:
    """The first ``n`` texts that stayed unacceptable after the retry, cut to 75 characters."""
    return (
        run.texts.filter(~F.col("retry_ok")).orderBy("first_row").limit(n)
        .select("first_row", clip(F.col("text")).alias("preview"))
    )


def translation_preview(run: TranslationRun, n: int = 20) -> DataFrame:
    """The first ``n`` messages with their translation."""
    return run.messages.orderBy("row_index").limit(n).select("row_index", "user_msg", "user_msg_en")
