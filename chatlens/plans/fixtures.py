"""Inputs of the registered queries, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlens.operators.cleaning import clean_export, role_long
from chatlens.operators.translate import WordTranslator, cache_from_previous, translate_messages
from chatlens.session import materialise, spread

# Short word lists whose entries occur in the given tables.
TEST_POSITIVE = ["the", "of", "to", "was", "la", "der", "el", "with"]
TEST_NEGATIVE = ["and", "is", "it", "by", "de", "die", "los", "from"]
LETTERS = "abcdefghijklmnopqrstuvwxyz"
FIRST_WORDS = {"batao": "tell", "the": "the"}
RETRY_WORDS = {"mujhe": "me", "batao": "tell", "kya": "what", "hai": "is"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def raw_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the reply in the next turn; time, user and state come from events.

    The reply is found with an equi-join on (conversation, turn), so one very
    long conversation does not end up in one task.
    """
    turns = table(spark, sf_dir, "conversations")
    users = turns.filter(F.col("role") == "user").select("conv_id", "turn", "role", F.col("text").alias("Question"))
    replies = turns.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("Response")
    )
    events = table(spark, sf_dir, "events").withColumnRenamed("event_id", "row_index")
    paired = users.join(replies, ["conv_id", "turn"], "left").withColumn("row_index", F.col("conv_id") * 8 + F.col("turn"))
    return paired.join(events, "row_index").select(
        "row_index",
        F.concat(F.substring(F.col("ts").cast("string"), 1, 19), F.lit("wa"), F.col("user_id").cast("string"))
        .alias("session_id"),
        "Question", F.col("event_type").alias("Category"), "Response", F.col("Response").alias("translated_answer"),
        F.col("role").alias("cal_role"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("cal_state"),
        F.col("props").alias("cal_feedback"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned messages with the identity translation."""
    return translate_messages(clean_export(raw_export(spark, sf_dir)), None).messages


def long_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return role_long(messages(spark, sf_dir))


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as one message, for the wide-range timelines."""
    return table(spark, sf_dir, "events").select(
        F.col("ts").alias("datetime"), F.concat(F.lit("wa"), F.col("user_id").cast("string")).alias("whatsapp_id"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("cal_state"),
    )


def probe_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, each decorated so that every text rule meets its case."""
    kind = F.col("doc_id") % 8
    text = F.col("text")
    decorated = (
        F.when(kind == 0, text)
        .when(kind == 1, F.concat(F.lit("see https://example.org/a?b=1 now "), text))
        .when(kind == 2, F.concat(F.lit("mail a.b@example.org "), text))
        .when(kind == 3, F.concat(F.lit("id 12345 ok ok "), text))
        .when(kind == 4, F.concat(F.lit("नमस्ते "), text))
        .when(kind == 5, F.concat(F.lit("mujhe batao kya hai "), text))
        .when(kind == 6, F.concat(F.lit("Please provide the text "), text))
        .otherwise(F.concat(F.lit("business idea "), text))
    )
    return documents(spark, sf_dir).select("doc_id", "lang", decorated.alias("text"))


def translation_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probe_texts(spark, sf_dir).select(F.col("doc_id").alias("row_index"), F.col("text").alias("user_msg"))


def previous_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier run in which only the English documents got an answer."""
    return probe_texts(spark, sf_dir).select(
        F.col("doc_id").alias("row_index"), F.col("text").alias("user_msg"),
        F.when(F.col("lang") == "en", F.col("text")).otherwise(F.lit("")).alias("user_msg_en"),
    )


def translation_run(spark: SparkSession, sf_dir: str):
    return translate_messages(
        translation_input(spark, sf_dir), lambda: WordTranslator(FIRST_WORDS), lambda: WordTranslator(RETRY_WORDS)
    )


def cached_translation_run(spark: SparkSession, sf_dir: str):
    """The same with the acceptable answers of the earlier run as cache, each entry twice, once padded."""
    # It is read three times below, so it is computed once.
    cache = materialise(cache_from_previous(previous_run(spark, sf_dir)), "previous-answers")
    padded = cache.withColumn("text", F.concat(F.lit(" "), "text", F.lit("\n")))
    return translate_messages(
        translation_input(spark, sf_dir), lambda: WordTranslator(FIRST_WORDS), lambda: WordTranslator(RETRY_WORDS),
        cache=cache.unionByName(padded),
    )


def letter_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as the shares of the 26 letters in their text, with language and source as role and topic."""
    return with_letter_shares(documents(spark, sf_dir).select(
        F.col("doc_id").alias("row_index"), F.col("lang").alias("message_role"),
        F.regexp_extract("source", "([0-9]+)$", 1).cast("int").alias("topic_id"), "text")).drop("text")


def with_letter_shares(docs: DataFrame) -> DataFrame:
    """Add ``vector``: the shares of the 26 letters in ``text``, a model that both engines can compute."""
    text = F.lower("text")
    counted = docs.select("*", F.explode(F.array(F.array(*[F.regexp_count(text, F.lit(c)) for c in LETTERS]))).alias("counts"))
    total = F.greatest(F.aggregate("counts", F.lit(0), lambda a, x: a + x), F.lit(1))
    return counted.withColumn("vector", F.transform("counts", lambda n: n / total)).drop("counts")


class LetterCounter:
    """A stand-in for an embedding model: how often each letter occurs."""

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return [[float(t.lower().count(c)) for c in LETTERS] for t in texts]


def linked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that have a vector, as messages with text and vector."""
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_index"), F.col("embedding").cast("array<double>").alias("vector"))
    return topics_given(spark, sf_dir).drop("topic_id").join(vectors, "row_index")


def topics_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with a supplied topic: one per source, every 11th an outlier."""
    number = F.regexp_extract("source", "([0-9]+)$", 1).cast("int")
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("row_index"),
        F.when(F.col("lang") == "en", "user").otherwise("assistant").alias("message_role"),
        F.when(F.col("doc_id") % 11 == 0, -1).otherwise(number).alias("topic_id"),
        "text",
    )
