"""Quality of a topic model: counts, diversity, coherence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens import fixed_values as fv
from chatlens.session import materialise
from chatlens.topics.eligibility import TOPIC
from chatlens.topics.terms import STOPWORDS, add_terms, topic_sizes


def topic_metrics(docs: DataFrame, ranked: DataFrame) -> DataFrame:
    """One row per role; outliers are the messages with topic -1."""
    totals = docs.groupBy("message_role").agg(
        F.count("*").alias("total_messages"), F.count_if(F.col("topic_id") == -1).alias("outliers")
    )
    sizes = topic_sizes(docs)
    per_role = sizes.groupBy("message_role").agg(
        F.count("*").alias("num_topics"),
        F.avg("message_count").cast("bigint").alias("avg_topic_size"),
        F.median("message_count").cast("bigint").alias("median_topic_size"),
    )
    top = ranked.filter(F.col("rank") <= 10).join(sizes, TOPIC, "left_semi")
    diversity = top.groupBy("message_role").agg(
        F.round(F.count_distinct("term") / F.count("*"), 3).alias("diversity")
    )
    zero = F.lit(0).cast("bigint")
    return totals.join(per_role, "message_role", "left").join(diversity, "message_role", "left").select(
        "message_role", F.coalesce("num_topics", zero).alias("num_topics"),
        F.coalesce("diversity", F.lit(0.0)).alias("diversity"),
        F.coalesce("avg_topic_size", zero).alias("avg_topic_size"),
        F.coalesce("median_topic_size", zero).alias("median_topic_size"),
        "total_messages", "outliers",
    )


def topic_coherence(
    docs: DataFrame, text_col: str, ranked: DataFrame, top: int = 10, stopwords: Sequence[str] = STOPWORDS
) -> DataFrame:
    """Mean NPMI of the top terms of each topic, from co-occurrence in messages.

    Each message is reduced to one bit mask per topic that says which of the
    ``top`` terms it holds. Messages are counted per mask, so at most 2^top
    rows per topic are left before any pair of terms is formed. Pairs that
    never meet score -1.
    """
    tops = materialise(ranked.filter(F.col("rank") <= top).select(*TOPIC, "term", "rank"), "top-terms")
    # One row per role: all top terms of its topics, few per topic.
    wanted = tops.groupBy("message_role").agg(F.collect_set("term").alias("_wanted"))
    roles = F.broadcast(docs.groupBy("message_role").agg(F.count("*").alias("_n")))
    # A message's terms are held against the wanted ones before they become rows.
    present = add_terms(docs.select("row_index", "message_role", text_col), text_col, stopwords).join(wanted, "message_role").select(
        "row_index", "message_role", F.explode(F.array_intersect("terms", "_wanted")).alias("term")
    )
    bit = F.pow(F.lit(2), F.col("rank") - 1).cast("bigint")
    masks = (
        present.join(tops.withColumn("_bit", bit).drop("rank"), ["message_role", "term"])
        .groupBy("message_role", "row_index", "topic_id").agg(F.sum("_bit").alias("_mask"))
        .groupBy(*TOPIC, "_mask").agg(F.count("*").alias("_c"))
    )
    has = lambda mask, rank: F.getbit(mask, rank - 1) == 1
    # Equal ranks stand for the message count of one term, unequal ones for a pair.
    pairs = F.array(*[F.struct(F.lit(i).alias("a"), F.lit(j).alias("b"))
                      for i in range(1, top + 1) for j in range(i, top + 1)])
    counts = materialise(
        masks.select(*TOPIC, "_mask", "_c", F.inline(pairs))
        .filter(has(F.col("_mask"), F.col("a")) & has(F.col("_mask"), F.col("b")))
        .groupBy(*TOPIC, "a", "b").agg(F.sum("_c").alias("_ab")), "term-pairs")
    single = counts.filter("a = b")
    scored = (
        counts.filter("a < b")
        .join(single.select(*TOPIC, "a", F.col("_ab").alias("_ca")), [*TOPIC, "a"])
        .join(single.select(*TOPIC, "b", F.col("_ab").alias("_cb")), [*TOPIC, "b"])
        .join(roles, "message_role")
    )
    p_ab = F.col("_ab") / F.col("_n")
    ratio = F.ln(F.col("_ab") * F.col("_n").cast("double") / (F.col("_ca").cast("double") * F.col("_cb")))
    npmi = F.when(F.col("_ab") == F.col("_n"), 1.0).otherwise(ratio / -F.ln(p_ab))
    met = scored.groupBy(*TOPIC).agg(F.sum(npmi).alias("_s"), F.count("*").alias("_k"))
    sizes = tops.groupBy(*TOPIC).agg(F.count("*").alias("_m"))
    all_pairs = F.col("_m") * (F.col("_m") - 1) / 2
    unmet = all_pairs - F.coalesce("_k", F.lit(0))
    return sizes.filter(F.col("_m") > 1).join(met, TOPIC, "left").select(
        *TOPIC, ((F.coalesce("_s", F.lit(0.0)) - unmet) / all_pairs).alias("coherence_c_npmi")
    )


def role_coherence(coherence: DataFrame) -> DataFrame:
    """Mean over the topics of a role."""
    return coherence.groupBy("message_role").agg(F.avg("coherence_c_npmi").alias("coherence_c_npmi"))


def topic_quality_flags(metrics: DataFrame) -> DataFrame:
    low, high = fv.TOPIC_COUNT_RANGE
    return metrics.select(
        "message_role", "num_topics", "diversity",
        (F.col("num_topics") < low).alias("too_few_topics"),
        (F.col("num_topics") > high).alias("too_many_topics"),
        (F.col("diversity") < fv.MIN_DIVERSITY).alias("low_diversity"),
    )
