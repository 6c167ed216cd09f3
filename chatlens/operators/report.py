"""Report tables: ranked topics, highlighted examples, summary sentences, insights."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlens import fixed_values as fv
from chatlens.functions.text import strip
from chatlens.topics.eligibility import TOPIC


def label_backfill(keywords: DataFrame, examples: DataFrame) -> DataFrame:
    """Give a keyword table without labels those of an example table.

    Rows match on role and exact keyword text; of equal matches the last one
    (by ``position``) wins, and without a match the label is ``Topic n``.
    """
    known = examples.groupBy("message_role", "keywords").agg(F.max_by("intent_label", "position").alias("intent_label"))
    default = F.concat(F.lit("Topic "), F.coalesce(F.col("topic_id").cast("string"), F.lit("?")))
    return keywords.drop("intent_label").join(known, ["message_role", "keywords"], "left").withColumn(
        "intent_label", F.coalesce("intent_label", default))


def top_topics(keywords: DataFrame, top: int = 15) -> DataFrame:
    """The largest topics of each role, ties by topic id."""
    order = Window.partitionBy("message_role").orderBy(F.desc("message_count"), "topic_id")
    return keywords.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def topic_summary_text(keywords: DataFrame, top: int = 5) -> DataFrame:
    """One text per role that lists its largest topics."""
    line = F.format_string("Topic %s: %s (%s msgs)", "topic_id", "keywords", "message_count")
    ranked = top_topics(keywords, top).groupBy("message_role").agg(
        F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("_l"))
    return ranked.select("message_role", F.array_join(F.col("_l.line"), "\n").alias("summary"))


def keyword_variants(keywords: Column) -> Column:
    """Spellings of comma-separated keywords to look for, longest first."""
    bases = F.filter(
        F.transform(F.split(F.coalesce(keywords, F.lit("")), ","), lambda t: F.lower(strip(t))), lambda t: t != ""
    )

    def spellings(base: Column) -> Column:
        plain = ~base.rlike("(?:s|ed|ing|tion|ment)$")
        ends_e = base.endswith("e")
        stem = F.substring(base, F.lit(1), F.length(base) - 1)
        long_e = ends_e & (F.length(base) > 2)
        return F.array(
            base, F.replace(base, F.lit("_"), F.lit(" ")),
            *[F.when(plain, F.concat(base, F.lit(end))) for end in ("s", "ed", "ing")],
            *[F.when(long_e, F.concat(stem, F.lit(end))) for end in ("ed", "ing")],
            F.when(ends_e, F.concat(stem, F.lit("ion"))),
            F.when(~base.endswith("ment"), F.concat(base, F.lit("ment"))),
        )

    found = F.array_distinct(F.array_compact(F.flatten(F.transform(bases, spellings))))
    ordered = F.array_sort(F.transform(found, lambda v: F.struct((-F.length(v)).alias("n"), v.alias("v"))))
    return F.transform(ordered, lambda pair: pair["v"])


def highlight(text: Column, variants: Column) -> Column:
    """Mark each variant as a whole word, one after the other."""
    def mark(marked: Column, term: Column) -> Column:
        pattern = F.concat(
            F.lit(f"(?iu)(?<![{fv.WORD_CLASS}])(\\Q"), term, F.lit(f"\\E)(?![{fv.WORD_CLASS}])"))
        return F.regexp_replace(marked, pattern, F.lit("<mark>$1</mark>"))

    return F.when(strip(text) == "", "").otherwise(F.aggregate(variants, text, mark))


def highlighted_examples(examples: DataFrame, keywords: DataFrame) -> DataFrame:
    """Topic examples with the topic's keywords marked."""
    joined = examples.join(keywords.select(*TOPIC, "intent_label", "keywords"), TOPIC)
    return joined.withColumn("_v", keyword_variants(F.col("keywords"))).withColumn(
        "example", highlight(F.col("example"), F.col("_v"))).drop("_v")


def overview_sentences(overview: DataFrame) -> DataFrame:
    """The overview row as lines of text; absent values leave their line out."""
    lines = [
        F.concat(F.lit("Total messages analysed: "), F.format_number("total_messages", 0)),
        F.concat(F.lit("Unique WhatsApp IDs: "), F.format_number("unique_users", 0)),
        F.concat(F.lit("Data range: "), F.col("start_datetime"), F.lit(" to "), F.col("end_datetime")),
        F.concat(F.lit("Coverage: "), F.col("total_days").cast("string"), F.lit(" days")),
    ]
    return overview.select(F.lit("overview").alias("topic"), F.concat_ws("\n", *lines).alias("sentence"))


def sentiment_sentences(top_labels: DataFrame) -> DataFrame:
    """One sentence per role on its most frequent sentiment labels."""
    part = F.format_string("%s (%.1f%%)", F.col("sentiment_label"), F.col("share") * 100)
    listed = top_labels.groupBy("role").agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("p")))).alias("_p"))
    return listed.select(
        F.col("role").alias("topic"),
        F.concat(F.initcap("role"), F.lit(" messages most often express: "), F.array_join(F.col("_p.p"), ", ")).alias("sentence"),
    )


def report_insights(
    hourly: DataFrame, states: DataFrame, sentiments: DataFrame, keywords: DataFrame, agency: DataFrame
) -> DataFrame:
    """The headline facts of the report as ``(name, value)`` text rows.

    Inputs are the small aggregate tables; ``agency`` is the scored table.
    """
    def fact(name: Column | str, value: Column) -> Column:
        return F.struct((F.lit(name) if isinstance(name, str) else name).alias("name"), value.cast("string").alias("value"))

    # Each small aggregate is computed once and turned into its rows. On equal counts the smallest
    # key wins, as in a sorted table.
    hours = hourly.agg(F.min_by("hour", F.struct(-F.col("messages"), F.col("hour"))).alias("h"), F.sum("messages").alias("n"))
    top = states.agg(F.min_by("cal_state", F.struct(-F.col("message_count"), F.col("cal_state"))).alias("s"), F.max("message_count").alias("n"))
    mood = sentiments.groupBy("role").agg(
        F.min_by("sentiment_label", F.struct(-F.col("messages"), F.col("sentiment_label"))).alias("v"))
    topic = keywords.groupBy("message_role").agg(
        F.min_by("keywords", F.struct(-F.col("message_count"), F.col("topic_id"))).alias("v"))
    scores = agency.filter(F.col("agency_score").isNotNull()).groupBy("message_role").agg(
        F.avg("agency_score").alias("mean"), F.avg(F.col("is_high").cast("int")).alias("high"))
    of_role = lambda name, role: F.concat(F.lit(name), F.col(role))
    facts = [
        (hours, [fact("peak_hour", F.col("h")), fact("total_messages", F.col("n"))]),
        (top, [fact("top_state", F.col("s")), fact("top_state_messages", F.col("n"))]),
        (mood, [fact(of_role("dominant_sentiment_", "role"), F.lower("v"))]),
        (topic, [fact(of_role("top_topic_", "message_role"), F.col("v"))]),
        (scores, [fact(of_role("mean_agency_", "message_role"), F.format_string("%.2f", "mean")),
                  fact(of_role("pct_high_agency_", "message_role"), F.format_string("%.1f", F.col("high") * 100))]),
    ]
    return functools.reduce(DataFrame.unionByName, [table.select(F.inline(F.array(*rows))) for table, rows in facts])
