"""Intent labels of topics, as array expressions over one row per topic."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlens import fixed_values as fv
from chatlens.functions.text import evaluated_once, strip
from chatlens.operators.scoring import run_model
from chatlens.topics.eligibility import TOPIC

_LABEL_BREAKS = rf"[{fv.BLANK_CLASS}_/,-]+"
_LINE_BREAKS = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"
_BANNED_PARTS = [*fv.BANNED_LABEL_WORDS, *fv.BANNED_LABEL_PARTS]


def label_tokens(text: Column) -> Column:
    """Lower-cased parts of a label or term without banned words."""
    return F.filter(F.split(F.lower(text), _LABEL_BREAKS), lambda t: (t != "") & ~t.isin(fv.BANNED_LABEL_WORDS))


def apply_synonyms(parts: Column) -> Column:
    """Replace words that stand for a known intent by the words of that intent."""
    intents = F.create_map(*[F.lit(x) for word, intent in fv.INTENT_WORDS.items() for x in (word, intent.lower())])
    return F.flatten(F.transform(parts, lambda t: F.split(F.coalesce(F.try_element_at(intents, t), t), " ")))


def keyword_tokens(terms: Column) -> Column:
    """Up to five label words from ranked terms; compound terms come first."""
    head = F.slice(terms, 1, 8)
    compound = F.slice(F.filter(head, lambda t: t.contains("_")), 1, 3)
    simple = F.slice(F.filter(head, lambda t: ~t.contains("_")), 1, 5)
    split_terms = F.flatten(F.transform(F.concat(compound, simple), label_tokens))
    chosen = F.when((F.size(split_terms) == 0) & (F.size(terms) > 0), F.slice(terms, 1, 1)).otherwise(split_terms)
    unique = F.array_distinct(apply_synonyms(chosen))
    more = F.flatten(F.transform(F.slice(terms, 1, 10), label_tokens))
    topped_up = F.slice(F.array_union(unique, more), 1, 3)
    return F.slice(F.when(F.size(unique) < 2, topped_up).otherwise(unique), 1, 5)


def format_label(parts: Column) -> Column:
    kept = F.filter(parts, lambda t: (t != "") & ~t.isin(fv.BANNED_LABEL_WORDS))
    chosen = F.when(F.size(kept) < 2, F.slice(parts, 1, 2)).otherwise(kept)
    return F.initcap(F.array_join(F.slice(chosen, 1, 5), " "))


def has_banned_part(label: Column) -> Column:
    """Banned strings count anywhere in a label, also inside a longer word."""
    lowered = F.lower(label)
    return F.exists(F.array(*[F.lit(p) for p in _BANNED_PARTS]), lambda part: lowered.contains(part))


def clean_supplied_label(label: Column) -> Column:
    """First line without edge punctuation; null if blank or tied to one product."""
    line = F.btrim(strip(F.get(F.split(strip(label), _LINE_BREAKS, 2), F.lit(0))), F.lit("-:"))
    lowered = F.lower(line)
    specific = F.exists(F.array(*[F.lit(p) for p in fv.TOO_SPECIFIC_PARTS]), lambda part: lowered.contains(part))
    return F.when((line != "") & ~specific, line)


def intent_labels(topics: DataFrame) -> DataFrame:
    """Decide the label of each topic.

    ``topics`` has ``terms``, ``name`` and may have ``supplied_label``. The
    supplied label (else the name) is used unless it is too short or banned;
    then, and when formatting brings back a banned string, the terms decide.
    """
    raw = F.coalesce(F.col("supplied_label"), F.col("name")) if "supplied_label" in topics.columns else F.col("name")
    df = evaluated_once(topics, _raw=F.coalesce(raw, F.lit("")), _kw=keyword_tokens(F.col("terms")))
    df = evaluated_once(df, _own=apply_synonyms(label_tokens(F.col("_raw"))))
    regenerate = (F.size("_own") < 2) | has_banned_part(F.col("_raw"))
    df = evaluated_once(df, _first=format_label(F.when(regenerate, F.col("_kw")).otherwise(F.col("_own"))))
    label = F.when(has_banned_part(F.col("_first")), format_label(F.col("_kw"))).otherwise(F.col("_first"))
    return df.select(*TOPIC, label.alias("intent_label"))


def labelling_prompts(info: DataFrame, samples: DataFrame) -> DataFrame:
    """One text per topic for a labelling model: top 8 terms and up to 10 messages.

    ``samples`` are ranked messages ``(message_role, topic_id, rank, example)``.
    """
    chosen = samples.filter(F.col("rank") <= 10).groupBy(*TOPIC).agg(
        F.array_sort(F.collect_list(F.struct("rank", "example"))).alias("_s")
    )
    lines = F.array_join(F.transform(F.col("_s.example"), lambda m: F.concat(F.lit("- "), m)), "\n")
    return info.join(chosen, TOPIC).select(
        *TOPIC, F.concat(F.lit("Keywords: "), F.array_join(F.slice("terms", 1, 8), ", "), F.lit("\nMessages:\n"), lines)
        .alias("text"),
    )


def supplied_labels(prompts: DataFrame, load_labeller: Callable[[], Any], partitions: int | None = None) -> DataFrame:
    """Ask a labelling model once per topic and keep the usable answers."""
    result = T.StructType([T.StructField("answer", T.StringType())])
    answered = run_model(prompts, load_labeller, result, batch_size=8, partitions=partitions)
    return answered.select(*TOPIC, clean_supplied_label(F.col("answer")).alias("supplied_label")).filter(
        F.col("supplied_label").isNotNull()
    )
