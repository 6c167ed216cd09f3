"""The whole analysis of one export, as plain calls of the operators."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlens import fixed_values as fv
from chatlens.operators import agency, cleaning, sentiment, summary, translate
from chatlens.session import materialise, stored_tables
from chatlens.sources import tables
from chatlens.topics import cluster, cluster_tree, eligibility, guidance, labels, metrics, neighbours, refine, terms, vectors
from chatlens.topics.eligibility import TOPIC


@dataclass
class Models:
    """Loaders of the models; ``None`` selects the built-in rule or leaves the step out."""

    translator: Callable[[], Any] | None = None
    strict_translator: Callable[[], Any] | None = None
    sentiment: Callable[[], Any] | None = None
    agency: Callable[[], Any] | None = None
    embedder: Callable[[], Any] | None = None
    labeller: Callable[[], Any] | None = None


def representative_messages(rows: DataFrame, centres: DataFrame, top: int) -> DataFrame:
    """``(message_role, topic_id, rank, example)``: the cleaned messages closest to their topic's centroid."""
    return vectors.representative_docs(rows, centres, "vector", top).select(*TOPIC, "rank", F.col("cleaned").alias("example"))


def _clusters(reduced: DataFrame, method: str, width: float, least: int) -> DataFrame:
    """``topic_id`` of reduced vectors: grid cells, exact neighbours, or the tree over several radii."""
    by = ["message_role"]
    if method == "grid":
        return cluster.density_clusters(reduced, "reduced", "doc_index", width, min_cluster_size=least, by=by)
    if method == "neighbours":
        return neighbours.neighbour_clusters(reduced, "reduced", "doc_index", width, min_cluster_size=least, by=by).drop("is_core")
    if method == "tree":
        return cluster_tree.cluster_tree(reduced, "reduced", "doc_index", width, min_cluster_size=least, by=by).points
    raise ValueError(f"no clustering is called {method}")


def cluster_role(
    docs: DataFrame, models: Models, min_cluster_size: int, cell_width: float | None, use_seeds: bool, stopwords: Sequence[str],
    clustering: str = "grid", seed_radius: float | None = None,
) -> tuple[DataFrame, Callable[[DataFrame, str], DataFrame]]:
    """Vectors, reduction and clusters of one role's messages, and the function that embeds other texts alike."""
    if models.embedder is None:
        embedded, embed_more = vectors.hashed_vectors(docs, "cleaned", stopwords=stopwords)
    else:
        embedded = vectors.model_vectors(docs, "cleaned", models.embedder)
        embed_more = lambda other, column: vectors.model_vectors(other, column, models.embedder)
    if use_seeds:
        seeds = docs.sparkSession.createDataFrame(
            [(i, i, " ".join(words)) for i, words in enumerate(fv.SEED_TOPICS)], "row_index bigint, seed_topic int, words string")
        seed_vectors = embed_more(seeds, "words").select("seed_topic", F.col("features").alias("seed_features"))
        matched = vectors.seed_match(embedded, "cleaned").drop("seed_similarity")
        if seed_radius is not None:
            # Messages without a seed word take the seed of the messages around them.
            placed = materialise(vectors.reduce_dimensions(matched), "seeded")
            matched = guidance.spread_seeds(placed, "reduced", "doc_index", seed_radius, by=["message_role"]).drop(
                "seed_topic", "spread_step", "reduced").withColumnRenamed("spread_topic", "seed_topic")
        embedded = vectors.blend_seeds(matched, seed_vectors).drop("seed_topic")
    reduced = materialise(vectors.reduce_dimensions(embedded).drop("features"), "reduced")
    width = cell_width or cluster.suggested_width(reduced, "reduced")
    return _clusters(reduced, clustering, width, min_cluster_size).withColumnRenamed("reduced", "vector"), embed_more


def model_topics(
    long: DataFrame,
    models: Models | None = None,
    min_cluster_size: int = fv.MIN_CLUSTER_SIZE,
    cell_width: float | None = None,
    merge_threshold: float = fv.MERGE_THRESHOLD,
    reduce_threshold: float | None = None,
    use_seeds: bool = True,
    max_docs: int | None = None,
    min_docs: int = fv.MIN_TERM_DOCS,
    roles: Sequence[str] = tuple(cleaning.ROLE_COLUMNS),
    stopwords: Sequence[str] = terms.STOPWORDS,
    dictionary: DataFrame | None = None,
    by_representation: bool = False,
    clustering: str = "grid",
    seed_radius: float | None = None,
    target_topics: int | None = None,
) -> dict[str, DataFrame]:
    """Topic tables of the role-long message table, with a topic model of its own for each role.

    ``clustering`` is ``grid``, ``neighbours`` (exact neighbours within ``cell_width``) or ``tree``
    (the clusters that last longest below that radius). With ``seed_radius``, seed topics spread to
    messages without a seed word. ``target_topics`` merges the topics of a role down to that number.
    ``by_representation`` compares topics by the vector of their representation
    text (terms and representative messages) instead of their centroid when
    they are merged. ``dictionary(form, lemma)`` replaces the built-in lemmas.
    """
    models = models or Models()
    docs = materialise(
        tables.with_row_index(
            eligibility.topic_eligible(long.filter(F.col("role").isin(list(roles))), max_docs=max_docs, dictionary=dictionary),
            "doc_index").withColumnRenamed("role", "message_role"),
        "topic-docs",
    )
    present = {r.message_role for r in docs.select("message_role").distinct().collect()}
    roles = [r for r in roles if r in present]
    if not roles:
        raise ValueError("no message is worth modelling")
    parts, embedders = [], {}
    for role in roles:
        part, embedders[role] = cluster_role(
            docs.filter(F.col("message_role") == role), models, min_cluster_size, cell_width, use_seeds, stopwords, clustering,
            seed_radius)
        parts.append(part)
    assigned = materialise(functools.reduce(DataFrame.unionByName, parts), "assigned")

    def ranked_terms(rows: DataFrame) -> DataFrame:
        return materialise(
            terms.topic_terms(terms.term_table(rows, "cleaned", stopwords, min_docs=min_docs)), "ranked-terms")

    def measured(rows: DataFrame, ranked: DataFrame, stage: str) -> DataFrame:
        coherence = metrics.role_coherence(metrics.topic_coherence(rows, "cleaned", ranked, stopwords=stopwords))
        return metrics.topic_metrics(rows, ranked).join(coherence, "message_role", "left").withColumn("stage", F.lit(stage))

    initial = measured(assigned, ranked_terms(assigned), "initial")
    rows = assigned
    if reduce_threshold is not None:
        rows = refine.reduce_topics(rows, vectors.stored_centroids(rows), reduce_threshold)
    if target_topics is not None:
        rows = refine.reduce_to_target(rows, vectors.stored_centroids(rows), target_topics)
    centres = vectors.stored_centroids(rows)
    if by_representation:
        texts = vectors.topic_representation(
            terms.term_lists(ranked_terms(rows)), representative_messages(rows, centres, 2)).withColumn("row_index", F.col("topic_id"))
        texts = functools.reduce(DataFrame.unionByName, [
            embedders[role](texts.filter(F.col("message_role") == role), "representation").select(
                *TOPIC, vector_to_array("features").alias("centroid")) for role in roles])
        centres = materialise(texts.join(centres.drop("centroid"), TOPIC), "representations")
    rows = refine.merge_topics(rows, centres, merge_threshold)
    rows = eligibility.filter_trivial(rows, "cleaned")
    rows = materialise(refine.drop_low_quality_topics(rows, "cleaned"), "final-topics")

    ranked = ranked_terms(rows)
    info = materialise(terms.topic_info(rows, ranked), "topic-info")
    named = info
    if models.labeller is not None:
        examples = representative_messages(rows, vectors.stored_centroids(rows), 10)
        prompts = labels.labelling_prompts(info, examples)
        named = info.join(labels.supplied_labels(prompts, models.labeller), TOPIC, "left")
    label_table = materialise(labels.intent_labels(named), "topic-labels")
    return {
        "message_topics": terms.message_topics(rows, label_table).select(
            "row_index", *TOPIC, "intent_label", F.col("text").alias("original_message"),
            F.col("cleaned").alias("cleaned_message")),
        "topic_info": info.join(label_table, TOPIC, "left"),
        "topic_keywords": terms.topic_keywords(info, label_table),
        "topic_examples": terms.topic_diagnostics(rows, "cleaned", "text", info, label_table),
        "topic_metrics": initial.unionByName(measured(rows, ranked, "post_processing")),
    }


def analyse_export(
    raw: DataFrame, models: Models | None = None, cache: DataFrame | None = None, topics: bool = True, **topic_options: Any
) -> dict[str, DataFrame]:
    """All result tables of a raw export."""
    models = models or Models()
    if "row_index" not in raw.columns:
        raw = tables.with_row_index(raw)
    run = translate.translate_messages(
        cleaning.clean_export(raw), models.translator, models.strict_translator, cache)
    messages = materialise(translate.translated_table(run), "messages")
    long = cleaning.role_long(messages)
    moods = materialise(sentiment.sentiment_messages(long, models.sentiment), "sentiment")
    scores = materialise(agency.agency_messages(long, models.agency), "agency")
    out = {
        "messages_translated": messages,
        "datetime_overview": summary.datetime_overview(messages),
        "cal_state_by_user": summary.cal_state_by_user(messages),
        "message_stats": summary.message_stats(long),
        "sentiment_all": moods,
        "sentiment_overview": sentiment.sentiment_overview(moods),
        "agency": scores,
        "agency_summary": agency.agency_summary(scores),
    }
    if models.translator is not None:
        out["translation_stats"] = translate.translation_stats(run)
    if topics:
        out.update(model_topics(long, models, **topic_options))
    return out


def write_results(results: dict[str, DataFrame], folder: str) -> None:
    """Store each table as Parquet below ``folder``."""
    for name, df in results.items():
        tables.write_parquet(df, f"{folder}/{name}.parquet")


def analyse_csv(spark: SparkSession, path: str, schema, folder: str, **options: Any) -> None:
    """Read a CSV export, analyse it and store every table."""
    raw = tables.read_csv(spark, path, schema)
    raw = tables.nullify_na_tokens(raw, raw.columns)
    # What the analysis stores on the way ends with it.
    with stored_tables(spark):
        write_results(analyse_export(raw, **options), folder)
