"""Corrections to a topic assignment: drop, merge and reduce topics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlens import fixed_values as fv
from chatlens.session import materialise
from chatlens.sources.tables import with_row_index
from chatlens.topics.components import connected_components
from chatlens.topics.eligibility import TOPIC, topic_quality
from chatlens.topics.vectors import similar_pairs

TOPIC_BLOCK = 2048  # topics that are compared with as many others at a time


def _relabel(docs: DataFrame, mapping: DataFrame) -> DataFrame:
    """Replace topic ids by ``mapping(message_role, topic_id, new_id)``; others stay.

    The mapping is stored first: with its size known, the join broadcasts it
    unless there are very many topics, and the messages are not moved.
    """
    stored = materialise(mapping, "topic-mapping")
    return docs.join(stored, TOPIC, "left").withColumn("topic_id", F.coalesce("new_id", "topic_id")).drop("new_id")


def drop_low_quality_topics(docs: DataFrame, text_col: str) -> DataFrame:
    """Messages of topics that are too short or read like assistant text become outliers."""
    low = topic_quality(docs, text_col).filter("low_quality").select(*TOPIC, F.lit(-1).alias("new_id"))
    return _relabel(docs, low)


def merged_ids(
    topics: DataFrame, threshold: float = fv.MERGE_THRESHOLD, max_merges: int = fv.MAX_MERGES
) -> DataFrame:
    """``(message_role, topic_id, new_id)`` after merging the closest pairs.

    ``topics(message_role, topic_id, message_count, centroid)`` is the only
    input: the centroid of a merged topic is the weighted mean of its parts, so
    no round reads the messages again. Each round merges the most similar pair
    of each role, ties by the smaller ids, into the smaller id.
    """
    state = topics.withColumn("new_id", F.col("topic_id"))
    for _ in range(max_merges):
        state = materialise(state, "merge-state")
        current = state.groupBy("message_role", F.col("new_id").alias("topic_id")).agg(
            Summarizer.mean(array_to_vector(F.col("centroid").cast("array<double>")), F.col("message_count").cast("double"))
            .alias("_m"),
        ).select(*TOPIC, vector_to_array("_m").alias("centroid"))
        pairs = similar_pairs(current, threshold)
        # One row per role.
        best = F.broadcast(pairs.groupBy("message_role").agg(
            F.min_by(F.struct("topic_a", "topic_b"), F.struct(-F.round("similarity", 9), "topic_a", "topic_b")).alias("_p")))
        state = state.join(best, "message_role", "left").withColumn(
            "new_id", F.when(F.col("new_id") == F.col("_p.topic_b"), F.col("_p.topic_a")).otherwise(F.col("new_id"))
        ).drop("_p")
    return state.select(*TOPIC, "new_id")


def merge_topics(
    docs: DataFrame, topics: DataFrame, threshold: float = fv.MERGE_THRESHOLD, max_merges: int = fv.MAX_MERGES
) -> DataFrame:
    """Apply :func:`merged_ids` to the messages."""
    changed = merged_ids(topics, threshold, max_merges).filter(F.col("new_id") != F.col("topic_id"))
    return _relabel(docs, changed)


def _unit_rows(vectors: pd.Series) -> np.ndarray:
    rows = np.stack(vectors.to_numpy())
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length > 0, length, 1)


def _nearest_in_block(rows: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
    """For each topic of ``rows`` its most similar one in ``others``; ties to the smaller id."""
    out = {"message_role": [], "topic_id": [], "nearest": [], "similarity": []}
    if len(rows) and len(others):
        others = others.sort_values("topic_id")
        near = np.round(_unit_rows(rows["centroid"]) @ _unit_rows(others["centroid"]).T, 9)
        near[rows["topic_id"].to_numpy()[:, None] == others["topic_id"].to_numpy()[None, :]] = -np.inf
        best = near.argmax(axis=1)
        found = near[np.arange(len(rows)), best]
        keep = np.isfinite(found)
        out = {"message_role": rows["message_role"].to_numpy()[keep], "topic_id": rows["topic_id"].to_numpy()[keep],
               "nearest": others["topic_id"].to_numpy()[best][keep], "similarity": found[keep]}
    return pd.DataFrame(out)


def nearest_topics(topics: DataFrame, block: int = TOPIC_BLOCK) -> DataFrame:
    """``message_role, topic_id, nearest, similarity``: the topic of the same role with the highest cosine.

    Topics meet block against block and each block answers with one row per topic, so neither pairs
    nor a role's topics ever stand in one place. Similarities are rounded to 9 digits; ties go to
    the smaller id. A topic that is alone in its role has no row.
    """
    stored = materialise(topics.select("message_role", "topic_id", F.col("centroid").cast("array<double>").alias("centroid")), "topic-centres")
    largest = stored.groupBy("message_role").count().agg(F.max("count")).first()[0] or 0
    blocks = max(1, -(-largest // block))
    at = F.pmod(F.xxhash64("topic_id"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = stored.withColumns({"_a": at, "_b": every}).groupBy("message_role", "_a", "_b")
    right = stored.withColumn("_b", at).withColumn("_a", every).groupBy("message_role", "_a", "_b")
    kind = stored.schema["topic_id"].dataType.simpleString()
    found = left.cogroup(right).applyInPandas(
        _nearest_in_block, f"message_role string, topic_id {kind}, nearest {kind}, similarity double")
    return found.groupBy(*TOPIC).agg(F.min(F.struct((-F.col("similarity")).alias("apart"), "nearest")).alias("m")).select(
        *TOPIC, F.col("m.nearest").alias("nearest"), (-F.col("m.apart")).alias("similarity"))


def ids_for_target(topics: DataFrame, target: int) -> DataFrame:
    """``(message_role, topic_id, new_id)`` after merging each role down to ``target`` topics.

    ``topics(message_role, topic_id, message_count, centroid)`` is the only input. In each round the
    pairs that are each other's nearest topic merge at once into the smaller id, the most similar
    first and no more than the role has topics too many; the centroid of a merged topic is the
    weighted mean of its parts. The most similar pair of a role is always such a pair, so every round
    makes progress; there are at most as many rounds as topics to merge, each over one row per
    topic. Roles with at most ``target`` topics stay as they are.
    """
    if target < 1:
        raise ValueError("target must be at least 1")
    state = materialise(topics.withColumn("new_id", F.col("topic_id")), "target-state")
    while True:
        excess = materialise(state.groupBy("message_role").agg(
            (F.count_distinct("new_id") - target).alias("_excess")).filter("_excess > 0"), "target-excess")
        if excess.isEmpty():
            return state.select(*TOPIC, "new_id")
        # One row per role.
        current = state.join(F.broadcast(excess), "message_role", "left_semi").groupBy("message_role", F.col("new_id").alias("topic_id")).agg(
            Summarizer.mean(array_to_vector(F.col("centroid").cast("array<double>")), F.col("message_count").cast("double")).alias("_m"),
        ).select(*TOPIC, vector_to_array("_m").alias("centroid"))
        near = materialise(nearest_topics(current), "target-nearest")
        back = near.select("message_role", F.col("topic_id").alias("nearest"), F.col("nearest").alias("_back"))
        mutual = near.join(back, ["message_role", "nearest"]).filter((F.col("_back") == F.col("topic_id")) & (F.col("topic_id") < F.col("nearest")))
        order = Window.partitionBy("message_role").orderBy(F.desc("similarity"), "topic_id")
        merged = mutual.withColumn("_rank", F.row_number().over(order)).join(F.broadcast(excess), "message_role").filter(
            F.col("_rank") <= F.col("_excess")).select("message_role", F.col("nearest").alias("new_id"), F.col("topic_id").alias("_into"))
        state = materialise(state.join(merged, ["message_role", "new_id"], "left").withColumn(
            "new_id", F.coalesce("_into", "new_id")).drop("_into"), "target-state")


def reduce_to_target(docs: DataFrame, topics: DataFrame, target: int) -> DataFrame:
    """Merge topics until each role has at most ``target`` of them; outliers stay."""
    return _relabel(docs, ids_for_target(topics, target).filter(F.col("new_id") != F.col("topic_id")))


def reduced_ids(topics: DataFrame, threshold: float) -> DataFrame:
    """Join all topics of a role that are linked by pairs of at least ``threshold``.

    Each (role, topic) is a node of its own, whatever the roles are called; a
    group takes its smallest topic id.
    """
    pairs = materialise(similar_pairs(topics, threshold), "similar-pairs")
    nodes = with_row_index(topics.select(*TOPIC), "node")
    end = lambda topic, node: nodes.select("message_role", F.col("topic_id").alias(topic), F.col("node").alias(node))
    edges = pairs.join(end("topic_a", "u"), ["message_role", "topic_a"]).join(end("topic_b", "v"), ["message_role", "topic_b"])
    parts = connected_components(edges.select("u", "v"))
    placed = nodes.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("topic_id").alias("new_id"))
    return placed.join(least, "component").select(*TOPIC, "new_id")


def reduce_topics(docs: DataFrame, topics: DataFrame, threshold: float) -> DataFrame:
    changed = reduced_ids(topics, threshold).filter(F.col("new_id") != F.col("topic_id"))
    return _relabel(docs, changed)
