"""Message vectors, their reduction, topic centroids and similarity."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.ml.feature import IDF, PCA, HashingTF, IDFModel, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlens import fixed_values as fv
from chatlens.functions.text import evaluated_once
from chatlens.operators.joins import attach_by_key
from chatlens.operators.scoring import score_texts
from chatlens.session import materialise
from chatlens.topics.eligibility import TOPIC
from chatlens.topics.terms import STOPWORDS, add_terms

VECTOR_RESULT = T.StructType([T.StructField("vector", T.ArrayType(T.DoubleType()))])


# --- vectors -------------------------------------------------------------------

def _hashed(docs: DataFrame, text_col: str, dims: int, stopwords: Sequence[str]) -> DataFrame:
    with_terms = add_terms(docs, text_col, stopwords, "_terms")
    return HashingTF(inputCol="_terms", outputCol="_tf", numFeatures=dims).transform(with_terms).drop("_terms")


def _weighted(hashed: DataFrame, idf: IDFModel) -> DataFrame:
    return Normalizer(inputCol="_idf", outputCol="features").transform(idf.transform(hashed)).drop("_tf", "_idf")


def hashed_vectors(
    docs: DataFrame, text_col: str, dims: int = 256, stopwords: Sequence[str] = STOPWORDS
) -> tuple[DataFrame, Callable[[DataFrame, str], DataFrame]]:
    """The built-in embedding: hashed TF-IDF of unit length in column ``features``.

    Also returns a function that embeds another table with the same weights.
    """
    # Stored, because the fit and each later use would hash all texts again.
    hashed = materialise(_hashed(docs, text_col, dims, stopwords), "hashed-terms")
    idf = IDF(inputCol="_tf", outputCol="_idf").fit(hashed)
    return _weighted(hashed, idf), lambda other, column: _weighted(_hashed(other, column, dims, stopwords), idf)


def model_vectors(docs: DataFrame, text_col: str, load_model: Callable[[], Any], batch_size: int = 32) -> DataFrame:
    """Vectors from an embedding model, each distinct text embedded once."""
    scored = score_texts(docs, text_col, load_model, VECTOR_RESULT, batch_size)
    raw = scored.withColumn("features", array_to_vector("vector")).drop("vector")
    return Normalizer(inputCol="features", outputCol="_unit").transform(raw).drop("features").withColumnRenamed(
        "_unit", "features")


def blend_seeds(docs: DataFrame, seed_vectors: DataFrame, weights: tuple[float, float] = (3.0, 1.0)) -> DataFrame:
    """Pull messages that match a seed topic towards the seed's vector.

    ``seed_vectors(seed_topic, seed_features)`` has one row per seed list, a
    number fixed by the caller's configuration.
    """
    own, seed = vector_to_array("features"), vector_to_array("seed_features")
    total = sum(weights)
    mixed = F.zip_with(own, seed, lambda a, b: (a * weights[0] + b * weights[1]) / total)
    joined = docs.join(F.broadcast(seed_vectors), "seed_topic", "left")
    features = F.when(F.col("seed_features").isNull(), F.col("features")).otherwise(array_to_vector(mixed))
    return joined.withColumn("features", features).drop("seed_features")


def reduce_dimensions(df: DataFrame, k: int = fv.REDUCED_DIMENSIONS) -> DataFrame:
    """Project unit vectors to ``k`` principal components, as array ``reduced``.

    The fit is one distributed pass that returns a (dims × dims) matrix.
    """
    unit = Normalizer(inputCol="features", outputCol="_unit").transform(df)
    model = PCA(k=k, inputCol="_unit", outputCol="_pc").fit(unit)
    return model.transform(unit).withColumn("reduced", vector_to_array("_pc")).drop("_unit", "_pc")


# --- guided topics ---------------------------------------------------------------

def seed_match(docs: DataFrame, text_col: str, seeds: Sequence[Sequence[str]] = fv.SEED_TOPICS) -> DataFrame:
    """The seed topic most similar to each message, null without any shared word.

    Similarity is the cosine of the two word sets. The few seed lists are
    literals, so this is a projection and not a join.
    """
    df = evaluated_once(docs, _set=F.array_distinct(
        F.regexp_extract_all(F.lower(F.coalesce(text_col, F.lit(""))), F.lit(f"[{fv.WORD_CLASS}]{{2,}}"), 0)))
    scores = [
        F.struct(
            F.when(F.size("_set") == 0, 0.0).otherwise(
                F.size(F.array_intersect("_set", F.array(*[F.lit(w) for w in seed])))
                / F.sqrt(F.size("_set") * F.lit(len(seed)))
            ).alias("similarity"),
            F.lit(-i).alias("order"),
        )
        for i, seed in enumerate(seeds)
    ]
    df = evaluated_once(df, _best=F.array_max(F.array(*scores)))
    hit = F.col("_best.similarity") > 0
    return df.withColumn("seed_topic", F.when(hit, -F.col("_best.order"))).withColumn(
        "seed_similarity", F.when(hit, F.col("_best.similarity"))
    ).drop("_set", "_best")


# --- centroids and similarity ------------------------------------------------------

def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def unit(vector: Column) -> Column:
    length = F.sqrt(dot(vector, vector))
    return F.when(length == 0, vector).otherwise(F.transform(vector, lambda x: x / length))


def centroids(docs: DataFrame, vector_col: str = "vector") -> DataFrame:
    """Mean vector and size of each topic; combined before the shuffle."""
    rows = docs.filter(F.col("topic_id") != -1).withColumn("_v", array_to_vector(F.col(vector_col).cast("array<double>")))
    return rows.groupBy(*TOPIC).agg(
        Summarizer.mean(F.col("_v")).alias("_mean"), F.count("*").alias("message_count")
    ).select(*TOPIC, "message_count", vector_to_array("_mean").alias("centroid"))


def leading_axes(topics: DataFrame, column: str, k: int) -> DataFrame:
    """Add ``_p``: the coordinates of the vectors along their ``k`` leading principal axes.

    The fit is one distributed pass that returns a (dims x dims) matrix.
    """
    with_vector = topics.withColumn("_dense", array_to_vector(column))
    fitted = PCA(k=k, inputCol="_dense", outputCol="_pc").fit(with_vector)
    return fitted.transform(with_vector).withColumn("_p", vector_to_array("_pc")).drop("_dense", "_pc")


def candidate_pairs(topics: DataFrame, threshold: float, vector_col: str = "centroid", grid_dims: int = 3) -> DataFrame:
    """Pairs of topics of a role that may reach the cosine ``threshold``, with their unit vectors.

    Unit vectors with cosine t are at most r = sqrt(2 - 2t) apart, and no
    projection makes them farther. They are projected to the axes along which
    they differ most and put into a grid of width r; topics only meet topics of
    the same or a touching cell, through an equi-join on the cell. No
    qualifying pair can be missed. Of each two touching cells only one reaches
    for the other.
    """
    width = max(math.sqrt(max(2 - 2 * threshold, 0.0)) * (1 + 1e-9), 1e-6)
    units = evaluated_once(topics.select(*TOPIC, vector_col), _u=unit(F.col(vector_col).cast("array<double>"))).drop(vector_col)
    size = units.agg(F.count("*").alias("n"), F.max(F.size("_u")).alias("d")).first()
    if size.n >= 2:
        units = leading_axes(units, "_u", min(grid_dims, size.d))
    else:
        units = units.withColumn("_p", F.array(F.lit(0.0)))
    cell = [F.floor(F.coalesce(F.get("_p", F.lit(i)), F.lit(0.0)) / width).alias(f"_c{i}") for i in range(grid_dims)]
    placed = units.select(*TOPIC, "_u", *cell)
    # The zero step and those whose first step other than zero goes up: half of the neighbours.
    ahead = [step for step in itertools.product((-1, 0, 1), repeat=grid_dims) if step >= (0,) * grid_dims]
    steps = F.array(*[
        F.struct(*[F.lit(s).alias(f"_s{i}") for i, s in enumerate(step)], F.lit(any(step)).alias("_moved")) for step in ahead
    ])
    names = [f"_c{i}" for i in range(grid_dims)]
    reach = placed.select("message_role", F.col("topic_id").alias("_x"), F.col("_u").alias("_a"), *names, F.inline(steps)).select(
        "message_role", "_x", "_a", "_moved", *[(F.col(f"_c{i}") + F.col(f"_s{i}")).alias(f"_c{i}") for i in range(grid_dims)])
    other = placed.select("message_role", F.col("topic_id").alias("_y"), F.col("_u").alias("_b"), *names)
    met = reach.join(other, ["message_role", *names]).filter(F.col("_moved") | (F.col("_x") < F.col("_y")))
    return met.select(
        "message_role", F.least("_x", "_y").alias("topic_a"), F.greatest("_x", "_y").alias("topic_b"), "_a", "_b")


def similar_pairs(topics: DataFrame, threshold: float, vector_col: str = "centroid", grid_dims: int = 3) -> DataFrame:
    """All pairs of topics of a role with cosine of at least ``threshold``."""
    met = candidate_pairs(topics, threshold, vector_col, grid_dims)
    return evaluated_once(met, similarity=dot(F.col("_a"), F.col("_b"))).filter(
        F.col("similarity") >= threshold
    ).select("message_role", "topic_a", "topic_b", "similarity")


def representative_docs(docs: DataFrame, centres: DataFrame, vector_col: str = "vector", top: int = 2) -> DataFrame:
    """The messages closest to their topic's centroid; ties by row index."""
    rows = docs.filter(F.col("topic_id") != -1)
    joined = attach_by_key(
        rows, centres.select(*TOPIC, "centroid"), TOPIC,
        centres.select(*TOPIC, F.col("message_count").alias("n_rows")), ["row_index"],
    )
    scored = evaluated_once(
        joined, similarity=dot(unit(F.col(vector_col).cast("array<double>")), unit(F.col("centroid")))
    )
    best = Window.partitionBy(*TOPIC).orderBy(F.round("similarity", 9).desc(), "row_index")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).drop("centroid")


def topic_representation(lists: DataFrame, examples: DataFrame) -> DataFrame:
    """Ten terms and two representative messages as one text per topic.

    ``examples`` are ranked messages ``(message_role, topic_id, rank, example)``.
    """
    two = examples.filter(F.col("rank") <= 2).groupBy(*TOPIC).agg(
        F.array_sort(F.collect_list(F.struct("rank", "example"))).alias("_e"))
    return lists.join(two, TOPIC, "left").select(
        *TOPIC,
        F.trim(F.concat_ws(" ", F.array_join(F.slice("terms", 1, 10), " "), F.array_join(F.col("_e.example"), " ")))
        .alias("representation"),
    )


def stored_centroids(docs: DataFrame, vector_col: str = "vector") -> DataFrame:
    return materialise(centroids(docs, vector_col), "centroids")
