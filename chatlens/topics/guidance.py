"""Seed topics that reach messages without a seed word, along the neighbour graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens import fixed_values as fv
from chatlens.session import materialise
from chatlens.topics.neighbours import GROUP, NeighbourGraph, group_key, join_points, neighbour_graph, usable_coordinates


def _most_votes(votes: DataFrame) -> DataFrame:
    """``set, seed`` from ``votes(set, seed, n)``: most votes, ties to the smaller seed."""
    summed = votes.groupBy("set", "seed").agg(F.sum("n").alias("n"))
    return summed.groupBy("set").agg(F.min(F.struct(-F.col("n"), "seed"))["seed"].alias("seed"))


def spread_over_sets(graph: NeighbourGraph, seeded: DataFrame) -> DataFrame:
    """``set, seed, step`` of all sets that a seed reaches; ``seeded(spot, seed, n)`` counts matched points.

    A set with matched core points takes the seed of most of them (step 0). In each further step,
    the sets without a seed that neighbour some with one take the seed behind which most points of
    these neighbours stand. Ties go to the smaller seed. A seed once taken stays, and the steps end
    when none reaches a new set, so the result is a fixed point that does not depend on the order.
    """
    core = graph.spots.filter("core")
    weight = materialise(core.groupBy("set").agg(F.sum("n").alias("n")), "set-weights")
    ends = materialise(graph.links.unionByName(graph.links.select(F.col("v").alias("u"), F.col("u").alias("v"))), "set-ends")
    votes = core.select("spot", "set").join(seeded, "spot").select("set", "seed", "n")
    taken = materialise(_most_votes(votes).withColumn("step", F.lit(0)), "spread")
    front, step = taken, 0
    while not front.isEmpty():
        step += 1
        # Only the neighbours of sets that the last step reached can be new.
        open_ends = ends.join(front.select(F.col("set").alias("u")), "u", "left_semi").select("v").distinct().join(
            taken.select(F.col("set").alias("v")), "v", "left_anti")
        backing = ends.join(open_ends, "v").join(taken.select(F.col("set").alias("u"), "seed"), "u").join(
            weight.withColumnRenamed("set", "u"), "u")
        front = materialise(_most_votes(backing.select(F.col("v").alias("set"), "seed", "n")).withColumn("step", F.lit(step)), "spread-front")
        taken = materialise(taken.unionByName(front), "spread")
    return taken


def spread_seeds(
    points: DataFrame, coords_col: str, id_col: str, radius: float, dims: int = fv.REDUCED_DIMENSIONS,
    min_samples: int = fv.MIN_SAMPLES, by: Sequence[str] = (), seed_col: str = "seed_topic",
) -> DataFrame:
    """Add ``spread_topic`` and ``spread_step``: the seed topic of each point after spreading.

    A point with a seed keeps it (step 0). Any other core point takes the seed of its set, and a
    point that is not core that of its nearest core point within ``radius``; see
    :func:`spread_over_sets`. Points that no seed reaches, and points without finite coordinates and
    seed, have nulls. Within a group of ``by`` equal points are one place.
    """
    graph = neighbour_graph(points, coords_col, id_col, radius, dims, min_samples, by)
    at = F.transform(coords_col, lambda v: v.cast("double") + F.lit(0.0))
    matched = points.filter(usable_coordinates(coords_col, dims) & F.col(seed_col).isNotNull()).groupBy(
        group_key(by).alias(GROUP), at.alias("x"), F.col(seed_col).alias("seed")).agg(F.count("*").alias("n"))
    seeded = materialise(matched.join(graph.spots.select(GROUP, "x", "spot"), [GROUP, "x"]).select("spot", "seed", "n"), "seeded-spots")
    reached = spread_over_sets(graph, seeded)
    own = graph.spots.join(graph.border.withColumnRenamed("set", "_near"), "spot", "left").withColumn(
        "set", F.when(F.col("core"), F.col("set")).otherwise(F.col("_near")))
    placed = materialise(own.join(reached, "set").select(GROUP, "x", F.col("seed").alias("_seed"), F.col("step").alias("_step")), "spread-spots")
    out = join_points(points.drop("spread_topic", "spread_step"), placed, coords_col, by, dims)
    return out.withColumns({
        "spread_topic": F.coalesce(F.col(seed_col), F.col("_seed")),
        "spread_step": F.when(F.col(seed_col).isNotNull(), 0).otherwise(F.col("_step")),
    }).drop("_seed", "_step")
