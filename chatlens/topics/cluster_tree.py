"""Hierarchy of density clusters: spanning forest over mutual reachability, levels, stable clusters.

A point's core distance is the radius at which it has enough neighbours; two points are mutually
reachable at the largest of both core distances and their own distance. A minimum spanning forest
of these lengths holds, for every radius, the clusters at that radius. It comes from Boruvka
rounds: each component takes its shortest edge, the components that meet become one, and of
parallel edges only the shortest goes on. A ladder of radii then gives a tree of clusters, and the
clusters that last longest in it are chosen, so dense and sparse ones are found side by side.

Points are first put together in cells of a ``grain`` (equal points always are), each with its mean
and its count. The tree asks for clusters at the radii of its ladder only, so the lengths are taken
in these steps: an edge is as long as the least radius that links its ends. The edges come from the
sets of `neighbours.core_graph` at each radius, whose number depends on the space that the points
fill; no list of all pairs within a radius is made.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlens import fixed_values as fv
from chatlens.session import materialise
from chatlens.sources.tables import with_row_index
from chatlens.topics.cluster import numbered_by_size
from chatlens.topics.components import connected_components
from chatlens.topics.neighbours import GROUP, core_graph, group_key, squared_distance, usable_coordinates

LEVELS = 8
SHRINK = 2 ** 0.5  # ratio of a radius to the next one
GRAINS_PER_RADIUS = 16


class ClusterTree(NamedTuple):
    """``clusters``: one row per cluster of the tree, with its parent, the radius at which it
    appears, its size there, its stability, and whether it is chosen; ``points``: the input with
    ``topic_id`` (-1 outside of chosen clusters)."""

    clusters: DataFrame
    points: DataFrame


def ladder(radius: float, levels: int = LEVELS, shrink: float = SHRINK) -> list[float]:
    """The radii of the levels, largest first."""
    return [radius / shrink ** k for k in range(levels)]


def grains(points: DataFrame, coords_col: str, id_col: str, grain: float, dims: int, by: Sequence[str]) -> tuple[DataFrame, Column]:
    """``_g, key, node, x, n``: cells of width ``grain`` (0: distinct points), numbered; and the key of a point."""
    exact = F.transform(coords_col, lambda v: v.cast("double") + F.lit(0.0))
    key = F.transform(coords_col, lambda v: F.floor(v / grain).cast("long")) if grain > 0 else exact
    good = points.filter(usable_coordinates(coords_col, dims)).select(group_key(by).alias(GROUP), key.alias("key"), exact.alias("x"), id_col)
    cells = good.groupBy(GROUP, "key").agg(
        F.array(*[F.avg(F.get("x", F.lit(i))) for i in range(dims)]).alias("mean"), F.min("x").alias("x"), F.count("*").alias("n"),
        F.min(F.col(id_col).cast("long")).alias("first"))
    # The mean of equal points may differ from them by rounding.
    cells = cells.withColumn("x", F.col("mean") if grain > 0 else F.col("x")).drop("mean")
    return materialise(with_row_index(cells.orderBy(GROUP, "first"), "node"), "grains"), key


def radius_edges(cells: DataFrame, radius: float, dims: int) -> DataFrame:
    """``u, v, d`` (squared distance) of all pairs of cells of a group within the radius, u < v."""
    width = radius * (1 + 1e-9)
    placed = cells.select(GROUP, "node", "x", "n", F.transform("x", lambda v: F.floor(v / width).cast("long")).alias("at"))
    ahead = [s for s in itertools.product((-1, 0, 1), repeat=dims) if s >= (0,) * dims]
    steps = F.array(*[F.array(*[F.lit(v).cast("long") for v in s]) for s in ahead])
    reach = placed.withColumn("_s", F.explode(steps)).select(
        GROUP, F.col("node").alias("a"), F.col("x").alias("x_a"), F.zip_with("at", "_s", lambda k, s: k + s).alias("at"),
        F.exists("_s", lambda s: s != 0).alias("moved"))
    other = placed.select(GROUP, F.col("node").alias("b"), F.col("x").alias("x_b"), "at")
    met = reach.join(other, [GROUP, "at"]).filter(F.col("moved") | (F.col("a") < F.col("b")))
    near = met.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), squared_distance("x_a", "x_b", dims).alias("d"))
    return near.filter(F.col("d") <= radius * radius)


def core_distances(cells: DataFrame, edges: DataFrame, min_samples: int) -> DataFrame:
    """``node, core``: squared distance within which a cell has ``min_samples`` points, itself included.

    Cells that have fewer within the radius of the edges are left out.
    """
    ends = edges.select("u", "v", "d").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "d"))
    around = ends.join(cells.select(F.col("node").alias("v"), "n"), "v").select(F.col("u").alias("node"), "d", "n", F.col("v").alias("other"))
    own = cells.select("node", F.lit(0.0).alias("d"), "n", F.lit(-1).cast("long").alias("other"))
    # One partition holds the neighbours of one cell, whose number the grain bounds.
    nearest = Window.partitionBy("node").orderBy("d", "other")
    reached = own.unionByName(around).withColumn("_n", F.sum("n").over(nearest)).filter(F.col("_n") >= min_samples)
    return reached.groupBy("node").agg(F.min("d").alias("core"))


def reachability(edges: DataFrame, cores: DataFrame) -> DataFrame:
    """``u, v, w``: the squared mutual reachability of edges between cells with a core distance."""
    core = lambda c: cores.select(F.col("node").alias(c), F.col("core").alias(f"core_{c}"))
    return edges.join(core("u"), "u").join(core("v"), "v").select("u", "v", F.greatest("d", "core_u", "core_v").alias("w"))


def ladder_edges(cells: DataFrame, radii: Sequence[float], dims: int, min_samples: int) -> tuple[DataFrame, DataFrame]:
    """``node, core, home`` of the cells that are core at some radius, and edges ``u, v, w`` between homes.

    ``core`` and ``w`` are squares of the least radius of the ladder at which a cell is core and an
    edge links its ends. ``home`` is the set that the cell is in at that radius, named after its first
    cell; a cell stays with its home at all larger radii. Paths of edges up to the square of a radius
    link just the cells that chains of core cells within this radius link.
    """
    spots = cells.select(GROUP, "x", F.col("node").alias("spot"), "n")
    homes, steps = None, []
    for radius in sorted(radii):
        graph, length = core_graph(spots, radius, dims, min_samples), F.lit(radius * radius)
        here = graph.spots.filter("core").select(F.col("spot").alias("node"), "set")
        if homes is None:
            homes = materialise(here.select("node", length.alias("core"), F.col("set").alias("home")), "homes")
        else:
            # What was core at a smaller radius still is.
            here = materialise(here.join(homes, "node", "left").select(
                "node", "set", F.coalesce("core", length).alias("core"), F.coalesce("home", "set").alias("home")), "homes")
            homes = here.select("node", "core", "home")
            steps.append(here.select(F.col("home").alias("u"), F.col("set").alias("v"), length.alias("w")).distinct())
        steps.append(graph.links.select("u", "v", length.alias("w")))
    ends = functools.reduce(DataFrame.unionByName, steps).filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w")
    return homes, ends.groupBy("u", "v").agg(F.min("w").alias("w"))


def spanning_forest(edges: DataFrame) -> DataFrame:
    """The minimum spanning forest of ``edges(u, v, w)``, u < v, as a stored table of the same columns.

    Edges of equal length are ordered by their ends, so the forest is unique and a round cannot
    close a circle. Each round at least halves the components that still have edges.
    """
    shortest = F.min(F.struct("w", "u", "v")).alias("e")
    taken = [edges.select("u", "v", "w").limit(0)]
    rest = materialise(edges.select(F.col("u").alias("a"), F.col("v").alias("b"), F.struct("w", "u", "v").alias("e")), "forest-edges")
    while not rest.isEmpty():
        ends = rest.select("a", "e").unionByName(rest.select(F.col("b").alias("a"), "e"))
        best = ends.groupBy("a").agg(F.min("e").alias("e")).select("e").distinct()
        chosen = materialise(rest.join(best, "e", "left_semi"), "forest-chosen")
        taken.append(chosen.select("e.*").select("u", "v", "w"))
        parts = connected_components(chosen.select(F.col("a").alias("u"), F.col("b").alias("v")))
        part = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"part_{c}"))
        # Every component with an edge has chosen one, so both ends have a part.
        between = rest.join(part("a"), "a").join(part("b"), "b").filter("part_a <> part_b").select(
            F.least("part_a", "part_b").alias("a"), F.greatest("part_a", "part_b").alias("b"), "e.*")
        rest = materialise(between.groupBy("a", "b").agg(shortest), "forest-edges")
    return materialise(functools.reduce(DataFrame.unionByName, taken), "forest")


def level_parts(homes: DataFrame, forest: DataFrame, radii: Sequence[float]) -> DataFrame:
    """``level, node, part``: the clusters at each radius, all levels in one search for components.

    A cell takes part, where its home is, from the radius on that reaches its core distance.
    """
    n = len(radii)
    squares = F.array(*[F.lit(r * r) for r in radii])
    inside = lambda length: F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.get(squares, k) >= F.col(length))
    number = lambda c: F.col(c) * n + F.col("level")
    edges = forest.withColumn("level", F.explode(inside("w"))).select(number("u").alias("u"), number("v").alias("v"))
    parts = connected_components(edges)
    members = homes.withColumn("level", F.explode(inside("core")))
    joined = members.withColumn("_id", number("home")).join(parts.select(F.col("node").alias("_id"), "component"), "_id", "left")
    return joined.select("level", "node", F.coalesce(F.expr(f"component div {n}"), F.col("home")).alias("part"))


def _weighed(nodes: DataFrame, radii: Sequence[float]) -> dict[int, DataFrame]:
    """Per level, from the densest up: how long a cluster lasts and what the clusters in it are worth.

    ``chain`` is the stability of the cluster from this level down to where it splits or ends,
    ``below`` the worth of the clusters that it splits into.
    """
    out: dict[int, DataFrame] = {}
    for level in reversed(range(len(radii))):
        # A cluster is weighed from the first radius on; what lies beyond it is unknown.
        step = 1 / radii[level] - 1 / radii[level - 1] if level else 0.0
        here = nodes.filter(F.col("level") == level).withColumn("gain", F.col("n") * F.lit(step))
        if level + 1 in out:
            inner = out[level + 1]
            children = inner.groupBy(F.col("above").alias("part")).agg(
                F.count("*").alias("k"), F.sum(F.round(F.greatest("chain", "below"), 9)).alias("worth"),
                F.max("chain").alias("_chain"), F.max("below").alias("_below"))
            here = here.join(children, "part", "left")
        else:
            here = here.withColumns({"k": F.lit(0), "worth": F.lit(0.0), "_chain": F.lit(0.0), "_below": F.lit(0.0)})
        k = F.coalesce("k", F.lit(0))
        out[level] = materialise(here.select(
            GROUP, "level", "part", "above", "n", k.alias("k"),
            (F.col("gain") + F.when(k == 1, F.col("_chain")).otherwise(0.0)).alias("chain"),
            F.when(k == 1, F.col("_below")).when(k > 1, F.col("worth")).otherwise(0.0).alias("below")), f"tree-level-{level}")
    return out


def _chosen(weighed: dict[int, DataFrame], radii: Sequence[float]) -> DataFrame:
    """One row per cluster of the tree, from the sparsest level down."""
    heads, above = [], None
    for level in range(len(radii)):
        here = weighed[level]
        if above is not None:
            here = here.join(above, "above", "left")
        else:
            none = F.lit(None)
            here = here.withColumns({"_level": none.cast("int"), "_part": none.cast("long"), "_k": none.cast("long"), "_state": none.cast("string")})
        # A cluster goes on under its first level and part as long as it has one part only.
        goes_on = F.coalesce(F.col("_k") == 1, F.lit(False))
        free = F.col("_state").isNull() | (F.col("_state") == "split")
        own = F.when(free & (F.round("chain", 9) >= F.round("below", 9)), "chosen").when(free, "split").otherwise("within")
        now = here.select(
            GROUP, "part", "n", "k", "chain",
            F.when(goes_on, F.col("_level")).otherwise(F.lit(level)).alias("head_level"),
            F.when(goes_on, F.col("_part")).otherwise(F.col("part")).alias("head_part"),
            F.when(goes_on, F.col("_state")).otherwise(own).alias("state"),
            F.when(~goes_on, F.col("_level")).alias("parent_level"), F.when(~goes_on, F.col("_part")).alias("parent_part"), goes_on.alias("goes_on"))
        now = materialise(now, "tree-heads")
        heads.append(now.filter("not goes_on").drop("goes_on", "k"))
        above = now.select(
            F.col("part").alias("above"), F.col("k").alias("_k"), F.col("head_level").alias("_level"), F.col("head_part").alias("_part"),
            F.when(F.col("state") == "split", "split").otherwise("within").alias("_state"))
    return functools.reduce(DataFrame.unionByName, heads)


def cluster_tree(
    points: DataFrame, coords_col: str, id_col: str, radius: float, dims: int = fv.REDUCED_DIMENSIONS,
    min_samples: int = fv.MIN_SAMPLES, min_cluster_size: int = fv.MIN_CLUSTER_SIZE, by: Sequence[str] = (),
    levels: int = LEVELS, shrink: float = SHRINK, grain: float | None = None,
) -> ClusterTree:
    """The tree of density clusters of ``points`` at a ladder of radii, and the clusters that last longest.

    The ladder begins at ``radius`` and each level is ``shrink`` times finer. A cluster at a level
    has at least ``min_cluster_size`` points. It goes on as the same cluster while one such part is
    left at the next level, splits if there are several, and ends if there is none. Its stability
    sums its size times the growth of 1 / radius from level to level. From the leaves up, a cluster
    is chosen if it is at least as stable as the chosen clusters inside it together.

    ``grain`` (default: a fraction of the radius) is the width of the cells that are treated as one
    point; with 0 only equal points are. Every point counts. Points without ``dims`` finite
    coordinates are outliers; ``id_col`` must be unique and integral; an empty table gives an empty one.
    """
    radii = ladder(radius, levels, shrink)
    cells, key = grains(points, coords_col, id_col, radius / GRAINS_PER_RADIUS if grain is None else grain, dims, by)
    homes, edges = ladder_edges(cells, radii, dims, min_samples)
    parts = materialise(level_parts(homes, spanning_forest(edges), radii), "level-parts")

    sized = parts.join(cells.select(GROUP, "node", "n"), "node").groupBy(GROUP, "level", "part").agg(F.sum("n").alias("n")).filter(
        F.col("n") >= min_cluster_size)
    # A part is named after one of its cells; where that is at the level above lies the whole part.
    upper = parts.select((F.col("level") + 1).alias("level"), F.col("node").alias("part"), F.col("part").alias("above"))
    nodes = materialise(sized.join(upper, ["level", "part"], "left"), "tree-nodes")
    heads = materialise(_chosen(_weighed(nodes, radii), radii), "tree-clusters")

    chosen = heads.filter("state = 'chosen'").select(F.col("head_level").alias("level"), F.col("head_part").alias("part"))
    members = parts.join(chosen, ["level", "part"]).select("node", "level", "part")
    of_cell = members.join(cells.select(GROUP, "key", "node", "n", "first"), "node")
    sizes = of_cell.groupBy(GROUP, "level", "part").agg(F.sum("n").alias("_size"), F.min("first").alias("_first"))
    numbered = materialise(numbered_by_size(sizes, [GROUP], "_size", "_first").select("level", "part", "topic_id"), "tree-numbers")
    topics = materialise(of_cell.join(numbered, ["level", "part"]).select(GROUP, "key", "topic_id"), "tree-topics")

    keyed = points.drop("topic_id").withColumns({GROUP: group_key(by), "_key": F.when(usable_coordinates(coords_col, dims), key)})
    out = keyed.join(topics.withColumnRenamed("key", "_key"), [GROUP, "_key"], "left").drop(GROUP, "_key").withColumn(
        "topic_id", F.coalesce("topic_id", F.lit(-1)))
    steps = F.array(*[F.lit(r) for r in radii])
    clusters = heads.join(numbered, [heads.head_level == numbered.level, heads.head_part == numbered.part], "left").select(
        heads[GROUP].alias("group"), heads.head_level.alias("level"), heads.head_part.alias("cluster"), "parent_level",
        F.col("parent_part").alias("parent"), F.get(steps, heads.head_level).alias("radius"), heads.n.alias("size"),
        F.col("chain").alias("stability"), (F.col("state") == "chosen").alias("chosen"), "topic_id")
    return ClusterTree(clusters, out)

