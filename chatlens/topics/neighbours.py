"""Exact neighbourhoods within a radius: core points, links between them, border points.

Two points are neighbours if they are at most a radius apart. No list of all neighbour pairs is
ever made, because a dense place holds as many as the square of its points:

* Equal points are one spot with a count. Spots fall into cells so small that all points of a cell
  are neighbours. A cell with enough points is dense: all of it is core, and it goes on as one set.
  Every other spot is a set of its own.
* Sets whose bounding boxes are within the radius meet through an equi-join on coarse cells; how
  many sets a coarse cell can hold depends on the number of axes, not on the number of points.
* A question about two sets (how many points are near, is any pair near, which is the nearest) is
  answered from their boxes where these decide it. Only undecided boxes are halved along every
  axis and asked again, down to the single spots. So a cell with a third of all points is looked
  at closely only where the radius cuts through it.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlens import fixed_values as fv
from chatlens.session import materialise
from chatlens.topics.cluster import numbered_by_size
from chatlens.topics.components import connected_components

GROUP = "_g"
_DEEPEST = 12  # halvings after which undecided boxes are resolved spot by spot
_PAIRS_PER_SPOT = 32  # undecided spot pairs up to which that is done at once


class NeighbourGraph(NamedTuple):
    """``spots(_g, spot, x, n, set, core)``, ``links(u, v)`` between sets of core points that are
    neighbours, and ``border(spot, set)``: the set of the nearest core point of the others."""

    spots: DataFrame
    links: DataFrame
    border: DataFrame


def group_key(by: Sequence[str]) -> Column:
    """One string for the values of ``by``, nulls included."""
    return F.to_json(F.struct(*[F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(by)])) if by else F.lit("")


def usable_coordinates(coords_col: str, dims: int) -> Column:
    """Whether a point has ``dims`` finite coordinates."""
    c = F.col(coords_col)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(c.isNotNull() & (F.size(c) == dims) & finite, F.lit(False))


def _total(parts: Sequence[Column]) -> Column:
    out = parts[0]
    for part in parts[1:]:
        out = out + part
    return out


def squared_distance(a: str, b: str, dims: int) -> Column:
    return _total([(F.get(a, F.lit(i)) - F.get(b, F.lit(i))) * (F.get(a, F.lit(i)) - F.get(b, F.lit(i))) for i in range(dims)])


def _box_distances(dims: int) -> tuple[Column, Column]:
    """Squared least and greatest distance of the boxes lo_a..hi_a and lo_b..hi_b."""
    least, most = [], []
    for i in range(dims):
        lo_a, hi_a, lo_b, hi_b = (F.get(c, F.lit(i)) for c in ("lo_a", "hi_a", "lo_b", "hi_b"))
        gap = F.greatest(lo_b - hi_a, lo_a - hi_b, F.lit(0.0))
        reach = F.greatest(hi_b - lo_a, hi_a - lo_b)
        least.append(gap * gap)
        most.append(reach * reach)
    return _total(least), _total(most)


def _boxes(spots: DataFrame, key: Column, dims: int) -> DataFrame:
    """One row per set and key: points, spots, bounding box, and one spot inside it."""
    at = lambda i: F.get("x", F.lit(i))
    return spots.groupBy("set", key.alias("sub")).agg(
        F.sum("n").alias("n"), F.count("*").alias("spots"), F.min(F.struct("spot", "x")).alias("r"),
        F.array(*[F.min(at(i)) for i in range(dims)]).alias("lo"), F.array(*[F.max(at(i)) for i in range(dims)]).alias("hi"),
    ).select("set", "sub", "n", "spots", F.col("r.spot").alias("rep"), F.col("r.x").alias("at"), "lo", "hi")


def _side(boxes: DataFrame, name: str, *extra: str) -> DataFrame:
    return boxes.select(*extra, F.col("set").alias(name), *[
        F.col(c).alias(f"{c}_{name}") for c in boxes.columns if c not in ("set", *extra)])


class _Undecided:
    """Pairs of boxes (a, sub_a, b, sub_b) that are halved until the question is answered."""

    def __init__(self, spots: DataFrame, width: float, dims: int):
        self.spots, self.width, self.dims = spots, width, dims
        self.budget = _PAIRS_PER_SPOT * spots.count() + 100_000

    def _key(self, level: int | None) -> Column:
        if level is None:
            return F.array(F.col("spot"))
        return F.transform("x", lambda v: F.floor(v / (self.width / 2.0 ** level)).cast("long"))

    def step(self, frontier: DataFrame, before: int, level: int | None) -> DataFrame:
        """The pairs of smaller boxes inside the pairs of ``frontier``, with their distances."""
        sets = frontier.select(F.col("a").alias("set")).unionByName(frontier.select(F.col("b").alias("set"))).distinct()
        rows = self.spots.join(sets, "set", "left_semi")
        # A box lies in one box of the level before, so any of its spots tells which.
        boxes = materialise(_boxes(rows, self._key(level), self.dims).withColumn(
            "above", F.transform("at", lambda v: F.floor(v / (self.width / 2.0 ** before)).cast("long"))), "boxes")
        a = _side(boxes, "a").withColumnRenamed("above_a", "over_a")
        b = _side(boxes, "b").withColumnRenamed("above_b", "over_b")
        over = frontier.select("a", F.col("sub_a").alias("over_a"), "b", F.col("sub_b").alias("over_b"))
        return measured(over.join(a, ["a", "over_a"]).join(b, ["b", "over_b"]).drop("over_a", "over_b"), self.dims)

    def walk(self, frontier: DataFrame, visit: Callable[[DataFrame], DataFrame]) -> None:
        """Hand ever smaller pairs of boxes to ``visit``, which returns those still undecided."""
        for level in itertools.count():
            frontier = materialise(frontier.select("a", "sub_a", "b", "sub_b", "spots_a", "spots_b"), "undecided")
            state = frontier.agg(F.count("*").alias("n"), F.sum(F.col("spots_a").cast("double") * F.col("spots_b")).alias("w")).first()
            if not state.n:
                return
            last = state.w <= self.budget or level >= _DEEPEST
            frontier = visit(materialise(self.step(frontier, level, None if last else level + 1), "box-pairs"))
            if last:
                return


def measured(pairs: DataFrame, dims: int) -> DataFrame:
    """Box pairs with squared ``least`` and ``most`` distance and that of the two spots, ``seen``."""
    least, most = _box_distances(dims)
    return pairs.select(
        "a", "sub_a", "b", "sub_b", "n_a", "n_b", "spots_a", "spots_b", "rep_a", "rep_b",
        least.alias("least"), most.alias("most"), squared_distance("at_a", "at_b", dims).alias("seen"))


def _sets(spots: DataFrame, dims: int) -> DataFrame:
    whole = _boxes(spots, F.array(F.lit(0)), dims).drop("sub")
    dense = spots.groupBy("set").agg(F.first(GROUP).alias(GROUP), F.first("dense").alias("dense"), F.first("cell").alias("sub"))
    return whole.join(dense, "set")


def near_sets(sets: DataFrame, radius: float, width: float, dims: int) -> DataFrame:
    """Pairs of sets a, b of one group whose boxes are within the radius, each pair once."""
    # The low corners of two sets with neighbours differ by at most radius + width along each axis.
    coarse = (radius + width) * (1 + 1e-9)
    placed = sets.withColumn("_key", F.transform("lo", lambda v: F.floor(v / coarse).cast("long")))
    keys = placed.select(GROUP, "_key").distinct()
    ahead = [s for s in itertools.product((-1, 0, 1), repeat=dims) if s >= (0,) * dims]
    steps = F.array(*[F.array(*[F.lit(v).cast("long") for v in s]) for s in ahead])
    reach = keys.withColumn("_s", F.explode(steps)).select(
        GROUP, F.col("_key").alias("_ka"), F.zip_with("_key", "_s", lambda k, s: k + s).alias("_kb"))
    met = materialise(reach.join(keys.withColumnRenamed("_key", "_kb"), [GROUP, "_kb"]), "near-cells")
    a = _side(placed, "a", GROUP).withColumnRenamed("_key_a", "_ka")
    b = _side(placed, "b", GROUP).withColumnRenamed("_key_b", "_kb")
    pairs = met.join(a, [GROUP, "_ka"]).join(b, [GROUP, "_kb"]).filter((F.col("_ka") != F.col("_kb")) | (F.col("a") < F.col("b")))
    least, _ = _box_distances(dims)
    kept = pairs.filter(least <= radius * radius)
    return measured(kept, dims).join(
        sets.select(F.col("set").alias("a"), F.col("dense").alias("dense_a")), "a").join(
        sets.select(F.col("set").alias("b"), F.col("dense").alias("dense_b")), "b")


def _both_ways(pairs: DataFrame) -> DataFrame:
    swap = {"a": "b", "b": "a"}
    turned = {c: c[:-1] + swap[c[-1]] if c[-2:] in ("_a", "_b") else swap.get(c, c) for c in pairs.columns}
    return pairs.unionByName(pairs.select(*[F.col(turned[c]).alias(c) for c in pairs.columns]))


class _CoreGraph(NamedTuple):
    """``spots`` and ``links`` of a `NeighbourGraph`, and what the search for border spots goes on with."""

    spots: DataFrame
    links: DataFrame
    pairs: DataFrame
    core: DataFrame
    search: _Undecided


def core_graph(spots: DataFrame, radius: float, dims: int, min_samples: int) -> _CoreGraph:
    """Core spots of ``spots(_g, x, spot, n)`` within a radius, and the links between their sets."""
    limit = radius * radius
    width = radius / math.sqrt(dims) * (1 - 1e-9)
    spots = spots.withColumn("cell", F.transform("x", lambda v: F.floor(v / width).cast("long")))
    cells = spots.groupBy(GROUP, "cell").agg(F.sum("n").alias("_n"), F.min("spot").alias("_first")).filter(F.col("_n") >= min_samples)
    spots = materialise(spots.join(cells, [GROUP, "cell"], "left").select(
        GROUP, "cell", "x", "spot", "n", F.coalesce("_first", "spot").alias("set"), F.col("_first").isNotNull().alias("dense")), "spot-sets")
    sets = materialise(_sets(spots, dims), "sets")
    pairs = materialise(near_sets(sets, radius, width, dims), "near-sets")

    # How many points the spots outside of dense cells have around them.
    single = _both_ways(pairs).filter(~F.col("dense_a"))
    inside, cut = F.col("most") <= limit, (F.col("least") <= limit) & (F.col("most") > limit)
    counts = [sets.filter("not dense").select(F.col("set").alias("a"), "n"), single.filter(inside).select("a", F.col("n_b").alias("n"))]
    search = _Undecided(spots, width, dims)

    def count(found: DataFrame) -> DataFrame:
        counts.append(found.filter(inside).select("a", F.col("n_b").alias("n")))
        return found.filter(cut)

    search.walk(single.filter(cut), count)
    around = functools.reduce(DataFrame.unionByName, counts)
    lone = around.groupBy("a").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_samples).select(F.col("a").alias("set"))
    core = materialise(sets.filter("dense").select("set").unionByName(lone), "core-sets")
    spots = materialise(spots.join(core.withColumn("core", F.lit(True)), "set", "left").select(
        GROUP, "spot", "x", "n", "set", "dense", F.coalesce("core", F.lit(False)).alias("core")), "core-spots")

    # Neighbouring sets of core points: any pair of spots within the radius links them.
    of_core = lambda c: core.select(F.col("set").alias(c))
    open_pairs = pairs.join(of_core("a"), "a", "left_semi").join(of_core("b"), "b", "left_semi")
    near = F.least("most", "seen") <= limit
    linked = [open_pairs.filter(near).select("a", "b")]

    def link(found: DataFrame) -> DataFrame:
        hit = materialise(found.filter(near).select("a", "b").distinct(), "links")
        linked.append(hit)
        return found.filter(~near & (F.col("least") <= limit)).join(hit, ["a", "b"], "left_anti")

    search.walk(open_pairs.filter(~near), link)
    links = functools.reduce(DataFrame.unionByName, linked)
    links = materialise(links.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "set-links")
    return _CoreGraph(spots, links, pairs, core, search)


def neighbour_graph(
    points: DataFrame, coords_col: str, id_col: str, radius: float, dims: int = fv.REDUCED_DIMENSIONS,
    min_samples: int = fv.MIN_SAMPLES, by: Sequence[str] = (),
) -> NeighbourGraph:
    """The neighbourhood structure of ``points`` within each group of ``by``.

    A point is core if at least ``min_samples`` points, itself included, are within ``radius``.
    ``id_col`` must be unique and integral. Points without ``dims`` finite coordinates have no part.
    """
    limit = radius * radius
    good = points.filter(usable_coordinates(coords_col, dims))
    spots = good.groupBy(group_key(by).alias(GROUP), F.transform(coords_col, lambda v: v.cast("double") + F.lit(0.0)).alias("x")).agg(
        F.min(F.col(id_col).cast("long")).alias("spot"), F.count("*").alias("n"))
    spots, links, pairs, core, search = core_graph(materialise(spots, "spots"), radius, dims, min_samples)
    of_core = lambda c: core.select(F.col("set").alias(c))

    # The nearest core spot of every spot that is not core but has one within the radius.
    edge = _both_ways(pairs).join(of_core("b"), "b", "left_semi").join(of_core("a"), "a", "left_anti")
    best = lambda found: found.filter(F.col("seen") <= limit).groupBy("a").agg(
        F.min(F.struct("seen", F.col("rep_b").alias("spot"), F.col("b").alias("set"))).alias("best"))
    nearest = materialise(best(edge), "nearest-core")

    def closer(found: DataFrame) -> DataFrame:
        several = found.filter((F.col("spots_b") > 1) & (F.col("least") <= limit))
        bound = several.join(nearest.select("a", F.col("best.seen").alias("_bound")), "a", "left")
        return bound.filter(F.col("_bound").isNull() | (F.col("least") <= F.col("_bound"))).drop("_bound")

    def narrow(found: DataFrame) -> DataFrame:
        nonlocal nearest
        both = best(found).unionByName(nearest)
        nearest = materialise(both.groupBy("a").agg(F.min("best").alias("best")), "nearest-core")
        return closer(found)

    search.walk(closer(edge), narrow)
    border = nearest.select(F.col("a").alias("spot"), F.col("best.set").alias("set"))
    return NeighbourGraph(spots, links, border)


def spot_parts(graph: NeighbourGraph) -> DataFrame:
    """``_g, spot, n, x, core, part``: the connected part of each spot; null for outliers."""
    parts = connected_components(graph.links)
    own = graph.spots.join(graph.border.withColumnRenamed("set", "_near"), "spot", "left").withColumn(
        "set", F.when(F.col("core"), F.col("set")).otherwise(F.col("_near")))
    placed = own.join(parts.select(F.col("node").alias("set"), "component"), "set", "left")
    return placed.select(GROUP, "spot", "n", "x", "core", F.coalesce("component", "set").alias("part"))


def join_points(points: DataFrame, spots: DataFrame, coords_col: str, by: Sequence[str], dims: int) -> DataFrame:
    """``points`` with the further columns of their spot, ``spots(_g, x, …)``; all rows stay."""
    at = F.when(usable_coordinates(coords_col, dims), F.transform(coords_col, lambda v: v.cast("double") + F.lit(0.0)))
    keyed = points.withColumns({GROUP: group_key(by), "_x": at})
    return keyed.join(spots.withColumnRenamed("x", "_x"), [GROUP, "_x"], "left").drop(GROUP, "_x")


def neighbour_clusters(
    points: DataFrame, coords_col: str, id_col: str, radius: float, dims: int = fv.REDUCED_DIMENSIONS,
    min_samples: int = fv.MIN_SAMPLES, min_cluster_size: int = fv.MIN_CLUSTER_SIZE, by: Sequence[str] = (),
) -> DataFrame:
    """Add ``topic_id`` (-1 for outliers) and ``is_core``: density clusters of the neighbour graph.

    Core points that are neighbours belong together, a point that is not core to the cluster of its
    nearest core point within ``radius`` (ties to the smaller id). Groups below ``min_cluster_size``
    points are outliers; ids go by size, then by smallest id. Points without finite coordinates are
    outliers; equal points share their cluster; an empty table gives an empty one.
    """
    graph = neighbour_graph(points, coords_col, id_col, radius, dims, min_samples, by)
    return number_parts(points, materialise(spot_parts(graph), "spot-parts"), coords_col, dims, min_cluster_size, by)


def number_parts(points: DataFrame, parts: DataFrame, coords_col: str, dims: int, least: int, by: Sequence[str]) -> DataFrame:
    """Number the parts of ``parts(_g, spot, n, x, core, part)`` by size and join them to the points."""
    groups = parts.filter("part is not null").groupBy(GROUP, "part").agg(
        F.sum("n").alias("_size"), F.min("spot").alias("_first")).filter(F.col("_size") >= least)
    numbered = numbered_by_size(groups, [GROUP], "_size", "_first").select("part", "topic_id")
    placed = materialise(parts.join(numbered, "part", "left").select(
        GROUP, "x", F.coalesce("topic_id", F.lit(-1)).alias("topic_id"), F.col("core").alias("is_core")), "spot-topics")
    out = join_points(points.drop("topic_id", "is_core"), placed, coords_col, by, dims)
    return out.withColumns({"topic_id": F.coalesce("topic_id", F.lit(-1)), "is_core": F.coalesce("is_core", F.lit(False))})
