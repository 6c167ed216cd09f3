"""Density clustering of reduced vectors on a grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlens import fixed_values as fv
from chatlens.session import materialise
from chatlens.sources.tables import with_row_index
from chatlens.topics.components import connected_components


# A cell spans two widths: as much as a cell of one width with half of its neighbours on both sides.
WIDTHS_PER_CELL = 2.0


def grid_shifts(width: float, dims: int) -> list[float]:
    """Offsets of the grids: one more than there are axes."""
    return [k * width / (dims + 1) for k in range(dims + 1)]


def grid_cells(coords: Column, width: float, dims: int) -> Column:
    """The cell of a point in each of the shifted grids."""
    return F.array(*[_cell(coords, width, shift) for shift in grid_shifts(width, dims)])


def _cell(coords: Column, width: float, shift: float) -> Column:
    return F.transform(coords, lambda x: F.floor((x + shift) / width))


def numbered_by_size(clusters: DataFrame, by: Sequence[str], size: str, first: str) -> DataFrame:
    """Give clusters the ids 0, 1, … within each group, largest first.

    The order comes from a distributed sort; only group starts are shared.
    """
    ordered = with_row_index(clusters.orderBy(*by, F.desc(size), first), "_at")
    if not by:
        return ordered.withColumn("topic_id", F.col("_at").cast("int")).drop("_at")
    # One row per group (role).
    starts = F.broadcast(ordered.groupBy(*by).agg(F.min("_at").alias("_from")))
    return ordered.join(starts, list(by)).withColumn("topic_id", (F.col("_at") - F.col("_from")).cast("int")).drop(
        "_at", "_from")


def density_clusters(
    points: DataFrame,
    coords_col: str,
    id_col: str,
    width: float,
    dims: int = fv.REDUCED_DIMENSIONS,
    min_samples: int = fv.MIN_SAMPLES,
    min_cluster_size: int = fv.MIN_CLUSTER_SIZE,
    by: Sequence[str] = (),
) -> DataFrame:
    """Add ``topic_id``: clusters of dense grid cells, -1 for outliers.

    * Points fall into cells of two ``width`` in several grids, which are shifted
      against each other by equal steps. An axis can separate two points that are
      closer than one step in one of the grids only, so with one grid more than
      there are axes they share a cell in at least one, wherever the grids begin.
    * A cell is dense if it holds at least ``min_samples`` points. Dense cells that
      share a point belong together; a point outside of all dense cells is an outlier.
    * Groups below ``min_cluster_size`` points are outliers; ids go by size.

    Points are counted per combination of cells before anything is joined and no
    pairs of points are formed, so a cell holding a third of all points costs no
    more than its one row. ``id_col`` must be unique and integral.
    """
    by = list(by)
    placed = points.withColumn("_cells", grid_cells(F.col(coords_col), width * WIDTHS_PER_CELL, dims))
    spots = materialise(
        placed.groupBy(*by, "_cells").agg(F.count("*").alias("_n"), F.min(id_col).alias("_id")), "grid-cells")
    single = spots.select(*by, "_id", "_n", F.posexplode("_cells").alias("_grid", "_cell"))
    dense = with_row_index(
        single.groupBy(*by, "_grid", "_cell").agg(F.sum("_n").alias("_total")).filter(F.col("_total") >= min_samples), "_node")
    # At most one cell per grid and spot.
    inside = materialise(
        single.join(dense, [*by, "_grid", "_cell"]).groupBy("_id").agg(F.sort_array(F.collect_list("_node")).alias("_nodes")),
        "dense-spots")
    first = F.get("_nodes", F.lit(0))
    edges = inside.select(first.alias("u"), F.explode("_nodes").alias("v"))
    parts = connected_components(edges)
    spot_parts = inside.select("_id", first.alias("node")).join(parts, "node", "left").select(
        "_id", F.coalesce("component", "node").alias("_part"))
    spot_parts = materialise(spots.join(spot_parts, "_id"), "spot-parts")
    groups = spot_parts.groupBy(*by, "_part").agg(F.sum("_n").alias("_size"), F.min("_id").alias("_first")).filter(
        F.col("_size") >= min_cluster_size)
    numbered = numbered_by_size(groups, by, "_size", "_first").select("_part", "topic_id")
    assigned = materialise(spot_parts.join(numbered, "_part").select(*by, "_cells", "topic_id"), "spot-topics")
    return placed.join(assigned, [*by, "_cells"], "left").withColumn(
        "topic_id", F.coalesce("topic_id", F.lit(-1))).drop("_cells")


def suggested_width(points: DataFrame, coords_col: str, dims: int = fv.REDUCED_DIMENSIONS, cells_per_axis: int = 12) -> float:
    """A cell width from the spread of the data: the widest 5 % – 95 % range over the axes, divided."""
    ranges = points.agg(*[
        (F.percentile_approx(F.get(coords_col, F.lit(i)), 0.95, 1000)
         - F.percentile_approx(F.get(coords_col, F.lit(i)), 0.05, 1000)).alias(f"a{i}") for i in range(dims)
    ]).first()
    widest = max((r for r in ranges if r is not None), default=0.0)
    return widest / cells_per_axis if widest > 0 else 1.0
