"""Reduction that keeps neighbours: leading eigenvectors of the normalised neighbour graph.

Points are put together in grains, as for the cluster tree, and grains within a radius are joined by
an edge whose weight falls with their distance. Orthogonal iteration then finds the leading
eigenvectors: each step is one join of the edges with the present vectors and one aggregation, and
only a matrix of a few rows and columns ever reaches the driver. Between two orthogonalisations the
steps follow the Chebyshev recurrence, which damps everything below the least eigenvalue wanted.

Averaging over neighbours needs no list of edges: the points of neighbouring cells meet as blocks,
whose weights are summed as they are computed, in each step anew.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.session import materialise
from chatlens.topics.cluster_tree import GRAINS_PER_RADIUS, grains, radius_edges
from chatlens.topics.neighbours import GROUP, group_key, usable_coordinates

SPARE = 3  # vectors next to the wanted ones, which speed up the iteration
STEPS = 10  # multiplications between two orthogonalisations
ROUNDS = 30
TOLERANCE = 1e-8
BLOCK = 2048  # points of a cell that meet those of another cell at a time
AT_ONCE = 256  # of them, for which weights are held


def normalised_edges(cells: DataFrame, radius: float, dims: int) -> DataFrame:
    """``u, v, s``: both directions of the normalised graph of ``cells(_g, node, x, n)``, loops included.

    Every point of a cell counts as a node of its own: the entry of two cells is
    ``sqrt(n_u n_v) w / sqrt(d_u d_v)`` with the weight ``w = exp(-2 (distance / radius)**2)`` and the
    degree ``d``, the summed weight to all points around. So a cell of many points acts as many.
    """
    near = radius_edges(cells, radius, dims).withColumn("w", F.exp(F.col("d") * F.lit(-2.0 / radius**2))).select("u", "v", "w")
    loops = cells.select(F.col("node").alias("u"), F.col("node").alias("v"), F.lit(1.0).alias("w"))
    both = materialise(near.unionByName(near.select(F.col("v").alias("u"), F.col("u").alias("v"), "w")).unionByName(loops), "graph-edges")
    count = lambda c: cells.select(F.col("node").alias(c), F.col("n").cast("double").alias(f"n_{c}"))
    degree = both.join(count("v"), "v").groupBy("u").agg(F.sum(F.col("w") * F.col("n_v")).alias("d"))
    scaled = materialise(degree.join(count("u"), "u").select(F.col("u").alias("node"), F.sqrt(F.col("n_u") / F.col("d")).alias("r")), "graph-scale")
    scale = lambda c: scaled.select(F.col("node").alias(c), F.col("r").alias(f"r_{c}"))
    return both.join(scale("u"), "u").join(scale("v"), "v").select("u", "v", (F.col("w") * F.col("r_u") * F.col("r_v")).alias("s"))


def multiplied(edges: DataFrame, vectors: DataFrame, names: Sequence[str]) -> DataFrame:
    """``node`` and the columns ``names`` of the graph's matrix times ``vectors``."""
    met = edges.join(vectors.withColumnRenamed("node", "v"), "v")
    return met.groupBy(F.col("u").alias("node")).agg(*[F.sum(F.col("s") * F.col(c)).alias(c) for c in names])


def _products(left: DataFrame, names: Sequence[str], other: Sequence[str]) -> np.ndarray:
    """The small matrix of inner products of columns, summed over all rows."""
    row = left.agg(*[F.sum(F.col(a) * F.col(b)) for a in names for b in other]).first()
    return np.array([v or 0.0 for v in row], float).reshape(len(names), len(other))


def _turned(vectors: DataFrame, names: Sequence[str], by: np.ndarray) -> DataFrame:
    """The columns ``names`` times a small matrix."""
    mixed = [sum((F.col(c) * F.lit(float(by[i, j])) for i, c in enumerate(names)), F.lit(0.0)).alias(names[j]) for j in range(by.shape[1])]
    return vectors.select("node", *mixed)


def leading_vectors(edges: DataFrame, nodes: DataFrame, k: int, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[DataFrame, list[float]]:
    """``node, e0 … e(k-1)``: the eigenvectors with the largest eigenvalues, and these.

    The start depends on the node numbers only; a table with fewer nodes has fewer columns. Ends when no eigenvalue moves by more than
    ``tolerance``, or after ``rounds`` orthogonalisations.
    """
    size = min(k + SPARE, nodes.count())
    if not size:
        return nodes.select("node", F.lit(0.0).alias("e0")), []
    names = [f"e{i}" for i in range(size)]
    start = lambda i: F.xxhash64("node", F.lit(i)) / F.lit(float(1 << 63))
    now = materialise(nodes.select("node", *[start(i).alias(c) for i, c in enumerate(names)]), "graph-vectors")
    found, before, low = np.zeros(0), np.full(size, np.inf), 0.0
    for _ in range(rounds):
        now = materialise(_filtered(edges, now, names, low), "graph-vectors")
        # Orthonormal columns by the inverse square root of their inner products.
        values, turn = np.linalg.eigh(_products(now, names, names))
        kept = values > values.max() * 1e-13 if values.max() > 0 else np.zeros(len(names), bool)
        basis = turn[:, kept] / np.sqrt(values[kept])
        now, names = _turned(now, names, basis), names[:basis.shape[1]]
        # The best combination of the columns as eigenvectors of the graph.
        times = multiplied(edges, now, names).withColumnsRenamed({c: f"_{c}" for c in names})
        small = _products(now.join(times, "node"), names, [f"_{c}" for c in names])
        values, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values)
        now = materialise(_turned(now, names, turn[:, order]), "graph-vectors")
        found = values[order]
        low = float(found[-1]) if len(found) else 0.0
        if len(found) == len(before) and np.abs(found[:k] - before[:k]).max(initial=0.0) < tolerance:
            break
        before = found
    return now.select("node", *names[:k]), found[:k].tolist()


def _filtered(edges: DataFrame, vectors: DataFrame, names: Sequence[str], low: float) -> DataFrame:
    """``vectors`` times a Chebyshev polynomial of the matrix that stays small from -1 to ``low``."""
    middle, half = (low - 1) / 2, max((low + 1) / 2, 1e-6)
    # Scaled by the value at 1, the largest eigenvalue, so that numbers neither grow nor vanish.
    top = (1 - middle) / half
    last, ratio = vectors, 1 / top
    now = _combined(edges, vectors, None, names, ratio / half, middle, 0.0)
    for _ in range(STEPS - 1):
        following = 1 / (2 * top - ratio)
        last, now, ratio = now, _combined(edges, now, last, names, 2 * following / half, middle, ratio * following), following
    return now


def _combined(
    edges: DataFrame, now: DataFrame, last: DataFrame | None, names: Sequence[str], scale: float, middle: float, less: float,
) -> DataFrame:
    """``scale * (S - middle) now - less * last``, column by column."""
    joined = now.join(multiplied(edges, now, names).withColumnsRenamed({c: f"_{c}" for c in names}), "node")
    value = lambda c: F.lit(scale) * (F.col(f"_{c}") - F.lit(middle) * F.col(c))
    if last is None:
        return materialise(joined.select("node", *[value(c).alias(c) for c in names]), "graph-step")
    joined = joined.join(last.withColumnsRenamed({c: f"z_{c}" for c in names}), "node")
    return materialise(joined.select("node", *[(value(c) - F.lit(less) * F.col(f"z_{c}")).alias(c) for c in names]), "graph-step")


def reduce_by_graph(
    points: DataFrame, coords_col: str, id_col: str, radius: float, dims: int, k: int, by: Sequence[str] = (), grain: float | None = None,
) -> DataFrame:
    """Add ``reduced``: the ``k`` leading eigenvectors of the neighbour graph behind the first one.

    The first eigenvector only tells how crowded a place is; each further one is divided by it, so
    that points in one place get equal coordinates whatever their number. Coordinates are scaled to
    a mean square of 1 over the points. Points without ``dims`` finite coordinates get null. With
    fewer grains than ``k + 1`` the missing coordinates are 0. Groups of ``by`` share no edges but
    one set of eigenvectors; call it for each group to reduce them by themselves.
    """
    cells, key = grains(points, coords_col, id_col, radius / GRAINS_PER_RADIUS if grain is None else grain, dims, by)
    edges = materialise(normalised_edges(cells, radius, dims), "graph")
    vectors, _ = leading_vectors(edges, cells.select("node"), k + 1)
    first = F.col("e0")
    share = lambda i: F.when(F.abs(first) > 1e-12, F.col(f"e{i}") / first).otherwise(0.0) if f"e{i}" in vectors.columns else F.lit(0.0)
    shares = materialise(vectors.select("node", *[share(i + 1).alias(f"c{i}") for i in range(k)]).join(cells.select("node", "n", GROUP, "key"), "node"), "graph-shares")
    squares = shares.agg(*[F.sqrt(F.sum(F.col(f"c{i}") * F.col(f"c{i}") * F.col("n")) / F.sum("n")) for i in range(k)]).first()
    scaled = [F.col(f"c{i}") / F.lit(float(squares[i]) if squares[i] else 1.0) for i in range(k)]
    placed = shares.select(GROUP, F.col("key").alias("_key"), F.array(*scaled).alias("reduced"))
    keyed = points.drop("reduced").withColumns({GROUP: group_key(by), "_key": F.when(usable_coordinates(coords_col, dims), key)})
    return keyed.join(placed, [GROUP, "_key"], "left").drop(GROUP, "_key")


def _weighed_sums(batches: Iterator[pa.RecordBatch], radius: float, dims: int) -> Iterator[pa.RecordBatch]:
    """``node, s0, s1 …``: for pairs of blocks, the sums of ``values`` over the points around each of ``nodes``, by weight."""
    def flat(batch, name, width):
        column = batch[name]
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width), (column.offsets.to_numpy() - column.offsets[0].as_py()) // width

    for batch in batches:
        (nodes, ends), (at, _), (near, near_ends), (values, _) = (
            flat(batch, name, width) for name, width in (("nodes", 1), ("at_nodes", dims), ("near", dims), ("values", dims + 1)))
        sums = np.empty((len(nodes), dims + 1))
        for i, start in ((i, start) for i in range(batch.num_rows) for start in range(ends[i], ends[i + 1], AT_ONCE)):
            here, there = slice(start, min(start + AT_ONCE, ends[i + 1])), slice(near_ends[i], near_ends[i + 1])
            distance = 0.0
            for k in range(dims):
                gap = at[here, k, None] - near[None, there, k]
                distance = distance + gap * gap
            weight = np.where(distance <= radius * radius, np.exp(distance * (-2.0 / radius**2)), 0.0)
            sums[here] = weight @ values[there]
        # A block meets many others in one batch.
        node, place = np.unique(nodes[:, 0], return_inverse=True)
        yield pa.RecordBatch.from_pydict({"node": node, **{f"s{k}": np.bincount(place, sums[:, k], len(node)) for k in range(dims + 1)}})


class _Neighbourhoods:
    """The points of ``cells(_g, node, x, n)`` in cells as wide as the radius, those of a crowded cell dealt over blocks."""

    def __init__(self, cells: DataFrame, radius: float, dims: int):
        width = radius * (1 + 1e-9)
        placed = cells.select(GROUP, "node", "x", "n", F.transform("x", lambda v: F.floor(v / width).cast("long")).alias("at"))
        crowds = materialise(placed.groupBy(GROUP, "at").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "crowds")
        self.radius, self.dims, self.crowds = radius, dims, crowds
        self.points = materialise(placed.join(crowds, [GROUP, "at"]).select(
            GROUP, "at", F.pmod(F.xxhash64("node"), "blocks").alias("block"), "node", "x", "n"), "placed")
        self.blocks = materialise(self._packed(self.points.select(GROUP, "at", "block", F.struct("node", "x").alias("_p"))).select(
            GROUP, "at", "block", F.col("_p.node").alias("nodes"), F.flatten("_p.x").alias("at_nodes")), "blocks")

    @staticmethod
    def _packed(points: DataFrame) -> DataFrame:
        return points.groupBy(GROUP, "at", "block").agg(F.collect_list("_p").alias("_p"))

    def averages(self, now: DataFrame, names: Sequence[str]) -> DataFrame:
        """``node`` and ``names``: the mean over all points around, by weight, of the columns ``names`` of ``now``."""
        values = F.array(*[F.col("n") * F.col(c) for c in names], F.col("n").cast("double"))
        around = self._packed(self.points.join(now, "node").select(GROUP, "at", "block", F.struct("x", values.alias("v")).alias("_p")))
        steps = F.array(*[F.array(*[F.lit(v).cast("long") for v in s]) for s in itertools.product((-1, 0, 1), repeat=self.dims)])
        # A block goes to each block of the cells around that hold points.
        reach = around.withColumn("_s", F.explode(steps)).select(
            GROUP, F.zip_with("at", "_s", lambda k, s: k + s).alias("at"), F.flatten("_p.x").alias("near"), F.flatten("_p.v").alias("values"))
        reach = reach.join(self.crowds, [GROUP, "at"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        met = self.blocks.join(reach.drop("blocks"), [GROUP, "at", "block"]).select("nodes", "at_nodes", "near", "values")
        radius, dims = self.radius, self.dims
        schema = ", ".join(["node long", *[f"s{k} double" for k in range(dims + 1)]])
        sums = met.mapInArrow(lambda batches: _weighed_sums(batches, radius, dims), schema)
        total = sums.groupBy("node").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(dims + 1)])
        return total.select("node", *[(F.col(f"s{k}") / F.col(f"s{dims}")).alias(c) for k, c in enumerate(names)])


def diffused(
    points: DataFrame, coords_col: str, id_col: str, radius: float, dims: int, by: Sequence[str] = (), steps: int = 3, grain: float = 0.0,
) -> DataFrame:
    """Add ``diffused``: the coordinates after ``steps`` averagings over the neighbour graph.

    Each step replaces a point by the mean of all points within ``radius``, itself included, weighted
    as in :func:`normalised_edges`; noise fades while the shape that neighbours share stays. What is
    shuffled and stored grows with the points, the work with the pairs of points in neighbouring cells.
    """
    cells, key = grains(points, coords_col, id_col, grain, dims, by)
    around = _Neighbourhoods(cells, radius, dims)
    names = [f"x{i}" for i in range(dims)]
    now = cells.select("node", *[F.get("x", F.lit(i)).alias(c) for i, c in enumerate(names)])
    for _ in range(steps):
        now = materialise(around.averages(now, names), "averages")
    placed = materialise(now.join(cells.select("node", GROUP, "key"), "node").select(
        GROUP, F.col("key").alias("_key"), F.array(*names).alias("diffused")), "diffused")
    keyed = points.drop("diffused").withColumns({GROUP: group_key(by), "_key": F.when(usable_coordinates(coords_col, dims), key)})
    return keyed.join(placed, [GROUP, "_key"], "left").drop(GROUP, "_key")
