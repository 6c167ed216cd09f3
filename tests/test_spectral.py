"""Eigenvectors of the neighbour graph against numpy, and what they keep of neighbourhoods."""

import numpy as np
from pyspark.sql import functions as F

from chatlens.topics import cluster_tree as tree
from chatlens.topics import spectral

POINT = "id long, c array<double>"


def table(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], POINT)


def brute_graph(x, radius):
    """The normalised matrix over all points, equal ones included."""
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    w = np.where(d <= radius * radius, np.exp(-2 * d / radius**2), 0.0)
    degree = w.sum(axis=1)
    return w / np.sqrt(degree[:, None] * degree[None])


def ring(n=120, seed=1):
    """A closed curve that winds four times around its two widest axes."""
    rng = np.random.default_rng(seed)
    t = np.arange(n) / n * 2 * np.pi + rng.uniform(0, 0.02, n)
    waves = [a * f(k * t) for k, a in ((1, 0.7), (4, 1.0)) for f in (np.cos, np.sin)]
    return np.stack(waves, axis=1)


def test_subspace_equals_numpy(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal([0, 0], 0.25, (60, 2)), rng.normal([1.5, 0], 0.25, (50, 2)), rng.normal([0.7, 1.4], 0.25, (40, 2))])
    x = np.concatenate([x, x[:10], x[:5]])  # equal points count each
    cells, _ = tree.grains(table(spark, x), "c", "id", 0.0, 2, [])
    edges = spectral.normalised_edges(cells, 0.9, 2)
    found, values = spectral.leading_vectors(edges, cells.select("node"), 3)
    s = brute_graph(x, 0.9)
    want_values, want = np.linalg.eigh(s)
    assert np.allclose(values, want_values[::-1][:3], atol=1e-7)
    node = {tuple(r.x): (r.node, r.n) for r in cells.collect()}
    by_node = {r.node: np.array([r.e0, r.e1, r.e2]) for r in found.collect()}
    # Back to the points: a cell of n points gives each of them its value over sqrt(n).
    mine = np.array([by_node[node[tuple(v)][0]] / np.sqrt(node[tuple(v)][1]) for v in x.tolist()])
    assert np.allclose(mine.T @ mine, np.eye(3), atol=1e-6)
    overlap = np.linalg.svd(mine.T @ want[:, ::-1][:, :3])[1]
    assert overlap.min() > 1 - 1e-6


def kept_neighbours(x, y, k=10):
    near = lambda z: np.argsort(((z[:, None] - z[None]) ** 2).sum(-1) + np.diag(np.full(len(z), np.inf)), axis=1)[:, :k]
    return np.mean([len(set(a) & set(b)) / k for a, b in zip(near(x), near(y))])


def test_keeps_more_neighbours_than_principal_components(spark):
    x = ring()
    df = table(spark, x)
    got = spectral.reduce_by_graph(df, "c", "id", 0.6, 4, 2, grain=0.0)
    mine = np.array([r.reduced for r in got.orderBy("id").collect()])
    assert np.allclose((mine**2).mean(axis=0), 1.0)
    centred = x - x.mean(axis=0)
    plain = centred @ np.linalg.svd(centred)[2][:2].T
    # Four neighbours: two on each side along the curve.
    assert kept_neighbours(x, mine, 4) > 0.8 and kept_neighbours(x, plain, 4) < 0.5


def test_odd_points(spark):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [0.1, 0.0]), (4, None), (5, [0.0]), (6, [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, POINT).withColumn("key", F.lit("z")).withColumn("node", F.lit("z"))
    got = {r.id: r.reduced for r in spectral.reduce_by_graph(df, "c", "id", 0.5, 2, 3, grain=0.0).collect()}
    assert len(got) == 6 and got[4] is got[5] is got[6] is None and got[1] == got[2] and len(got[3]) == 3
    assert spectral.reduce_by_graph(df.limit(0), "c", "id", 0.5, 2, 3).count() == 0
    smooth = {r.id: r.diffused for r in spectral.diffused(df, "c", "id", 0.5, 2).collect()}
    assert smooth[4] is None and smooth[1] == smooth[2] and 0 < smooth[1][0] < smooth[3][0] < 0.1


def test_diffusion_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 2))
    x = np.concatenate([x, x[:7]])
    got = np.array([r.diffused for r in spectral.diffused(table(spark, x), "c", "id", 0.6, 2, steps=2).orderBy("id").collect()])
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    w = np.where(d <= 0.36, np.exp(-2 * d / 0.36), 0.0)
    mean = w / w.sum(axis=1, keepdims=True)
    assert np.allclose(got, mean @ mean @ x)
