"""Neighbour graph, cluster tree, seed spreading and target numbers of topics against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatlens.session import shared_dir, stored_tables
from chatlens.topics import cluster_tree as tree
from chatlens.topics import guidance, neighbours, refine

POINT = "id long, c array<double>"


def squares(x):
    return sum((x[:, None, i] - x[None, :, i]) ** 2 for i in range(x.shape[1]))


def brute_clusters(x, ids, radius, min_samples, least):
    d = squares(x)
    near = d <= radius * radius
    core = near.sum(axis=1) >= min_samples
    part, n = -np.ones(len(x), int), 0
    for i in range(len(x)):
        if core[i] and part[i] < 0:
            stack, part[i] = [i], n
            while stack:
                for m in np.flatnonzero(near[stack.pop()] & core & (part < 0)):
                    part[m] = n
                    stack.append(m)
            n += 1
    for i in np.flatnonzero(~core):
        around = [(d[i, j], ids[j], part[j]) for j in np.flatnonzero(near[i] & core)]
        if around:
            part[i] = min(around)[2]
    sizes = sorted((-(part == p).sum(), min(ids[part == p]), p) for p in range(n))
    name = {p: k for k, (_, _, p) in enumerate(s for s in sizes if -s[0] >= least)}
    return [(name.get(p, -1), bool(c)) for p, c in zip(part.tolist(), core)]


def blobs(seed, n, dims, spread=0.3, extent=3.0):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(rng.normal(size=dims) * 1.5, spread, (n // 4, dims)) for _ in range(3)]
                       + [rng.uniform(-extent, extent, (n // 4, dims))])
    return np.concatenate([x, np.repeat(x[:3], 20, axis=0), np.round(x[:40], 1)]), rng


@pytest.mark.parametrize("dims,radius,closely", [(2, 0.25, False), (3, 0.4, True), (1, 0.02, False)])
def test_neighbour_clusters_equal_brute_force(spark, monkeypatch, dims, radius, closely):
    x, rng = blobs(3, 400, dims)
    ids = rng.permutation(len(x)) * 7
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], POINT)
    if closely:  # halve the boxes down to the last level instead of asking spot by spot
        monkeypatch.setattr(neighbours, "_PAIRS_PER_SPOT", -10**9)
    got = {r.id: (r.topic_id, r.is_core) for r in neighbours.neighbour_clusters(df, "c", "id", radius, dims, 4, 5).collect()}
    assert [got[i] for i in ids.tolist()] == brute_clusters(x, ids, radius, 4, 5)


def test_a_full_cell_is_not_squared(spark, monkeypatch):
    """A third of all points lies in one cell, and points around it ask how many of these are near."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.uniform(0, 0.5, (2000, 2)), rng.uniform(-1.5, 2, (400, 2)), rng.uniform(-60, 60, (3600, 2))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], POINT)
    compared = []
    step = neighbours._Undecided.step
    monkeypatch.setattr(neighbours._Undecided, "step", lambda *a: (lambda df: compared.append(df.count()) or df)(step(*a)))
    monkeypatch.setattr(neighbours, "_PAIRS_PER_SPOT", -10**9)
    got = neighbours.neighbour_clusters(df, "c", "id", 0.75, 2, 5, 5).collect()
    assert {(r.topic_id, r.is_core) for r in got if r.id < 2000} == {(0, True)}
    assert sum(compared) < 40 * len(x) < 2000 ** 2 / 10
    assert [(r.topic_id, r.is_core) for r in sorted(got, key=lambda r: r.id)] == brute_clusters(x, np.arange(len(x)), 0.75, 5, 5)


def test_neighbour_clusters_on_odd_points(spark):
    rows = [(i, "a", [0.0, 0.1 * i]) for i in range(6)] + [(10 + i, None, [0.0, 0.0]) for i in range(6)] + [
        (20, "a", None), (21, "a", [0.0, None]), (22, "a", [float("nan"), 0.0]), (23, "a", [0.0]), (24, "a", [float("inf"), 0.0]),
        (25, "b", [0.0, -0.0])]
    df = spark.createDataFrame(rows, "id long, role string, c array<double>")
    for name in ("set", "spot", "x", "n", "part", "key", "node", "topic_id", "_first"):
        df = df.withColumn(name, F.lit("y"))
    got = {r.id: r for r in neighbours.neighbour_clusters(df, "c", "id", 0.15, 2, 3, 3, ["role"]).collect()}
    assert len(got) == len(rows) and all(got[i].topic_id == 0 for i in [*range(6), *range(10, 16)])
    assert [got[i].is_core for i in range(6)] == [False, True, True, True, True, False]
    assert all((got[i].topic_id, got[i].is_core) == (-1, False) for i in range(20, 26)) and got[3].set == "y"
    assert neighbours.neighbour_clusters(df.limit(0), "c", "id", 0.15, 2, 3, 3, ["role"]).count() == 0
    found = tree.cluster_tree(df, "c", "id", 0.3, 2, 3, 3, ["role"], levels=3)
    topics = {r.id: r.topic_id for r in found.points.collect()}
    assert len(topics) == len(rows) and all(topics[i] == 0 for i in [*range(6), *range(10, 16)]) and topics[25] == topics[20] == -1
    empty = tree.cluster_tree(df.limit(0), "c", "id", 0.3, 2, 3, 3, ["role"], levels=3)
    assert empty.points.count() == empty.clusters.count() == 0


def kruskal(edges):
    part, taken = {}, []

    def root(i):
        while part.setdefault(i, i) != i:
            i = part[i]
        return i

    for w, u, v in sorted(edges):
        a, b = root(u), root(v)
        if a != b:
            part[a] = b
            taken.append((u, v, w))
    return taken


def test_spanning_forest_equals_kruskal(spark):
    rng = random.Random(4)
    edges = {}
    for _ in range(900):
        u, v = sorted(rng.sample(range(300), 2))
        edges[u, v] = float(rng.randrange(40))  # many ties
    df = spark.createDataFrame([(u, v, w) for (u, v), w in edges.items()], "u long, v long, w double")
    got = [tuple(r) for r in tree.spanning_forest(df).collect()]
    assert sorted(got) == sorted(kruskal((w, u, v) for (u, v), w in edges.items()))
    assert tree.spanning_forest(df.limit(0)).count() == 0


def test_mutual_reachability_forest_equals_brute_force(spark):
    x, _ = blobs(6, 240, 2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], POINT)
    cells, _ = tree.grains(df, "c", "id", 0.0, 2, [])
    edges = tree.radius_edges(cells, 0.8, 2)
    cores = tree.core_distances(cells, edges, 4)
    forest = tree.spanning_forest(tree.reachability(edges, cores)).collect()

    d = squares(x)
    core = np.sort(d, axis=1)[:, 3]
    first = {tuple(v): i for i, v in reversed(list(enumerate(x.tolist())))}.values()
    want = kruskal((max(d[i, j], core[i], core[j]), i, j) for i, j in itertools.combinations(sorted(first), 2)
                   if d[i, j] <= 0.64 and core[i] <= 0.64 and core[j] <= 0.64)
    assert len(forest) == len(want)
    assert abs(sum(np.sqrt(r.w) for r in forest) - sum(np.sqrt(w) for *_, w in want)) < 1e-9


def three_densities(seed=3):
    rng = np.random.default_rng(seed)
    parts = [rng.normal([0, 0], 1.0, (300, 2)), rng.normal([6, 0], 0.05, (150, 2)), rng.normal([6.55, 0], 0.05, (150, 2))]
    return np.concatenate(parts), np.repeat([0, 1, 2], [300, 150, 150])


@pytest.mark.parametrize("grain", [0.0, 0.05])
def test_tree_finds_clusters_of_different_density(spark, grain):
    x, truth = three_densities()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], POINT)

    def found_all(topics):
        names = [{t for t, k in zip(topics, truth) if k == c and t != -1} for c in range(3)]
        share = min(np.mean([t != -1 for t, k in zip(topics, truth) if k == c]) for c in range(3))
        return all(len(n) == 1 for n in names) and len(set.union(*names)) == 3 and share > 0.9

    found = tree.cluster_tree(df, "c", "id", 0.9, 2, 5, 20, levels=6, grain=grain)
    assert found_all([r.topic_id for r in found.points.orderBy("id").collect()])
    clusters = found.clusters.collect()
    split = [c for c in clusters if not c.chosen]
    assert len([c for c in clusters if c.chosen]) == 3 and len(split) == 1
    assert {c.parent for c in clusters if c.parent is not None} == {split[0].cluster}
    # No single radius of the ladder finds them.
    for radius in tree.ladder(0.9, 6):
        flat = brute_clusters(x, np.arange(len(x)), radius, 5, 20)
        assert not found_all([t for t, _ in flat])


def test_grains_bound_the_edges(spark):
    """Ten times the points in the same place bring no more edges, and none of them is dropped."""
    rng = np.random.default_rng(5)
    few, many = (spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.uniform(0, 1, (n, 2)))], POINT) for n in (3000, 30_000))
    edges = []
    for df in (few, many):
        cells, _ = tree.grains(df, "c", "id", 0.05, 2, [])
        assert cells.agg(F.sum("n")).first()[0] == df.count() and cells.count() <= 441
        edges.append(tree.radius_edges(cells, 0.2, 2).count())
    assert edges[1] < 1.1 * edges[0]


def test_seeds_spread_to_near_messages(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal([0, 0], 0.3, (200, 2)), rng.normal([5, 0], 0.3, (200, 2)), rng.normal([0, 5], 0.3, (100, 2)),
                        [[20.0, 20.0], [30.0, 30.0]]])
    seeds = [1 if i in (3, 50) else 2 if i in (210, 220) else 7 if i == 60 else 9 if i == 500 else None for i in range(len(x))]
    rows = [(i, v.tolist(), s) for i, (v, s) in enumerate(zip(x, seeds))]
    df = spark.createDataFrame(rows, POINT + ", seed_topic int").withColumn("seed", F.lit("z"))
    results = []
    for table in (df, df.repartition(7)):
        got = {r.id: (r.spread_topic, r.spread_step) for r in guidance.spread_seeds(table, "c", "id", 0.4, 2, 4).collect()}
        results.append(got)
    assert results[0] == results[1] and len(got) == len(rows)
    blob = lambda a, b: [got[i][0] for i in range(a, b) if got[i][1] is not None]
    assert set(blob(0, 200)) == {1, 7} and len(blob(0, 200)) > 190
    assert set(blob(200, 400)) == {2} and len(blob(200, 400)) > 190  # unlabelled messages move
    assert blob(400, 500) == [] and got[500] == (9, 0) and got[501] == (None, None) and got[60] == (7, 0)
    assert guidance.spread_seeds(df.limit(0), "c", "id", 0.4, 2, 4).count() == 0


def brute_target(rows, target):
    """``rows``: {topic: (count, vector)} of one role; {topic: new id}."""
    new, state = {t: t for t in rows}, dict(rows)
    while len(state) > target:
        def cosine(a, b):
            x, y = state[a][1], state[b][1]
            length = np.linalg.norm(x) * np.linalg.norm(y)
            return round(float(x @ y / length), 9) if length > 0 else 0.0

        best = {a: min((b for b in state if b != a), key=lambda b: (-cosine(a, b), b)) for a in state}
        pairs = sorted((-cosine(a, b), a, b) for a, b in best.items() if best[b] == a and a < b)
        for _, a, b in pairs[:len(state) - target]:
            (n, x), (m, y) = state[a], state.pop(b)
            state[a] = (n + m, (n * x + m * y) / (n + m))
            new = {t: a if v == b else v for t, v in new.items()}
    return new


@pytest.mark.parametrize("target,block", [(2, 2048), (9, 5), (100, 2048)])
def test_target_number_of_topics(spark, target, block, monkeypatch):
    monkeypatch.setattr(refine.nearest_topics, "__defaults__", (block,))
    rng = np.random.default_rng(7)
    rows = [("user", t, int(rng.integers(1, 50)), rng.normal(size=6)) for t in range(14)]
    rows += [("user", 40, 3, rows[4][3]), ("user", 41, 3, rows[4][3]), ("user", 42, 1, np.zeros(6)), ("assistant", 0, 5, rng.normal(size=6))]
    topics = spark.createDataFrame([(r, t, n, v.tolist()) for r, t, n, v in rows], "message_role string, topic_id int, message_count long, centroid array<double>")
    got = {(r.message_role, r.topic_id): r.new_id for r in refine.ids_for_target(topics, target).collect()}
    want = brute_target({t: (n, v) for r, t, n, v in rows if r == "user"}, target)
    assert got == {("user", t): n for t, n in want.items()} | {("assistant", 0): 0}
    assert len({n for (r, _), n in got.items() if r == "user"}) == min(target, 17)
    docs = spark.createDataFrame([("user", t, t) for t in want] + [("user", -1, 99)], "message_role string, topic_id int, row_index long")
    named = {r.row_index: r.topic_id for r in refine.reduce_to_target(docs, topics, target).collect()}
    assert named == want | {99: -1}


def test_target_of_no_topics(spark):
    topics = spark.createDataFrame([], "message_role string, topic_id int, message_count long, centroid array<double>")
    assert refine.ids_for_target(topics, 3).count() == 0
    with pytest.raises(ValueError):
        refine.ids_for_target(topics, 0)


def test_stored_tables_of_a_search_are_removed(spark):
    x, _ = blobs(1, 80, 2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], POINT)
    with stored_tables(spark) as folder:
        assert folder.startswith(shared_dir(spark))
        neighbours.neighbour_clusters(df, "c", "id", 0.3, 2, 4, 5).collect()
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
