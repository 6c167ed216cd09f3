"""Costs that grew too fast, second part: the cluster tree."""

import numpy as np

from chatlens.topics import cluster_tree as tree
from chatlens.topics import neighbours

POINT = "id long, c array<double>"


def stored_rows(spark, monkeypatch, x, **options):
    rows, materialise = [], neighbours.materialise

    def counted(df, *names):
        out = materialise(df, *names)
        rows.append(out.count())
        return out

    with monkeypatch.context() as patched:
        patched.setattr(tree, "materialise", counted)
        patched.setattr(neighbours, "materialise", counted)
        found = tree.cluster_tree(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], POINT), "c", "id", **options)
        topics = [r.topic_id for r in found.points.orderBy("id").collect()]
    return rows, topics


def test_tree_lists_no_pairs_of_a_dense_place(spark, monkeypatch):
    """Within the radius lie 180,000 pairs of the first blob alone."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(0, 0.02, (600, 2)), rng.normal(3, 0.02, (300, 2)), [[9.0, 9.0]]])
    rows, topics = stored_rows(spark, monkeypatch, x, radius=0.5, dims=2, min_samples=4, min_cluster_size=8, levels=2, grain=0.0)
    assert topics == [0] * 600 + [1] * 300 + [-1]
    assert max(rows) < 10 * len(x)


def test_ladder_edges_give_the_parts_of_all_pairs(spark):
    """Parts at each radius, by the sets of neighbours and by brute force; many points share a place or an edge length."""
    rng = np.random.default_rng(9)
    x = np.concatenate([np.round(rng.normal(0, 0.6, (150, 2)), 1), rng.normal(1, 0.3, (60, 2)), rng.uniform(-3, 3, (60, 2))])
    cells, _ = tree.grains(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], POINT), "c", "id", 0.0, 2, [])
    radii = tree.ladder(0.5, 3)
    homes, edges = tree.ladder_edges(cells, radii, 2, 4)
    got = {}
    for r in tree.level_parts(homes, tree.spanning_forest(edges), radii).collect():
        got.setdefault(r.level, {})[r.node] = r.part
    spots = {r.node: (r.x, r.n) for r in cells.collect()}
    for level, radius in enumerate(radii):
        near = {a: [b for b in spots if sum((p - q) * (p - q) for p, q in zip(spots[a][0], spots[b][0])) <= radius * radius] for a in spots}
        core = {a for a in spots if sum(spots[b][1] for b in near[a]) >= 4}
        want = {}
        for a in sorted(core):
            todo = [a]
            while todo:
                b = todo.pop()
                if b not in want:
                    want[b] = a
                    todo += [c for c in near[b] if c in core]
        assert got.get(level, {}) == want and len(set(want.values())) > 1
