"""Approximate nearest neighbours by inner product with a permutation index.

Each vector is represented by the order of its nearest pivots, computed once. A block of vectors
posts its members in one inverted file per pivot, with the place that the pivot has in their order.
A query walks the files of its own nearest pivots and adds up, for each member it meets, how
close the two places are, which is the footrule distance of the two orders up to a constant.

Orders see directions only, while the product also grows with a vector's length. So each block
measures on a few of its queries how the cosine depends on the footrule distance (a straight line)
and ranks its members by length times expected cosine. The first members of that ranking are ranked
again by exact products: as many as the same queries needed to find the wanted share of their true
nearest, so the share follows from the data of the block, not from a constant.

Pivots are a bounded sample; all rows are indexed. The queries are a stated set that meets
every block of rows, block against block, and each block answers with its best few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlens.llm.texts import map_columns
from chatlens.session import materialise

PIVOTS = 256  # bound of the sample that is collected and sent to the tasks
PREFIX = 64  # nearest pivots that represent a vector
TARGET = 0.95  # share of the true nearest of a block that its exact ranking must see
PROBES = 16  # queries of a block on which that is measured
LEAST_RERANK = 256
ROW_BLOCK, QUERY_BLOCK = 8192, 2048


def usable(vectors: DataFrame, vec_id: str, vector: str, dimension: int | None = None) -> DataFrame:
    """``vec_id, v`` (array<double>) of the rows that take part.

    Left out: null ids, null, empty and all-zero vectors, vectors with a null or non-finite
    component, and vectors whose length is not ``dimension`` (by default the most frequent one).
    """
    v = F.col("v")
    ok = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    good = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ok)
    if dimension is None:
        sizes = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
        dimension = sizes.d if sizes else 0
    return good.filter(F.size("v") == dimension)


def choose_pivots(distinct: DataFrame, pivots: int = PIVOTS) -> np.ndarray:
    """At most ``pivots`` vectors with the smallest hash, scaled to length 1."""
    rows = distinct.orderBy(F.xxhash64("v"), "rep").limit(pivots).select("v").collect()
    found = np.array([r.v for r in rows], float)
    return found / np.linalg.norm(found, axis=1, keepdims=True) if len(found) else found


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """For each vector the numbers of its nearest pivots, nearest first; ties to the smaller number."""
    near = vectors @ pivots.T
    return np.argsort(-near, axis=1, kind="stable")[:, :prefix].astype(np.int16)


def post(orders: np.ndarray, pivots: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The inverted file of each pivot: members and the places the pivot has in their orders."""
    members, places = np.divmod(np.arange(orders.size), orders.shape[1])
    flat = orders.ravel()
    by_pivot = np.argsort(flat, kind="stable")
    ends = np.searchsorted(flat[by_pivot], np.arange(pivots + 1))
    return [(members[by_pivot[a:b]], places[by_pivot[a:b]]) for a, b in zip(ends[:-1], ends[1:])]


def footrule_gains(files: list, order: np.ndarray, n: int, prefix: int) -> np.ndarray:
    """How close the order of each of ``n`` members is to a query's; greater means closer.

    A pivot outside one of the two prefixes counts as if it stood just behind it, so each
    shared pivot lowers the distance by ``prefix - |difference of places|`` and a bit more.
    """
    gain = np.zeros(n, np.int32)
    for place, pivot in enumerate(order.tolist()):
        members, places = files[pivot]
        gain[members] += 2 * prefix - place - places - np.abs(places - place)
    return gain


class Ranking:
    """Ranks the members of a block by length times the cosine that their footrule distance suggests."""

    def __init__(self, x: np.ndarray, files: list, prefix: int, probes: np.ndarray, orders: np.ndarray, k: int, target: float, least: int):
        self.files, self.n, self.prefix = files, len(x), prefix
        self.lengths = np.linalg.norm(x, axis=1)
        exact = probes @ x.T
        cosines = exact / (np.linalg.norm(probes, axis=1, keepdims=True) * self.lengths)
        gains = np.stack([footrule_gains(files, o, self.n, prefix) for o in orders]).astype(float)
        spread = gains.var()
        self.slope = float(((gains - gains.mean()) * (cosines - cosines.mean())).mean() / spread) if spread > 0 else 0.0
        self.start = float(cosines.mean() - self.slope * gains.mean())
        # Where the true nearest of the probes stand in this ranking.
        places = []
        for scores, gain in zip(exact, gains):
            place = np.empty(self.n, int)
            place[np.argsort(-self.expected(gain), kind="stable")] = np.arange(self.n)
            places.append(place[np.argsort(-scores, kind="stable")[:k]])
        self.most = min(self.n, max(least, 1 + int(np.quantile(np.concatenate(places), target))))

    def expected(self, gain: np.ndarray) -> np.ndarray:
        return self.lengths * (self.start + self.slope * gain)

    def first(self, order: np.ndarray) -> np.ndarray:
        """The members that are ranked again for a query with this order."""
        if self.most >= self.n:
            return np.arange(self.n)
        expected = self.expected(footrule_gains(self.files, order, self.n, self.prefix))
        return np.sort(np.argpartition(-expected, self.most - 1)[:self.most])


def _orders(pivots: np.ndarray, prefix: int):
    def run(vectors: pa.Array):
        x = np.array(vectors.to_pylist(), float)
        return [[o.tobytes() for o in nearest_pivots(x, pivots, prefix)]]
    return run


def _matrices(frame: pd.DataFrame, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    orders = np.frombuffer(b"".join(frame["places"]), np.int16).reshape(len(frame), prefix)
    return np.stack(frame["v"].to_numpy()), orders


def _search_block(pivots: int, prefix: int, target: float, least: int, k: int):
    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = {"query": [], "rep": [], "score": []}
        if len(rows) and len(queries):
            rows, queries = rows.sort_values("rep"), queries.sort_values("query")
            (x, orders), (q, asked) = _matrices(rows, prefix), _matrices(queries, prefix)
            reps, files = rows["rep"].to_numpy(), post(orders, pivots)
            # Queries come in the order of their ids; the probes are spread over them.
            probes = np.unique(np.linspace(0, len(q) - 1, PROBES).astype(int))
            ranking = Ranking(x, files, prefix, q[probes], asked[probes], k, target, least)
            for query, vector, order in zip(queries["query"], q, asked):
                found = ranking.first(order)
                scores = np.einsum("ij,j->i", x[found], vector)
                best = np.lexsort((reps[found], -scores))[:k]
                out["query"] += [query] * len(best)
                out["rep"] += reps[found][best].tolist()
                out["score"] += scores[best].tolist()
        return pd.DataFrame(out).astype({"query": "int64", "rep": "int64", "score": "float64"})
    return run


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding",
    pivots: int = PIVOTS, prefix: int = PREFIX, target: float = TARGET, least_rerank: int = LEAST_RERANK,
    row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``k`` nearest found for each query.

    ``is_query`` is a condition on ``vec_id``. Equal vectors are indexed and searched once, under
    their smallest id; the ``k + 1`` smallest ids of each are enough for any answer, because ties
    go to the smaller id and only the query itself is left out. Repeated rows of an id with one
    vector count once. Vectors may differ in length: products decide, not cosines. Only the two
    named columns are read. No usable row gives an empty result.
    """
    good = usable(vectors, vec_id, vector)
    # Equal vectors have equal text; the id lists are cut before the shuffle by the rank filter.
    stored = materialise(good.select("vec_id", "v").distinct(), "ann-rows")
    by_vector = Window.partitionBy("v").orderBy("vec_id")
    ranked = stored.withColumn("at", F.row_number().over(by_vector)).filter(F.col("at") <= k + 1)
    groups = materialise(
        ranked.groupBy("v").agg(F.min("vec_id").alias("rep"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "ann-groups")
    members = stored.filter(is_query).join(groups.select("v", "rep"), "v").select(F.col("vec_id").alias("query_id"), F.col("rep").alias("query"))
    chosen = choose_pivots(groups, pivots)
    prefix = min(prefix, max(len(chosen), 1))
    indexed = materialise(map_columns(groups.select("rep", "v"), ["v"], "places binary", _orders(chosen, prefix)), "ann-orders")
    asked = members.select(F.col("query").alias("rep")).distinct().join(indexed, "rep").select(F.col("rep").alias("query"), "v", "places")
    asked = materialise(asked, "ann-queries")

    n_rows, n_queries = groups.count(), asked.count()
    row_blocks, query_blocks = -(-n_rows // row_block) or 1, -(-n_queries // query_block) or 1
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = indexed.select("rep", "v", "places", block("rep", row_blocks).alias("rb")).withColumn("qb", every(query_blocks))
    right = asked.select("query", "v", "places", block("query", query_blocks).alias("qb")).withColumn("rb", every(row_blocks))
    found = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInPandas(
        _search_block(len(chosen), prefix, target, least_rerank, k + 1), "query long, rep long, score double")
    # k + 1 groups per query: one of them may be the query's own vector.
    top = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    best = materialise(found.withColumn("place", F.row_number().over(top)).filter(F.col("place") <= k + 1), "ann-best")
    answers = (
        best.join(groups.select("rep", "ids"), "rep").join(members, "query")
        .select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id")
    )
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
