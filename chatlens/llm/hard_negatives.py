"""Hard negatives by exact integer inner products, several candidates per multiplication.

Vectors become whole numbers. For each dimension the biased components of all candidates of a
block stand side by side in the fields of one wide integer (Kronecker packing). An anchor then
needs one multiplication per dimension, whatever the number of candidates: the sum of the products
holds every candidate's score in its field. Fields are as wide as the largest possible sum of the
block, so nothing carries over into the next one and the scores are exact.

Rows and anchors meet block by block. The first pass finds the positives of each anchor among the
rows of its label; the second one finds, for each positive, the best rows of other labels whose
score lies in the stated band below the positive's. Each block answers with its best few, and only
these are ranked again. All rows are compared with all anchors, so work grows with rows times
anchors; rows are copied once per block of anchors.
"""

from __future__ import annotations

import math
from operator import mul

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlens.session import materialise

ROW_BLOCK, ANCHOR_BLOCK = 8192, 1024
_LONG = (1 << 63) - 1


def whole_vectors(
    vectors: DataFrame, label: Column, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256,
) -> DataFrame:
    """``id, label, v`` (array<long>, ``floor(scale * x)``) of the rows that take part.

    Left out: null ids, labels and vectors, vectors with a null or non-finite component, vectors
    whose size is not the most frequent one (the larger if equal), and vectors with a component so
    large that their product with themselves would not fit a long. An id is one row: of several,
    the one with the smallest label and then the smallest vector counts.
    """
    v = F.col("v")
    whole = F.transform(F.col(f"`{vector}`").cast("array<double>"), lambda x: F.lit(float(scale)) * x)
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), label.cast("long").alias("label"), whole.alias("v"))
    # A component that is infinite or not a number fails the comparison with the limit.
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & finite)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    dimension = sizes.d if sizes else 0
    limit = float(math.isqrt(_LONG // max(dimension, 1)) - 1)
    fits = F.forall(v, lambda x: F.abs(x) <= F.lit(limit))
    rows = rows.filter((F.size("v") == dimension) & fits)
    one = rows.select("id", F.struct("label", F.transform("v", lambda x: F.floor(x).cast("long")).alias("v")).alias("row"))
    return one.groupBy("id").agg(F.min("row").alias("row")).select("id", "row.label", "row.v")


class Packed:
    """Candidates of a block in the fields of one wide integer per dimension."""

    def __init__(self, candidates: np.ndarray, least: int, most: int):
        """``least`` and ``most`` bound the components of the anchors that will be asked."""
        self.count, self.dimension = candidates.shape
        self.lift = max(0, -int(candidates.min(initial=0)))
        self.anchor_lift = max(0, -least)
        largest = self.dimension * (int(candidates.max(initial=0)) + self.lift) * (most + self.anchor_lift)
        self.width = max(1, -(-largest.bit_length() // 8))  # bytes of a field
        raised = (candidates + self.lift).astype("<u8")
        self.words = [int.from_bytes(self._fields(raised[:, d]), "little") for d in range(self.dimension)]
        # What the lift of the anchor adds to each field; sums wrap around like the fields read back.
        with np.errstate(over="ignore"):
            self.added = np.uint64(self.anchor_lift) * candidates.astype(np.int64).sum(axis=1).view(np.uint64)

    def _fields(self, column: np.ndarray) -> bytes:
        raw = np.ascontiguousarray(column).view(np.uint8).reshape(self.count, 8)
        out = np.zeros((self.count, self.width), np.uint8)
        used = min(8, self.width)
        out[:, :used] = raw[:, :used]
        return out.tobytes()

    def scores(self, anchor: list[int]) -> np.ndarray:
        """Exact inner products of one anchor with all candidates."""
        if not self.count:
            return np.empty(0, np.int64)
        total = sum(map(mul, (a + self.anchor_lift for a in anchor), self.words))
        raw = np.frombuffer(total.to_bytes(self.count * self.width, "little"), np.uint8).reshape(self.count, self.width)
        low = np.zeros((self.count, 8), np.uint8)
        used = min(8, self.width)
        low[:, :used] = raw[:, :used]
        fixed = (self.lift * sum(anchor) + self.dimension * self.anchor_lift * self.lift) % (1 << 64)
        with np.errstate(over="ignore"):
            return (low.view("<u8").reshape(-1) - self.added - np.uint64(fixed)).view(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, highest first, ties to the smaller id."""
    found = np.arange(len(scores))
    if len(scores) > k:
        found = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return found[np.lexsort((ids[found], -scores[found]))[:k]]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64) if len(column) else np.empty((0, 0), np.int64)


def _bounds(vectors: np.ndarray) -> tuple[int, int]:
    return int(vectors.min(initial=0)), int(vectors.max(initial=0))


def _find_positives(k: int):
    def run(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        by_label = dict(tuple(rows.groupby("label"))) if len(rows) else {}
        for label, asked in anchors.groupby("label") if len(anchors) else ():
            if label not in by_label:
                continue
            ids, queries = by_label[label]["id"].to_numpy(), _matrix(asked["v"])
            packed = Packed(_matrix(by_label[label]["v"]), *_bounds(queries))
            for anchor, query in zip(asked["id"].tolist(), queries.tolist()):
                scores = packed.scores(query)
                # One more than wanted, since the anchor itself may be among them.
                places = [p for p in best(scores, ids, k + 1) if ids[p] != anchor][:k]
                out += [(anchor, int(ids[p]), int(scores[p])) for p in places]
        return pd.DataFrame(out, columns=["anchor_id", "positive_id", "positive_score"]).astype("int64")
    return run


def _find_negatives(k: int, low: int, high: int):
    def run(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(rows) and len(anchors):
            ids, labels, queries = rows["id"].to_numpy(), rows["label"].to_numpy(), _matrix(anchors["v"])
            packed = Packed(_matrix(rows["v"]), *_bounds(queries))
            for anchor, label, query, positives in zip(anchors["id"].tolist(), anchors["label"], queries.tolist(), anchors["positives"]):
                other = np.flatnonzero(labels != label)
                scores, names = packed.scores(query)[other], ids[other]
                known: dict[int, list[tuple[int, int]]] = {}
                for positive in positives:
                    limit = int(positive["positive_score"])
                    if limit not in known:
                        # low * positive <= 100 * negative <= high * positive, in whole numbers
                        inside = np.flatnonzero((scores >= -(-low * limit // 100)) & (scores <= high * limit // 100))
                        places = inside[best(scores[inside], names[inside], k)]
                        known[limit] = list(zip(names[places].tolist(), scores[places].tolist()))
                    out += [(anchor, int(positive["positive_id"]), limit, n, s) for n, s in known[limit]]
        names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
        return pd.DataFrame(out, columns=names).astype("int64")
    return run


def mine(
    vectors: DataFrame, label: Column, is_anchor: Column, vec_id: str = "vec_id", vector: str = "embedding",
    positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
    row_block: int = ROW_BLOCK, anchor_block: int = ANCHOR_BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``label`` and ``is_anchor`` are expressions over the columns of ``vectors``; only these, the id
    and the vector are read, so further columns cannot clash. The positives of an anchor are the
    ``positives`` other rows of its label with the highest scores; its negatives for a positive are
    the ``negatives`` rows of another label with the highest scores among those from ``low`` to
    ``high`` percent of the positive's score. Ties go to the smaller id, and rank counts from 1. A
    pair without negatives has no row: a positive with a score below 0 never has any. Rows that
    take no part are listed at :func:`whole_vectors`; a repeated row counts once. Without usable
    rows or anchors the result is empty.
    """
    marked = vectors.select(vec_id, vector, label.alias("_label"), is_anchor.alias("_anchor"))
    rows = materialise(whole_vectors(marked, F.col("_label"), vec_id, vector, scale), "negatives-rows")
    asked = marked.filter("_anchor").select(F.col(f"`{vec_id}`").cast("long").alias("id")).distinct()
    anchors = materialise(rows.join(asked, "id"), "negatives-anchors")
    row_blocks, anchor_blocks = (max(1, -(-t.count() // size)) for t, size in ((rows, row_block), (anchors, anchor_block)))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("rb", block(row_blocks)).withColumn("ab", every(anchor_blocks)).groupBy("rb", "ab")

    def met(asked: DataFrame, search, schema: str) -> DataFrame:
        right = asked.withColumn("ab", block(anchor_blocks)).withColumn("rb", every(row_blocks)).groupBy("rb", "ab")
        return left.cogroup(right).applyInPandas(search, schema)

    found = met(anchors, _find_positives(positives), "anchor_id long, positive_id long, positive_score long")
    first = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    few = found.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= positives)
    # At most ``positives`` entries per anchor.
    lists = few.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    paired = materialise(anchors.join(lists.withColumnRenamed("anchor_id", "id"), "id"), "negatives-pairs")
    best_few = met(
        paired, _find_negatives(negatives, low, high),
        "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return best_few.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
