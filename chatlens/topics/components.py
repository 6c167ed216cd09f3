"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.session import remove_stored, scratch_path


def _to_minimum(directed: DataFrame) -> DataFrame:
    """Add to each directed edge (u, v) the smallest node around u, including u.

    One side of the join has one row per node, so the adaptive skew join can
    split a node with very many edges.
    """
    least = directed.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    return directed.join(least, "u")


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``(node, component)`` for every node of ``edges(u, v)``; the smallest node names it.

    Alternates the large-star and small-star steps of Kiveris et al.,
    "Connected Components in MapReduce and Beyond" (2014): each node connects
    its larger, then its smaller neighbours to the smallest one around it. The
    number of rounds grows with the logarithm of the graph, the edge table never
    grows, and each round is stored, which cuts the lineage. A round's table is
    deleted when the next one has been written.
    """
    spark = edges.sparkSession

    def stored(table: DataFrame) -> tuple[DataFrame, str]:
        path = scratch_path(spark, "edges")
        table.write.parquet(path)
        return spark.read.schema(table.schema).parquet(path), path

    now, path = stored(
        edges.filter(F.col("u") != F.col("v"))
        .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        # Edges that a step moves are marked; a round that moves none has met stars only.
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_minimum(both).filter(F.col("v") > F.col("u")).groupBy(F.col("v").alias("u"), F.col("m").alias("v")).agg(
            F.max(F.col("m") != F.col("u")).alias("moved"))
        # All edges now point from the larger to the smaller node.
        seen = _to_minimum(large).withColumn("moved", F.col("moved") | (F.col("m") != F.col("v")))
        ends = F.array(F.struct(F.col("m").alias("u"), "v"), F.struct(F.col("m").alias("u"), F.col("u").alias("v")))
        small = seen.select("moved", F.inline(ends)).filter("u != v")
        before = path
        now, path = stored(small.groupBy("u", "v").agg(F.max("moved").alias("moved")))
        remove_stored(spark, before)
        if not now.agg(F.max("moved")).first()[0]:
            break
    else:
        raise RuntimeError("components did not settle")
    members = now.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return members.unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
