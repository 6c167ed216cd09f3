"""Mix sources to target weights by balanced sampling with the cube method.

Each source gets a target number of words. A document is taken ``floor(rate)`` times for
certain and once more with the fractional rest of its source's rate as its inclusion
probability. The flight phase moves these probabilities within small blocks along vectors
that change neither the expected words nor the expected documents, until nearly all are 0
or 1. What is left of all blocks forms new blocks, level after level, and only the last
handful per source is a landing problem, solved by giving up the document total first.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlens.llm.texts import n_words
from chatlens.session import materialise

# The weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
BLOCK = 1024
_NEAR = 1e-9


def source_targets(
    sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES
) -> DataFrame:
    """``source, source_size, n_units, target`` for ``sized(source, size, …)``.

    The sources share ``share`` times all sizes by weight; no target exceeds ``most`` times the
    size of its source, and what is above goes to the others by weight. With the sources sorted
    by cap over weight, a source is capped exactly if its cap is below the level that the rest
    would reach. Both windows see one row per source.
    """
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_units"))
    place = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = per_source.withColumn("_place", F.row_number().over(place) - 1).withColumn(
        "_w", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("_place", F.lit(len(weights)))))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_level = Window.orderBy(F.col("_cap") / F.col("_w"), "_place")
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        ranked.withColumn("_cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("_all", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("_level", (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after))
        .withColumn("_capped", F.col("_cap") <= F.col("_level") * F.col("_w"))
        .withColumn("_level", F.min(F.when(~F.col("_capped"), F.struct(F.col("_cap") / F.col("_w"), "_place", "_level"))).over(everything)["_level"])
    )
    return levels.select(
        "source", "source_size", "n_units",
        F.when(F.col("_capped"), F.col("_cap")).otherwise(F.col("_level") * F.col("_w")).alias("target"),
    )


def flight(chance: np.ndarray, size: np.ndarray, random: np.random.Generator, land: bool = False) -> np.ndarray:
    """Move inclusion probabilities to 0 or 1 while the expected size and count stay.

    Takes three open units at a time: with the two constraints they have one direction to move
    in, and a step ends when one of the three reaches 0 or 1. At most two units stay open. With
    ``land``, the last two are moved along the size constraint alone and the last one is drawn.
    """
    chance = chance.astype(float).copy()
    draws = random.random(2 * len(chance) + 4)
    waiting = [i for i in range(len(chance)) if _NEAR < chance[i] < 1 - _NEAR]
    step, at, held = 0, 0, []

    def move(units: Sequence[int], direction: Sequence[float]) -> None:
        nonlocal step
        up = down = np.inf
        for i, d in zip(units, direction):
            if d > 0:
                up, down = min(up, (1 - chance[i]) / d), min(down, chance[i] / d)
            elif d < 0:
                up, down = min(up, chance[i] / -d), min(down, (1 - chance[i]) / -d)
        by = up if draws[step] * (up + down) < down else -down
        step += 1
        for i, d in zip(units, direction):
            value = chance[i] + by * d
            chance[i] = 0.0 if value < _NEAR else 1.0 if value > 1 - _NEAR else value

    while True:
        while len(held) < 3 and at < len(waiting):
            held.append(waiting[at])
            at += 1
        if len(held) < 3:
            break
        a, b, c = (float(size[i]) for i in held)
        direction = [b - c, c - a, a - b]
        if direction == [0.0, 0.0, 0.0]:
            direction = [1.0, -1.0, 0.0]
        largest = max(map(abs, direction))
        move(held, [d / largest for d in direction])
        held = [i for i in held if 0.0 < chance[i] < 1.0]
    if land:
        while len(held) == 2:
            a, b = (float(size[i]) for i in held)
            largest = max(a, b, 1.0)
            move(held, [b / largest, -a / largest] if a > 0 and b > 0 else [1.0, 0.0] if a == 0 else [0.0, 1.0])
            held = [i for i in held if 0.0 < chance[i] < 1.0]
        for i in held:
            chance[i] = 1.0 if draws[step] < chance[i] else 0.0
            step += 1
    return chance


def _fly(land: bool, seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # Large units first: what stays open at the end is small, and so is the landing error.
        pdf = pdf.sort_values(["size", "_order", "doc_id"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        first = pdf.iloc[0]
        name = f"{seed}|{first['source']!r}|{first['_level']}|{first['_block']}"
        random = np.random.default_rng(xxhash.xxh3_64_intdigest(name.encode()))
        pdf["chance"] = flight(pdf["chance"].to_numpy(), pdf["size"].to_numpy(), random, land)
        return pdf
    return run


def _blocks(open_units: DataFrame, level: int, most: int, block: int, seed: int) -> DataFrame:
    """Deal the open units of each source to blocks of about ``block`` by a hash of the id."""
    order = F.xxhash64("doc_id", F.lit(seed), F.lit(level))
    return open_units.withColumns({
        "_order": order, "_level": F.lit(level),
        "_block": F.pmod(F.xxhash64(order), F.ceil(F.col("n_open") / F.lit(block)) if most > block else F.lit(1)),
    })


def choose_copies(
    sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES,
    block: int = BLOCK, seed: int = 7,
) -> DataFrame:
    """``source, doc_id, copies, source_size, target`` per (source, doc_id) of ``sized(doc_id, source, size)``.

    Rows with one source and doc_id share their fate: they are one unit with the sum of their
    sizes. So do all rows of a source whose id is null. The choice depends on ids, sources, sizes
    and ``seed`` only, never on the partitioning.
    """
    # Sizes are summed by unit once; ids are distinct within a source, so the blocks stay bounded.
    units = sized.groupBy("source", "doc_id").agg(F.sum("size").alias("size"))
    units = materialise(units, "mix-units")
    targets = materialise(source_targets(units, weights, share, most), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # A rate that misses a whole number by rounding only is that number.
    rate = F.when(F.abs(rate - F.round(rate)) <= _NEAR, F.round(rate)).otherwise(rate)
    t = targets.withColumnRenamed("source", "_source")
    rated = units.join(t, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("_rate", rate)
    rated = rated.withColumn("certain", F.floor("_rate").cast("int")).withColumn(
        "chance", F.col("_rate") - F.col("certain"))
    # Units without words change no total, and a rate without a rest leaves nothing to draw.
    is_open = (F.col("chance") > _NEAR) & (F.col("chance") < 1 - _NEAR) & (F.col("size") > 0)
    keep = ["source", "doc_id", "size", "chance"]
    # Ids travel as text, because pandas would turn whole numbers next to a null into floats.
    schema = "source string, doc_id string, size long, chance double, n_open long, _order long, _level int, _block long"
    n_open = targets.select(F.col("source").alias("_source"), F.col("n_units").alias("n_open"))
    left = rated.filter(is_open).select(*keep)
    level, done = 0, []
    largest = targets.agg(F.max("n_units")).first()[0] or 0
    while True:
        last = largest <= block
        dealt = _blocks(
            left.join(n_open, F.col("source").eqNullSafe(F.col("_source"))).drop("_source"), level, largest, block, seed)
        dealt = dealt.select("source", F.col("doc_id").cast("string").alias("doc_id"), "size", "chance", "n_open", "_order", "_level", "_block")
        flown = dealt.groupBy("source", "_block").applyInPandas(_fly(last, seed), schema)
        flown = materialise(
            flown.select("source", F.col("doc_id").cast("long").alias("doc_id"), "size", "chance"), f"mix-level-{level}")
        settled = (F.col("chance") == 0) | (F.col("chance") == 1)
        done.append(flown.filter(settled).select("source", "doc_id", F.col("chance").cast("int").alias("_drawn")))
        if last:
            break
        left = flown.filter(~settled)
        counts = left.groupBy("source").agg(F.count("*").alias("n_open")).withColumnRenamed("source", "_source")
        n_open = materialise(counts, "mix-open")
        largest = n_open.agg(F.max("n_open")).first()[0] or 0
        level += 1
    drawn = done[0]
    for more in done[1:]:
        drawn = drawn.unionByName(more)
    drawn = drawn.withColumnsRenamed({"source": "_source", "doc_id": "_doc_id"})
    same = F.col("source").eqNullSafe(F.col("_source")) & F.col("doc_id").eqNullSafe(F.col("_doc_id"))
    return rated.join(drawn, same, "left").select(
        "source", "doc_id", (F.col("certain") + F.coalesce("_drawn", F.lit(0))).alias("copies"), "source_size", "target")


def sized_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, source and size in words (0 for null and empty texts) of each row."""
    return docs.select("doc_id", "source", n_words(F.col(f"`{text}`")).alias("size"))


def mix(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their columns unchanged.

    An empty table gives an empty mix. Documents without words are not taken.
    """
    sized = materialise(sized_documents(docs, text), "mix-sizes")
    taken = choose_copies(sized, **options).filter("copies > 0").select(
        F.col("source").alias("_source"), F.col("doc_id").alias("_doc_id"), F.col("copies").alias("_copies"))
    same = F.col("source").eqNullSafe(F.col("_source")) & F.col("doc_id").eqNullSafe(F.col("_doc_id"))
    wordy = docs.filter(n_words(F.col(f"`{text}`")) > 0)
    return wordy.join(taken, same).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)


def mix_report(docs: DataFrame) -> DataFrame:
    """What the mix takes of each row of ``documents``."""
    sized = materialise(sized_documents(docs), "mix-sizes")
    chosen = choose_copies(sized).withColumnsRenamed({"source": "_source", "doc_id": "_doc_id"})
    same = F.col("source").eqNullSafe(F.col("_source")) & F.col("doc_id").eqNullSafe(F.col("_doc_id"))
    return sized.join(chosen, same).select(
        "doc_id", "source", "size", "source_size", "target", "copies",
        (F.col("size") * F.col("copies")).cast("long").alias("taken"),
    )
