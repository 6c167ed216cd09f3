"""Near-duplicate documents: MinHash bands, sequential Bayesian verification, exact confirmation.

1. Each text is read once: shingle set, MinHash signature, band keys, and a digest of its word
   sequence. Texts with one digest are one class; only its smallest id goes on.
2. Classes that share a band bucket are candidates. A bucket is never expanded into all its
   pairs. First each member meets the smallest and the largest id of its buckets. Members that
   are then connected need no further comparison. Of the others, members of a small bucket are
   compared one by one; members of large buckets are compared through what sets them apart from a
   hub (see ``crowd_pairs``). So no pair that the bands find is lost, and a large group of copies
   costs a few comparisons per member.
3. A candidate pair is compared batch by batch of signature values. It is dropped as soon as the
   posterior probability that its similarity reaches the threshold falls below ``miss``; what is
   left is confirmed on the full shingle sets.

With 32 bands of 4 rows, a pair at similarity 0.75 shares no band with probability
(1 - 0.75**4)**32 = 5e-6, and less above it.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlens.llm.texts import map_columns, mixed, window_hashes, word_hashes
from chatlens.session import materialise
from chatlens.topics.components import connected_components

WIDTH = 5
PERCENT = 75
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
BATCH = 16
CROWD = 24  # members up to which a bucket is compared member by member
MISS = 1e-6

_random = np.random.default_rng(20)
_FACTORS = _random.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_OFFSETS = _random.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


def lowered(text: str) -> bytes:
    """UTF-8 of the text with A-Z in lower case and nothing else changed."""
    return text.encode("utf-8", "replace").lower()


def shingle_set(text: str, width: int = WIDTH) -> set[tuple[bytes, ...]]:
    """The distinct runs of ``width`` words; a shorter text is one shingle, an empty one has none."""
    words = lowered(text).split()
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*[words[k:] for k in range(width)]))


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash signature of 64-bit shingle hashes."""
    values = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(values), 4096):
        block = values[start:start + 4096, None] * _FACTORS + _OFFSETS
        np.minimum(best, block.min(axis=0), out=best)
    return best


def _sketch(texts: pa.Array):
    counts, keys, signatures, bands = [], [], [], []
    for text in texts.to_pylist():
        raw = lowered(text or "")
        hashes = word_hashes(raw)
        if not len(hashes):
            counts.append(0), keys.append(None), signatures.append(None), bands.append(None)
            continue
        digest = hashlib.sha256()
        digest.update(b" ".join(raw.split()))
        keys.append(digest.digest()[:16])
        if len(hashes) < WIDTH:  # one shingle: linked with equal sequences only, which share the key
            counts.append(1), signatures.append(None), bands.append(None)
            continue
        shingles = np.unique(window_hashes(hashes, WIDTH))
        values = signature(shingles)
        counts.append(len(shingles))
        signatures.append(values.tobytes())
        with np.errstate(over="ignore"):
            rows = values.reshape(BANDS, ROWS).astype(np.uint64)
            key = np.arange(1, BANDS + 1, dtype=np.uint64)
            for k in range(ROWS):
                key = mixed(key ^ rows[:, k])
        bands.append(key.view(np.int64))
    return [counts, keys, signatures, bands]


def sketches(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, key, signature and bands of each row (nulls where a text has no words)."""
    return map_columns(
        docs, [text], "n_shingles long, key binary, signature binary, bands array<long>", _sketch, keep=["doc_id"])


@functools.lru_cache
def least_matches(percent: int = PERCENT, miss: float = MISS) -> tuple[int, ...]:
    """After each batch, the fewest equal values with which a pair goes on.

    With a uniform prior, m equal values of n leave similarity J a Beta(m + 1, n - m + 1)
    posterior, and P(J >= t) is the probability of at most m successes in n + 1 trials at t.
    """
    t, least = percent / 100, []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, 0
        while True:
            total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if total >= miss:
                break
            m += 1
        least.append(m)
    return tuple(least)


def _likely(percent: int, miss: float):
    bounds = least_matches(percent, miss)

    def run(left: pa.Array, right: pa.Array):
        n = len(left)
        a, b = (np.frombuffer(b"".join(x.to_pylist()), np.uint32).reshape(n, HASHES) for x in (left, right))
        alive, matches = np.arange(n), np.zeros(n, int)
        for k, least in enumerate(bounds):
            part = slice(k * BATCH, (k + 1) * BATCH)
            matches[alive] += (a[alive, part] == b[alive, part]).sum(axis=1)
            alive = alive[matches[alive] >= least]
        out = np.zeros(n, bool)
        out[alive] = True
        return [pa.array(out)]

    return run


def _linked(percent: int):
    def run(a: pa.Array, b: pa.Array, text_a: pa.Array, text_b: pa.Array):
        last: dict[int, set] = {}  # a run of pairs often shares one side

        def of(node: int, text: str) -> set:
            if node not in last:
                if len(last) >= 32:
                    last.clear()
                last[node] = shingle_set(text)
            return last[node]

        out = []
        for x, y, s, t in zip(a.to_pylist(), b.to_pylist(), text_a.to_pylist(), text_b.to_pylist()):
            one, two = of(x, s), of(y, t)
            both = len(one & two)
            out.append(100 * both >= percent * (len(one) + len(two) - both))
        return [out]

    return run


def confirmed(pairs: DataFrame, nodes: DataFrame, percent: int = PERCENT, miss: float = MISS) -> DataFrame:
    """The pairs (a, b) whose texts are similar. ``nodes`` has node, signature and text, stored."""
    side = lambda name, column: nodes.select(F.col("node").alias(name), F.col(column).alias(f"{column}_{name}"))
    signed = pairs.join(side("a", "signature"), "a").join(side("b", "signature"), "b")
    likely = map_columns(
        signed, ["signature_a", "signature_b"], "likely boolean", _likely(percent, miss), keep=["a", "b"]
    ).filter("likely").select("a", "b")
    texts = likely.join(side("a", "text"), "a").join(side("b", "text"), "b")
    return map_columns(
        texts, ["a", "b", "text_a", "text_b"], "linked boolean", _linked(percent), keep=["a", "b"]
    ).filter("linked").select("a", "b")


def _shingle_hashes(texts: pa.Array):
    return [[np.unique(window_hashes(word_hashes(lowered(t)), WIDTH)).view(np.int64) for t in texts.to_pylist()]]


def crowd_pairs(crowd: DataFrame, nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) that may be linked, among the members of large buckets ``crowd(bucket, node, part)``.

    Buckets that share members form a group, and the member with the most and largest buckets is
    its hub. With d(x) the shingles in which x and the hub differ, w(x) = (100 + p) |d(x)| -
    (100 - p) |x| turns the link condition into

        w(x) + w(y) <= 2 (100 + p) |d(x) & d(y)|

    exactly, whatever the hub is. If w(x) + w(y) <= 0 the pair is linked, and the member with the
    smallest w is then linked with both, so one star finds all of these. Any other pair must share
    differences: they are ordered from rare to frequent, differences of one member alone are left
    out, and a pair is kept only where the places of a shared difference leave room for enough of
    them. Near copies differ from their hub in few and different shingles, so few pairs remain. A
    difference that most members share comes last and leaves little room, so only members whose
    values of w nearly cancel out meet at it.
    """
    high, low = 100 + percent, 100 - percent
    least = crowd.groupBy("bucket").agg(F.min("node").alias("u"), F.count("*").alias("n"))
    sized = materialise(crowd.join(least, "bucket"), "near-crowd")
    groups = connected_components(sized.select("u", F.col("node").alias("v")))
    weight = sized.groupBy("node").agg(F.sum("n").alias("n"), F.min("part").alias("part"))
    placed = weight.join(groups.withColumnRenamed("component", "group"), "node")
    hubs = placed.groupBy("group").agg(F.max_by("node", F.struct("n", -F.col("node"))).alias("hub"))
    sets = map_columns(
        nodes.join(weight.select("node"), "node", "left_semi"), ["text"], "tokens array<long>", _shingle_hashes, keep=["node"])
    sets = materialise(placed.select("node", "group", "part").join(sets, "node"), "near-sets")
    hub_sets = hubs.join(sets.select(F.col("node").alias("hub"), F.col("tokens").alias("hub_tokens")), "hub").select("group", "hub_tokens")
    apart = sets.join(hub_sets, "group").withColumn(
        "d", F.concat(F.array_except("tokens", "hub_tokens"), F.array_except("hub_tokens", "tokens")))
    apart = materialise(apart.select(
        "group", "node", "part", "d", F.size("d").alias("n"), (high * F.size("d") - low * F.size("tokens")).alias("w")), "near-apart")

    centre = apart.groupBy("group").agg(F.min_by(F.struct("node", "w", "part"), F.struct("w", "node")).alias("c"))
    star = apart.join(centre, "group").filter((F.col("w") + F.col("c.w") <= 0) & (F.col("part") != F.col("c.part"))).select(
        F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b"))

    single = apart.select("group", "node", "part", "n", "w", F.explode("d").alias("token"))
    shared = single.groupBy("group", "token").agg(F.count("*").alias("df")).filter("df > 1")
    mine = Window.partitionBy("node")
    # How many differences of the member follow in the order, this one included.
    placed = single.join(shared, ["group", "token"]).withColumn(
        "room", F.count("*").over(mine) - F.row_number().over(mine.orderBy("df", "token")) + 1)
    entries = materialise(placed.select("group", "token", "node", "part", "w", "room"), "near-entries")
    # A pair needs 0 < w(x) + w(y) <= 2 (100 + p) room, so the w of a partner lies in a band behind
    # -w(x). Bands as wide as the most room of a token split the members of a frequent one, and
    # each side reaches for two of them only.
    widest = entries.groupBy("group", "token").agg((2 * high * F.max("room")).alias("band"))
    banded = materialise(entries.join(widest, ["group", "token"]), "near-bands")
    side = lambda x: banded.select(
        "group", "token", "band", F.col("node").alias(x), F.col("part").alias(f"part_{x}"), F.col("w").alias(f"w_{x}"), F.col("room").alias(f"room_{x}"))
    here = F.floor(-F.col("w_a") / F.col("band"))
    reach = side("a").withColumn("at", F.explode(F.array(here, here + 1))).drop("band")
    found = side("b").withColumn("at", F.floor(F.col("w_b") / F.col("band"))).drop("band")
    need = F.col("w_a") + F.col("w_b")
    met = reach.join(found, ["group", "token", "at"]).filter(
        (F.col("a") < F.col("b")) & (F.col("part_a") != F.col("part_b"))
        & (need > 0) & (2 * high * F.least("room_a", "room_b") >= need))
    return star.unionByName(met.select("a", "b")).distinct()


def _placed(members: DataFrame, parts: DataFrame) -> DataFrame:
    """Members of buckets with their component; a node without one is its own."""
    return members.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")


def _spanning(placed: DataFrame) -> DataFrame:
    """The members of buckets that hold more than one component."""
    spans = placed.groupBy("bucket").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count("*").alias("n")).filter("p < q")
    return placed.join(spans.select("bucket", "n"), "bucket")


def components(
    sketch: DataFrame, docs: DataFrame, several: DataFrame | None, text: str = "text", percent: int = PERCENT, miss: float = MISS,
) -> DataFrame:
    """``node, component`` of the class representatives that are linked with others.

    ``several(doc_id, chosen)`` has the key of the text that counts for ids with more than one.
    """
    shared = sketch.filter("bands is not null").select(F.col("doc_id").alias("node"), F.explode("bands").alias("bucket"))
    ends = shared.groupBy("bucket").agg(
        F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high")
    members = materialise(shared.join(ends, "bucket").distinct(), "near-members")
    wanted = members.select("node").distinct()
    # One row per node, even where a doc_id is repeated. Signatures and texts of candidates only.
    texts = docs.select(F.col("doc_id").alias("node"), F.col(f"`{text}`").alias("text")).join(wanted, "node", "left_semi")
    if several is not None:
        keyed = map_columns(texts, ["text"], "n_shingles long, key binary, signature binary, bands array<long>", _sketch)
        texts = keyed.join(several.withColumnRenamed("doc_id", "node"), "node", "left").filter(
            F.col("key") == F.coalesce("chosen", "key")).select("node", "text")
    nodes = materialise(
        sketch.select(F.col("doc_id").alias("node"), "signature").join(wanted, "node").dropDuplicates(["node"])
        .join(texts.dropDuplicates(["node"]), "node"), "near-nodes")
    as_edges = lambda links: links.select(F.col("a").alias("u"), F.col("b").alias("v"))

    # First round: each member meets the smallest and the largest id of all its buckets.
    ends = members.groupBy("node").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    first = ends.select(F.explode(F.array(
        F.struct(F.col("low").alias("a"), F.col("node").alias("b")), F.struct(F.col("node").alias("a"), F.col("high").alias("b")))).alias("p")
    ).select("p.*").filter("a < b").distinct()
    first = materialise(first, "near-first")
    links = materialise(confirmed(first, nodes, percent, miss), "near-links")
    parts = materialise(connected_components(as_edges(links)), "near-parts")

    # Second round: buckets that still span several components. Small ones compare their members
    # across components, at most CROWD per member; large ones go another way.
    open_members = materialise(_spanning(_placed(members.select("bucket", "node"), parts)), "near-open")
    few = open_members.filter(F.col("n") <= CROWD)
    side = lambda name: few.select("bucket", F.col("part").alias(f"part_{name}"), F.col("node").alias(name))
    pairs = side("a").join(side("b"), "bucket").filter("a < b and part_a <> part_b").select("a", "b")
    crowd = open_members.filter(F.col("n") > CROWD).select("bucket", "node", "part")
    pairs = pairs.unionByName(crowd_pairs(crowd, nodes, percent)).distinct()
    second = materialise(pairs.join(first, ["a", "b"], "left_anti"), "near-second")
    more = confirmed(second, nodes, percent, miss)

    # Components of the first round are the nodes of the second.
    part = lambda name: parts.select(F.col("node").alias(name), F.col("component").alias(f"part_{name}"))
    between = more.join(part("a"), "a", "left").join(part("b"), "b", "left").select(
        F.coalesce("part_a", "a").alias("u"), F.coalesce("part_b", "b").alias("v"))
    joined = materialise(connected_components(between), "near-joined")
    settled = parts.join(joined.select(F.col("node").alias("component"), F.col("component").alias("_to")), "component", "left").select(
        "node", F.coalesce("_to", "component").alias("component"))
    # Nodes without a link in the first round stand for themselves in the second.
    return settled.unionByName(joined.join(parts, "node", "left_anti"))


def near_duplicates(docs: DataFrame, text: str = "text", percent: int = PERCENT, miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs``.

    Null, empty and blank texts have no shingles and stay alone. A row without an id is kept
    with a null component. Rows of an id with words are one document and get the same answer; if
    their texts differ, the one whose words have the smallest digest is the document's. Only doc_id and the
    text are read, so other columns cannot clash. An empty table gives an empty result.
    """
    sketch = materialise(sketches(docs, text), "near-sketch")
    wordy = sketch.filter("key is not null and doc_id is not null")
    several = materialise(wordy.groupBy("doc_id").agg(F.min("key").alias("chosen"), F.max("key").alias("_last")).filter(
        F.col("chosen") != F.col("_last")).drop("_last"), "near-several")
    if several.isEmpty():
        several = None
    else:
        wordy = materialise(wordy.join(several, "doc_id", "left").filter(F.col("key") == F.coalesce("chosen", "key")).drop("chosen"), "near-chosen")
    classes = materialise(wordy.groupBy("key").agg(F.min("doc_id").alias("rep")), "near-classes")
    reps = wordy.join(classes, [wordy.key == classes.key, wordy.doc_id == classes.rep], "left_semi")
    found = components(reps, docs, several, text, percent, miss)
    placed = wordy.select("doc_id", "n_shingles", "key").join(classes, "key").join(
        found.select(F.col("node").alias("rep"), "component"), "rep", "left"
    ).select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    if several is not None:
        # All rows of an id that have words get the answer of its document.
        one = placed.dropDuplicates(["doc_id"]).withColumnRenamed("doc_id", "_id")
        rows = sketch.filter("key is not null and doc_id is not null").select("doc_id")
        placed = rows.join(one, F.col("doc_id") == F.col("_id")).drop("_id")
    alone = sketch.filter("key is null or doc_id is null")
    alone = alone.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return placed.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
