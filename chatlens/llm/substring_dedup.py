"""Remove word passages that already occur earlier, found by difference-cover anchors.

A passage is a window of ``width`` consecutive words. Hashing every window of the corpus would
shuffle a row per word. Instead, shorter anchor windows are hashed only at positions whose
remainder modulo a period lies in a difference cover. Any two equal windows, wherever they
start, have a common offset below the period at which both positions are in the cover, so they
share an aligned anchor. Anchors that occur once are dropped; around the others the match is
extended: every full window that contains a repeated anchor is compared by its own hash.

Windows are compared by 96 hash bits of 64-bit word hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlens.llm.texts import map_columns, mixed, window_hashes, word_hashes, word_pieces
from chatlens.llm.texts import words as words_of
from chatlens.session import materialise

WIDTH = 20
# Perfect difference covers; each remainder is the difference of two members.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
LEAST_ANCHOR = 8
_SLICE = 2000


def period_for(width: int) -> int:
    """The largest period that leaves anchors of at least ``LEAST_ANCHOR`` words (1 if none does)."""
    return max(p for p in COVERS if p == 1 or width - p + 1 >= LEAST_ANCHOR)


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def joined_words(raw: bytes) -> bytes:
    return b" ".join([w for piece in word_pieces(raw) for w in piece])


def _measure(texts: pa.Array):
    counts, digests = [], []
    for text in texts.to_pylist():
        raw = _raw(text)
        counts.append(sum(map(len, word_pieces(raw))))
        digests.append(hashlib.sha256(joined_words(raw)).digest())
    return [counts, digests]


def _combined(keys: tuple[np.ndarray, ...], docs: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows in the order of (doc, place): which repeat an earlier key, and a key of its own for each row."""
    order = np.lexsort(keys)  # stable: equal keys stay in their order
    same = np.ones(len(order) - 1, bool)
    for key in keys:
        same &= key[order[1:]] == key[order[:-1]]
    later = np.zeros(len(order), bool)
    later[order[1:]] = same
    return later, mixed(docs.view(np.uint64) ^ (places.astype(np.uint64) << np.uint64(40)))


def _anchors(width: int):
    period = period_for(width)
    size = width - period + 1
    in_cover = np.isin(np.arange(period), COVERS[period])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, _SLICE) for b in batches for i in range(0, b.num_rows, _SLICE)):
            hashes, docs, places = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int32)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = word_hashes(_raw(text))
                if len(words) < width:
                    continue
                at = np.flatnonzero(in_cover[np.arange(len(words) - size + 1) % period])
                hashes.append(window_hashes(words, size)[at])
                docs.append(np.full(len(at), doc, np.int64))
                places.append(at.astype(np.int32))
            h, d, p = np.concatenate(hashes), np.concatenate(docs), np.concatenate(places)
            if not len(h):
                continue
            # Combine before the shuffle: of equal anchors in this slice only the first goes out
            # under its hash, so a frequent anchor sends a few rows per task. The others are known
            # to be repeated and go out under keys of their own.
            _, group, times = np.unique(h, return_inverse=True, return_counts=True)
            n = times[group]
            later, own = _combined((h,), d, p)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.where(later, own, h).view(np.int64)), pa.array(d), pa.array(p),
                pa.array(np.minimum(n, 2).astype(np.int32)),
            ], names=["anchor", "doc_id", "at", "n"])

    return run


def _windows(width: int):
    period = period_for(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, _SLICE) for b in batches for i in range(0, b.num_rows, _SLICE)):
            lows, highs, docs, places = [], [], [], []
            for doc, text, anchors in sorted(zip(*[c.to_pylist() for c in batch.columns]), key=lambda r: r[0]):
                words = word_hashes(_raw(text))
                n = len(words) - width + 1
                if n <= 0:
                    continue
                # Windows that start up to period - 1 words before a repeated anchor contain it.
                edge = np.zeros(len(words) + 1, np.int32)
                a = np.unique(np.array(anchors, np.int64))
                np.add.at(edge, np.maximum(a - period + 1, 0), 1)
                np.add.at(edge, a + 1, -1)
                at = np.flatnonzero(np.cumsum(edge)[:n])
                lows.append(window_hashes(words, width, 1)[at])
                highs.append((window_hashes(words, width, 2)[at] >> np.uint64(32)).astype(np.uint32))
                docs.append(np.full(len(at), doc, np.int64))
                places.append(at.astype(np.int32))
            if not lows:
                continue
            low, high, d, p = (np.concatenate(x) for x in (lows, highs, docs, places))
            # Combine before the shuffle, as for the anchors: of equal windows in this slice only
            # the first goes out under its hash; the others are known to come later.
            later, own = _combined((low, high), d, p)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.where(later, own, low).view(np.int64)), pa.array(high.view(np.int32)), pa.array(d), pa.array(p),
                pa.array(later),
            ], names=["h1", "h2", "doc_id", "at", "later"])

    return run


def _cut(width: int):
    def run(texts: pa.Array, starts: pa.Array):
        removed, spans, kept = [], [], []
        for text, at in zip(texts.to_pylist(), starts.to_pylist()):
            found: list[list[int]] = []
            for s in sorted(set(at or ())):
                if found and s <= found[-1][1]:
                    found[-1][1] = s + width
                else:
                    found.append([s, s + width])
            words = [w for piece in word_pieces(_raw(text)) for w in piece]
            left, end = [], 0
            for a, b in found:
                left += words[end:a]
                end = b
            left += words[end:]
            removed.append(len(words) - len(left))
            spans.append([{"start": a, "end": b} for a, b in found])
            kept.append(hashlib.sha256(b" ".join(left)).hexdigest())
        return [removed, spans, kept]

    return run


_SPANS = "array<struct<start:int,end:int>>"


def repeated_spans(docs: DataFrame, text: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, digest, n_words, n_removed, spans (removed word ranges, end exclusive) and kept_sha256 of each row.

    A word is removed if it is covered by a window whose words also start earlier: in a document
    with a smaller id, or before it in the same one. Null, empty and short texts lose nothing.
    Rows without an id are compared with nothing and lose nothing. Equal rows of an id are one
    document and get the same answer. If an id has several texts, the one whose words have the
    smallest digest is the document; its other texts are compared with nothing and lose nothing.
    Only doc_id and the text are read, so other columns cannot clash. An empty table gives an empty
    result.
    """
    measured = materialise(map_columns(
        docs, [text], "n_words long, digest binary", _measure, keep=["doc_id"]), "passages-base")
    # Ids with several texts, and the digest of the one that counts.
    several = materialise(measured.filter("doc_id is not null and n_words > 0").groupBy("doc_id").agg(
        F.min("digest").alias("chosen"), F.max("digest").alias("_last")).filter(F.col("chosen") != F.col("_last")).drop("_last"),
        "passages-several")
    source = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col(f"`{text}`").alias("text"))
    if several.isEmpty():
        measured = measured.withColumn("counts", F.col("doc_id").isNotNull())
    else:
        own = measured.join(several, "doc_id", "left")
        measured = materialise(own.withColumn(
            "counts", F.col("doc_id").isNotNull() & (F.col("digest") == F.coalesce("chosen", "digest"))).drop("chosen"), "passages-chosen")
        among = map_columns(source.join(several, "doc_id"), ["text"], "n_words long, digest binary", _measure)
        source = source.join(several, "doc_id", "left_anti").unionByName(
            among.filter(F.col("digest") == F.col("chosen")).select("doc_id", "text"))

    # A later copy of a whole text is removed whole; only the first one needs a closer look.
    counted = measured.filter((F.col("n_words") >= width) & F.col("counts"))
    firsts = counted.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    copies = counted.join(firsts.filter("n > 1"), "digest").filter("doc_id > first").select("doc_id").distinct()
    copies = materialise(copies, "passages-copies")

    anchors = source.mapInArrow(_anchors(width), "anchor long, doc_id long, at int, n int")
    times = F.sum("n").over(Window.partitionBy("anchor"))
    repeated = anchors.withColumn("times", times).filter("times > 1").groupBy("doc_id").agg(
        F.collect_list("at").alias("anchors")).join(copies, "doc_id", "left_anti")
    # The one shuffle of texts; only documents with a repeated anchor are kept for what follows.
    work = materialise(source.dropDuplicates(["doc_id"]).join(repeated, "doc_id"), "passages-work")
    windows = work.select("doc_id", "text", "anchors").mapInArrow(_windows(width), "h1 long, h2 int, doc_id long, at int, later boolean")
    place = F.struct("doc_id", "at")
    first = F.min(place).over(Window.partitionBy("h1", "h2"))
    later = windows.withColumn("first", first).filter(F.col("later") | (place > F.col("first"))).groupBy("doc_id").agg(
        F.collect_list("at").alias("starts"))
    cut = map_columns(
        work.select("doc_id", "text").join(later, "doc_id"), ["text", "starts"],
        f"n_removed long, spans {_SPANS}, kept_sha256 string", _cut(width), keep=["doc_id"])
    whole = copies.withColumn("whole", F.lit(True))
    out = measured.join(cut, "doc_id", "left").join(whole, "doc_id", "left")
    gone, counts = F.col("counts") & F.col("whole").isNotNull(), F.col("counts")
    own = lambda c, other: F.coalesce(F.when(counts, F.col(c)), other)
    return out.select(
        "doc_id", "digest", "n_words",
        F.when(gone, F.col("n_words")).otherwise(own("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end"))))
        .otherwise(own("spans", F.array().cast(_SPANS))).alias("spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(own("kept_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"),
    )


def remove_spans(docs: DataFrame, spans: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the words outside of ``spans(doc_id, digest, spans)`` joined by one space as ``text``."""

    def run(texts: pa.Array, found: pa.Array):
        out = []
        for value, cuts in zip(texts.to_pylist(), found.to_pylist()):
            words = [w for piece in word_pieces(_raw(value)) for w in piece]
            left, end = [], 0
            for cut in cuts or ():
                left += words[end:cut["start"]]
                end = cut["end"]
            out.append(b" ".join(left + words[end:]).decode())
        return [out]

    # Rows of one id may hold several texts, told apart by the digest of their words.
    one = spans.select("doc_id", F.col("digest").alias("_digest"), F.col("spans").alias("_spans")).dropDuplicates(["doc_id", "_digest"])
    digest = F.unhex(F.sha2(F.array_join(words_of(F.col(f"`{text}`")), " "), 256))
    joined = docs.withColumn("_digest", digest).join(one, ["doc_id", "_digest"], "left").select(*docs.columns, "_spans")
    return map_columns(joined, [text, "_spans"], f"`{text}` string", run, [c for c in docs.columns])
