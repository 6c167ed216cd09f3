"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

A text becomes a vector of hashed byte trigrams, hashed runs of character classes and counts
of repetition. A bounded labelled sample gives the term weights and, by a truncated singular
value decomposition, the latent axes. The latent vectors of that sample are sent to every task;
each document is compared with all of them by exact cosine products, block against block, and
its nearest neighbours vote with weights that grow with their similarity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlens.llm.texts import map_columns, word_hashes

# Bounds and settings; all are arguments of ``fit``.
SAMPLE_PER_LABEL = 1500
AXES = 64
NEIGHBOURS = 25
POWER = 8
THRESHOLD = 0.3

_TRIGRAMS, _SHAPES = 2048, 512
_EXTRA = 3  # words said twice in a row, words said before, lines said before
TERMS = _TRIGRAMS + _SHAPES + _EXTRA
_PIECE = 1 << 20


def _classes() -> np.ndarray:
    """Class of each byte: lower, upper, digit, non-ASCII; white space and marks stand for themselves."""
    table = np.arange(256, dtype=np.uint32)
    table[ord("a"):ord("z") + 1] = ord("a")
    table[ord("A"):ord("Z") + 1] = ord("A")
    table[ord("0"):ord("9") + 1] = ord("0")
    table[128:] = ord("a")
    return table


_CLASS = _classes()


def _spread(codes: np.ndarray, size: int) -> np.ndarray:
    return np.bincount((codes * np.uint32(2654435761)) >> np.uint32(32 - size.bit_length() + 1), minlength=size)


def term_counts(text: str | None) -> np.ndarray:
    """Square roots of the term frequencies, each group of terms scaled by its own total."""
    raw = (text or "").encode("utf-8", "replace")
    out = np.zeros(TERMS, np.float64)
    for start in range(0, len(raw), _PIECE):
        b = np.frombuffer(raw[start:start + _PIECE + 3], np.uint8).astype(np.uint32)
        if len(b) >= 3:
            out[:_TRIGRAMS] += _spread((b[:-2] << np.uint32(16)) ^ (b[1:-1] << np.uint32(8)) ^ b[2:], _TRIGRAMS)
        c = _CLASS[b]
        change = np.flatnonzero(np.diff(c, prepend=np.uint32(0)))  # one entry per run of a class
        runs, length = c[change], np.minimum(np.diff(np.append(change, len(c))), 9).astype(np.uint32)
        if len(runs) >= 3:
            key = (runs[:-2] << np.uint32(24)) ^ (runs[1:-1] << np.uint32(13)) ^ (runs[2:] << np.uint32(4)) ^ (length[1:-1] > 1)
            out[_TRIGRAMS:_TRIGRAMS + _SHAPES] += _spread(key.astype(np.uint32), _SHAPES)
    for a, b in ((0, _TRIGRAMS), (_TRIGRAMS, _TRIGRAMS + _SHAPES)):
        out[a:b] /= max(out[a:b].sum(), 1)
    words = word_hashes(raw)
    if len(words):
        out[-3] = np.count_nonzero(words[1:] == words[:-1]) / len(words)
        out[-2] = 1 - len(np.unique(words)) / len(words)
        lines = [line for line in raw.split(b"\n") if line.strip()]
        out[-1] = 1 - len(set(lines)) / len(lines)
    return np.sqrt(out)


@dataclass
class Model:
    centre: np.ndarray
    weights: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def latent(self, terms: np.ndarray) -> np.ndarray:
        """Latent vectors of length 1 (0 for texts without terms)."""
        z = ((terms - self.centre) * self.weights) @ self.axes
        z[~terms.any(axis=1)] = 0
        norm = np.linalg.norm(z, axis=1, keepdims=True)
        return np.divide(z, norm, out=np.zeros_like(z), where=norm > 0)

    def scores(self, terms: np.ndarray, neighbours: int, power: float) -> np.ndarray:
        """Share of label 1 among the nearest neighbours, weighted by similarity to a power."""
        if not len(self.labels):
            return np.full(len(terms), self.prior)
        near = self.latent(terms) @ self.vectors.T
        k = min(neighbours, near.shape[1])
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, best, axis=1), 0) ** power
        total = weight.sum(axis=1)
        vote = (weight * self.labels[best]).sum(axis=1)
        return np.clip(np.where(total > 0, vote / np.where(total > 0, total, 1), self.prior), 0, 1)


def fit_terms(terms: np.ndarray, labels: np.ndarray, axes: int = AXES) -> Model:
    """Term weights and latent axes from the sample's term matrix (a randomised decomposition)."""
    if not len(labels):
        return Model(np.zeros(TERMS), np.ones(TERMS), np.zeros((TERMS, 1)), np.zeros((0, 1)), labels, 0.5)
    centre = terms.mean(axis=0)
    weights = 1 / (terms.std(axis=0) + 0.01)
    weights[:_TRIGRAMS] *= np.sqrt(1 / _TRIGRAMS)
    weights[_TRIGRAMS:-_EXTRA] *= np.sqrt(1 / _SHAPES)
    weights[-_EXTRA:] *= np.sqrt(1 / 8)
    x = (terms - centre) * weights
    basis = np.random.default_rng(3).standard_normal((x.shape[1], min(axes + 16, *x.shape)))
    for _ in range(4):
        basis = np.linalg.qr(x.T @ (x @ np.linalg.qr(basis)[0]))[0]
    _, _, right = np.linalg.svd(x @ basis, full_matrices=False)
    model = Model(centre, weights, basis @ right[:axes].T, np.zeros((0, 1)), labels.astype(float), float(labels.mean()))
    model.vectors = model.latent(terms)
    return model


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def training_sample(labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> DataFrame:
    """At most ``per_label`` ids of each label, chosen by a hash of the id, never a held-out one."""
    usable = labels.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max("quality").alias("label"))
    pick = lambda label: usable.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
    return pick(0).unionByName(pick(1))


def _terms(texts: pa.Array):
    return [[term_counts(t).astype(np.float32).tobytes() for t in texts.to_pylist()]]


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", per_label: int = SAMPLE_PER_LABEL, axes: int = AXES) -> Model:
    """The model of a bounded sample; at most 2 * per_label term vectors of fixed size reach the driver.

    A document votes once: of an id's rows, the one whose text has the smallest digest is learned from.
    """
    # The sample has a fixed bound, which is what makes the broadcast safe.
    sample = docs.select("doc_id", F.col(f"`{text}`").alias("text")).join(F.broadcast(training_sample(labels, per_label)), "doc_id")
    # Equal texts of an id are one; of different ones only the digests meet, and one text is left per id.
    one = sample.groupBy("doc_id", "label").agg(F.min_by("text", F.sha2(F.coalesce("text", F.lit("")), 256)).alias("text"))
    rows = map_columns(one, ["text"], "terms binary", _terms, keep=["doc_id", "label"]).collect()
    rows.sort(key=lambda r: (r.doc_id, bytes(r.terms)))
    terms = np.array([np.frombuffer(r.terms, np.float32) for r in rows], float).reshape(len(rows), TERMS)
    return fit_terms(terms, np.array([r.label for r in rows], float), axes)


def score(
    docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD,
    neighbours: int = NEIGHBOURS, power: float = POWER, keep=None,
) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` to every row.

    A text without terms (null, empty, fewer than three bytes and no word) gets the share of
    label 1 in the sample. Repeated rows get the same score; columns named like an output are
    replaced. Without any labelled row every score is 0.5.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: sample bound x axes

    def run(texts: pa.Array):
        terms = np.array([term_counts(t) for t in texts.to_pylist()]).reshape(len(texts), TERMS)
        values = sent.value.scores(terms, neighbours, power)
        return [pa.array(values), pa.array((values >= threshold).astype(np.int32))]

    return map_columns(docs, [text], "score double, predicted int", run, keep)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``docs``."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels), keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
