"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

import chatlens

# Functions of this package travel with the job, so workers need no installed copy.
cloudpickle.register_pickle_by_value(chatlens)

# White space between words: the six ASCII characters. Everything else belongs to a word.
BLANK = r"[\x20\x09-\x0D]"
BLANKS = " \t\n\x0b\x0c\r"

_PIECE = 1 << 22
_ROWS = 500  # rows handled at a time, which bounds the memory of a task
_MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, f"{BLANK}+"))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(rf"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def map_columns(
    df: DataFrame,
    inputs: Sequence[str],
    outputs: str,
    function: Callable[..., Sequence],
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add columns that ``function`` computes from Arrow batches of ``inputs``.

    ``function`` gets one Arrow array per input and returns one array or list
    per output column (``outputs`` is a DDL schema). The columns in ``keep``
    (all of them by default) pass through unchanged; an output whose name
    already exists replaces that column.
    """
    added = T.StructType.fromDDL(outputs)
    names = set(added.fieldNames())
    passed = [f for f in df.schema.fields if f.name not in names and (keep is None or f.name in keep)]
    carried = [f.name for f in passed]
    prefix = "_in"
    while any(c.startswith(prefix) for c in carried):
        prefix = "_" + prefix
    at_input = [f"{prefix}{i}" for i in range(len(inputs))]
    schema = T.StructType([*passed, *added.fields])
    source = df.select(*[F.col(f"`{c}`") for c in carried], *[F.col(f"`{c}`").alias(a) for c, a in zip(inputs, at_input)])
    arrow_out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, _ROWS) for b in batches for i in range(0, b.num_rows, _ROWS)):
            got = function(*[batch.column(len(carried) + i) for i in range(len(at_input))])
            columns = [batch.column(i) for i in range(len(carried))]
            for field, values in zip(list(arrow_out)[len(carried):], got):
                columns.append(values if isinstance(values, pa.Array) else pa.array(values, field.type))
            yield pa.RecordBatch.from_arrays(columns, names=arrow_out.names)

    return source.mapInArrow(run, schema)


class _WordHashes(dict):
    """64-bit hash of a word; remembers the words seen lately, so memory stays bounded."""

    limit = 1 << 18

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


_seen = _WordHashes()


def word_pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text, in lists of a few MB, so that a very long text fits in memory."""
    start = 0
    while start < len(raw):
        end = start + _PIECE
        while end < len(raw) and raw[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield raw[start:end].split()
        start = end


def word_hashes(raw: bytes) -> np.ndarray:
    """One unsigned 64-bit hash per word."""
    parts = [np.fromiter(map(_seen.__getitem__, piece), np.uint64, len(piece)) for piece in word_pieces(raw)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint64)


def mixed(values: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that every bit depends on every input bit."""
    values = values.copy()
    values ^= values >> np.uint64(30)
    values *= np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(31)
    return values


def window_hashes(hashes: np.ndarray, width: int, seed: int = 1) -> np.ndarray:
    """Hash of each run of ``width`` consecutive words (empty if there are fewer words)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    factor = np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & _MASK | 1)
    total = np.full(n, np.uint64(seed))
    for k in range(width):
        total *= factor
        total += hashes[k:k + n]
    return mixed(total)
