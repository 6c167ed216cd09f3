"""Words of Arrow texts, cut at the same characters as by the patterns of Spark."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from chatlens import fixed_values as fv

CODE_POINTS = 0x110000
_BLOCK = 4096


@functools.lru_cache(maxsize=1)
def word_characters(spark: SparkSession) -> bytes:
    """One bit per code point: whether the session's own regular expressions take it as part of a word."""
    blocks = [(start, "".join(chr(c) for c in range(start, start + _BLOCK) if not 0xD800 <= c < 0xE000)) for start in range(0, CODE_POINTS, _BLOCK)]
    kept = spark.createDataFrame(blocks, "start int, characters string").select(F.regexp_replace("characters", f"[^{fv.WORD_CLASS}]+", ""))
    found = np.zeros(CODE_POINTS, bool)
    found[[ord(c) for row in kept.collect() for c in row[0]]] = True
    return np.packbits(found).tobytes()


class WordSplitter:
    """Lists of the words of two or more characters that are no stopwords, from an array of lower-cased texts."""

    def __init__(self, characters: bytes, stopwords: list[str]):
        self.inside = np.unpackbits(np.frombuffer(characters, np.uint8)).astype(bool)
        self.ascii = np.concatenate([self.inside[:128], np.zeros(128, bool)])
        self.stopwords = pa.array(stopwords, pa.string())

    def _in_words(self, data: np.ndarray) -> np.ndarray:
        """Which bytes of a UTF-8 text belong to characters of words."""
        inside = self.ascii[data]
        lead = np.flatnonzero(data >= 0xC0)
        for size, low, high, bits in ((2, 0xC0, 0xE0, 0x1F), (3, 0xE0, 0xF0, 0x0F), (4, 0xF0, 0xF8, 0x07)):
            at = lead[(data[lead] >= low) & (data[lead] < high)]
            code = (data[at] & bits).astype(np.int32)
            for k in range(1, size):
                code = code << 6 | (data[at + k] & 0x3F)
            at = at[self.inside[code]]
            for k in range(size):
                inside[at + k] = True
        return inside

    def __call__(self, text: pa.Array) -> pa.ListArray:
        text = pc.fill_null(text.cast(pa.string()), "")
        _, places, content = text.buffers()
        rows = np.frombuffer(places, np.int32)[text.offset:text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int32)
        data = np.frombuffer(content or b"", np.uint8)[rows[0]:rows[-1]]
        rows = rows - rows[0]
        inside = self._in_words(data)
        # A word starts and ends at the border of its row, too.
        before, after = np.concatenate([[False], inside])[:-1], np.concatenate([inside, [False]])[1:]
        before[rows[:-1][rows[:-1] < len(data)]] = False
        after[rows[1:][rows[1:] > 0] - 1] = False
        start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        first = data[start]
        width = 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0).astype(np.int64)
        short = end - start == width
        for k in range(4):
            inside[start[short & (width > k)] + k] = False
        start, end = start[~short], end[~short]
        places = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
        words = pa.StringArray.from_buffers(len(start), pa.py_buffer(places), pa.py_buffer(data[inside]))
        kept = pc.invert(pc.is_in(words, value_set=self.stopwords))
        upto = np.concatenate([[0], np.cumsum(kept.to_numpy(zero_copy_only=False))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(upto[np.searchsorted(start, rows)]), words.filter(kept))
