"""Byte-level BPE: encode whole texts and decode the ids again.

A text is cut into pre-tokens by the byte-level pattern. Each pre-token starts as a
doubly linked list of byte symbols. A heap holds the possible merges as (rank,
position, left, right); the lowest rank, and of equal ranks the leftmost, is applied
first. An entry whose symbols have changed meanwhile is stale and skipped. Decoding
concatenates the vocabulary strings and turns their characters back into bytes.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlens.llm.texts import map_columns

# The pre-token pattern of byte-level BPE vocabularies.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# A single space before a character that is certainly not white space starts a new
# pre-token, so a text may be cut there and its parts be encoded one by one.
_CUT = re.compile(" (?=[!-~¡-ᙿ])")
_PRE = regex.compile(PRE_TOKEN)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 characters stand for themselves; the other bytes get the
    characters from U+0100 on, in order.
    """
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


def read_vocabulary(path: str) -> dict:
    """Vocabulary, merges and added tokens of a ``tokenizers`` JSON file, with ids only."""
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    vocabulary = data["model"]["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
    added = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
    strings = {i: s for s, i in vocabulary.items()} | {i: s for s, i in added.items()}
    return {
        "strings": [strings.get(i, "") for i in range(max(strings) + 1)],
        "bytes": [vocabulary[c] for c in byte_characters()],
        "merges": {(vocabulary[a], vocabulary[b]): (rank, vocabulary[a + b]) for rank, (a, b) in enumerate(merges)},
        "added": added,
    }


def merge_symbols(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Apply the merges to one pre-token."""
    n = len(symbols)
    if n < 2:
        return symbols
    find, push, pop = merges.get, heapq.heappush, heapq.heappop
    heap = []
    left = symbols[0]
    for i in range(1, n):
        right = symbols[i]
        found = find((left, right))
        if found:
            heap.append((found[0], i - 1, left, right, found[1]))
        left = right
    if not heap:
        return symbols
    symbols = [*symbols, -1]  # the last one ends the list and takes part in no merge
    before, after = list(range(-1, n)), list(range(1, n + 2))
    heapq.heapify(heap)
    while heap:
        _, i, left, right, merged = pop(heap)
        j = after[i]
        if symbols[i] != left or symbols[j] != right:
            continue  # stale: one of the two symbols has been merged since
        symbols[i], symbols[j] = merged, -1
        after[i] = k = after[j]
        before[k] = i
        found = find((merged, symbols[k]))
        if found:
            push(heap, (found[0], i, merged, symbols[k], found[1]))
        h = before[i]
        if h >= 0:
            found = find((symbols[h], merged))
            if found:
                push(heap, (found[0], h, symbols[h], merged, found[1]))
    return [s for s in symbols if s >= 0]


class _Lately(dict):
    """A memory of computed values with a bounded size: what was not used for long is forgotten."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class Codec:
    """Encoder and decoder of one vocabulary. Ids travel as little-endian 32-bit integers."""

    def __init__(self, vocabulary: dict, limit: int = 150_000):
        self.merges, self.first, self.added = vocabulary["merges"], vocabulary["bytes"], vocabulary["added"]
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        of_character = {c: b for b, c in enumerate(byte_characters())}
        self.strings = [
            bytes(of_character[c] for c in s) if all(c in of_character for c in s) else s.encode()
            for s in vocabulary["strings"]
        ]
        self.lengths = np.array([len(s) for s in self.strings], np.int64)  # in bytes
        self.of_pre_token = _Lately(self._pre_token, limit)
        self.of_part = _Lately(self._part, limit)
        self.of_word = _Lately(lambda word: self._part(" " + word), limit)  # a part without the space before it

    def _pre_token(self, text: str) -> bytes:
        ids = merge_symbols([self.first[b] for b in text.encode()], self.merges)
        return struct.pack(f"<{len(ids)}i", *ids)

    def _part(self, text: str) -> bytes:
        return b"".join([self.of_pre_token[p] for p in _PRE.findall(text)])

    def parts(self, text: str) -> list[str]:
        """Cut a text into parts that can be encoded one by one; added tokens are parts of their own."""
        pieces = [text]
        if self.split_added and any(a in text for a in self.added):
            pieces = [p for p in self.split_added.split(text) if p]
        out: list[str] = []
        for piece in pieces:
            if piece in self.added:
                out.append(piece)
                continue
            first, *rest = _CUT.split(piece)
            if first:
                out.append(first)
            out += [" " + p for p in rest]
        return out

    def part(self, text: str) -> bytes:
        return struct.pack("<i", self.added[text]) if text in self.added else self.of_part[text]

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text."""
        if self.added and any(a in text for a in self.added):
            return np.frombuffer(b"".join(map(self.part, self.parts(text))), "<i4")
        first, *words = _CUT.split(text)
        return np.frombuffer(b"".join([self.of_part[first] if first else b"", *map(self.of_word.__getitem__, words)]), "<i4")

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; ids outside the vocabulary stand for nothing, broken UTF-8 for U+FFFD."""
        known = len(self.strings)
        return b"".join([self.strings[i] for i in ids if i is not None and 0 <= i < known]).decode("utf-8", "replace")

    def decode_own(self, ids: np.ndarray) -> str:
        """:meth:`decode` of ids that :meth:`encode` gave, which are all in the vocabulary."""
        return b"".join(map(self.strings.__getitem__, ids.tolist())).decode("utf-8", "replace")


def codec_of(vocabulary: Broadcast) -> Codec:
    """The codec of this worker process, kept with the broadcast value it is made from."""
    value = vocabulary.value
    if "codec" not in value:
        value["codec"] = Codec(value)
    return value["codec"]


def broadcast_vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """Read the file once on the driver and send it to the executors; a vocabulary has a fixed size."""
    return spark.sparkContext.broadcast(read_vocabulary(path))


def _id_lists(codec: Codec, texts: list[str | None]) -> tuple[pa.Array, list[np.ndarray]]:
    arrays = [codec.encode(t or "") for t in texts]
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate([np.empty(0, np.int32), *arrays])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())), arrays


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", keep=None) -> DataFrame:
    """Add the token ids of ``text`` as array<int>.

    Null and empty texts have no ids. Repeated rows stay as they are, other columns
    pass through, and a column named like the output is replaced.
    """
    vocabulary = broadcast_vocabulary(docs.sparkSession, path)

    def run(texts: pa.Array):
        return [_id_lists(codec_of(vocabulary), texts.to_pylist())[0]]

    return map_columns(docs, [text], f"`{ids}` array<int>", run, keep)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded", keep=None) -> DataFrame:
    """Add the text of an array of ids; null ids give the empty text."""
    vocabulary = broadcast_vocabulary(df.sparkSession, path)

    def run(lists: pa.Array):
        codec = codec_of(vocabulary)
        return [[codec.decode(x or ()) for x in lists.to_pylist()]]

    return map_columns(df, [ids], f"`{text}` string", run, keep)


def encode_and_decode(docs: DataFrame, path: str, text: str = "text", keep=None) -> DataFrame:
    """Add ``ids`` and ``decoded`` in one pass, so that a text enters a Python worker once."""
    vocabulary = broadcast_vocabulary(docs.sparkSession, path)

    def run(texts: pa.Array):
        codec = codec_of(vocabulary)
        lists, arrays = _id_lists(codec, texts.to_pylist())
        return [lists, [codec.decode_own(a) for a in arrays]]

    return map_columns(docs, [text], "ids array<int>, decoded string", run, keep)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of ids and decoded text of ``documents``."""
    coded = encode_and_decode(docs.select("doc_id", "text"), path, keep=["doc_id"])
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
