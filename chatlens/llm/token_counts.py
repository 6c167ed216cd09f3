"""Token counts of the sections of documents by offset-mapped attribution.

A document is encoded once and whole, because tokens depend on what stands around them. Each
token has a span of characters; sections are spans of characters too. The two sorted lists are
joined as intervals, and a token that crosses a boundary is allocated by an explicit rule:

* ``start``: to the section that holds its first character;
* ``majority``: to the section that holds most of its characters, the earlier one if equal;
* ``shares``: to each section in proportion to its characters.

A token that stands for a part of a character's bytes spans that character.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlens.llm.bpe import Codec, broadcast_vocabulary, codec_of
from chatlens.llm.texts import map_columns

RULES = ("start", "majority", "shares")


def token_spans(codec: Codec, text: str) -> tuple[np.ndarray, np.ndarray]:
    """First character and end (exclusive) of each token of ``text``."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    lengths = codec.lengths[codec.encode(text)]
    ends = np.cumsum(lengths)
    if len(raw) == len(text):
        return ends - lengths, ends
    number = np.cumsum((raw & 0xC0) != 0x80) - 1  # character of each byte
    return number[ends - lengths], number[ends - 1] + 1


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens per section and the number of tokens that cross a boundary.

    ``bounds`` are the ends of sections that follow each other from character 0.
    """
    first = np.searchsorted(bounds, starts, side="right")
    last = np.searchsorted(bounds, ends - 1, side="right")
    crossing = np.flatnonzero(first != last)
    total = np.bincount(first, minlength=len(bounds)).astype(float)
    if rule != "start":
        for t in crossing:
            sections = np.arange(first[t], last[t] + 1)
            left = np.maximum(np.append(0, bounds)[sections], starts[t])
            part = np.minimum(bounds[sections], ends[t]) - left
            total[first[t]] -= 1
            if rule == "majority":
                total[sections[np.argmax(part)]] += 1
            else:
                total[sections] += part / part.sum()
    return total, len(crossing)


def line_sections(text: str) -> list[str]:
    """The lines of a text, each with its line break; an empty text has no sections."""
    parts = text.split("\n")
    lines = [p + "\n" for p in parts[:-1]] + [parts[-1]]
    return lines if lines[-1] else lines[:-1]


def _count(vocabulary, rule: str, cut):
    def run(*columns: pa.Array):
        codec = codec_of(vocabulary)
        tokens, sections, crossed = [], [], []
        for values in zip(*[c.to_pylist() for c in columns]):
            parts = cut(values)
            text = "".join(parts)
            if not text:
                tokens.append(0), sections.append([0.0] * len(parts)), crossed.append(0)
                continue
            bounds = np.array(list(accumulate(map(len, parts))))
            starts, ends = token_spans(codec, text)
            got, crossing = attribute(starts, ends, bounds, rule)
            tokens.append(len(starts)), sections.append(got.tolist()), crossed.append(crossing)
        return [tokens, sections, crossed]

    return run


_OUT = "n_tokens long, section_tokens array<double>, n_crossing long"


def count_by_line(docs: DataFrame, path: str, text: str = "text", rule: str = "start", keep=None) -> DataFrame:
    """Add n_tokens, section_tokens (one entry per line) and n_crossing.

    Lines keep their line break. Null and empty texts have no tokens and no sections. Repeated
    rows get the same answer; columns named like an output are replaced.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    vocabulary = broadcast_vocabulary(docs.sparkSession, path)
    return map_columns(docs, [text], _OUT, _count(vocabulary, rule, lambda v: line_sections(v[0] or "")), keep)


def count_by_field(docs: DataFrame, path: str, fields: list[str], joint: str = "\n", rule: str = "start", keep=None) -> DataFrame:
    """The same for a document made of several string fields, in order, joined by ``joint``.

    The joint belongs to the field before it. A null field is an empty one: it takes part with its
    joint, so there is one entry per field.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    vocabulary = broadcast_vocabulary(docs.sparkSession, path)

    def cut(values: tuple) -> list[str]:
        return [(v or "") + (joint if i < len(values) - 1 else "") for i, v in enumerate(values)]

    return map_columns(docs, fields, _OUT, _count(vocabulary, rule, cut), keep)


def fields_and_lines(docs: DataFrame, path: str, rule: str = "start") -> DataFrame:
    """Token counts of ``documents`` as one string: the source line, the language line, then the text.

    Per document: all tokens, those of each field, those of each line of the text, and how many
    tokens cross a boundary.
    """
    vocabulary = broadcast_vocabulary(docs.sparkSession, path)

    def cut(values: tuple) -> list[str]:
        source, lang, text = (v or "" for v in values)
        return [source + "\n", lang + "\n", *line_sections(text)]

    counted = map_columns(
        docs.select("doc_id", "source", "lang", "text"), ["source", "lang", "text"], _OUT, _count(vocabulary, rule, cut), ["doc_id"])
    whole = lambda c: F.round(c).cast("long")
    s = F.col("section_tokens")
    lines: Column = F.slice(s, 3, F.greatest(F.size(s) - 2, F.lit(0)))
    return counted.select(
        "doc_id", "n_tokens", whole(F.get(s, F.lit(0))).alias("source_tokens"), whole(F.get(s, F.lit(1))).alias("lang_tokens"),
        whole(F.aggregate(lines, F.lit(0.0), lambda a, x: a + x)).alias("text_tokens"),
        F.size(lines).cast("long").alias("n_lines"),
        F.array_join(F.transform(lines, lambda x: whole(x).cast("string")), ",").alias("line_tokens"), "n_crossing",
    )
