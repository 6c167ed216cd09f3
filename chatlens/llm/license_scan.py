"""Licence notices and identifier tags in texts.

One pass of an Aho-Corasick automaton over the normalised words of a text finds notice phrases
and identifier tags together, however many there are. Behind a tag stands a licence expression,
such as ``(MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0``: a shunting-yard
parser turns it into reverse Polish order (``with`` binds tighter than ``and``, ``and`` than
``or``), and evaluating that gives its licences, its canonical form and how much it demands of a
user: an ``or`` takes the lighter side, an ``and`` the heavier one, a ``with`` lightens the licence before it.
"""

from __future__ import annotations

import functools
import re
from collections import deque

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.llm.texts import map_columns

# --- fixed values ----------------------------------------------------------------

# Phrases that every scan looks for, with their labels.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Further phrases of licence notices, in the words of a normalised text.
NOTICE_PHRASES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "released under the mit license": "mit",
    "opensource org licenses mit": "mit",
    "apache org licenses license 2 0": "apache-2",
    "apache license 2 0": "apache-2",
    "gnu general public license": "gpl",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license v2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu general public license v3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu lesser general public license version 2 1": "lgpl-2.1",
    "gnu lesser general public license version 3": "lgpl-3",
    "gnu affero general public license": "agpl",
    "gnu affero general public license version 3": "agpl-3",
    "mozilla public license": "mpl",
    "mozilla public license version 2 0": "mpl-2",
    "mozilla public license v 2 0": "mpl-2",
    "eclipse public license": "epl",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "bsd 2 clause license": "bsd-2-clause",
    "bsd 3 clause license": "bsd-3-clause",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "under the isc license": "isc",
    "boost software license version 1 0": "bsl-1",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "sil open font license": "ofl",
    "open data commons open database license": "odbl",
    "cc0 1 0 universal": "cc0",
    "creativecommons org publicdomain zero 1 0": "cc0",
    "creative commons attribution 4 0 international": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution noncommercial sharealike": "cc-by-nc-sa",
    "creative commons attribution noncommercial noderivatives": "cc-by-nc-nd",
    "creative commons attribution noncommercial noderivs": "cc-by-nc-nd",
    "creativecommons org licenses by 4 0": "cc-by",
    "creativecommons org licenses by sa": "cc-by-sa",
    "creativecommons org licenses by nc": "cc-by-nc",
    "creativecommons org licenses by nc sa": "cc-by-nc-sa",
    "creativecommons org licenses by nc nd": "cc-by-nc-nd",
    "cc by 4 0": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "all rights reserved": "all-rights-reserved",
}

# Words of a tag; a licence expression follows. Behind the first an unknown name counts too.
STRICT_TAG = "spdx license identifier"
TAGS = (STRICT_TAG, "license", "licence", "license expression", "licensed under", "released under", "distributed under", "available under")

# Families of licence names and how much they demand (0 nothing, 1 no free use).
DEMANDS = {
    "0bsd": 0.1, "agpl": 0.9, "all": 1.0, "apache": 0.2, "artistic": 0.4, "bsd": 0.2, "bsl": 0.2, "cc0": 0.1, "cddl": 0.5,
    "epl": 0.5, "eupl": 0.6, "gpl": 0.7, "isc": 0.2, "lgpl": 0.5, "mit": 0.2, "mpl": 0.5, "ncsa": 0.2, "odbl": 0.6, "ofl": 0.3,
    "postgresql": 0.2, "psf": 0.2, "python": 0.2, "unlicense": 0.1, "wtfpl": 0.1, "zlib": 0.2,
}
CREATIVE = {"cc-by": 0.3, "cc-by-nc": 0.9, "cc-by-nc-nd": 0.9, "cc-by-nc-sa": 0.9, "cc-by-nd": 0.8, "cc-by-sa": 0.6}
# Families whose bare name is a licence.
PLAIN_NAMES = ("0bsd", "isc", "mit", "ncsa", "postgresql", "unlicense", "wtfpl", "zlib")
OPERATORS = {"or": 1, "and": 2, "with": 3}

# How strongly a find speaks for licence terms.
WEIGHTS = {"base": 0.8, "notice": 0.7, "expression": 0.9}
UNKNOWN = 1.0  # demand of a licence of no known family
LIGHTER = 0.2  # what an exception takes off

# --- expressions -----------------------------------------------------------------

# Letters in lower case and digits; every byte beyond ASCII belongs to a word too.
_NORMAL = bytes(
    c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_WORD = re.compile(rb"[^ ]+")
_TOKEN = re.compile(r"[ \t]*([()]|[A-Za-z0-9](?:[A-Za-z0-9.+:-]*[A-Za-z0-9+])?)")
_MARK = re.compile(r"[ \t]*[:=][ \t]*[\"']?")
_BLANK = re.compile(r"[ \t]+(?:the[ \t]+)?", re.IGNORECASE)
_VERSION = re.compile(r"-\d+(\.\d+)*$")


def label_of(name: str) -> str:
    """The label of a licence name: ``GPL-3.0-or-later`` is gpl-3, ``CC-BY-SA-4.0`` is cc-by-sa."""
    label = name.lower().removesuffix("+")
    for ending in ("-only", "-or-later"):
        label = label.removesuffix(ending)
    if label.startswith(("cc-by", "cc0")):
        return _VERSION.sub("", label)
    return label.removesuffix(".0")


def demand_of(label: str) -> float | None:
    """How much a licence demands; None for a name of no known family."""
    return CREATIVE.get(label, DEMANDS.get(label.split("-")[0]))


def is_known(name: str) -> bool:
    """Whether a word is a licence name by itself: most families need a version or variant."""
    label = label_of(name)
    return label in CREATIVE or label in PLAIN_NAMES or ("-" in label and label.split("-")[0] in DEMANDS)


def expression_tokens(text: str, start: int, any_name: bool) -> list[tuple[str, int]]:
    """The longest run of tokens from ``start`` that is a licence expression, with their ends.

    Names and operators alternate, a closing bracket needs an open one, and ``with`` stands between
    a single licence and an exception. Unless ``any_name``, licences must be known ones. So prose
    behind an expression ends it; an operator or bracket that is left over at the end is cut off.
    """
    out: list[tuple[str, int]] = []
    depth, whole, wants_name = 0, 0, True
    while found := _TOKEN.match(text, start):
        token, start = found[1], found.end()
        operator = token.lower() if token.lower() in OPERATORS else None
        last = out[-1][0].lower() if out else ""
        if token == "(":
            if not wants_name or last == "with":
                break
            depth += 1
        elif token == ")":
            if wants_name or not depth:
                break
            depth -= 1
        elif operator:
            excepted = len(out) > 1 and out[-2][0].lower() == "with"
            if wants_name or (operator == "with" and (last == ")" or excepted)):
                break
            wants_name = True
        else:
            right = "exception" in token.lower() if last == "with" else any_name or is_known(token)
            if not wants_name or not right:
                break
            wants_name = False
        out.append((token, start))
        if not depth and not wants_name:
            whole = len(out)
    return out[:whole]


def to_postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard: the tokens in reverse Polish order, operators in lower case; None if unbalanced."""
    output: list[str] = []
    waiting: list[str] = []
    wants_name = True
    for token in tokens:
        operator = token.lower()
        if token == "(":
            if not wants_name:
                return None
            waiting.append(token)
        elif token == ")":
            if wants_name:
                return None
            while waiting and waiting[-1] != "(":
                output.append(waiting.pop())
            if not waiting:
                return None
            waiting.pop()
        elif operator in OPERATORS:
            if wants_name:
                return None
            while waiting and waiting[-1] != "(" and OPERATORS[waiting[-1]] >= OPERATORS[operator]:
                output.append(waiting.pop())
            waiting.append(operator)
            wants_name = True
        else:
            if not wants_name:
                return None
            output.append(token)
            wants_name = False
    if wants_name or "(" in waiting:
        return None
    return output + waiting[::-1]


def evaluate(postfix: list[str]) -> tuple[list[str], float, str]:
    """Labels, demand and canonical form (with the fewest brackets) of an expression."""
    stack: list[tuple[float, deque[str], int]] = []  # demand, pieces of the canonical form, binding
    labels = set()
    for at, token in enumerate(postfix):
        if token not in OPERATORS:
            # The right side of a ``with`` is no licence; it stands just before its operator.
            excepts = at + 1 < len(postfix) and postfix[at + 1] == "with"
            label = token.lower() if excepts else label_of(token)
            demand = demand_of(label)
            stack.append((UNKNOWN if demand is None else demand, deque([label]), len(OPERATORS) + 1))
            if not excepts:
                labels.add(label)
            continue
        right, left = stack.pop(), stack.pop()
        binding = OPERATORS[token]
        for _, pieces, own in (left, right):
            if own < binding:
                pieces.appendleft("(")
                pieces.append(")")
        # The shorter side moves to the longer one, so long expressions stay cheap.
        one, other = left[1], right[1]
        if len(one) >= len(other):
            one.append(f" {token} ")
            one.extend(other)
            pieces = one
        else:
            other.appendleft(f" {token} ")
            other.extendleft(reversed(one))
            pieces = other
        if token == "with":
            demand = max(0.0, round(left[0] - LIGHTER, 6))
        else:
            demand = min(left[0], right[0]) if token == "or" else max(left[0], right[0])
        stack.append((demand, pieces, binding))
    return sorted(labels), stack[0][0], "".join(stack[0][1])


def expression_at(text: str, start: int, any_name: bool) -> tuple[list[str], float, str, int] | None:
    """Labels, demand, canonical form and end of the licence expression at ``start``, if there is one."""
    tokens = expression_tokens(text, start, any_name)
    postfix = to_postfix([t for t, _ in tokens]) if tokens else None
    return (*evaluate(postfix), tokens[-1][1]) if postfix else None


# --- scan ------------------------------------------------------------------------

@functools.lru_cache
def _automaton(base: tuple, notices: tuple, tags: tuple) -> ahocorasick.Automaton:
    phrases: dict[str, list[tuple[str, str]]] = {}
    for kind, entries in (("base", base), ("notice", notices), ("tag", tuple((t, t) for t in tags))):
        for phrase, label in entries:
            phrases.setdefault(f" {phrase} ", []).append((kind, label))
    machine = ahocorasick.Automaton()
    for phrase, found in phrases.items():
        machine.add_word(phrase, (len(phrase), len(phrase.split()), found))
    machine.make_automaton()
    return machine


def scan(text: str, machine: ahocorasick.Automaton) -> tuple[int, list[dict]]:
    """Number of words and the finds of one text: kind, label, first word, span, expression, demand."""
    raw = text.encode("utf-8", "replace")
    normal = raw.translate(_NORMAL)
    words = normal.split()
    joined = f" {b' '.join(words).decode()} "
    hits = sorted((last + 1 - length, size, found) for last, (length, size, found) in machine.iter(joined))
    if not hits:
        return len(words), []
    places, word, counted = [], 0, 0
    for start, size, found in hits:
        word += joined.count(" ", counted, start)
        counted = start
        places += [(word, -size, kind, label) for kind, label in found]
    spans = [m.span() for m in _WORD.finditer(normal)]
    # Characters before each byte.
    before = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    finds, held = [], 0
    for first, size, kind, label in sorted(places):
        behind = first - size
        start, end = int(before[spans[first][0]]), int(before[spans[behind - 1][1]])
        entry = {"kind": kind, "label": label, "word": first, "start": start, "end": end, "expression": None, "demand": demand_of(label)}
        if kind == "base":
            finds.append(entry)
        elif kind == "notice":
            # A phrase within a longer one says less than that and is left out.
            if behind > held:
                held = behind
                finds.append(entry)
        else:
            gap = _MARK.match(text, end) or (_BLANK.match(text, end) if words[behind - 1] == b"under" else None)
            got = expression_at(text, gap.end(), label == STRICT_TAG) if gap else None
            for name in got[0] if got else ():
                finds.append(entry | {"kind": "expression", "label": name, "end": got[3], "expression": got[2], "demand": got[1]})
    return len(words), finds


_OUT = ("n_words long, notices array<struct<kind:string,label:string,word:long,start:long,end:long,expression:string,demand:double>>, "
        "score double")


def _scan(base: tuple, notices: tuple, tags: tuple):
    def run(texts: pa.Array):
        machine = _automaton(base, notices, tags)
        counts, finds, scores = [], [], []
        for text in texts.to_pylist():
            n, found = scan(text or "", machine)
            doubt = 1.0
            for kind, _ in sorted({(f["kind"], f["label"]) for f in found}):
                doubt *= 1 - WEIGHTS[kind]
            counts.append(n), finds.append(found), scores.append(round(1 - doubt, 9))
        return [counts, finds, scores]

    return run


def find_licenses(docs: DataFrame, text: str = "text", notices: dict[str, str] = NOTICE_PHRASES, tags=TAGS, keep=None) -> DataFrame:
    """Add n_words, notices and score.

    A notice has its kind (``base``, ``notice`` or ``expression``), label, first word, span in
    characters and, for an expression, canonical form and demand. Base phrases count at every
    place; other phrases only outside of longer ones. The score, 0 to 1, grows with each distinct
    find: 1 - product of (1 - weight of the kind); 0 without any. Null, empty and blank texts have
    no words and no notices. Repeated rows get the same answer. Columns named like an output are
    replaced, all others in ``keep`` pass through. An empty table gives an empty one.
    """
    run = _scan(tuple(BASE_PHRASES.items()), tuple(notices.items()), tuple(tags))
    return map_columns(docs, [text], _OUT, run, keep)


def digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, expressions, demand and score."""
    found = find_licenses(docs, text, keep=["doc_id"])
    base = F.filter("notices", lambda x: x["kind"] == "base")
    places = F.transform(base, lambda x: x["word"])
    listed = lambda finds, field: F.array_join(F.array_sort(F.array_distinct(F.transform(finds, lambda x: x[field]))), ",")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"), listed(base, "label").alias("base_labels"), listed(F.col("notices"), "label").alias("labels"),
        F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.transform("notices", lambda x: x["expression"])))), "; ").alias("expressions"),
        F.array_max(F.transform("notices", lambda x: x["demand"])).alias("demand"), "score")
