"""Periodic runs: stretches of a text that repeat the same words with a fixed period.

A run is a stretch of consecutive words with smallest period q and at least ``max(least, turns * q)``
words that no neighbouring word extends keeping the period. Each text is searched by itself:

1. Recursive frequency splitting. Every word of a run occurs at least ``turns`` times in it. So a
   word that is rarer than that within its segment cannot belong to a run of the segment and
   splits it. The parts are counted anew and split again until nothing changes; parts shorter than
   ``least`` are dropped. Ordinary prose is gone after a few rounds.
2. Lag scan of the surviving segments. For a small lag all words that far apart are compared. For
   a larger lag q, a run holds two whole neighbouring blocks of q words that begin at a multiple
   of q; their hashes are compared for all lags and multiples, n log n comparisons in all. Where
   they agree the words themselves decide, and the stretch is extended word by word.

Nothing is cut off: periods go up to a third of a segment and texts may be of any length.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.llm.texts import map_columns, mixed

LEAST = 24  # words in the shortest run
TURNS = 3  # periods in the shortest run
DIRECT = 16  # lags up to which all words are compared
_FACTOR = 0x9E3779B97F4A7C15  # odd


def surviving_segments(ids: np.ndarray, least: int = LEAST, turns: int = TURNS) -> list[tuple[int, int]]:
    """The parts (start, end) that remain after splitting at words rarer than ``turns`` in their part.

    All parts of a round are counted together; a part that no word splits is done.
    """
    done: list[tuple[int, int]] = []
    starts, ends = np.array([0]), np.array([len(ids)])
    while True:
        long = ends - starts >= least
        starts, ends = starts[long], ends[long]
        if not len(starts):
            return sorted(done)
        sizes = ends - starts
        part = np.repeat(np.arange(len(starts)), sizes)
        at = np.arange(len(part)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
        _, inverse, counts = np.unique(part * (int(ids.max()) + 1) + ids[at], return_inverse=True, return_counts=True)
        common = counts[inverse] >= turns
        whole = np.ones(len(starts), bool)
        whole[part[~common]] = False
        done += list(zip(starts[whole].tolist(), ends[whole].tolist()))
        keep = common & ~whole[part]
        at, part = at[keep], part[keep]
        if not len(at):
            return sorted(done)
        cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(part) != 0)) + 1
        starts, ends = at[np.append(0, cut)], at[np.append(cut - 1, len(at) - 1)] + 1


def _direct_runs(ids: np.ndarray, lag: int, least: int, turns: int) -> Iterator[tuple[int, int]]:
    """Stretches (start, end) with this period, by comparing all words."""
    same = np.concatenate(([False], ids[:-lag] == ids[lag:], [False])).astype(np.int8)
    steps = np.diff(same)
    for start, end in zip(np.flatnonzero(steps == 1).tolist(), np.flatnonzero(steps == -1).tolist()):
        if end + lag - start >= max(least, turns * lag):
            yield start, end + lag


def _block_hits(ids: np.ndarray, first: int, last: int) -> dict[int, np.ndarray]:
    """For each lag of first..last the multiples x of it with equal hashes at x and x + lag (lag words each)."""
    n = len(ids)
    factor = np.full(n + 1, _FACTOR, np.uint64)
    factor[0] = 1
    with np.errstate(over="ignore"):
        power = np.cumprod(factor, dtype=np.uint64)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(ids.astype(np.uint64) + np.uint64(1)) * power[:n], dtype=np.uint64)))
        lags, places = [], []

        def compare(x: np.ndarray, lag: np.ndarray) -> None:
            same = (total[x + lag] - total[x]) * power[lag] == total[x + 2 * lag] - total[x + lag]
            lags.append(lag[same])
            places.append(x[same])

        # Small lags have many multiples, large ones few: go along whichever is longer.
        middle = min(last, max(first - 1, int(n ** 0.5)))
        for lag in range(first, middle + 1):
            x = np.arange(0, n - 2 * lag + 1, lag)
            compare(x, np.full(len(x), lag))
        turn = 0
        while (top := min(last, n // (turn + 2))) > middle:
            lag = np.arange(middle + 1, top + 1)
            compare(turn * lag, lag)
            turn += 1
    lag, x = np.concatenate(lags) if lags else np.empty(0, int), np.concatenate(places) if places else np.empty(0, int)
    order = np.lexsort((x, lag))
    lag, x = lag[order], x[order]
    cut = np.flatnonzero(np.diff(lag)) + 1
    return {int(part[0]): at for part, at in zip(np.split(lag, cut), np.split(x, cut)) if len(part)}


def _extended(ids: np.ndarray, x: int, lag: int) -> tuple[int, int] | None:
    """The stretch (start, end) with this period around the block at x; None if only the hashes agree."""
    def reach(left: np.ndarray, right: np.ndarray) -> int:
        step, at = 64, 0
        while at < len(left):
            differ = left[at:at + step] != right[at:at + step]
            if differ.any():
                return at + int(differ.argmax())
            at += step
            step *= 2
        return len(left)

    forward = reach(ids[x:len(ids) - lag], ids[x + lag:])
    if forward < lag:
        return None
    back = reach(ids[:x][::-1], ids[lag:x + lag][::-1])
    return x - back, x + forward + lag


class _Found:
    """Runs by period, for the question whether a stretch lies in a run of a divisor of its period."""

    def __init__(self) -> None:
        self.by_period: dict[int, list[tuple[int, int]]] = {}

    def add(self, start: int, end: int, period: int) -> None:
        insort(self.by_period.setdefault(period, []), (start, end))

    def end_around(self, x: int, end: int, period: int) -> int:
        """End of a run that holds x..end and whose period divides ``period``, or 0."""
        for q, runs in self.by_period.items():
            if period % q == 0:
                # Runs of one period overlap by less than it, so both starts and ends ascend.
                at = bisect_right(runs, (x, math.inf)) - 1
                if at >= 0 and runs[at][1] >= end:
                    return runs[at][1]
        return 0


def runs_of(ids: np.ndarray, least: int = LEAST, turns: int = TURNS) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence of word numbers, by start and period.

    ``turns`` is at least 3 and ``least`` at least 1. A stretch of at least two periods whose
    smallest period is a proper divisor of q lies in a run of that divisor, which was found before.
    """
    if turns < 3:
        raise ValueError("turns must be at least 3")
    out = []
    for start, end in surviving_segments(ids, max(least, turns), turns):
        part, found = ids[start:end], _Found()
        longest = len(part) // turns
        for lag in range(1, min(DIRECT, longest) + 1):
            for x, y in _direct_runs(part, lag, least, turns):
                if not found.end_around(x, y, lag):
                    found.add(x, y, lag)
        hits = _block_hits(part, DIRECT + 1, longest) if longest > DIRECT else {}
        for lag, places in hits.items():
            at = 0
            while at < len(places):
                x = int(places[at])
                covered = found.end_around(x, x + 2 * lag, lag)
                if not covered:
                    stretch = _extended(part, x, lag)
                    if stretch is None:
                        at += 1
                        continue
                    covered = stretch[1]
                    if covered - stretch[0] >= max(least, turns * lag):
                        found.add(*stretch, lag)
                # The next block that does not lie in this stretch.
                at = max(at + 1, bisect_left(places, covered - 2 * lag + 1))
        out += [(start + x, y - x, q) for q, runs in found.by_period.items() for x, y in runs]
    return sorted(out, key=lambda r: (r[0], r[2]))


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period; ties to the smaller start, then period."""
    top = None
    for run in runs:
        if top is None or run[1] * top[2] > top[1] * run[2]:
            top = run
    return top


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words without the repetitions: of each run the first period stays, unless another run drops it."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, int)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [w for w, n in zip(words, np.cumsum(gone).tolist()) if not n]


def _search(least: int, turns: int, with_text: bool):
    def run(texts: pa.Array):
        columns: tuple[list, ...] = tuple([] for _ in range(4))
        for text in texts.to_pylist():
            # Only the six ASCII blanks separate words, as for bytes.
            words = (text or "").encode("utf-8", "replace").split()
            numbers: dict[bytes, int] = {}
            ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
            runs = runs_of(ids, least, turns) if len(words) >= max(least, turns) else []
            kept = b" ".join(collapsed(words, runs))
            columns[0].append(len(words))
            columns[1].append([{"start": s, "length": n, "period": q} for s, n, q in runs])
            columns[2].append(hashlib.sha256(kept).hexdigest())
            columns[3].append(kept.decode() if with_text else None)
        return list(columns)

    return run


def find_runs(docs: DataFrame, text: str = "text", least: int = LEAST, turns: int = TURNS, keep=None, with_text: bool = True) -> DataFrame:
    """Add n_words, runs (start, length and period in words), collapsed_sha256 and collapsed.

    ``collapsed`` is the text's words, joined by one blank, without what a run repeats (null if not
    ``with_text``). Null, empty and blank texts have no words and no runs. Every row is answered by
    itself, so repeated rows get the same answer. Columns named like an output are replaced, all
    others in ``keep`` pass through. An empty table gives an empty one.
    """
    return map_columns(
        docs, [text],
        "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed_sha256 string, collapsed string",
        _search(least, turns, with_text), keep)


def digests(docs: DataFrame, text: str = "text", least: int = LEAST, turns: int = TURNS) -> DataFrame:
    """doc_id, n_runs, the strongest run, and digests of all runs and of the collapsed text."""
    found = find_runs(docs, text, least, turns, ["doc_id"], with_text=False)
    runs = F.col("runs")
    # A run beats the best so far only if its length / period is greater, so the earliest wins a tie.
    top = F.reduce(
        runs, F.get(runs, F.lit(0)),
        lambda a, r: F.when(r["length"] * a["period"] > a["length"] * r["period"], r).otherwise(a))
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    return found.withColumn("top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), "collapsed_sha256")
