"""URL filters: longest matching rule, else a verdict from the words inside the host and path.

Names such as ``cheappills`` are split into words by the most probable segmentation under a
unigram model (Viterbi). The unigram counts come from the text of all crawled pages; names of
hosts are left out, since a name that is seen often would then count as one word. A multinomial naive Bayes model then scores the words of host
and path. It is trained on the table itself: a host that contains a seed word counts as an
example of the blocked class, every other host as one of the allowed class, so words that go
along with the seeds gain weight of their own.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlens.llm.texts import map_columns, mixed
from chatlens.session import materialise

# Words in host names of advertising, gambling, malware and adult sites.
SEEDS = [
    "ads", "adult", "banner", "bet", "bets", "bonus", "casino", "cheap", "click", "clicks", "crack", "cracked",
    "discount", "escort", "farm", "free", "gambling", "hack", "jackpot", "keygen", "loan", "loans", "lottery",
    "malware", "nude", "pharma", "phish", "pills", "poker", "popup", "porn", "prize", "replica", "sex", "slots",
    "spam", "spyware", "torrent", "track", "tracker", "tracking", "viagra", "virus", "warez", "win", "winner", "xxx",
]
PER_LETTER = 2.5  # what each letter of an unknown word costs
THRESHOLD = 0.0

BLOCK, ALLOW = "block", "allow"
_PARTS = re.compile(r"[^\W\d_]+")
_SCORE = "_uf_score"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; else empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Mapping[str, str]) -> Column:
    """The longest rule (``host/path``) that fits, else null.

    A rule fits its host and all subdomains if the url's path starts with the rule's path.
    Rules are tried longest first, those of one length in alphabetical order.
    """
    chosen = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        at, _, begin = rule.partition("/")
        fits = (host == at) | host.endswith("." + at)
        chosen = F.when(fits & path.startswith("/" + begin), F.lit(rule)).otherwise(chosen)
    return chosen


class Segmenter:
    """Most probable split of a name under a unigram model with a length penalty for unknown words."""

    def __init__(self, counts: Mapping[str, float], total: float | None = None):
        """``total`` is that of the whole dictionary, if ``counts`` are a part of it."""
        total = total or sum(counts.values()) or 1.0
        self.log = {w: math.log(n / total) for w, n in counts.items()}
        self.lengths, self.floor = {len(w) for w in counts if w}, math.log(1 / (10 * total))

    def unknown(self, length: int) -> float:
        return self.floor - PER_LETTER * length

    def split(self, name: str) -> list[str]:
        """Viterbi over the end positions; ties go to the longer last word."""
        n = len(name)
        best, step = [0.0] * (n + 1), [0] * (n + 1)
        far = 0  # where the best unknown word begins, wherever it ends
        for end in range(1, n + 1):
            best[end], step[end] = best[far] + self.unknown(end - far), far
            for length in self.lengths:
                start = end - length
                word = self.log.get(name[start:end]) if start >= 0 else None
                if word is not None and (best[start] + word, -start) > (best[end], -step[end]):
                    best[end], step[end] = best[start] + word, start
            if best[end] + PER_LETTER * end > best[far] + PER_LETTER * far:
                far = end
        words, end = [], n
        while end > 0:
            words.append(name[step[end]:end])
            end = step[end]
        return words[::-1]


def name_runs(text: str) -> list[str]:
    """The runs of letters of a host or path, in lower case."""
    return _PARTS.findall(text.lower())


def word_counts(pages: DataFrame, html: str = "html") -> DataFrame:
    """``w, n``: every word in the page texts with its count, stored."""
    text = F.lower(F.regexp_replace(F.coalesce(F.col(f"`{html}`"), F.lit("")), r"<[^>]*>", " "))
    words = pages.select(F.explode(F.regexp_extract_all(text, F.lit(r"([\p{L}]+)"), F.lit(1))).alias("w"))
    return materialise(words.groupBy("w").agg(F.count("*").cast("double").alias("n")), "url-words")


def with_seeds(counted: DataFrame, seeds: Sequence[str] = SEEDS) -> tuple[DataFrame, float]:
    """The dictionary with every seed word at least as frequent as a common word, and its total."""
    total = counted.agg(F.sum("n")).first()[0] or 0.0
    own = {r.w: r.n for r in counted.filter(F.col("w").isin(*seeds)).collect()} if seeds else {}
    usual = max(total / 1000, 1.0)
    lifted = {s: max(own.get(s, 0.0), usual) for s in seeds}
    if lifted:
        added = counted.sparkSession.createDataFrame(list(lifted.items()), "w string, n double")
        counted = counted.filter(~F.col("w").isin(*seeds)).unionByName(added)
    return counted, total + sum(lifted.values()) - sum(own.values())


_FACTOR = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_AT_ONCE = 1 << 18  # hashes that leave a task in one batch


def part_hashes(text: str, lengths: Sequence[int]) -> Iterator[np.ndarray]:
    """The distinct hashes of all parts of ``text`` with one of these lengths, length by length.

    Equal parts have equal hashes wherever they stand; memory stays in proportion to the text.
    """
    letters = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64) + np.uint64(1)
    n = len(letters)

    def powers(of: int) -> np.ndarray:
        return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, of, np.uint64))), dtype=np.uint64)

    with np.errstate(over="ignore"):
        up, total = powers(_FACTOR), np.concatenate((np.zeros(1, np.uint64), np.cumsum(letters * powers(_INVERSE)[:n], dtype=np.uint64)))
        for k in lengths:
            if k <= n:
                yield np.unique(mixed((total[k:] - total[:-k]) * up[k - 1:n] ^ np.uint64(k)))


def _hash_whole(words: pa.Array):
    return [[int(next(part_hashes(w, [len(w)])).view(np.int64)[0]) if w else 0 for w in words.to_pylist()]]


def parts_of(names: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """``id, h``: the hashes of all parts of the runs ``names(id, run)`` with one of these lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, held = [], [], 0
            for i, name in zip(batch.column("id").to_pylist(), batch.column("run").to_pylist()):
                for found in part_hashes(name, lengths):
                    ids.append(np.full(len(found), i, np.int64))
                    hashes.append(found.view(np.int64))
                    held += len(found)
                    if held >= _AT_ONCE:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, hashes)], names=["id", "h"])
                        ids, hashes, held = [], [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, hashes)], names=["id", "h"])

    return names.select("id", "run").mapInArrow(run, "id long, h long")


def split_names(names: DataFrame, dictionary: DataFrame, total: float) -> DataFrame:
    """``run, words``: each distinct run of letters, ``names(id, run)``, stored, with its segmentation.

    Each run meets the dictionary words inside it through the hashes of its parts, so the dictionary
    has no bound and a long run costs a number per part, not a copy of itself. Only lengths that the
    dictionary has are tried. A word that only shares a hash with a part is never used by the split.
    """
    longest = names.agg(F.max(F.length("run"))).first()[0] or 0
    hashed = materialise(map_columns(dictionary.filter(F.length("w") <= longest), ["w"], "h long", _hash_whole), "url-dictionary")
    lengths = sorted(r.k for r in hashed.select(F.length("w").alias("k")).distinct().collect())
    # Stored first, so that a join knows how large it is.
    parts = materialise(parts_of(names, lengths), "url-hashes")
    found = parts.join(hashed, "h").groupBy("id").agg(F.collect_list(F.struct("w", "n")).alias("found"))

    def run(runs: pa.Array, known: pa.Array):
        return [[
            Segmenter({x["w"]: x["n"] for x in k or ()}, total).split(r) for r, k in zip(runs.to_pylist(), known.to_pylist())
        ]]

    return map_columns(names.join(found, "id", "left"), ["run", "found"], "words array<string>", run, keep=["run"])


def distinct_urls(parts: DataFrame) -> DataFrame:
    """``host, path, m, runs``: each distinct host and path, its rows, and its runs of letters.

    ``runs`` has a (kind, run) for each run; host runs ("h:") and path runs ("p:") are told apart.
    """

    def run(hosts: pa.Array, paths: pa.Array):
        return [[
            [{"kind": "h:", "run": r} for r in name_runs(h)] + [{"kind": "p:", "run": r} for r in name_runs(p)]
            for h, p in zip(hosts.to_pylist(), paths.to_pylist())
        ]]

    counted = parts.groupBy("host", "path").agg(F.count("*").alias("m"))
    return map_columns(counted, ["host", "path"], "runs array<struct<kind:string,run:string>>", run)


def run_classes(urls: DataFrame, split: DataFrame, seeds: Sequence[str] = SEEDS) -> DataFrame:
    """``kind, run, b, a``: how often each run occurs in blocked and in other rows.

    A row with the kind "" carries the number of rows of the two classes.
    """
    bad_runs = split.filter(F.arrays_overlap("words", F.array(*map(F.lit, seeds)))).select("run") if seeds else split.select("run").limit(0)
    in_hosts = urls.select("host", F.explode("runs").alias("r")).filter("r.kind = 'h:'").select("host", F.col("r.run").alias("run")).distinct()
    bad_hosts = in_hosts.join(bad_runs, "run", "left_semi").select("host").distinct()
    # Runs are counted per host before the join, so a host meets it once for each of its runs.
    none = F.array(F.struct(F.lit("").alias("kind"), F.lit("").alias("run")))
    by_host = urls.select("host", "m", F.explode(F.concat(none, "runs")).alias("r")).groupBy(
        "host", F.col("r.kind").alias("kind"), F.col("r.run").alias("run")).agg(F.sum("m").alias("m"))
    flagged = by_host.join(bad_hosts.withColumn("bad", F.lit(True)), "host", "left")
    return flagged.groupBy("kind", "run").agg(
        F.sum(F.when(F.col("bad"), F.col("m")).otherwise(0)).alias("b"),
        F.sum(F.when(F.col("bad").isNull(), F.col("m")).otherwise(0)).alias("a"))


def fit(classes: DataFrame, split: DataFrame) -> tuple[DataFrame, float]:
    """The log-odds (blocked against allowed) of every token as ``token, odds``, and the prior.

    All rows are counted and every token keeps its weight; the table stays in Spark.
    """
    words = classes.join(split, "run").select("kind", F.explode("words").alias("w"), "b", "a")
    counted = materialise(
        words.groupBy(F.concat("kind", "w").alias("token")).agg(F.sum("b").alias("b"), F.sum("a").alias("a")), "url-tokens")
    totals = counted.agg(F.sum("b").alias("b"), F.sum("a").alias("a"), F.count("*").alias("kinds")).first()
    rows = classes.filter("kind = ''").agg(F.sum("b").alias("b"), F.sum("a").alias("a")).first()
    kinds = totals.kinds + 1  # one for all tokens that are not in the table
    odds = F.log((F.col("b") + 1) / ((totals.b or 0) + kinds)) - F.log((F.col("a") + 1) / ((totals.a or 0) + kinds))
    return counted.select("token", odds.alias("odds")), math.log((rows.b or 0) + 1) - math.log((rows.a or 0) + 1)


def _in_order(values: Column) -> Column:
    """The sum of collected numbers, added by size, so that it doesn't depend on how they arrived."""
    return F.aggregate(F.array_sort(values), F.lit(0.0), lambda total, x: total + x)


def url_scores(urls: DataFrame, classes: DataFrame, split: DataFrame, odds: DataFrame) -> DataFrame:
    """``host, path, score``: the summed log-odds of the tokens of each distinct url that has any."""
    tokens = classes.join(split, "run").select("kind", "run", F.explode("words").alias("w"))
    of_run = tokens.select("kind", "run", F.concat("kind", "w").alias("token")).join(odds, "token").groupBy("kind", "run").agg(
        _in_order(F.collect_list("odds")).alias("score"))
    of_run = materialise(of_run, "url-runs")
    spread = urls.select("host", "path", F.explode("runs").alias("r")).select("host", "path", F.col("r.kind").alias("kind"), F.col("r.run").alias("run"))
    return spread.join(of_run, ["kind", "run"]).groupBy("host", "path").agg(_in_order(F.collect_list("score")).alias("score"))


def judge_urls(
    pages: DataFrame, rules: Mapping[str, str], url: str = "url", html: str = "html", seeds: Sequence[str] = SEEDS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Add host, path, rule, log_odds and verdict to each row of ``pages``.

    The rule decides where one fits; elsewhere the url is blocked if its log-odds exceed
    ``threshold``. A null url or one without ``://`` has an empty host and path and is judged by
    the prior alone. Urls and words may be of any length. Repeated rows are judged alike; columns named like an output are replaced. The
    page text is read for the dictionary and not returned.
    """
    parts = pages.withColumns({"host": host_of(F.col(f"`{url}`")), "path": path_of(F.col(f"`{url}`"))})
    dictionary, total = with_seeds(word_counts(parts, html), seeds)
    urls = materialise(distinct_urls(parts), "url-names")
    names = urls.select(F.explode("runs.run").alias("run")).distinct()
    names = materialise(names.withColumn("id", F.monotonically_increasing_id()), "url-parts")
    split = materialise(split_names(names, dictionary, total), "url-split")
    classes = materialise(run_classes(urls, split, seeds), "url-classes")
    odds, prior = fit(classes, split)
    scores = materialise(url_scores(urls, classes, split, odds), "url-scores")

    kept = parts.drop(html, "log_odds")
    judged = kept.join(scores.withColumnRenamed("score", _SCORE), ["host", "path"], "left").select(
        *[F.col(f"`{c}`") for c in kept.columns], (F.lit(prior) + F.coalesce(_SCORE, F.lit(0.0))).alias("log_odds"))
    rule = matching_rule(F.col("host"), F.col("path"), rules)
    by_rule = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair]) if rules else None
    verdict = F.when(F.col("log_odds") > threshold, BLOCK).otherwise(ALLOW)
    return judged.withColumn("rule", rule).withColumn(
        "verdict", F.coalesce(by_rule[F.col("rule")], verdict) if rules else verdict)
