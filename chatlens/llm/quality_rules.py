"""Quality rules: plain counts plus a hashed n-gram likelihood ratio, in DataFrame functions only.

The ratio compares two multinomials over hashed word and word-pair buckets: one of trusted
documents, one of the whole raw corpus. A document's score is the sum of
``log p_trusted(bucket) - log p_raw(bucket)`` over its n-grams divided by their number, and it is
kept when the score reaches a fixed threshold. No random numbers are involved.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlens.llm.texts import words

# Runs of letters and digits, and runs of other visible characters.
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]+"
BUCKETS = 1 << 14
THRESHOLD = -0.5  # nats per n-gram; clean text lies near 0 whatever the size of the corpus
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
_WIDTH = 5
_OWN = "_qr_"


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later expressions read instead of computing it again."""
    return df.select("*", F.explode(F.array(value)).alias(_OWN + name))


def _bucket_lists(df: DataFrame, text: str, buckets: int) -> DataFrame:
    """Add the bucket of each token and of each pair of neighbouring tokens."""
    tokens = F.regexp_extract_all(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(f"({TOKEN})"), F.lit(1))
    df = _once(df, "t", F.transform(tokens, lambda t: F.xxhash64(t)))
    t = F.col(_OWN + "t")
    single = F.transform(t, lambda h: F.pmod(h, F.lit(buckets)).cast("int"))
    pair = F.transform(
        F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))),
        lambda h, i: F.pmod(F.xxhash64(h, F.get(t, i + 1)), F.lit(buckets)).cast("int"),
    )
    return _once(df, "b", F.concat(single, pair)).drop(_OWN + "t")


def bucket_counts(
    docs: DataFrame, labels: DataFrame, text: str = "text", buckets: int = BUCKETS
) -> tuple[dict[int, int], dict[int, int]]:
    """How many n-grams fall into each bucket: of the rows labelled as good, and of all rows.

    Every row is counted, in one pass over the texts. At most ``buckets`` rows reach the driver.
    """
    good = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    mark = _OWN + "g"
    rows = docs.select("doc_id", text)
    # A merge join whatever the number of labels, so that cost grows in proportion to the rows.
    marked = rows.filter("doc_id is not null").join(good.withColumn(mark, F.lit(True)).hint("merge"), "doc_id", "left")
    # Rows without an id match no label and stay out of the join, where they would share one key.
    marked = marked.unionByName(rows.filter("doc_id is null").withColumn(mark, F.lit(False)))
    spread = _bucket_lists(marked.select(text, mark), text, buckets).select(mark, F.explode(_OWN + "b").alias("b"))
    counted = spread.groupBy("b").agg(F.count("*").alias("n"), F.count_if(mark).alias("good")).collect()
    return {r.b: r.good for r in counted if r.good}, {r.b: r.n for r in counted}


def log_ratios(trusted: dict[int, int], raw: dict[int, int], buckets: int = BUCKETS) -> list[float]:
    """log p_trusted - log p_raw per bucket, both smoothed by one count per bucket.

    Without trusted text every ratio is 0, so nothing is rejected by it.
    """
    if not trusted:
        return [0.0] * buckets
    a, b = sum(trusted.values()) + buckets, sum(raw.values()) + buckets
    return [
        math.log((trusted.get(i, 0) + 1) / a) - math.log((raw.get(i, 0) + 1) / b) for i in range(buckets)
    ]


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", buckets: int = BUCKETS) -> list[float]:
    """The ratios from the counts of all documents labelled as good and of all of ``docs``."""
    return log_ratios(*bucket_counts(docs, labels, text, buckets), buckets)


def _repeated_places(doubled: Column) -> Column:
    """Where windows start that occur twice or more; ``doubled`` are the (hash, place) pairs in order."""
    n = F.size(doubled)
    same = lambda i, j: F.get(doubled, i)["h"] == F.get(doubled, j)["h"]
    return F.array_sort(F.transform(
        F.filter(doubled, lambda x, i: F.coalesce(((i > 0) & same(i, i - 1)) | ((i < n - 1) & same(i, i + 1)), F.lit(False))),
        lambda x: x["i"],
    ))


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    df = _once(docs, "w", words(F.col(f"`{text}`")))
    w = F.col(_OWN + "w")
    df = _once(df, "wh", F.transform(w, lambda x: F.xxhash64(x)))
    wh = F.col(_OWN + "wh")
    df = _once(df, "h", F.transform(
        F.slice(wh, 1, F.greatest(F.size(wh) - (_WIDTH - 1), F.lit(0))),
        lambda x, i: F.xxhash64(x, *[F.get(wh, i + k) for k in range(1, _WIDTH)]),
    )).drop(_OWN + "wh")
    h = F.col(_OWN + "h")
    # Sorting is only needed where a window does occur twice.
    pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    df = _once(df, "s", F.when(F.size(F.array_distinct(h)) < F.size(h), pairs).otherwise(none))
    df = _once(df, "p", _repeated_places(F.col(_OWN + "s"))).drop(_OWN + "s")
    p = F.col(_OWN + "p")
    covered = F.aggregate(
        F.transform(p, lambda x, i: F.least(F.lit(_WIDTH), F.coalesce(F.get(p, i + 1) - x, F.lit(_WIDTH)))),
        F.lit(0).cast("long"), lambda total, x: total + x,
    )
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    df = _once(df, "l", lines)
    counts = df.withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size(_OWN + "l") - F.size(F.array_distinct(_OWN + "l"))).cast("long"),
        "n_repeat_words": covered,
    }).drop(*[_OWN + c for c in "whpl"])
    return counts.withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    )


def likelihood(docs: DataFrame, ratios: Sequence[float], text: str = "text") -> DataFrame:
    """Add n_ngrams and mean_ratio (0 for a text without tokens)."""
    # One constant of fixed length, read by position; repr() keeps every bit of the numbers.
    model = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    df = _bucket_lists(docs, text, len(ratios))
    b = F.col(_OWN + "b")
    total = F.aggregate(b, F.lit(0.0), lambda acc, x: acc + F.get(model, x))
    return df.withColumns({
        "n_ngrams": F.size(b).cast("long"),
        "mean_ratio": F.when(F.size(b) > 0, total / F.size(b)).otherwise(F.lit(0.0)),
    }).drop(_OWN + "b")


def judge(
    docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = THRESHOLD, buckets: int = BUCKETS
) -> DataFrame:
    """All counts, the mean ratio and ``kept`` for each row of ``docs``.

    Null, empty and blank texts have no words and fail the base rules. Repeated rows are judged
    alike, one by one. Other columns pass through; columns named like an output are replaced.
    An empty table gives an empty result.
    """
    ratios = fit(docs, labels, text, buckets)
    judged = likelihood(base_counts(docs, text), ratios, text)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("mean_ratio") >= threshold))
