"""Terms of topics: vocabulary, class-based TF-IDF, keyword and size tables."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlens import fixed_values as fv
from chatlens.functions.text import evaluated_once, token_count
from chatlens.functions.words import WordSplitter, word_characters
from chatlens.session import materialise
from chatlens.topics.eligibility import TOPIC

STOPWORDS = sorted({*fv.ENGLISH_STOPWORDS, *fv.PLATFORM_STOPWORDS, *fv.FILLER_STOPWORDS, *fv.BANNED_LABEL_WORDS})


# The Arrow bytes of words that a task counts at a time, and of texts that it splits, in whole messages. Counting
# takes about 40 times as much memory, and a machine runs a task per core.
COUNTED_BYTES, SPLIT_BYTES = 2 << 20, 1 << 20
LARGEST_NUMBER = 1 << 62
# The counts of one part of all terms are in the memory of a task at a time, those of about ``PART_BYTES`` of stored messages.
PARTS_PER_PARTITION, LEAST_PARTS, MOST_PARTS, PART_BYTES = 4, 512, 8192, 1 << 20
UNKNOWN_SIZE = 1 << 50  # Spark takes a table of unknown size for larger than any


def vocabulary_words(text: Column) -> Column:
    """Lower-cased words of two or more characters."""
    # ASCII letters come first because they are the cheapest to test; "+" is matched in one loop, "{2,}" is not.
    one = f"[a-z{fv.WORD_CLASS}]"
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"{one}{one}+"), 0)


def kept_words(text: Column, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """The words of a text that are no stopwords."""
    listed = list(stopwords)
    return F.filter(vocabulary_words(text), lambda w: ~w.isin(listed))


def add_terms(df: DataFrame, text_col: str, stopwords: Sequence[str] = STOPWORDS, out: str = "terms") -> DataFrame:
    """Add the array of words and word pairs that remain without stopwords."""
    df = evaluated_once(df, _w=kept_words(F.col(text_col), stopwords))
    pairs = F.greatest(F.size("_w") - 1, F.lit(0))
    grams = F.concat(
        F.col("_w"),
        F.zip_with(F.slice("_w", F.lit(1), pairs), F.slice("_w", F.lit(2), pairs), lambda a, b: F.concat_ws(" ", a, b)),
    )
    return df.select(*[c for c in df.columns if c != "_w"], grams.alias(out))


def stopword_table(docs: DataFrame, text_col: str, stopwords: Sequence[str] = STOPWORDS) -> DataFrame:
    """How often each stopword occurs in the documents."""
    listed = list(stopwords)
    words = F.filter(vocabulary_words(F.col(text_col)), lambda w: w.isin(listed))
    return docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("occurrences"))


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Tables of whole rows with about ``most`` bytes each, or one row if that is longer."""
    held, size = [], 0
    for batch in batches:
        step = max(1, batch.num_rows * most // max(batch.nbytes, most))
        for start in range(0, batch.num_rows, step):
            held.append(batch.slice(start, step))
            size += held[-1].nbytes
            if size >= most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _words(batches: Iterator[pa.RecordBatch], splitter: Callable[[], WordSplitter]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, with ``words`` in place of the lower-cased ``text``."""
    split = splitter()
    for rows in _pieces(batches, SPLIT_BYTES):
        rows = rows.combine_chunks()
        at = rows.column_names.index("text")
        yield from rows.set_column(at, "words", split(rows["text"].combine_chunks())).to_batches()


class _Said:
    """The words and pairs of neighbours of messages, under numbers.

    A word has its place in ``dictionary`` as its number, the pair of a and b has n + a · n + b.
    ``rows`` and ``terms`` list each term of a message once, in this order, ``times`` how often it occurs there.
    """

    def __init__(self, words: pa.ListArray):
        coded = words.flatten().dictionary_encode()
        row, a, n = pc.list_parent_indices(words).to_numpy(), coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
        first = np.flatnonzero(row[1:] == row[:-1])
        term, span = np.concatenate([a, n + a[first] * n + a[first + 1]]), n * (n + 1)
        self.dictionary, self.n, self.numbers = coded.dictionary, n, None
        # Many rows with many words: only the pairs that occur are numbered.
        if len(words) * span >= LARGEST_NUMBER:
            self.numbers, term = np.unique(term, return_inverse=True)
            span = len(self.numbers)
        self.span = max(span, 1)
        # Each key takes the place of its term.
        term[:len(row)] += row * self.span
        term[len(row):] += row[first] * self.span
        self.keys, self.times = np.unique(term, return_counts=True)
        del term
        self.rows, self.terms = np.divmod(self.keys, self.span)

    def words_of(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether a term is a single word, the place of its first (or only) word, and that of the second."""
        numbers = terms if self.numbers is None else self.numbers[terms]
        single, pair = numbers < self.n, np.maximum(numbers - self.n, 0)
        return single, np.where(single, numbers, pair // self.n), pair % self.n

    def times_of(self, rows: np.ndarray, terms: pa.StringArray) -> np.ndarray:
        """How often each of the named terms occurs in the row beside it."""
        if not len(self.keys):
            return np.zeros(len(rows), np.int64)
        # An empty last part stands where a single word has no second one.
        parts = pc.split_pattern(pc.binary_join_element_wise(terms, "", " "), " ")
        single = pc.equal(pc.list_value_length(parts), 2).to_numpy(zero_copy_only=False)
        first, second = (
            pc.fill_null(pc.index_in(pc.list_element(parts, i), value_set=self.dictionary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            for i in (0, 1))
        known = (first >= 0) & (single | (second >= 0))
        number = np.where(single, first, self.n + first * self.n + second)
        if self.numbers is not None:
            at = np.minimum(np.searchsorted(self.numbers, number), self.span - 1)
            number, known = at, known & (self.numbers[at] == number)
        key = rows * self.span + number
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(known & (self.keys[at] == key), self.times[at], 0)


def _count_terms(batches: Iterator[pa.RecordBatch], parts: int = 1) -> Iterator[pa.RecordBatch]:
    """For each topic and each word or pair of neighbours in ``words``: occurrences, messages and part, piece by piece.

    A term is in the same one of ``parts`` parts wherever it is counted. Rows come in the order of
    parts, then of ``group``, a number of the topic within the piece.
    """
    for rows in _pieces(batches, COUNTED_BYTES):
        said = _Said(rows["words"].combine_chunks())
        if not said.n:
            continue
        roles, topics = (rows[key].combine_chunks().dictionary_encode("encode") for key in TOPIC)
        width = len(topics.dictionary)
        groups, group = np.unique(roles.indices.to_numpy().astype(np.int64) * width + topics.indices.to_numpy(), return_inverse=True)
        found = group[said.rows] * said.span + said.terms
        order = np.argsort(found)
        found = found[order]
        starts = np.flatnonzero(np.diff(found, prepend=-1))
        tf, seen = np.add.reduceat(said.times[order], starts), np.diff(starts, append=len(found))
        found = found[starts]
        said.keys = said.times = said.rows = said.terms = order = starts = None
        group, term = np.divmod(found, said.span)
        single, first, second = said.words_of(term)
        mixed = pd.util.hash_array(said.dictionary.to_numpy(zero_copy_only=False), categorize=False)
        mixed = np.where(single, mixed[first], mixed[first] * np.uint64(0x9E3779B97F4A7C15) + mixed[second])
        part = (mixed % np.uint64(parts)).astype(np.min_scalar_type(parts))
        by_part = np.argsort(part, kind="stable")
        part, group, tf, seen, single = (x[by_part] for x in (part, group, tf, seen, single))
        one, two = (said.dictionary.take(pa.array(x[by_part])) for x in (first, second))
        found = term = first = second = mixed = by_part = None
        term = pc.if_else(pa.array(single), one, pc.binary_join_element_wise(one, two, " "))
        one = two = single = None
        keys = groups[group]
        yield from pa.table({
            TOPIC[0]: roles.dictionary.take(pa.array(keys // width)), TOPIC[1]: topics.dictionary.take(pa.array(keys % width)),
            "term": term, "tf": tf, "docs": seen, "part": part.astype(np.int32), "group": group,
        }).to_batches()


def _term_lists(batches: Iterator[pa.RecordBatch], splitter: Callable[[], WordSplitter], parts: int) -> Iterator[pa.RecordBatch]:
    """The counts of a piece, one row for each part: the terms, topic by topic, and how many belong to each topic.

    No word holds the line break that joins the terms.
    """
    for counts in _count_terms(_words(batches, splitter), parts):
        part, group = counts["part"].to_numpy(), counts["group"].to_numpy()
        first = np.diff(part, prepend=-1) != 0
        starts, runs = np.flatnonzero(first), np.flatnonzero(first | (np.diff(group, prepend=-1) != 0))
        bounds = lambda at, end: pa.array(np.append(at, end).astype(np.int32))
        of_terms, of_runs = bounds(starts, len(part)), bounds(np.searchsorted(runs, starts), len(runs))
        lengths = pa.array(np.diff(runs, append=len(part)).astype(np.int32))
        yield from pa.table({
            "part": counts["part"].take(pa.array(starts)),
            **{key: pa.ListArray.from_arrays(of_runs, counts[key].take(pa.array(runs))) for key in TOPIC},
            "lengths": pa.ListArray.from_arrays(of_runs, lengths),
            "terms": pc.binary_join(pa.ListArray.from_arrays(of_terms, counts["term"]), "\n"),
            **{key: pa.ListArray.from_arrays(of_terms, counts[key].cast(pa.int32())) for key in ("tf", "docs")},
        }).to_batches(10_000)


def _sums(group: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(group, values, size).astype(np.int64)


def _put_together(lists: pa.Table, min_docs: int, by_topic: bool) -> pa.Table:
    """All counts of the terms of one part, put together; terms in too few messages (or topics) leave first."""
    words = pc.split_pattern(lists["terms"], "\n").combine_chunks().flatten().dictionary_encode()
    words, of = words.dictionary, words.indices.to_numpy().astype(np.int64)
    tf, docs, lengths = (pc.list_flatten(lists[key]).to_numpy() for key in ("tf", "docs", "lengths"))
    roles, topics = (pc.list_flatten(lists[key]).combine_chunks().dictionary_encode("encode") for key in TOPIC)
    # A null topic is neither inside nor outside.
    inside = pc.fill_null(pc.not_equal(topics.dictionary, -1), False).to_numpy(zero_copy_only=False)
    # From here on a term is that of one role.
    of += np.repeat(roles.indices.to_numpy().astype(np.int64) * len(words), lengths)
    topic, size = np.repeat(topics.indices.to_numpy(), lengths), len(roles.dictionary) * len(words)
    if by_topic:
        cells = np.unique((of * np.int64(len(inside)) + topic)[inside[topic]])
        df = np.bincount(cells // len(inside), minlength=size)
    else:
        df = _sums(of, docs, size)
    chosen = np.flatnonzero(df[of] >= min_docs)
    of, topic, tf, docs = of[chosen], topic[chosen], tf[chosen], docs[chosen]
    within = inside[topic]
    f, counted = _sums(of[within], tf[within], size), np.bincount(of[within], minlength=size) > 0
    cells = pa.array(of * np.int64(len(inside)) + topic).dictionary_encode()
    cell, n = cells.indices.to_numpy(), len(cells.dictionary)
    of, topic = np.divmod(cells.dictionary.to_numpy(), len(inside))
    role, place = np.divmod(of, len(words))
    return pa.table({
        TOPIC[0]: roles.dictionary.take(pa.array(role)), TOPIC[1]: topics.dictionary.take(pa.array(topic)),
        "term": words.take(pa.array(place)), "tf": _sums(cell, tf, n), "docs": _sums(cell, docs, n),
        "df": df[of], "f": pa.array(f[of], mask=~counted[of]),
    })


def _parts(docs: DataFrame) -> int:
    """Into how many parts the terms of ``docs`` are dealt: by the size that Spark expects of the messages, if it knows one."""
    least = max(LEAST_PARTS, PARTS_PER_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return least if size >= UNKNOWN_SIZE else max(least, min(MOST_PARTS, size // PART_BYTES))


def term_table(
    docs: DataFrame,
    text_col: str,
    stopwords: Sequence[str] = STOPWORDS,
    min_docs: int = fv.MIN_TERM_DOCS,
    max_share: float = fv.MAX_TERM_SHARE,
    df_unit: str = "message",
) -> DataFrame:
    """Stored table ``(message_role, topic_id, term, tf, docs, df, f)`` of the vocabulary.

    ``tf`` counts a term in a topic and ``docs`` the messages there that contain it,
    ``f`` counts it in all topics of the role, ``df`` the messages (or topics, with
    ``df_unit='topic'``). Each task splits its messages into words and counts their terms
    under short numbers. Only these counts are shuffled, once, as lists by part: the terms
    are dealt by a hash over parts whose number grows with the messages, and a task puts one part
    at a time together in memory. Terms outside the limits, which are most,
    leave before the counts of a topic are put together.
    """
    spark, parts = docs.sparkSession, _parts(docs)
    splitter = functools.partial(WordSplitter, word_characters(spark), list(stopwords))
    keys = docs.select(*TOPIC).schema.fields
    texts = docs.select(*TOPIC, F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    packed = T.StructType([
        T.StructField("part", T.IntegerType()), *[T.StructField(key.name, T.ArrayType(key.dataType)) for key in keys],
        *T.StructType.fromDDL("lengths array<int>, terms string, tf array<int>, docs array<int>").fields])
    counted = T.StructType([*keys, *T.StructType.fromDDL("term string, tf long, docs long, df long, f long").fields])
    lists = texts.mapInArrow(lambda batches: _term_lists(batches, splitter, parts), packed).repartition("part")
    by_topic = df_unit == "topic"
    found = lists.groupBy("part").applyInArrow(lambda part: _put_together(part, min_docs, by_topic), counted)
    universe = F.count_distinct(F.when(F.col("topic_id") != -1, F.col("topic_id"))) if by_topic else F.count("*")
    # One row per role, and there are two roles.
    totals = F.broadcast(docs.groupBy("message_role").agg(universe.alias("_n")))
    kept = found.join(totals, "message_role").filter(F.col("df") <= F.col("_n") * max_share)
    return materialise(kept.select(*TOPIC, "term", "tf", "docs", "df", "f"), "topic-terms")


def vocabulary(terms: DataFrame) -> DataFrame:
    return terms.groupBy("message_role", "term").agg(F.max("df").alias("df"))


def topic_terms(terms: DataFrame, top: int = 10) -> DataFrame:
    """The ``top`` terms of each topic by tf · ln(1 + A / f), A = mean words per topic."""
    rows = terms.filter(F.col("topic_id") != -1)
    mean_words = F.broadcast(rows.groupBy("message_role").agg(
        (F.sum("tf") / F.count_distinct("topic_id")).alias("_a")
    ))
    weighed = rows.join(mean_words, "message_role").withColumn("weight", F.col("tf") * F.log1p(F.col("_a") / F.col("f")))
    # Ranking all terms would sort them all. Terms of like weight are counted first, in steps of a sixteenth of a
    # power of two, and only those from one step below the last place upwards are ranked: two steps and more apart,
    # weights above the floor of 1e-6 still differ when they are rounded.
    step = F.floor(F.log2(F.greatest("weight", F.lit(1e-6))) * 16)
    stepped = weighed.withColumn("_step", step)
    above = Window.partitionBy(*TOPIC).orderBy(F.col("_step").desc())
    # One row per topic.
    lowest = materialise(
        stepped.groupBy(*TOPIC, "_step").agg(F.count("*").alias("_n"))
        .withColumn("_before", F.sum("_n").over(above) - F.col("_n")).filter(F.col("_before") < top)
        .groupBy(*TOPIC).agg(F.min("_step").alias("_lowest")), "lowest-steps")
    best = Window.partitionBy(*TOPIC).orderBy(F.round("weight", 9).desc(), "term")
    return (
        stepped.join(lowest, TOPIC).filter(F.col("_step") >= F.col("_lowest") - 1)
        .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
        .select(*TOPIC, "rank", "term", "weight")
    )


def term_lists(ranked: DataFrame) -> DataFrame:
    """``(message_role, topic_id, terms)``; a list is as long as the top-n it comes from."""
    pairs = F.array_sort(F.collect_list(F.struct("rank", "term")))
    return ranked.groupBy(*TOPIC).agg(pairs.alias("_p")).select(*TOPIC, F.col("_p.term").alias("terms"))


def _similarities(batches: Iterator[pa.RecordBatch], splitter: Callable[[], WordSplitter]) -> Iterator[pa.RecordBatch]:
    """The messages with the cosine of their term counts and the weights beside them."""
    for rows in _words(batches, splitter):
        said = _Said(rows["words"])
        listed = rows["_terms"]
        row, weight = pc.list_parent_indices(listed).to_numpy(), pc.fill_null(rows["_weights"].flatten(), 0.0).to_numpy()
        total = np.bincount(row, weight * said.times_of(row, listed.flatten()), rows.num_rows)
        squares = np.bincount(said.rows, said.times * said.times, rows.num_rows)
        length = np.sqrt(squares) * rows["_l"].to_numpy(zero_copy_only=False)
        cosine = np.divide(total, length, out=np.zeros(rows.num_rows), where=squares > 0)
        yield pa.RecordBatch.from_pydict({**{key: rows[key] for key in (*TOPIC, "row_index", "example")}, "similarity": cosine})


def representative_by_terms(
    docs: DataFrame, text_col: str, ranked: DataFrame, top: int = 2, stopwords: Sequence[str] = STOPWORDS
) -> DataFrame:
    """``message_role, topic_id, rank, row_index, example, similarity``: the messages that say most of a topic.

    Similarity is the cosine of a message's term counts and the weights of its topic's ``ranked``
    terms. The weights of a topic, a list of bounded length, come to the message, so the product is
    taken within the row and no terms are shuffled. Ties go to the smaller row index; a message
    without terms has similarity 0. Topics without terms have no row.
    """
    weights = materialise(ranked.groupBy(*TOPIC).agg(
        F.collect_list(F.struct("term", "weight")).alias("_w"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_l")),
        "topic-weights").select(*TOPIC, F.col("_w.term").alias("_terms"), F.col("_w.weight").alias("_weights"), "_l")
    splitter = functools.partial(WordSplitter, word_characters(docs.sparkSession), list(stopwords))
    kept = docs.filter(F.col("topic_id") != -1).select(*TOPIC, "row_index", F.col(text_col).alias("example"))
    rows = kept.withColumn("text", F.lower(F.coalesce("example", F.lit("")))).join(weights, TOPIC)
    schema = T.StructType([*kept.schema.fields, T.StructField("similarity", T.DoubleType())])
    scored = rows.mapInArrow(lambda batches: _similarities(batches, splitter), schema)
    best = Window.partitionBy(*TOPIC).orderBy(F.round("similarity", 9).desc(), "row_index")
    ranks = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranks.select(*TOPIC, "rank", "row_index", "example", "similarity")


def topic_sizes(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("topic_id") != -1).groupBy(*TOPIC).agg(F.count("*").alias("message_count"))


def generated_name(terms: Column) -> Column:
    return F.concat_ws("_", F.col("topic_id").cast("string"), F.array_join(F.slice(terms, 1, 4), "_"))


def topic_info(docs: DataFrame, ranked: DataFrame) -> DataFrame:
    """Size, generated name and term list of each topic."""
    return topic_sizes(docs).join(term_lists(ranked), TOPIC, "left").select(
        *TOPIC, "message_count", generated_name(F.col("terms")).alias("name"),
        F.coalesce("terms", F.array().cast("array<string>")).alias("terms"),
    )


def topic_keywords(info: DataFrame, labels: DataFrame | None = None, top: int = 10) -> DataFrame:
    """The keyword table; a topic without a label shows its generated name."""
    named = info if labels is None else info.join(labels.select(*TOPIC, "intent_label"), TOPIC, "left")
    label = F.col("name") if labels is None else F.coalesce("intent_label", "name")
    return named.filter(F.size("terms") > 0).select(
        *TOPIC, label.alias("intent_label"), F.array_join(F.slice("terms", 1, top), ", ").alias("keywords"), "message_count"
    )


def active_topics(topics: DataFrame, docs: DataFrame) -> DataFrame:
    """Topics that still have messages."""
    return topics.join(topic_sizes(docs).select(*TOPIC), TOPIC, "left_semi")


def message_topics(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Add the label of each message's topic. ``labels`` is a small stored table."""
    joined = docs.join(labels.select(*TOPIC, "intent_label"), TOPIC, "left")
    label = F.when(F.col("topic_id") == -1, "Outlier").otherwise(
        F.coalesce("intent_label", F.concat(F.lit("Topic "), F.col("topic_id").cast("string")))
    )
    return joined.withColumn("intent_label", label)


def topic_examples(docs: DataFrame, text_col: str, per_topic: int = 3) -> DataFrame:
    """The first messages of each topic, numbered."""
    first = Window.partitionBy(*TOPIC).orderBy("row_index")
    return (
        docs.filter((F.col("topic_id") != -1) & F.col(text_col).isNotNull())
        .select(*TOPIC, "row_index", F.col(text_col).alias("example"))
        .withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= per_topic)
    )


def topic_diagnostics(docs: DataFrame, cleaned_col: str, original_col: str, info: DataFrame, labels: DataFrame) -> DataFrame:
    """Label, keywords, size, mean tokens, warning and three examples of each topic."""
    sized = docs.filter(F.col("topic_id") != -1).groupBy(*TOPIC).agg(F.avg(token_count(F.col(cleaned_col))).alias("avg_tokens"))
    examples = topic_examples(docs, original_col).groupBy(*TOPIC).agg(*[
        F.coalesce(F.max(F.when(F.col("rank") == i, F.col("example"))), F.lit("")).alias(f"example_{i}") for i in (1, 2, 3)
    ])
    label = F.coalesce("intent_label", F.concat(F.lit("Topic "), F.col("topic_id").cast("string")))
    return (
        info.join(labels.select(*TOPIC, "intent_label"), TOPIC, "left").join(sized, TOPIC).join(examples, TOPIC)
        .select(
            *TOPIC, label.alias("intent_label"), F.array_join(F.slice("terms", 1, 10), ", ").alias("keywords"),
            "message_count", "avg_tokens", (F.col("avg_tokens") < fv.MIN_MESSAGE_TOKENS).alias("short_warning"),
            "example_1", "example_2", "example_3",
        )
    )
