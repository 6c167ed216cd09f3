"""The distributed job around a model: score each distinct text once, join back."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlens.operators.joins import HOT_ROWS, attach_by_key, text_key
from chatlens.session import is_stored, materialise, remove_stored, scratch_path

Model = Callable[[list[str]], Sequence[Any]]

# A lost task repeats at most about this many model calls.
TEXTS_PER_TASK = 2000
# Answers that are kept at a time in a run that can be resumed.
TEXTS_PER_COMMIT = 100_000
# Jobs that such a run is at most divided into; a job has a task for each part of the answers.
MOST_ROUNDS = 16


def as_model(model: Any) -> Model:
    """Accept a function or an object with a ``score`` or ``predict`` method."""
    for name in ("score", "predict"):
        if hasattr(model, name):
            return getattr(model, name)
    if callable(model):
        return model
    raise AttributeError("a model must be callable or have a 'score' or 'predict' method")


def distinct_texts(df: DataFrame, text_col: str, first_by: str | None = None) -> DataFrame:
    """``(text, n_rows[, first_row])`` per non-blank text; combined before the shuffle."""
    aggregates = [F.count("*").alias("n_rows")]
    if first_by:
        aggregates.append(F.min(first_by).alias("first_row"))
    return df.select(F.col(text_col).alias("text"), *([first_by] if first_by else [])).groupBy("text").agg(*aggregates)


class WordTokenizer:
    """The built-in tokenizer: words between blanks."""

    def encode(self, text: str) -> list[str]:
        return text.split()

    def decode(self, tokens: Sequence[str]) -> str:
        return " ".join(tokens)


def run_model(
    texts: DataFrame,
    load_model: Callable[[], Any],
    result: T.StructType,
    batch_size: int,
    partitions: int | None = None,
    texts_per_task: int = TEXTS_PER_TASK,
    max_tokens: int | None = None,
    load_tokenizer: Callable[[], Any] = WordTokenizer,
    stored: bool = False,
    placed: bool = False,
) -> DataFrame:
    """Add the model's columns to a table with a ``text`` column.

    The model is loaded once per task and called with lists of at most
    ``batch_size`` texts. Rows are spread evenly first, because the cost is per
    text and not per byte, so the partitions must not be merged by size. The
    texts are stored and counted, and the number of tasks follows from that; ``stored`` says that
    ``texts`` reads a stored table, so counting it is cheap and no copy is needed, ``placed`` that its
    rows are spread over the tasks already.

    With ``max_tokens`` the model sees at most so many tokens of a text, as the tokenizer (an object
    with ``encode`` and ``decode``, loaded once per task) counts them; shorter texts are passed
    unchanged. Batches are then formed by length, longest first, so that a model which pads its
    input wastes little; answers return to their rows.
    """
    names = result.fieldNames()
    single = len(names) == 1

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = as_model(load_model())
        tokenizer = load_tokenizer() if max_tokens is not None else None
        for frame in batches:
            texts_here = frame["text"].tolist()
            order = list(range(len(texts_here)))
            if tokenizer is not None:
                parts = [tokenizer.encode(t) for t in texts_here]
                texts_here = [tokenizer.decode(p[:max_tokens]) if len(p) > max_tokens else t for p, t in zip(parts, texts_here)]
                order.sort(key=lambda i: -min(len(parts[i]), max_tokens))
            found: list[Any] = [None] * len(texts_here)
            for start in range(0, len(order), batch_size):
                places = order[start:start + batch_size]
                answers = list(model([texts_here[i] for i in places]))
                if len(answers) != len(places):
                    raise RuntimeError(f"model returned {len(answers)} results for {len(places)} texts")
                for i, a in zip(places, answers):
                    found[i] = (a,) if single else tuple(a)
            scored = pd.DataFrame(found, columns=names, index=frame.index)
            yield pd.concat([frame, scored], axis=1)

    schema = T.StructType(texts.schema.fields + result.fields)
    if placed:
        return texts.mapInPandas(score, schema)
    if partitions is None and not stored:
        texts = materialise(texts, "model-texts")
    n = partitions or max(texts.sparkSession.sparkContext.defaultParallelism, -(-texts.count() // texts_per_task))
    return texts.repartition(n).mapInPandas(score, schema)


def run_resumable(
    texts: DataFrame,
    load_model: Callable[[], Any],
    result: T.StructType,
    batch_size: int,
    folder: str,
    texts_per_commit: int = TEXTS_PER_COMMIT,
    partitions: int | None = None,
    settled: Column | None = None,
    stored: bool = False,
) -> DataFrame:
    """:func:`run_model` whose answers are kept in ``folder`` as they come, by the key of their text.

    ``texts(text_key, text)`` has one row per key; ``stored`` says that it reads a stored table. Texts that the folder answers are not called
    again. The others go in parts of about ``texts_per_commit`` at most, and the answers of a part are
    appended when it is done; if a run stops, the next one with the same folder calls only what is
    missing. Few parts are a job each; many share :data:`MOST_ROUNDS` jobs, in which each part is a
    task whose files are moved to the folder as soon as it ends, so the number of jobs does not grow
    with the texts, and a job reads no texts but its own.
    ``settled`` says which answers count; others are asked again in a later run and replaced if that
    helps. The folder belongs to one model and stays until its owner removes it.
    """
    spark = texts.sparkSession
    schema = T.StructType([texts.schema["text_key"], *result.fields])
    good = settled if settled is not None else F.lit(True)
    texts = texts if stored else materialise(texts, "texts-to-answer", "zstd")

    def answered() -> DataFrame:
        if not is_stored(spark, folder):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(folder)

    done = answered().filter(good).select("text_key")
    n = texts.select("text_key").join(done, "text_key", "left_anti").count()
    parts = -(-n // texts_per_commit)
    rounds = min(parts, MOST_ROUNDS)
    dealt, of_round = texts.select("text_key", "text"), F.pmod(F.xxhash64("text_key"), F.lit(max(rounds, 1))).cast("int")
    path = scratch_path(spark, "dealt-texts")
    if rounds > 1:
        dealt.withColumn("_round", of_round).write.option("compression", "zstd").partitionBy("_round").parquet(path)
    for part in range(rounds):
        if rounds > 1 and not is_stored(spark, f"{path}/_round={part}"):
            continue
        asked = dealt if rounds == 1 else spark.read.schema(dealt.schema).parquet(f"{path}/_round={part}")
        per_task = min(texts_per_commit, TEXTS_PER_TASK) if parts > rounds else TEXTS_PER_TASK
        tasks = partitions or spark.sparkContext.defaultParallelism
        if parts > rounds or partitions is None:
            tasks = max(tasks, -(-n // (rounds * per_task)))
        # One shuffle spreads the texts and leaves out those with an answer: the keys are hashes already.
        asked = asked.repartition(tasks, "text_key").join(done.filter(of_round == part), "text_key", "left_anti")
        # The second version of the output committer moves the files of a task when it ends, not at the end of the job.
        run_model(asked, load_model, result, batch_size, placed=True).select(schema.fieldNames()).write.option(
            "mapreduce.fileoutputcommitter.algorithm.version", "2").option("compression", "zstd").mode("append").parquet(folder)
    remove_stored(spark, path)
    mine = answered().join(texts.select("text_key"), "text_key", "left_semi")
    sure = mine.filter(good).dropDuplicates(["text_key"])
    rest = mine.filter(~F.coalesce(good, F.lit(False))).dropDuplicates(["text_key"]).join(sure.select("text_key"), "text_key", "left_anti")
    both = sure.unionByName(rest).join(texts, "text_key")
    others = [c for c in texts.columns if c not in ("text_key", "text")]
    return both.select("text_key", "text", *result.fieldNames(), *others)


def score_texts(
    df: DataFrame,
    text_col: str,
    load_model: Callable[[], Any],
    result: T.StructType,
    batch_size: int = 32,
    spread_by: Sequence[str] = ("row_index",),
    partitions: int | None = None,
    hot_rows: int = HOT_ROWS,
    **run_options: Any,
) -> DataFrame:
    """Add model columns to every row of ``df``; each distinct text is scored once.

    The scored texts are stored before they are joined back, so neither a
    second consumer nor a lost executor calls the model again.
    """
    scored = materialise(
        run_model(distinct_texts(df.filter(F.col(text_col).isNotNull()), text_col), load_model, result, batch_size,
                  partitions, **run_options)
        .withColumn("text_key", text_key(F.col("text"))).drop("text"),
        "scored-texts",
    )
    return attach_by_key(
        df.withColumn("text_key", text_key(F.col(text_col))),
        scored.drop("n_rows"), "text_key", scored.select("text_key", "n_rows"), spread_by, hot_rows,
    ).drop("text_key")
