"""Lexicon lemmas, messages that say most of a topic, token budgets, resumable calls, additive states."""

import math
import os
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlens.functions import text as tx
from chatlens.operators import scoring, sentiment, states, summary, translate
from chatlens.session import scratch_path
from chatlens.topics import terms


# --- lemmas ----------------------------------------------------------------------

def test_lemmas_are_confirmed_by_the_lexicon(spark):
    lexicon = spark.createDataFrame([(w,) for w in "class cat wolf box church dish man city bus lens gas go s".split()] + [("cat",), (None,)], "word string")
    exceptions = spark.createDataFrame([("oxen", "ox"), ("went", "go"), ("went", "goes"), ("lens", "lentil")], "form string, lemma string")
    forms = "classes cats wolves boxes churches dishes men cities bus lens oxen went xyzs gases s unknown Cats".split()
    words = spark.createDataFrame([(f,) for f in forms] + [("cats",), (None,), ("",)], "form string")
    got = {r.form: r.lemma for r in tx.lexicon_lemmas(words, lexicon, exceptions).collect()}
    assert got == {
        "classes": "class", "cats": "cat", "wolves": "wolf", "boxes": "box", "churches": "church", "dishes": "dish", "men": "man",
        "cities": "city", "bus": "bus", "lens": "lentil", "oxen": "ox", "went": "go", "gases": "gas", "s": "s"}
    rows = [(1, "the Cats saw  wolves"), (2, ""), (3, None), (4, "cats cats")]
    df = spark.createDataFrame(rows, "row_index long, lemmas string").withColumn("form", F.lit("x"))
    out = {r.row_index: r.lemmas for r in tx.lemmatise_by_lexicon(df, "row_index", "lemmas", lexicon).collect()}
    assert out == {1: "the Cats saw wolf", 2: "", 3: "", 4: "cat cat"}
    assert tx.lexicon_lemmas(words.limit(0), lexicon).count() == 0
    assert tx.lexicon_lemmas(words, lexicon.limit(0), exceptions.limit(0)).count() == 0


# --- representative messages -------------------------------------------------------

def test_messages_that_say_most_of_a_topic(spark):
    rows = [(1, "user", 0, "apple pear apple"), (2, "user", 0, "apple"), (3, "user", 0, ""), (4, "user", 0, None), (5, "user", -1, "apple"),
            (6, "user", 1, "plum"), (7, "user", 2, "kiwi"), (8, "user", 0, "apple")]
    docs = spark.createDataFrame(rows, "row_index int, message_role string, topic_id int, text string")
    ranked = spark.createDataFrame([("user", 0, 1, "apple", 2.0), ("user", 0, 2, "pear", 1.0), ("user", 1, 1, "fig", 1.0)],
                                   "message_role string, topic_id int, rank int, term string, weight double")
    got = [(r.topic_id, r["rank"], r.row_index, r.similarity) for r in terms.representative_by_terms(docs, "text", ranked, 3, []).collect()]
    # Of message 1: apple twice, pear, and the pairs "apple pear" and "pear apple".
    one = (2 * 2 + 1) / (math.sqrt(4 + 1 + 1 + 1) * math.sqrt(5))
    alone = 2 / math.sqrt(5)
    want = [(0, 1, 2, alone), (0, 2, 8, alone), (0, 3, 1, one), (1, 1, 6, 0.0)]
    assert [g[:3] for g in sorted(got)] == [w[:3] for w in want]
    assert [g[3] for g in sorted(got)] == pytest.approx([w[3] for w in want])
    assert terms.representative_by_terms(docs.limit(0), "text", ranked).count() == 0


# --- token budget ----------------------------------------------------------------

RESULT = T.StructType([T.StructField("seen", T.StringType()), T.StructField("batch", T.ArrayType(T.IntegerType()))])


def test_models_see_a_budget_of_tokens(spark):
    class EchoModel:
        """Answers with the text it was given and the lengths in its batch."""

        def predict(self, texts):
            return [(t, [len(t) for t in texts]) for t in texts]

    class LetterTokenizer:
        """Counts every letter as a token."""

        def encode(self, text):
            return list(text)

        def decode(self, tokens):
            return "".join(tokens)

    texts = ["a b  c d e", "a  b c", "x" * 50, "", "short"] + ["w " * n for n in range(1, 40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row_index long, text string")
    whole = {r.text: r.seen for r in scoring.run_model(df, EchoModel, RESULT, 4, 1).collect()}
    assert all(text == seen for text, seen in whole.items())
    words = {r.text: r.seen for r in scoring.run_model(df, EchoModel, RESULT, 4, 1, max_tokens=4).collect()}
    assert words["a b  c d e"] == "a b c d" and words["a  b c"] == "a  b c" and words["x" * 50] == "x" * 50
    rows = scoring.run_model(df, EchoModel, RESULT, 4, 1, max_tokens=7, load_tokenizer=LetterTokenizer).collect()
    assert len(rows) == len(texts) and all(r.seen == r.text[:7] for r in rows)
    # Batches hold texts of like length, the longest first.
    assert all(r.batch == sorted(r.batch, reverse=True) for r in rows)
    assert sum(len(set(r.batch)) > 1 for r in rows) <= 2 * 4


def test_sentiment_input_is_cut_by_default(spark):
    long = spark.createDataFrame([(1, "user", "u", None, "good " * 2000), (2, "user", "u", None, "fine"), (3, "user", "u", None, " ")],
                                 "row_index long, role string, whatsapp_id string, datetime string, text string")

    class Words:
        def predict(self, texts):
            return [(f"{min(len(t.split()), 512)} stars", float(len(t.split()))) for t in texts]

    got = {r.message[:4]: r.sentiment_score for r in sentiment.sentiment_messages(long, Words).collect()}
    assert got == {"good": 512.0, "fine": 1.0}
    free = sentiment.sentiment_messages(long, Words, max_tokens=None).collect()
    assert max(r.sentiment_score for r in free) == 2000.0


# --- resumable calls ---------------------------------------------------------------

def loader(folder, limit):
    """A model that notes every call in a file and cannot be loaded any more after ``limit`` calls."""
    path = os.path.join(folder, "calls")

    def load():
        with open(path, "a+") as calls:
            calls.seek(0)
            if limit is not None and len(calls.readlines()) >= limit:
                raise RuntimeError("stopped half way")

        def model(batch):
            with open(path, "a") as calls:
                calls.writelines(t + "\n" for t in batch)
            return [(t.upper(), 1, 1) for t in batch]

        return model

    return load, path


def test_a_stopped_translation_calls_no_text_twice(spark, tmp_path):
    rows = [(i, f"some text number {i % 60}") for i in range(90)]
    messages = spark.createDataFrame(rows, "row_index long, user_msg string")
    folder = scratch_path(spark, "resume")
    first, path = loader(str(tmp_path), 20)
    options = {"partitions": 2, "resume": folder, "texts_per_commit": 10}
    with pytest.raises(Exception, match="stopped half way"):
        translate.translate_messages(messages, first, first, **options)
    done = Counter(open(path).read().splitlines())
    assert 20 <= len(done) < 60
    second, _ = loader(str(tmp_path), None)
    run = translate.translate_messages(messages, second, second, **options)
    got = {r.row_index: r.user_msg_en for r in run.messages.collect()}
    assert got == {i: t.upper() for i, t in rows}
    calls = Counter(open(path).read().splitlines())
    assert len(calls) == 60 and max(calls.values()) == 1
    stats = translate.translation_stats(run).first()
    assert stats.api_calls == 60 and stats.input_tokens == 60
    # A third run, with more messages, calls only the new text.
    more = messages.unionByName(spark.createDataFrame([(1000, "a new text")], messages.schema))
    again = translate.translate_messages(more, second, second, **options)
    assert again.messages.count() == 91
    assert Counter(open(path).read().splitlines()) == calls + Counter(["a new text"])


def test_failed_calls_are_asked_again(spark):
    folder = scratch_path(spark, "resume")
    messages = spark.createDataFrame([(1, "one good text"), (2, "bad text here"), (3, None)], "row_index long, user_msg string")

    class Failing:
        def __call__(self, texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("refused")
            return [("fine words", 1, 1) for _ in texts]

    class Working:
        def __call__(self, texts):
            return [("fine words now", 1, 1) for _ in texts]

    once = translate.translate_messages(messages, Failing, Failing, resume=folder)
    assert translate.translation_stats(once).first().failed_calls == 1
    run = translate.translate_messages(messages, Working, Working, resume=folder)
    assert {r.row_index: r.user_msg_en for r in run.messages.collect()} == {1: "fine words", 2: "fine words now", 3: ""}
    assert translate.translation_stats(run).first().failed_calls == 0


# --- additive states ---------------------------------------------------------------

def test_states_of_parts_add_up(spark):
    rows = [("2024-01-01 23:00:00", "a", "x", "user", "1 star"), ("2024-01-02 01:00:00", "a", None, "user", "1 star"),
            ("2024-01-02 02:00:00.5", "b", "x", "assistant", "2 stars"), (None, "c", "y", "user", "1 star"),
            ("not a time", None, "y", "user", None), ("2024-01-02 01:00:00", "a", None, "user", "1 star")]
    df = spark.createDataFrame(rows, "datetime string, whatsapp_id string, cal_state string, role string, sentiment_label string")
    df = df.withColumn("datetime", F.col("datetime").try_cast("timestamp_ntz"))
    parts = [df.limit(0), df.filter("whatsapp_id = 'a'"), df.filter("whatsapp_id is null or whatsapp_id <> 'a'")]
    for order in (parts, parts[::-1]):
        state = states.merged([states.message_state(p) for p in order])
        nested = states.merged([states.merged([states.message_state(p) for p in order[:2]]), states.message_state(order[2])])
        assert states.overview_of(state).collect() == states.overview_of(nested).collect() == summary.datetime_overview(df).collect()
        assert sorted(states.cal_state_of(state).collect(), key=str) == sorted(summary.cal_state_by_user(df).collect(), key=str)
        moods = states.merged([states.mood_state(p) for p in order])
        assert sorted(states.sentiment_counts_of(moods).collect(), key=str) == sorted(sentiment.sentiment_counts(df).collect(), key=str)
    assert states.overview_of(states.message_state(df.limit(0))).collect() == summary.datetime_overview(df.limit(0)).collect()
    assert states.message_state(df.drop("cal_state")).filter("cal_state is null").count() == 5


def test_a_state_is_smaller_than_its_messages(spark):
    many = spark.range(20_000).select(
        F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("datetime"), (F.col("id") % 7).cast("string").alias("whatsapp_id"),
        F.lit("x").alias("cal_state"))
    state = states.message_state(many)
    assert state.count() == 7 * 14 and state.agg(F.sum("n")).first()[0] == 20_000


def test_many_parts_share_a_few_jobs_and_are_kept_one_by_one(spark, tmp_path, monkeypatch):
    texts = spark.createDataFrame([(f"k{i}", f"text {i}") for i in range(200)], "text_key string, text string")
    result = T.StructType([T.StructField("n", T.LongType())])
    jobs, run_model = [], scoring.run_model
    monkeypatch.setattr(scoring, "run_model", lambda *a, **b: jobs.append(1) or run_model(*a, **b))
    marker = str(tmp_path / "failed")

    def load():
        def model(batch):
            if "text 7" in batch and not os.path.exists(marker):
                time.sleep(5)  # the other parts of this job end meanwhile
                open(marker, "w").close()
                raise RuntimeError("stopped half way")
            return [len(t) for t in batch]

        return model

    folder = scratch_path(spark, "resume")
    with pytest.raises(Exception, match="stopped half way"):
        scoring.run_resumable(texts, load, result, 4, folder, texts_per_commit=2)
    kept = spark.read.parquet(folder).count()
    before = len(jobs)
    # Of the jobs before the last all is kept, of the last one the parts that had ended.
    assert kept > 0 and before <= scoring.MOST_ROUNDS
    out = scoring.run_resumable(texts, load, result, 4, folder, texts_per_commit=2)
    assert {r.text_key: r.n for r in out.collect()} == {f"k{i}": len(f"text {i}") for i in range(200)}
    assert len(jobs) - before <= scoring.MOST_ROUNDS
    assert spark.read.parquet(folder).count() == 200
