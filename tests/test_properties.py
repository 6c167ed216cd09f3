"""Randomised checks of text rules and vectors against plain restatements."""

import itertools
import re
from types import SimpleNamespace

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from chatlens.functions import text as tx
from chatlens.operators import cleaning, translate
from chatlens.session import shared_dir
from chatlens.topics import terms, vectors

ALPHABET = "aAbs zZ09._@'/:-\t\n\x1c    éßनम२ि"
SETTINGS = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))


def collapse(parts):
    return " ".join(k for k, _ in itertools.groupby(parts))


def prepared(text):
    text = re.sub(r"\S+@\S+", "", re.sub(r"https?://[!$-_a-z]+", "", text))
    text = re.sub(r"\s+", " ", re.sub(r"\b\d+\b", "", text)).lower().strip()
    return collapse(text.split())


@SETTINGS
@given(st.lists(st.text(ALPHABET, max_size=40), min_size=40, max_size=80))
def test_text_rules_on_random_text(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    x = F.col("x")
    got = rows.select(
        "i", tx.strip(x).alias("s"), tx.tokens(x).alias("t"), tx.token_count(x).alias("n"), tx.collapse_repeats(x).alias("c"),
        tx.preprocess(x).alias("p"), terms.vocabulary_words(x).alias("v"), tx.truncate_tokens(x, 2).alias("u"),
        tx.squeeze(x).alias("q"),
    ).collect()
    for r in got:
        text = texts[r.i]
        parts = text.split()
        assert r.s == text.strip() and r.t == parts and r.n == len(parts)
        assert r.c == (collapse(parts) if parts else text)
        assert r.p == prepared(text)
        assert r.v == re.findall(r"\b\w\w+\b", text.lower())
        assert r.u == (" ".join(parts[:2]) if len(parts) > 2 else text)
        assert r.q == re.sub(r"\s\s+", " ", text).strip()


def test_reduction_equals_numpy(spark):
    rng = np.random.default_rng(4)
    data = rng.normal(size=(80, 8)) * np.arange(8, 0, -1)
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(data)], "i int, a array<double>")
    got = vectors.reduce_dimensions(df.withColumn("features", array_to_vector("a")), 3).orderBy("i").collect()
    values, axes = np.linalg.eigh(np.cov(data.T))
    want = data @ axes[:, np.argsort(values)[::-1][:3]]
    assert np.allclose(np.abs([r.reduced for r in got]), np.abs(want), atol=1e-8)


def test_representative_messages_equal_numpy(spark):
    rng = np.random.default_rng(6)
    data = rng.normal(size=(60, 5))
    df = spark.createDataFrame([(i, "user", i % 3, [float(v) for v in row]) for i, row in enumerate(data)],
                               "row_index int, message_role string, topic_id int, vector array<double>")
    got = vectors.representative_docs(df, vectors.stored_centroids(df), top=4).collect()
    for t in range(3):
        rows = np.arange(t, 60, 3)
        centre = data[rows].mean(axis=0)
        cosine = data[rows] @ centre / np.linalg.norm(data[rows], axis=1) / np.linalg.norm(centre)
        assert [r.row_index for r in sorted(got, key=lambda r: r.rank) if r.topic_id == t] == list(rows[np.argsort(-cosine)[:4]])


def test_shared_folder_is_fixed_for_the_session(spark):
    assert shared_dir(spark) == shared_dir(spark)


def _session_like(master, **settings):
    conf = SimpleNamespace(get=lambda key, default=None: settings.get(key, default), set=settings.__setitem__)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))


def test_shared_folder_must_be_named_on_a_cluster(tmp_path):
    with pytest.raises(RuntimeError):
        shared_dir(_session_like("yarn"))
    assert shared_dir(_session_like("yarn", **{"spark.checkpoint.dir": "hdfs:///work"})) == "hdfs:///work"
    local = _session_like("local[2]")
    assert shared_dir(local) == shared_dir(local)


def test_translation_with_a_text_on_a_third_of_the_rows(spark):
    rows = spark.range(30_000).select(
        F.col("id").alias("row_index"), F.when(F.col("id") % 3 == 0, "hello mera hai").otherwise(F.concat(F.lit("w "), F.col("id").cast("string"))).alias("user_msg"))
    words = {"mera": "my", "w": "word"}
    run = translate.translate_messages(rows, lambda: translate.WordTranslator(words), hot_rows=500)
    counts = {r.user_msg_en: r.n for r in run.messages.groupBy("user_msg_en").agg(F.count("*").alias("n")).filter("n > 1").collect()}
    assert counts == {"hello my hai": 10_000} and run.messages.count() == 30_000
    assert run.texts.count() == 20_001
    assert cleaning.dedup_first(run.messages, translate.DEDUP_KEYS).count() == 20_001
