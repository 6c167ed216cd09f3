"""Costs that grew too fast, fifth part: memory of the tasks, disk of steps that listed what they only summed."""

import os
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from chatlens.functions.words import WordSplitter, word_characters
from chatlens.operators import scoring, translate
from chatlens.session import stored_tables
from chatlens.topics import spectral, terms

LETTERS = "abcdefghijklmnopqrstuvwxyz"


@pytest.fixture(scope="module")
def batch():
    """One Arrow batch of 24 MB of texts, as a task gets them."""
    rng = random.Random(7)
    words = ["".join(rng.choices(LETTERS, k=rng.randrange(2, 10))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=600)) for _ in range(6000)]
    n = len(texts)
    return pa.record_batch({
        "message_role": pa.array(["user", "assistant", None] * (n // 3)), "topic_id": pa.array([i % 7 - 1 for i in range(n)], pa.int32()),
        "text": pa.array(texts)})


def peak_mb(run):
    tracemalloc.start()
    try:
        found = run()
        return found, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_counting_takes_memory_by_piece_and_not_by_batch(spark, batch):
    characters = word_characters(spark)
    assert batch.nbytes > 20e6

    def run():
        counts = rows = 0
        for part in terms._term_lists(iter([batch]), lambda: WordSplitter(characters, []), 64):
            counts += sum(len(x) for x in part["tf"])
            rows += part.num_rows
        return counts, rows

    (counts, rows), mb = peak_mb(run)
    assert counts > 1e6
    # A row for each part and piece, whatever the number of topics.
    assert rows <= 64 * 16
    assert mb < 200


def test_similarities_take_memory_by_piece_and_not_by_batch(spark, batch):
    characters, n = word_characters(spark), batch.num_rows
    rows = pa.table(batch).append_column("row_index", pa.array(range(n))).append_column("example", batch["text"]).append_column(
        "_terms", pa.array([["alpha", "beta gamma"]] * n)).append_column("_weights", pa.array([[1.0, 2.0]] * n)).append_column("_l", pa.array([1.0] * n))
    batches = rows.combine_chunks().to_batches()
    found, mb = peak_mb(lambda: sum(b.num_rows for b in terms._similarities(iter(batches), lambda: WordSplitter(characters, []))))
    assert found == n
    assert mb < 200


def test_parts_of_terms_grow_with_the_messages(spark, tmp_path, monkeypatch):
    rows = [("user", i % 3, " ".join(f"{a}{i % 50}word" for a in LETTERS)) for i in range(2000)]
    df = spark.createDataFrame(rows, "message_role string, topic_id int, text string")
    df.write.parquet(f"{tmp_path}/few")
    for _ in range(4):
        df.write.mode("append").parquet(f"{tmp_path}/many")
    few, many = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("few", "many"))
    # Small tables and those of unknown size have the least number.
    assert terms._parts(few) == terms._parts(df) == terms.LEAST_PARTS
    want = {tuple(r) for r in terms.term_table(few, "text", []).collect()}
    monkeypatch.setattr(terms, "LEAST_PARTS", 1)
    monkeypatch.setattr(terms, "PART_BYTES", 200)
    assert 16 < terms._parts(few) < terms._parts(many) <= terms.MOST_PARTS
    assert want and {tuple(r) for r in terms.term_table(few, "text", []).collect()} == want


def brute_average(x, groups, values, radius):
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    w = np.where((d <= radius * radius) & (groups[:, None] == groups[None]), np.exp(-2 * d / radius**2), 0.0)
    return w @ values / w.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("block, at_once", [(7, 3), (2048, 256)])
def test_diffusion_stores_no_pairs(spark, monkeypatch, block, at_once):
    monkeypatch.setattr(spectral, "BLOCK", block, raising=False)
    monkeypatch.setattr(spectral, "AT_ONCE", at_once, raising=False)
    rng = np.random.default_rng(2)
    # One crowded place, a few far points, and some that are equal.
    x = np.concatenate([rng.normal(0, 0.1, (110, 2)), rng.normal(0, 2, (20, 2))])
    x = np.concatenate([x, x[:9]])
    groups = np.array(["a", "b"])[np.arange(len(x)) % 2]
    df = spark.createDataFrame([(i, str(g), v.tolist()) for i, (g, v) in enumerate(zip(groups, x))], "id long, g string, c array<double>")
    stored, materialise = {}, spectral.materialise
    monkeypatch.setattr(spectral, "materialise", lambda t, name, *a: stored.setdefault((name, len(stored)), materialise(t, name, *a)))
    got = np.array([r.diffused for r in spectral.diffused(df, "c", "id", 0.5, 2, ["g"], steps=2).orderBy("id").collect()])
    want = brute_average(x, groups, brute_average(x, groups, x, 0.5), 0.5)
    assert np.allclose(got, want)
    # Thousands of pairs are within the radius; no stored table has more rows than there are points.
    assert max(t.count() for t in stored.values()) <= len(x)


def test_resumable_translation_stores_each_text_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scoring, "MOST_ROUNDS", 3)
    rows = [(i, f"the text number {i % 30} is here and it is fine" if i % 2 else f"mujhe batao kya hai the text {i % 30} and it is here with the words") for i in range(80)]
    messages = spark.createDataFrame(rows + [(90, None), (91, " ")], "row_index long, user_msg string")
    stored = {}
    for module in (scoring, translate):
        plain = module.materialise
        monkeypatch.setattr(module, "materialise", lambda t, name, *a, plain=plain: stored.setdefault(name, plain(t, name, *a)))
    folder = f"{tmp_path}/answers"
    load, words = translate.WordTranslator, {"mujhe": "me", "batao": "tell", "kya": "what", "hai": "is"}
    with stored_tables(spark) as scope:
        run = translate.translate_messages(
            messages, lambda: load({}), lambda: load(words), resume=folder, texts_per_commit=4)
        got = {r.row_index: r.user_msg_en for r in run.messages.collect()}
        texts, first = run.texts.collect(), stored["translation-first"].collect()
        kept = [f for f in os.listdir(scope.removeprefix("file:")) if not f.startswith(".")]
    assert got[0] == "me tell what is the text 0 and it is here with the words" and got[1] == rows[1][1] and got[90] == got[91] == "" and len(got) == 82
    assert sorted(r.text for r in texts) == sorted({t for _, t in rows})
    assert all(r.text_en == " ".join(words.get(w, w) for w in r.text.split()) for r in texts)
    # The answers are kept by key, and the texts beside them only where they are called again.
    assert {"text_key", "text_en"} <= set(spark.read.parquet(f"{folder}/first").columns) and "text" not in spark.read.parquet(f"{folder}/first").columns
    assert all((r.text is not None) == r.needs_retranslation for r in first) and {r.needs_retranslation for r in first} == {True, False}
    # No copy of the texts for the calls, no table of all texts and answers; what was dealt over the jobs is deleted.
    assert not {"texts-to-answer", "translation-texts"} & set(stored)
    assert not [f for f in kept if f.startswith(("open-texts", "dealt-texts"))]
