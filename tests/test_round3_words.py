"""Costs that grew too fast, third part: words and terms of all texts."""

import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chatlens.functions import text as tx
from chatlens.topics import terms


def test_lexicon_lemmas_split_the_texts_once_for_the_words(spark, monkeypatch):
    rows = [(1, "the cats saw  wolves went"), (2, ""), (3, None), (4, "cats cats lens"), (5, "a cats"), (5, "b wolves"), (None, "cats")]
    df = spark.createDataFrame(rows, "row_index long, lemmas string")
    lexicon = spark.createDataFrame([(w,) for w in ("cat", "wolf", "the", "lens", "saw")], "word string")
    exceptions = spark.createDataFrame([("went", "go"), ("lens", None), ("gone", "go"), ("wolves", None), ("wolves", "w")], "form string, lemma string")
    stored, materialise = {}, tx.materialise
    monkeypatch.setattr(tx, "materialise", lambda t, name: stored.setdefault(name, materialise(t, name)))
    out = tx.lemmatise_by_lexicon(df, "row_index", "lemmas", lexicon, exceptions)
    got = sorted(((r.row_index, r.lemmas) for r in out.collect()), key=str)
    assert got == [(1, "the cat saw wolf go"), (2, ""), (3, ""), (4, "cat cat lens"), (5, "a b cat wolf"), (5, "a b cat wolf"), (None, "")]
    assert {r.form: r.n_rows for r in stored["word-counts"].collect()} == {
        "the": 1, "cats": 5, "saw": 1, "wolves": 2, "went": 1, "lens": 1, "a": 1, "b": 1}
    # Only words that change are looked up.
    assert {r.form: r.lemma for r in stored["lemmas"].collect()} == {"cats": "cat", "wolves": "wolf", "went": "go"}


def counted_plainly(rows):
    tf, docs = Counter(), Counter()
    for role, topic, words in rows:
        found = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
        tf.update((role, topic, t) for t in found)
        docs.update({(role, topic, t) for t in found})
    return {k: (n, docs[k]) for k, n in tf.items()}


@pytest.mark.parametrize("size", [1, 300, 1 << 25])
@pytest.mark.parametrize("largest", [1, 1 << 62])
def test_pieces_of_batches_count_all_terms(monkeypatch, size, largest):
    monkeypatch.setattr(terms, "COUNTED_BYTES", size)
    monkeypatch.setattr(terms, "LARGEST_NUMBER", largest)
    rng = random.Random(4)
    rows = [(rng.choice(["user", "bot", None]), rng.choice([-1, 0, 7, None]), [rng.choice("ab cd éf gh ij".split()) for _ in range(rng.randrange(9))])
            for _ in range(200)]
    schema = pa.schema([("message_role", pa.string()), ("topic_id", pa.int32()), ("words", pa.list_(pa.string()))])
    batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in part], schema) for part in (rows[:90], [], rows[90:], [("user", 0, [])])]
    tf, docs, pieces = Counter(), Counter(), 0
    for batch in terms._count_terms(iter(batches)):
        pieces += 1
        for r in batch.to_pylist():
            key = r["message_role"], r["topic_id"], r["term"]
            tf[key] += r["tf"]
            docs[key] += r["docs"]
    assert {k: (n, docs[k]) for k, n in tf.items()} == counted_plainly(rows)
    assert pieces == 1 if size > 300 else pieces > 5


def test_words_are_those_of_the_plain_pattern(spark):
    texts = ["a bc Dé x_1 _ __ १२ 中 中文 İx ßß a1-b2 ⅠⅡ", None, "", "zz"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.regexp_extract_all(F.lower(F.coalesce("t", F.lit(""))), F.lit(f"[{tx.fv.WORD_CLASS}]{{2,}}"), 0)
    assert all(r.a == r.b for r in df.select(plain.alias("a"), terms.vocabulary_words(F.col("t")).alias("b")).collect())


def test_terms_are_shuffled_once_and_only_heavy_ones_ranked(spark, monkeypatch):
    rng = random.Random(6)
    vocabulary = [f"word{i}" for i in range(60)]
    rows = [("user", i % 4 - 1, " ".join(rng.choices(vocabulary, [1 / (j + 1) for j in range(60)], k=30))) for i in range(200)]
    docs = spark.createDataFrame(rows, "message_role string, topic_id int, text string")
    plans, materialise = [], terms.materialise
    monkeypatch.setattr(terms, "materialise", lambda df, name: plans.append((df, name)) or materialise(df, name))
    table = terms.term_table(docs, "text", min_docs=2, max_share=1.0)
    plan = plans[0][0]._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "REPARTITION_BY_COL" in plan
    got = [(r.topic_id, r["rank"], r.term, round(r.weight, 9)) for r in terms.topic_terms(table, 7).collect()]
    counts = [r for r in table.collect() if r.topic_id != -1]
    mean = sum(r.tf for r in counts) / 3
    want = []
    for topic in range(3):
        best = sorted((-round(r.tf * math.log1p(mean / r.f), 9), r.term) for r in counts if r.topic_id == topic)[:7]
        want += [(topic, i, t, -w) for i, (w, t) in enumerate(best, 1)]
    assert sorted(got) == [(a, b, c, pytest.approx(w, abs=2e-9)) for a, b, c, w in want]
    assert [name for _, name in plans] == ["topic-terms", "lowest-steps"]
