"""Costs that grew too fast, fourth part: terms counted and put together in Arrow."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chatlens.functions.words import WordSplitter, word_characters
from chatlens.topics import terms

ROWS = [("user", 0, "Cats see dogs, cats see"), ("user", 1, "cats see a bird"), ("user", -1, "cats see cats"), ("user", None, "cats"),
        ("bot", 0, "cats fly"), ("bot", 0, "cats fly"), ("bot", -1, "old bird"), ("bot", -1, "old bird"), (None, 0, "cats cats"), ("bot", 2, None)]
DOCS = "message_role string, topic_id int, text string"


def test_splitter_gives_the_words_of_the_pattern(spark):
    rng = random.Random(1)
    characters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(characters[i:i + 90]) for i in range(0, len(characters), 90)]
    texts += ["".join(rng.choice("ab é中𐍈-1_ \n𝟘İ") for _ in range(rng.randrange(12))) for _ in range(500)] + [None, "", "the a", "x", "The end"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("i", F.lower("t").alias("low"), terms.kept_words(F.col("t")).alias("w")).orderBy("i").collect()
    splitter, low = WordSplitter(word_characters(spark), terms.STOPWORDS), pa.array([r.low for r in rows])
    assert splitter(low).to_pylist() == [r.w for r in rows]
    assert splitter(low[5:60]).to_pylist() == [r.w for r in rows[5:60]]
    assert splitter(low[:0]).to_pylist() == []


@pytest.mark.parametrize("unit, pairs", [("message", {"cats see", "cats fly", "old bird"}), ("topic", {"cats see"})])
def test_terms_are_shuffled_as_lists_and_put_together_by_part(spark, monkeypatch, unit, pairs):
    docs = spark.createDataFrame(ROWS, DOCS).repartition(3)
    plans, materialise = [], terms.materialise
    monkeypatch.setattr(terms, "materialise", lambda df, name: plans.append(df) or materialise(df, name))
    table = terms.term_table(docs, "text", [], min_docs=2, max_share=1.0, df_unit=unit).collect()
    plan = plans[0]._jdf.queryExecution().executedPlan().toString()
    # No row per term crosses the network.
    assert "FlatMapGroupsInArrow" in plan and "regexp_extract_all" not in plan
    assert {r.term for r in table if " " in r.term} == pairs
    got = {(r.message_role, r.topic_id): (r.tf, r.docs, r.df, r.f) for r in table if r.term == "cats"}
    df = {"message": {"user": 4, "bot": 2}, "topic": {"user": 2}}[unit]
    want = {("user", 0): (2, 1), ("user", 1): (1, 1), ("user", -1): (2, 1), ("user", None): (1, 1), ("bot", 0): (2, 2)}
    assert got == {k: (*v, df[k[0]], 3 if k[0] == "user" else 2) for k, v in want.items() if k[0] in df}
    if unit == "message":
        # Said by outliers only: no count within topics.
        assert {(r.topic_id, r.tf, r.docs, r.df, r.f) for r in table if r.term == "old bird"} == {(-1, 2, 2, 2, None)}


@pytest.mark.parametrize("largest", [1, 1 << 62])
def test_named_terms_are_found_in_their_rows(monkeypatch, largest):
    monkeypatch.setattr(terms, "LARGEST_NUMBER", largest)
    said = terms._Said(pa.array([["a", "b", "a", "b"], [], ["b", "a"]], pa.list_(pa.string())))
    names = ["a", "a b", "b a", "b b", "zz", "a zz", "zz a"]
    rows = [r for r in range(3) for _ in names]
    assert said.times_of(pa.array(rows).to_numpy(), pa.array(names * 3)).tolist() == [2, 2, 1, 0, 0, 0, 0] + [0] * 7 + [1, 0, 1, 0, 0, 0, 0]
    assert terms._Said(pa.array([[]], pa.list_(pa.string()))).times_of(pa.array([0]).to_numpy(), pa.array(["a"])).tolist() == [0]


def test_representatives_are_scored_in_arrow(spark):
    docs = spark.createDataFrame([(i, *row) for i, row in enumerate(ROWS)], "row_index long, " + DOCS)
    ranked = spark.createDataFrame([("user", 0, 1, "cats see", 3.0), ("user", 0, 2, "dogs", 4.0), ("bot", 0, 1, "fly", 2.0), ("bot", 2, 1, "fly", 2.0)],
                                   "message_role string, topic_id int, rank int, term string, weight double")
    found = terms.representative_by_terms(docs, "text", ranked, 2, [])
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    got = [(r.message_role, r.topic_id, r["rank"], r.row_index, r.example, round(r.similarity, 9)) for r in found.collect()]
    # Words cats 2, see 2, dogs 1; pairs cats see 2, see dogs 1, dogs cats 1.
    assert sorted(got) == [("bot", 0, 1, 4, "cats fly", round(3 ** -0.5, 9)), ("bot", 0, 2, 5, "cats fly", round(3 ** -0.5, 9)),
                           ("bot", 2, 1, 9, None, 0.0), ("user", 0, 1, 0, "Cats see dogs, cats see", round(10 / (15 ** 0.5 * 5), 9))]
