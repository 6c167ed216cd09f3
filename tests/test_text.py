import re

import pytest
from pyspark.sql import functions as F

from chatlens import fixed_values as fv
from chatlens.functions import text as tx
from chatlens.operators.report import highlight, keyword_variants


def one(spark, build, *values, kind="string"):
    """Evaluate a Column builder on each value."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", build(F.col("x")).alias("y")).orderBy("i").collect()]


def test_blank_characters_are_those_of_unicode():
    assert set(fv.BLANK_CHARS) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


SAMPLES = [None, "", "   ", " ", " a  b\t\nc ", "\x1ca\x1fb", "one", "　x y "]


def test_strip_tokens_and_counts_follow_python(spark):
    plain = [s or "" for s in SAMPLES]
    assert one(spark, tx.strip, *SAMPLES) == [s.strip() for s in plain]
    assert one(spark, tx.tokens, *SAMPLES) == [s.split() for s in plain]
    assert one(spark, tx.token_count, *SAMPLES) == [len(s.split()) for s in plain]


def test_length_counts_code_points(spark):
    assert one(spark, F.length, "a\U0001f600") == [2]


@pytest.mark.parametrize("text,expected", [
    ("ok ok a ok", "ok a ok"), ("ok", "ok"), ("  ", "  "), ("a\na  b", "a b"), ("ok okay okay", "ok okay"),
    ("book ok ok", "book ok"), ("ok " * 20000, "ok"),
])
def test_collapse_repeats(spark, text, expected):
    assert one(spark, tx.collapse_repeats, text) == [expected]


def test_preprocess(spark):
    texts = ["See https://x.org/a?b=1 NOW", "mail a.b@c.d please", "@b c@ @@ a@@ x", "id 123 a1b 4५6 x", "A  \n B", None]
    assert one(spark, tx.preprocess, *texts) == ["see now", "mail please", "@b c@ @@ x", "id a1b x", "a b", ""]


def test_email_rule_is_linear_on_long_runs(spark):
    assert one(spark, tx.preprocess, "x" * 200_000) == ["x" * 200_000]


def test_phrases_apply_in_order(spark):
    texts = ["team register now", "bb program deadline", "my business ideas", "build product or make product", "nothing"]
    assert one(spark, tx.merge_phrases, *texts) == [
        "team_registration now", "bb program_deadline", "my business ideas", "make_product or make_product", "nothing"]


def test_lemmas(spark):
    assert one(spark, tx.lemmatise, "classes cities boxes women us bus times women's 's") == [
        "class city box woman us bus time women's 's"]


def test_lemmas_of_words_with_a_silent_e(spark):
    words = ("houses courses purposes cases responses exercises sizes prizes series species movies always news branches wishes "
             "boxes passes quizzes buses stories ties heroes menus bias axes places changes")
    want = ("house course purpose case response exercise size prize series species movie always news branch wish "
            "box pass quiz bus story tie hero menu bias ax place change")
    assert one(spark, tx.lemmatise, words) == [want]


def test_clean_message_with_a_dictionary(spark):
    words = spark.createDataFrame([("ran", "run"), ("dogs", "dogge"), ("dogs", "dog"), ("please", "please")], "form string, lemma string")
    rows = spark.createDataFrame([(1, "Dogs ran FAR far 12"), (2, ""), (3, None), (4, "please provide the text")], "row_index int, t string")
    got = {r.row_index: r.cleaned for r in tx.clean_message(rows, "t", dictionary=words).collect()}
    assert got == {1: "dog run far", 2: "", 3: "", 4: ""}
    many = spark.range(3000).select(F.col("id").alias("row_index"), F.lit("dogs ran").alias("t"))
    assert {r.cleaned for r in tx.clean_message(many, "t", dictionary=words).collect()} == {"dog run"}


def test_lemma_dictionary_of_any_size(spark):
    words = spark.createDataFrame([("ran", "run"), ("dogs", "dog")], "form string, lemma string")
    rows = spark.createDataFrame([(1, "dogs ran far"), (2, "")], "id int, t string")
    assert {r.id: r.t for r in tx.lemmatise_with(rows, "id", "t", words).collect()} == {1: "dog run far", 2: ""}


def test_assistant_like(spark):
    texts = ["Please provide the text", "now SUMMARISE this", "surely", "sure thing", "upload idea", "share details", "", None]
    assert one(spark, tx.is_assistant_like, *texts) == [True, True, False, True, True, True, False, False]


def test_truncate_and_squeeze(spark):
    assert one(spark, lambda c: tx.truncate_tokens(c, 2), "a  b", "a  b c") == ["a  b", "a b"]
    assert one(spark, tx.squeeze, " a\t\tb\nc ") == ["a b\nc"]


def test_clean_message_blanks_assistant_text(spark):
    rows = spark.createDataFrame([("Sure here it is",), ("Team register 12 please",)], "t string")
    assert [r.cleaned for r in tx.clean_message(rows, "t").collect()] == ["", "team_registration please"]


# --- language rules against a plain restatement -----------------------------------

def ratio(text):
    words = re.findall("[a-z]+", text.lower())
    known = [w for w in words if w in fv.ENGLISH_WORDS or w.rstrip("s") in fv.ENGLISH_WORDS]
    return len(known) / len(words) if words else 0.0


def hindi(text):
    hits = sum(w in fv.ROMANISED_HINDI_WORDS for w in re.findall("[a-z]+", text.lower()))
    return hits >= 2 or (hits == 1 and ratio(text) < 0.3)


def test_language_flags(spark):
    texts = ["mujhe batao", "hello kya friend", "the kya is what to do", "what is the time", "times classs", "नमस्ते",
             "café is the one", ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r for r in tx.add_language_flags(rows, "t").collect()}
    for i, t in enumerate(texts):
        assert got[i].english_ratio == pytest.approx(ratio(t))
        assert got[i].is_romanised_hindi == hindi(t)
        assert got[i].is_english == (bool(t) and t.isascii() and ratio(t) >= 0.4)
        assert got[i].has_indic == any(0x900 <= ord(c) <= 0xD7F for c in t)


@pytest.mark.parametrize("original,translated,expected", [
    ("नमस्ते", "Hello", False), ("नमस्ते", "नमस्ते", True), ("hi", "", True), ("", "", False), (None, None, False),
    ("hello there", "123", True), ("what is the time", "time samay kya", True), ("what is the time", "what is the time", False),
    ("mujhe batao kya", "mujhe batao kya", False), ("what is the time", "mujhe kya time is the what", True),
])
def test_needs_retranslation(spark, original, translated, expected):
    rows = spark.createDataFrame([(original, translated)], "o string, t string")
    out = tx.flag_retranslation(rows, "o", "t")
    assert out.first().needs_retranslation is expected
    assert out.columns == ["o", "t", "needs_retranslation"]


def test_keyword_variants_and_nested_highlight(spark):
    got = one(spark, keyword_variants, "idea, team_make", None)
    assert set(got[0]) == {"idea", "ideas", "ideaed", "ideaing", "ideament", "team_make", "team make", "team_makes",
                           "team_makeed", "team_makeing", "team_maked", "team_making", "team_makion", "team_makement"}
    assert [len(v) for v in got[0]] == sorted((len(v) for v in got[0]), reverse=True)
    assert got[1] == []
    terms = F.array(F.lit("business idea"), F.lit("idea"))
    assert one(spark, lambda c: highlight(c, terms), "My Business Idea, ideas", " ") == [
        "My <mark>Business <mark>Idea</mark></mark>, ideas", ""]


def test_escape_clip_and_iso(spark):
    assert one(spark, tx.escape_cell, "a|b\nc", None) == ["a\\|b c", ""]
    assert one(spark, tx.clip, "x" * 75, "x" * 76) == ["x" * 75, "x" * 75 + "..."]
    iso = lambda c: tx.iso_datetime(c.cast("timestamp_ntz"))
    assert one(spark, iso, "2024-01-02 03:04:05", "2024-01-02 03:04:05.5") == [
        "2024-01-02T03:04:05", "2024-01-02T03:04:05.500000"]
