"""Costs that grew too fast: rankings computed twice, text rules, codec of whole texts."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatlens.functions import text as tx
from chatlens.plans import fixtures as fx
from chatlens.plans import topic_queries
from chatlens.topics import terms


@pytest.mark.parametrize("name", ["supplied_labels", "supplied_to_final_labels"])
def test_terms_are_counted_and_ranked_once(spark, monkeypatch, name):
    words = "river stone cloud meadow garden winter window candle".split()
    rows = [(i, "user", i % 2, " ".join(words[(i + j) % 4 + 4 * (i % 2)] for j in range(5))) for i in range(16)]
    docs = spark.createDataFrame(rows, "row_index long, message_role string, topic_id int, text string")
    monkeypatch.setattr(fx, "topics_given", lambda *_: docs)
    stored, materialise = [], terms.materialise
    monkeypatch.setattr(terms, "materialise", lambda df, table: stored.append(table) or materialise(df, table))
    assert len(topic_queries.QUERIES[name](spark, "").collect()) == 2
    assert stored.count("topic-terms") == 1


def test_term_counts_equal_plain_python(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("apple pear plum fig a of".split()) for _ in range(rng.randrange(0, 30))) for _ in range(40)] + [None, "", "fig"]
    docs = spark.createDataFrame([("user", i % 3 - 1, t) for i, t in enumerate(texts)], "message_role string, topic_id int, text string")
    tf, df, f = {}, {}, {}
    for i, t in enumerate(texts):
        words = [w for w in re.findall(r"[^\W]{2,}", t or "") if w not in terms.STOPWORDS]
        found = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
        for w in found:
            tf[i % 3 - 1, w] = tf.get((i % 3 - 1, w), 0) + 1
            f[w] = f.get(w, 0) + (i % 3 != 0)
        for w in set(found):
            df[w] = df.get(w, 0) + 1
    got = {(r.topic_id, r.term): (r.tf, r.df, r.f) for r in terms.term_table(docs, "text", min_docs=2, max_share=1.0).collect()}
    assert got == {(k, w): (n, df[w], f[w]) for (k, w), n in tf.items() if df[w] >= 2}


def test_guarded_searches_change_no_text(spark):
    parts = ["see https://a.b/c?d=1", "a@b.c", "@x", "x@", "12 345", "n1 2", "a  b", "\u00a0", "business idea", "my_business idea", "what  next",
             "ok ok", "boxes", "men", "series", "classes", "http://x  y", "key partners", "\n", "meaning of", "Buses", "\u0967"]
    rng = random.Random(5)
    texts = [rng.choice(["", " "]).join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(6))) for _ in range(300)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    plain = tx.spaced(F.col("t"))
    for pattern in (tx._URL_PATTERN, tx._EMAIL_PATTERN, tx._NUMBER_PATTERN):
        plain = F.regexp_replace(plain, pattern, "")
    plain = tx._drop_repeats(F.btrim(F.lower(F.regexp_replace(plain, " {2,}", " ")), F.lit(" ")))
    merged = F.lower("t")
    for phrase, token in tx.fv.PHRASE_TOKENS:
        merged = F.regexp_replace(merged, f"{tx._NOT_IN_WORD_BEFORE}{phrase}{tx._NOT_IN_WORD_AFTER}", token)
    lemmas = F.array_join(F.transform(tx.tokens(F.col("t")), lambda w: tx.lemma(w)), " ")
    out = df.select(plain.alias("a"), tx.preprocess(F.col("t")).alias("b"), merged.alias("c"), tx.merge_phrases(F.lower("t")).alias("d"),
                    lemmas.alias("e"), tx.lemmatise(F.col("t")).alias("f")).collect()
    assert all((r.a, r.c, r.e) == (r.b, r.d, r.f) for r in out) and len(out) == 301


def test_own_ids_decode_as_any_ids_do(tmp_path):
    from chatlens.llm import bpe

    characters = bpe.byte_characters()
    vocabulary = {
        "strings": [*characters, "ab", "\u0120a", "<x>"], "bytes": list(range(256)),
        "merges": {(97, 98): (0, 256), (32, 97): (1, 257)}, "added": {"<x>": 258}}
    codec = bpe.Codec(vocabulary)
    for text in ("", " ", "ab ab a", " a  ab\n b", "x<x> ab", "\u00e9 a\u3000 b", "a <x", "   "):
        ids = codec.encode(text)
        assert codec.decode_own(ids) == codec.decode(ids.tolist()) == text
        parts = [codec.part(p) for p in codec.parts(text)]
        assert np.array_equal(ids, np.frombuffer(b"".join(parts), "<i4"))
