"""Hard negatives, periodic runs and licence scans, each against a brute-force version."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from helpers import CLASHES, LONG, MESSY, WORD, empty, messy
from pyspark.sql import functions as F

from chatlens.llm import hard_negatives, license_scan, periodic_runs, queries

SF = "/root/testdata/sf0.001"

# --- hard negatives --------------------------------------------------------------


def brute_negatives(rows, positives=5, negatives=10, low=30, high=90, is_anchor=lambda i: i % 4 == 0):
    """``rows`` are (id, label, whole-number vector)."""
    out = set()
    for i, label, v in rows:
        if not is_anchor(i):
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in rows if j != i]
        for p, j, other in sorted(s for s in scored if s[2] == label)[:positives]:
            band = sorted(s for s in scored if s[2] != label and low * -p <= 100 * -s[0] <= high * -p)
            out |= {(i, j, rank, k, -p, -n) for rank, (n, k, _) in enumerate(band[:negatives], 1)}
    return out


def as_tuples(found):
    return {(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in found.collect()}


@pytest.mark.parametrize("row_block,anchor_block,kind", [(8192, 1024, "unit"), (17, 9, "unit"), (40, 8, "few"), (64, 64, "large")])
def test_hard_negatives_equal_brute_force(spark, row_block, anchor_block, kind):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(160, 12))
    x = {"unit": x / np.linalg.norm(x, axis=1, keepdims=True), "few": np.sign(x[:, :12].round()), "large": x * 1e6}[kind]
    x[7] = x[3]  # ties
    rows = [(i, int(rng.integers(0, 3)) if i % 3 else 0, x[i].tolist()) for i in range(160)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    for name in ("id", "v", "rb", "ab", "_label", "_anchor", "rank", "positives"):  # clashing names
        df = df.withColumn(name, F.lit("x"))
    want = brute_negatives([(i, label, [int(np.floor(256 * c)) for c in v]) for i, label, v in rows])
    got = hard_negatives.mine(df, F.col("label"), F.col("vec_id") % 4 == 0, row_block=row_block, anchor_block=anchor_block)
    assert as_tuples(got) == want and got.count() == len(want) and want


@pytest.mark.parametrize("size", [1, 3, 40, 1000, 2**20, 2**28])
def test_packed_products_are_exact(size):
    rng = np.random.default_rng(size)
    candidates, anchors = rng.integers(-size, size + 1, (50, 64)), rng.integers(-size, size + 1, (5, 64))
    packed = hard_negatives.Packed(candidates, int(anchors.min()), int(anchors.max()))
    for anchor in anchors.tolist():
        want = [sum(a * b for a, b in zip(anchor, c)) for c in candidates.tolist()]
        assert packed.scores(anchor).tolist() == want
    assert len(hard_negatives.Packed(candidates[:0], -1, 1).scores([1] * 64)) == 0


def test_hard_negatives_leave_out_unusable_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 0, [1.0, 0.0]), (1, 0, [1.0, 0.1]), (2, 1, [0.5, 0.0]), (2, 1, [0.5, 0.0]), (3, None, [0.6, 0.0]), (4, 1, None),
            (8, 1, [0.5, nan]), (12, 1, [inf, 0.5]), (16, 1, [0.5, None]), (20, 1, [0.7]), (24, 1, []), (28, 1, [1e300, 0.5]),
            (32, 1, [1e12, 0.0]), (None, 1, [0.5, 0.0]), (40, 5, [-1.0, 0.0]), (44, 5, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = as_tuples(hard_negatives.mine(df, F.col("label"), F.col("vec_id") % 4 == 0))
    # 44 has the same score as the positive and lies above the band; 40 and 44 have a positive below 0.
    assert got == {(0, 1, 1, 2, 65536, 32768)}
    assert hard_negatives.mine(df.limit(0), F.col("label"), F.col("vec_id") % 4 == 0).count() == 0
    assert hard_negatives.mine(df, F.col("label"), F.lit(False)).count() == 0
    two = spark.createDataFrame([(0, 1, [1.0]), (0, 0, [2.0]), (1, 0, [1.0]), (2, 7, [0.5])], df.schema)
    assert as_tuples(hard_negatives.mine(two, F.col("label"), F.col("vec_id") == 0)) == {(0, 1, 1, 2, 131072, 65536)}


def test_hard_negative_query_keeps_its_contract(spark):
    got = queries.op11_hard_negatives(spark, SF)
    assert dict(got.dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint",
                                "positive_score": "bigint", "negative_score": "bigint"}
    rows = []
    for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect():
        label = (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label
        rows.append((r.vec_id, label, [int(np.floor(256 * float(c))) for c in r.embedding]))
    assert as_tuples(got) == brute_negatives(rows, is_anchor=lambda i: i % 100 == 0)


# --- periodic runs ---------------------------------------------------------------


def brute_runs(w, least=24, turns=3):
    """All lags and all starts; a stretch within a run of a divisor of its period is no run of its own."""
    found = []
    for q in range(1, len(w) // turns + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            length = i + q - start
            if i > start and length >= max(least, turns * q) and not any(
                    q % p == 0 and a <= start and start + length <= a + n for a, n, p in found):
                found.append((start, length, q))
            i += i == start
    return sorted(found, key=lambda r: (r[0], r[2]))


def periodic_words(rng):
    w = []
    for _ in range(rng.randint(1, 6)):
        if rng.random() < 0.3:
            w += [f"w{rng.randrange(rng.choice([2, 3, 50, 1000]))}" for _ in range(rng.randint(0, 60))]
        else:
            base = [f"w{rng.randrange(rng.choice([1, 2, 4, 100]))}" for _ in range(rng.randint(1, 40))]
            w += (base * rng.randint(2, 12))[:rng.randint(1, 400)]
    return w


def brute_row(w):
    runs = brute_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    top = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (len(runs), *top, 1000 * top[1] // top[2] if runs else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


RUN_COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


@pytest.mark.parametrize("least", [24, 6, 3])
def test_runs_equal_brute_force(least):
    rng = random.Random(least)
    for _ in range(250):
        w = periodic_words(rng)
        ids = np.unique(w, return_inverse=True)[1]
        assert periodic_runs.runs_of(ids, least) == brute_runs(w, least)


def test_run_digests_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([" ", "\n", " \t"]).join(periodic_words(rng))) for i in range(120)]
    got = periodic_runs.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = dict(rows)
    assert len(got) == len(rows) and sum(r.n_runs > 1 for r in got) > 10
    for r in got:
        assert tuple(r[c] for c in RUN_COLUMNS) == brute_row(WORD.findall(texts[r.doc_id]))


def test_segments_split_until_stable():
    # Removing the rare word leaves parts in which further words have become rare.
    w = [1, 2, 3] * 10 + [9] + [4, 5] * 20 + [6, 1, 4] + [7] * 30
    assert periodic_runs.surviving_segments(np.array(w)) == [(0, 30), (31, 71), (74, 104)]
    assert periodic_runs.surviving_segments(np.arange(1000)) == [] and periodic_runs.surviving_segments(np.array([], int)) == []


def test_long_texts_are_searched_whole():
    one = np.zeros(300_000, int)
    assert periodic_runs.runs_of(one) == [(0, 300_000, 1)]
    tail = np.concatenate((np.arange(50_000), np.tile(np.arange(70_000, 90_000), 4)))
    assert periodic_runs.runs_of(tail) == [(50_000, 80_000, 20_000)]
    mixed_text = np.random.default_rng(1).integers(0, 300, 400_000)
    assert periodic_runs.runs_of(mixed_text) == []


def planted(doc_id, text):
    """The words of a document as the query changes them."""
    w = WORD.findall(text or "")
    if doc_id is None:
        return w
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


def test_run_query_keeps_its_contract(spark):
    got = queries.op12_periodic_runs(spark, SF)
    assert got.columns == ["doc_id", *RUN_COLUMNS]
    assert [t for _, t in got.dtypes] == ["bigint"] * 6 + ["string"] * 2
    rows = {r.doc_id: r for r in got.collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs) and sum(r.n_runs > 0 for r in rows.values()) > 5
    for d in docs:
        w = planted(d.doc_id, d.text)
        if len(w) <= 1500:
            assert tuple(rows[d.doc_id][c] for c in RUN_COLUMNS) == brute_row(w), d.doc_id
        else:
            assert rows[d.doc_id].n_runs == len(periodic_runs.runs_of(np.unique(w, return_inverse=True)[1]))


def test_runs_on_messy_rows(spark):
    got = periodic_runs.find_runs(messy(spark))
    assert set(CLASHES) <= set(got.columns) and got.count() == len(MESSY)
    by_id = defaultdict(list)
    for r in got.collect():
        by_id[r.doc_id].append(r)
    assert by_id[3][0].runs == [] and by_id[4][0].collapsed == "" and by_id[5][0].n_words == 0
    assert by_id[9][0].collapsed == by_id[9][1].collapsed and by_id[None][0].n_words == 12
    assert [(r.start, r.length, r.period) for r in by_id[8][0].runs] == [(0, 60_000, 3001)]
    assert by_id[8][0].collapsed == " ".join(LONG.split(" ")[:3001])
    assert periodic_runs.digests(empty(spark)).count() == 0
    none = periodic_runs.digests(messy(spark).filter("doc_id = 3")).first()
    assert none.n_runs == 0 and none.start is None and none.exponent_milli is None
    assert none.runs_sha256 == none.collapsed_sha256 == hashlib.sha256(b"").hexdigest()


# --- licence scans ---------------------------------------------------------------

LICENCE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_base(text):
    w = LICENCE_WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for phrase, label in license_scan.BASE_PHRASES.items() for i in range(len(w))
              if w[i:i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


BASE_COLUMNS = ["n_words", "n_base", "first_word", "last_word", "base_labels"]


def licence_texts(seed=1, n=300):
    rng = random.Random(seed)
    parts = ["Released under the MIT License.", "under the mit licenses", "Apache License, Version 2", "CC BY-NC", "cc  by\nnc-sa 4.0", "é",
             "under the", "mit license", "ccbync", "İ", "word", "CC-BY", "NC", "the MIT license", "license: (MIT or ISC)", "ſ", "\x00", "K"]
    return [(i, rng.choice([" ", "", "; "]).join(rng.choice(parts) for _ in range(rng.randint(0, 12)))) for i in range(n)]


def test_base_places_equal_brute_force(spark):
    rows = licence_texts()
    got = license_scan.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = dict(rows)
    assert len(got) == len(rows) and sum(r.n_base > 0 for r in got) > 50
    for r in got:
        assert tuple(r[c] for c in BASE_COLUMNS) == brute_base(texts[r.doc_id]), texts[r.doc_id]
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_licence_query_keeps_its_contract(spark):
    got = queries.op13_license_scan(spark, SF)
    assert dict(got.dtypes).items() >= {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint",
                                        "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"}.items()
    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = got.collect()
    assert len(rows) == len(docs) and any(r.labels for r in rows)
    for r in rows:
        assert tuple(r[c] for c in BASE_COLUMNS) == brute_base(docs[r.doc_id])
        assert bool(r.labels) == (r.score > 0) and bool(r.labels) == ("icense" in docs[r.doc_id] or "rights reserved" in docs[r.doc_id])


@pytest.mark.parametrize("text,labels,form,demand", [
    ("SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0 */ x",
     "apache-2,gpl-2,mit", "(mit or apache-2) and gpl-2 with classpath-exception-2.0", 0.5),
    ("spdx-license-identifier: mit or isc and gpl-3.0+", "gpl-3,isc,mit", "mit or isc and gpl-3", 0.2),
    ("SPDX-License-Identifier: LicenseRef-Own OR (MIT", "licenseref-own", "licenseref-own", 1.0),
    ("license = 'BSD-3-Clause'", "bsd-3-clause", "bsd-3-clause", 0.2),
    ("licensed under MIT and then some", "mit", "mit", 0.2),
    ("License: CC-BY-NC-SA-4.0", "cc-by-nc,cc-by-nc-sa", "cc-by-nc-sa", 0.9),
    ("license: free for all", "", "", None), ("licensed under the terms of nothing", "", "", None),
    ("license: ((MIT", "", "", None), ("license: with and or", "", "", None),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3", "", 0.7),
])
def test_expressions(spark, text, labels, form, demand):
    row = license_scan.digests(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.labels, row.expressions, row.demand) == (labels, form, demand)


def test_shunting_yard_equals_python():
    """Random expressions: the labels' truth values agree with Python's own evaluation."""
    rng = random.Random(3)

    def build(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice("abcd")
        sides = build(depth - 1), rng.choice([" and ", " or "]), build(depth - 1)
        return f"({''.join(sides)})" if rng.random() < 0.5 else "".join(sides)

    for _ in range(300):
        text = build(5)
        postfix = license_scan.to_postfix(re.findall(r"[()]|\w+", text))
        form = license_scan.evaluate(postfix)[2]
        for bits in range(16):
            values = dict(zip("abcd", (bool(bits >> k & 1) for k in range(4))))
            stack = []
            for t in postfix:
                if t in ("and", "or"):
                    b, a = stack.pop(), stack.pop()
                    stack.append(a and b if t == "and" else a or b)
                else:
                    stack.append(values[t])
            assert stack == [eval(text, {}, values)] == [eval(form, {}, values)]
    for bad in (["("], [")"], ["and"], ["mit", "isc"], ["mit", "or"], ["(", "mit"], ["mit", ")"], ["(", ")"], []):
        assert license_scan.to_postfix(bad) is None


def test_licences_on_messy_and_long_rows(spark):
    got = license_scan.find_licenses(messy(spark))
    rows = got.collect()
    assert len(rows) == len(MESSY) and set(CLASHES) - {"score", "n_words"} <= set(got.columns)
    assert all(r.notices == [] and r.score == 0.0 for r in rows)
    assert license_scan.digests(empty(spark)).count() == 0
    long = "é under the MIT license, " * 40_000 + "license: " + " or ".join(["(MIT and ISC)"] * 20_000)
    row = license_scan.digests(spark.createDataFrame([(1, long), (1, long)], "doc_id long, text string")).collect()
    assert row[0] == row[1] and row[0].n_base == 40_000 and row[0].last_word == 5 * 39_999 + 1 and row[0].labels == "isc,mit"
    spans = license_scan.find_licenses(spark.createDataFrame([("日本 CC-BY-NC x",)], "text string")).first().notices
    assert [(s.start, s.end, s.word) for s in spans] == [(3, 11, 1)]
