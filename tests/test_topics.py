import itertools
import math
import random

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from chatlens.plans import end_to_end
from chatlens.plans.end_to_end import analyse_export, model_topics
from chatlens.topics import cluster, components, eligibility, labels, metrics, refine, terms, vectors


def doc_rows(spark, rows):
    return spark.createDataFrame(rows, "row_index int, message_role string, topic_id int, text string")


# --- terms ---------------------------------------------------------------------------

def test_terms_drop_stopwords_before_pairs(spark):
    df = terms.add_terms(doc_rows(spark, [(1, "user", 0, "Make the product a good_idea x"), (2, "user", 0, "")]), "text")
    assert [r.terms for r in df.orderBy("row_index").collect()] == [
        ["make", "product", "good_idea", "make product", "product good_idea"], []]


def test_term_counts_and_weights_by_hand(spark):
    docs = doc_rows(spark, [(1, "user", 0, "apple apple pear"), (2, "user", 1, "pear plum"), (3, "user", -1, "apple")])
    table = terms.term_table(docs, "text", min_docs=1, max_share=1.0)
    one_word = {(r.topic_id, r.term): (r.tf, r.df, r.f) for r in table.collect() if " " not in r.term}
    assert one_word == {(0, "apple"): (2, 2, 2), (0, "pear"): (1, 2, 2), (1, "pear"): (1, 2, 2), (1, "plum"): (1, 1, 1), (-1, "apple"): (1, 2, 2)}
    rows = {(r.topic_id, r.term): r.weight for r in terms.topic_terms(table).collect()}
    mean_words = (2 + 1 + 1 + 1 + 1 + 1 + 1) / 2
    assert rows[(0, "apple")] == pytest.approx(2 * math.log(1 + mean_words / 2))
    assert {r.term for r in terms.vocabulary(terms.term_table(docs, "text", min_docs=2, max_share=0.9)).collect()} == {"apple", "pear"}
    by_topic = {r.term: r.df for r in terms.vocabulary(terms.term_table(docs, "text", min_docs=1, max_share=1.0, df_unit="topic")).collect()}
    assert by_topic["pear"] == 2 and by_topic["apple"] == 1


def test_outlier_and_default_labels(spark):
    docs = doc_rows(spark, [(1, "user", 0, "a"), (2, "user", 5, "b"), (3, "user", -1, "c")])
    known = spark.createDataFrame([("user", 0, "Known")], "message_role string, topic_id int, intent_label string")
    assert {r.row_index: r.intent_label for r in terms.message_topics(docs, known).collect()} == {1: "Known", 2: "Topic 5", 3: "Outlier"}


# --- labels --------------------------------------------------------------------------

def label_of(spark, words, name="0", supplied=None):
    df = spark.createDataFrame([("user", 0, words, name, supplied)],
                               "message_role string, topic_id int, terms array<string>, name string, supplied_label string")
    return labels.intent_labels(df).first().intent_label


@pytest.mark.parametrize("words,name,supplied,expected", [
    (["idea", "business_plan", "help"], "x", None, "Business Plan Idea Support Help"),
    (["topic", "chat"], "0_topic_chat", None, "Topic"),
    (["alpha"], "7", None, "Alpha"),
    (["alpha", "beta"], "3_alpha_beta", None, "3 Alpha Beta"),
    (["alpha", "beta"], "x", "measure support", "Alpha Beta"),
    (["alpha", "beta"], "x", "Team Registration support for all new users", "Team Registration Support For All"),
    (["deadline", "deadlines", "gamma"], "x", "one", "Deadlines Gamma"),
])
def test_intent_labels(spark, words, name, supplied, expected):
    assert label_of(spark, words, name, supplied) == expected


@pytest.mark.parametrize("label,expected", [
    ("Team Help\nmore", "Team Help"), ("- Team Help:", " Team Help"), ("  ", None), (None, None), ("Sock Makers", None), ("Instagram", None),
])
def test_supplied_label_cleaning(spark, label, expected):
    df = spark.createDataFrame([(label,)], "x string")
    assert df.select(labels.clean_supplied_label(F.col("x")).alias("y")).first().y == expected


# --- corrections and metrics -----------------------------------------------------------

def test_trivial_and_low_quality_topics(spark):
    docs = doc_rows(spark, [(1, "user", 0, "one two three four"), (2, "user", 0, "ok sir"), (3, "user", 1, "a b"), (4, "user", 1, ""),
                            (5, "user", 2, "please provide it now here"), (6, "user", 2, "send the big one now")])
    assert {r.row_index: r.topic_id for r in eligibility.filter_trivial(docs, "text").collect()} == {1: 0, 2: -1, 3: -1, 4: -1, 5: 2, 6: 2}
    assert {r.row_index: r.topic_id for r in refine.drop_low_quality_topics(docs, "text").collect()} == {1: 0, 2: 0, 3: -1, 4: -1, 5: -1, 6: -1}


def test_metrics_count_outliers_and_survive_no_topics(spark):
    docs = doc_rows(spark, [(i, "user", t, "x") for i, t in enumerate([0, 0, 0, 1, -1])] + [(9, "assistant", -1, "x")])
    ranked = spark.createDataFrame([("user", 0, 1, "a"), ("user", 0, 2, "b"), ("user", 1, 1, "a"), ("user", 8, 1, "z")],
                                   "message_role string, topic_id int, rank int, term string")
    got = {r.message_role: r for r in metrics.topic_metrics(docs, ranked).collect()}
    u, a = got["user"], got["assistant"]
    assert (u.num_topics, u.diversity, u.avg_topic_size, u.median_topic_size, u.total_messages, u.outliers) == (2, 0.667, 2, 2, 5, 1)
    assert (a.num_topics, a.diversity, a.total_messages, a.outliers) == (0, 0.0, 1, 1)
    flags = {r.message_role: r.too_few_topics for r in metrics.topic_quality_flags(metrics.topic_metrics(docs, ranked)).collect()}
    assert flags == {"user": True, "assistant": True}


def test_coherence_against_brute_force(spark):
    rng = random.Random(3)
    words = ["apple", "pear", "plum", "fig", "kiwi"]
    texts = [" ".join(w for w in words if rng.random() < 0.4) for _ in range(60)]
    docs = doc_rows(spark, [(i, "user", i % 2, t) for i, t in enumerate(texts)])
    tops = {0: ["apple", "pear", "plum"], 1: ["plum", "fig", "kiwi", "melon"]}
    ranked = spark.createDataFrame([("user", t, i + 1, w) for t, ws in tops.items() for i, w in enumerate(ws)],
                                   "message_role string, topic_id int, rank int, term string")

    def npmi(a, b):
        n = len(texts)
        pa, pb, pab = (sum(all(w in t.split() for w in ws) for t in texts) / n for ws in ([a], [b], [a, b]))
        return -1.0 if pab == 0 else math.log(pab / (pa * pb)) / -math.log(pab)

    got = {r.topic_id: r.coherence_c_npmi for r in metrics.topic_coherence(docs, "text", ranked).collect()}
    for t, ws in tops.items():
        pairs = list(itertools.combinations(ws, 2))
        assert got[t] == pytest.approx(sum(npmi(a, b) for a, b in pairs) / len(pairs))


# --- vectors ---------------------------------------------------------------------------

def test_seed_match(spark):
    docs = doc_rows(spark, [(1, "user", 0, "register the team on portal"), (2, "user", 0, "zzz"), (3, "user", 0, "program rules")])
    got = {r.row_index: (r.seed_topic, r.seed_similarity) for r in vectors.seed_match(docs, "text").collect()}
    assert got[1] == (0, pytest.approx(3 / math.sqrt(15))) and got[2] == (None, None)
    assert got[3] == (9, pytest.approx(2 / math.sqrt(6)))


@pytest.mark.parametrize("threshold", [0.3, 0.8, 0.95])
def test_similar_pairs_equal_brute_force(spark, threshold):
    rng = random.Random(5)
    base = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(6)]
    vecs = [[x + rng.gauss(0, 0.25) for x in base[i % 6]] for i in range(40)]
    rows = [("user", i, v) for i, v in enumerate(vecs)]
    got = {(r.topic_a, r.topic_b) for r in vectors.similar_pairs(
        spark.createDataFrame(rows, "message_role string, topic_id int, centroid array<double>"), threshold).collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.hypot(*a) / math.hypot(*b)
    assert got == {(i, j) for i, j in itertools.combinations(range(40), 2) if cos(vecs[i], vecs[j]) >= threshold}


def test_similar_pairs_plan_has_no_cross_join(spark):
    df = spark.createDataFrame([("user", 1, [1.0, 0.0])], "message_role string, topic_id int, centroid array<double>")
    plan = vectors.similar_pairs(df, 0.9)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_merge_joins_closest_pairs_into_smaller_id(spark):
    rows = [("user", 1, 10, [1.0, 0.0]), ("user", 2, 10, [0.999, 0.02]), ("user", 3, 5, [0.99, 0.1]), ("user", 4, 5, [0.0, 1.0])]
    topics = spark.createDataFrame(rows, "message_role string, topic_id int, message_count long, centroid array<double>")
    ids = lambda n: {r.topic_id: r.new_id for r in refine.merged_ids(topics, 0.95, n).collect()}
    assert ids(0) == {1: 1, 2: 2, 3: 3, 4: 4}
    assert ids(1) == {1: 1, 2: 1, 3: 3, 4: 4}
    assert ids(2) == ids(5) == {1: 1, 2: 1, 3: 1, 4: 4}


def test_reduce_joins_chains_within_a_role(spark):
    angle = lambda a: [math.cos(a), math.sin(a)]
    rows = [(role, i, 1, angle(0.2 * i if i < 4 else 2.5)) for role in ("user", "assistant") for i in range(5)]
    topics = spark.createDataFrame(rows, "message_role string, topic_id int, message_count long, centroid array<double>")
    got = {(r.message_role, r.topic_id): r.new_id for r in refine.reduced_ids(topics, math.cos(0.21)).collect()}
    assert got == {(role, i): 0 if i < 4 else 4 for role in ("user", "assistant") for i in range(5)}


def test_reduce_keeps_any_roles_apart(spark):
    rows = [("user", 0, 1, [1.0, 0.0]), ("user", 1, 1, [0.0, 1.0]), ("system", 0, 1, [1.0, 0.0]), ("system", 1, 1, [1.0, 0.01]),
            ("assistant", 5, 1, [1.0, 0.0]), ("assistant", 3, 1, [1.0, 0.0])]
    topics = spark.createDataFrame(rows, "message_role string, topic_id int, message_count long, centroid array<double>")
    got = {(r.message_role, r.topic_id): r.new_id for r in refine.reduced_ids(topics, 0.95).collect()}
    assert got == {("user", 0): 0, ("user", 1): 1, ("system", 0): 0, ("system", 1): 0, ("assistant", 5): 3, ("assistant", 3): 3}


@pytest.mark.parametrize("dims", [64, 256])
def test_similar_pairs_prune(spark, dims):
    """Topics of separate subjects are not all compared with each other."""
    rng = random.Random(dims)
    subjects = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(4)]
    rows = [("user", i, [x + rng.gauss(0, 0.1) for x in subjects[i % 4]]) for i in range(80)]
    topics = spark.createDataFrame(rows, "message_role string, topic_id int, centroid array<double>")
    compared = vectors.candidate_pairs(topics, 0.95).select("topic_a", "topic_b").collect()
    assert len(compared) == len(set(compared)) < 0.35 * 80 * 79 / 2
    found = {(r.topic_a, r.topic_b) for r in vectors.similar_pairs(topics, 0.95).collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.hypot(*a) / math.hypot(*b)
    assert found == {(i, j) for i, j in itertools.combinations(range(80), 2) if cos(rows[i][2], rows[j][2]) >= 0.95}


def test_stopwords_are_passed_on(spark):
    docs = doc_rows(spark, [(i, "user", i % 2, "alpha beta gamma" + str(i % 3)) for i in range(12)])
    assert "alpha" in {r.term for r in terms.term_table(docs, "text", max_share=1.0).collect()}
    table = terms.term_table(docs, "text", stopwords=["alpha"], max_share=1.0)
    assert not any("alpha" in r.term.split() for r in table.collect())
    ranked = spark.createDataFrame([("user", 0, 1, "alpha"), ("user", 0, 2, "beta")], "message_role string, topic_id int, rank int, term string")
    scores = [metrics.topic_coherence(docs, "text", ranked, stopwords=s).first().coherence_c_npmi for s in ([], ["alpha"])]
    assert scores == [1.0, -1.0]
    one, _ = vectors.hashed_vectors(docs, "text", 64, stopwords=["alpha", "beta"])
    two, _ = vectors.hashed_vectors(docs, "text", 64, stopwords=[])
    assert one.first().features != two.first().features


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60) if i != 30] + [(100, 100 + i) for i in range(1, 40)] + [(5, 5)]
    random.Random(0).shuffle(edges)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {i: 0 if i <= 30 else 31 for i in range(61)} | {100 + i: 100 for i in range(40)}
    assert got == want


def planted(rng):
    centres = [(0, 0, 0), (5, 5, 0), (-5, 5, 3), (6, -6, -4)]
    points, truth = [], []
    for k, (centre, n) in enumerate(zip(centres, (30, 30, 30, 10))):
        for _ in range(n):
            points.append([c + rng.gauss(0, 0.2) for c in centre])
            truth.append(k if n >= 15 else -1)
    for i in range(10):
        points.append([20.0 + 7 * i, -30.0, 11.0 * i])
        truth.append(-1)
    return points, truth


def test_clusters_of_planted_blobs(spark):
    points, truth = planted(random.Random(7))
    df = spark.createDataFrame(list(enumerate(points)), "row_index int, xyz array<double>")
    found = {r.row_index: r.topic_id for r in cluster.density_clusters(df, "xyz", "row_index", 1.0, dims=3).collect()}
    groups = {}
    for i, t in enumerate(truth):
        groups.setdefault(t, set()).add(found[i])
    assert groups[-1] == {-1}
    assert all(len(groups[t]) == 1 for t in (0, 1, 2)) and {min(groups[t]) for t in (0, 1, 2)} == {0, 1, 2}


@pytest.mark.parametrize("shift", [0.0, 0.25, 0.5, 0.77])
def test_clusters_do_not_depend_on_the_origin(spark, shift):
    points, _ = planted(random.Random(7))
    found = []
    for by in (0.0, shift):
        df = spark.createDataFrame([(i, [x + by for x in p]) for i, p in enumerate(points)], "row_index int, xyz array<double>")
        got = {r.row_index: r.topic_id for r in cluster.density_clusters(df, "xyz", "row_index", 1.0, dims=3).collect()}
        found.append({frozenset(i for i in got if got[i] == t) for t in set(got.values())})
    assert found[0] == found[1]


def test_points_across_a_corner_meet(spark):
    """Two halves of one blob that a grid corner separates are one cluster."""
    points = [[s * 0.01 * (1 + i % 5), s * 0.01 * (1 + i // 5)] for s in (-1, 1) for i in range(20)]
    df = spark.createDataFrame(list(enumerate(points)), "row_index int, xy array<double>")
    assert {r.topic_id for r in cluster.density_clusters(df, "xy", "row_index", 1.0, dims=2).collect()} == {0}


def test_clusters_with_one_third_equal_points(spark):
    rng = random.Random(2)
    points = [[0.5, 0.5]] * 3000 + [[rng.uniform(-50, 50), rng.uniform(-50, 50)] for _ in range(6000)]
    df = spark.createDataFrame(list(enumerate(points)), "row_index int, xy array<double>")
    found = {r.row_index: r.topic_id for r in cluster.density_clusters(df, "xy", "row_index", 0.25, dims=2).collect()}
    assert len(found) == 9000 and {found[i] for i in range(3000)} == {0}


def test_hashed_vectors_are_unit_and_reduction_has_k_columns(spark):
    docs = doc_rows(spark, [(i, "user", 0, f"alpha beta{i % 5} gamma{i % 3} delta{i % 7}") for i in range(60)])
    vecs, more = vectors.hashed_vectors(docs, "text", 64)
    rows = vecs.select(vector_to_array("features").alias("v")).collect()
    assert all(math.hypot(*r.v) == pytest.approx(1.0) for r in rows)
    assert len(vectors.reduce_dimensions(vecs, 5).first().reduced) == 5
    assert more(docs.limit(1), "text").count() == 1


# --- the whole analysis ------------------------------------------------------------------

def test_analyse_export(spark):
    subjects = [["team", "portal", "login", "screen", "button"], ["product", "soap", "wood", "price", "market"],
                ["translate", "poem", "hindi", "verse", "rhyme"]]
    rng = random.Random(11)
    rows = []
    for i in range(180):
        words = subjects[i % 3]
        said = " ".join(rng.sample(words, 4) + ["work"])
        rows.append((f"2024-01-{1 + i % 28:02d} 10:00:{i % 60:02d}9198{i % 9}", said, "cat", "You can plan and build " + said, "You can plan and build " + said,
                     "user", "Goa" if i % 2 else None, None))
    from chatlens import schemas
    raw = spark.createDataFrame(rows, schemas.RAW_EXPORT)
    out = analyse_export(raw, cell_width=0.2, min_cluster_size=10)
    n = out["messages_translated"].count()
    assert n == len({(r[0], r[1]) for r in rows})
    assert out["sentiment_all"].count() == out["agency"].count() == 2 * n
    assert {r.role for r in out["message_stats"].collect()} == {"user", "assistant"}
    assigned = out["message_topics"].collect()
    assert len(assigned) == 2 * n
    by_topic = {}
    for r in assigned:
        if r.topic_id != -1 and r.message_role == "user":
            by_topic.setdefault(r.topic_id, set()).add(next(k for k, ws in enumerate(subjects) if ws[0] in r.cleaned_message or ws[1] in r.cleaned_message))
    assert by_topic and all(len(s) == 1 for s in by_topic.values())
    assert out["topic_metrics"].count() == 4
    assert {len(r.keywords) > 0 for r in out["topic_keywords"].collect()} == {True}
    assert out["topic_examples"].first().example_1
    one_role = analyse_export(raw, cell_width=0.2, min_cluster_size=10, roles=["user"], by_representation=True)
    assert {r.message_role for r in one_role["message_topics"].collect()} == {"user"}
    alone = sorted((r.row_index, r.topic_id) for r in one_role["message_topics"].collect())
    assert alone == sorted((r.row_index, r.topic_id) for r in assigned if r.message_role == "user")


def test_analysis_with_neighbours_seeds_and_a_target(spark):
    subjects = [["team", "portal", "login", "screen", "button"], ["product", "soap", "wood", "price", "market"],
                ["translate", "poem", "hindi", "verse", "rhyme"]]
    rng = random.Random(11)
    rows = [(i, "user", "u", None, " ".join(rng.sample(subjects[i % 3], 4) + ["work"])) for i in range(150)]
    long = spark.createDataFrame(rows, "row_index long, role string, whatsapp_id string, datetime string, text string")
    out = model_topics(long, roles=["user"], cell_width=0.2, min_cluster_size=10, clustering="neighbours", seed_radius=0.2, target_topics=2)
    assigned = out["message_topics"].collect()
    assert len(assigned) == 150
    found = {r.topic_id for r in assigned if r.topic_id != -1}
    assert 1 <= len(found) <= 2 and sum(r.topic_id != -1 for r in assigned) > 60
    assert {r.topic_id for r in out["topic_keywords"].collect()} == found
    with pytest.raises(ValueError):
        end_to_end._clusters(long, "none of these", 0.2, 10)
