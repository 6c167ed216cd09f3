import datetime as dt
import random
import statistics
import sys

import pytest
from pyspark import cloudpickle
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from chatlens import schemas
from chatlens.operators import agency, cleaning, joins, report, scoring, sentiment, summary, translate
from chatlens.sources import tables

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def test_required_and_default_columns(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(KeyError):
        tables.require_columns(df, "a", "b")
    assert tables.ensure_column(df, "b", F.lit("")).first().b == ""
    assert tables.ensure_column(df, "a", F.lit("")).first().a == 1
    empty = tables.empty_table(spark, schemas.CAL_STATE_BY_USER)
    assert summary.cal_state_by_user(df).collect() == empty.collect() == []


def test_na_tokens(spark):
    df = spark.createDataFrame([("NA",), ("null",), ("",), ("ok",), (None,)], "a string")
    assert [r.a for r in tables.nullify_na_tokens(df, ["a"]).collect()] == [None, None, None, "ok", None]


def test_csv_keeps_quotes_newlines_and_blanks(spark, tmp_path):
    df = spark.createDataFrame([('he said "a,b"\nnext', "  x "), ("\\", None)], "a string, b string")
    tables.write_csv(df, str(tmp_path / "t.csv"))
    back = tables.read_csv(spark, str(tmp_path / "t.csv"), df.schema)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_named_tables(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "three.parquet"))
    names = tables.register_tables(spark, {"gone": str(tmp_path / "gone.parquet")}, [str(tmp_path / "three.parquet")])
    assert names == ["three"] and spark.sql("SELECT count(*) AS n FROM three").first().n == 3
    with pytest.raises(FileNotFoundError):
        tables.register_tables(spark, {}, ["x=" + str(tmp_path / "gone.parquet")])


def test_row_index_is_dense_and_keeps_order(spark):
    rows = tables.with_row_index(spark.range(0, 1000, 1, 7)).collect()
    assert sorted((r.row_index, r.id) for r in rows) == [(i, i) for i in range(1000)]


RAW = [("2024-01-31 23:00:0091987", "hi"), ("2024-02-30 10:00:0091987", "bad"), ("2024", "short"), (None, "none")]


def test_session_ids_strict_and_quarantine(spark):
    raw = spark.createDataFrame(RAW, "session_id string, Question string")
    with pytest.raises(PySparkException):
        cleaning.clean_export(raw).collect()
    assert [r.Question for r in cleaning.quarantine(raw).collect()] == ["bad", "short", "none"]
    good = cleaning.clean_export(raw.limit(1))
    assert good.columns == ["datetime", "whatsapp_id", "user_msg"]
    assert tuple(good.first()) == (dt.datetime(2024, 1, 31, 23), "91987", "hi")
    with pytest.raises(KeyError):
        cleaning.clean_export(spark.range(1))


def test_role_long_tolerates_missing_columns(spark):
    only_user = spark.createDataFrame([(0, "u")], "row_index int, user_msg_en string")
    assert [tuple(r) for r in cleaning.role_long(only_user).collect()] == [(0, "user", "", "u")]


def test_cap_before_blank_filter(spark):
    rows = spark.createDataFrame([(0, "user", " "), (1, "user", "a"), (2, "user", "b")], "row_index int, role string, text string")
    assert [r.text for r in cleaning.nonblank(cleaning.cap_per_role(rows, 2), "text").collect()] == ["a"]


def test_cap_keeps_every_role(spark):
    rows = spark.createDataFrame([(i, ("user", "assistant", "system", None)[i % 4]) for i in range(40)], "row_index int, role string")
    got = cleaning.cap_per_role(rows, 3).collect()
    assert sorted(r.row_index for r in got) == list(range(12))


def test_dedup_keeps_first_and_treats_nulls_as_equal(spark):
    rows = spark.createDataFrame([(2, None, "u1", "hi"), (1, None, "u1", "hi"), (3, None, None, "hi")],
                                 "row_index int, datetime timestamp_ntz, whatsapp_id string, user_msg string")
    assert sorted(r.row_index for r in cleaning.dedup_first(rows, translate.DEDUP_KEYS).collect()) == [1, 3]


def test_dedup_cuts_a_hot_key_before_the_shuffle(spark):
    rows = spark.range(0, 100_000, 1, 8).select(F.col("id").alias("row_index"), (F.col("id") % 1).cast("string").alias("user_msg"))
    plan = cleaning.dedup_first(rows, ["user_msg"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert [r.row_index for r in cleaning.dedup_first(rows, ["user_msg"]).collect()] == [0]


def test_day_span_counts_full_days(spark):
    rows = spark.createDataFrame([("2024-01-01 23:00:00", "a"), ("2024-01-02 01:00:00", "a")], "datetime string, whatsapp_id string")
    got = summary.datetime_overview(rows).first()
    assert (got.total_messages, got.unique_users, got.total_days) == (2, 1, 1)
    assert [tuple(x) for x in got.messages_by_date] == [("2024-01-01", 1), ("2024-01-02", 1)]


def test_message_stats_count_blank_as_zero(spark):
    rows = spark.createDataFrame([("user", "ab cd"), ("user", None), ("user", " ")], "role string, text string")
    assert tuple(summary.message_stats(rows).first()) == ("user", 1, 2.0, 1.0, pytest.approx(2 / 3), 0.0)


@pytest.mark.parametrize("hot_rows", [10, 1_000_000])
def test_join_with_hot_key_keeps_every_row(spark, hot_rows):
    left = spark.range(3000).select(F.col("id").alias("row_index"), F.when(F.col("id") < 1000, 7).otherwise(F.col("id")).alias("k"))
    right = left.select("k").distinct().filter("k % 2 = 1").withColumn("v", F.col("k") * 10)
    counts = left.groupBy("k").agg(F.count("*").alias("n_rows"))
    got = joins.attach_by_key(left, right, "k", counts, ["row_index"], hot_rows).collect()
    assert len(got) == 3000
    assert all(r.v == (r.k * 10 if r.k % 2 else None) for r in got)


def test_rows_without_a_key_are_kept_and_spread(spark):
    left = spark.range(4000).select(F.col("id").alias("row_index"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("k"))
    right = left.filter("k is not null").select("k").withColumn("v", F.lit(1))
    counts = right.select("k", F.lit(1).alias("n_rows"))
    got = joins.attach_by_key(left, right, "k", counts, ["row_index"])
    assert got.count() == 4000 and got.filter("v is null").count() == 2000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "4096" in plan


def test_exact_median_equals_brute_force(spark):
    rng = random.Random(1)
    data = [("a", rng.gauss(0, 1)) for _ in range(4001)] + [("b", 0.5)] * 3000 + [("b", rng.random()) for _ in range(1000)]
    data += [("c", 1.0), ("c", 4.0), ("d", None)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {r.g: r.m for r in joins.exact_median(df, ["g"], "v", "m").collect()}
    assert got == {g: pytest.approx(statistics.median(v for k, v in data if k == g)) for g in "abc"}


def test_median_slices_stay_small(spark, monkeypatch):
    """No task ranks more than one of the sorted partitions, for all-different and for equal values."""
    seen = []
    real = joins.materialise

    def kept(df, name):
        out = real(df, name)
        if name == "median-values":
            seen.append(out)
        return out

    monkeypatch.setattr(joins, "materialise", kept)
    rows = spark.range(40_000).select(
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("g"),
        F.when(F.col("id") % 2 == 0, F.rand(3)).otherwise(F.lit(0.25)).alias("v"))
    got = {r.g: r.m for r in joins.exact_median(rows, ["g"], "v", "m").collect()}
    values = sorted(r.v for r in rows.filter("g = 'a'").collect())
    assert got == {"a": pytest.approx((values[9999] + values[10000]) / 2), "b": 0.25}
    assert seen[0].filter("g = 'b'").count() == 1
    assert joins.exact_median(rows.limit(0), ["g"], "v", "m").count() == 0


class CountingModel:
    def score(self, texts):
        assert len(texts) <= 4
        return [float(len(t)) for t in texts]


def test_score_texts_scores_distinct_texts_and_keeps_rows(spark, tmp_path):
    log = str(tmp_path / "calls")

    def load():
        def model(texts):
            with open(log, "a") as out:
                out.write("".join(t + "\n" for t in texts))
            return [float(len(t)) for t in texts]
        return model

    rows = spark.createDataFrame([(i, f"t{i % 5}" if i else None) for i in range(50)], "row_index int, text string")
    scored = scoring.score_texts(rows, "text", load, agency.MODEL_RESULT, batch_size=4, hot_rows=5)
    assert scored.count() == 50 and {r.agency_score for r in scored.collect()} == {2.0, None}
    assert sorted(open(log).read().split()) == [f"t{i}" for i in range(5)]


def test_model_length_check_and_duck_typing(spark):
    rows = spark.createDataFrame([(1, "a")], "row_index int, text string")
    assert scoring.score_texts(rows, "text", CountingModel, agency.MODEL_RESULT, 4).first().agency_score == 1.0
    with pytest.raises(PySparkException):
        scoring.score_texts(rows, "text", lambda: lambda texts: [], agency.MODEL_RESULT, 4)
    with pytest.raises(AttributeError):
        scoring.as_model(object())


def test_sentiment_labels_and_overview(spark):
    rows = spark.createDataFrame([
        (1, "user", "good great"), (2, "user", "bad"), (3, "user", "table"), (4, "user", " "), (5, "assistant", "good bad good")],
        "row_index int, role string, text string").withColumns({"whatsapp_id": F.lit("u"), "datetime": F.lit(None).cast("timestamp_ntz")})
    scored = sentiment.sentiment_messages(rows)
    assert sorted((r.message, r.sentiment_label, r.sentiment_stars) for r in scored.collect()) == [
        ("bad", "1 star", 1), ("good bad good", "4 stars", 4), ("good great", "5 stars", 5), ("table", "3 stars", 3)]
    user = sentiment.sentiment_overview(scored).filter("role = 'user'").first()
    assert (user.messages, user.median_score, user.mean_stars, user.count_1_star, user.count_2_stars) == (3, 1.0, 3.0, 1, None)


def test_sentiment_with_model(spark):
    rows = spark.createDataFrame([(1, "user", "x", "u")], "row_index int, role string, text string, whatsapp_id string").withColumn(
        "datetime", F.lit(None).cast("timestamp_ntz"))
    odd = sentiment.sentiment_messages(rows, lambda: lambda texts: [("POSITIVE", 0.9) for _ in texts]).first()
    assert (odd.sentiment_label, odd.sentiment_score, odd.sentiment_stars) == ("POSITIVE", 0.9, None)


def test_agency_flags_are_null_without_score(spark):
    rows = spark.createDataFrame([(0, "user", "o", "plan build"), (1, "user", "o", " "), (2, "user", "o", "stuck"), (3, "user", "o", "sea")],
                                 "row_index int, role string, text_original string, text string")
    got = {r.message_id: (r.agency_score, r.is_high, r.is_low) for r in agency.agency_messages(rows).collect()}
    assert got == {"user_0": (1.0, True, False), "user_1": (None, None, None), "user_2": (-1.0, False, True), "user_3": (0.0, False, False)}
    by_model = agency.agency_messages(rows, CountingModel, batch_size=4, max_tokens=1)
    assert {r.message_id: r.agency_score for r in by_model.collect()} == {"user_0": 4.0, "user_1": None, "user_2": 5.0, "user_3": 3.0}


def test_histogram_closes_last_bin(spark):
    df = spark.createDataFrame([("user", float(x)) for x in range(5)], "message_role string, agency_score double")
    assert {r.bin: r.messages for r in agency.agency_histogram(df, 4).collect()} == {1: 1, 2: 1, 3: 1, 4: 2}


class Broken:
    def __call__(self, texts):
        if "boom" in texts:
            raise RuntimeError("no answer")
        return [("hello there friend", 5, 7) for _ in texts]


def test_translation_failure_retry_and_cache(spark):
    rows = spark.createDataFrame([(0, "नमस्ते"), (1, " नमस्ते "), (2, "boom"), (3, None), (4, "पानी"), (5, "cached")], "row_index int, user_msg string")
    cache = spark.createDataFrame([("cached", "from before")], "text string, text_en string")
    first = translate.WordTranslator({})
    run = translate.translate_messages(rows, lambda: first, lambda: translate.WordTranslator({"नमस्ते": "Hello"}), cache, hot_rows=1)
    assert run.messages.columns == ["row_index", "user_msg", "user_msg_en"]
    assert {r.row_index: r.user_msg_en for r in run.messages.collect()} == {
        0: "Hello", 1: "Hello", 2: "boom", 3: "", 4: "पानी", 5: "from before"}
    stats = translate.translation_stats(run).first()
    assert (stats.total_rows, stats.non_empty_inputs, stats.api_calls, stats.retries, stats.retries_ok, stats.cache_served_rows) == (6, 5, 5, 2, 1, 2)
    assert [r.preview for r in translate.failed_retry_preview(run).collect()] == ["पानी"]
    broken = translate.translate_messages(rows, Broken)
    texts = {r.text: r for r in broken.texts.collect()}
    assert texts["boom"].first_en == "boom" and texts["boom"].input_tokens == 0
    assert texts["cached"].first_en == "hello there friend"


def test_cache_keeps_first_acceptable(spark):
    rows = spark.createDataFrame([(3, "नमस्ते", "Hi"), (1, "नमस्ते", "नमस्ते"), (2, "नमस्ते", "Hello"), (4, "", "x")],
                                 "row_index int, user_msg string, user_msg_en string")
    assert [tuple(r) for r in translate.cache_from_previous(rows).collect()] == [("नमस्ते", "Hello")]
    assert translate.same_messages(rows, rows.filter("row_index < 4")).first().reusable is False
    assert translate.same_messages(rows, rows).first().reusable is True


def test_label_backfill_last_match_wins(spark):
    kw = spark.createDataFrame([("user", 1, "a, b", 3), ("user", 2, "c", 1)], "message_role string, topic_id int, keywords string, message_count long")
    ex = spark.createDataFrame([("user", "a, b", "old", 1), ("user", "a, b", "new", 2)], "message_role string, keywords string, intent_label string, position int")
    assert {r.topic_id: r.intent_label for r in report.label_backfill(kw, ex).collect()} == {1: "new", 2: "Topic 2"}


def test_results_do_not_depend_on_partitions(spark):
    rows = spark.range(500).select((F.col("id") % 7).cast("string").alias("whatsapp_id"), F.lit(None).cast("string").alias("cal_state"))
    a = {tuple(r) for r in summary.cal_state_by_user(rows.repartition(1)).collect()}
    b = {tuple(r) for r in summary.cal_state_by_user(rows.repartition(13)).collect()}
    assert a == b and {r[1] for r in a} == {"Unknown"}


def test_cache_with_doubled_and_padded_entries(spark):
    messages = spark.createDataFrame([(0, "hola"), (1, " hola "), (2, "adios"), (3, None)], "row_index int, user_msg string")
    cache = spark.createDataFrame([(" hola ", "hello"), ("hola", "hi"), ("adios\n", None), ("  ", "blank"), (None, "none")], "text string, text_en string")
    calls = translate.WordTranslator({"adios": "bye"})
    run = translate.translate_messages(messages, lambda: calls, cache=cache)
    got = {r.row_index: r.user_msg_en for r in run.messages.collect()}
    assert got == {0: "hello", 1: "hello", 2: "bye", 3: ""}
    assert [r.text for r in translate.translation_misses(messages, cache).collect()] == ["adios"]
    assert translate.translation_stats(run).first().api_calls == 1


class Unreachable:
    def __call__(self, texts):
        if any("bad" in t for t in texts):
            raise OSError("no answer")
        return [(t, 1, 1) for t in texts]


def test_failed_calls_are_counted(spark):
    messages = spark.createDataFrame([(0, "the good one"), (1, "the bad one"), (2, "the other one")], "row_index int, user_msg string")
    run = translate.translate_messages(messages, Unreachable)
    assert {r.row_index: r.user_msg_en for r in run.messages.collect()}[1] == "the bad one"
    stats = translate.translation_stats(run).first()
    assert (stats.failed_calls, stats.api_calls, stats.retries) == (1, 3, 0)


def test_model_tasks_follow_the_number_of_texts(spark):
    texts = lambda n: spark.range(n).select(F.col("id").cast("string").alias("text"))
    result = schemas.T.StructType([schemas.T.StructField("n", schemas.T.DoubleType())])
    tasks = lambda n: scoring.run_model(texts(n), CountingModel, result, 4, texts_per_task=100).select(
        F.spark_partition_id().alias("p")).distinct().count()
    assert tasks(10) <= 4 and tasks(3000) == 30


def test_stored_tables_end_with_their_block(spark, tmp_path):
    import os

    from chatlens import session
    kept = session.materialise(spark.range(3), "kept")
    with session.stored_tables(spark) as folder:
        inside = session.materialise(spark.range(5), "inside")
        assert inside.count() == 5 and os.listdir(folder.removeprefix("file:"))
    assert not os.path.exists(folder.removeprefix("file:")) and kept.count() == 3


def test_outputs_follow_their_contracts(spark):
    raw = spark.createDataFrame([("2024-01-31 23:00:0091987", "hi you", "c", "yes of course", "yes of course", "user", "Goa", "{}")], schemas.RAW_EXPORT)
    messages = tables.with_row_index(cleaning.clean_export(raw))
    names = lambda df: {(f.name, f.dataType.simpleString()) for f in df.schema.fields}
    contract = lambda c: {(f.name, f.dataType.simpleString()) for f in c.fields}
    assert contract(schemas.MESSAGES_CLEANED) <= names(messages)
    long = cleaning.role_long(translate.translate_messages(messages, None).messages)
    assert contract(schemas.ROLE_LONG) <= names(long)
    assert contract(schemas.SENTIMENT_MESSAGES) <= names(sentiment.sentiment_messages(long))
    assert contract(schemas.AGENCY_MESSAGES) <= names(agency.agency_messages(long))
