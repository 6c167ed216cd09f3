"""Registered queries on sources, cleaning, summaries, translation, sentiment and agency."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatlens import fixed_values as fv
from chatlens import schemas
from chatlens.functions.text import flag_retranslation
from chatlens.operators import agency, cleaning, scoring, sentiment, states, summary, translate
from chatlens.plans import fixtures as fx
from chatlens.plans import sql
from chatlens.plans.sql import BASE, BASE_LONG, EVENTS, PROBE, RAW, query, strip
from chatlens.session import materialise, scratch_path, stored_tables
from chatlens.sources import tables
from chatlens.topics import eligibility

_WORDS = {"positive": fx.TEST_POSITIVE, "negative": fx.TEST_NEGATIVE}
_AGENCY_WORDS = {"agentic": fx.TEST_POSITIVE, "passive": fx.TEST_NEGATIVE}


def _sentiment(spark, d):
    return sentiment.sentiment_messages(fx.long_messages(spark, d), **_WORDS)


def _agency(spark, d):
    return agency.agency_messages(fx.long_messages(spark, d), **_AGENCY_WORDS)


def _r(column: str, digits: int = 6):
    return F.round(column, digits).alias(column)


# --- sources and sinks ---------------------------------------------------------

def scan_csv_roundtrip(spark, d):
    path = scratch_path(spark, "raw.csv")
    tables.write_csv(fx.raw_export(spark, d).drop("row_index"), path)
    return tables.read_csv(spark, path, schemas.RAW_EXPORT)


def datetime_overview(spark, d):
    return summary.datetime_overview(fx.messages(spark, d)).withColumn("messages_by_date", F.to_json("messages_by_date"))


def overview_json_scan(spark, d):
    path = scratch_path(spark, "overview.json")
    tables.write_json(summary.datetime_overview(fx.event_messages(spark, d)), path)
    overview = tables.read_json(spark, path, schemas.DATETIME_OVERVIEW)
    return overview.select("total_messages", "total_days", F.inline("messages_by_date"))


def agency_parquet_roundtrip(spark, d):
    path = scratch_path(spark, "agency.parquet")
    tables.write_parquet(_agency(spark, d), path, ["message_role"])
    stored = spark.read.parquet(path)
    return stored.filter(F.col("message_role") == "user").select("message_id", "row_index", _r("agency_score"), "is_high")


def named_tables_sql(spark, d):
    tables.register_tables(
        spark, {"chat_turns": f"{d}/conversations.parquet", "chat_absent": f"{d}/no_such_table.parquet"},
        [f"chat_events={d}/events.parquet"],
    )
    return spark.sql("""
        SELECT t.role, e.event_type, count(*) AS messages
        FROM chat_turns t JOIN chat_events e ON e.event_id = t.conv_id * 8 + t.turn
        GROUP BY t.role, e.event_type""")


def ensure_columns(spark, d):
    narrow = fx.messages(spark, d).select("row_index", "user_msg")
    filled = tables.ensure_column(narrow, "user_msg_en", F.col("user_msg"))
    filled = tables.ensure_column(filled, "ai_msg_en", F.lit(""))
    filled = tables.ensure_column(filled, "message_role", F.lit("user"))
    return tables.ensure_column(filled, "user_msg", F.lit("unused"))


# --- cleaning ------------------------------------------------------------------

def parse_session(spark, d):
    raw = fx.raw_export(spark, d)
    return raw.select("row_index", cleaning.session_time(F.col("session_id")).cast("string").alias("datetime"),
                      cleaning.session_user(F.col("session_id")).alias("whatsapp_id"))


def _damaged(raw):
    # Exports whose state is missing lose the seconds of their session id.
    broken = F.concat(F.substring("session_id", 1, 16), F.lit("wa"))
    return raw.withColumn("session_id", F.when(F.col("cal_state").isNull(), broken).otherwise(F.col("session_id")))


def parse_session_quarantine(spark, d):
    return cleaning.quarantine(_damaged(fx.raw_export(spark, d))).select("row_index", "session_id", "cal_feedback")


def clean_messages(spark, d):
    return cleaning.clean_export(fx.raw_export(spark, d)).withColumn("datetime", F.col("datetime").cast("string"))


def nonblank_messages(spark, d):
    return cleaning.nonblank(fx.long_messages(spark, d), "text").select("row_index", "role", "text")


def max_items_cap(spark, d):
    capped = cleaning.cap_per_role(fx.long_messages(spark, d), 100)
    return cleaning.nonblank(capped, "text").select("row_index", "role", F.length("text").alias("n_chars"))


def max_docs_cap(spark, d):
    long = fx.probe_texts(spark, d).select(F.col("doc_id").alias("row_index"), F.col("lang").alias("role"), "text")
    return eligibility.topic_eligible(long, max_docs=50).select("row_index", "role", "cleaned")


def role_long(spark, d):
    return fx.long_messages(spark, d).withColumn("datetime", F.col("datetime").cast("string"))


def valid_datetime(spark, d):
    rows = _damaged(fx.raw_export(spark, d)).select(
        "row_index", F.substring("session_id", 1, 19).alias("datetime")
    ).withColumn("datetime", F.when(~F.col("datetime").contains("wa"), F.col("datetime")))
    return cleaning.valid_datetime(rows).withColumn("datetime", F.col("datetime").cast("string"))


def nullify_na(spark, d):
    # Each missing-value token in turn, bare and with a blank before it, next to real values.
    listed = F.array(*[F.lit(t) for t in fv.NA_TOKENS])
    token = F.get(listed, F.pmod("row_index", F.lit(len(fv.NA_TOKENS))).cast("int"))
    raw = fx.raw_export(spark, d).select(
        "row_index", F.coalesce("cal_state", token).alias("cal_state"), token.alias("token"),
        F.concat(F.lit(" "), token).alias("padded"), F.coalesce("Response", F.lit("")).alias("Response"),
    )
    return tables.nullify_na_tokens(raw, ["cal_state", "token", "padded", "Response"])


def dedup_messages(spark, d):
    docs = fx.documents(spark, d).select(
        F.col("doc_id").alias("row_index"), F.col("text").alias("user_msg"), F.lit(None).cast("string").alias("whatsapp_id")
    )
    return cleaning.dedup_first(docs, translate.DEDUP_KEYS)


def message_ids(spark, d):
    events = fx.table(spark, d, "events").select("event_id")
    numbered = tables.with_row_index(events.orderBy("event_id"))
    return numbered.select("event_id", "row_index", F.concat(F.lit("user_"), F.col("row_index").cast("string")).alias("message_id"))


# --- summaries -----------------------------------------------------------------

def messages_by_date(spark, d):
    by_date = summary.messages_by_date(fx.event_messages(spark, d))
    return by_date.withColumn("date", F.col("date").cast("string")).orderBy("date")


def timeline_hourly(spark, d):
    return summary.messages_by_hour(fx.event_messages(spark, d))


def cal_state_by_user(spark, d):
    return summary.cal_state_sorted(summary.cal_state_by_user(fx.event_messages(spark, d)))


def cal_state_share(spark, d):
    return summary.cal_state_share(summary.cal_state_by_user(fx.event_messages(spark, d))).withColumn(
        "share_pct", F.round("share_pct", 6))


def message_stats(spark, d):
    stats = summary.message_stats(fx.long_messages(spark, d))
    return stats.select("role", "messages", *[_r(c) for c in stats.columns[2:]])


# --- translation ---------------------------------------------------------------

def translation_misses(spark, d):
    cache = translate.cache_from_previous(fx.previous_run(spark, d))
    return translate.translation_misses(fx.translation_input(spark, d), cache).select("text", "n_rows", "first_row")


def cache_reuse(spark, d):
    return translate.cache_from_previous(fx.previous_run(spark, d))


def cache_strict_match(spark, d):
    # The earlier run lacks some rows, has others changed, and some only padded with blanks.
    row, text = F.col("row_index") % 10, F.col("user_msg")
    changed = F.when(row == 1, F.concat(text, F.lit("!"))).when(row == 2, F.concat(F.lit(" "), text, F.lit("\n"))).otherwise(text)
    previous = fx.previous_run(spark, d).filter(row != 0).withColumn("user_msg", changed)
    return translate.same_messages(previous, fx.translation_input(spark, d))


def translated_messages(spark, d):
    return fx.translation_run(spark, d).messages


def translated_messages_cached(spark, d):
    return fx.cached_translation_run(spark, d).messages


def translation_preview(spark, d):
    return translate.translation_preview(fx.translation_run(spark, d))


def translation_retry(spark, d):
    texts = fx.translation_run(spark, d).texts
    return texts.filter(F.col("retry_ok").isNotNull()).select("text", "first_en", "retry_en", "retry_ok", "text_en", "n_rows")


def translation_stats(spark, d):
    stats = translate.translation_stats(fx.translation_run(spark, d))
    rounded = {c: F.round(c, 9) for c in ("changed_pct", "unchanged_pct", "total_cost", "cost_per_call")}
    return stats.withColumns(rounded)


def failed_retry_preview(spark, d):
    return translate.failed_retry_preview(fx.translation_run(spark, d))


def needs_retranslation(spark, d):
    # Some English words become a Hindi one, which stands in for a poor translation.
    rows = fx.probe_texts(spark, d).withColumn(
        "translated", F.regexp_replace("text", "(?:the|of|and|is) ", "mera "))
    return flag_retranslation(rows, "text", "translated").select("doc_id", "needs_retranslation")


# --- sentiment -----------------------------------------------------------------

def sentiment_messages(spark, d):
    return _sentiment(spark, d).withColumns({"datetime": F.col("datetime").cast("string"), "sentiment_score": F.round("sentiment_score", 6)})


def sentiment_overview(spark, d):
    out = sentiment.sentiment_overview(materialise(_sentiment(spark, d), "sentiment"))
    return out.withColumns({c: F.round(c, 6) for c in ("mean_score", "median_score", "mean_stars")})


def sentiment_counts(spark, d):
    return sentiment.sentiment_counts(_sentiment(spark, d))


def sentiment_top_labels(spark, d):
    return sentiment.sentiment_top_labels(_sentiment(spark, d)).withColumn("share", F.round("share", 6))


# --- agency --------------------------------------------------------------------

def agency_messages(spark, d):
    return _agency(spark, d).withColumns({"datetime": F.col("datetime").cast("string"), "agency_score": F.round("agency_score", 6)})


def agency_all(spark, d):
    scored = _agency(spark, d)
    users = scored.filter(F.col("message_role") == "user").select("message_id", "message_role", "row_index", _r("agency_score"), "is_high")
    replies = scored.filter(F.col("message_role") == "assistant").select("message_id", "message_role", _r("agency_score"), "is_low")
    return agency.concat_roles(users, replies)


def agency_summary(spark, d):
    return agency.agency_summary(materialise(_agency(spark, d), "agency"))


def agency_histogram(spark, d):
    return agency.agency_histogram(materialise(_agency(spark, d), "agency"))


def agency_top_high(spark, d):
    return agency.agency_top(_agency(spark, d)).withColumn("agency_score", F.round("agency_score", 6))


def agency_top_low(spark, d):
    return agency.agency_top(_agency(spark, d), lowest=True).withColumn("agency_score", F.round("agency_score", 6))


def agency_neutral_sample(spark, d):
    return agency.agency_neutral_sample(_agency(spark, d)).withColumn("agency_score", F.round("agency_score", 6))


class _LengthModel:
    """A stand-in for a hosted model: scores a text by its length."""

    def predict(self, texts):
        return [len(t) / (len(t) + 1000.0) for t in texts]


def score_texts_plugin(spark, d):
    docs = fx.documents(spark, d).select(F.col("doc_id").alias("row_index"), "text")
    scored = scoring.score_texts(docs, "text", _LengthModel, agency.MODEL_RESULT)
    return scored.select("row_index", _r("agency_score"))


class _CountingModel:
    """A stand-in for a hosted model that tells how many words it was given."""

    def predict(self, texts):
        sizes = [len(t.split()) for t in texts]
        return [(f"{1 + n % 5} stars", n / (n + 1.0)) for n in sizes]


INPUT_CUT = 16


def sentiment_input_cut(spark, d):
    """Sentiment by a model that may see the first words of a message only."""
    scored = sentiment.sentiment_messages(fx.long_messages(spark, d), _CountingModel, max_tokens=INPUT_CUT)
    return scored.groupBy("role", "sentiment_label", "sentiment_stars", _r("sentiment_score")).agg(F.count("*").alias("messages"))


def translated_resumably(spark, d):
    """A translation whose answers are kept in parts, after a first run that saw every third message only."""
    folder, messages = scratch_path(spark, "answers"), fx.translation_input(spark, d)

    def run(rows):
        return translate.translate_messages(
            rows, lambda: translate.WordTranslator(fx.FIRST_WORDS), lambda: translate.WordTranslator(fx.RETRY_WORDS),
            resume=folder, texts_per_commit=400)

    with stored_tables(spark):  # of the first run only the answers stay
        run(messages.filter(F.col("row_index") % 3 == 0))
    return run(messages).messages.select("row_index", "user_msg_en")


def _halves(rows):
    """A table as two exports: even and odd seconds."""
    second = F.coalesce(F.second("datetime"), F.lit(0)) % 2
    return [rows.filter(second == 0), rows.filter(second == 1)]


def additive_overview(spark, d):
    """The overview from the merged states of two exports."""
    state = states.merged([states.message_state(part) for part in _halves(fx.messages(spark, d))])
    return states.overview_of(state).withColumn("messages_by_date", F.to_json("messages_by_date"))


def additive_cal_state(spark, d):
    return states.cal_state_of(states.merged([states.message_state(part) for part in _halves(fx.event_messages(spark, d))]))


def additive_sentiment_counts(spark, d):
    return states.sentiment_counts_of(states.merged([states.mood_state(part) for part in _halves(_sentiment(spark, d))]))


QUERIES = {f.__name__: f for f in (
    scan_csv_roundtrip, datetime_overview, overview_json_scan, agency_parquet_roundtrip, named_tables_sql,
    ensure_columns, parse_session, parse_session_quarantine, clean_messages, nonblank_messages, max_items_cap, max_docs_cap,
    role_long, valid_datetime, nullify_na, dedup_messages, message_ids, messages_by_date, timeline_hourly,
    cal_state_by_user, cal_state_share, message_stats, translation_misses, cache_reuse, cache_strict_match,
    translated_messages, translated_messages_cached, translation_preview, translation_retry, translation_stats, failed_retry_preview, needs_retranslation,
    sentiment_messages, sentiment_overview, sentiment_counts, sentiment_top_labels, agency_messages, agency_all,
    agency_summary, agency_histogram, agency_top_high, agency_top_low, agency_neutral_sample, score_texts_plugin,
    sentiment_input_cut, translated_resumably, additive_overview, additive_cal_state, additive_sentiment_counts,
)}

# --- the same in SQL -------------------------------------------------------------

_SENT = (*BASE_LONG, *sql.sentiment_steps("long"))
_AG = (*BASE_LONG, *sql.agency_steps("long"))
_DAMAGED = ("damaged", """SELECT * REPLACE (CASE WHEN cal_state IS NULL THEN substring(session_id, 1, 16) || 'wa'
    ELSE session_id END AS session_id) FROM raw_export""")
_CACHE = (
    PROBE,
    ("prev", f"""SELECT doc_id AS row_index, {strip('text')} AS t, CASE WHEN lang = 'en' THEN {strip('text')} ELSE '' END AS e
                 FROM probe WHERE {strip('text')} <> ''"""),
    ("prev_flag", sql.retranslation("t", "e", "prev", "row_index, t, e")),
    ("cache", "SELECT t AS text, arg_min(e, row_index) AS text_en FROM prev_flag WHERE NOT needs GROUP BY t"),
)


def _translator(words: dict[str, str], text: str) -> str:
    return (rf"array_to_string(list_transform(regexp_extract_all({text}, '\S+'), "
            f"lambda w: coalesce({sql.mapping(words)}[w], w)), ' ')")


_RUN = (
    PROBE,
    ("work", f"""SELECT {strip('text')} AS text, count(*) AS n_rows, min(doc_id) AS first_row FROM probe
                 WHERE {strip('text')} <> '' GROUP BY 1"""),
    ("first_0", f"SELECT *, {_translator(fx.FIRST_WORDS, 'text')} AS first_en FROM work"),
    ("first_1", sql.retranslation("text", "first_en", "first_0", "text, n_rows, first_row, first_en")),
    ("retry_0", f"SELECT text, {_translator(fx.RETRY_WORDS, 'text')} AS retry_en FROM first_1 WHERE needs"),
    ("retry_1", sql.retranslation("text", "retry_en", "retry_0", "text, retry_en")),
    ("texts", """SELECT f.text, f.n_rows, f.first_row, f.first_en, r.retry_en, NOT r.needs AS retry_ok,
                 coalesce(CASE WHEN NOT r.needs THEN r.retry_en END, f.first_en) AS text_en
                 FROM first_1 f LEFT JOIN retry_1 r ON r.text = f.text"""),
    ("out", f"""SELECT p.doc_id AS row_index, p.text AS user_msg, coalesce(t.text_en, '') AS user_msg_en
                FROM probe p LEFT JOIN texts t ON t.text = {strip('p.text')}"""),
)


def _top(direction: str, where: str = "agency_score IS NOT NULL") -> str:
    return query(*_AG, body=f"""SELECT message_role, rank, message_id, round(agency_score, 6) AS agency_score,
        replace(replace(coalesce(text_translated, ''), '|', '\\|'), chr(10), ' ') AS message FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY message_role ORDER BY {direction}, row_index) AS INTEGER) AS rank
        FROM agency WHERE {where}) WHERE rank <= 5""")


ORACLE = {
    "scan_csv_roundtrip": query(RAW, body="SELECT * EXCLUDE (row_index) FROM raw_export"),
    "datetime_overview": query(*BASE, (
        "by_date", "SELECT CAST(CAST(datetime AS DATE) AS VARCHAR) AS date, count(*) AS messages FROM messages GROUP BY 1"),
        body="""SELECT count(*) AS total_messages, count(DISTINCT whatsapp_id) AS unique_users,
            strftime(min(datetime), '%Y-%m-%dT%H:%M:%S') AS start_datetime,
            strftime(max(datetime), '%Y-%m-%dT%H:%M:%S') AS end_datetime,
            CAST(floor(epoch(max(datetime) - min(datetime)) / 86400) + 1 AS INTEGER) AS total_days,
            (SELECT '[' || string_agg('{"date":"' || date || '","messages":' || messages || '}', ',' ORDER BY date) || ']'
             FROM by_date) AS messages_by_date
            FROM messages"""),
    "additive_overview": query(*BASE, (
        "by_date", "SELECT CAST(CAST(datetime AS DATE) AS VARCHAR) AS date, count(*) AS messages FROM messages GROUP BY 1"),
        body="""SELECT count(*) AS total_messages, count(DISTINCT whatsapp_id) AS unique_users,
            strftime(min(datetime), '%Y-%m-%dT%H:%M:%S') AS start_datetime,
            strftime(max(datetime), '%Y-%m-%dT%H:%M:%S') AS end_datetime,
            CAST(floor(epoch(max(datetime) - min(datetime)) / 86400) + 1 AS INTEGER) AS total_days,
            (SELECT '[' || string_agg('{"date":"' || date || '","messages":' || messages || '}', ',' ORDER BY date) || ']'
             FROM by_date) AS messages_by_date
            FROM messages"""),
    "overview_json_scan": query(EVENTS, body="""
        SELECT (SELECT count(*) FROM event_messages) AS total_messages,
               (SELECT CAST(floor(epoch(max(datetime) - min(datetime)) / 86400) + 1 AS INTEGER) FROM event_messages) AS total_days,
               CAST(CAST(datetime AS DATE) AS VARCHAR) AS date, count(*) AS messages
        FROM event_messages GROUP BY 3"""),
    "agency_parquet_roundtrip": query(*_AG, body="""SELECT message_id, row_index, round(agency_score, 6) AS agency_score, is_high
        FROM agency WHERE message_role = 'user'"""),
    "named_tables_sql": """SELECT t.role, e.event_type, count(*) AS messages
        FROM conversations t JOIN events e ON e.event_id = t.conv_id * 8 + t.turn GROUP BY 1, 2""",
    "ensure_columns": query(*BASE, body="""SELECT row_index, user_msg, user_msg AS user_msg_en, '' AS ai_msg_en,
        'user' AS message_role FROM messages"""),
    "parse_session": query(*BASE, body="SELECT row_index, CAST(datetime AS VARCHAR) AS datetime, whatsapp_id FROM cleaned"),
    "parse_session_quarantine": query(RAW, _DAMAGED, body="""SELECT row_index, session_id, cal_feedback FROM damaged
        WHERE try_strptime(substring(session_id, 1, 19), '%Y-%m-%d %H:%M:%S') IS NULL"""),
    "clean_messages": query(*BASE, body="SELECT * REPLACE (CAST(datetime AS VARCHAR) AS datetime) FROM cleaned"),
    "nonblank_messages": query(*BASE_LONG, body=f"SELECT row_index, role, text FROM long WHERE {strip('text')} <> ''"),
    "max_docs_cap": query(PROBE, ("capped", f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r
        FROM probe WHERE {strip('text')} <> '') WHERE r <= 50"""), *sql.clean_steps("capped"), body=f"""SELECT doc_id AS row_index, lang AS role, cleaned
        FROM cleaned_rows WHERE {sql.eligible('cleaned')}"""),
    "max_items_cap": query(*BASE_LONG, body=f"""SELECT row_index, role, CAST(length(text) AS INTEGER) AS n_chars FROM (
        SELECT *, row_number() OVER (PARTITION BY role ORDER BY row_index) AS r FROM long) WHERE r <= 100 AND {strip('text')} <> ''"""),
    "role_long": query(*BASE_LONG, body="SELECT * REPLACE (CAST(datetime AS VARCHAR) AS datetime) FROM long"),
    "valid_datetime": query(RAW, _DAMAGED, body="""SELECT row_index, CAST(dt AS VARCHAR) AS datetime FROM (
        SELECT row_index, try_strptime(substring(session_id, 1, 19), '%Y-%m-%d %H:%M:%S') AS dt FROM damaged) WHERE dt IS NOT NULL"""),
    "nullify_na": query(RAW, body=f"""SELECT row_index, cal_state, CAST(NULL AS VARCHAR) AS token, Response,
        ' ' || {sql.array(fv.NA_TOKENS)}[row_index % {len(fv.NA_TOKENS)} + 1] AS padded FROM raw_export"""),
    "dedup_messages": """SELECT row_index, user_msg, CAST(NULL AS VARCHAR) AS whatsapp_id FROM (
        SELECT min(doc_id) AS row_index, text AS user_msg FROM documents GROUP BY text)""",
    "message_ids": """SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS row_index,
        'user_' || CAST(row_number() OVER (ORDER BY event_id) - 1 AS VARCHAR) AS message_id FROM events""",
    "messages_by_date": query(EVENTS, body="""SELECT CAST(CAST(datetime AS DATE) AS VARCHAR) AS date, count(*) AS messages
        FROM event_messages GROUP BY 1 ORDER BY 1"""),
    "timeline_hourly": query(EVENTS, body="SELECT CAST(hour(datetime) AS INTEGER) AS hour, count(*) AS messages FROM event_messages GROUP BY 1"),
    "cal_state_by_user": query(EVENTS, body="""SELECT whatsapp_id, coalesce(cal_state, 'Unknown') AS cal_state, count(*) AS message_count
        FROM event_messages GROUP BY 1, 2 ORDER BY 1, 3 DESC, 2"""),
    "cal_state_share": query(EVENTS, body="""SELECT coalesce(cal_state, 'Unknown') AS cal_state, count(*) AS message_count,
        round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM event_messages) * 100, 6) AS share_pct
        FROM event_messages GROUP BY 1"""),
    "message_stats": query(*BASE_LONG, body=f"""SELECT role, count(*) FILTER (WHERE {strip('text')} <> '') AS messages,
        round(avg(length(coalesce(text, ''))), 6) AS avg_characters,
        round(CAST(median(length(coalesce(text, ''))) AS DOUBLE), 6) AS median_characters,
        round(avg({sql.token_count('text')}), 6) AS avg_tokens,
        round(CAST(median({sql.token_count('text')}) AS DOUBLE), 6) AS median_tokens FROM long GROUP BY role"""),
    "translation_misses": query(*_CACHE, body=f"""SELECT {strip('text')} AS text, count(*) AS n_rows, min(doc_id) AS first_row
        FROM probe WHERE {strip('text')} <> '' AND {strip('text')} NOT IN (SELECT text FROM cache) GROUP BY 1"""),
    "cache_reuse": query(*_CACHE, body="SELECT text, text_en FROM cache"),
    "cache_strict_match": """SELECT count(*) FILTER (WHERE doc_id % 10 <> 0) AS previous_rows, count(*) AS current_rows,
        count(*) FILTER (WHERE doc_id % 10 < 2) AS mismatches, count(*) FILTER (WHERE doc_id % 10 < 2) = 0 AS reusable FROM documents""",
    "translated_messages": query(*_RUN, body="SELECT * FROM out"),
    "translated_messages_cached": query(*_CACHE, *_RUN[1:], body=f"""SELECT o.row_index, o.user_msg,
        coalesce(c.text_en, o.user_msg_en) AS user_msg_en FROM out o LEFT JOIN cache c ON c.text = {strip('o.user_msg')}"""),
    "translation_preview": query(*_RUN, body="SELECT row_index, user_msg, user_msg_en FROM out ORDER BY row_index LIMIT 20"),
    "translation_retry": query(*_RUN, body="SELECT text, first_en, retry_en, retry_ok, text_en, n_rows FROM texts WHERE retry_ok IS NOT NULL"),
    "translation_stats": query(*_RUN, (
        "rows_", f"""SELECT count(*) AS total_rows, count(*) FILTER (WHERE {strip('user_msg')} <> {strip('user_msg_en')}) AS changed_rows,
            count(*) FILTER (WHERE {strip('user_msg')} <> '') AS non_empty_inputs FROM out"""), (
        "calls_", r"""SELECT count(*) AS first_calls, count(retry_ok) AS retries, count(*) FILTER (WHERE retry_ok) AS retries_ok,
            CAST(sum(len(regexp_extract_all(text, '\S+')) * (CASE WHEN retry_ok IS NULL THEN 1 ELSE 2 END)) AS BIGINT) AS tokens
            FROM texts"""),
        body="""SELECT total_rows, changed_rows, total_rows - changed_rows AS unchanged_rows,
            round(CAST(changed_rows AS DOUBLE) / total_rows * 100, 9) AS changed_pct,
            round(CAST(total_rows - changed_rows AS DOUBLE) / total_rows * 100, 9) AS unchanged_pct,
            non_empty_inputs, non_empty_inputs - first_calls AS cache_served_rows, first_calls + retries AS api_calls,
            tokens AS input_tokens, tokens AS output_tokens,
            round(CAST(tokens AS DOUBLE) / 1e6 * 0.150 + CAST(tokens AS DOUBLE) / 1e6 * 0.600, 9) AS total_cost,
            round((CAST(tokens AS DOUBLE) / 1e6 * 0.150 + CAST(tokens AS DOUBLE) / 1e6 * 0.600) / (first_calls + retries), 9) AS cost_per_call,
            retries, retries_ok, retries - retries_ok AS retries_failed, CAST(0 AS BIGINT) AS failed_calls FROM rows_, calls_"""),
    "failed_retry_preview": query(*_RUN, body="""SELECT first_row, CASE WHEN length(text) > 75 THEN left(text, 75) || '...' ELSE text END AS preview
        FROM texts WHERE NOT retry_ok ORDER BY first_row LIMIT 10"""),
    "needs_retranslation": query(PROBE, (
        "pair", "SELECT doc_id, text, regexp_replace(text, '(?:the|of|and|is) ', 'mera ', 'g') AS translated FROM probe"), (
        "flag", sql.retranslation("text", "translated", "pair", "doc_id")),
        body="SELECT doc_id, needs AS needs_retranslation FROM flag"),
    "sentiment_messages": query(*_SENT, body="""SELECT role, whatsapp_id, CAST(datetime AS VARCHAR) AS datetime, message,
        sentiment_label, round(sentiment_score, 6) AS sentiment_score, sentiment_stars FROM sentiment"""),
    "sentiment_overview": query(*_SENT, body="""SELECT role, count(*) AS messages, round(avg(sentiment_score), 6) AS mean_score,
        round(median(sentiment_score), 6) AS median_score, round(avg(sentiment_stars), 6) AS mean_stars,
        nullif(count(*) FILTER (WHERE sentiment_stars = 1), 0) AS count_1_star,
        nullif(count(*) FILTER (WHERE sentiment_stars = 2), 0) AS count_2_stars,
        nullif(count(*) FILTER (WHERE sentiment_stars = 3), 0) AS count_3_stars,
        nullif(count(*) FILTER (WHERE sentiment_stars = 4), 0) AS count_4_stars,
        nullif(count(*) FILTER (WHERE sentiment_stars = 5), 0) AS count_5_stars FROM sentiment GROUP BY role"""),
    "additive_cal_state": query(EVENTS, body="""SELECT whatsapp_id, coalesce(cal_state, 'Unknown') AS cal_state, count(*) AS message_count
        FROM event_messages GROUP BY 1, 2"""),
    "additive_sentiment_counts": query(*_SENT, body="SELECT role, sentiment_label, count(*) AS messages FROM sentiment GROUP BY 1, 2"),
    "sentiment_input_cut": query(*BASE_LONG, ("seen", rf"""SELECT role, least(len(regexp_extract_all(text, '\S+')), {INPUT_CUT}) AS n FROM long
        WHERE {strip('text')} <> ''"""), body="""SELECT role, (1 + n % 5) || ' stars' AS sentiment_label, CAST(1 + n % 5 AS INTEGER) AS sentiment_stars,
        round(n / (n + 1.0), 6) AS sentiment_score, count(*) AS messages FROM seen GROUP BY ALL"""),
    "translated_resumably": query(*_RUN, body="SELECT row_index, user_msg_en FROM out"),
    "sentiment_counts": query(*_SENT, body="SELECT role, sentiment_label, count(*) AS messages FROM sentiment GROUP BY 1, 2"),
    "sentiment_top_labels": query(*_SENT, ("c", "SELECT role, sentiment_label, count(*) AS messages FROM sentiment GROUP BY 1, 2"),
        body="""SELECT * FROM (SELECT role, sentiment_label, messages,
            round(CAST(messages AS DOUBLE) / sum(messages) OVER (PARTITION BY role), 6) AS share,
            CAST(row_number() OVER (PARTITION BY role ORDER BY messages DESC, sentiment_label) AS INTEGER) AS rank FROM c) WHERE rank <= 3"""),
    "agency_messages": query(*_AG, body="""SELECT * REPLACE (CAST(datetime AS VARCHAR) AS datetime, round(agency_score, 6) AS agency_score)
        FROM agency"""),
    "agency_all": query(*_AG, body="""SELECT message_id, message_role, CASE WHEN message_role = 'user' THEN row_index END AS row_index,
        round(agency_score, 6) AS agency_score, CASE WHEN message_role = 'user' THEN is_high END AS is_high,
        CASE WHEN message_role = 'assistant' THEN is_low END AS is_low FROM agency"""),
    "agency_summary": query(*_AG, body="""SELECT upper(message_role[1]) || message_role[2:] AS message_role,
        count(message_id) AS total_messages, count(agency_score) AS scored_messages, round(avg(agency_score), 3) AS mean_agency,
        round(median(agency_score), 3) AS median_agency, round(avg(CAST(is_high AS INTEGER)) * 100, 1) AS pct_high,
        round(avg(CAST(is_low AS INTEGER)) * 100, 1) AS pct_low FROM agency GROUP BY message_role"""),
    "agency_histogram": query(*_AG, ("range_", "SELECT min(agency_score) AS mn, max(agency_score) AS mx FROM agency"),
        body="""SELECT message_role, CAST(CASE WHEN mx = mn THEN 1 ELSE least(floor((agency_score - mn) / ((mx - mn) / 40)) + 1, 40) END AS INTEGER) AS bin,
            count(*) AS messages FROM agency, range_ WHERE agency_score IS NOT NULL GROUP BY 1, 2"""),
    "agency_top_high": _top("agency_score DESC"),
    "agency_top_low": _top("agency_score ASC"),
    "agency_neutral_sample": _top("md5('42:' || message_id)", "abs(agency_score) <= 0.15"),
    "score_texts_plugin": """SELECT doc_id AS row_index, round(CAST(length(text) AS DOUBLE) / (length(text) + 1000.0), 6) AS agency_score
        FROM documents""",
}
