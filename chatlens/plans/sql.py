"""SQL fragments that restate the inputs and rules for the second engine."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from chatlens import fixed_values as fv
from chatlens.plans import fixtures as fx


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def in_list(values: Iterable[str]) -> str:
    return "(" + ", ".join(quote(v) for v in values) + ")"


def array(values: Iterable[str]) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]"


def mapping(pairs: Mapping[str, str]) -> str:
    return f"MAP({array(pairs)}, {array(pairs.values())})"


def query(*named: tuple[str, str], body: str) -> str:
    ctes = ",\n".join(f"{name} AS ({sql})" for name, sql in named)
    return f"WITH {ctes}\n{body}" if named else body


# --- inputs ------------------------------------------------------------------

RAW = ("raw_export", """
  SELECT t.conv_id * 8 + t.turn AS row_index,
         substring(CAST(e.ts AS VARCHAR), 1, 19) || 'wa' || CAST(e.user_id AS VARCHAR) AS session_id,
         t.text AS Question, e.event_type AS Category,
         CASE WHEN t.next_role = 'assistant' THEN t.next_text END AS Response,
         CASE WHEN t.next_role = 'assistant' THEN t.next_text END AS translated_answer,
         t.role AS cal_role,
         CASE WHEN e.event_type = 'error' THEN NULL ELSE e.event_type END AS cal_state,
         e.props AS cal_feedback
  FROM (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
               lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text FROM conversations) t
  JOIN events e ON e.event_id = t.conv_id * 8 + t.turn
  WHERE t.role = 'user'""")

CLEANED = ("cleaned", """
  SELECT row_index, CAST(substring(session_id, 1, 19) AS TIMESTAMP) AS datetime, substring(session_id, 20) AS whatsapp_id,
         Question AS user_msg, Category AS user_msg_category, Response AS ai_msg, translated_answer AS ai_msg_en,
         cal_state, cal_feedback
  FROM raw_export""")

MESSAGES = ("messages", r"""
  SELECT *, regexp_replace(coalesce(user_msg, ''), '^\s+|\s+$', '', 'g') AS user_msg_en FROM cleaned""")

LONG = ("long", """
  SELECT row_index, datetime, whatsapp_id, 'user' AS role, user_msg AS text_original, user_msg_en AS text FROM messages
  UNION ALL
  SELECT row_index, datetime, whatsapp_id, 'assistant', ai_msg, ai_msg_en FROM messages""")

EVENTS = ("event_messages", """
  SELECT ts AS datetime, 'wa' || CAST(user_id AS VARCHAR) AS whatsapp_id,
         CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS cal_state FROM events""")

PROBE = ("probe", """
  SELECT doc_id, lang, CASE doc_id % 8
      WHEN 0 THEN text
      WHEN 1 THEN 'see https://example.org/a?b=1 now ' || text
      WHEN 2 THEN 'mail a.b@example.org ' || text
      WHEN 3 THEN 'id 12345 ok ok ' || text
      WHEN 4 THEN 'नमस्ते ' || text
      WHEN 5 THEN 'mujhe batao kya hai ' || text
      WHEN 6 THEN 'Please provide the text ' || text
      ELSE 'business idea ' || text END AS text
  FROM documents""")

TOPICS = ("topics", """
  SELECT doc_id AS row_index, CASE WHEN lang = 'en' THEN 'user' ELSE 'assistant' END AS message_role,
         CASE WHEN doc_id % 11 = 0 THEN -1 ELSE CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) END AS topic_id,
         text
  FROM documents""")

BASE = (RAW, CLEANED, MESSAGES)
BASE_LONG = (*BASE, LONG)

# --- text rules --------------------------------------------------------------


def strip(text: str) -> str:
    return rf"regexp_replace(coalesce({text}, ''), '^\s+|\s+$', '', 'g')"


def token_count(text: str) -> str:
    return rf"CAST(len(regexp_extract_all(coalesce({text}, ''), '\S+')) AS INTEGER)"


def words(text: str) -> str:
    return f"regexp_extract_all(lower(coalesce({text}, '')), '[a-z]+')"


def hits(words_sql: str, listed: Iterable[str]) -> str:
    return f"len(list_filter({words_sql}, lambda w: w IN {in_list(listed)}))"


def english_ratio(words_sql: str) -> str:
    listed = in_list(fv.ENGLISH_WORDS)
    known = f"len(list_filter({words_sql}, lambda w: w IN {listed} OR rtrim(w, 's') IN {listed}))"
    return f"(CASE WHEN len({words_sql}) = 0 THEN 0.0 ELSE CAST({known} AS DOUBLE) / len({words_sql}) END)"


def language_columns(text: str, prefix: str = "") -> str:
    """Columns ``ratio``, ``indic``, ``latin``, ``english``, ``hindi`` with a prefix."""
    w = words(text)
    ratio, found = english_ratio(w), hits(w, fv.ROMANISED_HINDI_WORDS)
    return f"""
      {ratio} AS {prefix}english_ratio,
      regexp_matches({text}, '[\\x{{0900}}-\\x{{0D7F}}]') AS {prefix}has_indic,
      regexp_matches({text}, '[A-Za-z]') AS {prefix}has_latin,
      ({text} <> '' AND NOT regexp_matches({text}, '[^\\x00-\\x7F]') AND {ratio} >= 0.4) AS {prefix}is_english,
      ({found} >= 2 OR ({found} = 1 AND {ratio} < 0.3)) AS {prefix}is_romanised_hindi"""


def retranslation(original: str, translated: str, source: str, keep: str = "*") -> str:
    """A SELECT that adds ``needs`` to the rows of ``source``."""
    return f"""
      SELECT {keep}, CASE
          WHEN {strip(translated)} = '' THEN {strip(original)} <> ''
          WHEN t_has_indic THEN true
          WHEN o_has_latin AND NOT t_has_latin THEN true
          WHEN o_is_english THEN t_is_romanised_hindi OR o_english_ratio - t_english_ratio >= 0.2
          ELSE false END AS needs
      FROM (SELECT *, {language_columns(original, 'o_')}, {language_columns(translated, 't_')} FROM {source})"""


def collapse_text(text: str) -> str:
    toks = rf"regexp_extract_all({text}, '\S+')"
    pairs = f"list_zip({toks}, list_prepend(NULL, {toks}))"
    kept = f"list_filter({pairs}, lambda z: z[1] IS NOT NULL AND z[1] IS DISTINCT FROM z[2])"
    return f"array_to_string(list_transform({kept}, lambda z: z[1]), ' ')"


def preprocess(text: str) -> str:
    out = f"coalesce({text}, '')"
    for pattern in (r"https?://[!$-_a-z]+", r"\S+@\S+", r"\b[0-9]+\b"):
        out = f"regexp_replace({out}, '{pattern}', '', 'g')"
    return rf"trim(lower(regexp_replace({out}, '\s+', ' ', 'g')))"


def merge_phrases(text: str) -> str:
    out = text
    for phrase, token in fv.PHRASE_TOKENS:
        out = rf"regexp_replace({out}, '\b{phrase}\b', '{token}', 'g')"
    return out


def lemma(word: str) -> str:
    return (
        f"CASE WHEN {word} IN {in_list(fv.IRREGULAR_NOUNS)} THEN {mapping(fv.IRREGULAR_NOUNS)}[{word}] "
        f"WHEN len({word}) <= 3 OR {word} IN {in_list(fv.UNCHANGED_NOUNS)} THEN {word} "
        f"WHEN {word} LIKE '%ies' AND len({word}) > 4 THEN left({word}, len({word}) - 3) || 'y' "
        f"WHEN regexp_matches({word}, '(?:sses|xes|zzes|ches|shes)$') THEN left({word}, len({word}) - 2) "
        f"WHEN regexp_matches({word}, '(?:ss|us|is|[^a-z]s)$') THEN {word} "
        f"WHEN {word} LIKE '%s' THEN left({word}, len({word}) - 1) ELSE {word} END"
    )


def lemmatise(text: str) -> str:
    return rf"array_to_string(list_transform(regexp_extract_all({text}, '\S+'), lambda w: {lemma('w')}), ' ')"


ASSISTANT = rf"(?i)^({fv.ASSISTANT_OPENERS})\b|" + "|".join(fv.ASSISTANT_TEMPLATES)


def assistant_like(text: str) -> str:
    return f"regexp_matches(coalesce({text}, ''), '{ASSISTANT}')"


def clean_steps(source: str, text: str = "text") -> tuple[tuple[str, str], ...]:
    """CTEs that end in ``cleaned_rows`` with a column ``cleaned``."""
    return (
        ("clean_1", f"SELECT *, {preprocess(text)} AS pre0 FROM {source}"),
        ("clean_2", f"SELECT *, {collapse_text('pre0')} AS pre FROM clean_1"),
        ("clean_3", f"SELECT *, {merge_phrases('pre')} AS mrg FROM clean_2"),
        ("clean_4", f"SELECT *, {lemmatise('mrg')} AS lem FROM clean_3"),
        ("cleaned_rows", f"SELECT *, CASE WHEN {assistant_like('lem')} THEN '' ELSE lem END AS cleaned FROM clean_4"),
    )


def eligible(cleaned: str) -> str:
    """Whether a cleaned message is worth modelling."""
    return (f"trim({cleaned}) <> '' AND {cleaned} NOT IN {in_list(fv.SHORT_RESPONSES)} AND NOT {assistant_like(cleaned)} "
            f"AND {token_count(cleaned)} >= {fv.MIN_MESSAGE_TOKENS}")


# --- built-in scorers --------------------------------------------------------


def sentiment_steps(source: str) -> tuple[tuple[str, str], ...]:
    """CTEs that end in ``sentiment``."""
    w = words("text")
    return (
        ("sent_1", f"""SELECT *, {hits(w, fx.TEST_POSITIVE)} AS p, {hits(w, fx.TEST_NEGATIVE)} AS n
                       FROM {source} WHERE {strip('text')} <> ''"""),
        ("sent_2", "SELECT *, CASE WHEN p + n = 0 THEN 0.0 ELSE CAST(p - n AS DOUBLE) / (p + n) END AS polarity FROM sent_1"),
        ("sent_3", "SELECT *, CAST(3 + round(polarity * 2) AS INTEGER) AS stars FROM sent_2"),
        ("sentiment", """SELECT row_index, role, whatsapp_id, datetime, text AS message,
            CASE WHEN stars = 1 THEN '1 star' ELSE CAST(stars AS VARCHAR) || ' stars' END AS sentiment_label,
            (abs(polarity) + 1) / 2 AS sentiment_score, stars AS sentiment_stars FROM sent_3"""),
    )


def agency_steps(source: str) -> tuple[tuple[str, str], ...]:
    """CTEs that end in ``agency``."""
    toks = r"regexp_extract_all(coalesce(text, ''), '\S+')"
    w = words("cut")
    return (
        ("ag_1", f"""SELECT *, CASE WHEN len({toks}) > {fv.AGENCY_MAX_TOKENS}
                     THEN array_to_string({toks}[1:{fv.AGENCY_MAX_TOKENS}], ' ') ELSE {strip('text')} END AS cut FROM {source}"""),
        ("ag_2", f"""SELECT *, {hits(w, fx.TEST_POSITIVE)} AS p, {hits(w, fx.TEST_NEGATIVE)} AS n, len({w}) AS k FROM ag_1"""),
        ("ag_3", """SELECT *, CASE WHEN cut <> '' THEN
                     greatest(least(CAST(p - n AS DOUBLE) / greatest(k, 1) * 5.0, 1.0), -1.0) END AS agency_score FROM ag_2"""),
        ("agency", """SELECT role || '_' || CAST(row_index AS VARCHAR) AS message_id, row_index, role AS message_role,
            datetime, whatsapp_id, text_original, text AS text_translated, agency_score,
            agency_score >= 0.3 AS is_high, agency_score <= -0.3 AS is_low FROM ag_3"""),
    )


# --- topic tables ------------------------------------------------------------

STOP = sorted({*fv.ENGLISH_STOPWORDS, *fv.PLATFORM_STOPWORDS, *fv.FILLER_STOPWORDS, *fv.BANNED_LABEL_WORDS})


def term_steps(source: str = "topics", top: int = 10) -> tuple[tuple[str, str], ...]:
    """CTEs ``grams`` (one row per term of a document), ``vocabulary``, ``topic_terms``."""
    return (
        ("uni", f"""SELECT row_index, message_role, topic_id,
            list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w NOT IN {in_list(STOP)}) AS u
            FROM {source}"""),
        ("grams", """SELECT row_index, message_role, topic_id, unnest(list_concat(u,
            list_transform(list_zip(u[1:len(u) - 1], u[2:]), lambda z: z[1] || ' ' || z[2]))) AS term FROM uni"""),
        ("role_docs", f"SELECT message_role, count(*) AS docs FROM {source} GROUP BY 1"),
        ("vocabulary", f"""SELECT g.message_role, g.term, count(DISTINCT g.row_index) AS df FROM grams g
            GROUP BY 1, 2 HAVING count(DISTINCT g.row_index) >= {fv.MIN_TERM_DOCS}
            AND count(DISTINCT g.row_index) <= {fv.MAX_TERM_SHARE} * (SELECT docs FROM role_docs r WHERE r.message_role = g.message_role)"""),
        ("tf", """SELECT g.message_role, g.topic_id, g.term, count(*) AS tf FROM grams g
            JOIN vocabulary v ON v.message_role = g.message_role AND v.term = g.term
            WHERE g.topic_id <> -1 GROUP BY 1, 2, 3"""),
        ("avg_words", "SELECT message_role, CAST(sum(tf) AS DOUBLE) / count(DISTINCT topic_id) AS a FROM tf GROUP BY 1"),
        ("term_total", "SELECT message_role, term, sum(tf) AS f FROM tf GROUP BY 1, 2"),
        ("weighted", """SELECT tf.message_role, tf.topic_id, tf.term, tf.tf * ln(1 + a.a / t.f) AS weight FROM tf
            JOIN avg_words a ON a.message_role = tf.message_role
            JOIN term_total t ON t.message_role = tf.message_role AND t.term = tf.term"""),
        ("ranked_terms", """SELECT *, CAST(row_number() OVER (PARTITION BY message_role, topic_id
            ORDER BY round(weight, 9) DESC, term) AS INTEGER) AS rank FROM weighted"""),
        ("topic_terms", f"SELECT message_role, topic_id, rank, term, weight FROM ranked_terms WHERE rank <= {top}"),
    )


KEYWORDS = ("topic_kw", """
  SELECT message_role, topic_id, string_agg(term, ', ' ORDER BY rank) AS keywords,
         CAST(topic_id AS VARCHAR) || '_' || string_agg(term, '_' ORDER BY rank) FILTER (WHERE rank <= 4) AS name,
         list(term ORDER BY rank) AS terms
  FROM topic_terms GROUP BY 1, 2""")
SIZES = ("topic_sizes", "SELECT message_role, topic_id, count(*) AS message_count FROM topics WHERE topic_id <> -1 GROUP BY 1, 2")
TABLE = (TOPICS, *term_steps(), KEYWORDS, SIZES)
