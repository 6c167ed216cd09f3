"""SQL restatements of the queries on text rules, topics and report tables."""

from __future__ import annotations

import math

from chatlens import fixed_values as fv
from chatlens.plans import fixtures as fx
from chatlens.plans import sql
from chatlens.plans.message_queries import _SENT
from chatlens.plans.sql import EVENTS, PROBE, TABLE, TOPICS, array, in_list, mapping, query
from chatlens.plans.topic_queries import CHAIN_WIDTH, LEMMA_EXCEPTIONS, NEAR, REDUCE_AT, TARGET_TOPICS, TREE_LEVELS, TREE_RADIUS
from chatlens.topics.cluster import WIDTHS_PER_CELL, grid_shifts
from chatlens.topics.cluster_tree import ladder

_BANNED = in_list(fv.BANNED_LABEL_WORDS)
_PARTS = array([*fv.BANNED_LABEL_WORDS, *fv.BANNED_LABEL_PARTS])
_INTENTS = mapping({word: intent.lower() for word, intent in fv.INTENT_WORDS.items()})


def _label_tokens(text: str) -> str:
    return (rf"list_filter(regexp_split_to_array(lower({text}), '[\s_/,-]+'), "
            f"lambda t: t <> '' AND t NOT IN {_BANNED})")


def _synonyms(parts: str) -> str:
    return f"flatten(list_transform({parts}, lambda t: string_split(coalesce({_INTENTS}[t], t), ' ')))"


def _ordered_distinct(column: str) -> str:
    return f"list_filter({column}, lambda x, i: list_position({column}, x) = i)"


def _has_banned(label: str) -> str:
    return f"len(list_filter({_PARTS}, lambda p: contains(lower({label}), p))) > 0"


def _format(parts: str) -> str:
    kept = f"list_filter({parts}, lambda t: t <> '' AND t NOT IN {_BANNED})"
    chosen = f"(CASE WHEN len({kept}) < 2 THEN {parts}[1:2] ELSE {kept} END)[1:5]"
    return f"array_to_string(list_transform({chosen}, lambda t: upper(t[1]) || lower(t[2:])), ' ')"


INFO = ("info", """
  SELECT s.message_role, s.topic_id, s.message_count, coalesce(k.name, CAST(s.topic_id AS VARCHAR)) AS name, k.terms, k.keywords
  FROM topic_sizes s LEFT JOIN topic_kw k ON k.message_role = s.message_role AND k.topic_id = s.topic_id""")
def _label_steps(source: str = "info", raw: str = "name") -> tuple[tuple[str, str], ...]:
    """CTEs that end in ``labels_``; ``raw`` is the label or name to start from."""
    return (
        ("lab_1", f"SELECT *, {raw} AS raw, terms[1:8] AS head FROM {source}"),
        ("lab_2", f"""SELECT *, flatten(list_transform(list_concat(list_filter(head, lambda t: contains(t, '_'))[1:3],
            list_filter(head, lambda t: NOT contains(t, '_'))[1:5]), lambda t: {_label_tokens('t')})) AS parts FROM lab_1"""),
        ("lab_3", f"SELECT *, {_synonyms('(CASE WHEN len(parts) = 0 THEN terms[1:1] ELSE parts END)')} AS syn FROM lab_2"),
        ("lab_4", f"""SELECT *, {_ordered_distinct('syn')} AS uniq,
            flatten(list_transform(terms[1:10], lambda t: {_label_tokens('t')})) AS more FROM lab_3"""),
        ("lab_5", "SELECT *, list_concat(uniq, more) AS longer FROM lab_4"),
        ("lab_6", f"""SELECT *, (CASE WHEN len(uniq) < 2 THEN ({_ordered_distinct('longer')})[1:3] ELSE uniq END)[1:5] AS kw,
            {_synonyms(_label_tokens('raw'))} AS own FROM lab_5"""),
        ("lab_7", f"SELECT *, CASE WHEN len(own) < 2 OR {_has_banned('raw')} THEN kw ELSE own END AS pick FROM lab_6"),
        ("lab_8", f"SELECT *, {_format('pick')} AS first_label, {_format('kw')} AS kw_label FROM lab_7"),
        ("labels_", f"""SELECT message_role, topic_id, CASE WHEN {_has_banned('first_label')} THEN kw_label ELSE first_label END
            AS intent_label FROM lab_8"""),
    )


_INFO = (*TABLE, INFO)
_LABELLED = (*_INFO, *_label_steps())
_KW = (*_INFO, ("kw", "SELECT message_role, topic_id, name AS intent_label, keywords, message_count FROM info WHERE len(terms) > 0"))


def _examples(n: int) -> tuple[str, str]:
    return ("examples", f"""SELECT * FROM (SELECT message_role, topic_id, row_index, text AS example,
        CAST(row_number() OVER (PARTITION BY message_role, topic_id ORDER BY row_index) AS INTEGER) AS rank
        FROM topics WHERE topic_id <> -1 AND text IS NOT NULL) WHERE rank <= {n}""")


_METRICS = (*TABLE, ("metric", """
  SELECT r.message_role, coalesce(n, 0) AS num_topics, coalesce(d, 0.0) AS diversity, coalesce(av, 0) AS avg_topic_size,
         coalesce(md, 0) AS median_topic_size, total AS total_messages, outliers
  FROM (SELECT message_role, count(*) AS total, count(*) FILTER (WHERE topic_id = -1) AS outliers FROM topics GROUP BY 1) r
  LEFT JOIN (SELECT message_role, count(*) AS n, CAST(trunc(avg(message_count)) AS BIGINT) AS av,
             CAST(trunc(median(message_count)) AS BIGINT) AS md FROM topic_sizes GROUP BY 1) s USING (message_role)
  LEFT JOIN (SELECT message_role, round(CAST(count(DISTINCT term) AS DOUBLE) / count(*), 3) AS d FROM topic_terms GROUP BY 1) t
  USING (message_role)"""))

_EMB = ("emb", """SELECT vec_id AS row_index, 'user' AS message_role, label AS topic_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v
  FROM embeddings""")


_LINKED = ("linked", """SELECT vec_id AS row_index, CASE WHEN lang = 'en' THEN 'user' ELSE 'assistant' END AS message_role, text,
  list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings JOIN documents ON doc_id = vec_id""")
_LETTER_COUNTS = ("letter_counts", f"""SELECT doc_id AS row_index,
    list_transform({array(fx.LETTERS)}, lambda c: length(lower(text)) - length(replace(lower(text), c, ''))) AS n FROM documents""")
_TOPIC_LETTERS = ("emb", f"""SELECT t.row_index, t.message_role, t.topic_id, t.text,
    list_transform(n, lambda x: CAST(x AS DOUBLE) / greatest(list_sum(n), 1)) AS v FROM topics t JOIN letter_counts USING (row_index)
    WHERE t.topic_id <> -1""")
_LETTERS = ("emb", f"""SELECT row_index, message_role, topic_id,
    list_transform(n, lambda x: CAST(x AS DOUBLE) / greatest(list_sum(n), 1)) AS v FROM (
    SELECT doc_id AS row_index, lang AS message_role, CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) AS topic_id,
    list_transform({array(fx.LETTERS)}, lambda c: length(lower(text)) - length(replace(lower(text), c, ''))) AS n FROM documents)""")


def _centroids(name: str, source: str) -> tuple[str, str]:
    return (name, f"""SELECT message_role, topic_id, list(m ORDER BY pos) AS c FROM (
        SELECT message_role, topic_id, pos, avg(x) AS m FROM (
        SELECT message_role, topic_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM {source}) GROUP BY 1, 2, 3) GROUP BY 1, 2""")


def _pairs(name: str, centres: str, threshold: float) -> tuple[str, str]:
    cosine = "list_dot_product(a.c, b.c) / (sqrt(list_dot_product(a.c, a.c)) * sqrt(list_dot_product(b.c, b.c)))"
    return (name, f"""SELECT a.message_role, a.topic_id AS topic_a, b.topic_id AS topic_b, {cosine} AS similarity
        FROM {centres} a JOIN {centres} b ON a.message_role = b.message_role AND a.topic_id < b.topic_id WHERE {cosine} >= {threshold}""")


def _merge_round(i: int, source: str) -> tuple[tuple[str, str], ...]:
    return (
        _centroids(f"cen_{i}", source), _pairs(f"pair_{i}", f"cen_{i}", 0.95),
        (f"best_{i}", f"""SELECT message_role, topic_a, topic_b FROM pair_{i} QUALIFY row_number() OVER (
            PARTITION BY message_role ORDER BY round(similarity, 9) DESC, topic_a, topic_b) = 1"""),
        (f"emb_{i}", f"""SELECT e.row_index, e.message_role, CASE WHEN b.topic_b IS NOT NULL THEN b.topic_a ELSE e.topic_id END AS topic_id, e.v
            FROM {source} e LEFT JOIN best_{i} b ON b.message_role = e.message_role AND b.topic_b = e.topic_id"""),
    )


_SPELL = """list_filter([b, replace(b, '_', ' '),
    CASE WHEN plain THEN b || 's' END, CASE WHEN plain THEN b || 'ed' END, CASE WHEN plain THEN b || 'ing' END,
    CASE WHEN e AND length(b) > 2 THEN stem || 'ed' END, CASE WHEN e AND length(b) > 2 THEN stem || 'ing' END,
    CASE WHEN e THEN stem || 'ion' END, CASE WHEN NOT b LIKE '%ment' THEN b || 'ment' END], lambda x: x IS NOT NULL)"""

def _recursive(*named: tuple[str, str], body: str) -> str:
    return "WITH RECURSIVE " + query(*named, body=body)[len("WITH "):]


def _density(source: str, width: float) -> tuple[tuple[str, str], ...]:
    """CTEs from ``source(row_index, message_role, v)`` to ``found(row_index, message_role, topic_id)``."""
    cell = lambda axis: f"CAST(floor(({axis} + s) / {width}) AS BIGINT) AS {axis}"
    shifts = ", ".join(f"({k}, CAST({shift!r} AS DOUBLE))" for k, shift in enumerate(grid_shifts(width, 3)))
    return (
        ("sums", f"SELECT row_index, message_role, list_sum(v[1:21]) AS x, list_sum(v[22:42]) AS y, list_sum(v[43:64]) AS z FROM {source}"),
        ("pts", f"SELECT row_index, message_role, g, {cell('x')}, {cell('y')}, {cell('z')} FROM sums, (VALUES {shifts}) AS grids(g, s)"),
        ("dense", """SELECT message_role, g, x, y, z, row_number() OVER (ORDER BY message_role, g, x, y, z) AS node FROM pts
            GROUP BY 1, 2, 3, 4, 5 HAVING count(*) >= 4"""),
        ("inside", "SELECT row_index, message_role, node FROM pts JOIN dense USING (message_role, g, x, y, z)"),
        ("touch", "SELECT DISTINCT a.node AS u, b.node AS v FROM inside a JOIN inside b USING (row_index)"),
        ("reach", "SELECT node AS a, node AS b FROM dense UNION SELECT r.a, t.v FROM reach r JOIN touch t ON t.u = r.b"),
        ("part", "SELECT a AS node, min(b) AS p FROM reach GROUP BY 1"),
        ("member", "SELECT DISTINCT row_index, message_role, p FROM inside JOIN part USING (node)"),
        ("sized", "SELECT message_role, p, count(*) AS s, min(row_index) AS f FROM member GROUP BY 1, 2 HAVING count(*) >= 8"),
        ("numbered", "SELECT p, CAST(row_number() OVER (PARTITION BY message_role ORDER BY s DESC, f) - 1 AS INTEGER) AS topic_id FROM sized"),
        ("found", """SELECT s.row_index, s.message_role, coalesce(topic_id, -1) AS topic_id FROM sums s
            LEFT JOIN member m USING (row_index) LEFT JOIN numbered USING (p)"""),
    )


_CELL = NEAR / math.sqrt(3) * (1 - 1e-9)
SPREAD_STEPS = 12  # more than the given tables need
_PLACED = ("pts", "SELECT row_index, message_role, list_sum(v[1:21]) AS x, list_sum(v[22:42]) AS y, list_sum(v[43:64]) AS z FROM linked")
_APART = "((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"


def _near(radius: float) -> tuple[tuple[str, str], ...]:
    """CTEs: ``near(a, b, d)`` for all neighbours, themselves included, and ``core(a)``."""
    return (
        _LINKED, _PLACED,
        ("near", f"""SELECT a.row_index AS a, b.row_index AS b, {_APART} AS d FROM pts a JOIN pts b
            ON a.message_role = b.message_role AND {_APART} <= {radius * radius!r}"""),
        ("core", "SELECT a FROM near GROUP BY a HAVING count(*) >= 4"),
    )


_GRAPH = (
    *_near(NEAR),
    ("link", "SELECT a, b FROM near WHERE a IN (SELECT a FROM core) AND b IN (SELECT a FROM core)"),
    ("edge", """SELECT a, b AS nearest FROM near WHERE a NOT IN (SELECT a FROM core) AND b IN (SELECT a FROM core)
        QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) = 1"""),
)


def _tree_steps() -> tuple[tuple[str, str], ...]:
    """CTEs that end in ``head_K`` for each level, ``heads`` and ``chosen_part(level, part, row_index)``."""
    radii = ladder(TREE_RADIUS, TREE_LEVELS)
    last = TREE_LEVELS - 1
    steps = [
        *_near(TREE_RADIUS),
        ("corelen", "SELECT a, d AS c FROM near QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) = 4"),
        ("mutual", """SELECT n.a, n.b, greatest(n.d, x.c, y.c) AS w FROM near n JOIN corelen x ON x.a = n.a JOIN corelen y ON y.a = n.b
            WHERE n.a <> n.b"""),
    ]
    for k, r in enumerate(radii):
        # A least member that does not get smaller in any further step names the part.
        steps += [
            (f"reach_{k}", f"""SELECT a, a AS p FROM corelen WHERE c <= {r * r!r} UNION
                SELECT m.b, r.p FROM reach_{k} r JOIN mutual m ON m.a = r.a WHERE m.w <= {r * r!r} AND r.p < m.b"""),
            (f"part_{k}", f"SELECT a, min(p) AS p FROM reach_{k} GROUP BY a"),
            (f"node_{k}", f"SELECT message_role, p, count(*) AS n FROM part_{k} JOIN pts ON row_index = a GROUP BY 1, 2 HAVING count(*) >= 8"),
        ]
    for k in range(last, -1, -1):
        step = 1 / radii[k] - 1 / radii[k - 1] if k else 0.0
        child = (f"SELECT above AS p, count(*) AS k, sum(round(greatest(chain, below), 9)) AS worth, max(chain) AS c1, max(below) AS b1 "
                 f"FROM weigh_{k + 1} GROUP BY 1") if k < last else "SELECT CAST(NULL AS BIGINT) AS p, 0 AS k, 0.0 AS worth, 0.0 AS c1, 0.0 AS b1 WHERE false"
        above = f"(SELECT u.p FROM part_{k - 1} u WHERE u.a = n.p)" if k else "CAST(NULL AS BIGINT)"
        steps.append((f"weigh_{k}", f"""SELECT n.message_role, n.p, n.n, {above} AS above, coalesce(c.k, 0) AS k,
            n.n * CAST({step!r} AS DOUBLE) + CASE WHEN c.k = 1 THEN c1 ELSE 0.0 END AS chain,
            CASE WHEN c.k = 1 THEN b1 WHEN c.k > 1 THEN worth ELSE 0.0 END AS below FROM node_{k} n LEFT JOIN ({child}) c ON c.p = n.p"""))
    for k in range(TREE_LEVELS):
        before = f"LEFT JOIN head_{k - 1} u ON u.p = w.above" if k else "LEFT JOIN (SELECT 0 AS k, 0 AS hl, CAST(0 AS BIGINT) AS hp, '' AS st WHERE false) u ON true"
        steps.append((f"head_{k}", f"""SELECT w.message_role, w.p, w.n, w.k, w.chain, coalesce(u.k = 1, false) AS goes_on,
            CASE WHEN u.k = 1 THEN u.hl ELSE {k} END AS hl, CASE WHEN u.k = 1 THEN u.hp ELSE w.p END AS hp,
            CASE WHEN u.k = 1 THEN CASE WHEN u.st = 'split' THEN 'split' ELSE 'within' END
                 WHEN u.st IS NOT NULL AND u.st <> 'split' THEN 'within'
                 WHEN round(w.chain, 9) >= round(w.below, 9) THEN 'chosen' ELSE 'split' END AS st FROM weigh_{k} w {before}"""))
    steps.append(("heads", " UNION ALL ".join(
        f"SELECT message_role, {k} AS level, CAST({r!r} AS DOUBLE) AS radius, p, n, chain, st = 'chosen' AS chosen FROM head_{k} WHERE NOT goes_on"
        for k, r in enumerate(radii))))
    steps.append(("members", " UNION ALL ".join(
        f"SELECT h.message_role, h.level, h.p, q.a AS row_index FROM heads h JOIN part_{k} q ON q.p = h.p WHERE h.level = {k} AND h.chosen"
        for k in range(TREE_LEVELS))))
    steps.append(("numbers", """SELECT level, p, CAST(row_number() OVER (PARTITION BY message_role ORDER BY count(*) DESC, min(row_index)) - 1 AS INTEGER)
        AS topic_id FROM members GROUP BY message_role, level, p"""))
    return tuple(steps)


def _target_round(i: int, source: str) -> tuple[tuple[str, str], ...]:
    cosine = "list_dot_product(a.c, b.c) / (sqrt(list_dot_product(a.c, a.c)) * sqrt(list_dot_product(b.c, b.c)))"
    return (
        _centroids(f"cen_{i}", source),
        (f"near_{i}", f"""SELECT a.message_role, a.topic_id AS a, b.topic_id AS b, round({cosine}, 9) AS s FROM cen_{i} a JOIN cen_{i} b
            ON a.message_role = b.message_role AND a.topic_id <> b.topic_id
            QUALIFY row_number() OVER (PARTITION BY a.message_role, a.topic_id ORDER BY round({cosine}, 9) DESC, b.topic_id) = 1"""),
        (f"over_{i}", f"SELECT message_role, count(*) - {TARGET_TOPICS} AS x FROM cen_{i} GROUP BY 1"),
        (f"join_{i}", f"""SELECT message_role, a, b FROM (SELECT n.message_role, n.a, n.b, row_number() OVER (
            PARTITION BY n.message_role ORDER BY n.s DESC, n.a) AS r FROM near_{i} n JOIN near_{i} m
            ON m.message_role = n.message_role AND m.a = n.b AND m.b = n.a WHERE n.a < n.b) JOIN over_{i} USING (message_role) WHERE r <= x"""),
        (f"emb_{i}", f"""SELECT e.row_index, e.message_role, coalesce(j.a, e.topic_id) AS topic_id, e.v FROM {source} e
            LEFT JOIN join_{i} j ON j.message_role = e.message_role AND j.b = e.topic_id"""),
    )


TARGET_ROUNDS = 10  # more than the given tables need; a round without excess changes nothing

_VARIANTS = (
    ("base", "SELECT message_role, topic_id, lower(trim(unnest(string_split(keywords, ',')))) AS b FROM kw"),
    ("rules", """SELECT *, NOT regexp_matches(b, '(?:s|ed|ing|tion|ment)$') AS plain, b LIKE '%e' AS e, left(b, length(b) - 1) AS stem
        FROM base WHERE b <> ''"""),
    ("variants", f"SELECT DISTINCT message_role, topic_id, unnest({_SPELL}) AS variant FROM rules"),
)

# Words stand between two marks, so that a whole word is a literal; the tags' own words do, too.
_OPEN, _CLOSE = "chr(1)", "chr(2)"
_TAG = f"{_OPEN} || 'mark' || {_CLOSE}"
_MARKED = rf"""list_reduce(spelt, lambda t, v: regexp_replace(t, '(?i)' || {_OPEN} || replace(v, ' ', {_CLOSE} || ' ' || {_OPEN}) || {_CLOSE},
    '<' || {_TAG} || '>\0</' || {_TAG} || '>', 'g'), regexp_replace(example, '([{fv.WORD_CLASS}]+)', {_OPEN} || '\1' || {_CLOSE}, 'g'))"""

ORACLE = {
    "lang_flags": query(PROBE, ("f", f"SELECT doc_id, {sql.language_columns('text')} FROM probe"),
                        body="SELECT * REPLACE (round(english_ratio, 6) AS english_ratio) FROM f"),
    "english_ratio": f"SELECT doc_id, round({sql.english_ratio(sql.words('text'))}, 6) AS english_ratio FROM documents",
    "collapse_tokens": query(PROBE, body=f"SELECT doc_id, {sql.collapse_text('text')} AS collapsed FROM probe"),
    "assistant_like": query(PROBE, body=f"SELECT doc_id, {sql.assistant_like('text')} AS assistant_like FROM probe"),
    "preprocess_text": query(PROBE, ("p", f"SELECT doc_id, {sql.preprocess('text')} AS t FROM probe"),
                             body=f"SELECT doc_id, {sql.collapse_text('t')} AS preprocessed FROM p"),
    "merge_phrases": query(PROBE, body=f"SELECT doc_id, {sql.merge_phrases('lower(text)')} AS merged FROM probe"),
    "lemmatize": f"SELECT doc_id, {sql.lemmatise('lower(text)')} AS lemmas FROM documents",
    "clean_message": query(PROBE, *sql.clean_steps("probe"), body="SELECT doc_id, cleaned FROM cleaned_rows"),
    "truncate_tokens": query(
        ("s", rf"SELECT doc_id, regexp_replace(regexp_replace(text, '\s\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS t FROM documents"),
        body=rf"""SELECT doc_id, CASE WHEN len(regexp_extract_all(t, '\S+')) > {fv.AGENCY_MAX_TOKENS}
            THEN array_to_string(regexp_extract_all(t, '\S+')[1:{fv.AGENCY_MAX_TOKENS}], ' ') ELSE t END AS truncated FROM s"""),
    "topic_eligible": query(PROBE, *sql.clean_steps("probe"), body=f"""SELECT doc_id AS row_index, cleaned FROM cleaned_rows
        WHERE {sql.eligible('cleaned')}"""),
    "stopword_table": f"""SELECT word, count(*) AS occurrences FROM (
        SELECT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS word FROM documents)
        WHERE word IN {in_list(sql.STOP)} GROUP BY 1""",
    "vocabulary": query(*TABLE, body="SELECT message_role, term, df FROM vocabulary"),
    "topic_terms": query(*TABLE, body="SELECT * REPLACE (round(weight, 6) AS weight) FROM topic_terms"),
    "topic_info": query(*_INFO, body="SELECT message_role, topic_id, message_count, name FROM info"),
    "topic_keywords": query(*_LABELLED, body="""SELECT i.message_role, i.topic_id, l.intent_label, i.keywords, i.message_count
        FROM info i JOIN labels_ l USING (message_role, topic_id) WHERE len(i.terms) > 0"""),
    "active_topics": query(*_KW, body="""SELECT message_role, topic_id, keywords FROM kw WHERE EXISTS (SELECT 1 FROM topics t
        WHERE t.message_role = kw.message_role AND t.topic_id = kw.topic_id AND length(t.text) > 400)"""),
    "message_topics": query(*_LABELLED, body="""SELECT t.row_index, t.message_role, t.topic_id,
        CASE WHEN t.topic_id = -1 THEN 'Outlier' ELSE coalesce(l.intent_label, 'Topic ' || t.topic_id) END AS intent_label
        FROM topics t LEFT JOIN labels_ l USING (message_role, topic_id)"""),
    "topic_examples": query(TOPICS, _examples(3), body="SELECT * FROM examples"),
    "topic_diagnostics": query(*_LABELLED, _examples(3), body=f"""
        SELECT i.message_role, i.topic_id, l.intent_label, i.keywords, i.message_count, round(a.k, 6) AS avg_tokens,
               a.k < 4 AS short_warning, coalesce(e1.example, '') AS example_1, coalesce(e2.example, '') AS example_2,
               coalesce(e3.example, '') AS example_3
        FROM info i JOIN labels_ l USING (message_role, topic_id)
        JOIN (SELECT message_role, topic_id, avg({sql.token_count('text')}) AS k FROM topics GROUP BY 1, 2) a USING (message_role, topic_id)
        LEFT JOIN examples e1 ON e1.message_role = i.message_role AND e1.topic_id = i.topic_id AND e1.rank = 1
        LEFT JOIN examples e2 ON e2.message_role = i.message_role AND e2.topic_id = i.topic_id AND e2.rank = 2
        LEFT JOIN examples e3 ON e3.message_role = i.message_role AND e3.topic_id = i.topic_id AND e3.rank = 3"""),
    "topic_labels": query(*_LABELLED, body="SELECT * FROM labels_"),
    "supplied_labels": query(*_INFO, ("answer", """SELECT message_role, topic_id,
        CASE WHEN length(terms[1]) > 2 THEN ' ' || terms[1] || ' ' || terms[2] || ' ' END AS supplied_label FROM info"""),
        body=f"""SELECT * FROM answer WHERE supplied_label IS NOT NULL
        AND len(list_filter({array(fv.TOO_SPECIFIC_PARTS)}, lambda p: contains(lower(supplied_label), p))) = 0"""),
    "supplied_to_final_labels": query(*_INFO, ("answer", f"""SELECT message_role, topic_id, ' ' || terms[1] || ' ' || terms[2] || ' ' AS given
        FROM info WHERE length(terms[1]) > 2"""), ("with_answer", f"""SELECT i.*, coalesce(CASE WHEN len(list_filter(
        {array(fv.TOO_SPECIFIC_PARTS)}, lambda p: contains(lower(given), p))) = 0 THEN given END, name) AS start FROM info i
        LEFT JOIN answer USING (message_role, topic_id)"""), *_label_steps("with_answer", "start"), body="SELECT * FROM labels_"),
    "topic_metrics": query(*_METRICS, body="SELECT * FROM metric"),
    "topic_quality_flags": query(*_METRICS, body="""SELECT message_role, num_topics, diversity, num_topics < 10 AS too_few_topics,
        num_topics > 30 AS too_many_topics, diversity < 0.6 AS low_diversity FROM metric"""),
    "topic_coherence": query(*TABLE,
        ("doc_terms", "SELECT DISTINCT row_index, message_role, term FROM grams"),
        ("one", """SELECT t.message_role, t.topic_id, t.term, t.rank, count(d.row_index) AS c FROM topic_terms t
            LEFT JOIN doc_terms d ON d.message_role = t.message_role AND d.term = t.term GROUP BY 1, 2, 3, 4"""),
        ("two", """SELECT a.message_role, a.topic_id, a.term AS ta, b.term AS tb, count(*) AS c FROM topic_terms a
            JOIN topic_terms b ON b.message_role = a.message_role AND b.topic_id = a.topic_id AND a.term < b.term
            JOIN doc_terms x ON x.message_role = a.message_role AND x.term = a.term
            JOIN doc_terms y ON y.message_role = a.message_role AND y.term = b.term AND y.row_index = x.row_index GROUP BY 1, 2, 3, 4"""),
        ("scored", """SELECT a.message_role, a.topic_id, CASE WHEN two.c IS NULL THEN -1.0 WHEN two.c = r.docs THEN 1.0 ELSE
            ln(CAST(two.c AS DOUBLE) * r.docs / (CAST(a.c AS DOUBLE) * b.c)) / -ln(CAST(two.c AS DOUBLE) / r.docs) END AS npmi
            FROM one a JOIN one b ON b.message_role = a.message_role AND b.topic_id = a.topic_id AND a.term < b.term
            JOIN role_docs r ON r.message_role = a.message_role
            LEFT JOIN two ON two.message_role = a.message_role AND two.topic_id = a.topic_id AND two.ta = a.term AND two.tb = b.term"""),
        body="SELECT message_role, topic_id, round(avg(npmi), 6) AS coherence_c_npmi FROM scored GROUP BY 1, 2"),
    "drop_low_quality_topics": query(TOPICS,
        ("cut", r"""SELECT row_index, message_role, topic_id, text FROM topics UNION ALL
            SELECT -1 - row_index, message_role, topic_id + 100, array_to_string(regexp_extract_all(text, '\S+')[1:2], ' ') FROM topics
            WHERE topic_id BETWEEN 0 AND 2"""),
        ("q", f"""SELECT message_role, topic_id, coalesce(avg(nullif({sql.token_count('text')}, 0)), 0) < 3
            OR avg(CAST({sql.assistant_like('text')} AS INTEGER)) > 0.6 AS low FROM cut WHERE topic_id <> -1 GROUP BY 1, 2"""),
        body="""SELECT c.row_index, c.message_role, CASE WHEN q.low THEN -1 ELSE c.topic_id END AS topic_id
            FROM cut c LEFT JOIN q USING (message_role, topic_id)"""),
    "filter_trivial": query(TOPICS, ("cut", """SELECT row_index, message_role, topic_id, text FROM topics UNION ALL
            SELECT -1 - row_index, message_role, topic_id, regexp_extract(text, '^[^.]*', 0) FROM topics"""),
        body=f"""SELECT row_index, message_role, CASE WHEN {sql.token_count('text')} < 6 OR text IN {in_list(fv.SHORT_RESPONSES)}
            THEN -1 ELSE topic_id END AS topic_id FROM cut"""),
    "seed_topic_match": query(PROBE,
        ("seeds", """SELECT * FROM (VALUES (0, ['the', 'and', 'of']), (1, ['idea', 'business', 'in']), (2, ['de', 'la', 'les']),
            (3, ['der', 'die', 'und']), (4, ['text', 'please'])) s(seed, words)"""),
        ("sets", r"SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS w FROM probe"),
        ("sims", """SELECT doc_id, seed, CASE WHEN len(w) = 0 THEN 0.0
            ELSE len(list_intersect(w, words)) / sqrt(CAST(len(w) AS DOUBLE) * len(words)) END AS s FROM sets, seeds"""),
        ("best", "SELECT doc_id, seed, s, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, seed) AS r FROM sims"),
        body="""SELECT doc_id, CASE WHEN s > 0 THEN CAST(seed AS INTEGER) END AS seed_topic, CASE WHEN s > 0 THEN round(s, 6) END AS seed_similarity
            FROM best WHERE r = 1"""),
    "topic_similarity_pairs": query(_LETTERS, _centroids("cen", "emb"), _pairs("pair", "cen", 0.99),
        body="SELECT message_role, topic_a, topic_b, round(similarity, 6) AS similarity FROM pair"),
    "merge_topics": query(_LETTERS, *_merge_round(1, "emb"), *_merge_round(2, "emb_1"),
        body="SELECT row_index, message_role, topic_id FROM emb_2"),
    "reduce_topics": "WITH RECURSIVE " + query(_LETTERS, _centroids("cen", "emb"), _pairs("pair", "cen", REDUCE_AT),
        ("reach", """SELECT message_role, topic_id AS a, topic_id AS b FROM cen
            UNION SELECT r.message_role, r.a, CASE WHEN p.topic_a = r.b THEN p.topic_b ELSE p.topic_a END FROM reach r
            JOIN pair p ON p.message_role = r.message_role AND (p.topic_a = r.b OR p.topic_b = r.b)"""),
        ("named", "SELECT message_role, a, min(b) AS n FROM reach GROUP BY 1, 2"),
        body="SELECT e.row_index, e.message_role, m.n AS topic_id FROM emb e JOIN named m ON m.message_role = e.message_role AND m.a = e.topic_id")[len("WITH "):],
    "representative_docs": query(_EMB, _centroids("cen", "emb"),
        ("sim", """SELECT e.topic_id, e.row_index, list_dot_product(e.v, c.c) / (sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(c.c, c.c))) AS s
            FROM emb e JOIN cen c USING (topic_id)"""),
        body="""SELECT 'user' AS message_role, topic_id, rank, row_index, round(s, 6) AS similarity FROM (
            SELECT *, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY round(s, 9) DESC, row_index) AS INTEGER) AS rank FROM sim) WHERE rank <= 2"""),
    "topic_representation": query(*_INFO, _LETTER_COUNTS, _TOPIC_LETTERS, _centroids("cen", "emb"),
        ("sim", """SELECT e.message_role, e.topic_id, e.row_index, e.text,
            list_dot_product(e.v, c.c) / (sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(c.c, c.c))) AS s
            FROM emb e JOIN cen c USING (message_role, topic_id)"""),
        ("best", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY message_role, topic_id
            ORDER BY round(s, 9) DESC, row_index) AS rank FROM sim) WHERE rank <= 2"""),
        body="""SELECT k.message_role, k.topic_id,
        trim(array_to_string(k.terms[1:10], ' ') || coalesce(' ' || e.t, '')) AS representation FROM topic_kw k
        LEFT JOIN (SELECT message_role, topic_id, string_agg(text, ' ' ORDER BY rank) AS t FROM best GROUP BY 1, 2) e
        USING (message_role, topic_id)"""),
    "density_clusters": _recursive(_EMB, *_density("emb", 0.15 * WIDTHS_PER_CELL), body="SELECT * FROM found"),
    "neighbour_clusters": _recursive(*_GRAPH,
        ("reach", "SELECT a, a AS p FROM core UNION SELECT l.b, r.p FROM reach r JOIN link l ON l.a = r.a WHERE r.p < l.b"),
        ("part", "SELECT a, min(p) AS p FROM reach GROUP BY a"),
        ("member", "SELECT a, p FROM part UNION ALL SELECT e.a, p.p FROM edge e JOIN part p ON p.a = e.nearest"),
        ("sized", "SELECT message_role, p, count(*) AS n, min(a) AS f FROM member JOIN pts ON row_index = a GROUP BY 1, 2 HAVING count(*) >= 8"),
        ("numbered", "SELECT p, CAST(row_number() OVER (PARTITION BY message_role ORDER BY n DESC, f) - 1 AS INTEGER) AS topic_id FROM sized"),
        body="""SELECT s.row_index, s.message_role, coalesce(topic_id, -1) AS topic_id, s.row_index IN (SELECT a FROM core) AS is_core
            FROM pts s LEFT JOIN member m ON m.a = s.row_index LEFT JOIN numbered USING (p)"""),
    "cluster_tree": _recursive(*_tree_steps(), body="""SELECT s.row_index, s.message_role, coalesce(topic_id, -1) AS topic_id
        FROM pts s LEFT JOIN members m USING (row_index) LEFT JOIN numbers n ON n.level = m.level AND n.p = m.p"""),
    "cluster_tree_nodes": _recursive(*_tree_steps(), body="""SELECT message_role, h.level, round(radius, 9) AS radius, n AS size,
        round(chain, 6) AS stability, chosen, topic_id FROM heads h LEFT JOIN numbers b ON b.level = h.level AND b.p = h.p"""),
    "spread_seeds": _recursive(*_GRAPH,
        ("cells", f"SELECT row_index, message_role, {', '.join(f'floor({c} / {_CELL!r}) AS c{c}' for c in 'xyz')} FROM pts"),
        ("dense", "SELECT message_role, cx, cy, cz, min(row_index) AS s FROM cells GROUP BY 1, 2, 3, 4 HAVING count(*) >= 4"),
        ("place", """SELECT c.row_index AS a, coalesce(d.s, c.row_index) AS s FROM cells c LEFT JOIN dense d USING (message_role, cx, cy, cz)
            WHERE c.row_index IN (SELECT a FROM core)"""),
        ("weight", "SELECT s, count(*) AS n FROM place GROUP BY s"),
        ("touch", "SELECT DISTINCT x.s AS u, y.s AS v FROM link l JOIN place x ON x.a = l.a JOIN place y ON y.a = l.b WHERE x.s <> y.s"),
        ("seeds", "SELECT row_index AS a, CAST(floor(row_index / 20) % 3 AS INTEGER) AS seed FROM pts WHERE row_index % 20 = 0"),
        ("step_0", """SELECT s, seed, 0 AS step FROM (SELECT s, seed, row_number() OVER (PARTITION BY s ORDER BY count(*) DESC, seed) AS r
            FROM seeds JOIN place USING (a) GROUP BY s, seed) WHERE r = 1"""),
        *[(f"step_{k}", f"""SELECT s, seed, step FROM step_{k - 1} UNION ALL SELECT s, seed, {k} FROM (
            SELECT t.v AS s, p.seed, row_number() OVER (PARTITION BY t.v ORDER BY sum(w.n) DESC, p.seed) AS r FROM touch t
            JOIN step_{k - 1} p ON p.s = t.u JOIN weight w ON w.s = t.u
            WHERE t.v NOT IN (SELECT s FROM step_{k - 1}) GROUP BY t.v, p.seed) WHERE r = 1""") for k in range(1, SPREAD_STEPS + 1)],
        ("taken", f"SELECT * FROM step_{SPREAD_STEPS}"),
        ("own", "SELECT a, s FROM place UNION ALL SELECT e.a, p.s FROM edge e JOIN place p ON p.a = e.nearest"),
        body="""SELECT q.row_index, q.message_role, coalesce(d.seed, t.seed) AS spread_topic,
            CASE WHEN d.seed IS NOT NULL THEN 0 ELSE t.step END AS spread_step FROM pts q LEFT JOIN seeds d ON d.a = q.row_index
            LEFT JOIN own o ON o.a = q.row_index LEFT JOIN taken t ON t.s = o.s"""),
    "blend_seeds": query(
        ("e", "SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings"),
        body="""SELECT e.vec_id AS row_index, array_to_string(list_transform(CASE WHEN s.v IS NULL THEN e.v ELSE
            list_transform(list_zip(e.v, s.v), lambda p: (p[1] * 3.0 + p[2] * 1.0) / 4.0) END,
            lambda x: CAST(CAST(floor(x * 1e6 + 0.5) AS BIGINT) AS VARCHAR)), ' ') AS vector_millionths
            FROM e LEFT JOIN e s ON s.vec_id < 3 AND s.vec_id = e.vec_id % 4"""),
    "topics_to_target": query(_LETTERS, *[part for i in range(1, TARGET_ROUNDS + 1) for part in _target_round(i, f"emb_{i - 1}" if i > 1 else "emb")],
        body=f"SELECT row_index, message_role, topic_id FROM emb_{TARGET_ROUNDS}"),
    "diffused_vectors": query(_LINKED, _PLACED,
        ("w", f"SELECT a.row_index AS a, b.row_index AS b, exp(-2.0 * {_APART} / {NEAR * NEAR!r}) AS w FROM pts a JOIN pts b "
              f"ON a.message_role = b.message_role AND {_APART} <= {NEAR * NEAR!r}"),
        *[(f"at_{k}", f"""SELECT w.a AS row_index, sum(w * p.x) / sum(w) AS x, sum(w * p.y) / sum(w) AS y, sum(w * p.z) / sum(w) AS z
            FROM w JOIN {f'at_{k - 1}' if k > 1 else 'pts'} p ON p.row_index = w.b GROUP BY w.a""") for k in (1, 2, 3)],
        body="""SELECT row_index, message_role, round(t.x, 6) AS x, round(t.y, 6) AS y, round(t.z, 6) AS z FROM at_3 t
            JOIN (SELECT row_index, message_role FROM pts) USING (row_index)"""),
    "lexicon_lemmas": query(
        ("lexicon", r"SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\S+')) AS word FROM benchmark"),
        ("toks", r"SELECT doc_id, unnest(t) AS form, generate_subscripts(t, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '\S+') AS t FROM documents)"),
        ("forms", "SELECT DISTINCT form FROM toks"),
        ("tried", " UNION ".join(["SELECT form, form AS lemma FROM forms", *[
            f"SELECT form, left(form, length(form) - {len(e)}) || '{r}' FROM forms WHERE form LIKE '%{e}' AND length(form) > {len(e) - len(r)}"
            for e, r in fv.DETACHMENTS]])),
        ("known", """SELECT form, lemma FROM tried JOIN (SELECT word FROM lexicon WHERE NOT word LIKE '%es') ON word = lemma
            QUALIFY row_number() OVER (PARTITION BY form ORDER BY length(lemma), lemma) = 1"""),
        ("first", "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in LEMMA_EXCEPTIONS) + ") v(form, lemma)"),
        ("joined", """SELECT doc_id, string_agg(coalesce(f.lemma, k.lemma, t.form), ' ' ORDER BY pos) AS lemmas FROM toks t
            LEFT JOIN known k USING (form) LEFT JOIN first f USING (form) GROUP BY doc_id"""),
        body="SELECT doc_id, coalesce(lemmas, '') AS lemmas FROM documents LEFT JOIN joined USING (doc_id)"),
    "representative_by_terms": query(*TABLE,
        ("counted", "SELECT row_index, message_role, topic_id, term, count(*) AS c FROM grams WHERE topic_id <> -1 GROUP BY ALL"),
        ("length_", "SELECT row_index, sqrt(sum(c * c)) AS l FROM counted GROUP BY 1"),
        ("topic_length", "SELECT message_role, topic_id, sqrt(sum(weight * weight)) AS l FROM topic_terms GROUP BY 1, 2"),
        ("said", """SELECT c.row_index, sum(c.c * t.weight) AS s FROM counted c JOIN topic_terms t
            ON t.message_role = c.message_role AND t.topic_id = c.topic_id AND t.term = c.term GROUP BY 1"""),
        ("scored", """SELECT d.row_index, d.message_role, d.topic_id, coalesce(s.s / (n.l * t.l), 0.0) AS similarity FROM topics d
            JOIN topic_length t USING (message_role, topic_id) LEFT JOIN length_ n USING (row_index) LEFT JOIN said s USING (row_index)"""),
        body="""SELECT message_role, topic_id, rank, row_index, round(similarity, 6) AS similarity FROM (SELECT *, CAST(row_number() OVER (
            PARTITION BY message_role, topic_id ORDER BY round(similarity, 9) DESC, row_index) AS INTEGER) AS rank FROM scored) WHERE rank <= 3"""),
    "topic_chain": _recursive(_LINKED, *_density("linked", CHAIN_WIDTH * WIDTHS_PER_CELL),
        ("chained", "SELECT f.row_index, f.message_role, f.topic_id, l.text FROM found f JOIN linked l USING (row_index)"),
        *sql.term_steps("chained"), sql.KEYWORDS,
        ("sized_topics", "SELECT message_role, topic_id, count(*) AS n FROM chained WHERE topic_id <> -1 GROUP BY 1, 2"),
        ("roles", """SELECT message_role, count(*) FILTER (WHERE topic_id = -1) AS outliers,
            count(DISTINCT CASE WHEN topic_id <> -1 THEN topic_id END) AS num_topics FROM chained GROUP BY 1"""),
        body="""SELECT s.message_role, s.topic_id, s.n AS message_count, coalesce(k.name, CAST(s.topic_id AS VARCHAR)) AS name,
            r.num_topics, r.outliers FROM sized_topics s JOIN roles r USING (message_role) LEFT JOIN topic_kw k USING (message_role, topic_id)"""),
    "model_vectors": query(_LETTER_COUNTS, body="""SELECT row_index, array_to_string(list_transform(n, lambda x:
        CAST(CAST(round(CASE WHEN list_sum(n) = 0 THEN 0 ELSE x / sqrt(CAST(list_sum(list_transform(n, lambda y: y * y)) AS DOUBLE)) END * 1e6) AS BIGINT)
        AS VARCHAR)), ' ') AS vector_millionths FROM letter_counts"""),
    "label_backfill": query(*_LABELLED, ("lk", """SELECT i.message_role, i.topic_id, l.intent_label, i.keywords, i.message_count
        FROM info i JOIN labels_ l USING (message_role, topic_id) WHERE len(i.terms) > 0"""),
        body="""SELECT message_role, topic_id, keywords, message_count,
            CASE WHEN message_count > 10 THEN intent_label ELSE 'Topic ' || topic_id END AS intent_label FROM lk"""),
    "top_topics": query(*_KW, body="""SELECT message_role, rank, topic_id, intent_label, message_count FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY message_role ORDER BY message_count DESC, topic_id) AS INTEGER) AS rank FROM kw) WHERE rank <= 15"""),
    "topic_summary_text": query(*_KW, body="""SELECT message_role, string_agg('Topic ' || topic_id || ': ' || keywords || ' (' || message_count || ' msgs)',
        chr(10) ORDER BY rank) AS summary FROM (SELECT *, row_number() OVER (PARTITION BY message_role ORDER BY message_count DESC, topic_id) AS rank FROM kw)
        WHERE rank <= 5 GROUP BY 1"""),
    "keyword_variants": query(*_KW, *_VARIANTS,
        body="""SELECT message_role, topic_id, CAST(row_number() OVER (PARTITION BY message_role, topic_id ORDER BY length(variant) DESC, variant) - 1
            AS INTEGER) AS position, variant FROM variants"""),
    "highlight_examples": query(*_KW, *_VARIANTS,
        ("spelling", "SELECT message_role, topic_id, list(variant ORDER BY length(variant) DESC, variant) AS spelt FROM variants GROUP BY 1, 2"),
        _examples(3),
        body=f"""SELECT e.message_role, e.topic_id, e.rank, CASE WHEN {sql.strip('example')} = '' THEN '' ELSE
            replace(replace({_MARKED}, {_OPEN}, ''), {_CLOSE}, '') END AS example
            FROM examples e JOIN spelling s USING (message_role, topic_id)"""),
    "summary_sentences": query(*_SENT,
        ("counted", "SELECT role, sentiment_label, count(*) AS n FROM sentiment GROUP BY 1, 2"),
        ("topped", """SELECT role, sentiment_label, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY role) AS share,
            row_number() OVER (PARTITION BY role ORDER BY n DESC, sentiment_label) AS rank FROM counted"""),
        body="""SELECT 'overview' AS topic, 'Total messages analysed: ' || format('{:,}', count(*)) || chr(10) || 'Unique WhatsApp IDs: '
            || format('{:,}', count(DISTINCT whatsapp_id)) || chr(10) || 'Data range: ' || strftime(min(datetime), '%Y-%m-%dT%H:%M:%S') || ' to '
            || strftime(max(datetime), '%Y-%m-%dT%H:%M:%S') || chr(10) || 'Coverage: '
            || CAST(floor(epoch(max(datetime) - min(datetime)) / 86400) + 1 AS INTEGER) || ' days' AS sentence FROM messages
        UNION ALL
        SELECT role, upper(role[1]) || role[2:] || ' messages most often express: '
            || string_agg(sentiment_label || ' (' || format('{:.1f}', share * 100) || '%)', ', ' ORDER BY rank) FROM topped WHERE rank <= 3 GROUP BY role"""),
    "report_insights": query(*_SENT, *sql.agency_steps("long"), EVENTS, *_KW,
        ("hours", "SELECT hour(datetime) AS h, count(*) AS n FROM event_messages GROUP BY 1"),
        ("states", "SELECT coalesce(cal_state, 'Unknown') AS s, count(*) AS n FROM event_messages GROUP BY 1"),
        ("moods", "SELECT role, sentiment_label, count(*) AS n FROM sentiment GROUP BY 1, 2"),
        body="""SELECT 'peak_hour' AS name, CAST((SELECT h FROM hours ORDER BY n DESC, h LIMIT 1) AS VARCHAR) AS value
        UNION ALL SELECT 'total_messages', CAST((SELECT sum(n) FROM hours) AS VARCHAR)
        UNION ALL SELECT 'top_state', (SELECT s FROM states ORDER BY n DESC, s LIMIT 1)
        UNION ALL SELECT 'top_state_messages', CAST((SELECT max(n) FROM states) AS VARCHAR)
        UNION ALL SELECT 'dominant_sentiment_' || role, lower(sentiment_label) FROM (SELECT *, row_number() OVER (PARTITION BY role
            ORDER BY n DESC, sentiment_label) AS r FROM moods) WHERE r = 1
        UNION ALL SELECT 'top_topic_' || message_role, keywords FROM (SELECT *, row_number() OVER (PARTITION BY message_role
            ORDER BY message_count DESC, topic_id) AS r FROM kw) WHERE r = 1
        UNION ALL SELECT 'mean_agency_' || message_role, format('{:.2f}', avg(agency_score)) FROM agency WHERE agency_score IS NOT NULL GROUP BY message_role
        UNION ALL SELECT 'pct_high_agency_' || message_role, format('{:.1f}', avg(CAST(is_high AS INTEGER)) * 100) FROM agency
            WHERE agency_score IS NOT NULL GROUP BY message_role"""),
}
