"""The registered queries of this package and, where SQL can express them, their restatements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlens.llm import (
    bpe, hard_negatives, license_scan, mixing, near_dedup, periodic_runs, permutation_index, quality_knn, quality_rules,
    secret_scan, substring_dedup, token_counts, url_filter,
)
from chatlens.llm.texts import table, words

# The rules that the url query is asked to apply.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of an installed public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality_rules.judge(docs, table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.round("mean_ratio", 9).alias("mean_ratio"), "kept")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("log_odds", 9).alias("log_odds"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.fields_and_lines(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.repeated_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), label, F.col("vec_id") % 100 == 0)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with the tail of every tenth text made periodic, as the query on runs asks.

    With h = crc32 of the decimal id and g = h / 10, a text with h % 10 = 0 and n > 0 words repeats
    the p words from word a = g % n on, where p = 1 + (n - a) / (3 + g % 8). Rows without an id stay.
    """
    hashed = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    n, a = F.size("w").cast("long"), F.col("a")
    cut = hashed.withColumn("g", F.expr("h div 10")).withColumn("w", F.when(F.col("h") % 10 == 0, words(F.col("text"))))
    cut = cut.withColumn("a", F.when(F.size("w") > 0, F.col("g") % n))
    cut = cut.withColumn("p", 1 + F.floor((n - a) / (3 + F.col("g") % 8)))
    periodic = F.transform("w", lambda x, i: F.when(i < a, x).otherwise(F.get("w", (a + (i - a) % F.col("p")).cast("int"))))
    return cut.select("doc_id", F.when(a.isNotNull(), F.array_join(periodic, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(with_planted_periods(table(spark, sf_dir, "documents")))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digests(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_quality_votes, op2_quality_rules, op3_near_duplicates, op4_url_filter, op5_token_counts, op6_nearest_vectors,
    op7_source_mix, op8_repeated_passages, op9_bpe_codec, op10_secret_scan,
    op11_hard_negatives, op12_periodic_runs, op13_license_scan,
)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE: dict[str, str] = {
    "op3_near_duplicates": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_transform({_WORDS},
    lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS x FROM s),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
linked AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 75 * (x.n + y.n - n_both)),
edges AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id, n.doc_id = min(r.b) AS kept
FROM n JOIN reach r ON r.a = n.doc_id GROUP BY n.doc_id, n.n""",
    "op8_repeated_passages": rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 18)) AS pos, unnest(list_transform(range(1, len(w) - 18),
    lambda i: array_to_string(w[i:i + 19], ' '))) AS x FROM w WHERE len(w) >= 20),
later AS (SELECT doc_id, pos FROM windows QUALIFY row_number() OVER (PARTITION BY x ORDER BY doc_id, pos) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS pos FROM later),
each AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS pos FROM w),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY pos) AS text
  FROM each ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)""",
    "op11_hard_negatives": """
WITH r AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same,
    CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM r a JOIN r b ON a.id <> b.id WHERE a.id % 100 = 0),
positives AS (
  SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
  n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY rank <= 10""",
}
