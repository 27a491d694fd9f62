"""The columns of five operators that SQL can express, each with that SQL.

``base_<name>`` runs opN_<name> over its whole table and returns those columns; what the method
itself decides (what a mix takes, the model's score, the verdict, fingerprints, further labels) is
tested against brute force instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries

_LOW = "translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"'[^\x20\x09-\x0D]+'"


def base_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries.op1_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def base_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries.op2_lm_scoring(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def base_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries.op6_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def base_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries.op7_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def base_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries.op8_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (base_mixing, base_lm_scoring, base_quality_rules, base_fingerprints, base_license_scan)
}

ORACLE_SQL: dict[str, str] = {
    # Sources by the share at which they are full; the level is the first that the next one isn't full at.
    "base_mixing": f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(COALESCE(text, ''), {_WORDS})) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM d GROUP BY source),
o AS (SELECT *, 3e0 * source_size / w AS full_at, row_number() OVER up AS k,
  (sum(source_size) OVER () - 3 * COALESCE(sum(source_size) OVER (up ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / CAST(sum(w) OVER (up ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM s WINDOW up AS (ORDER BY 3e0 * source_size / w, source NULLS LAST)),
l AS (SELECT min_by(level, k) AS level FROM o WHERE level <= full_at)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, o.source_size, round(least(l.level * w, 3e0 * source_size), 3) AS target FROM d JOIN o ON d.source IS NOT DISTINCT FROM o.source, l""",
    "base_lm_scoring": f"""WITH t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS table_),
d AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(CAST(doc_id AS VARCHAR))), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(i + 1 AS INTEGER), 1)) AS BIGINT))),
  lambda c, b: xor(c >> 8, table_[CAST(xor(c & 255, b) AS INTEGER) + 1])), 4294967295) % 7 = 2 AS held_out, list_append(regexp_extract_all({_LOW}, {_WORDS}), '') AS ws FROM documents, t),
w AS (SELECT doc_id, held_out, unnest(ws) AS word FROM d),
c AS (SELECT word, count(*) AS c FROM w WHERE NOT held_out GROUP BY word),
n AS (SELECT CAST(COALESCE(sum(c), 0) AS BIGINT) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, n AS train_tokens, round(sum(log10((COALESCE(c, 0) + 1) / CAST(n + v + 1 AS DOUBLE))), 4) AS base_score
FROM w LEFT JOIN c USING (word), n GROUP BY doc_id, held_out, n, v""",
    "base_quality_rules": rf"""WITH d AS (SELECT doc_id, COALESCE(text, '') AS t, regexp_extract_all(COALESCE(text, ''), {_WORDS}) AS ws FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS first, unnest(list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i + 7], ' '))) AS g FROM d WHERE len(ws) >= 8),
again AS (SELECT doc_id, first FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
r AS (SELECT doc_id, count(DISTINCT first + k) AS n FROM again, range(8) AS x(k) GROUP BY doc_id),
b AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, {_WORDS})) AS lines, COALESCE(r.n, 0) AS n_repeat_words FROM d LEFT JOIN r ON r.doc_id = d.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b""",
    "base_fingerprints": """WITH d AS (SELECT doc_id, COALESCE(text, '') AS t, COALESCE(lead(COALESCE(text, '')) OVER (ORDER BY doc_id), first_value(COALESCE(text, '')) OVER (ORDER BY doc_id)) AS following FROM documents)
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(substr(t, 1, length(t) - length(t) // 4) || substr(following, 1, length(t) // 4)) AS edited_sha256 FROM d""",
    "base_license_scan": rf"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, list_filter(range(1, len(ws) + 1), lambda i: ws[i] = 'cc' AND ws[i + 1] = 'by') AS cc,
  list_filter(range(1, len(ws) + 1), lambda i: ws[i] = 'general' AND ws[i + 1] = 'public' AND ws[i + 2] = 'license') AS gpl,
  list_filter(range(1, len(ws) + 1), lambda i: ws[i] = 'all' AND ws[i + 1] = 'rights' AND ws[i + 2] = 'reserved') AS res FROM d),
a AS (SELECT *, list_concat(cc, gpl, res) AS places FROM p)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, list_min(places) - 1 AS first_word, list_max(places) - 1 AS last_word,
  array_to_string(list_filter([CASE WHEN len(cc) > 0 THEN 'cc-by' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(res) > 0 THEN 'reserved' END], lambda x: x IS NOT NULL), ',') AS base_labels FROM a""",
}
