"""The numbered problems on language-model data and algorithms, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ivlattice.llm import bpe, leaks, nearesttime, sharedspans
from ivlattice.session import clean_name, micros, table


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    trades = table(spark, d, "trades_options").select(F.col("ingest_seq").alias("left_id"), clean_name("instrument").alias("entity"), micros("ts").alias("at"))
    quotes = table(spark, d, "tardis_sample").select(F.col("quote_id").alias("right_id"), clean_name("symbol").alias("entity"), F.col("timestamp").alias("at"))
    out = nearesttime.nearest_in_time(trades, quotes, tolerance_us=30_000_000, bucket_us=3_600_000_000)
    return out.select(F.col("left_id").alias("ingest_seq"), F.col("right_id").alias("quote_id"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_texts(table(spark, d, "documents"))


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The texts again, from their ids."""
    return bpe.decode_ids(p8_ids(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return leaks.overlaps(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_exact_words(spark: SparkSession, d: str) -> DataFrame:
    """The longest exact run of each leaked pair, all places of both texts considered."""
    return p9_overlaps(spark, d).filter(F.col("exact_words") >= leaks.SPAN).select("doc_id", "item_id", F.col("exact_words").cast("long").alias("exact_words"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sharedspans.shared_spans(table(spark, d, "documents"))


def p10_passages(spark: SparkSession, d: str) -> DataFrame:
    return sharedspans.passages(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p6_found, p8_ids, p8_decoded, p9_found, p9_overlaps, p9_exact_words, p10_found, p10_passages)}

_GRAMS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
e AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
dg AS (SELECT doc_id, i, array_to_string(w[i:i+11], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 11)) AS i FROM d)),
eg AS (SELECT item_id, i AS j, array_to_string(w[i:i+11], ' ') AS g FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 11)) AS i FROM e))
"""

SQL = {
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p9_exact_words": _GRAMS
    + """, h AS (SELECT doc_id, item_id, i - j AS diagonal, i FROM dg JOIN eg USING (g)),
r AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY i) AS k FROM h),
n AS (SELECT doc_id, item_id, count(*) + 11 AS words FROM r GROUP BY doc_id, item_id, diagonal, k)
SELECT doc_id, item_id, max(words) AS exact_words FROM n GROUP BY ALL""",
    "p6_found": """
WITH t AS (SELECT ingest_seq, upper(trim(instrument)) AS i, epoch_us(ts) AS at FROM trades_options),
q AS (SELECT quote_id, upper(trim(symbol)) AS i, timestamp AS at FROM tardis_sample)
SELECT t.ingest_seq, arg_min(q.quote_id, (abs(t.at - q.at), q.at, q.quote_id)) AS quote_id
FROM t JOIN q ON t.i = q.i AND q.at BETWEEN t.at - 30000000 AND t.at + 30000000 GROUP BY t.ingest_seq""",
    "p9_found": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
e AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
dg AS (SELECT doc_id, array_to_string(w[i:i+11], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 11)) AS i FROM d)),
eg AS (SELECT item_id, array_to_string(w[i:i+11], ' ') AS g FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 11)) AS i FROM e))
SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g)""",
    "p10_found": """
WITH w AS (SELECT doc_id, s, text[s:s+299] AS g FROM (SELECT doc_id, text, unnest(generate_series(1, length(text) - 299)) AS s FROM documents WHERE length(text) >= 300)),
h AS (SELECT doc_id, s, hash(g) AS g FROM w),
c AS (SELECT g FROM h GROUP BY g HAVING min(doc_id) <> max(doc_id)),
m AS (SELECT doc_id, s - 1 AS s FROM h JOIN c USING (g)),
n AS (SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 300 THEN 0 ELSE 1 END AS new FROM m),
r AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM n)
SELECT doc_id, min(s) AS span_start, max(s) + 300 AS span_end FROM r GROUP BY doc_id, k""",
}
