"""Inputs of the queries, written once in SQL that Spark and DuckDB both run (dates are formatted by each in its own way)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("customer", "supplier", "part", "nation", "region", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, text: str, **frames: DataFrame) -> DataFrame:
    """Run text with {name} placeholders for tables of sf_dir and for frames."""
    named = {n: table(spark, sf_dir, n) for n in TABLES if "{" + n + "}" in text} | frames
    return spark.sql(text, **named)


# Legal notices made of orders: every date shape, status and supersession phrase occurs
_LEGAL = """
SELECT o_orderkey AS doc_id, CASE o_orderkey % 8
  WHEN 0 THEN 'The Act No. ' || o_orderkey || ' shall come into force on DMY. This rule is in force.'
  WHEN 1 THEN 'Circular ' || o_orderkey || ' is effective on the DMY and must be read with 5% interest! Every holder shall keep it.'
  WHEN 2 THEN 'w.e.f. DMY the order ' || o_orderkey || ' was repealed and replaced by ORDER ' || (o_orderkey + 1) || ' dated today.'
  WHEN 3 THEN 'with effect from DASH the guidelines ' || o_orderkey || ' are amended and valid until DMY. They may be used.'
  WHEN 4 THEN 'Gazette dated DMY: this notification supersedes ORDER ' || (o_orderkey - 1) || ', ORDER ' || (o_orderkey - 2) || ' dated 1990.'
  WHEN 5 THEN 'The constitution comes into force on WORDS. Section ' || o_orderkey || ' will not be prohibited under this article.'
  WHEN 6 THEN 'The memorandum is suspended and shall remain in force until DMY. Is it read? No! It was postponed, as per rule ' || o_orderkey || '.'
  ELSE 'This advisory ' || o_orderkey || ' has no date; it was modified - the word-\n s are split.' END AS text
FROM TABLE"""


def _legal(source: str, dmy: str, dash: str, words: str) -> str:
    out = _LEGAL.replace("TABLE", source)
    for name, call in (("DMY", dmy), ("DASH", dash), ("WORDS", words)):
        out = out.replace(name, f"' || {call} || '")
    return out


LEGAL_SPARK = _legal("{orders}", "date_format(o_orderdate, 'dd/MM/yyyy')", "date_format(o_orderdate, 'dd-MM-yyyy')", "date_format(o_orderdate, 'd MMMM yyyy')")
LEGAL = _legal("orders", "strftime(o_orderdate, '%d/%m/%Y')", "strftime(o_orderdate, '%d-%m-%Y')", "strftime(o_orderdate, '%-d %B %Y')").replace("\\n", "' || chr(10) || '")
LEGAL = LEGAL.replace("word-\n s", "word-' || chr(10) || ' s")

# Temporal spans made of orders: one query for thirty customers, so queries grow with them; a span supersedes the customer's order before it
_SPANS = """
SELECT QUERY AS query_id, o_orderkey AS span_id, o_custkey AS document_id,
  row_number() OVER (PARTITION BY QUERY ORDER BY o_orderkey) AS pos,
  'order ' || (o_orderkey % 97) || ' of customer ' || (o_custkey % 13) || ' with priority ' || o_orderpriority AS text,
  o_orderdate AS effective_date,
  CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate + INTERVAL '900' DAY END AS expiry_date,
  CASE WHEN o_orderkey % 11 = 0 THEN o_orderdate + INTERVAL '300' DAY END AS repeal_date,
  CASE o_orderkey % 6 WHEN 2 THEN 'amended' WHEN 3 THEN 'repealed' WHEN 4 THEN 'suspended' ELSE 'active' END AS status,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 10.0E0 WHEN '2' THEN 8.0E0 WHEN '3' THEN 6.0E0 WHEN '4' THEN 4.0E0 ELSE 2.0E0 END AS precedence_weight,
  CASE WHEN o_orderkey % 3 = 0 THEN lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) END AS older,
  CASE WHEN o_orderkey % 7 = 0 THEN lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) END AS superseded_by
FROM TABLE"""
THIRTY, FIFTIETH = "CAST(floor(o_custkey / 30) AS BIGINT)", "o_custkey % 50"
SPANS = _SPANS.replace("TABLE", "orders").replace("QUERY", THIRTY)
# The same in fifty queries of all customers: conflicts among many spans of a query, as many as the table has
WIDE_SPANS = _SPANS.replace("TABLE", "orders").replace("QUERY", FIFTIETH)


def temporal(spark: SparkSession, sf_dir: str, query: str = THIRTY) -> DataFrame:
    from pyspark.sql import functions as F

    rows = sql(spark, sf_dir, _SPANS.replace("TABLE", "{orders}").replace("QUERY", query))
    empty = F.expr("CAST(array() AS array<bigint>)")
    return rows.withColumn("supersedes", F.when(F.col("older").isNotNull(), F.array("older")).otherwise(empty)).drop("older")


# Byte spans made of line items: intervals that touch, overlap and repeat within an order
_INTERVALS = """
SELECT ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 1000 + l_suppkey % 1000 AS span_id, l_orderkey AS document_id,
  (l_linenumber * 20 + l_partkey % 37) AS start, (l_linenumber * 20 + l_partkey % 37 + CAST(l_quantity AS BIGINT)) AS "end",
  'part ' || l_partkey AS text, CAST(l_linenumber AS BIGINT) AS page_num, 's' || l_linenumber AS section_id, l_discount * 10 AS confidence
FROM TABLE"""
INTERVALS = _INTERVALS.replace("TABLE", "lineitem")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, _INTERVALS.replace("TABLE", "{lineitem}").replace('"end"', "`end`"))


def legal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, LEGAL_SPARK)


AS_OF = "1996-06-30"
EARLIER = "1995-01-01"
