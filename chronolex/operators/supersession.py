"""Supersession by name: names that texts give ("supersedes ORDER 12") resolved to the documents that bear them.

A title or a name is brought to one key: upper case, kinds of documents in the singular, without articles and "No.".
Names meet titles by an equi-join on keys, then the spans of the documents within each query, so neither names nor
spans are paired with all others; a title that many documents bear is a key that the join can split. A name resolves
to every other document that bears it; one that none bears has no effect. Null or empty names and titles have no key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("act", "statute", "order", "circular", "notification", "rule", "regulation", "guideline", "directive", "memorandum", "advisory", "constitution", "decision")
_TITLE = rf"(?i)\b({'|'.join(KINDS)})s?\s+(?:(?:no\b\.?|number\b)\s*)?([0-9]+[A-Za-z0-9/-]*)"


def _plain(name: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.upper(name), r"[^\p{L}\p{N}]+", " "))
    plain = F.regexp_replace(plain, r"\b(?:THE|THIS|NO|NUMBER)\b", " ")
    plain = F.regexp_replace(plain, rf"\b({'|'.join(k.upper() for k in KINDS)})S\b", "$1")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def _bare(name: Column) -> Column:
    """name_key, empty in place of null: an expression that reads each part once."""
    return F.regexp_extract(_plain(name), r"^.*[0-9 ].*$", 0)


def name_key(name: Column) -> Column:
    """The key of a title or name; null where nothing with a digit or a second word is left."""
    return F.nullif(_bare(name), F.lit(""))


def title_key(text: Column) -> Column:
    """The key of the first numbered kind of document that a text names."""
    return F.nullif(_plain(F.regexp_extract(text, _TITLE, 0)), F.lit(""))


def document_titles(chunks: DataFrame) -> DataFrame:
    """(document_id, key) of chunks (chunk_id, text): by the first chunk of a document that names one; chunk_id is the document's id, an underscore and a number."""
    key = title_key(F.col("text"))
    place = F.try_element_at(F.split("chunk_id", "_"), F.lit(2)).try_cast("long")
    named = chunks.select(F.split("chunk_id", "_")[0].alias("document_id"), place.alias("place"), key.alias("key"))
    first = F.min_by("key", F.when(F.col("key").isNotNull(), F.struct("place", "key"))).alias("key")  # a filter before it would find each key twice
    return named.groupBy("document_id").agg(first).filter("key IS NOT NULL")


def named_edges(spans: DataFrame, titles: DataFrame) -> DataFrame:
    """(query_id, superseding, superseded) span ids: spans (query_id, span_id, document_id, supersedes, superseded_by) whose names
    are titles (document_id, key) of other documents with spans in the query."""
    own = spans.select("query_id", "span_id", "document_id")
    keys = lambda names, newer: F.transform(names, lambda n: F.struct(_bare(n).alias("key"), F.lit(newer).alias("newer")))
    given = F.concat(keys(F.coalesce("supersedes", F.array().cast("array<string>")), True), keys(F.array("superseded_by"), False))
    naming = spans.filter(F.col("superseded_by").isNotNull() | (F.size("supersedes") > 0))
    names = naming.select("query_id", "span_id", "document_id", F.explode(given).alias("n")).select("query_id", "span_id", "document_id", "n.key", "n.newer").filter("key <> ''").distinct()
    borne = names.join(titles.select(F.col("document_id").alias("other"), "key"), "key").filter("other <> document_id").select("query_id", "span_id", "newer", "other").distinct()
    met = borne.join(own.withColumnsRenamed({"span_id": "other_span", "document_id": "other"}), ["query_id", "other"])
    pick = lambda when: F.when(F.col("newer") == when, F.col("span_id")).otherwise(F.col("other_span"))
    return met.select("query_id", pick(True).alias("superseding"), pick(False).alias("superseded")).distinct()
