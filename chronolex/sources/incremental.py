"""An index that follows its corpus: documents that are new, changed or gone since the last update, and nothing else.

Below a folder, each update writes one generation: `manifest` (document_id, hash, status, error) of all documents it
saw, `chunks` and their term counts of documents that came or changed, and `tombstones` of those that changed or went.
What is current is a row of a generation that no later tombstone names. A document that cannot be read is a row of
the manifest with its error: it keeps its former chunks, and the next update tries it again. Equal contents are not
touched. An update that fails before its manifest is there left nothing that counts. compacted() gives one generation
again. A manifest row comes last, so readers see whole generations only.

documents: rows (document_id, hash, text, error), unique ids; hash changes when the content does. A null text
without an error is a document without chunks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.operators.index import Lexical, lexical_of, term_counts
from chronolex.staging import staged

ADDED, CHANGED, REMOVED, SAME, FAILED = "added", "changed", "removed", "same", "failed"


def whole_texts(documents: DataFrame) -> DataFrame:
    """A document as one chunk."""
    return documents.filter("text IS NOT NULL").select("document_id", F.concat_ws("_", "document_id", F.lit(0)).alias("chunk_id"), "text")


def documents_of(pages: DataFrame, files: DataFrame) -> DataFrame:
    """documents by file path from corpus.text_pages and corpus.corpus_files: pages joined by form feeds, the first error of any page."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("page_num", "raw_text"))), lambda x: x["raw_text"])
    read = pages.groupBy("file_path").agg(F.array_join(texts, "\f").alias("text"), F.min("error").alias("error"))
    rows = files.select("file_path", F.col("file_hash").alias("hash")).join(read, "file_path", "left")
    return rows.select(F.col("file_path").alias("document_id"), "hash", F.when(F.col("error").isNull(), F.col("text")).alias("text"), "error")


def _table(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{path}/{name}")
    except AnalysisException:
        return None


def _generation(spark: SparkSession, path: str) -> int:
    """The last whole generation, -1 without any."""
    manifest = _table(spark, path, "manifest")
    return -1 if manifest is None else manifest.agg(F.max("generation")).first()[0]


def last_manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """(document_id, hash, status, error) of the last update; hash is that of the content whose chunks are current."""
    at = _generation(spark, path)
    return None if at < 0 else spark.read.parquet(f"{path}/manifest").filter(F.col("generation") == at).drop("generation")


def compared(documents: DataFrame, before: DataFrame | None) -> DataFrame:
    """(document_id, hash, error, status): documents against the manifest before, by an equi-join on ids.

    hash is null where no content of the document is current."""
    if before is None:
        before = documents.select("document_id", F.lit(None).cast("string").alias("hash")).limit(0)
    old = before.filter(f"status <> '{REMOVED}'").select("document_id", F.col("hash").alias("_old")) if "status" in before.columns else before.select("document_id", F.col("hash").alias("_old"))
    both = documents.select("document_id", F.col("hash").alias("_new"), "error", F.lit(True).alias("_here")).join(old, "document_id", "full_outer")
    status = F.when(F.col("_here").isNull(), REMOVED).when(F.col("error").isNotNull(), FAILED).when(F.col("_old").isNull(), ADDED).when(F.col("_old") != F.col("_new"), CHANGED).otherwise(SAME)
    rows = both.withColumn("status", status).filter(~(F.col("_here").isNull() & F.col("_old").isNull()))  # failed once and gone
    current = F.when(F.col("status") == FAILED, F.col("_old")).when(F.col("status") == REMOVED, F.lit(None)).otherwise(F.col("_new"))
    return rows.select("document_id", current.alias("hash"), "status", "error")


def update(documents: DataFrame, path: str, chunked: Callable[[DataFrame], DataFrame] = whole_texts) -> dict[str, int]:
    """Bring the index below path up to documents; status -> how many documents. chunked(documents) gives (document_id, chunk_id, text)."""
    spark = documents.sparkSession
    at = _generation(spark, path) + 1
    seen = staged(compared(documents, last_manifest(spark, path)), "compared")
    fresh = documents.drop("error").join(seen.filter(F.col("status").isin(ADDED, CHANGED)).select("document_id"), "document_id", "left_semi")
    chunks = staged(chunked(fresh), "chunks")
    put = lambda df, name: df.write.mode("overwrite").parquet(f"{path}/{name}/generation={at}")
    put(chunks, "chunks")
    put(term_counts(chunks).join(chunks.select("document_id", "chunk_id"), "chunk_id"), "counts")
    put(seen.filter(F.col("status").isin(CHANGED, REMOVED)).select("document_id"), "tombstones")
    put(seen, "manifest")
    return {r["status"]: r["n"] for r in seen.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}


def _current(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Rows of a table that no later generation has buried: a row's generation against the last tombstone of its document."""
    at = _generation(spark, path)
    if at < 0:
        raise ValueError(f"no index at {path}")
    rows = spark.read.parquet(f"{path}/{name}").filter(F.col("generation") <= at)
    buried = spark.read.parquet(f"{path}/tombstones").filter(F.col("generation") <= at).groupBy("document_id").agg(F.max("generation").alias("_buried"))
    kept = rows.join(buried, "document_id", "left").filter("_buried IS NULL OR generation >= _buried")
    return kept.drop("_buried", "generation")


def current_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, chunk_id, text)."""
    return _current(spark, path, "chunks").select("document_id", "chunk_id", "text")


def current_lexical(spark: SparkSession, path: str) -> Lexical:
    """What the lexical rankings read, from the written term counts: no text is cut into words again."""
    return lexical_of(_current(spark, path, "counts").drop("document_id").select("chunk_id", "doc_len", "terms"))


def failures(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, error) of documents that the last update could not read."""
    manifest = last_manifest(spark, path)
    if manifest is None:
        raise ValueError(f"no index at {path}")
    return manifest.filter(F.col("status") == FAILED).select("document_id", "error")


def compacted(spark: SparkSession, path: str, to: str) -> None:
    """The index below path as one generation below another folder."""
    manifest = last_manifest(spark, path).filter(f"status <> '{REMOVED}'")
    for name in ("chunks", "counts"):
        _current(spark, path, name).write.mode("overwrite").parquet(f"{to}/{name}/generation=0")
    spark.read.parquet(f"{path}/tombstones").drop("generation").limit(0).write.mode("overwrite").parquet(f"{to}/tombstones/generation=0")
    manifest.write.mode("overwrite").parquet(f"{to}/manifest/generation=0")
