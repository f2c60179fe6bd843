"""Files in and reports out: corpus listing, manifests, QA and label files, index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = ("pdf", "png", "jpg", "jpeg", "tiff", "txt")


def corpus_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(file_path, suffix, file_size, file_hash, content) of all files below root with one of the suffixes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    rows = files.withColumn("suffix", suffix).filter(F.col("suffix").isin(*suffixes))
    return rows.select(F.col("path").alias("file_path"), "suffix", F.col("length").alias("file_size"), F.sha2("content", 256).alias("file_hash"), "content")


def text_pages(files: DataFrame) -> DataFrame:
    """Pages (document_id, page_num, raw_text, trust_score) of text files, cut at form feeds; others need an OCR engine and give an error column."""
    text = F.when(F.col("suffix") == "txt", F.make_valid_utf8(F.col("content").cast("string")))
    rows = files.select(F.col("file_hash").alias("document_id"), "file_path", F.when(text.isNull(), F.concat(F.lit("no reader for ."), "suffix")).alias("error"), F.posexplode_outer(F.split(text, "\f")).alias("page", "raw_text"))
    return rows.select("document_id", "file_path", (F.coalesce("page", F.lit(0)) + 1).alias("page_num"), "raw_text", F.lit(1.0).alias("trust_score"), "error")


def manifest(files: DataFrame, sections: DataFrame) -> DataFrame:
    """One line a file: path, hash, size, pages, mean trust, sections."""
    per = sections.groupBy(F.col("document_id").alias("file_hash")).agg(F.countDistinct("page_num").alias("num_pages"), F.avg("confidence").alias("avg_trust_score"), F.count(F.lit(1)).alias("total_sections"))
    return files.drop("content").join(per, "file_hash", "left").fillna(0, ["num_pages", "total_sections"]).withColumn("processing_timestamp", F.current_timestamp())


def processed_documents(spark: SparkSession, manifest_path: str, documents_path: str) -> DataFrame:
    """Documents named by the manifest; unprocessed_lines() has the lines without a document."""
    lines = spark.read.json(manifest_path)
    return spark.read.parquet(documents_path).join(lines.select(F.col("file_hash").alias("document_id")).distinct(), "document_id", "left_semi")


def unprocessed_lines(spark: SparkSession, manifest_path: str, documents_path: str) -> DataFrame:
    """(document_id, warning): a row a manifest line whose document isn't there."""
    lines = spark.read.json(manifest_path).select(F.col("file_hash").alias("document_id"))
    left = lines.join(spark.read.parquet(documents_path), "document_id", "left_anti")
    return left.withColumn("warning", F.concat(F.lit("no processed document for "), F.coalesce("document_id", F.lit("a line without a hash"))))


def qa_dataset(spark: SparkSession, path: str) -> DataFrame:
    """QA pairs from .jsonl (a row a line) or .json (an array); another suffix is an error."""
    if path.endswith(".jsonl"):
        return spark.read.json(path)
    if path.endswith(".json"):
        return spark.read.option("multiLine", "true").json(path)
    raise ValueError(f"unsupported QA file: {path}")


def chunk_by_id(chunks: DataFrame, chunk_id: str) -> DataFrame:
    return chunks.filter(F.col("chunk_id") == chunk_id)


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Chunk stores, postings and vectors as Parquet."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_report(df: DataFrame, path: str, kind: str = "json") -> None:
    """Metric and ablation reports, a few rows, as one JSON or CSV file."""
    writer = df.coalesce(1).write.mode("overwrite")
    writer.option("header", "true").csv(path) if kind == "csv" else writer.json(path)


def index_metadata(spark: SparkSession, name: str, chunks: DataFrame, dimension: int, fingerprint: str) -> DataFrame:
    count = chunks.agg(F.count(F.lit(1)).alias("num_chunks"))
    return count.select(F.lit(name).alias("index_type"), "num_chunks", F.lit(dimension).alias("embedding_dim"), F.current_timestamp().alias("created_timestamp"), F.lit(fingerprint).alias("config_hash"))


def synthetic_qa(spark: SparkSession) -> DataFrame:
    """Three QA rows for runs without a QA file."""
    rows = [
        ("When does the order apply?", "It applies from its effective date.", "2023-01-01", [(0, 40, "order_1")]),
        ("Who must keep records?", "Every holder must keep records.", "2023-06-01", [(0, 35, "order_2")]),
        ("Is the circular in force?", "The circular is in force.", "2024-01-01", [(0, 30, "order_3")]),
    ]
    return spark.createDataFrame(rows, "question string, answer string, as_of_date string, relevant_spans array<struct<start:int,end:int,document_id:string>>")
