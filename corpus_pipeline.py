"""From documents to segmented training text in five stages, each written as Parquet and read again.

quality classifier -> n-gram Jaccard join -> secret scan -> mixing to target weights -> SentencePiece
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.llm import mixing, ngram_join, pieces, quality, secrets
from chronolex.llm.common import staged, table, unused


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine, learnt from labels of folds 1 to 4, predicts to be of quality 1."""
    machine = quality.fit(docs, table(spark, sf_dir, "labels"))
    score, predicted = unused(docs, "_score"), unused(docs, "_predicted")
    return quality.scored(docs, machine, names=(score, predicted)).filter(F.col(predicted) == 1).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles of Jaccard 0.8 or more."""
    return ngram_join.without_near_copies(docs, k=5, threshold="4/5")


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its secrets replaced by a mark."""
    return secrets.redacted(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to source weights takes them."""
    return mixing.mixed(docs)


def segmentation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece counts, scores and checksums of every document's best segmentations."""
    return pieces.digest(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", quality_filter),
    ("n-gram Jaccard join", near_copies),
    ("secret scan", secret_redaction),
    ("source mixing", source_mix),
    ("SentencePiece segmentation", segmentation),
]

#: the stages learn models and search lattices: tested against brute force instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"), "zstd")
    return STAGES[-1][1](spark, docs, sf_dir)
