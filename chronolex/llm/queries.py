"""The queries of the operators and, where SQL can express them, their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.llm.common import table


def op1_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from chronolex.llm.huffman import corpus_file

    return corpus_file(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronolex.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronolex.llm.ngram_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), k=3, threshold="9/10")


def op4_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronolex.llm.quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_pruned_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronolex.llm.pruned_graph import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op6_metric_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronolex.llm.metric_tree import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op7_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronolex.llm.lm import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op8_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronolex.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).drop("source")


def op9_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from chronolex.llm.pieces import digest

    return digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_secret_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronolex.llm.secrets import secret_report

    return secret_report(table(spark, sf_dir, "documents"))


def op11_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from chronolex.llm.alignment import align

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_voronoi_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronolex.llm.hard_negatives import mine

    return mine(table(spark, sf_dir, "embeddings"), lambda vec_id, label: F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronolex.llm.language import identify

    return identify(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, query in globals().items() if name.startswith("op")}


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_OP2 = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), d AS (SELECT page_id, html, strlen(html) AS n, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS top FROM p),
  g AS (SELECT *, list_transform(range(8), lambda i: ('0x' || substr(h, 1 + 5 * i, 5))::INT) AS parts FROM d)
  SELECT page_id, n::BIGINT AS payload_bytes, array_to_string(list_transform(parts, lambda v: substr('{_BASE32}', ((v >> 15) & 31) + 1, 1) || substr('{_BASE32}', ((v >> 10) & 31) + 1, 1)
    || substr('{_BASE32}', ((v >> 5) & 31) + 1, 1) || substr('{_BASE32}', (v & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM g"""
_OP6 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS v FROM embeddings),
  s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s QUALIFY rank <= 10"""


_OP12 = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
  p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
  SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5"""


def oracle_sql() -> dict[str, str]:
    """The others encode, learn, search approximately or follow links: they are tested against brute force instead."""
    return {"op2_warc": _OP2, "op6_metric_tree_topk": _OP6, "op12_voronoi_negatives": _OP12}
