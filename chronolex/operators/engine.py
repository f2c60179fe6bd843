"""Questions and differences end to end: queries are rows, one plan answers them all.

Chunks are rows (chunk_id, text, spans, languages, section_types), spans an array of structs (text, byte_start,
byte_end, page_num, section_type, confidence); chunk_id is the document's id, an underscore and a number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolex.config import EngineConfig
from chronolex.functions.text import answer_hash
from chronolex.operators import answer as an
from chronolex.operators import claims as cl
from chronolex.operators import conflicts
from chronolex.operators import retrieve as rt
from chronolex.operators import temporal as tp
from chronolex.operators.index import lexical
from chronolex.operators.supersession import document_titles
from chronolex.operators.text_diff import differences, unified
from chronolex.staging import sized_by_rows, staged

RERANK_FROM = 10


def _cut(df: DataFrame) -> DataFrame:
    """df computed once: what follows uses spans many times over, and each use would retrieve again."""
    return staged(df, "engine")


def lists(queries: DataFrame, chunks: DataFrame, config: EngineConfig, query_vectors: DataFrame | None = None, vectors: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The dense, sparse and BM25 lists (query_id, chunk_id, score, rank) of queries (query_id, text), top_k deep; a list that is switched off, or a dense one without vectors, is empty."""
    sized_by_rows(queries.sparkSession)  # hits of alike questions repeat each other
    none = queries.select("query_id", F.lit(None).cast(chunks.schema["chunk_id"].dataType).alias("chunk_id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    dense = rt.dense(query_vectors, vectors, config.top_k) if config.use_dense and query_vectors is not None and vectors is not None else none
    lex = lexical(chunks) if config.use_sparse or config.use_bm25 else None
    sparse = rt.sparse_by_profile(queries, lex, config.top_k) if config.use_sparse else none
    bm25 = rt.bm25_by_profile(queries, lex, config.top_k) if config.use_bm25 else none
    return dense, sparse, bm25


def retrieve(queries: DataFrame, chunks: DataFrame, config: EngineConfig = EngineConfig(), query_vectors: DataFrame | None = None, vectors: DataFrame | None = None, valid: Column | None = None, min_confidence: float = 0.0, languages=None, section_types=None, scorer: Column | None = None) -> DataFrame:
    """queries (query_id, text) -> fused hits (query_id, chunk_id, dense, sparse, bm25, score, confidence, rank) with the chunks' columns.

    Each list has the config's top_k. Filters run on the fused hits, then they are cut to top_k; a scorer re-ranks the queries that keep more than ten."""
    hits = rt.fuse(*lists(queries, chunks, config, query_vectors, vectors), config.hybrid_alpha).join(chunks, "chunk_id")
    hits = rt.top(rt.filtered(hits, min_confidence, languages, section_types, valid), config.top_k)
    if config.use_reranker and scorer is not None:
        many = F.count(F.lit(1)).over(Window.partitionBy("query_id")) > RERANK_FROM
        hits = hits.withColumn("score", F.when(many, rt.rerank(hits, scorer)["score"]).otherwise(F.col("score")))
        hits = rt.top(hits.drop("rank"), config.top_k)
    return hits


Configs = EngineConfig | dict[str, EngineConfig]  # several by name: query_id.config says which a row has, and they differ in switches only


def _one(config: Configs) -> EngineConfig:
    """The configuration whose numbers count: they are equal in several ones."""
    return next(iter(config.values())) if isinstance(config, dict) else config


def _on(config: Configs, has) -> Column | None:
    """The rows whose configuration `has` a switch on; None: no row."""
    if not isinstance(config, dict):
        return F.lit(True) if has(config) else None
    names = [n for n, c in config.items() if has(c)]
    return F.lit(True) if len(names) == len(config) else F.col("query_id.config").isin(names) if names else None


def _switched(rows: DataFrame, config: Configs, has, step, other=lambda rows: rows) -> DataFrame:
    """step of the rows whose configuration `has` a switch on, with other of the rest."""
    on = _on(config, has)
    if on is None:
        return other(rows)
    if not isinstance(config, dict) or all(map(has, config.values())):
        return step(rows)
    return step(rows.filter(on)).unionByName(other(rows.filter(~on)))


def span_stages(hits: DataFrame, as_of: Column, config: Configs = EngineConfig(), titles: DataFrame | None = None, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Temporal spans of the hits: all, those that are valid at the date, and those of them that no conflict takes away; `pos` is the last ones' place by score.

    as_of may read columns of the hits that `keep` names. titles (document_id, key): the documents that names of
    supersession resolve to (supersession.document_titles)."""
    spans = _cut(tp.temporal_spans(hits, keep))
    at_date = lambda precedence: lambda rows: tp.split_by_date(rows, as_of, precedence, titles).filter("valid").drop("valid")
    dated = _cut(_switched(spans, config, lambda c: c.enable_precedence, at_date(True), at_date(False)))

    def resolved(rows):
        membership = _cut(conflicts.members(rows))
        return conflicts.resolve(rows, membership, _cut(conflicts.links(rows, membership)))

    return spans, dated, _placed(_switched(dated, config, lambda c: c.suppress_contradictions, resolved))


def _placed(spans: DataFrame) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "span_id")
    return _cut(spans.withColumn("pos", F.row_number().over(order)))


def valid_spans(hits: DataFrame, as_of: Column, config: EngineConfig = EngineConfig(), titles: DataFrame | None = None) -> DataFrame:
    """Temporal spans of the hits that are valid at the date, without the losers of conflicts."""
    return span_stages(hits, as_of, config, titles)[2]


def verified(answers: DataFrame, spans: DataFrame, config: Configs = EngineConfig(), similarity=None) -> DataFrame:
    """Claims of answers (query_id, text) with their best span: query_id, sentence_index, claim, start, end, span_id, label, confidence."""
    evidence = spans.select(F.col("query_id").alias("answer_id"), F.col("pos").alias("evidence_id"), "text")
    found = cl.best_evidence(cl.extract(answers.withColumnRenamed("query_id", "answer_id")), evidence, similarity=similarity)
    sure = F.coalesce("similarity", F.lit(0.0))
    found = found.withColumnRenamed("answer_id", "query_id")
    on = _on(config, lambda c: c.nli_threshold > 0)
    label = F.lit("supported") if on is None else F.when(on, cl.label(F.col("similarity"))).otherwise("supported")
    rows = found.withColumn("label", F.when(F.col("evidence_id").isNull(), "uncertain").otherwise(label)).withColumn("confidence", sure)
    ids = spans.select("query_id", F.col("pos").alias("evidence_id"), "span_id")
    return rows.join(ids, ["query_id", "evidence_id"], "left").drop("evidence_id", "similarity")


def build_answer(queries: DataFrame, spans: DataFrame, results: DataFrame, summary: DataFrame, config: Configs = EngineConfig()) -> DataFrame:
    """(query_id, answer, citations, answer_hash, refusal_code, refusal_message): refuted spans go, each conflict group keeps its winner,
    the rest is decoded, refused or cited. A refused query has an empty answer; a query without spans is refused, too."""
    one = _one(config)
    left = _switched(spans, config, lambda c: c.suppress_contradictions, lambda rows: an.without_refuted_spans(rows, results))
    left = _cut(_switched(left, config, lambda c: c.enable_precedence, lambda rows: an.group_winners(rows, an.conflict_groups(rows)).drop("group")))
    decoded = an.decode(left, one.max_answer_chars)
    counted = left.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_spans"))
    rows = queries.select("query_id").join(summary, "query_id", "left").join(counted, "query_id", "left").join(decoded.select("query_id", "answer"), "query_id", "left")
    rows = rows.fillna(0, ["n_spans", "total_claims", "refuted_claims"]).fillna(0.0, ["average_confidence"]).fillna("", ["answer"]).fillna(True, ["refusal_recommended"])
    rows = _cut(an.refusal(rows, one.min_evidence_spans, one.refusal_threshold).select("query_id", "answer", "refusal_code"))
    rows = rows.withColumn("refusal_message", an.refusal_message(F.col("refusal_code"))).withColumn("answer", F.when(F.col("refusal_code").isNull(), F.col("answer")).otherwise(""))
    citing = _on(config, lambda c: c.include_citations)
    if citing is not None:
        cited = an.cited(an.evidence(left.filter(citing).drop("confidence"), results).withColumn("byte_end", F.col("byte_start") + F.octet_length("text")).withColumn("page_num", F.lit(None).cast("int")))
        marked = an.annotated(an.sentence_citations(rows.filter(F.col("refusal_code").isNull() & citing).select("query_id", "answer"), cited)).withColumnRenamed("answer", "_marked")
        notes = cited.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("number", "citation"))), lambda x: x["citation"]).alias("citations"))
        rows = rows.join(marked, "query_id", "left").join(notes, "query_id", "left").withColumn("answer", F.coalesce("_marked", "answer")).drop("_marked")
    else:
        rows = rows.withColumn("citations", F.lit(None).cast("array<string>"))
    kept = F.when(F.col("refusal_code").isNull(), F.col("citations"))
    return rows.select("query_id", "answer", F.coalesce(kept, F.array().cast("array<string>")).alias("citations"), answer_hash(F.col("answer")).alias("answer_hash"), "refusal_code", "refusal_message")


def answered(queries: DataFrame, spans: DataFrame, config: Configs = EngineConfig(), threshold: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """Answers (build_answer) of queries (query_id) from their spans, and the verified claims of what the spans say."""
    drafts = _cut(an.decode(spans, _one(config).max_answer_chars).select("query_id", F.col("answer").alias("text")))
    results = _cut(verified(drafts, spans, config))
    summary = cl.summarise(drafts.withColumnRenamed("query_id", "answer_id"), results.withColumnRenamed("query_id", "answer_id"), threshold).withColumnRenamed("answer_id", "query_id")
    return build_answer(queries, spans, results, summary, config), results


def ask(queries: DataFrame, chunks: DataFrame, as_of: Column, config: EngineConfig = EngineConfig(), threshold: float = 0.3, titles: DataFrame | None = None, **options) -> DataFrame:
    """queries (query_id, text) answered as of a date from chunks; options go to retrieve().

    What a text says it supersedes counts by the titles of documents; without titles (document_id, key) the chunks' own."""
    titles = _cut(document_titles(chunks)) if titles is None else titles
    return answered(queries, valid_spans(retrieve(queries, chunks, config, **options), as_of, config, titles), config, threshold)[0]


def diff(queries: DataFrame, chunks: DataFrame, old: Column, new: Column, config: EngineConfig = EngineConfig(), titles: DataFrame | None = None, **options) -> DataFrame:
    """Answers as of two dates compared: query_id, text_diff, added, removed, retained span ids, hash_changed, old_span_count, new_span_count."""
    titles = _cut(document_titles(chunks)) if titles is None else titles
    hits = _cut(retrieve(queries, chunks, config, **options))
    sides = {}
    for name, day in (("old", old), ("new", new)):
        spans = valid_spans(hits, day, config, titles)
        if config.enable_precedence:
            spans = _cut(an.group_winners(spans, an.conflict_groups(spans)).drop("group"))
        texts = an.decode(spans, config.max_answer_chars).select("query_id", F.col("answer").alias(name))
        sides[name] = (spans, texts, spans.groupBy("query_id").agg(F.count(F.lit(1)).alias(f"{name}_span_count")))
    ids = lambda spans, name: spans.groupBy("query_id").agg(F.sort_array(F.collect_set("span_id")).alias(name))
    rows = queries.select("query_id")
    for name, (spans, texts, counts) in sides.items():
        rows = rows.join(texts, "query_id", "left").join(counts, "query_id", "left").join(ids(spans, f"_{name}"), "query_id", "left")
    rows = rows.fillna("", ["old", "new"]).fillna(0, ["old_span_count", "new_span_count"])
    a, b = (F.coalesce(c, F.array().cast("array<string>")) for c in ("_old", "_new"))
    rows, sentence = _cut(rows), r"(?<=[.!?])\s+"
    lines = rows.select(F.col("query_id").alias("key"), *[F.when(F.col(c) != "", F.split(c, sentence)).alias(c) for c in ("old", "new")])
    rows = rows.join(unified(differences(lines)).select(F.col("key").alias("query_id"), F.col("lines").alias("_diff")), "query_id", "left")
    return rows.select(
        "query_id", F.coalesce("_diff", F.array().cast("array<string>")).alias("text_diff"), F.array_except(b, a).alias("added"), F.array_except(a, b).alias("removed"), F.array_intersect(a, b).alias("retained"),
        (answer_hash(F.col("old")) != answer_hash(F.col("new"))).alias("hash_changed"), "old_span_count", "new_span_count",
    )
