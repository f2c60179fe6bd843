"""Index, retrieval, claim, answer, metric, training and layout queries."""

from __future__ import annotations


from pyspark.sql import functions as F

from chronolex.config import EngineConfig
from chronolex.functions import text as tx
from chronolex.operators import answer as an
from chronolex.operators import calibrate as ca
from chronolex.operators import claims as cl
from chronolex.operators import dense_index as dx
from chronolex.operators import engine as en
from chronolex.operators import evaluate as ev
from chronolex.operators import index as ix
from chronolex.operators import layout as ly
from chronolex.operators import metrics as mt
from chronolex.operators import retrieve as rt
from chronolex.operators import temporal as tm
from chronolex.operators import training as tr
from chronolex.plans import fixed as fx
from chronolex.plans.inputs import AS_OF, EARLIER, INTERVALS, LEGAL, SPANS, intervals, legal, sql, table, temporal
from chronolex.plans.temporal_queries import _kept
from chronolex.operators.temporal import active_spans
from chronolex.staging import staged

K = 10
DEPTH = 100  # of the lists that training and its metrics look through


def _chunks(s, d):
    return table(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.array("lang").alias("languages"))


def _queries(s, d):
    return table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _vectors(s, d):
    """Asked and all vectors; a query's number is its vec_id over 20."""
    vectors = ix.unit_vectors(table(s, d, "embeddings").withColumnRenamed("vec_id", "chunk_id"))
    return vectors.filter("chunk_id % 20 = 0").select(F.expr("chunk_id DIV 20").alias("query_id"), F.col("v").alias("q")), vectors.select("chunk_id", "v")


def _dense(s, d, k=K):
    return rt.dense(*_vectors(s, d), k)


def _dense_cells(s, d):
    asked, vectors = _vectors(s, d)
    index = dx.build(vectors)
    return dx.search(asked, index, K, dx.calibrated(index))


def _own_labels(s, d):
    """(query_id, own): query i is the vector with vec_id 20 i."""
    return table(s, d, "embeddings").filter("vec_id % 20 = 0").select(F.expr("vec_id DIV 20").alias("query_id"), F.col("label").alias("own"))


def _lexical(s, d):
    return ix.lexical(_chunks(s, d))


def _bm25(s, d, k=K, lex=None):
    return rt.bm25(_queries(s, d), lex or _lexical(s, d), k)


def _sparse(s, d, k=K, lex=None):
    return rt.sparse(_queries(s, d), lex or _lexical(s, d), k)


def _bm25_blocks(s, d):
    return rt.block_top_k(rt.asked_terms(_queries(s, d)), staged(ix.blocks(ix.bm25_index(_lexical(s, d))), "blocks"), K)


def _sparse_blocks(s, d):
    lex = _lexical(s, d)
    idf = staged(ix.tfidf_idf(lex), "idf")
    asked = rt.asked_vectors(_queries(s, d), idf).withColumnRenamed("asked", "times")
    return rt.block_top_k(asked, staged(ix.blocks(ix.tfidf_vectors(lex, idf)), "blocks"), K)


def _lists(s, d, k=K):
    """The dense and the two lexical lists; both lexical ones from one tokenisation."""
    lex = _lexical(s, d)
    return _dense(s, d, k), _sparse(s, d, k, lex), _bm25(s, d, k, lex)


def _fused(s, d):
    return rt.fuse(*_lists(s, d))


def _hybrid(s, d):
    out = rt.top(_fused(s, d), K)
    return out.select("query_id", "chunk_id", *[F.round(c, 5).alias(c) for c in ("dense", "sparse", "bm25", "score", "confidence")])


def _rrf(s, d):
    out = rt.top(rt.reciprocal_rank(*_lists(s, d, 2 * K)), K)
    return out.select("query_id", "chunk_id", F.round("score", 6).alias("score"))


def _filtered(s, d):
    hits = rt.top(_fused(s, d), K).join(_chunks(s, d).select("chunk_id", "languages"), "chunk_id")
    return rt.filtered(hits, 0.2, ["de", "fr"]).select("query_id", "chunk_id")


def _reranked(s, d):
    return rt.rerank(_bm25(s, d), 1.0 / F.col("rank")).select("query_id", "chunk_id", F.round("score", 8).alias("score"))


def _answers(s, d):
    return legal(s, d).select(F.col("doc_id").alias("answer_id"), "text")


def _evidence(s, d):
    return sql(s, d, "SELECT o_orderkey AS answer_id, o_orderkey * 10 + i AS evidence_id, CASE i WHEN 0 THEN 'This rule is in force' ELSE 'Circular ' || o_orderkey || ' is effective on the day' END AS text FROM {orders} LATERAL VIEW explode(array(0, 1)) t AS i WHERE o_orderkey % 9 > 0")


_EVIDENCE = "SELECT o_orderkey AS answer_id, o_orderkey * 10 + i AS evidence_id, CASE i WHEN 0 THEN 'This rule is in force' ELSE 'Circular ' || o_orderkey || ' is effective on the day' END AS text FROM orders, (VALUES (0), (1)) v(i) WHERE o_orderkey % 9 > 0"


def _results(s, d):
    found = cl.best_evidence(cl.extract(_answers(s, d)), _evidence(s, d))
    similarity = F.coalesce("similarity", F.lit(0.3))
    return found.withColumn("label", cl.label(F.when(F.col("evidence_id").isNotNull(), similarity))).withColumn("confidence", similarity)


def _verified(s, d):
    return _results(s, d).select("answer_id", "sentence_index", "evidence_id", "label", F.round("confidence", 6).alias("confidence"))


def _summary(s, d):
    out = cl.summarise(_answers(s, d), _results(s, d))
    return out.withColumn("average_confidence", F.round("average_confidence", 6))


def _answer_spans(s, d):
    spans = temporal(s, d).withColumn("document_type", F.lit("order")).withColumn("byte_start", F.col("pos") * 10).withColumn("byte_end", F.col("pos") * 10 + F.length("text")).withColumn("page_num", F.lit(1)).withColumn("confidence", F.col("precedence_weight") / 10)
    return spans.withColumn("query_id", F.col("document_id"))


def _groups(s, d):
    return an.conflict_groups(_answer_spans(s, d))


def _winners(s, d):
    spans = _answer_spans(s, d)
    return an.group_winners(spans, an.conflict_groups(spans)).select("query_id", "span_id", "group")


def _decoded(s, d):
    return an.decode(_answer_spans(s, d))


def _cited(s, d):
    return an.cited(_answer_spans(s, d)).select("query_id", "span_id", F.col("number").cast("long").alias("number"), "citation")


def _sentence_citations(s, d):
    spans = an.cited(_answer_spans(s, d))
    answers = spans.groupBy("query_id").agg(F.concat_ws(". ", F.max("text"), F.min("text")).alias("answer"))
    return an.sentence_citations(answers, spans).select("query_id", "sentence_index", F.array_join("numbers", ",").alias("numbers"))


def _refusal(s, d):
    summary = cl.summarise(_answers(s, d), _results(s, d), 0.4).withColumn("n_spans", F.col("answer_id") % 4).join(_answers(s, d).withColumnRenamed("text", "answer"), "answer_id")
    out = an.refusal(summary)
    return out.select("answer_id", "refusal_code", an.refusal_message(F.col("refusal_code")).alias("message"))


def _evidence_rows(s, d):
    spans = temporal(s, d)
    results = spans.filter("span_id % 3 = 0").select("query_id", "span_id", F.lit("supported").alias("label"), (F.col("precedence_weight") / 10).alias("confidence"))
    return an.evidence(spans.select("query_id", "span_id"), results)


def _suppressed(s, d):
    spans = temporal(s, d)
    results = spans.select("query_id", "span_id", F.when(F.col("span_id") % 4 == 0, "refuted").otherwise("supported").alias("label"))
    return an.without_refuted_spans(spans, results).select("query_id", "span_id")


def _evidence_diff(s, d):
    spans = temporal(s, d)
    at = lambda day: active_spans(spans, F.lit(day).cast("timestamp_ntz"))
    out = an.evidence_diff(at(EARLIER), at(AS_OF))
    return out.select("query_id", *[F.array_join(F.sort_array(c), ",").alias(c) for c in ("added", "removed", "retained")])


def _labelled(s, d):
    return sql(s, d, "SELECT doc_id, CASE WHEN toxic = 1 THEN 'refuted' WHEN quality = 1 THEN 'supported' ELSE 'uncertain' END AS label, (doc_id % 101) / 100.0D AS confidence, quality = 1 AS correct, CAST(quality AS STRING) AS predicted, CAST(CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END AS STRING) AS truth FROM {labels}")


_LABELLED = "SELECT doc_id, CASE WHEN toxic = 1 THEN 'refuted' WHEN quality = 1 THEN 'supported' ELSE 'uncertain' END AS label, (doc_id % 101) / 100.0::DOUBLE AS confidence, quality = 1 AS correct, quality::VARCHAR AS predicted, CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END::VARCHAR AS truth FROM labels"


def _isotonic(s, d):
    return ca.isotonic(_labelled(s, d).withColumn("y", F.col("correct").cast("double")), "confidence", "y").select("lo", "hi", "n", F.round("fitted", 6).alias("fitted"))


def _isotonic_ece(s, d):
    """Calibration error of the scores as they are and as fitted."""
    rows = _labelled(s, d)
    blocks = ca.isotonic(rows.withColumn("y", F.col("correct").cast("double")), "confidence", "y")
    fitted = rows.withColumn("confidence", ca.calibrated(F.col("confidence"), blocks))
    before, after = (mt.ece(x).select(F.round("ece", 6).alias(n)) for x, n in ((rows, "ece_before"), (fitted, "ece_after")))
    return before.join(F.broadcast(after))


def _split(s, d):
    """Labelled rows by confidence, the first four fifths for training; ties by doc_id."""
    return tr.ordered_split(_labelled(s, d), ["confidence", "doc_id"]).select("doc_id", "part")


def _faithfulness(s, d):
    return _labelled(s, d).agg(F.round(mt.faithfulness(), 6).alias("faithfulness"), F.round(mt.contradiction_rate(), 6).alias("contradiction_rate"))


def _ndcg(s, d):
    hits = _dense(s, d)
    label = table(s, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label")
    rows = hits.join(label, "chunk_id").join(_own_labels(s, d), "query_id")
    ranked = rows.select("query_id", F.col("chunk_id").alias("item_id"), "score", (F.col("label") == F.col("own")).cast("double").alias("relevance"))
    return mt.ndcg(ranked).withColumn("ndcg", F.round("ndcg", 6))


def _span_f1(s, d):
    spans = intervals(s, d).select("document_id", "start", "end", "page_num")
    out = mt.span_f1(spans.filter("page_num < 4"), spans.filter("page_num > 1"), ["document_id", "start", "end"])
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


def _latency(s, d):
    out = mt.latency(table(s, d, "events"), "value", ["event_type"])
    return out.select("event_type", "n", *[F.round(c, 4).alias(c) for c in ("mean", "median", "p95", "p99", "std")])


def _temporal_accuracy(s, d):
    from chronolex.operators.temporal import in_interval

    return temporal(s, d).groupBy("query_id").agg(F.round(mt.temporal_accuracy(in_interval(F.lit(AS_OF).cast("timestamp_ntz"))), 6).alias("accuracy"))


_FORCE = "This rule is in force"


def _robustness(s, d):
    """Mean likeness of the notices to a statement, as they stand and code-mixed."""
    words, asked = tx.word_set(F.lit(_FORCE)), legal(s, d)
    like = lambda t: F.avg(F.round(tx.jaccard(tx.word_set(t), words), 6))
    return asked.agg(mt.robustness_drop(like(F.col("text")), like(tx.code_mixed(F.col("text")))).alias("robustness_drop"))


def _metrics(s, d):
    """One row of the evaluation's metrics, each from its own table."""
    from chronolex.operators.temporal import in_interval

    spans = intervals(s, d).select("document_id", "start", "end", "page_num")
    parts = [
        _labelled(s, d).agg(mt.faithfulness().alias("faithfulness"), mt.contradiction_rate().alias("contradiction_rate"), *[mt.label_share(x).alias(f"{x}_ratio") for x in ("supported", "uncertain")]),
        _ndcg(s, d).agg(F.avg("ndcg").alias("ndcg")),
        mt.span_f1(spans.filter("page_num < 4"), spans.filter("page_num > 1"), ["document_id", "start", "end"]).select(F.col("f1").alias("span_f1"), F.col("precision").alias("span_precision"), F.col("recall").alias("span_recall")),
        mt.latency(table(s, d, "events").withColumn("all", F.lit(1)), "value", ["all"]).select(F.col("p95").alias("p95_latency"), F.col("mean").alias("latency_mean")),
        temporal(s, d).agg(mt.temporal_accuracy(in_interval(F.lit(AS_OF).cast("timestamp_ntz"))).alias("temporal_accuracy")),
        _robustness(s, d),
        mt.ece(_labelled(s, d)),
    ]
    return mt.evaluation(parts)


def _targets(s, d):
    return mt.targets(_metrics(s, d)).select(*[f"meets_{n}" for n in mt.TARGETS])


def _notice_chunks(s, d):
    """Notices of all orders as chunks of one span each."""
    one = F.array(F.struct(F.col("text").alias("text"), F.lit(0).alias("byte_start"), F.octet_length("text").alias("byte_end"), F.lit(1).alias("page_num"), F.lit("paragraph").alias("section_type"), F.lit(0.9).alias("confidence")))
    rows = legal(s, d)
    return staged(rows.select(F.concat_ws("_", "doc_id", F.lit(0)).alias("chunk_id"), "text", one.alias("spans"), F.array(F.lit("en")).alias("languages"), F.array(F.lit("paragraph")).alias("section_types")), "chunks")


def _qa(s, d):
    """A question on every order whose key 200 divides: the first words of its notice, as of a date but for every third; the notice is what answers it."""
    rows = legal(s, d).filter("doc_id % 200 = 0")
    day = F.when(F.expr("doc_id DIV 200 % 3 > 0"), F.lit(AS_OF).cast("timestamp_ntz"))
    relevant = F.array(F.struct(F.col("doc_id").alias("document_id"), F.lit(0).alias("byte_start"), F.octet_length("text").alias("byte_end")))
    return staged(rows.select(F.col("doc_id").alias("query_id"), F.regexp_extract("text", r"^(?:\S+\s+){0,7}\S+", 0).alias("question"), F.col("text").alias("expected"), day.alias("as_of"), relevant.alias("relevant")), "qa")


def _asked(s, d):
    questions = _qa(s, d).select("query_id", F.col("question").alias("text"))
    out = en.ask(questions, _notice_chunks(s, d), F.lit(AS_OF).cast("timestamp_ntz"))
    return out.select("query_id", "answer", F.size("citations").alias("citations"), "answer_hash", "refusal_code")


def _differed(s, d):
    questions = _qa(s, d).select("query_id", F.col("question").alias("text"))
    out = en.diff(questions, _notice_chunks(s, d), *[F.lit(day).cast("timestamp_ntz") for day in (EARLIER, AS_OF)])
    return out.select("query_id", F.array_join("text_diff", "\n").alias("text_diff"), *[F.size(c).alias(c) for c in ("added", "removed", "retained")], "hash_changed", "old_span_count", "new_span_count")


def _qa_evaluation(s, d):
    qa = _qa(s, d)
    rows = ev.per_question(ev.run(qa, _notice_chunks(s, d), {"baseline": EngineConfig()}), qa)
    return rows.select("query_id", "variant", "question", "answer", "refusal_code", "n_spans", "suppressed", "conflicted", F.size("predicted_spans").alias("predicted"), F.size("true_spans").alias("true"))


def _ablations(s, d):
    """(config, metric, value): the questions on notices asked under every configuration."""
    qa = _qa(s, d)
    return ev.measured(ev.run(qa, _notice_chunks(s, d), mt.ablation_grid(EngineConfig())), qa)


def _importance(s, d):
    out = mt.importance(mt.ablation_delta(staged(_ablations(s, d), "metrics")))
    return out.select("config", F.round("importance", 6).alias("importance"))


def _hard_negatives(s, d):
    label = table(s, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label")
    positives = label.join(_own_labels(s, d), F.col("label") == F.col("own")).select("query_id", "chunk_id")
    return tr.hard_negatives(_dense(s, d, DEPTH), positives).withColumn("n", F.col("n").cast("long"))


def _ir_metrics(s, d):
    label = table(s, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label")
    positives = label.join(_own_labels(s, d), F.col("label") == F.col("own")).filter("query_id * 20 <> chunk_id").select("query_id", "chunk_id")
    out = tr.retrieval_metrics(_dense(s, d, DEPTH), positives)
    return out.select("query_id", *[F.round(c, 6).alias(c) for c in ("recall_at_10", "recall_at_100", "map", "ndcg")])


def _train_pairs(s, d):
    qa = sql(s, d, "SELECT o_custkey AS question, array(o_orderkey % 1200) AS positives, array(1, 2, o_orderkey % 1300, 4, 5, 6, 7) AS negatives FROM {orders}")
    corpus = table(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return tr.training_pairs(qa, corpus).groupBy("question", "chunk_id", "label").agg(F.count(F.lit(1)).alias("n"))


def _triples(s, d):
    return tr.nli_triples(_answers(s, d)).select("answer_id", "sentence_index", "hypothesis", "label")


def _confusion(s, d):
    rows = _labelled(s, d).select(F.col("truth").alias("label"), "predicted")
    return tr.confusion(rows, ["0", "1"]).select("label", F.col("0").alias("predicted_0"), F.col("1").alias("predicted_1"))


def _class_scores(s, d):
    out = tr.class_scores(_labelled(s, d).select(F.col("truth").alias("label"), "predicted"))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


_BOXES = """SELECT l_orderkey AS page, ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 1000 + l_suppkey % 1000 AS elem_id, CAST(l_suppkey % 400 AS DOUBLE) AS x1, CAST(l_partkey % 700 AS DOUBLE) AS y1, l_suppkey % 400 + 40 + l_quantity AS x2, l_partkey % 700 + 8.0E0 + l_linenumber AS y2,
  CASE l_linenumber WHEN 1 THEN 'THE TITLE' WHEN 2 THEN '1. first item of the list' WHEN 3 THEN 'Table 7' WHEN 4 THEN 'a  b  c  d' WHEN 5 THEN 'label' WHEN 6 THEN '' ELSE 'A paragraph of the page which is long enough' END AS text FROM TABLE"""


def _boxes(s, d):
    return sql(s, d, _BOXES.replace("TABLE", "{lineitem}"))


def _iou(s, d):
    side = lambda k: _boxes(s, d).select("page", *[F.col(c).alias(f"{k}_{c}") for c in ("elem_id", "x1", "y1", "x2", "y2")])
    pairs = side("a").join(side("b"), "page").filter("a_elem_id < b_elem_id")
    return pairs.select("a_elem_id", "b_elem_id", F.round(ly.iou(), 6).alias("iou"))


_METRIC_NAMES = ("faithfulness", "contradiction_rate", "ndcg", "span_f1", "p95_latency", "temporal_accuracy", "robustness_drop", "ece", "span_precision", "span_recall", "latency_mean", "supported_ratio", "uncertain_ratio")


def _layout_elements(s, d):
    """The lists of the structure roll-up, a row an element."""
    lists = ly.structure_lists(ly.classified(_boxes(s, d)))
    item = lambda name: lambda e: F.struct(F.lit(name).alias("group"), e["position"].cast("long").alias("position"), e["text"].alias("text"), e["bbox"]["x1"].alias("x1"), e["bbox"]["y2"].alias("y2"))
    each = F.concat(*[F.transform(name, item(name)) for name in ("headings", "sections", "tables", "paragraphs")])
    return lists.select("page", F.explode(each).alias("e")).select("page", "e.*")


def _nli_labels(s, d):
    """Scores made of line items, as an entailment model would give them."""
    rows = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.array(F.col("l_quantity") / 10, F.col("l_discount") * 30, F.col("l_tax") * 40).cast("array<double>").alias("x"))
    rows = rows.withColumn("v", cl.label_of_scores(F.col("x")))
    return rows.select("l_orderkey", "l_linenumber", "v.label", F.round("v.confidence", 6).alias("confidence"))


def _claim_report(s, d):
    return cl.report(_results(s, d).withColumn("confidence", F.round("confidence", 6)), _evidence(s, d))


def _provenance(s, d):
    hits = _notice_chunks(s, d).select(F.lit(1).alias("query_id"), "chunk_id", (F.length("text") / 100).alias("score"), "spans")
    return rt.provenance(hits).select("chunk_id", "document_id", "byte_start", "byte_end", "section_type", F.round("score", 6).alias("score"))


def _filtered_notices(s, d):
    """Fused hits of the questions on notices: English paragraphs that hold at the date."""
    hits = en.retrieve(_qa(s, d).select("query_id", F.col("question").alias("text")), _notice_chunks(s, d), EngineConfig())
    dated = tm.with_temporal_metadata(staged(hits, "hits"))
    return rt.filtered(dated, 0.2, ["en"], ["paragraph", "heading"], tm.hit_valid(F.lit(AS_OF).cast("timestamp_ntz"))).select("query_id", "chunk_id", F.round("score", 5).alias("score"))


def _bbox(s, d):
    """The box of each line item's box as a polygon of four points."""
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    rows = _boxes(s, d).select("elem_id", ly.bbox(F.array(point("x2", "y1"), point("x1", "y1"), point("x1", "y2"), point("x2", "y2"))).alias("b"))
    return rows.select("elem_id", "b.*")


QUERIES = {
    "bm25_topk": lambda s, d: _bm25(s, d).drop("rank"),
    "tfidf_topk": lambda s, d: _sparse(s, d).drop("rank"),
    "bm25_blocks": lambda s, d: _bm25_blocks(s, d).drop("rank"),
    "tfidf_blocks": lambda s, d: _sparse_blocks(s, d).drop("rank"),
    "dense_topk": lambda s, d: _dense(s, d).withColumn("rank", F.col("rank").cast("long")),
    "dense_cells": lambda s, d: _dense_cells(s, d).withColumn("rank", F.col("rank").cast("long")),
    "hybrid_fuse": _hybrid,
    "rrf_fuse": _rrf,
    "filter_lang_conf": _filtered,
    "rerank": _reranked,
    "index_stats": lambda s, d: ix.index_statistics(_lexical(s, d)),
    "claims": lambda s, d: cl.extract(_answers(s, d)).select("answer_id", "sentence_index", "claim", "start", F.col("end").alias("end_"), "claim_type"),
    "verify_claims": _verified,
    "verify_summary": _summary,
    "filter_claims": lambda s, d: cl.without_refuted(_answers(s, d), _results(s, d)),
    "conflict_groups": _groups,
    "group_winners": _winners,
    "dedup_decode": _decoded,
    "citations": _cited,
    "sentence_citations": _sentence_citations,
    "refusal": _refusal,
    "evidence_rows": _evidence_rows,
    "suppress_refuted": _suppressed,
    "evidence_diff": _evidence_diff,
    "faithfulness": _faithfulness,
    "ndcg10": _ndcg,
    "span_f1": _span_f1,
    "latency_stats": _latency,
    "temporal_accuracy": _temporal_accuracy,
    "ece": lambda s, d: mt.ece(_labelled(s, d)).select(F.round("ece", 6).alias("ece")),
    "evaluation": lambda s, d: _metrics(s, d).select(*[F.round(c, 4).alias(c) for c in _METRIC_NAMES]),
    "targets": _targets,
    "ablations": lambda s, d: _ablations(s, d).withColumn("value", F.round("value", 4)),
    "ablation_importance": _importance,
    "ask": _asked,
    "diff": _differed,
    "qa_evaluation": _qa_evaluation,
    "hard_negatives": _hard_negatives,
    "retrieval_metrics": _ir_metrics,
    "train_pairs": _train_pairs,
    "nli_triples": _triples,
    "confusion": _confusion,
    "class_scores": _class_scores,
    "isotonic_fit": _isotonic,
    "isotonic_ece": _isotonic_ece,
    "ordered_split": _split,
    "iou": _iou,
    "layout_kinds": lambda s, d: ly.classified(_boxes(s, d)).select("elem_id", "kind"),
    "reading_order": lambda s, d: ly.reading_order(_boxes(s, d)).select("elem_id", F.col("reading_order").cast("long").alias("reading_order")),
    "layout_columns": lambda s, d: ly.columns(_boxes(s, d)),
    "bbox": _bbox,
    "layout_elements": _layout_elements,
    "nli_labels": _nli_labels,
    "claim_report": _claim_report,
    "provenance": _provenance,
    "filter_sections_asof": _filtered_notices,
    "layout_structure": lambda s, d: ly.structure(ly.classified(_boxes(s, d))),
}

_TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '')"
_STOP = ", ".join(f"'{w}'" for w in fx.STOP_WORDS)
_BM25_AT = f"""docs AS (SELECT doc_id AS chunk_id, {_TOKENS} AS l FROM documents), size AS (SELECT count(*) AS n, avg(len(l)) AS avgdl FROM docs),
  occ AS (SELECT chunk_id, len(l) AS dl, unnest(l) AS term FROM docs), tf AS (SELECT chunk_id, dl, term, count(*) AS tf FROM occ GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
  raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, size), idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
  bq AS (SELECT item_id AS query_id, unnest({_TOKENS}) AS term FROM benchmark),
  bs AS (SELECT query_id, chunk_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM bq JOIN tf USING (term) JOIN idf USING (term), size GROUP BY ALL),
  bm25 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bs WHERE score > 0 QUALIFY rank <= DEPTH)"""
_TFIDF_AT = f"""td AS (SELECT doc_id AS chunk_id, unnest({_TOKENS}) AS term FROM documents), tt AS (SELECT chunk_id, term, count(*) AS tf FROM td WHERE length(term) >= 2 AND term NOT IN ({_STOP}) GROUP BY ALL),
  ti AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM tt GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 10000),
  tv AS (SELECT chunk_id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY chunk_id)) AS w FROM tt JOIN ti USING (term)),
  qd AS (SELECT item_id AS query_id, unnest({_TOKENS}) AS term FROM benchmark), qt AS (SELECT query_id, term, count(*) AS tf FROM qd WHERE length(term) >= 2 AND term NOT IN ({_STOP}) GROUP BY ALL),
  qv AS (SELECT query_id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY query_id)) AS w FROM qt JOIN ti USING (term)),
  ts AS (SELECT query_id, chunk_id, round(sum(tv.w * qv.w), 6) AS score FROM tv JOIN qv USING (term) GROUP BY ALL),
  sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ts WHERE score > 0 QUALIFY rank <= DEPTH)"""
_DENSE_AT = """ev AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), ds AS (SELECT a.vec_id // 20 AS query_id, b.vec_id AS chunk_id, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM ev a, ev b WHERE a.vec_id % 20 = 0),
  dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ds WHERE score > 0 QUALIFY rank <= DEPTH)"""
_BM25, _TFIDF, _DENSE = (x.replace("DEPTH", str(K)) for x in (_BM25_AT, _TFIDF_AT, _DENSE_AT))


def _norm(k: str) -> str:
    low, high = f"min({k}) OVER (PARTITION BY query_id)", f"max({k}) OVER (PARTITION BY query_id)"
    x = f"coalesce({k}, 0)"
    return f"CASE WHEN {high} IS NULL OR {high} = 0 THEN 0 WHEN {high} = {low} THEN CASE WHEN {x} > 0 THEN 1 ELSE 0 END ELSE ({x} - {low}) / ({high} - {low}) END AS {k}"


_FUSE = f"""{_DENSE}, {_TFIDF}, {_BM25}, un AS (SELECT query_id, chunk_id, score AS d, NULL::DOUBLE AS s, NULL::DOUBLE AS b FROM dense UNION ALL SELECT query_id, chunk_id, NULL, score, NULL FROM sparse UNION ALL SELECT query_id, chunk_id, NULL, NULL, score FROM bm25),
  mg AS (SELECT query_id, chunk_id, max(d) AS d, max(s) AS s, max(b) AS b FROM un GROUP BY ALL), nm AS (SELECT query_id, chunk_id, {_norm("d")}, {_norm("s")}, {_norm("b")} FROM mg),
  fs AS (SELECT *, (0.5 * d + 0.5 * s) * 0.8 + b * 0.2 AS score, least(1, greatest(0, (d + s + b) / 3 * 0.7 + (1 - abs(d - s)) * 0.3)) AS confidence FROM nm),
  fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM fs QUALIFY rank <= 10)"""
_SENT = rf"""st AS (SELECT doc_id AS answer_id, text, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS l FROM ({LEGAL})),
  se AS (SELECT answer_id, text, (generate_subscripts(l, 1) - 1)::INT AS sentence_index, unnest(l) AS claim FROM st),
  cl AS (SELECT answer_id, sentence_index, claim, (instr(text, claim) - 1)::INT AS start, (instr(text, claim) - 1 + length(claim))::INT AS end_,
    CASE {" ".join(f"WHEN regexp_matches(lower(claim), '{p}') THEN '{k}'" for k, p in fx.CLAIM_TYPES)} ELSE 'descriptive' END AS claim_type FROM se
    WHERE len(list_filter(regexp_split_to_array(claim, '\s+'), lambda x: x <> '')) >= 5 AND regexp_matches(lower(claim), '{fx.FACTUAL}'))"""


def _words(c: str) -> str:
    return rf"list_distinct(list_filter(regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{M}}\p{{N}}_]+'), lambda x: x <> ''))"


_RESULTS = f"""{_SENT}, evd AS ({_EVIDENCE}), jn AS (SELECT c.*, e.evidence_id, CASE WHEN e.evidence_id IS NOT NULL THEN round(len(list_intersect({_words("claim")}, {_words("e.text")})) / len(list_distinct(list_concat({_words("claim")}, {_words("e.text")}))), 6) END AS sim
    FROM cl c LEFT JOIN evd e USING (answer_id)),
  be AS (SELECT answer_id, sentence_index, claim, start, end_, arg_max(evidence_id, (sim, -evidence_id)) AS best, max(sim) AS similarity, min(evidence_id) AS first FROM jn GROUP BY ALL),
  rs AS (SELECT answer_id, sentence_index, claim, start, end_, CASE WHEN similarity > 0.3 THEN best ELSE first END AS evidence_id,
    CASE WHEN similarity IS NULL THEN 'uncertain' WHEN similarity >= 0.5 THEN 'supported' WHEN similarity < 0.1 THEN 'refuted' ELSE 'uncertain' END AS label, coalesce(similarity, 0.3)::DOUBLE AS confidence FROM be)"""


def _summary_sql(threshold: float) -> str:
    return f"""{_RESULTS}, gr AS (SELECT answer_id, count(*) AS n, count_if(label = 'supported') AS s, count_if(label = 'refuted') AS r, count_if(label = 'uncertain') AS u, avg(confidence) AS c FROM rs GROUP BY 1),
  sm AS (SELECT t.answer_id, coalesce(n, 0)::BIGINT AS total_claims, coalesce(s, 0)::BIGINT AS supported_claims, coalesce(r, 0)::BIGINT AS refuted_claims, coalesce(u, 0)::BIGINT AS uncertain_claims, coalesce(c, 0)::DOUBLE AS average_confidence,
    coalesce(n, 0) = 0 OR r > 0 OR u / n > 0.5 OR coalesce(c, 0) < {threshold} AS refusal_recommended FROM st t LEFT JOIN gr USING (answer_id))"""


_ORDER = f"WITH s AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY pos) AS number FROM ({SPANS}))"


def _rel(depth: int) -> str:
    return _DENSE_AT.replace("DEPTH", str(depth)) + ", rk AS (SELECT query_id, chunk_id, score, CASE WHEN a.label = b.label THEN 1.0 ELSE 0.0 END AS rel FROM dense JOIN ev a ON a.vec_id = chunk_id JOIN ev b ON b.vec_id = query_id * 20)"


_CENTRE = "(y1 + y2) / 2, (x1 + x2) / 2, elem_id"
_KIND = rf"""bx AS ({_BOXES.replace("TABLE", "lineitem")}), kd AS (SELECT *, CASE WHEN trim(text) = '' THEN 'empty' WHEN y2 - y1 > 1.5 * avg(y2 - y1) OVER (PARTITION BY page) THEN 'heading' WHEN length(text) < 50 AND upper(text) = text AND regexp_matches(text, '\p{{Lu}}') THEN 'title'
    WHEN regexp_matches(text, '^[0-9]+\.') THEN 'numbered_item' WHEN regexp_matches(text, '(?i)^\s*TABLE\s*[0-9]*') THEN 'table_header' WHEN len(regexp_extract_all(text, '\s{{2,}}')) >= 2 THEN 'table_cell' WHEN x2 - x1 < 100 AND length(text) < 20 THEN 'label' ELSE 'paragraph' END AS kind FROM bx)"""

_FOLDED = f"WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY pos) AS number, {_words('text')} AS w FROM ({SPANS}))"


def _overlap_sql(a: str, b: str) -> str:
    return f"CASE WHEN least(len({a}), len({b})) > 0 THEN len(list_intersect({a}, {b})) / least(len({a}), len({b})) ELSE 0 END"


_GROUPS = f"""{_FOLDED}, g AS (SELECT document_id, number, span_id, 0 AS grp, [w] AS seeds FROM s WHERE number = 1
    UNION ALL SELECT document_id, number, span_id, CASE WHEN place > 0 THEN place - 1 ELSE len(seeds) END::INT, CASE WHEN place > 0 THEN seeds ELSE list_append(seeds, w) END
    FROM (SELECT s.document_id, s.number, s.span_id, s.w, g.seeds, coalesce(list_position(list_transform(g.seeds, lambda x: {_overlap_sql("x", "s.w")} > 0.7), TRUE), 0) AS place
      FROM g JOIN s ON s.document_id = g.document_id AND s.number = g.number + 1))"""
_JOINED = "list_reduce({l}, lambda a, x: CASE WHEN regexp_matches(a, '[.!?,;]$') THEN a || ' ' || x ELSE a || '. ' || x END)"

_MIXED = r"""array_to_string(list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''), lambda x, i: CASE WHEN (i - 1) % 3 = 0 THEN CASE lower(x) """ + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tx.CODE_MIX.items()) + " ELSE x END ELSE x END), ' ')"


def _like_sql(text: str) -> str:
    return f"avg(round(len(list_intersect({_words(text)}, f.w)) / len(list_distinct(list_concat({_words(text)}, f.w))), 6))"


_METRICS = f"""WITH {_rel(K)}, lb AS ({_LABELLED}), iv AS ({INTERVALS}), sp AS ({SPANS}), lg AS (SELECT text, {_MIXED} AS mixed FROM ({LEGAL})),
  nr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, chunk_id) AS i FROM rk),
  nd AS (SELECT query_id, round(CASE WHEN min(rel) = max(rel) THEN 1 ELSE sum(rel / log2(r + 1)) / sum(rel / log2(i + 1)) END, 6) AS ndcg FROM nr GROUP BY 1),
  pp AS (SELECT DISTINCT document_id, start, "end" FROM iv WHERE page_num < 4), tt AS (SELECT DISTINCT document_id, start, "end" FROM iv WHERE page_num > 1),
  lt AS (SELECT value, row_number() OVER (ORDER BY value) AS i, count(*) OVER () AS n FROM events),
  eb AS (SELECT floor(confidence * 10) AS bin, count(*) AS n, avg(confidence) AS c, avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS a FROM lb WHERE confidence < 1 GROUP BY 1), f AS (SELECT {_words(f"'{_FORCE}'")} AS w),
  m AS (SELECT (SELECT least(1, greatest(0, 0.7 * avg(CASE WHEN label = 'supported' THEN 1.0 ELSE 0.0 END) + 0.3 * avg(CASE WHEN label = 'supported' THEN confidence ELSE 0.0 END))) FROM lb) AS faithfulness, (SELECT avg(CASE WHEN label = 'refuted' THEN 1.0 ELSE 0.0 END) FROM lb) AS contradiction_rate, (SELECT avg((label = 'supported')::INT) FROM lb) AS supported_ratio, (SELECT avg((label = 'uncertain')::INT) FROM lb) AS uncertain_ratio,
    (SELECT count(*) FROM pp JOIN tt USING (document_id, start, "end")) / (SELECT count(*) FROM pp) AS span_precision, (SELECT count(*) FROM pp JOIN tt USING (document_id, start, "end")) / (SELECT count(*) FROM tt) AS span_recall, (SELECT avg(value) FROM events) AS latency_mean,
    (SELECT avg(ndcg) FROM nd) AS ndcg, (SELECT 2 * (SELECT count(*) FROM pp JOIN tt USING (document_id, start, "end")) / ((SELECT count(*) FROM pp) + (SELECT count(*) FROM tt))) AS span_f1,
    (SELECT min(value) FILTER (i >= greatest(1, floor(n * 0.95))) FROM lt) AS p95_latency,
    (SELECT avg(CASE WHEN (effective_date IS NULL OR TIMESTAMP '{AS_OF}' >= effective_date) AND (expiry_date IS NULL OR TIMESTAMP '{AS_OF}' <= expiry_date) AND (repeal_date IS NULL OR TIMESTAMP '{AS_OF}' <= repeal_date) THEN 1.0 ELSE 0.0 END) FROM sp) AS temporal_accuracy,
    (SELECT greatest(0, {_like_sql("text")} - {_like_sql("mixed")}) FROM lg, f) AS robustness_drop, (SELECT sum(abs(c - a) * n) / (SELECT count(*) FROM lb) FROM eb) AS ece)"""

# the isotonic fit as the highest of the least means: over all starts up to a score, of the ends from it on
_ISOTONIC = f"""WITH l AS ({_LABELLED}), s AS (SELECT confidence AS x, count(*) AS w, sum(CASE WHEN correct THEN 1 ELSE 0 END) AS y FROM l GROUP BY 1), k AS (SELECT x, w, row_number() OVER (ORDER BY x) AS i, sum(w) OVER (ORDER BY x) AS sw, sum(y) OVER (ORDER BY x) AS sy, w AS w1, y AS y1 FROM s),
  m AS (SELECT c.i, a.i AS start, min((b.sy - a.sy + a.y1) / (b.sw - a.sw + a.w1)) AS low FROM k c JOIN k a ON a.i <= c.i JOIN k b ON b.i >= c.i GROUP BY ALL),
  f AS (SELECT i, max(low) AS fitted FROM m GROUP BY 1), b AS (SELECT min(x) AS lo, max(x) AS hi, sum(w) AS n, fitted FROM k JOIN f USING (i) GROUP BY fitted)"""

ORACLE = {
    "filter_claims": rf"""WITH {_RESULTS}, ct AS (SELECT DISTINCT answer_id, start, end_ FROM rs WHERE label = 'refuted' OR label = 'uncertain' AND confidence < 0.5),
        pr AS (SELECT answer_id, start, coalesce(lag(end_) OVER (PARTITION BY answer_id ORDER BY start), 0) AS before, end_ FROM ct),
        kp AS (SELECT answer_id, string_agg(substr(text, before + 1, start - before), '' ORDER BY start) AS head, max(end_) AS last FROM pr JOIN st USING (answer_id) GROUP BY 1)
        SELECT answer_id, trim(regexp_replace(coalesce(head, '') || substr(text, coalesce(last, 0) + 1), '\s+', ' ', 'g')) AS text FROM st LEFT JOIN kp USING (answer_id)""",
    "conflict_groups": f'{_GROUPS} SELECT document_id AS query_id, span_id, grp AS "group" FROM g',
    "group_winners": f"""{_GROUPS} SELECT document_id AS query_id, span_id, grp AS "group" FROM g JOIN s USING (document_id, number, span_id)
        QUALIFY row_number() OVER (PARTITION BY document_id, grp ORDER BY precedence_weight DESC, effective_date DESC NULLS LAST, pos) = 1""",
    "dedup_decode": f"""{_FOLDED}, z AS (SELECT document_id, 0::BIGINT AS number, []::VARCHAR[] AS parts, []::VARCHAR[][] AS sets, 0::BIGINT AS n, FALSE AS is_full FROM s WHERE number = 1
        UNION ALL SELECT document_id, number, CASE WHEN take THEN list_append(parts, t) ELSE parts END, CASE WHEN take THEN list_append(sets, w) ELSE sets END, CASE WHEN take THEN n + length(t) + 1 ELSE n END, stop
        FROM (SELECT *, NOT stop AND t <> '' AND len(list_filter(sets, lambda x: {_overlap_sql("x", "w")} > 0.8)) = 0 AS take
          FROM (SELECT s.document_id, s.number, trim(s.text) AS t, s.w, z.parts, z.sets, z.n, z.is_full OR z.n + length(trim(s.text)) + 1 > 1024 AS stop FROM z JOIN s ON s.document_id = z.document_id AND s.number = z.number + 1)))
        SELECT document_id AS query_id, CASE WHEN len(parts) = 0 THEN '' ELSE {_JOINED.format(l="parts")} END AS answer, len(parts)::INT AS parts FROM z QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY number DESC) = 1""",
    "layout_columns": f"""WITH RECURSIVE bx AS ({_BOXES.replace("TABLE", "lineitem")}), o AS (SELECT page, elem_id, (x1 + x2) / 2 AS x, row_number() OVER (PARTITION BY page ORDER BY (x1 + x2) / 2, elem_id) AS number FROM bx),
        c AS (SELECT page, number, elem_id, x AS seed, 0 AS n FROM o WHERE number = 1
          UNION ALL SELECT o.page, o.number, o.elem_id, CASE WHEN abs(o.x - c.seed) > 50 THEN o.x ELSE c.seed END, CASE WHEN abs(o.x - c.seed) > 50 THEN c.n + 1 ELSE c.n END FROM c JOIN o ON o.page = c.page AND o.number = c.number + 1)
        SELECT page, elem_id, n AS "column" FROM c""",
    "bm25_topk": f"WITH {_BM25} SELECT query_id, chunk_id, score FROM bm25",
    "tfidf_topk": f"WITH {_TFIDF} SELECT query_id, chunk_id, score FROM sparse",
    "bm25_blocks": f"WITH {_BM25} SELECT query_id, chunk_id, score FROM bm25",
    "tfidf_blocks": f"WITH {_TFIDF} SELECT query_id, chunk_id, score FROM sparse",
    "dense_topk": f"WITH {_DENSE} SELECT query_id, chunk_id, score, rank FROM dense",
    "hybrid_fuse": f"WITH {_FUSE} SELECT query_id, chunk_id, round(d, 5) AS dense, round(s, 5) AS sparse, round(b, 5) AS bm25, round(score, 5) AS score, round(confidence, 5) AS confidence FROM fused",
    "rrf_fuse": f"""WITH {", ".join(x.replace("DEPTH", str(2 * K)) for x in (_DENSE_AT, _TFIDF_AT, _BM25_AT))}, un AS (SELECT query_id, chunk_id, 1 / (60 + rank) AS x FROM dense UNION ALL SELECT query_id, chunk_id, 1 / (60 + rank) FROM sparse UNION ALL SELECT query_id, chunk_id, 1 / (60 + rank) FROM bm25),
        sc AS (SELECT query_id, chunk_id, sum(x) AS score FROM un GROUP BY ALL) SELECT query_id, chunk_id, round(score, 6) AS score FROM sc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) <= 10""",
    "filter_lang_conf": f"WITH {_FUSE} SELECT query_id, chunk_id FROM fused JOIN documents ON doc_id = chunk_id WHERE confidence >= 0.2 AND lang IN ('de', 'fr')",
    "rerank": f"WITH {_BM25} SELECT query_id, chunk_id, round(score * 0.7 + 0.3 / rank, 8) AS score FROM bm25",
    "index_stats": f"WITH {_BM25} SELECT (SELECT count(*) FROM docs) AS chunks, (SELECT count(*) FROM df) AS terms, (SELECT count(*) FROM tf) AS postings",
    "claims": f"WITH {_SENT} SELECT * FROM cl",
    "verify_claims": f"WITH {_RESULTS} SELECT answer_id, sentence_index, evidence_id, label, round(confidence, 6) AS confidence FROM rs",
    "verify_summary": f"WITH {_summary_sql(0.8)} SELECT * REPLACE (round(average_confidence, 6) AS average_confidence) FROM sm",
    "citations": f"""{_ORDER} SELECT document_id AS query_id, span_id, number, '[' || number || '] Order, Page 1, Bytes ' || (pos * 10) || '-' || (pos * 10 + length(text)) || ' (Confidence: ' || printf('%.2f', precedence_weight / 10) || ')' AS citation FROM s""",
    "sentence_citations": f"""{_ORDER}, a AS (SELECT document_id, max(text) AS t1, min(text) AS t2 FROM s GROUP BY 1), z AS (SELECT document_id, 0 AS i, t1 || '.' AS x FROM a UNION ALL SELECT document_id, 1, t2 FROM a),
        u AS (SELECT z.document_id, i, number, len(list_intersect({_words("x")}, {_words("s.text")})) >= least(3.0, 0.3 * len({_words("x")})) AS hit FROM z JOIN s USING (document_id))
        SELECT document_id AS query_id, i AS sentence_index, coalesce(string_agg(number::VARCHAR, ',' ORDER BY number) FILTER (hit), '') AS numbers FROM u GROUP BY ALL""",
    "refusal": rf"""WITH {_summary_sql(0.4)}, rf AS (SELECT sm.answer_id, CASE WHEN refusal_recommended THEN 'verification' WHEN average_confidence < 0.3 THEN 'low_confidence' WHEN refuted_claims > 0 THEN 'refuted_claims' WHEN sm.answer_id % 4 < 2 THEN 'insufficient_evidence'
          WHEN trim(text) = '' THEN 'empty_answer' WHEN len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) < 5 THEN 'too_short' END AS code FROM sm JOIN st USING (answer_id))
        SELECT answer_id, code AS refusal_code, 'I cannot provide a reliable answer due to: ' || replace(code, '_', ' ') || '. Please try rephrasing your question.' AS message FROM rf""",
    "evidence_rows": f"WITH s AS ({SPANS}) SELECT query_id, span_id, CASE WHEN span_id % 3 = 0 THEN 'supported' ELSE 'uncertain' END AS label, CASE WHEN span_id % 3 = 0 THEN precedence_weight / 10 ELSE 0.0 END AS confidence FROM s",
    "suppress_refuted": f"WITH s AS ({SPANS}) SELECT query_id, span_id FROM s WHERE span_id % 4 <> 0",
    "evidence_diff": f"""WITH s AS ({SPANS}), o AS ({_kept(f"TIMESTAMP '{EARLIER}'")}), n AS ({_kept(f"TIMESTAMP '{AS_OF}'")}), b AS (SELECT coalesce(o.query_id, n.query_id) AS query_id, coalesce(o.span_id, n.span_id) AS id, o.span_id IS NOT NULL AS io, n.span_id IS NOT NULL AS inn FROM o FULL JOIN n ON o.query_id = n.query_id AND o.span_id = n.span_id)
        SELECT query_id, coalesce(string_agg(id::VARCHAR, ',' ORDER BY id) FILTER (NOT io), '') AS added, coalesce(string_agg(id::VARCHAR, ',' ORDER BY id) FILTER (NOT inn), '') AS removed, coalesce(string_agg(id::VARCHAR, ',' ORDER BY id) FILTER (io AND inn), '') AS retained FROM b GROUP BY 1""",
    "faithfulness": f"""SELECT round(least(1, greatest(0, 0.7 * avg(CASE WHEN label = 'supported' THEN 1.0 ELSE 0.0 END) + 0.3 * avg(CASE WHEN label = 'supported' THEN confidence ELSE 0.0 END))), 6) AS faithfulness,
        round(avg(CASE WHEN label = 'refuted' THEN 1.0 ELSE 0.0 END), 6) AS contradiction_rate FROM ({_LABELLED})""",
    "ndcg10": f"""WITH {_rel(K)}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, chunk_id) AS i FROM rk)
        SELECT query_id, round(CASE WHEN min(rel) = max(rel) THEN 1 ELSE sum(rel / log2(r + 1)) / sum(rel / log2(i + 1)) END, 6) AS ndcg FROM r GROUP BY 1""",
    "span_f1": f"""WITH i AS ({INTERVALS}), p AS (SELECT DISTINCT document_id, start, "end" FROM i WHERE page_num < 4), t AS (SELECT DISTINCT document_id, start, "end" FROM i WHERE page_num > 1), h AS (SELECT (SELECT count(*) FROM p) AS p, (SELECT count(*) FROM t) AS t, (SELECT count(*) FROM p JOIN t USING (document_id, start, "end")) AS h)
        SELECT round(h / p, 6) AS precision, round(h / t, 6) AS recall, round(2 * h / (p + t), 6) AS f1 FROM h""",
    "latency_stats": """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
        SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, round(median(value), 4) AS median, round(min(value) FILTER (i >= greatest(1, floor(n * 0.95))), 4) AS p95, round(min(value) FILTER (i >= greatest(1, floor(n * 0.99))), 4) AS p99, round(stddev_pop(value), 4) AS std FROM r GROUP BY 1""",
    "temporal_accuracy": f"""WITH s AS ({SPANS}) SELECT query_id, round(avg(CASE WHEN (effective_date IS NULL OR TIMESTAMP '{AS_OF}' >= effective_date) AND (expiry_date IS NULL OR TIMESTAMP '{AS_OF}' <= expiry_date) AND (repeal_date IS NULL OR TIMESTAMP '{AS_OF}' <= repeal_date) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM s GROUP BY 1""",
    "ece": f"WITH l AS ({_LABELLED}), b AS (SELECT floor(confidence * 10) AS bin, count(*) AS n, avg(confidence) AS c, avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS a FROM l WHERE confidence < 1 GROUP BY 1) SELECT round(sum(abs(c - a) * n) / (SELECT count(*) FROM l), 6) AS ece FROM b",
    "evaluation": f"{_METRICS} SELECT * REPLACE ({', '.join(f'round({c}, 4) AS {c}' for c in _METRIC_NAMES)}) FROM m",
    "targets": f"""{_METRICS} SELECT faithfulness >= 0.95 AS meets_faithfulness, contradiction_rate <= 0.02 AS meets_contradiction_rate, ndcg >= 0.85 AS meets_ndcg, p95_latency <= 3.0 AS meets_p95_latency,
        temporal_accuracy >= 0.98 AS meets_temporal_accuracy, robustness_drop <= 0.05 AS meets_robustness_drop, ece <= 0.10 AS meets_ece FROM m""",
    "hard_negatives": f"WITH {_rel(DEPTH)} SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS n FROM rk WHERE rel = 0 QUALIFY n <= 10",
    "retrieval_metrics": f"""WITH {_rel(DEPTH)}, t AS (SELECT a.vec_id // 20 AS query_id, count(*) AS total FROM ev a JOIN ev b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM rk),
        h AS (SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) / rank AS p FROM r WHERE rel = 1 AND query_id * 20 <> chunk_id)
        SELECT query_id, round(count(p) FILTER (rank <= 10) / total, 6) AS recall_at_10, round(count(p) / total, 6) AS recall_at_100, round(coalesce(sum(p) FILTER (rank <= 10), 0) / least(total, 10), 6) AS map, round(coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= 10), 0) / list_sum(list_transform(range(1, least(total, 10)::BIGINT + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM t LEFT JOIN h USING (query_id) GROUP BY query_id, total""",
    "train_pairs": """WITH q AS (SELECT o_custkey AS question, o_orderkey % 1200 AS chunk_id, 1.0 AS label FROM orders UNION ALL SELECT o_custkey, unnest([1, 2, o_orderkey % 1300, 4, 5]), 0.0 FROM orders)
        SELECT question, chunk_id, label::DOUBLE AS label, count(*) AS n FROM q JOIN documents ON doc_id = chunk_id GROUP BY ALL""",
    "nli_triples": f"""WITH {_SENT}, f AS (SELECT answer_id, sentence_index, claim, lower(claim) AS low FROM cl QUALIFY row_number() OVER (PARTITION BY answer_id ORDER BY sentence_index) <= 3)
        SELECT answer_id, sentence_index, claim AS hypothesis, 'entailment' AS label FROM f
        UNION ALL SELECT answer_id, sentence_index, CASE WHEN contains(low, 'shall') THEN replace(low, 'shall', 'shall not') WHEN contains(low, 'must') THEN replace(low, 'must', 'must not') WHEN contains(low, 'is') THEN replace(low, 'is', 'is not') WHEN contains(low, 'are') THEN replace(low, 'are', 'are not') ELSE 'It is not true that ' || low END, 'contradiction' FROM f
        UNION ALL SELECT answer_id, sentence_index, CASE length(claim) % 5 WHEN 0 THEN replace(claim, '10%', '15%') WHEN 1 THEN replace(claim, 'shall', 'may') WHEN 2 THEN replace(claim, 'must', 'should') WHEN 3 THEN replace(claim, 'all', 'some') ELSE replace(claim, 'every', 'any') END, 'neutral' FROM f""",
    "confusion": f"SELECT truth AS label, count_if(predicted = '0')::BIGINT AS predicted_0, count_if(predicted = '1')::BIGINT AS predicted_1 FROM ({_LABELLED}) GROUP BY 1",
    "class_scores": f"""WITH l AS ({_LABELLED}), c AS (SELECT v.c, (SELECT count(*) FROM l WHERE truth = v.c) AS s, (SELECT count(*) FROM l WHERE predicted = v.c) AS g, (SELECT count(*) FROM l WHERE truth = v.c AND predicted = v.c) AS h FROM (VALUES ('0'), ('1')) v(c))
        SELECT round(sum(h) / sum(s), 6) AS accuracy, round(sum(h / g * s) / sum(s), 6) AS precision, round(sum(h / s * s) / sum(s), 6) AS recall, round(sum(2 * (h / g) * (h / s) / (h / g + h / s) * s) / sum(s), 6) AS f1 FROM c""",
    "isotonic_fit": f"{_ISOTONIC} SELECT lo, hi, n::BIGINT AS n, round(fitted, 6) AS fitted FROM b",
    "isotonic_ece": f"""{_ISOTONIC}, p AS (SELECT lo AS x, fitted AS y FROM b UNION SELECT hi, fitted FROM b), v AS (SELECT l.confidence AS before, b.fitted AS after, CASE WHEN l.correct THEN 1.0 ELSE 0.0 END AS ok FROM l JOIN b ON l.confidence BETWEEN b.lo AND b.hi),
        g AS (SELECT 'b' AS side, floor(before * 10) AS bin, count(*) AS n, abs(avg(before) - avg(ok)) AS gap FROM v WHERE before < 1 GROUP BY ALL UNION ALL SELECT 'a', floor(after * 10), count(*), abs(avg(after) - avg(ok)) FROM v WHERE after < 1 GROUP BY ALL)
        SELECT round(coalesce(sum(gap * n) FILTER (side = 'b'), 0) / (SELECT count(*) FROM v), 6) AS ece_before, round(coalesce(sum(gap * n) FILTER (side = 'a'), 0) / (SELECT count(*) FROM v), 6) AS ece_after FROM g""",
    "ordered_split": f"SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY confidence, doc_id) <= floor(count(*) OVER () * 0.8) THEN 'train' ELSE 'test' END AS part FROM ({_LABELLED})",
    "iou": f"""WITH bx AS ({_BOXES.replace("TABLE", "lineitem")}), p AS (SELECT a.elem_id AS a_elem_id, b.elem_id AS b_elem_id, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS t
        FROM bx a JOIN bx b ON a.page = b.page AND a.elem_id < b.elem_id) SELECT a_elem_id, b_elem_id, round(i / (t - i), 6) AS iou FROM p""",
    "layout_kinds": f"WITH {_KIND} SELECT elem_id, kind FROM kd",
    "reading_order": f"WITH {_KIND} SELECT elem_id, row_number() OVER (PARTITION BY page ORDER BY {_CENTRE}) - 1 AS reading_order FROM kd",
    "bbox": f"SELECT elem_id, x1, y1, x2, y2 FROM ({_BOXES.replace('TABLE', 'lineitem')})",
    "layout_elements": f"""WITH {_KIND}, o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY {_CENTRE}) - 1 AS position FROM kd)
        SELECT page, CASE kind WHEN 'heading' THEN 'headings' WHEN 'numbered_item' THEN 'sections' WHEN 'paragraph' THEN 'paragraphs' ELSE 'tables' END AS "group", position, text, x1, y2 FROM o WHERE kind IN ('heading', 'numbered_item', 'table_header', 'table_cell', 'paragraph')""",
    "nli_labels": """WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity / 10 AS a, l_discount * 30 AS b, l_tax * 40 AS c FROM lineitem)
        SELECT l_orderkey, l_linenumber, CASE WHEN a >= b AND a >= c THEN 'supported' WHEN b >= c THEN 'uncertain' ELSE 'refuted' END AS label, round(exp(greatest(a, b, c)) / (exp(a) + exp(b) + exp(c)), 6) AS confidence FROM x""",
    "claim_report": f"WITH {_RESULTS} SELECT rs.answer_id, claim, CASE WHEN length(evd.text) > 200 THEN left(evd.text, 200) || '...' ELSE evd.text END AS evidence, label, round(confidence, 6) AS confidence FROM rs LEFT JOIN evd USING (answer_id, evidence_id)",
    "provenance": f"SELECT doc_id || '_0' AS chunk_id, doc_id::VARCHAR AS document_id, 0 AS byte_start, strlen(text)::INT AS byte_end, 'paragraph' AS section_type, round(length(text) / 100, 6) AS score FROM ({LEGAL})",
    "layout_structure": f"""WITH {_KIND}, o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY {_CENTRE}) AS r FROM kd)
        SELECT page, arg_min(text, r) FILTER (kind = 'title') AS title, count_if(kind = 'heading')::BIGINT AS headings, count_if(kind = 'numbered_item')::BIGINT AS sections, count_if(kind IN ('table_header', 'table_cell'))::BIGINT AS tables, count_if(kind = 'paragraph')::BIGINT AS paragraphs FROM o GROUP BY 1""",
}
