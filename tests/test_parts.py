"""Chunk unions, sections of pages, labels of scores, structure lists, provenance and filters on small rows."""

import math

import pytest
from pyspark.sql import functions as F

from chronolex.operators import claims as cl
from chronolex.operators import layout as ly
from chronolex.operators import retrieve as rt
from chronolex.operators import segment as sg
from chronolex.operators import training as tr


def test_union_of_chunks_keeps_the_first_of_each_text(spark):
    texts = spark.createDataFrame([(1, "alpha beta\ngamma"), (2, "one"), (3, ""), (4, None), (5, "word " * 300)], "document_id int, text string")
    pages = texts.select("document_id", F.lit(1).alias("page_num"), F.col("text").alias("raw_text"), F.lit(1.0).alias("trust_score"))
    rows = sg.sections(pages, "\n")
    got = sg.document_chunks(rows, texts).collect()
    runs = sg.chunk_rows(sg.hierarchical_chunks(rows), rows).collect()
    windows = sg.sliding_windows(texts).collect()
    want, seen = [], set()
    for kind, part, number in ((0, runs, "chunk_no"), (1, windows, "window")):
        for r in sorted(part, key=lambda r: (r["document_id"], r[number])):
            if (r["document_id"], r["text"]) not in seen:
                seen.add((r["document_id"], r["text"]))
                want.append((r["document_id"], kind, r[number], r["text"], r["byte_start"], r["byte_end"]))
    assert sorted(map(tuple, got)) == sorted(want)
    assert {r["kind"] for r in got if r["document_id"] == 5} == {0, 1} and [r["kind"] for r in got if r["document_id"] == 2] == [0]  # its window repeats its chunk


def test_pages_with_found_sections_prefer_them(spark):
    pages = spark.createDataFrame([(1, 1, "raw one\n\nraw two", 0.5), (1, 2, "CHAPTER I\n\n\n\nlast words here", None), (1, 3, "raw three", 0.4)], "document_id int, page_num int, raw_text string, trust_score double")
    found = spark.createDataFrame([(1, 1, 0, " 1. Found it ", 7, 0.9), (1, 1, 1, "plain", None, None), (1, 3, 0, "  ", 0, 0.9)], "document_id int, page_num int, pos int, text string, byte_start int, confidence double")
    got = [tuple(r) for r in sg.page_sections(pages, found).select("pos", "page_num", "text", "section_type", "byte_start", "byte_end", "confidence", "parent").orderBy("pos").collect()]
    assert got == [(1, 1, "1. Found it", "section", 7, 18, 0.9, None), (2, 1, "plain", "paragraph", 0, 5, 0.5, None), (3, 2, "CHAPTER I", "chapter", 0, 9, 1.0, None), (4, 2, "last words here", "paragraph", 11, 26, 1.0, "CHAPTER I")]
    assert sg.page_sections(pages.limit(0), found.limit(0)).collect() == []


def test_detections(spark):
    rows = [(1, 1, 0, "HEAD", 0.9), (1, 1, 1, "low", 0.2), (1, 1, 2, "1. item", 0.7), (1, 2, 0, "Some words.", 0.8), (1, 2, 1, " ", 0.9)]
    got = {(r["page_num"], r["pos"]): (r["byte_start"], r["coarse_type"], round(r["trust_score"], 6)) for r in sg.detected(spark.createDataFrame(rows, "document_id int, page_num int, pos int, text string, confidence double")).collect()}
    assert got == {(1, 0): (0, "heading", 0.8), (1, 2): (5, "numbered_section", 0.8), (2, 0): (0, "paragraph", 0.8)}


@pytest.mark.parametrize(("scores", "label"), [([2.0, 1.0, 0.0], "supported"), ([0.0, 0.0, 0.0], "supported"), ([0.0, 3.0, 1.0], "uncertain"), ([-5.0, -4.0, 900.0], "refuted"), ([1.0, None, 2.0], None), ([1.0, 2.0], None), (None, None), ([float("nan"), 1.0, 2.0], None)])
def test_label_of_scores(spark, scores, label):
    got = spark.createDataFrame([(scores,)], "x array<double>").select(cl.label_of_scores(F.col("x")).alias("v")).first()["v"]
    if label is None:
        assert got is None
        return
    top = max(scores)
    shares = [math.exp(x - top) for x in scores]
    assert got["label"] == label and got["probabilities"] == pytest.approx([x / sum(shares) for x in shares]) and got["confidence"] == max(got["probabilities"])


def test_best_evidence_with_a_hook_and_without_evidence(spark):
    claims = spark.createDataFrame([(1, 0, "the bank shall pay"), (2, 0, "no evidence here")], "answer_id int, sentence_index int, claim string")
    evidence = spark.createDataFrame([(1, 8, "the bank shall pay"), (1, 5, "pay shall bank the"), (1, 2, "other")], "answer_id int, evidence_id int, text string")
    got = {r["answer_id"]: (r["evidence_id"], r["similarity"]) for r in cl.best_evidence(claims, evidence).collect()}
    assert got == {1: (5, 1.0), 2: (None, None)}  # equal likeness: the smaller id
    hooked = cl.best_evidence(claims, evidence, similarity=lambda a, b: F.when(b == "other", 0.9).otherwise(0.1))
    assert {r["answer_id"]: r["evidence_id"] for r in hooked.collect()} == {1: 2, 2: None}
    low = cl.best_evidence(claims, evidence, similarity=lambda a, b: F.lit(0.2))
    assert {r["answer_id"]: r["evidence_id"] for r in low.collect()} == {1: 2, 2: None}  # none above the least: the first
    results = cl.best_evidence(claims, evidence).withColumn("label", F.lit("supported")).withColumn("confidence", F.lit(1.0))
    assert {r["claim"]: r["evidence"] for r in cl.report(results, evidence).collect()} == {"the bank shall pay": "pay shall bank the", "no evidence here": None}
    assert cl.report(results, evidence.withColumn("text", F.repeat(F.lit("x"), 300))).filter("evidence IS NOT NULL").first()["evidence"] == "x" * 200 + "..."


def test_structure_lists_and_boxes(spark):
    rows = [(1, 1, "THE TITLE", 0.0, 0.0, 200.0, 10.0), (1, 2, "1. one", 0.0, 20.0, 200.0, 30.0), (1, 3, "Table 1", 0.0, 40.0, 200.0, 50.0), (1, 4, "A paragraph of the page that is long", 0.0, 60.0, 200.0, 70.0), (1, 5, "big", 0.0, 80.0, 200.0, 130.0), (2, 6, "", 0.0, 0.0, 1.0, 1.0)]
    got = {r["page"]: r for r in ly.structure_lists(ly.classified(spark.createDataFrame(rows, "page int, elem_id long, text string, x1 double, y1 double, x2 double, y2 double"))).collect()}
    assert got[1]["title"] == "THE TITLE" and [(x["position"], x["text"], x["type"]) for x in got[1]["tables"]] == [(2, "Table 1", "table_header")]
    assert [x["position"] for x in got[1]["headings"]] == [4] and tuple(got[1]["sections"][0]["bbox"]) == (0.0, 20.0, 200.0, 30.0) and len(got[1]["paragraphs"]) == 1
    assert got[2]["title"] is None and got[2]["tables"] == []
    box = spark.sql("SELECT array(named_struct('x', 3.0, 'y', 1.0), named_struct('x', 1.0, 'y', 5.0)) AS p").select(ly.bbox(F.col("p")).alias("b")).first()["b"]
    assert tuple(map(float, box)) == (1.0, 1.0, 3.0, 5.0)


def test_provenance_and_filters(spark):
    kind = "query_id int, chunk_id string, score double, confidence double, languages array<string>, section_types array<string>, spans array<struct<text:string,byte_start:int>>"
    hits = spark.createDataFrame([(1, "d7_3", 0.5, 0.9, ["en"], ["clause"], [("a", 0), ("b", 4)]), (1, "d8_0", 0.4, 0.1, None, ["note"], []), (2, "d9_0", 0.3, 0.8, ["hi"], ["note"], [("c", 2)])], kind)
    assert sorted(tuple(r) for r in rt.provenance(hits).select("query_id", "document_id", "text", "byte_start").collect()) == [(1, "d7", "a", 0), (1, "d7", "b", 4), (2, "d9", "c", 2)]
    ids = lambda **by: {r["chunk_id"] for r in rt.filtered(hits, **by).collect()}
    assert ids(min_confidence=0.5) == {"d7_3", "d9_0"} and ids(languages=["unknown", "hi"]) == {"d8_0", "d9_0"} and ids(section_types=["note"], valid=F.col("score") > 0.35) == {"d8_0"}


def test_retrieval_ndcg(spark):
    hits = spark.createDataFrame([(1, c, r) for r, c in enumerate([10, 11, 12, 13], 1)] + [(2, 5, 1)], "query_id int, chunk_id int, rank int")
    positives = spark.createDataFrame([(1, 11), (1, 13), (1, 99), (2, 5), (3, 7)], "query_id int, chunk_id int")
    got = {r["query_id"]: r["ndcg"] for r in tr.retrieval_metrics(hits, positives).collect()}
    gain = lambda *ranks: sum(1 / math.log2(r + 1) for r in ranks)
    assert got == {1: pytest.approx(gain(2, 4) / gain(1, 2, 3)), 2: 1.0, 3: 0.0}
