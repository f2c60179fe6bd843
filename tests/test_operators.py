"""Hand-computed rows for ordered folds, edge cases and sources."""

import random

import pytest
from pyspark.sql import functions as F

from chronolex.config import EngineConfig
from chronolex.functions import text as tx
from chronolex.operators import answer, claims, conflicts, layout, metrics, retrieve, segment, spans, temporal, training
from chronolex.sources import corpus


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "want"), [("This rule is invalid", "active"), ("The order was repealed", "repealed"), ("It is suspended", "suspended"), ("It was amended", "amended"), ("", "active")])
def test_status(spark, text, want):
    assert one(spark, temporal.status(F.col("t")), t=text) == want


@pytest.mark.parametrize(("text", "want"), [("w.e.f. 25/12/2023", "2023-12-25"), ("effective from January 1, 2023", None), ("comes into force on the 3 May 2020", "2020-05-03"), ("with effect from 12/31/2020", "2020-12-31"), ("effective 99/99/2020", None)])
def test_effective_date(spark, text, want):
    found = temporal.with_temporal_metadata(spark.createDataFrame([(text,)], "text string")).first()["effective_date"]
    assert (found and found.strftime("%Y-%m-%d")) == want


@pytest.mark.parametrize(("text", "want"), [("नियम rule", "hi"), ("123", "unknown"), ("plain", "en")])
def test_language(spark, text, want):
    assert one(spark, tx.detect_language(F.col("t")), t=text) == want


def test_dates_keep_shape_order_and_offsets(spark):
    found = one(spark, tx.dates_in(F.col("t")), t="on 3 May 2020, 1/2/2021 and 1/2/2021 or May 4, 2022")
    assert [(d["text"], d["start"], d["end"]) for d in found] == [("1/2/2021", 15, 23), ("1/2/2021", 28, 36), ("3 May 2020", 3, 13), ("May 4, 2022", 40, 51)]


def test_text_folds(spark):
    assert one(spark, tx.merge_fragments(F.col("p")), p=["inter-", "nal", "Rule-", "Two", "x"]) == ["internal", "Rule-", "Two", "x"]
    assert one(spark, tx.join_coherently(F.col("p")), p=["a.", "b", "c,", "d"]) == "a. b. c, d"
    assert one(spark, tx.code_mixed(F.col("t")), t="Bank has rule account") == "बैंक has rule खाता"
    assert one(spark, tx.normalize_unicode(F.col("t")), t="ﬁ​  x") == "fi x"
    assert one(spark, tx.dehyphenate(F.col("t")), t="inter-\n national re- port") == "international report"


def chunk_runs(sections, size):
    """The rule of hierarchical chunks, section by section."""
    out, buffer, level = [], [], 0
    for pos, lv, n in sections:
        if buffer and lv <= level:
            out.append((buffer[0][0], buffer[-1][0]))
            buffer = []
        buffer.append((pos, n))
        if len(buffer) > 1 and sum(b for _, b in buffer) + len(buffer) - 1 > size:
            out.append((buffer[0][0], pos))
            buffer = [(pos, n)]
        level = lv
    if buffer:
        out.append((buffer[0][0], buffer[-1][0]))
    return out


def test_hierarchical_chunks(spark):
    rng = random.Random(1)
    docs = {d: [(p, rng.randint(0, 3), rng.randint(1, 300)) for p in range(1, rng.randint(2, 12))] for d in range(20)}
    rows = spark.createDataFrame([(d, p, lv, "x" * n) for d, s in docs.items() for p, lv, n in s], "document_id int, pos int, level int, text string")
    found = {}
    for r in segment.hierarchical_chunks(rows, 400).orderBy("document_id", "chunk_no").collect():
        found.setdefault(r["document_id"], []).append((r["first_pos"], r["last_pos"]))
    assert found == {d: chunk_runs(s, 400) for d, s in docs.items()}


def test_sliding_windows_of_any_script(spark):
    text = "नियम " * 300 + "end"
    raw, want = text.encode(), []
    for start in range(0, len(raw), 448):
        piece = raw[start : start + 512].decode(errors="ignore")
        if start + 512 < len(raw) and piece.rfind(" ") > 256:
            piece = piece[: piece.rfind(" ")]
        want += [piece.strip()] * bool(piece.strip())
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "document_id int, text string")
    assert [r["text"] for r in segment.sliding_windows(df).orderBy("window").collect()] == want


def test_greedy_groups_and_decoding(spark):
    rows = [(1, 1, 11, "the cat sat"), (1, 2, 12, "the cat sat"), (1, 3, 13, "dog"), (1, 4, 14, "x" * 2000), (1, 5, 15, "late"), (2, 1, 21, "")]
    df = spark.createDataFrame(rows, "query_id int, pos int, span_id int, text string")
    assert [r["group"] for r in answer.conflict_groups(df).orderBy("span_id").collect()] == [0, 0, 1, 2, 3, 0]
    assert {r["query_id"]: r["answer"] for r in answer.decode(df).collect()} == {1: "the cat sat. dog", 2: ""}


def test_columns_follow_the_seed(spark):
    rows = [(1, i, x, 0.0, x, 1.0) for i, x in enumerate([0.0, 40.0, 60.0, 100.0, 200.0])]
    df = spark.createDataFrame(rows, "page int, elem_id long, x1 double, y1 double, x2 double, y2 double")
    assert [r["column"] for r in layout.columns(df).orderBy("elem_id").collect()] == [0, 0, 1, 1, 2]


def test_fusion_of_missing_and_negative(spark):
    hits = lambda *rows: spark.createDataFrame(rows, "query_id int, chunk_id int, score double, rank int")
    fused = {r["chunk_id"]: r for r in retrieve.fuse(hits((1, 1, 2.0, 1)), hits((1, 1, 4.0, 1), (1, 2, 2.0, 2)), hits((1, 3, 3.0, 1))).collect()}
    assert set(fused) == {1, 2, 3} and (fused[3]["dense"], fused[3]["sparse"], fused[3]["bm25"]) == (0.0, -1.0, 1.0) and fused[1]["dense"] == 1.0
    one_list = hits((1, 1, 1.0, 1))
    assert abs(retrieve.reciprocal_rank(one_list, one_list, one_list).first()["score"] - 3 / 61) < 1e-12


def test_spans(spark):
    rows = [(1, 1, 0, 5, "a"), (2, 1, 5, 9, "b"), (3, 1, 8, 12, "c"), (4, 2, 0, 9000, "d"), (5, 2, 8000, 8010, "e")]
    df = spark.createDataFrame(rows, "span_id int, document_id int, start int, end int, text string")
    assert {tuple(r) for r in spans.overlapping(df, df).collect()} == {(2, 3), (3, 2), (4, 5), (5, 4)}
    full = df.withColumns({"page_num": F.lit(1), "confidence": F.lit(0.5), "section_id": F.lit("s")})
    assert sorted((r["start"], r["end"]) for r in spans.merge_adjacent(full).collect()) == [(0, 5), (0, 9000), (5, 12)]
    assert sorted((r["start"], r["end"]) for r in spans.merge_adjacent(full, 5, True).collect()) == [(0, 12), (0, 9000)]


def test_temporal_partition_and_self_conflicts(spark):
    rows = [("q", "a", "one two three", "d1", None, None, None, "active", 8.0, ["b"], None), ("q", "b", "one two three", "d2", None, None, None, "active", 4.0, [], None), ("q", "c", "zzz", "d3", None, None, None, "repealed", 1.0, [], None)]
    kinds = "query_id string, span_id string, text string, document_id string, effective_date timestamp_ntz, expiry_date timestamp_ntz, repeal_date timestamp_ntz, status string, precedence_weight double, supersedes array<string>, superseded_by string"
    df = spark.createDataFrame(rows, kinds)
    day = F.lit("2020-01-01").cast("timestamp_ntz")
    assert {r["span_id"]: r["valid"] for r in temporal.split_by_date(df, day).collect()} == {"a": True, "b": False, "c": False}
    members = conflicts.members(df)
    linked = conflicts.links(df, members)
    assert {r["span_id"] for r in conflicts.resolve(df, members, linked).collect()} == {"a", "c"} and conflicts.pair_count(df, members, linked).first()["conflicts"] == 1


def test_claims(spark):
    df = spark.createDataFrame([(1, "It shall be done by all. No. The rate is 5 of it."), (2, "")], "answer_id int, text string")
    found = claims.extract(df)
    assert [(r["claim"], r["claim_type"], r["start"]) for r in found.orderBy("sentence_index").collect()] == [("It shall be done by all.", "obligation", 0), ("The rate is 5 of it.", "quantitative", 29)]
    results = found.withColumn("label", F.when(F.col("sentence_index") == 0, "refuted").otherwise("supported")).withColumn("confidence", F.lit(0.9))
    assert {r["answer_id"]: r["text"] for r in claims.without_refuted(df, results).collect()} == {1: "No. The rate is 5 of it.", 2: ""}
    assert {r["answer_id"]: r["refusal_recommended"] for r in claims.summarise(df, results).collect()} == {1: True, 2: True}


def test_metrics_edges(spark):
    rows = spark.createDataFrame([(1.0, True), (0.95, False)], "confidence double, correct boolean")
    assert abs(metrics.ece(rows).first()["ece"] - 0.475) < 1e-9
    values = spark.createDataFrame([("k", float(v)) for v in range(1, 21)], "k string, v double")
    assert metrics.latency(values, "v", ["k"]).first()["p95"] == 19.0
    none = spark.createDataFrame([], "d int, s int")
    assert tuple(metrics.span_f1(none, none, ["d", "s"]).first()) == (1.0, 1.0, 1.0)
    grid = metrics.ablation_grid(EngineConfig())
    assert len(grid) == 11 and grid["dense_retrieval"].use_dense is False and grid["baseline"] == EngineConfig() and len(EngineConfig().fingerprint()) == 16


def test_training(spark):
    rows = spark.createDataFrame([(i,) for i in range(10)], "i int")
    assert training.ordered_split(rows, ["i"]).filter("part = 'train'").count() == 8
    raw = spark.createDataFrame([("p", "h", "SUPPORTED"), ("p", "h", "other")], "evidence string, claim string, gold_label string")
    assert [tuple(r) for r in training.nli_pairs(raw).collect()] == [("p", "h", 0)]


def test_sources(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "sub" / "a.txt").write_text("1. One\n\nsecond\fpage two")
    (tmp_path / "in" / "b.png").write_bytes(b"x")
    (tmp_path / "in" / "c.doc").write_bytes(b"x")
    files = corpus.corpus_files(spark, f"file://{tmp_path}/in")
    pages = corpus.text_pages(files)
    assert files.count() == 2 and pages.filter("error IS NULL").count() == 2 and pages.filter("error IS NOT NULL").count() == 1
    sections = segment.sections(pages.filter("error IS NULL"))
    lines = {r["suffix"]: r for r in corpus.manifest(files, sections).collect()}
    assert (lines["txt"]["num_pages"], lines["txt"]["total_sections"], lines["png"]["total_sections"]) == (2, 3, 0)
    corpus.write_report(spark.range(3), f"file://{tmp_path}/r", "json")
    assert spark.read.json(f"file://{tmp_path}/r").count() == 3
    corpus.write_report(corpus.synthetic_qa(spark), f"file://{tmp_path}/qa.jsonl")
    assert corpus.qa_dataset(spark, f"file://{tmp_path}/qa.jsonl").count() == 3
    with pytest.raises(ValueError):
        corpus.qa_dataset(spark, "qa.csv")
