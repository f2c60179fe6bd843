"""How often rows are dealt anew, read from plans."""

from pyspark.sql import functions as F

from chronolex.operators import scans
from chronolex.operators import segment as sg


def dealt(df):
    """Exchanges by key in the plan."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_a_scan_deals_its_rows_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(50).selectExpr("IF(id % 7 = 0, NULL, id % 3) AS k", "id DIV 10 AS b", "id AS n", "'text' || id AS text")
        out = scans.scan(rows, ["k"], ["b"], ["n"], {"s": ("sum", F.col("n"))})
        assert dealt(out) == 4  # the rows, the buckets' totals, those by key, what they carry over
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    got, sums = sorted(map(tuple, out.select("n", "k", "s").collect())), {}
    for n, k, s in got:
        sums[k] = sums.get(k, 0) + n
        assert s == sums[k]
    assert len(got) == 50


def test_sections_are_one_scan_and_copies_go_by_digest(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pages = spark.createDataFrame([(1, 1, "TITLE\none\ntwo", 1.0), (2, 1, "a\n\nb", 1.0)], "document_id long, page_num int, raw_text string, trust_score double")
        rows = sg.sections(pages, "\n")
        assert dealt(rows) == 4  # one scan
        windows = sg.without_copies(rows.selectExpr("document_id", "0 AS kind", "pos AS chunk_no", "text"), digest=True).select("document_id", "digest")
        assert "text" not in windows._jdf.queryExecution().optimizedPlan().toString().split("Window")[1].split("\n")[1].split("sha2")[0]
        assert [r["parent"] for r in rows.orderBy("document_id", "pos").collect()] == [None, "TITLE", "TITLE", None, None]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_islands_of_short_documents_need_one_order(spark):
    from chronolex.operators import spans as sp

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(i, i % 3 if i % 4 else None, 10 * i, 10 * i + (25 if i % 5 else 0), f"t{i}", 0.5, 1, "s") for i in range(40)]
        spans = spark.createDataFrame(rows, "span_id long, document_id long, start long, end long, text string, confidence double, page_num long, section_id string")
        short, long = sp.merge_adjacent(spans), sp.merge_adjacent(spans.unionByName(spans.selectExpr("span_id + 100 AS span_id", "document_id", "start + 9000 AS start", "end + 9000 AS end", "text", "confidence", "page_num", "section_id")))
        assert dealt(short) == 1
        got = sorted(((r["document_id"] is None, r["document_id"] or 0, r["start"], r["end"], r["text"]) for r in short.collect()))
        both = sorted(((r["document_id"] is None, r["document_id"] or 0, r["start"], r["end"], r["text"]) for r in long.collect()))
        assert both == sorted(got + [(n, d, s + 9000, e + 9000, t) for n, d, s, e, t in got])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_resolution_makes_no_pairs(spark):
    from chronolex.operators import spans as sp

    rows = [(i, i % 5 if i % 9 else None, 10 * i % 700, 10 * i % 700 + (i * 7) % 40, i % 11 / 10 if i % 13 else None) for i in range(120)]
    spans = spark.createDataFrame(rows, "span_id long, document_id long, start long, end long, confidence double")
    out = sp.resolve_overlaps(spans)
    assert "LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString()
    hit = lambda a: any(a[1] is not None and a[1] == b[1] and a[0] != b[0] and a[3] > b[2] and b[3] > a[2] for b in rows)
    assert sorted(r["span_id"] for r in out.collect()) == [r[0] for r in rows if (r[4] or 0) >= 0.8 or not hit(r)]


def test_pairs_of_a_chunk_asked_often_stay_where_they_are(spark, monkeypatch):
    from chronolex.operators import training as tr

    qa = spark.createDataFrame([(i, [i % 4, 77], [1, 2, i, 4, 5, 6, None]) for i in range(30)], "question long, positives array<long>, negatives array<long>")
    corpus = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "chunk_id long, text string")
    plain = sorted(map(tuple, tr.training_pairs(qa, corpus).collect()))
    monkeypatch.setattr(tr, "OFTEN", 3)
    monkeypatch.setattr(tr, "MOST_OFTEN", 20)
    out = tr.training_pairs(qa, corpus)
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString() and sorted(map(tuple, out.collect())) == plain and len(plain) > 100


def test_layout_lists_are_made_once(spark):
    import os

    import pytest

    from chronolex.plans import catalogue

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test data")
    plan = catalogue.queries()["layout_elements"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan


def test_rounds_of_a_difference_hold_no_texts(spark, monkeypatch):
    from chronolex.operators import text_diff as td

    seen, write = [], td.staged
    monkeypatch.setattr(td, "staged", lambda df, name: seen.append(df.columns) or write(df, name))
    pairs = spark.createDataFrame([(1, ["a", "b", "", "c"], ["a", "x", "c"]), (2, ["p"], ["q"]), (3, None, [None])], "key int, old array<string>, new array<string>")
    got = sorted(map(tuple, td.differences(pairs).select("key", "gap", "kind", "pos", "op", "line").collect()))
    assert seen and not any(c in ("line", "old", "new") for columns in seen for c in columns)
    assert got == [(1, 0, 0, 0, " ", "a"), (1, 0, 1, 1, "-", "b"), (1, 0, 1, 2, "-", ""), (1, 0, 2, 1, "+", "x"), (1, 3, 0, 3, " ", "c"), (2, -1, 1, 0, "-", "p"), (2, -1, 2, 0, "+", "q"), (3, -1, 2, 0, "+", "")]
