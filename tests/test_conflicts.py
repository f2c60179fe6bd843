"""Conflicts as classes and supersession by name, against plain loops over pairs."""

import itertools
import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from chronolex.config import EngineConfig
from chronolex.operators import conflicts as cf
from chronolex.operators import engine
from chronolex.operators import supersession as su
from chronolex.operators import temporal as tp

SPANS = "query_id int, span_id int, document_id int, text string, precedence_weight double, effective_date timestamp_ntz"


def spans_of(n, seed):
    """Few texts in few documents, so that classes, links, equal weights, equal and missing dates all occur."""
    rng = random.Random(seed)
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(10)] = rng.choice(["one", "two"])
        text = rng.choice(["", None, " ".join(words), " ".join(reversed(words)) + "!"]) if i % 9 == 0 else " ".join(words)
        rows.append((rng.randint(1, 3), i, rng.randint(1, 4), text, rng.choice([1.0, 2.0]), rng.choice([None, datetime(2020, 1, 1), datetime(2021, 1, 1)])))
    return rows


def wins(a, b):
    """Whether a beats b."""
    if a[4] != b[4]:
        return a[4] > b[4]
    first, second = sorted((a, b), key=lambda x: x[1])
    later = second if first[5] and second[5] and second[5] > first[5] else first
    return later is a


@pytest.mark.parametrize("seed", range(4))
def test_classes_give_all_pairs_and_their_resolution(spark, seed):
    rows = spans_of(120, seed)
    words = {r[1]: set(re.findall(r"\w+", (r[3] or "").lower())) for r in rows}
    want, lost = {}, set()
    for a, b in itertools.combinations(rows, 2):
        if a[0] == b[0] and a[2] != b[2] and words[a[1]] | words[b[1]]:
            similarity = len(words[a[1]] & words[b[1]]) / len(words[a[1]] | words[b[1]])
            if similarity > 0.8:
                want[a[0], a[1], b[1]] = similarity
    at = {r[1]: r for r in rows}
    sides = [(x, y) for _, a, b in want for x, y in ((a, b), (b, a))]
    lost = {x for x, _ in sides} - {x for x, y in sides if wins(at[x], at[y])}
    spans = spark.createDataFrame(rows, SPANS)
    membership = cf.members(spans)
    linked = cf.links(spans, membership)
    held, found = {}, {}
    for r in membership.collect():
        held.setdefault((r["query_id"], r["class_id"]), []).append(r["span_id"])
    for r in linked.collect():
        for a, b in itertools.product(held[r["query_id"], r["first"]], held[r["query_id"], r["second"]]):
            if a != b and at[a][2] != at[b][2]:
                found[r["query_id"], min(a, b), max(a, b)] = r["similarity"]
    assert found == pytest.approx(want)
    counts = {r["query_id"]: r["conflicts"] for r in cf.pair_count(spans, membership, linked).collect()}
    assert counts == {q: sum(k[0] == q for k in want) for q in {k[0] for k in want}}
    kept = sorted(r["span_id"] for r in cf.resolve(spans, membership, linked).collect())
    assert kept == sorted(set(at) - lost)


def test_equal_texts_make_rows_in_proportion(spark):
    """A thousand equal spans: half a million pairs, one class and one link."""
    spans = spark.range(1000).select(F.lit(1).alias("query_id"), F.col("id").cast("int").alias("span_id"), F.col("id").cast("int").alias("document_id"), F.lit("the same words").alias("text"), F.lit(1.0).alias("precedence_weight"), F.lit(None).cast("timestamp_ntz").alias("effective_date"))
    membership = cf.members(spans)
    linked = cf.links(spans, membership)
    assert [tuple(r) for r in linked.collect()] == [(1, 0, 0, 1.0)] and membership.count() == 1000
    assert cf.pair_count(spans, membership, linked).first()["conflicts"] == 499_500
    assert cf.resolve(spans, membership, linked).count() == 999  # the last of equals loses to all


def test_no_spans(spark):
    spans = spark.createDataFrame([], SPANS)
    membership = cf.members(spans)
    linked = cf.links(spans, membership)
    assert membership.collect() == linked.collect() == cf.pair_count(spans, membership, linked).collect() == cf.resolve(spans, membership, linked).collect() == []


# --- names ----------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    ("name", "key"),
    [("ORDER 12", "ORDER 12"), ("the Order No. 12", "ORDER 12"), (" Orders, number 12/A ", "ORDER 12 A"), ("Finance Act", "FINANCE ACT"), ("act", None), ("", None), (None, None), ("12", "12"), ("GUIDELINES 7", "GUIDELINE 7")],
)
def test_name_keys(spark, name, key):
    assert spark.createDataFrame([(name,)], "n string").select(su.name_key(F.col("n"))).first()[0] == key


@pytest.mark.parametrize(("text", "key"), [("The Act No. 8 shall come into force.", "ACT 8"), ("w.e.f. 1/1/2020 the order 2 was repealed and replaced by ORDER 3 dated today.", "ORDER 2"), ("No title here.", None), (None, None), ("regulations 14B apply", "REGULATION 14B")])
def test_title_keys(spark, text, key):
    assert spark.createDataFrame([(text,)], "t string").select(su.title_key(F.col("t"))).first()[0] == key


def test_names_resolve_to_documents_of_the_query(spark):
    kind = "query_id int, span_id string, document_id string, supersedes array<string>, superseded_by string"
    rows = [
        (1, "a_0", "a", ["ORDER 2", "order no. 3"], None),
        (1, "b_0", "b", [], None),
        (1, "b_9", "b", [], "Act 1"),
        (2, "b_0", "b", [], None),
        (1, "c_0", "c", None, "ACT 77"),
        (1, "d_0", "d", ["ACT 4"], None),
    ]
    titles = [("a", "ACT 1"), ("b", "ORDER 2"), ("e", "ORDER 2"), ("x", "ORDER 3"), ("d", "ACT 4")]
    found = su.named_edges(spark.createDataFrame(rows, kind), spark.createDataFrame(titles, "document_id string, key string")).collect()
    assert {tuple(r) for r in found} == {(1, "a_0", "b_0"), (1, "a_0", "b_9")} and len(found) == 2


def test_a_named_supersession_changes_the_answer(spark):
    notices = [
        ("d1_0", "The order 12 on bank deposits is effective on the 01/01/2020 and every bank shall keep a reserve."),
        ("d2_0", "Notification 30 supersedes ORDER 12. It is effective on the 01/01/2022 and every bank deposit shall be insured in full."),
    ]
    rows = [(i, t, [(t, 0, len(t), 1, "paragraph", 0.9)], ["en"], ["paragraph"]) for i, t in notices]
    corpus = spark.createDataFrame(rows, "chunk_id string, text string, spans array<struct<text:string,byte_start:int,byte_end:int,page_num:int,section_type:string,confidence:double>>, languages array<string>, section_types array<string>")
    asked = spark.createDataFrame([(1, "bank deposit reserve insured")], "query_id int, text string")
    config, day = EngineConfig(min_evidence_spans=1), lambda d: F.lit(d).cast("timestamp_ntz")
    answer = lambda d, **more: engine.ask(asked, corpus, day(d), config, **more).first()["answer"]
    assert "keep a reserve" in answer("2021-06-01") and "insured" not in answer("2021-06-01")
    assert "keep a reserve" not in answer("2023-06-01") and "insured" in answer("2023-06-01")
    without = spark.createDataFrame([], "document_id string, key string")
    assert "keep a reserve" in answer("2023-06-01", titles=without) and "insured" in answer("2023-06-01", titles=without)


def test_each_pattern_is_tried_once(spark):
    plan = tp.with_temporal_metadata(spark.createDataFrame([("x",)], "text string"))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"regexp_extract\(", plan)) <= len(tp.EFFECTIVE) + len(tp.EXPIRY) + len(tp.PUBLICATION) + 2 * len(tp.SUPERSEDED_BY)


CUED = [
    "It COMES\tinto Force on the 3-4-2001 and EXPIRES on 05/06/2002.",
    "Effective 7 March 1999; valid until 8  April 2000. Published on the 1/2/1998.",
    "With Effect\nfrom 31/12/1995, replaced by ORDER 9 dated today. It replaces Act 3, RULES 4 of old.",
    "W.E.F. 12/31/1995 and shall remain in force until 1/1/1997; substituted by RULE 6. GAZETTE 2/3/1994",
    "In Supersession of CIRCULAR 5, ORDER 6. Notification dated 4/5/1993 was superseded by ACT 77 of 1990",
    "effective 99/99/2001, effective 1 May 2001",
    "from the source, with force and effect: current, valid, replaceable",
    "",
    None,
]


def test_texts_without_cues_are_spared_patterns_and_nothing_else_changes(spark):
    """Each find against the pattern alone; a pattern is not tried on a text without any of its cues."""
    assert set(tp.CUES) == {p for group in (tp.EFFECTIVE, tp.EXPIRY, tp.PUBLICATION, tp.SUPERSEDED_BY, tp.SUPERSEDES) for p in group}
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(CUED)], "i int, text string")
    tidy = lambda p: F.trim(F.regexp_extract("text", f"(?i){p}", 1))
    plain = texts.withColumns({f"d{k}_{j}": F.regexp_replace(F.translate(tidy(p), "-", "/"), r"\s+", " ") for k, group in enumerate((tp.EFFECTIVE, tp.EXPIRY, tp.PUBLICATION)) for j, p in enumerate(group)})
    date = lambda k, n: F.coalesce(*[F.try_to_timestamp(F.col(f"d{k}_{j}"), F.lit(f)).cast("timestamp_ntz") for j in range(n) for f in ("d/M/yyyy", "M/d/yyyy", "d MMMM yyyy")])
    plain = plain.select("i", date(0, 4).alias("effective_date"), date(1, 3).alias("expiry_date"), date(2, 3).alias("publication_date"), F.coalesce(*[F.nullif(tidy(p), F.lit("")) for p in tp.SUPERSEDED_BY]).alias("superseded_by"))
    found = tp.with_temporal_metadata(texts)
    assert sorted(map(tuple, found.select(plain.columns).collect())) == sorted(map(tuple, plain.collect()))
    names = {r["i"]: r["supersedes"] for r in found.collect()}
    assert names == {i: {2: ["Act 3", "RULES 4"], 4: ["CIRCULAR 5", "ORDER 6"]}.get(i) for i in range(len(CUED))}
    tree = found._jdf.queryExecution().optimizedPlan().toString()
    assert tree.count("THEN regexp_extract(") + tree.count("THEN translate(regexp_extract(") + tree.count("THEN regexp_replace(translate(regexp_extract(") + tree.count("THEN trim(regexp_extract(") >= 13


def test_names_and_titles_are_brought_to_keys_once(spark):
    """Notices are dealt by their number before texts are made, a title's key is staged, and a name's key found once for the join and its filter."""
    from chronolex.plans import temporal_queries as tq

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    before, tq.NOTICES = tq.NOTICES, 500
    try:
        legal = tq._spread_legal(spark, "/root/testdata/sf0.001")
        assert legal.rdd.getNumPartitions() == -(-legal.count() // 500) > 1
        plan = tq._named_edges(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        tq.NOTICES = before
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("upper(") <= 2 and "act|statute" not in plan  # the two kinds of names; no pattern of titles
