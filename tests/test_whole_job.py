"""Queries take all rows of their tables, held against brute force on small tables."""

import hashlib
import itertools
import random
import re
import unicodedata
from datetime import datetime

import numpy as np
import pytest

from chronolex.plans import catalogue
from chronolex.plans import retrieval_queries as rq
from chronolex.operators import temporal as tp
from chronolex.plans.inputs import FIFTIETH, temporal


@pytest.fixture
def run(spark, tmp_path):
    def run(name, **tables):
        for table, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{table}.parquet")
        return catalogue.queries()[name](spark, str(tmp_path)).collect()

    return run


def windows(text):
    """(window, digest, byte_start, byte_end) as the rule cuts them, spaces stripped."""
    raw, out = text.encode(), []
    for start in range(0, len(raw), 448):
        piece = raw[start : start + 512].decode(errors="ignore")
        if start + 512 < len(raw) and piece.rfind(" ") > 256:
            piece = piece[: piece.rfind(" ")]
        piece = piece.strip(" ")
        if piece:
            out.append((start // 448, hashlib.sha256(piece.encode()).hexdigest(), start, start + len(piece.encode())))
    return out


def test_sliding_chunks_of_every_document(run):
    alphabets = ["plain words ", "größe straße\n", "é", "नियम ", "a😀b", "x� ", "�😀é"]
    texts = ["", *(" " * lead + unit * n for unit in alphabets for n in (3, 170, 700) for lead in (0, 1, 2))]
    found = run("sliding_chunks", documents=([*enumerate(texts), (999, None)], "doc_id long, text string"))
    want = {(d, *w) for d, text in enumerate(texts) for w in windows(text)}
    assert len(found) == len(want)
    assert {(r["document_id"], r["window"], r["digest"], r["byte_start"], r["byte_end"]) for r in found} == want


def conflicts(spans, threshold=0.8):
    """{(query_id, first, second): (similarity, winner)} over all pairs."""
    words, found = {x["span_id"]: set(re.sub(r"\W+", " ", x["text"].lower()).split()) for x in spans}, {}
    for a, b in itertools.combinations(sorted(spans, key=lambda x: x["span_id"]), 2):
        if a["query_id"] == b["query_id"] and a["document_id"] != b["document_id"]:
            one, two = words[a["span_id"]], words[b["span_id"]]
            similarity = len(one & two) / len(one | two)
            if similarity > threshold:
                wins = b if (b["precedence_weight"], b["effective_date"]) > (a["precedence_weight"], a["effective_date"]) else a
                found[a["query_id"], a["span_id"], b["span_id"]] = (round(similarity, 6), wins["span_id"])
    return found


def pairs_of(spans, membership, linked):
    """{(query_id, first, second): similarity} from links between classes and membership."""
    document, held, found = {x["span_id"]: x["document_id"] for x in spans}, {}, {}
    for r in membership:
        held.setdefault((r["query_id"], r["class_id"]), []).append(r["span_id"])
    for r in linked:
        q = r["query_id"]
        for a, b in itertools.product(held[q, r["first"]], held[q, r["second"]]):
            if a != b and document[a] != document[b]:
                found[q, min(a, b), max(a, b)] = round(r["similarity"], 6)
    return found


def test_conflicts_above_the_default_threshold(run, spark, tmp_path):
    kinds = ["1-URGENT", "2-HIGH", "4-NOT SPECIFIED", "5-LOW"]
    rng = random.Random(2)
    orders = [(k, rng.choice([0, 50, 650, 1300]) + rng.randrange(2), datetime(1995, 1, 1 + k % 5), rng.choice(kinds)) for k in range(600)]
    found = run("text_conflicts", orders=(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_orderpriority string"))
    spans = [r.asDict() for r in temporal(spark, str(tmp_path), FIFTIETH).collect()]
    want = conflicts(spans)
    assert any(s <= 0.9 for s, _ in want.values()) and any(s > 0.9 for s, _ in want.values())
    membership = [{"query_id": r["query_id"], "class_id": r["first"], "span_id": r["second"]} for r in found if r["kind"] == "member"]
    assert pairs_of(spans, membership, [r for r in found if r["kind"] == "link"]) == {at: s for at, (s, _) in want.items()}
    few = [r.asDict() for r in temporal(spark, str(tmp_path)).collect()]
    counted = {r["query_id"]: r["conflicts"] for r in catalogue.queries()["conflict_counts"](spark, str(tmp_path)).collect()}
    pairs = conflicts(few)
    assert counted == {q: sum(at[0] == q for at in pairs) for q in {at[0] for at in pairs}}
    sides = {(x, w == x) for (_, *pair), (_, w) in want.items() for x in pair}
    lost = {x for x, won in sides if not won and (x, True) not in sides}
    kept = catalogue.queries()["conflict_resolve"](spark, str(tmp_path)).collect()
    assert sorted(r["span_id"] for r in kept) == sorted(x["span_id"] for x in spans if x["span_id"] not in lost)
    assert lost - {x for (_, *pair), (s, _) in want.items() if s > 0.9 for x in pair}


ORDERS = "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_orderpriority string"


def test_conflicts_reach_every_fiftieth_customer(run, spark, tmp_path):
    """Customers 3 and 653 (a multiple of 50 and of 13 apart): one query, one text, so one class of two and one loser; customer 4 is in another query."""
    orders = [(10, 3, datetime(1995, 1, 1), "1-URGENT"), (10 + 97 * 6, 653, datetime(1995, 1, 1), "1-URGENT"), (11, 4, datetime(1995, 1, 1), "1-URGENT")]
    found = run("text_conflicts", orders=(orders, ORDERS))
    assert sorted((r["query_id"], r["first"], r["second"]) for r in found if r["kind"] == "member") == [(3, 10, 10), (3, 10, 592), (4, 11, 11)]
    assert [r["span_id"] for r in catalogue.queries()["conflict_resolve"](spark, str(tmp_path)).orderBy("span_id").collect()] == [10, 11]


def test_dated_conflicts_as_classes_give_all_pairs(run, spark, tmp_path):
    """Pairs from classes and edges of meta_conflicts are those that metadata_conflicts makes, over customers that 50 tells apart."""
    rng = random.Random(5)
    orders = [(k, rng.randrange(6) * 50 + rng.randrange(2), datetime(1995, 1, 1 + rng.randrange(4)), "5-LOW") for k in range(150)]
    found = run("meta_conflicts", orders=(orders, ORDERS))
    held, place = {}, {r["span_id"]: r["pos"] for r in temporal(spark, str(tmp_path), FIFTIETH).collect()}
    for r in found:
        if r["conflict_type"] == "member":
            held.setdefault(r["first"], []).append(r["second"])
    got = {}
    for r in found:
        if r["conflict_type"] == "status_conflict":
            for a, b in itertools.product(held[r["first"]], held[r["second"]]):
                side = {"prefer_first": a, "prefer_second": b}.get(r["resolution"])
                got[tuple(sorted((a, b), key=place.get))] = ("status_conflict", side)
    for r in found:
        if r["conflict_type"] == "supersession":
            got[r["first"], r["second"]] = ("supersession", r["first"] if r["resolution"] == "prefer_first" else r["second"])
    pick = lambda r: {"prefer_first": r["first"], "prefer_second": r["second"]}.get(r["resolution"])
    want = {(r["first"], r["second"]): (r["conflict_type"], pick(r)) for r in tp.metadata_conflicts(temporal(spark, str(tmp_path), FIFTIETH)).collect()}
    assert got == want and len({t for t, _ in want.values()}) == 2


def test_metadata_conflicts_list_every_pair_of_spans(run, spark, tmp_path):
    """meta_conflicts gives each pair of spans that conflict, not only their classes: a loop over all pairs of a query finds the same."""
    rng = random.Random(8)
    orders = [(k, rng.randrange(3) * 50 + rng.randrange(2), datetime(1995, 1, 1 + rng.randrange(3)), "5-LOW") for k in range(120)]
    found = run("meta_conflicts", orders=(orders, ORDERS))
    got = sorted((r["first"], r["second"], r["conflict_type"], r["resolution"]) for r in found if r["conflict_type"] in ("status_pair", "supersession"))
    rows, want = temporal(spark, str(tmp_path), FIFTIETH).collect(), []
    for a, b in itertools.product(rows, rows):
        if a["query_id"] != b["query_id"] or a["pos"] >= b["pos"]:
            continue
        if b["span_id"] in a["supersedes"] or b["superseded_by"] == a["span_id"]:
            want.append((a["span_id"], b["span_id"], "supersession", "prefer_first"))
        elif a["span_id"] in b["supersedes"] or a["superseded_by"] == b["span_id"]:
            want.append((a["span_id"], b["span_id"], "supersession", "prefer_second"))
        elif a["effective_date"] == b["effective_date"] and a["status"] != b["status"]:
            prefer = "prefer_first" if a["status"] == "active" else "prefer_second" if b["status"] == "active" else "prefer_latest"
            want.append((a["span_id"], b["span_id"], "status_pair", prefer))
    assert got == sorted(want) and {t for _, _, t, _ in want} == {"supersession", "status_pair"}
    pairs = tp.metadata_conflicts(temporal(spark, str(tmp_path), FIFTIETH)).collect()
    assert sorted((r["first"], r["second"], r["conflict_type"].replace("status_conflict", "status_pair"), r["resolution"]) for r in pairs) == got


def test_depth_of_training_lists_and_fused_lists(run, spark, tmp_path):
    rng = random.Random(3)
    vectors = [[rng.gauss(0.5, 1) for _ in range(8)] for _ in range(300)]
    label = [rng.randrange(4) for _ in vectors]
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choices(words, k=rng.randint(3, 30))) for _ in range(80)]
    found = run(
        "retrieval_metrics",
        embeddings=([*zip(range(300), vectors, label)], "vec_id long, embedding array<float>, label int"),
        documents=([(d, x, "en") for d, x in enumerate(texts)], "doc_id long, text string, lang string"),
        benchmark=([(i, " ".join(rng.choices(words, k=6))) for i in range(5)], "item_id long, text string"),
    )
    got = {r["query_id"]: r for r in found}
    unit = [np.float32(v).astype(float) / np.linalg.norm(np.float32(v).astype(float)) for v in vectors]
    negatives = {}
    for x in catalogue.queries()["hard_negatives"](spark, str(tmp_path)).collect():
        negatives.setdefault(x["query_id"], []).append((x["n"], x["chunk_id"]))
    for q in got:
        ranked = sorted((-round(float(unit[20 * q] @ v), 6), c) for c, v in enumerate(unit))  # query i is vector 20 i
        ranked = [c for score, c in ranked if score < 0][:100]
        own = {c for c in range(300) if label[c] == label[20 * q] and c != 20 * q}
        for k in (10, 100):
            assert got[q][f"recall_at_{k}"] == round(len(own & set(ranked[:k])) / len(own), 6)
        assert sorted(negatives[q]) == [*enumerate([c for c in ranked if label[c] != label[20 * q]][:10], 1)]
    assert any(r["recall_at_100"] > r["recall_at_10"] for r in found)

    lists = {k: {} for k in ("dense", "sparse", "bm25")}
    for name, hits in (("dense", rq._dense), ("sparse", rq._sparse), ("bm25", rq._bm25)):
        for r in hits(spark, str(tmp_path), 1000).collect():
            lists[name][r["query_id"], r["chunk_id"]] = r["rank"]
    scores = {}
    for ranks in lists.values():
        for at, rank in ranks.items():
            if rank <= 20:
                scores[at] = scores.get(at, 0) + 1 / (60 + rank)
    want = set()
    for q in {q for q, _ in scores}:
        best = sorted((-round(x, 6), c) for (i, c), x in scores.items() if i == q)[:10]
        want |= {(q, c, -x) for x, c in best}
    fused = catalogue.queries()["rrf_fuse"](spark, str(tmp_path)).collect()
    assert {(r["query_id"], r["chunk_id"], r["score"]) for r in fused} == want and len(fused) == len(want)


def test_nfkc_of_every_document(run):
    texts = ["ﬁne  ﾃｽﾄ​ x", "①² ｆｕｌｌ\t width﻿", "", None, "a b　c d\x85e\x1cf ", "‍ ‌", "ﬃ नि‍यम \n" * 20_000, "plain"]
    found = run("nfkc_normalize", documents=([*enumerate(texts)], "doc_id long, text string"))
    clean = lambda t: re.sub(r"\s+", " ", re.sub("[​‌‍﻿]", "", unicodedata.normalize("NFKC", t))).strip()
    assert {r["id"]: r["text"] for r in found} == {i: t if t is None else clean(t) for i, t in enumerate(texts)}
