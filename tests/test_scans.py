"""Scans split inside a key give what one scan of the key gives."""

import random

import pytest
from pyspark.sql import functions as F

from chronolex.operators import scans, segment, spans


@pytest.mark.parametrize(("inclusive", "width"), [(True, 7), (False, 7), (True, 10_000), (False, 1)])
def test_totals_of_buckets(spark, inclusive, width):
    rng = random.Random(width)
    rows = [(rng.choice(["hot"] * 8 + ["x", None]), i, rng.choice([None, rng.randint(-9, 9)])) for i in range(500)]
    frame = spark.createDataFrame(rows, "k string, i int, v int").withColumn("b", F.floor(F.col("i") / width))
    got = scans.scan(frame, ["k"], ["b"], ["i"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.col("v"))}, inclusive).collect()
    want, held = {}, {}
    for k, i, v in rows:
        seen = held.setdefault(k, [])
        before = list(seen)
        if v is not None:
            seen.append(v)
        now = seen if inclusive else before
        want[i] = (sum(now), max(now, default=None), now[-1] if now else None)
    assert {r["i"]: (r["s"], r["m"], r["l"]) for r in got} == want and len(got) == len(rows)


def test_no_window_of_rows_holds_a_document(spark):
    pages = spark.createDataFrame([(1, 1, "\n".join(f"line {i}" for i in range(5000)), 1.0)], "document_id int, page_num int, raw_text string, trust_score double")
    plan = segment.sections(pages, "\n")._jdf.queryExecution().executedPlan().toString()
    windows = [x for x in plan.splitlines() if "windowspecdefinition(" in x and "_v_" in x.split("windowspecdefinition(")[0]]
    assert windows and all("_b" in x.split("windowspecdefinition(")[1] for x in windows)


def test_sections_and_islands_whatever_the_buckets(spark, monkeypatch):
    rng = random.Random(3)
    text = "\n".join(rng.choice(["", "TITLE OF IT", "plain words here", "1. Point", "  spaced  ", "é"]) for _ in range(400))
    pages = spark.createDataFrame([(d, p, text[p * 50 :], 0.5) for d in (1, 2) for p in (1, 2, 3)] + [(3, 1, "", 1.0), (4, 1, None, 1.0)], "document_id int, page_num int, raw_text string, trust_score double")
    rows = [(i, rng.randint(1, 2), s := rng.randint(0, 3000), s + rng.randint(1, 30), f"t{i}") for i in range(300)]
    intervals = spark.createDataFrame(rows, "span_id int, document_id int, start int, end int, text string").withColumns({"page_num": F.lit(1), "confidence": F.lit(0.5), "section_id": F.lit("s")})
    found = []
    for split, bucket in ((1 << 20, 1 << 20), (16, 64), (1, 3)):
        monkeypatch.setattr(scans, "SPLIT", split)
        monkeypatch.setattr(spans, "BUCKET", bucket)
        found.append([sorted(map(str, df.collect())) for df in (segment.sections(pages, "\n"), *(spans.merge_adjacent(intervals, g, t).drop("island") for g, t in ((0, False), (0, True), (9, True))))])
    assert found[0] == found[1] == found[2] and all(found[0])
    offsets = {(r["document_id"], r["pos"]): (r["byte_start"], r["text"]) for r in segment.sections(pages, "\n").collect()}
    whole = "\n".join(text[p * 50 :] for p in (1, 2, 3)).encode()
    for (_, _), (start, said) in offsets.items():
        assert whole[start:].lstrip(b" ").startswith(said.encode())
