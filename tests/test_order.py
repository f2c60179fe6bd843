"""Order statistics, exact splits, isotonic fits, chunk context and temporal views against plain loops."""

import math
import random
import statistics
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolex.operators import calibrate as ca
from chronolex.operators import metrics as mt
from chronolex.operators import order
from chronolex.operators import segment as sg
from chronolex.operators import temporal as tp


def test_statistics_of_few_hot_keys(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([rng.randint(0, 50) / 4, None])) for _ in range(3000)] + [("one", 2.5)]
    got = {r["k"]: r for r in mt.latency(spark.createDataFrame(rows, "k string, v double"), "v", ["k"]).collect()}
    for key in {k for k, v in rows if v is not None}:
        values = sorted(v for k, v in rows if k == key and v is not None)
        n, r = len(values), got[key]
        assert r["n"] == n and r["median"] == statistics.median(values) and r["mean"] == pytest.approx(statistics.fmean(values))
        assert [r["p95"], r["p99"]] == [values[max(1, math.floor(n * q)) - 1] for q in (0.95, 0.99)]
        assert r["std"] == pytest.approx(statistics.pstdev(values), abs=1e-9)
    assert set(got) == {k for k, v in rows if v is not None}
    assert mt.latency(spark.createDataFrame([], "k string, v double"), "v", ["k"]).collect() == []


def test_no_window_holds_a_key_in_one_task(spark):
    rows = spark.range(20_000).select(F.lit(1).alias("k"), (F.col("id") * 7 % 10_007).alias("v"))
    counts = rows.groupBy("k", "v").agg(F.count(F.lit(1)).alias("_c"))
    placed = order.with_places(counts, ["k"], "v")
    plan = placed._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "windowspecdefinition(" in line and "sum(_c" in line]
    assert windows and all("_range" in line.split("windowspecdefinition(")[1].split("ASC")[0] for line in windows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # ranges so small would be put together
    try:
        assert order._ranged(counts, "k", "v").select("_range").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert placed.agg(F.max("_to")).first()[0] == 20_000


@pytest.mark.parametrize(("n", "share"), [(10, 0.8), (7, 0.8), (1, 0.8), (0, 0.8), (1000, 0.333), (50, 0.0), (50, 1.0)])
def test_exact_split(spark, n, share):
    rows = [(i % 3, i) for i in range(n)]
    parts = order.first_share(spark.createDataFrame(rows, "x int, i int").repartition(3), ["x", "i"], share).collect()
    want = {i for _, i in sorted(rows)[: int(n * share + 1e-9)]}
    assert len(parts) == n and {r["i"] for r in parts if r["part"] == "train"} == want


def test_exact_split_of_equal_rows(spark):
    parts = order.first_share(spark.range(1000).select(F.lit(5).alias("x")), ["x"], 0.8).groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in parts} == {"train": 800, "test": 200}


# --- isotonic -----------------------------------------------------------------------------------------
def plain_fit(points):
    """Least-squares rising fit of (x, y, w) by the textbook loop; {x: fitted}."""
    pooled = {}
    for x, y, w in points:
        a, b = pooled.get(x, (0.0, 0.0))
        pooled[x] = a + w * y, b + w
    blocks = []
    for x in sorted(pooled):
        blocks.append([pooled[x][0], pooled[x][1], [x]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            wy, w, xs = blocks.pop()
            blocks[-1] = [blocks[-1][0] + wy, blocks[-1][1] + w, blocks[-1][2] + xs]
    return {x: wy / w for wy, w, xs in blocks for x in xs}


@pytest.mark.parametrize(("seed", "at_once"), [(0, 100_000), (1, 50), (2, 7)])
def test_isotonic_is_the_plain_fit_whatever_the_parts(spark, seed, at_once):
    rng = random.Random(seed)
    points = [(round(x, 2), float(rng.random() < x), rng.choice([1.0, 2.0, 0.5])) for x in (rng.random() for _ in range(800))]
    rows = points + [(None, 1.0, 1.0), (float("nan"), 1.0, 1.0), (0.5, None, 1.0), (0.5, 1.0, 0.0), (0.5, 1.0, -1.0)]
    blocks = ca.isotonic(spark.createDataFrame(rows, "x double, y double, w double"), "x", "y", "w", at_once)
    found, want = sorted(map(tuple, blocks.collect())), plain_fit(points)
    assert sum(b[4] for b in found) == len(points) and all(a[1] < b[0] and a[5] < b[5] for a, b in zip(found, found[1:], strict=False))
    for x, y in want.items():
        assert [b[5] for b in found if b[0] <= x <= b[1]] == [pytest.approx(y)]


def test_rising_and_falling_data(spark):
    frame = lambda ys: spark.createDataFrame([(float(i), float(y)) for i, y in enumerate(ys)], "x double, y double")
    rising = ca.isotonic(frame(range(300)), "x", "y", at_once=10)
    assert rising.count() == 300
    falling = ca.isotonic(frame(range(300, 0, -1)), "x", "y", at_once=10)
    assert [tuple(r) for r in falling.select("lo", "hi", "fitted", "n").collect()] == [(0.0, 299.0, 150.5, 300)]
    assert ca.isotonic(frame([]), "x", "y").collect() == []


def test_calibrated_scores(spark):
    points = spark.createDataFrame([(0.2, 0.0), (0.4, 1.0), (0.5, 0.0), (0.9, 1.0)], "x double, y double")
    blocks = ca.isotonic(points, "x", "y")
    asked = spark.createDataFrame([(i, x) for i, x in enumerate([0.0, 0.2, 0.3, 0.45, 0.7, 1.0, None])], "i int, s double")
    got = [r["c"] for r in asked.select("i", ca.calibrated(F.col("s"), blocks).alias("c")).orderBy("i").collect()]
    assert got == [pytest.approx(x) if x is not None else None for x in (0.0, 0.0, 0.25, 0.5, 0.75, 1.0, None)]


def test_fit_lowers_the_calibration_error(spark):
    rng = np.random.default_rng(4)
    x = rng.random(4000)
    rows = spark.createDataFrame([(float(a), bool(rng.random() < a**3)) for a in x], "confidence double, correct boolean")
    blocks = ca.isotonic(rows.withColumn("y", F.col("correct").cast("double")), "confidence", "y")
    fitted = rows.withColumn("confidence", ca.calibrated(F.col("confidence"), blocks))
    assert mt.ece(fitted).first()["ece"] < 0.02 < 0.2 < mt.ece(rows).first()["ece"]


# --- context, views -----------------------------------------------------------------------------------
def test_context_of_overlapping_chunks(spark):
    rng = random.Random(6)
    rows = []
    for d in range(3):
        for c in range(40):
            start = rng.randint(0, 60)
            rows.append((d, c, start, start + rng.randint(1, 12), sorted(rng.sample(range(5), rng.randint(0, 2))), rng.sample(["a", "b"], rng.randint(0, 2))))
    chunks = spark.createDataFrame(rows, "document_id int, chunk_no int, byte_start int, byte_end int, page_nums array<int>, section_types array<string>")
    held = [r.asDict() for r in sg.chunk_context(chunks).collect()]
    want = {}
    for d, c, s, e, pages, kinds in rows:
        others = [r for r in rows if r[0] == d and r[1] != c]
        want[d, c] = {"preceding": {r[1] for r in others if r[3] <= s}, "following": {r[1] for r in others if r[2] >= e and r[3] > s}, "page": {r[1] for r in others if set(r[4]) & set(pages)}, "section": {r[1] for r in others if set(r[5]) & set(kinds)}}
    for r in held:
        same = [x for x in held if x["document_id"] == r["document_id"]]
        assert {x["chunk_no"] for x in same if x["end_place"] <= r["n_preceding"]} == want[r["document_id"], r["chunk_no"]]["preceding"]
        assert {x["chunk_no"] for x in same if x["start_place"] > len(same) - r["n_following"]} == want[r["document_id"], r["chunk_no"]]["following"]
    groups = [tuple(r) for r in sg.chunk_groups(chunks).collect()]
    for (d, c), lists in want.items():
        for relation in ("page", "section"):
            own = {g[2] for g in groups if g[:2] == (d, relation) and g[3] == c}
            assert {g[3] for g in groups if g[:2] == (d, relation) and g[2] in own} - {c} == lists[relation]
    asked = chunks.filter("chunk_no IN (3, 17)")
    found = {}
    for r in sg.neighbours(chunks, asked).collect():
        found.setdefault((r["document_id"], r["chunk_no"]), {}).setdefault(r["relation"], []).append(r["neighbour"])
    for at in found:
        assert {k: sorted(v) for k, v in found[at].items()} == {k: sorted(v) for k, v in want[at].items() if v}


def test_diff_view(spark):
    kind = "query_id int, text string, effective_date timestamp_ntz, status string, precedence_weight double, document_type string"
    long, day = "x" * 130, datetime(2020, 1, 2, 3, 4, 5, 6)
    old = spark.createDataFrame([(1, "kept", None, "active", 1.0, "act"), (1, "gone", day, "active", 2.0, None), (1, "changed", None, "active", 1.0, "act")], kind)
    new = spark.createDataFrame([(1, "kept", None, "active", 1.0, "act"), (1, long, datetime(2021, 5, 6), "active", 3.0, "rule"), (1, "changed", day, "amended", 1.0, "act")], kind)
    got = {r["change"]: r.asDict() for r in tp.diff_view(old, new).collect()}
    assert set(got) == {"added", "removed", "modified"}
    assert got["added"]["text"] == "x" * 100 + "..." and got["added"]["effective_date"] == "2021-05-06T00:00:00" and got["added"]["document_type"] == "rule" and got["added"]["precedence_weight"] == 3.0
    assert got["removed"]["document_type"] == "unknown" and got["removed"]["effective_date"] == day.isoformat() and got["removed"]["old_status"] is None
    assert (got["modified"]["old_status"], got["modified"]["new_status"], got["modified"]["old_effective"], got["modified"]["new_effective"], got["modified"]["precedence_weight"]) == ("active", "amended", None, day.isoformat(), None)


def test_statistics_with_nulls(spark):
    kind = "status string, precedence_weight double, document_type string, effective_date timestamp_ntz, expiry_date timestamp_ntz, superseded_by string, supersedes array<string>"
    rows = [("active", 8.5, "act", datetime(2020, 1, 1), None, None, ["x"]), (None, None, None, None, datetime(2021, 1, 1), "y", None), ("active", 8.0, "act", datetime(2019, 1, 1), None, None, [])]
    got = {(r["dimension"], r["value"]): (r["n"], r["superseding"], r["earliest_effective"], r["latest_expiry"]) for r in tp.statistics(spark.createDataFrame(rows, kind)).collect()}
    assert got[("total", "all")] == (3, 2, datetime(2019, 1, 1), datetime(2021, 1, 1))
    assert got[("document_type", "act")][:2] == (2, 1) and got[("document_type", "unknown")][:2] == (1, 1)
    assert got[("status", None)][:2] == (1, 1) and got[("weight", "8-9")][:2] == (2, 1) and got[("weight", None)][0] == 1
    assert len(got) == 7
