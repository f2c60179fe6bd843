"""Differences of texts: applying one to the old text gives the new; the unified form is the usual one where the choice is clear."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from chronolex.operators import scans
from chronolex.operators import text_diff as td


def frame(spark, pairs):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "key int, old array<string>, new array<string>")


def edited(rng, lines):
    out = list(lines)
    for _ in range(rng.randint(0, 6)):
        at, what = rng.randrange(len(out) + 1), rng.randint(0, 3)
        if what == 0:
            out.insert(at, rng.choice(["new", "x", "", "}"]))
        elif what == 1 and out:
            out.pop(min(at, len(out) - 1))
        elif what == 2 and len(out) > 2:
            a, b = sorted((rng.randrange(len(out)), rng.randrange(len(out))))
            out[a:a] = out[b : b + 3]
        elif out:
            out[min(at, len(out) - 1)] = "changed"
    return out


PAIRS = [([], []), (None, ["a"]), (["a"], None), (["a", "b"], ["a", "b"]), (["a", None, "b"], ["", "b"]), (["x"] * 5, ["x"] * 3), (["a", "b", "c"], ["c", "b", "a"]), (list("abcdefghij"), list("abXdefghiY"))]


@pytest.mark.parametrize(("seed", "split"), [(0, 1024), (1, 4)])
def test_applied_differences_give_the_new_text(spark, monkeypatch, seed, split):
    monkeypatch.setattr(scans, "SPLIT", split)
    rng = random.Random(seed)
    pairs = list(PAIRS)
    for _ in range(60):
        lines = [rng.choice(["{", "}", "", *(f"line {i}" for i in range(30))]) for _ in range(rng.randint(0, 50))]
        pairs.append((lines, edited(rng, lines)))
    diff = td.differences(frame(spark, pairs))
    plain = lambda x: ["" if s is None else s for s in x or []]
    for new in (True, False):
        got = {r["key"]: r["lines"] for r in td.applied(diff, new).collect()}
        assert {i: got.get(i, []) for i in range(len(pairs))} == {i: plain(b if new else a) for i, (a, b) in enumerate(pairs)}
    kept = {r["key"]: r["n"] for r in diff.filter("op = ' '").groupBy("key").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert kept[3] == 2 and kept[6] == 1 and kept[7] == 8
    best = sum(sum(m.size for m in difflib.SequenceMatcher(None, plain(a), plain(b), False).get_matching_blocks()) for a, b in pairs)
    assert sum(kept.values()) >= 0.85 * best


def test_unified_form(spark):
    rng = random.Random(4)
    pairs = []
    for _ in range(25):
        lines = [f"line {i} {rng.random()}" for i in range(rng.randint(0, 60))]  # unique lines: one best matching
        other = [x for x in lines if rng.random() > 0.05]
        for _ in range(rng.randint(0, 3)):
            other.insert(rng.randrange(len(other) + 1), f"added {rng.random()}")
        pairs.append((lines, other))
    got = {r["key"]: r["lines"] for r in td.unified(td.differences(frame(spark, pairs))).collect()}
    for i, (a, b) in enumerate(pairs):
        assert got.get(i, []) == list(difflib.unified_diff(a, b, lineterm=""))


def test_longest_rising_run(spark):
    rng = random.Random(5)
    for _ in range(15):
        js = rng.sample(range(40), rng.randint(0, 25))
        rows = spark.createDataFrame([([*enumerate(js)],)], "a array<struct<i:int,j:int>>")
        found = [x["j"] for x in rows.select(td._walk(F.col("a"), td.rising(F.col("a"))).alias("w")).first()["w"]]
        best = [1] * len(js)
        for k in range(len(js)):
            best[k] = 1 + max((best[m] for m in range(k) if js[m] < js[k]), default=0)
        assert found == sorted(found) and len(found) == max(best, default=0)


def test_no_python_worker_and_no_pairs(spark):
    diff = td.differences(frame(spark, PAIRS))
    assert "Python" not in td.unified(diff)._jdf.queryExecution().executedPlan().toString()
    empty = td.differences(frame(spark, PAIRS).limit(0))
    assert empty.collect() == td.unified(empty).collect() == td.applied(empty).collect() == []
