"""op12: positives and negatives against plain loops over all pairs."""

import numpy as np
import pytest

from chronolex.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, embedding array<float>, group int, key string"
NAMES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def same(vec_id, label):
    return label


def brute(rows, every=10, k=5, scale=256, low=80):
    rows = [(i, c, [int(np.floor(np.float64(x) * scale)) for x in np.array(v, np.float32)]) for i, c, v, *_ in rows if i is not None and c is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max([len(v) for *_, v in rows], default=0)
    rows = [(i, c, v + [0] * (width - len(v))) for i, c, v in rows]
    out, done = [], set()
    for i, c, v in rows:
        if i % every or (i, c, tuple(v)) in done:
            continue
        done.add((i, c, tuple(v)))
        scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), j, d) for j, d, w in rows if j != i]
        for p, j, _ in sorted(x for x in scored if x[2] == c)[:k]:
            fit = sorted((n, m) for n, m, d in scored if d != c and low * -p <= 100 * -n <= 100 * -p)
            out += [(i, j, r + 1, m, -p, -n) for r, (n, m) in enumerate(fit[:k])]
    return sorted(out)


def found(spark, rows, **more):
    frame = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA)
    return sorted(tuple(r[n] for n in NAMES) for r in hn.mine(frame, same, every=10, **more).collect())


def clustered(n, seed=1, width=6, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (8, width))
    return [(i, int(rng.integers(labels)), (centres[rng.integers(8)] + rng.normal(0, 0.3, width)).tolist()) for i in range(n)]


def test_clusters_in_many_groups_and_slices(spark, monkeypatch):
    rows = clustered(700)
    monkeypatch.setattr(hn, "MOST", 8)
    monkeypatch.setattr(hn, "BLOCK", 32)
    assert found(spark, rows, group=10, slice_rows=150) == brute(rows)
    monkeypatch.setattr(hn, "MOST_TASKS", 3)
    assert found(spark, rows, group=10, slice_rows=150) == brute(rows)


def test_bounds_spare_groups(spark):
    """Far clusters do not meet: fewer rows are sent than rows times groups."""
    rng = np.random.default_rng(2)
    centres = np.eye(6) * 4
    rows = [(i, i % 2, (centres[i % 6] + rng.normal(0, 0.02, 6)).tolist()) for i in range(600)]
    sent = []
    routed = hn._routed
    try:
        hn._routed = lambda *a, **b: sent.append(out := routed(*a, **b)) or out
        assert found(spark, rows, group=10) == brute(rows)
    finally:
        hn._routed = routed
    assert len(sent) == 2 and all(0 < s.count() < 0.6 * 600 * 6 for s in sent)


def test_ties_repeats_nulls_and_odd_vectors(spark):
    one, two = [1.0, 0.0, 0.5], [0.9, 0.1, 0.5]
    rows = [(i, i % 2, one) for i in range(25)] + [(30, 0, two), (30, 0, two), (30, 1, two), (40, 0, [0.0, 0.0, 0.0]), (50, 1, [2.0]), (51, 1, [])]
    rows += [(60, None, one), (None, 1, one), (70, 1, None), (80, 1, [float("nan"), 1.0, 1.0]), (90, 0, [float("inf"), 0.0, 0.0]), (100, 0, [None, 1.0, 1.0]), (110, 0, [-1.0, -1.0, -1.0])]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, group=1, slice_rows=5) == brute(rows)


def test_no_rows_no_anchors_no_positives(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, 0, [1.0]), (2, 0, [1.0])]) == []
    assert found(spark, [(10, 0, [1.0]), (2, 1, [1.0])]) == []
    assert found(spark, [(10, 0, [1.0]), (11, 0, [-1.0]), (2, 1, [-1.0])]) == []


def test_large_numbers_keep_exact_products(spark, monkeypatch):
    rows = [(i, i % 3, [float(2**20 + i), float(i), 1.0]) for i in range(40)]
    monkeypatch.setattr(hn, "_EXACT", 0.0)
    assert found(spark, rows) == brute(rows)


def test_first_keeps_the_best():
    rng = np.random.default_rng(3)
    first, held = hn.First(5, 3), []
    for _ in range(30):
        keys, scores, ids = rng.integers(5, size=20000), rng.integers(-50, 50, size=20000), rng.integers(10**6, size=20000)
        keep = scores >= first.least[keys]
        first.add(keys[keep], scores[keep], ids[keep])
        held += zip(keys.tolist(), (-scores).tolist(), ids.tolist(), strict=True)
    got = sorted(zip(*(x.tolist() for x in first.rows()), strict=True))
    want = [x for k in range(5) for x in sorted(h for h in held if h[0] == k)[:3]]
    assert sorted((k, -s, i) for k, s, i in got) == sorted(want)


@pytest.mark.parametrize("low", [80, 0])
def test_other_bands(spark, low):
    rows = clustered(200, seed=5)
    assert found(spark, rows, low=low, k=3) == brute(rows, low=low, k=3)
