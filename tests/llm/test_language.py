"""op13: held-out accuracy, scores against plain loops over subwords, rejection, and the defined edge cases."""

import zlib

import numpy as np

from chronolex.llm import language as lg

WORDS = {
    "aa": ["kala", "makara", "tala", "nakal", "raka", "lakata", "manara"],
    "bb": ["stren", "grelt", "ferst", "trengel", "selt", "drest", "brengst"],
    "cc": ["ouille", "soupou", "mouil", "poule", "louso", "bouli", "souple"],
}


def corpus(n, seed=0, most=40):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        lang = list(WORDS)[int(rng.integers(3))]
        rows.append((i, " ".join(rng.choice(WORDS[lang], int(rng.integers(1, most)))).capitalize() + ".", lang, "s"))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, bucket string")


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_held_out_accuracy_and_edges(spark):
    rows = corpus(300)
    odd = [None, "", "  \n", "123 456 !!", "½ Ⅷ ²", "ÉÀ", "一二三 漢字", "x" * 100_000, "kala " * 50_000]
    rows += [(1000 + i, t, "aa" if i % 2 else None, None) for i, t in enumerate(odd)]
    got = {r["doc_id"]: r for r in lg.identify(frame(spark, rows), sample=200).collect()}
    assert len(got) == len(rows)
    for i, text, lang, _ in rows:
        assert got[i]["held_out"] == held(i)
        if i >= 1000:
            blank = not any(c.isalpha() for c in text or "")
            assert (got[i]["lang_pred"] == "und") == blank
            assert not blank or (got[i]["score"] == 0 and got[i]["rejected"])
        assert 0 <= got[i]["score"] <= 1 and got[i]["lang_pred"] in {*WORDS, "und"}
    tested = [i for i, *_ in rows if held(i) and i < 1000]
    assert np.mean([got[i]["lang_pred"] == rows[i][2] for i in tested]) >= 0.97


def test_labels_of_the_held_out_fold_and_ids_change_nothing(spark):
    rows = corpus(120, seed=3)
    one = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in lg.identify(frame(spark, rows)).collect()}
    other = [(i, t, "zz" if held(i) else c, "other") for i, t, c, _ in rows]
    assert one == {r["doc_id"]: (r["lang_pred"], r["score"]) for r in lg.identify(frame(spark, other).repartition(7)).collect()}


def test_scores_are_those_of_plain_loops(spark):
    rows = corpus(60, seed=5)
    docs = frame(spark, rows)
    model = lg.fit(docs)
    table = model.table().astype(np.float64)
    for r in lg.predicted(docs, model).collect():
        grams = []
        for token in rows[r["doc_id"]][1].lower().rstrip(".").split():
            marked = f"<{token}>"
            grams += [marked, *(marked[i : i + n] for n in range(1, 5) for i in range(len(marked) - n + 1))]
        margin = np.mean([table[zlib.crc32(g.encode()) % lg.BUCKETS] for g in grams], axis=0) + model.bias
        p = np.exp(margin / model.temperature)
        p /= p.sum()
        assert r["lang_pred"] == model.names[int(p.argmax())] and abs(r["score"] - p.max()) < 1e-6


def test_gradient_descent_lowers_the_loss():
    rng = np.random.default_rng(1)
    labels = rng.integers(3, size=90)
    rows = lg.Rows.of([(np.unique(rng.integers(100 * c, 100 * c + 60, 30)), np.ones(0)) for c in labels])
    rows.share = np.ones(len(rows.row)) / np.bincount(rows.row)[rows.row]
    model = lg.train(rows, labels, ["a", "b", "c"], epochs=30)
    assert (model.margins(rows).argmax(axis=1) == labels).all()


def test_rejection_bounds_the_errors():
    rng = np.random.default_rng(2)
    n, labels = 4000, rng.integers(2, size=4000)
    sure = rng.uniform(-6, 6, n)  # true log odds: half of the rows are hard to tell
    labels = (rng.uniform(size=n) < 1 / (1 + np.exp(-sure))).astype(int)
    model = lg.Model(["a", "b"], np.zeros((lg.BUCKETS, lg.DIM)), np.zeros((lg.DIM, 2)), np.zeros(2))
    model.margins = lambda x: np.stack([np.zeros(n), 2.5 * sure], axis=1)  # over-confident
    rows = lg.Rows(n, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    lg.calibrate(model, rows, labels, errors=0.05)
    assert 2.0 < model.temperature < 3.2
    p = lg.softmax(model.margins(rows) / model.temperature)
    taken = p.max(axis=1) >= model.bound
    assert 0.1 < taken.mean() < 0.9 and (p.argmax(axis=1) != labels)[taken].mean() <= 0.05


def test_bounds_of_the_sample(spark):
    rows = corpus(200, seed=7)
    rows += [(5000 + i, "solo mio", "dd", "s") for i in range(3)]
    small = lg.fit(frame(spark, rows), sample=12)
    assert len(small.names) == 4  # languages take turns, so that the rare one is learnt
    assert lg.fit(frame(spark, rows), sample_bytes=0).names == []
    assert lg.fit(frame(spark, rows + rows[:50])).temperature == lg.fit(frame(spark, rows)).temperature


def test_nothing_to_learn_from(spark):
    rows = [(1, "kala", None, "s"), (2, None, "aa", "s")]
    assert [(r["lang_pred"], r["score"], r["rejected"]) for r in lg.identify(frame(spark, rows)).collect()] == [("und", 0.0, True)] * 2
    assert lg.identify(frame(spark, [])).collect() == []
