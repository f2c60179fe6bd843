"""Top k over blocks of postings against the plain join, and what it spares."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolex.operators import dense_index as dx
from chronolex.operators import index as ix
from chronolex.operators import retrieve as rt


def corpus(spark, n, seed=0, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    weight = [1 / (i + 1) for i in range(words)]
    rows = [(i, " ".join(rng.choices(vocabulary, weight, k=rng.randint(1, 30)))) for i in range(n)]
    return spark.createDataFrame(rows + [(n, None), (n + 1, ""), (n + 2, "w1 w1 w2"), (n + 3, "w1 w1 w2")], "chunk_id long, text string")


def questions(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "query_id long, text string")


def rows(df):
    return sorted(map(tuple, df.select("query_id", "chunk_id", "score", "rank").collect()))


QUESTIONS = ["w50 w3", "w1 w1 w2", "w0", "nothing known", "", "w40 w41 w42 w43 w0 w1", None, "w59"]


@pytest.mark.parametrize("block,levels", [(2048, 8), (16, 4)])
def test_blocks_give_the_rows_of_the_join(spark, monkeypatch, block, levels):
    monkeypatch.setattr(ix, "BLOCK", block)
    monkeypatch.setattr(ix, "LEVELS", levels)
    lex, asked = ix.lexical(corpus(spark, 300)), questions(spark, QUESTIONS)
    blocks = ix.blocks(ix.bm25_index(lex))
    assert rows(rt.block_top_k(rt.asked_terms(asked), blocks, 5)) == rows(rt.bm25(asked, lex, 5))
    idf = ix.tfidf_idf(lex)
    vectors = ix.blocks(ix.tfidf_vectors(lex, idf))
    assert rows(rt.block_top_k(rt.asked_vectors(asked, idf).withColumnRenamed("asked", "times"), vectors, 5)) == rows(rt.sparse(asked, lex, 5))
    held = blocks.agg(F.max("n"), F.sum("n")).first()
    assert held[1] == ix.bm25_index(lex).count() and held[0] <= 3 * block + 30


def test_blocks_hold_all_postings_and_hot_terms_have_many_parts(spark, monkeypatch):
    monkeypatch.setattr(ix, "BLOCK", 16)
    lex = ix.lexical(corpus(spark, 400))
    blocks = ix.blocks(ix.bm25_index(lex))
    back = blocks.select("term", F.explode(F.arrays_zip("chunk_ids", "weights")).alias("p"), "most").select("term", "p.*", "most")
    assert sorted(map(tuple, back.select("term", "chunk_ids", "weights").collect())) == sorted(map(tuple, ix.bm25_index(lex).collect()))
    assert back.filter("weights > most").count() == 0
    assert blocks.filter("term = 'w0'").agg(F.countDistinct("part")).first()[0] > 10


def test_small_corpora_with_weights_below_zero(spark):
    """Words of most chunks pull the mean idf below zero, and so their own weights."""
    chunks = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "a b c", "a b", "a b d", "a c"])], "chunk_id long, text string")
    lex, asked = ix.lexical(chunks), questions(spark, ["a d", "b c", "a"])
    assert rows(rt.block_top_k(rt.asked_terms(asked), ix.blocks(ix.bm25_index(lex)), 3)) == rows(rt.bm25(asked, lex, 3))


def test_blocks_that_cannot_matter_are_not_read(spark, monkeypatch):
    monkeypatch.setattr(ix, "BLOCK", 32)
    chunks = corpus(spark, 1500, seed=3, words=20).unionByName(spark.createDataFrame([(9000 + i, "rare rare w0") for i in range(6)], "chunk_id long, text string"))
    lex, asked = ix.lexical(chunks), rt.asked_terms(questions(spark, ["rare w0 w1"]))
    blocks, reads = ix.blocks(ix.bm25_index(lex)), []
    assert rows(rt.block_top_k(asked, blocks, 5, seeds=1, reads=reads)) == rows(rt.bm25(questions(spark, ["rare w0 w1"]), lex, 5))
    total, read = rt.blocks_read(asked, blocks, reads)
    assert total > 1500 and read < 0.5 * total


def test_postings_of_a_chunk_meet_queries_in_its_task(spark):
    lex, asked = ix.lexical(corpus(spark, 300, seed=6)), rt.asked_terms(questions(spark, ["w0 w1 w2", "w1 w3"]))
    plan = rt._by_chunk(rt._postings(ix.blocks(ix.bm25_index(lex))), 10).join(F.broadcast(asked), "term").groupBy("query_id", "chunk_id").count()._jdf.queryExecution().executedPlan().toString()
    top = plan[: plan.index("REPARTITION_BY_NUM")]
    assert top.count("Exchange hashpartitioning") == 1  # that of the postings; none of sums


def test_term_counts_need_no_shuffle(spark):
    chunks = corpus(spark, 50)
    plan = ix.term_counts(chunks)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    found = {r["chunk_id"]: ({p["term"]: p["tf"] for p in r["terms"]}, r["doc_len"]) for r in ix.term_counts(chunks).collect()}
    for r in chunks.collect():
        words = (r["text"] or "").split()
        assert found[r["chunk_id"]][0] == {w: words.count(w) for w in words} and (r["text"] is None or found[r["chunk_id"]][1] == len(words))


def test_no_chunks_no_queries(spark):
    none, some = corpus(spark, 5).limit(0), corpus(spark, 5)
    asked = questions(spark, ["w1"])
    assert rows(rt.bm25(asked, ix.lexical(none), 3)) == rows(rt.sparse(asked, ix.lexical(none), 3)) == []
    assert rows(rt.block_top_k(rt.asked_terms(asked), ix.blocks(ix.bm25_index(ix.lexical(none))), 3)) == []
    assert rows(rt.block_top_k(rt.asked_terms(asked.limit(0)), ix.blocks(ix.bm25_index(ix.lexical(some))), 3)) == []


# --- vectors ------------------------------------------------------------------------------------------
def unit(spark, x, name="chunk_id"):
    rows = [(i, v.tolist()) for i, v in enumerate(x / np.linalg.norm(x, axis=1)[:, None])]
    return spark.createDataFrame(rows, f"{name} long, {'v' if name == 'chunk_id' else 'q'} array<double>")


def clustered(n, seed=0, width=12, clusters=20):
    rng = np.random.default_rng(seed)
    return rng.normal(0, 1, (clusters, width))[rng.integers(clusters, size=n)] + rng.normal(0, 0.2, (n, width))


def recall(found, wanted):
    got, want = ({(r["query_id"], r["chunk_id"]) for r in df.collect()} for df in (found, wanted))
    return len(got & want) / len(want)


def test_cells_find_the_neighbours_of_clustered_vectors_in_few_of_them(spark):
    x = clustered(3000)
    vectors, asked = unit(spark, x), unit(spark, x[::50] + 0.01, "query_id")
    index = dx.build(vectors)
    probes = dx.calibrated(index)
    assert probes < 0.4 * len(index.centroids)
    found, exact = dx.search(asked, index, 10, probes), rt.dense(asked, vectors, 10)
    assert recall(found, exact) >= 0.9
    scores = {(r["query_id"], r["chunk_id"]): r["score"] for r in rt.dense(asked, vectors, 3000).collect()}
    assert all(r["score"] == pytest.approx(scores[r["query_id"], r["chunk_id"]], abs=2e-6) for r in found.collect())


def test_all_cells_probed_is_exact_whatever_the_parts(spark):
    x = clustered(400, seed=2)
    x[100:300] = x[100]  # a crowded cell of equal rows: ties go to the smaller id
    vectors, asked = unit(spark, x), unit(spark, x[::40], "query_id")
    index = dx.build(vectors, cells=5, part_rows=20)
    assert index.parts > 10
    key = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in df.collect())
    assert recall(dx.search(asked, index, 7, 5), rt.dense(asked, vectors, 7)) >= 0.95
    whole = dx.search(asked, index, 250, 5)
    assert key(whole) == key(rt.dense(asked, vectors, 250))


def test_written_cells_and_their_pruning(spark, tmp_path):
    x = clustered(500, seed=4)
    index = dx.build(unit(spark, x), cells=20)
    dx.write(index, f"file://{tmp_path}/dense")
    again, asked = dx.read(spark, f"file://{tmp_path}/dense"), unit(spark, x[:1], "query_id")
    rows_of = lambda i: sorted(map(tuple, dx.search(asked, i, 5, 3).collect()))
    assert rows_of(again) == rows_of(index) and len(rows_of(again)) == 5
    plan = dx._by_code(dx.probed(asked, again, 2), again, 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan


def test_codes_are_near(spark):
    x = clustered(300, seed=5)
    x /= np.linalg.norm(x, axis=1)[:, None]
    c = dx.k_means(x, 8)
    cell, code, scale = dx.encode(x, c)
    assert np.abs(c[cell] + code * scale[:, None] - x).max() <= scale.max() / 2 + 1e-12
    assert (dx.encode(c, c)[2] == 0).all()


def test_no_vectors_or_no_queries(spark):
    x = unit(spark, clustered(30))
    asked = x.withColumnsRenamed({"chunk_id": "query_id", "v": "q"})
    assert rt.dense(asked.limit(0), x, 3).collect() == rt.dense(asked, x.limit(0), 3).collect() == []
    assert dx.search(asked.limit(0), dx.build(x), 3, 2).collect() == dx.search(asked, dx.build(x.limit(0)), 3, 2).collect() == []
    assert dx.calibrated(None) == 1 and dx.calibrated(dx.build(x.limit(1))) == 1
