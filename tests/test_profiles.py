"""Top k by profiles of common words: the rows of the plain join, and far fewer of them on the way."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolex.config import EngineConfig
from chronolex.operators import index as ix
from chronolex.operators import retrieve as rt


def corpus(spark, n, seed):
    """Notices that differ in a number and few words, and questions of their common words and a number."""
    rng = random.Random(seed)
    texts = [(f"{i}_0", f"the act {i % 150} shall come into force on {rng.choice(['monday', 'friday', 'friday late'])}" + " the end" * rng.randint(0, 1)) for i in range(n)]
    asked = [(q, f"the act {rng.choice([q, 5000])} shall come" + rng.choice(["", " the", " in sunshine"])) for q in range(40)]
    return spark.createDataFrame(texts, "chunk_id string, text string"), spark.createDataFrame(asked, "query_id int, text string")


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("kind", ["bm25", "sparse"])
def test_profiles_give_the_rows_of_the_join(spark, kind, seed):
    chunks, queries = corpus(spark, 400, seed)
    lex = ix.lexical(chunks)
    rows = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 5)) for r in df.collect())
    want = rows(getattr(rt, kind)(queries, lex, 7))
    assert rows(getattr(rt, f"{kind}_by_profile")(queries, lex, 7, common=20)) == want and want


def test_alike_chunks_make_few_rows(spark, monkeypatch):
    """The score of 400 chunks in six profiles is made once a profile and kind of question, not for each of 40 questions and chunks."""
    chunks, queries = corpus(spark, 400, 3)
    lex, made = ix.lexical(chunks), {}
    kept = rt.staged
    monkeypatch.setattr(rt, "staged", lambda df, name: made.setdefault(name, kept(df, name)))
    rt.bm25_by_profile(queries, lex, 7, common=20).count()
    assert 0 < made["alike"].count() <= 60
    assert made["firsts"].groupBy("profile").count().agg(F.max("count")).first()[0] == 7


def test_parts_of_chunks_follow_the_sums_that_they_hold(spark, monkeypatch):
    """Four hundred chunks asked by forty queries in parts of at most a hundred sums: enough parts, whatever the bytes."""
    chunks, _ = corpus(spark, 400, 4)
    lex = ix.lexical(chunks)
    monkeypatch.setattr(ix, "SUMS", 100)
    assert lex.postings(by_chunk=40).rdd.getNumPartitions() == 160


def test_queries_of_one_vector_are_searched_once(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "chunk_id long, v array<double>")
    queries = spark.createDataFrame([(i, [float(c) for c in x[i % 3]]) for i in range(30)], "query_id long, q array<double>")
    sent, scores = [], rt._block_scores
    monkeypatch.setattr(rt, "_block_scores", lambda asked, *rest: sent.append(asked.count()) or scores(asked, *rest))
    got = sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in rt.dense(queries, vectors, 5).collect())
    want = []
    for i in range(30):
        each = np.round(x @ x[i % 3], 6)
        best = sorted((c for c in range(60) if each[c] > 0), key=lambda c: (-each[c], c))[:5]
        want += [(i, n + 1, c) for n, c in enumerate(best)]
    assert got == sorted(want) and sum(sent) == 3


def test_alike_rows_in_small_files_are_not_sent_through_the_driver(spark):
    from chronolex.operators import engine
    from chronolex.staging import staged

    queries = spark.createDataFrame([(1, "bank")], "query_id long, text string")
    engine.lists(queries, spark.createDataFrame([("1_0", "the bank")], "chunk_id string, text string"), EngineConfig(use_sparse=False))
    alike = staged(spark.range(300_000).selectExpr("id % 7 AS k", "'the same text of every row that is held' AS text"), "alike")
    plan = alike.join(spark.range(400_000).selectExpr("id AS k"), "k")._jdf.queryExecution().sparkPlan().toString()
    assert "Broadcast" not in plan.replace("broadcast=false", "")
