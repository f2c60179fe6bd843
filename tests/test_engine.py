"""Questions end to end over a small corpus of versioned notices."""

import pytest
from pyspark.sql import functions as F

from chronolex.config import EngineConfig
from chronolex.operators import engine, index

NOTICES = [
    ("d1_0", "The deposit rule is effective on the 01/01/2020 and every bank shall keep a reserve of ten percent."),
    ("d2_0", "The deposit rule is effective on the 01/01/2023 and every bank shall hold a larger reserve of twelve percent."),
    ("d3_0", "Fishing permits are issued by the harbour office and must be renewed each spring season."),
    ("d4_0", "The deposit order was repealed and the reserve of any bank is no longer governed by it at all."),
]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, t, [(t, 0, len(t.encode()), 1, "paragraph", 0.9)], ["en"], ["paragraph"]) for i, t in NOTICES]
    return spark.createDataFrame(rows, "chunk_id string, text string, spans array<struct<text:string,byte_start:int,byte_end:int,page_num:int,section_type:string,confidence:double>>, languages array<string>, section_types array<string>")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "deposit reserve bank percent"), (2, "fishing permits harbour"), (3, "zzz")], "query_id int, text string")




def DAY(d):
    return F.lit(d).cast("timestamp_ntz")


CONFIG = EngineConfig(min_evidence_spans=1)


def test_ask(spark, corpus, queries):
    got = {r["query_id"]: r for r in engine.ask(queries, corpus, DAY("2024-06-01"), CONFIG).collect()}
    assert set(got) == {1, 2, 3} and got[3]["refusal_code"] == "verification" and got[3]["answer"] == "" and got[3]["citations"] == []
    assert "Fishing permits" in got[2]["answer"] and "[1]" in got[2]["answer"] and len(got[2]["citations"]) == 1 and got[2]["refusal_code"] is None
    assert "twelve percent" in got[1]["answer"] and "repealed" not in got[1]["answer"] and len(got[1]["answer_hash"]) == 16
    early = {r["query_id"]: r for r in engine.ask(queries, corpus, DAY("2021-01-01"), CONFIG).collect()}
    assert "ten percent" in early[1]["answer"] and "twelve" not in early[1]["answer"]


def test_retrieve_with_components_off(spark, corpus, queries):
    full = engine.retrieve(queries, corpus, EngineConfig()).filter("query_id = 2").collect()
    assert full[0]["chunk_id"] == "d3_0" and full[0]["bm25"] > 0 and full[0]["sparse"] > 0 and full[0]["dense"] == 0
    none = EngineConfig(use_sparse=False, use_bm25=False)
    assert engine.retrieve(queries, corpus, none).count() == 0
    assert engine.retrieve(queries, corpus, EngineConfig(), languages=["hi"]).count() == 0


def test_diff(spark, corpus, queries):
    got = {r["query_id"]: r for r in engine.diff(queries, corpus, DAY("2021-01-01"), DAY("2024-06-01"), CONFIG).collect()}
    assert got[1]["hash_changed"] and got[1]["added"] == ["d2_0_0"] and "d1_0_0" in got[1]["retained"] + got[1]["removed"]
    assert any(x.startswith("+") and "twelve" in x for x in got[1]["text_diff"])
    assert not got[2]["hash_changed"] and got[2]["retained"] == ["d3_0_0"] and got[2]["text_diff"] == [] and got[3]["old_span_count"] == 0


def test_written_indices(spark, corpus, queries, tmp_path):
    from chronolex.operators import retrieve

    said = index.write_indices(corpus.select("chunk_id", "text"), None, f"file://{tmp_path}/ix")
    assert set(said.values()) == {"ok"}
    read = index.read_indices(spark, f"file://{tmp_path}/ix")
    assert set(read) == {"chunks", "bm25", "tfidf_idf", "tfidf", "bm25_blocks", "tfidf_blocks"}
    rows, lex = lambda df: sorted(map(tuple, df.select("query_id", "chunk_id", "score").collect())), index.lexical(corpus)
    assert rows(retrieve.bm25(queries, None, 3, read["bm25"])) == rows(retrieve.bm25(queries, lex, 3))
    assert rows(retrieve.sparse(queries, None, 3, (read["tfidf_idf"], read["tfidf"]))) == rows(retrieve.sparse(queries, lex, 3))
    assert rows(retrieve.block_top_k(retrieve.asked_terms(queries), read["bm25_blocks"], 3)) == rows(retrieve.bm25(queries, lex, 3))
    asked = retrieve.asked_vectors(queries, read["tfidf_idf"]).withColumnRenamed("asked", "times")
    assert rows(retrieve.block_top_k(asked, read["tfidf_blocks"], 3)) == rows(retrieve.sparse(queries, lex, 3))
    with pytest.raises(ValueError):
        index.write_indices(corpus.limit(0), None, f"file://{tmp_path}/none")
    broken = index.write_indices(corpus.select("chunk_id", "text"), corpus.select("chunk_id"), f"file://{tmp_path}/part")
    assert broken["bm25"] == "ok" and broken["dense"] != "ok"
