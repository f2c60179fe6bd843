"""An updated index holds what one built anew holds, whatever came, changed, went or failed on the way."""

import random

import pytest
from pyspark.sql import functions as F

from chronolex.operators import index as ix
from chronolex.operators import retrieve as rt
from chronolex.sources import corpus, incremental

SCHEMA = "document_id string, hash string, text string, error string"


def frame(spark, docs, failed=()):
    return spark.createDataFrame([(i, str(hash(t)), None if i in failed else t, "no reader" if i in failed else None) for i, t in docs.items()], SCHEMA)


def rows(df):
    return sorted(map(str, df.collect()))


def same_index(spark, path, docs):
    anew = incremental.whole_texts(frame(spark, docs))
    assert rows(incremental.current_chunks(spark, path)) == rows(anew.select("document_id", "chunk_id", "text"))
    lex, new = incremental.current_lexical(spark, path), ix.lexical(anew)
    assert rows(lex.counts.select("chunk_id", "doc_len", "terms")) == rows(new.counts.select("chunk_id", "doc_len", "terms"))
    assert rows(lex.vocabulary) == rows(new.vocabulary) and (lex.n, lex.avgdl) == (new.n, new.avgdl)
    asked = spark.createDataFrame([(1, "w1 w2 w3")], "query_id int, text string")
    assert rows(rt.bm25(asked, lex, 5)) == rows(rt.bm25(asked, new, 5))


def test_updates_equal_a_rebuild(spark, tmp_path):
    rng, path = random.Random(1), f"file://{tmp_path}/index"
    text = lambda: " ".join(rng.choices([f"w{i}" for i in range(12)], k=rng.randint(1, 9)))
    docs = {f"d{i}": text() for i in range(20)}
    assert incremental.update(frame(spark, docs), path) == {"added": 20}
    same_index(spark, path, docs)
    for step in range(3):
        for i in rng.sample(sorted(docs), 3):
            docs[i] = text() + f" step{step}"
        for i in rng.sample(sorted(docs), 2):
            del docs[i]
        docs[f"new{step}"] = text()
        said = incremental.update(frame(spark, docs), path)
        assert said["added"] == 1 and said["removed"] == 2 and 1 <= said["changed"] <= 3
        same_index(spark, path, docs)
    docs["d_back"] = docs.pop(sorted(docs)[0])
    incremental.update(frame(spark, docs), path)
    again = incremental.update(frame(spark, docs), path)
    assert again == {"same": len(docs)}
    same_index(spark, path, docs)
    incremental.compacted(spark, path, f"file://{tmp_path}/one")
    same_index(spark, f"file://{tmp_path}/one", docs)
    docs["after"] = "w1 w1"
    assert incremental.update(frame(spark, docs), f"file://{tmp_path}/one")["added"] == 1
    same_index(spark, f"file://{tmp_path}/one", docs)


def test_a_document_that_comes_back(spark, tmp_path):
    path, one, two = f"file://{tmp_path}/index", {"a": "x y", "b": "z"}, {"a": "x y"}
    for docs in (one, two, one):
        incremental.update(frame(spark, docs), path)
        same_index(spark, path, docs)


def test_failures_are_rows_and_keep_the_former_chunks(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    assert incremental.update(frame(spark, {"a": "one", "b": "two"}, {"b"}), path) == {"added": 1, "failed": 1}
    assert rows(incremental.failures(spark, path)) == ["Row(document_id='b', error='no reader')"]
    same_index(spark, path, {"a": "one"})
    incremental.update(frame(spark, {"a": "uno", "b": "two"}, {"a"}), path)
    same_index(spark, path, {"a": "one", "b": "two"})  # a keeps what it had, b was tried again
    assert incremental.update(frame(spark, {"a": "uno", "b": "two"}), path) == {"changed": 1, "same": 1}
    same_index(spark, path, {"a": "uno", "b": "two"})


def test_an_update_that_breaks_off_counts_for_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    incremental.update(frame(spark, {"a": "one"}), path)
    with pytest.raises(RuntimeError):
        incremental.update(frame(spark, {"a": "two", "b": "x"}), path, lambda d: (_ for _ in ()).throw(RuntimeError))
    chunks = spark.createDataFrame([("b", "b_0", "left behind")], "document_id string, chunk_id string, text string")
    chunks.write.parquet(f"{path}/chunks/generation=1")
    assert rows(incremental.current_chunks(spark, path)) == ["Row(document_id='a', chunk_id='a_0', text='one')"]
    incremental.update(frame(spark, {"a": "two"}), path)
    same_index(spark, path, {"a": "two"})


def test_files_to_documents_and_lines_without_one(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("first page\fsecond")
    (tmp_path / "in" / "b.pdf").write_bytes(b"%PDF")
    files = corpus.corpus_files(spark, f"file://{tmp_path}/in")
    docs = incremental.documents_of(corpus.text_pages(files), files)
    path = f"file://{tmp_path}/index"
    assert incremental.update(docs, path) == {"added": 1, "failed": 1}
    assert incremental.current_chunks(spark, path).first()["text"] == "first page\fsecond" and "no reader" in incremental.failures(spark, path).first()["error"]
    spark.createDataFrame([("h1",), ("h2",), (None,)], "file_hash string").write.json(f"file://{tmp_path}/m")
    spark.createDataFrame([("h1", "x")], "document_id string, text string").write.parquet(f"file://{tmp_path}/d")
    assert corpus.processed_documents(spark, f"file://{tmp_path}/m", f"file://{tmp_path}/d").count() == 1
    warned = corpus.unprocessed_lines(spark, f"file://{tmp_path}/m", f"file://{tmp_path}/d").select(F.col("warning")).collect()
    assert len(warned) == 2 and any("h2" in r["warning"] for r in warned)


def test_no_index(spark, tmp_path):
    with pytest.raises(ValueError):
        incremental.current_chunks(spark, f"file://{tmp_path}/none")
    assert incremental.update(frame(spark, {"a": "x"}).limit(0), f"file://{tmp_path}/index") == {}
