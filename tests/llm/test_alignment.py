"""op11: groups, links and counts of two tokenizers against plain loops over whole texts."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None,
    "",
    " ",
    "  a  b\n\n c\t d ",
    "a\r\nb  c;\r\n x\r y",
    "x　y ▁z",
    "é ﬁ \x00 <s> <|endoftext|> <0x41> a\x1cb !\x1c!",
    "a" * 3000,
    "\n\n\n",
    "\n x \n",
    "\xa0 x\xa0 y z  w",
    "日本語 テスト　です \U0001f600\U0001f44d\U0001f3fd",
    "x" * 200 + " " * 300 + "y",
    "same words here",
    "same words here",
    "The same words, here and there. " * 400,
]


def brute(texts):
    """The contract in plain loops: (n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each text."""
    import json

    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    letters, extra = {}, 0
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte <= 255:
            letters[chr(byte)] = byte
        else:
            letters[chr(256 + extra)] = byte
            extra += 1
    entry = {i: e for e, i in json.load(open(A))["model"]["vocab"].items()}
    of_a = lambda i: bytes(letters[c] for c in entry[i])
    of_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    grouped = []
    for text in texts:
        groups = []
        if text:
            ids_a, ids_b, raw = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text), (" " + text).encode()
            if b"".join(map(of_a, ids_a)) == raw == b"".join(map(of_b, ids_b)):
                ends_a, ends_b = np.cumsum([len(of_a(i)) for i in ids_a]).tolist(), np.cumsum([len(of_b(i)) for i in ids_b]).tolist()
                cuts = sorted(set(ends_a) & set(ends_b))
                x = y = 0
                for cut in cuts:
                    nx, ny = ends_a.index(cut) + 1, ends_b.index(cut) + 1
                    groups.append((ids_a[x:nx], ids_b[y:ny]))
                    x, y = nx, ny
        grouped.append(groups)
    links = [Counter((p, q) for ga, gb in groups for p in ga for q in gb) for groups in grouped]
    count = Counter(pair for of in links for pair in of)
    most = {}
    for (p, _), n in count.items():
        most[p] = max(most.get(p, 0), n)
    for groups, of in zip(grouped, links, strict=True):
        said = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        yield (
            sum(len(g[0]) for g in groups),
            sum(len(g[1]) for g in groups),
            len(groups),
            sum(of.values()),
            sum(n for pair, n in of.items() if count[pair] == most[pair[0]]),
            sum(n * count[pair] for pair, n in of.items()),
            hashlib.sha256(said.encode()).hexdigest() if said else "",
        )


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(4)
    words = ["the", "of", "Straße", "été", "hello", "world", "unbelievable", "tokenization", "x1y2", "foo_bar", "don't", "naïve"]
    return [*ODD, *(" ".join(rng.choice(words, rng.integers(1, 40))) + rng.choice(["", ".", "\n", "!\n\nAnd"]) for _ in range(80))]


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_groups_links_and_counts(spark, texts):
    from chronolex.llm.alignment import align

    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id int, text string, batch string, pairs string").repartition(5)
    got = {r["doc_id"]: tuple(r[n] for n in NAMES) for r in align(docs, A, B).collect()}
    want = list(brute(texts))
    assert [got[i] for i in range(len(texts))] == want


def test_postings_of_hot_ids_are_dealt_by_salt(spark, texts, monkeypatch):
    from chronolex.llm import alignment

    monkeypatch.setattr(alignment, "PART_BYTES", 200)
    monkeypatch.setattr(alignment, "_HELD_PAIRS", 64)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: tuple(r[n] for n in NAMES) for r in alignment.align(docs, A, B).collect()}
    assert [got[i] for i in range(len(texts))] == list(brute(texts))


def test_repeated_rows_null_ids_and_no_rows(spark):
    from chronolex.llm.alignment import align

    rows = [(1, "one two"), (1, "one two"), (None, "one"), (None, None), (2, "")]
    got = sorted((tuple(r[n] for n in ("doc_id", *NAMES)) for r in align(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect()), key=str)
    want = sorted(((i, *w) for (i, _), w in zip(rows, brute([t for _, t in rows]), strict=True)), key=str)
    assert got == want
    assert align(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []


def test_groups_of_many_tokens_are_counted_by_id(monkeypatch, texts):
    from chronolex.llm import alignment

    plain = alignment.Aligner(A, B).batch(texts)
    monkeypatch.setattr(alignment, "_WIDE", 1)
    wide = alignment.Aligner(A, B).batch(texts)
    assert (plain[0] == wide[0]).all() and plain[1] == wide[1]
    sums = [Counter(), Counter()]
    for found, into in zip((plain, wide), sums, strict=True):
        for d, p, n in zip(*(x.tolist() for x in found[2]), strict=True):
            into[d, p] += n
    assert sums[0] == sums[1]


def test_words_seen_again_after_the_memo_is_emptied(monkeypatch, texts):
    from chronolex.llm import alignment

    want = alignment.Aligner(A, B).batch(texts)
    monkeypatch.setattr(alignment, "_MEMO_UNITS", 10)
    aligner = alignment.Aligner(A, B)
    aligner.batch(texts[:40])
    got = aligner.batch(texts)
    assert (want[0] == got[0]).all() and want[1] == got[1]
