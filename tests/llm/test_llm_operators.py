"""The operators against brute force, exact round trips and the defined results of edge cases."""

import base64
import hashlib
import random
import re
import string
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = [None, "", " \t\n", "one", "One two", "a b c", "a b c", "É ▁ x\n\n" * 3, "word " * 3000]


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def documents(spark, texts, sources=None):
    """A documents table with an extra column and a column name that operators use inside."""
    rows = [(i, t, "en", (sources or ["s"])[i % len(sources or ["s"])], None if t is None else len(t), "extra") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node string")


def some_texts(n, seed=0):
    rng = random.Random(seed)
    words = ["".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(1, 7))) for _ in range(150)]
    out = list(EDGE)
    while len(out) < n:
        base = [rng.choice(words) for _ in range(rng.randint(1, 60))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy).capitalize())
    return out[:n]


# --- 1 ------------------------------------------------------------------------------------------------
def test_package_merge_is_optimal_under_the_limit():
    from chronolex.llm.huffman import canonical_codes, code_lengths

    for counts, limit in (([1, 1, 2, 4, 8, 16, 32, 64], 8), ([1, 1, 2, 4, 8, 16, 32, 64], 4), ([5, 0, 3], 16), ([7], 16), ([1] * 300, 9)):
        lengths = code_lengths(np.array(counts), limit).astype(int)
        used = lengths[lengths > 0]
        assert used.max() <= limit and sum(2.0**-used) <= 1
        codes = canonical_codes(lengths)
        words = {format(int(codes[i]), f"0{lengths[i]}b") for i in np.flatnonzero(lengths)}
        assert all(not a.startswith(b) for a in words for b in words if a != b)
    assert code_lengths(np.array([1, 1, 2, 4, 8, 16]), 16).tolist() == [5, 5, 4, 3, 2, 1]
    assert code_lengths(np.array([1, 1, 2, 4, 8, 16]), 3).astype(int).tolist() == [3, 3, 3, 3, 2, 2]


def test_blocks_decode_from_their_checkpoints():
    from chronolex.llm.huffman import Coder, code_lengths, read_chunks, write_chunk

    rng = np.random.default_rng(1)
    ids = rng.zipf(1.3, 5000) % 3000
    coder = Coder(code_lengths(np.bincount(ids, minlength=3000)))
    offsets, bits = coder.pack(ids, 64)
    assert (coder.unpack(offsets, bits, len(ids), 64) == ids).all()
    tail = np.frombuffer(bits, np.uint8)[int(offsets[7]) // 8 :].tobytes()  # a block in the middle, on its own
    assert (coder.unpack(np.array([int(offsets[7]) % 8]), tail, 64, 64) == ids[7 * 64 : 8 * 64]).all()
    chunk = write_chunk(coder, [1, None], [ids[:10], ids[10:]]) + b"\n"
    (names, lengths, back), = read_chunks(chunk)
    assert names == [1, None] and lengths.tolist() == [10, 4990] and (back == ids).all()
    with pytest.raises(ValueError):
        list(read_chunks(b"x" * len(chunk)))


def test_token_files(spark):
    from tokenizers import Tokenizer

    from chronolex.llm.huffman import corpus_file

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [*some_texts(60), "It's <|endoftext|>, I'LL… × ÷ İ é"]
    got = corpus_file(documents(spark, texts), path, file_ids=1000).orderBy("doc_id").collect()
    tokenizer, start = Tokenizer.from_file(path), 0
    for i, text in enumerate(texts):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert tuple(got[i]) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert corpus_file(documents(spark, []), path).count() == 0
    twice = corpus_file(documents(spark, ["a", "b"]).unionByName(documents(spark, ["a"])), path)
    assert sorted(r["start"] for r in twice.collect()) == [0, 2, 4]
    same = documents(spark, ["a b c"]).select("text").withColumn("doc_id", F.lit(None)).crossJoin(spark.range(300).select(F.lit(1).alias("x")))
    assert sorted(r["start"] for r in corpus_file(same, path, file_ids=100).collect()) == [4 * i for i in range(300)]


# --- 2 ------------------------------------------------------------------------------------------------
def test_warc_round_trip(spark):
    from chronolex.llm.warc import round_trip

    html = [None, "", "<p>x</p>", "<p>x</p>", "é" * 5000, "y" * 40000]
    pages = spark.createDataFrame([(i, None if i % 2 else f"http://h/{i}\n", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in round_trip(pages).collect()}
    for i, h in enumerate(html):
        raw = (h or "").encode()
        same = [j for j, x in enumerate(html) if (x or "") == (h or "")]
        assert got[i]["payload_bytes"] == len(raw) and got[i]["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("response", None) if i == max(same) else ("revisit", max(same)))
    assert {r["record_type"] for r in round_trip(pages, min_bytes=10).filter("payload_bytes < 10").collect()} == {"response"}
    assert round_trip(pages.limit(0)).count() == 0


def test_warc_members_with_false_magic_in_small_ranges(spark, tmp_path):
    """Stored (uncompressed) members full of gzip magic, read in ranges smaller than a member."""
    import struct

    from chronolex.llm.warc import MAGIC, read_warc, sha1_base32

    def stored(body):
        packer = zlib.compressobj(0, zlib.DEFLATED, -15)
        return MAGIC + b"\0" * 7 + packer.compress(body) + packer.flush() + struct.pack("<II", zlib.crc32(body), len(body))

    payloads = [(MAGIC + bytes([i]) * 50) * 30 for i in range(40)]
    members = []
    for i, payload in enumerate(payloads):
        block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
        members.append(stored(f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <r{i}>\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"))
    (tmp_path / "a.warc").write_bytes(b"".join(members))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = {r["record_id"]: r for r in read_warc(spark, f"file://{tmp_path}").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 40 and all(bytes(got[f"r{i}"]["payload"]) == p and got[f"r{i}"]["payload_digest"] == sha1_base32(p) for i, p in enumerate(payloads))


def test_warc_records_of_many_megabytes(spark):
    from chronolex.llm.warc import round_trip

    unit = "".join(random.Random(1).choices(string.ascii_letters + string.digits, k=50_000))
    big = [(unit * 350)[: (17 << 20) + i] for i in range(3)]
    pages = spark.createDataFrame([(i, None, h) for i, h in enumerate([*big, "a", big[0]])], "page_id long, url string, html string")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("1m", "4096"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size if size == "1m" else "65536")
        try:
            got = {r["page_id"]: r for r in round_trip(pages).collect()}
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert [got[i]["payload_bytes"] for i in range(5)] == [len(big[0]), len(big[1]), len(big[2]), 1, len(big[0])]
        assert (got[0]["record_type"], got[0]["refers_to"], got[4]["record_type"]) == ("revisit", 4, "response")
        assert all(got[i]["payload_digest"] == base64.b32encode(hashlib.sha1(h.encode()).digest()).decode() for i, h in enumerate(big))


def test_warc_pieces_at_the_start_of_a_range():
    from chronolex.llm.warc import _gzip, join_pieces, record_member

    member = record_member("r", "response", None, b"x", 1, base64.b32encode(hashlib.sha1(b"x").digest()).decode(), None)
    pieces = [_gzip(b""), member[:40], member[40:], member]
    assert [w for w, _ in join_pieces(iter(pieces))] == ["orphan", "orphan", "orphan", "record"]
    found = list(join_pieces(iter(pieces[:3]), known=True))
    assert [x and x[0] for w, x in found if w == "record"] == [None, "r"] and len(found) == 2


# --- 3 ------------------------------------------------------------------------------------------------
def brute_components(texts, k, t):
    sets = []
    for text in texts:
        w = WORD.findall(low(text))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both * t.denominator >= t.numerator * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("k", "threshold"), [(3, "9/10"), (5, "4/5"), (1, "1/2")])
def test_jaccard_join(spark, k, threshold):
    from chronolex.llm.ngram_join import jaccard_components

    texts = some_texts(150, seed=k)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(documents(spark, texts), k, threshold).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts, k, Fraction(threshold))


def test_signatures_meet_for_every_linked_pair():
    from chronolex.llm.ngram_join import bitmap, may_link, signatures

    rng = np.random.default_rng(3)
    for t in (Fraction(9, 10), Fraction(1, 2)):
        for boundary in (0, 4, 9):
            for _ in range(150):
                n = int(rng.integers(1, 14))
                a = np.sort(rng.choice(40, n, replace=False).astype(np.uint64) << np.uint64(30))
                b = a.copy()
                for _ in range(int(rng.integers(0, 3))):
                    b[int(rng.integers(0, n))] = np.uint64(int(rng.integers(0, 40))) << np.uint64(30)
                b = np.unique(b)
                both = len(np.intersect1d(a, b))
                if both * t.denominator >= t.numerator * (len(a) + len(b) - both):
                    heavy = np.sort(a[: n // 2])
                    x, y = (dict(zip(*(v.tolist() for v in signatures(s, t, boundary, heavy)), strict=True)) for s in (a, b))
                    p, q = t.numerator, t.denominator
                    assert any(min(len(a) - x[k], len(b) - y[k]) * (p + q) >= (len(a) + len(b)) * p for k in set(x) & set(y))
                    assert may_link(bitmap(a), len(a), bitmap(b), len(b), t)


def test_components_of_chains_and_stars(spark):
    from chronolex.llm.graph import components

    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 120)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(31)) and all(got[i] == 100 for i in range(100, 120))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 4 ------------------------------------------------------------------------------------------------
def test_quality_on_held_out_labels(spark):
    from chronolex.llm.quality import classify

    rng, rows, labels = random.Random(2), list(EDGE), []
    for i in range(600):
        words = [rng.choice(["the", "river", "house", "is", "old", "and", "green"]) for _ in range(40)]
        good = i % 3 > 0
        rows.append(" ".join(words).capitalize() + "." if good else " ".join(w.upper() + "!!" for w in words))
        labels.append((len(rows) - 1, int(good)))
    got = classify(documents(spark, rows), spark.createDataFrame([*labels, (10**9, 1), (None, 1)], "doc_id long, quality int"))
    got = {r["doc_id"]: r for r in got.collect()}
    held = [(got[i]["predicted"], q) for i, q in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(got) == len(rows) and all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert sum(p == q for p, q in held) >= 0.98 * len(held) and all(0 <= r["score"] <= 1 for r in got.values())
    nothing = classify(documents(spark, ["a"]), spark.createDataFrame([], "doc_id long, quality int")).first()
    assert nothing["score"] == 0.5 and nothing["predicted"] == 1


def test_pairs_in_linear_time_equal_the_double_sum():
    from chronolex.llm.quality import BUCKETS, STATISTICS, Machine, features

    rng = np.random.default_rng(0)
    size = BUCKETS + len(STATISTICS)
    m = Machine(0.3, rng.normal(size=size), rng.normal(size=(size, 8)), np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)))
    x = features(["one two two three"], [3])
    full = np.zeros(size)
    full[x.bucket], full[BUCKETS:] = x.share, np.clip(x.dense[0], -5, 5)
    at = np.flatnonzero(full)
    want = m.bias + full @ m.linear + sum(m.factors[i] @ m.factors[j] * full[i] * full[j] for n, i in enumerate(at) for j in at[:n])
    assert np.isclose(m.margin(x)[0], want)


# --- 5, 6 ---------------------------------------------------------------------------------------------
def vectors(spark, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(900, 12)) * rng.uniform(0.5, 2, (900, 1))
    x[100:300] = x[100]  # one common vector
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    rows += [(1000, None), (1020, [0.0] * 12), (1040, [float("nan")] * 12), (1060, [1.0] * 5), (1080, [float("inf")] + [0.0] * 11), (None, [1.0] * 12), (1100, [None] + [0.0] * 11)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>"), {i: np.array(r + [0.0] * (12 - len(r))) for i, r in rows if i is not None and (i < 1000 or i == 1060)}


def test_graph_search_recall_and_scores(spark):
    from chronolex.llm.pruned_graph import nearest

    df, x = vectors(spark)
    got = {}
    for r in nearest(df, shard_values=300 * 12).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    ids, matrix = np.array(list(x)), np.array(list(x.values()))
    recall = []
    for q in ids[ids % 20 == 0]:
        s = matrix @ x[q]
        want = [i for i in ids[np.lexsort((ids, -s))] if i != q][:20]
        recall.append(len({v for v, _ in got[q]} & set(want)) / 20)
        assert q not in dict(got[q]) and all(np.isclose(v, x[i] @ x[q]) for i, v in got[q])
    assert set(got) == set(ids[ids % 20 == 0].tolist()) and np.mean(recall) >= 0.9
    assert nearest(df.limit(0)).count() == 0


def test_metric_tree_is_exact(spark):
    from chronolex.llm.metric_tree import MetricTree, top_k

    df, x = vectors(spark, 1)
    ids, matrix = np.array([*x, 1020]), np.floor(np.array([*x.values(), np.zeros(12)]) * 1024).astype(np.int64)
    got = {}
    for r in top_k(df, shard_values=300 * 12).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    for q in ids[ids % 100 == 0]:
        s = matrix @ matrix[list(ids).index(q)]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:10]
        assert got[q] == [(ids[i], s[i]) for i in order]
    line = np.stack([np.arange(4000), np.zeros(4000)], axis=1) * 100
    tree = MetricTree(line)
    tree.search(np.array([399900, 0]), 5)
    assert tree.computed < 400  # bounds spare nine tenths of the distances


# --- 7 ------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("broadcast_words", [10**6, 0])
def test_language_model(spark, broadcast_words):
    from collections import Counter

    from chronolex.llm.lm import score_documents

    texts = some_texts(200, seed=5)
    got = {r["doc_id"]: r for r in score_documents(documents(spark, texts), broadcast_words=broadcast_words).collect()}
    tokens = [WORD.findall(low(t)) + ["\n"] for t in texts]
    seen = Counter(w for i, t in enumerate(tokens) if zlib.crc32(str(i).encode()) % 10 for w in t)
    n, v = sum(seen.values()), len(seen)
    for i, t in enumerate(tokens):
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(seen[w] > 0 for w in t), n)
        assert np.isclose(r["base_score"], sum(np.log10((seen[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) and r["score"] < 0
    held = [i for i in got if got[i]["held_out"]]
    assert sum(got[i]["score"] for i in held) > sum(got[i]["base_score"] for i in held)
    assert score_documents(documents(spark, [])).count() == 0


@pytest.mark.parametrize("broadcast_words", [10**6, 0])
def test_language_model_scores_against_brute_force(spark, broadcast_words):
    """Every score from counts in plain loops. The mixture weights from the histogram's rounded estimates are held
    against those from the estimates themselves."""
    from collections import Counter

    from chronolex.llm.lm import _grid, mixture_weights, score_documents

    texts = some_texts(300, seed=11) + [None, "", "seen once in a lifetime"]
    rows = {r["doc_id"]: r for r in score_documents(documents(spark, texts), broadcast_words=broadcast_words).collect()}
    tokens = [WORD.findall(low(t)) + ["\n"] for t in texts]
    fold = [zlib.crc32(str(i).encode()) % 10 for i in range(len(texts))]
    seen, rest, seen_pair, rest_pair, held = Counter(), Counter(), Counter(), Counter(), Counter()
    for f, doc in zip(fold, tokens, strict=True):
        pairs = list(zip([None, *doc], doc, strict=False))
        if f != 0:
            seen.update([None, *doc])
            seen_pair.update(pairs)
        if f > 1:
            rest.update([None, *doc])
            rest_pair.update(pairs)
        if f == 1:
            held.update(pairs)
    n, v, r = sum(seen.values()) - seen[None], len(seen) - 1, sum(rest.values()) - rest[None]
    floor, histogram, exact = 1 / (v + 1), Counter(), {}

    def bucket(count):
        return count.bit_length()

    for (u, w), times in held.items():
        p2, p1 = (rest_pair[u, w] / rest[u] if rest[u] else 0.0), rest[w] / r
        histogram[bucket(rest[u]), int(_grid(np.array(p2), floor)), int(_grid(np.array(p1), floor))] += times
        exact.setdefault(bucket(rest[u]), []).append((p2, p1, times))
    mix = mixture_weights(histogram, floor)

    def likelihood(weights, cells):
        return sum(t * np.log2(weights @ (p2, p1, floor)) for p2, p1, t in cells) / sum(t for *_, t in cells)

    for b, cells in exact.items():
        best = np.full(3, 1 / 3)
        for _ in range(200):
            total = np.zeros(3)
            for p2, p1, t in cells:
                share = best * (p2, p1, floor)
                total += t * share / share.sum()
            best = total / total.sum()
        # what rounding to quarter octaves costs, in bits of a held-out token
        assert likelihood(best, cells) - likelihood(mix[b], cells) < 0.02
    for i, doc in enumerate(tokens):
        want = 0.0
        for u, w in zip([None, *doc], doc, strict=False):
            m = mix[bucket(seen[u])]
            want += np.log10(m[0] * seen_pair[u, w] / max(seen[u], 1) + m[1] * seen[w] / n + m[2] * floor)
        assert np.isclose(rows[i]["score"], want, rtol=1e-9)


def test_mixture_weights_raise_the_likelihood():
    from chronolex.llm.lm import GRID, _grid, _grid_value, mixture_weights

    assert abs(_grid_value(_grid(np.array([0.01]), 1e-3), 1e-3)[0] / 0.01 - 1) < 1 / GRID
    a, b = int(_grid(np.array([0.5]), 1e-3)[0]), int(_grid(np.array([0.002]), 1e-3)[0])
    w = mixture_weights({(3, a, b): 90.0, (3, 0, b): 10.0, (1, 0, b): 50.0}, 1e-3)
    assert w[3][0] > 0.5 and w[1][0] < 0.01 and np.allclose(w.sum(axis=1), 1)


# --- 8 ------------------------------------------------------------------------------------------------
def test_sainte_lague_against_the_heap():
    from chronolex.llm.mixing import sainte_lague

    rng = np.random.default_rng(4)
    for _ in range(50):
        n, seats = int(rng.integers(1, 9)), int(rng.integers(0, 60))
        weights, caps = rng.integers(0, 50, n), rng.integers(0, 20, n)
        won = [0] * n
        for _ in range(seats):
            able = [i for i in range(n) if won[i] < caps[i] and weights[i] > 0]
            if not able:
                break
            won[max(able, key=lambda i: (weights[i] / (2 * won[i] + 1), -i))] += 1
        assert sainte_lague(weights, seats, caps).tolist() == won


def test_mix_meets_targets(spark):
    from chronolex.llm.mixing import mix, mixed

    texts = some_texts(600, seed=8)
    docs = documents(spark, texts, ["b", "a", None, "ü", "", "z"])
    rows = mix(docs, shard_docs=50, block=16).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mix(docs, shard_docs=50, block=16).collect()), key=str)
    size = {}
    for r in rows:
        assert r["size"] == len(WORD.findall(texts[r["doc_id"]] or "")) and 0 <= r["taken"] <= 2 * r["size"]
        size[r["source"]] = size.get(r["source"], 0) + r["size"]
    order = sorted((s for s in size if s is not None), key=str.encode) + [None]
    weight, full, left = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, set(), 1.5 * sum(size.values())
    while True:  # the excess of full sources is shared again
        level = (left - sum(2 * size[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and weight[s] * level > 2 * size[s]}
        if not over:
            break
        full |= over
    for s in order:
        target = 2 * size[s] if s in full else weight[s] * level
        mine = [r for r in rows if r["source"] == s]
        assert np.isclose(mine[0]["target"], target) and abs(sum(r["taken"] for r in mine) - target) < 16 * 8
    assert mixed(docs, shard_docs=50, block=16).columns == docs.columns
    assert mix(docs.limit(0)).count() == 0


# --- 9 ------------------------------------------------------------------------------------------------
def test_n_best_segmentations(spark):
    from chronolex.llm.pieces import Segmenter, coded, digest, n_best

    path = public_tokenizers.path("piece_bpe_32k.model")
    s, rng = Segmenter(path), random.Random(6)
    texts = ["".join(rng.choice("abcdethe  \n\té漢🙂▁\ufdd0.x") for _ in range(rng.randint(0, 25))) for _ in range(300)] + ["The theory of thing", ""]
    for text, numbers in zip(texts, s.numbers(texts), strict=True):
        whole = coded(s._cut(b" " + text.encode()) if text else [])[0]
        got, want = s.text_n_best(numbers, 4), n_best(s.model, whole, 4)  # A* over the lattice of the whole text
        assert len({tuple(ids) for _, ids in got}) == len(got)
        assert [x for x, _ in got] == [x for x, _ in want] and all(s.decode(ids) == text.encode() for _, ids in got)

    def every(text, at=0):
        if at == len(text):
            yield 0.0
        for n in range(1, len(text) - at + 1):
            piece = text[at : at + n]
            score = s.model.scores[s.model.ids[piece]] if piece in s.model.ids else s.model.fallback if n == 1 else None
            if score is not None:
                yield from (score + x for x in every(text, at + n))

    for text in ("▁hello", "▁naïve漢", "▁aaaaaaaa"):
        assert [x for x, _ in n_best(s.model, coded([text.replace("▁", " ").encode()])[0], 6)] == sorted(every(text), reverse=True)[:6]
    assert all(s.decode(ids).decode() == "a\ufdd0▁b" for _, ids in s.text_n_best(s.numbers(["a\ufdd0▁b"])[0], 3))
    rows = digest(documents(spark, EDGE), path).collect()
    assert len(rows) == len(EDGE) and all(r["round_trip"] for r in rows) and rows[0]["n_pieces"] == 0


def test_a_unit_of_a_million_characters(spark):
    from chronolex.llm.pieces import Segmenter, digest, solve

    rng, path = random.Random(4), public_tokenizers.path("piece_bpe_32k.model")
    texts = ["".join(rng.choices("abcdefghij", k=1_000_000)), "a" * 300_000 + " b " + "é▁" * 1000]
    rows = digest(documents(spark, texts), path).collect()
    assert all(r["round_trip"] and len(set(r["nbest_crc32"])) == 3 for r in rows)
    s, unit = Segmenter(path), (" " + "".join(rng.choices("ththeaes", k=2000))).encode()
    alone, together = s.unit_n_best(unit, 2), solve(s.model, [b" x", unit])  # both ways of solving agree
    assert alone[0][0] == together.score[1] and alone[0][0] - alone[1][0] == together.gap[1]
    assert list(alone[0][1]) == together.ids[together.starts[1] :].tolist()


# --- 10 -----------------------------------------------------------------------------------------------
def test_secrets(spark):
    from chronolex.llm.secrets import digest_text, redacted, secret_report  # noqa: F401

    rng = random.Random(9)
    key = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(40))
    texts = [*EDGE, "token=secret=abcdefghijklmnop", "PassWord : 'abcdef123456'", "paſſword=abcdefghijkl", "AKIA" + "A" * 14, "AKIA" + "A" * 13, "x" + "0" * 16, "é key " + key + " end", "internationalizationing of Donaudampfschifffahrtsgesellschaft", "deadbeef" * 2]
    got = {r["doc_id"]: r for r in secret_report(documents(spark, texts)).collect()}
    assign = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for i, text in enumerate(texts):
        t = text or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        text_ = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert got[i]["base_sha256"] == hashlib.sha256(text_.encode()).hexdigest()
        assert [got[i][c] for c in ("n_assign", "n_access", "n_hex")] == [sum(x[1] == k for x in spans) for k in range(3)]
    at = next(i for i, t in enumerate(texts) if t and key in t)
    assert got[at]["spans"] == f"random:6:{6 + len(key)}" and got[at + 1]["spans"] == ""
    clean = {r["doc_id"]: r["text"] for r in redacted(documents(spark, texts)).collect()}
    assert clean[at] == "é key [SECRET] end" and clean[at + 1] == texts[at + 1] and clean[0] is None
    assert secret_report(documents(spark, [])).count() == 0


def test_false_discovery_by_length():
    from chronolex.llm import secrets as S

    rng = random.Random(1)
    code = lambda text, alphabet: np.array([[alphabet.index(c) for c in text]])
    hexes = "0123456789abcdef"
    sums = [S.battery(code("".join(rng.choices(hexes, k=40)), hexes), 16)[0] for _ in range(500)]
    assert abs(np.mean(sums) - 6) < 1 and np.mean(np.array(sums) > 12.59) < 0.1 and S.battery(code("a1" * 20, hexes), 16)[0] > 100
    pairs = rng_pairs(rng)
    cells = [S.length_class(40) * len(S.ENCODINGS) + k for k in (3, 5)]
    counts = {(cells[0], 5): 4, (cells[0], 200): 50, (cells[1], 8): 3, (cells[1], 60): 20, (cells[1], 400): 100}
    # Benjamini-Hochberg run by run
    p = sorted((float(S.null_p_values(pairs, c)[step]), c, step) for (c, step), n in counts.items() for _ in range(n))
    limit = max((x[0] for k, x in enumerate(p, 1) if x[0] <= 0.01 * k / len(p)), default=-1)
    last = S.discoveries(counts, pairs)
    assert {x[1:] for x in p if x[0] <= limit} == {(c, b) for c, b in counts if b <= last.get(c, -1)} == {(cells[0], 5), (cells[1], 8)}


def rng_pairs(rng):
    """Counts of pairs of characters in texts of 300 words."""
    from chronolex.llm import secrets as S

    words = ["".join(rng.choices("etaoinshrdlucm", k=rng.randint(2, 9))) for _ in range(300)]
    kinds = S._KIND[np.frombuffer((" " + " ".join(rng.choices(words, k=5000)) + " 12 1999 ").encode(), np.uint8)]
    return np.bincount(kinds[:-1] * 37 + kinds[1:], minlength=37 * 37).reshape(37, 37)


def test_keys_are_told_from_identifiers(spark):
    """Keys outside all base patterns, and what only looks like them: recall by length, and few words among what is found."""
    from chronolex.llm.secrets import secret_report

    rng = random.Random(5)
    words = ["".join(rng.choices("etaoinshrdlucmfw", weights=range(16, 0, -1), k=rng.randint(3, 8))) for _ in range(400)]
    texts, planted = [], {}
    for i in range(1200):
        around = [" ".join(rng.choices(words, k=30)) for _ in range(2)]
        camel = "".join(w.capitalize() for w in rng.choices(words, k=9))[: rng.randint(20, 60)]
        middle = {0: camel, 1: "https://x.org/" + "/".join(rng.choices(words, k=5)) + f"/{rng.randint(1000, 9999)}", 2: "_".join(rng.choices(words, k=6)), 3: ""}[i % 4]
        if i % 4 == 3:
            n = rng.choice((24, 40, 64))
            middle = "".join(rng.choices(string.ascii_letters + string.digits, k=n))
            planted[i] = (f"random:{len(around[0]) + 1}:{len(around[0]) + 1 + n}", n)
        texts.append(f"{around[0]} {middle} {around[1]}")
    found = {r["doc_id"]: r["spans"] for r in secret_report(documents(spark, texts)).collect()}
    hit = {i for i, x in found.items() if "random" in x}
    assert all(found[i] == planted[i][0] for i in hit & set(planted)) and len(hit - set(planted)) <= 0.02 * len(hit)
    recall = {n: np.mean([i in hit for i, x in planted.items() if x[1] == n]) for n in (24, 40, 64)}
    assert recall[40] >= 0.7 and recall[64] >= 0.95, recall


# --- names and repeated ids ---------------------------------------------------------------------------
CLASHES = ("_id", "_text", "_chars", "_score", "_predicted", "_times", "_nth", "_n", "_found", "_spans", "quality", "node", "row", "key", "class", "component", "component_id", "shard", "ask", "v", "size", "taken", "target", "score", "n", "text_", "n_chars_")


def test_extra_columns_of_any_name(spark):
    import corpus_pipeline

    from chronolex.llm import huffman, lm, metric_tree, mixing, ngram_join, pieces, pruned_graph, quality, secrets, warc

    texts = some_texts(40)
    wide = lambda df: df.withColumns({c: F.lit("x") for c in CLASHES if c not in df.columns})
    docs, labels = wide(documents(spark, texts, ["a", "b"]).drop("node")), spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    byte, piece = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
    for made in (huffman.corpus_file(docs, byte), ngram_join.jaccard_components(docs), quality.classify(docs, wide(labels)), lm.score_documents(docs), mixing.mix(docs), pieces.digest(docs, piece), secrets.secret_report(docs)):
        assert made.count() == len(texts)
    pages = wide(spark.createDataFrame([(1, "u", "h"), (2, "u", "h")], "page_id long, url string, html string"))
    assert warc.round_trip(pages).count() == 2
    df = wide(vectors(spark)[0].drop("v"))
    assert pruned_graph.nearest(df).count() == 46 * 20 and metric_tree.top_k(df).count() > 0
    found = secrets.found_spans(docs)
    assert found.columns == [c for c in docs.columns if c != "text"] + ["_spans_"] and found.count() == len(texts)
    for stage in (lambda d: quality.scored(d, quality.fit(d, labels), names=("s1", "s2")).select(d.columns), secrets.redacted, mixing.mixed, lambda d: corpus_pipeline.STAGES[3][1](spark, d, "")):
        out = stage(docs)
        assert out.columns == docs.columns and out.filter("_id = 'x' AND quality = 'x'").count() == out.count() > 0
    kept = ngram_join.without_near_copies(docs)
    want = {c for _, c in brute_components(texts, 5, Fraction("4/5"))}
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(want)


def test_different_texts_under_one_id_stay(spark):
    from chronolex.llm.ngram_join import without_near_copies

    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "h i j k l m n"), (2, "h i j k l m n"), (None, "x"), (None, "x"), (3, None), (3, None)]
    left = without_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, left), key=str) == sorted([(1, "a b c d e f g"), (1, "h i j k l m n"), (None, "x"), (None, "x"), (3, None)], key=str)


def test_vectors_of_several_lengths(spark):
    from chronolex.llm.metric_tree import top_k
    from chronolex.llm.pruned_graph import nearest
    from chronolex.llm.vectors import shard_count

    df = spark.createDataFrame([(0, [1.0, 2.0]), (100, [1.0]), (3, [0.5, 0.5, 9.0]), (4, [])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in nearest(df).filter("query_id = 100").orderBy("rank").collect()] == [(100, 1, 0, 1.0), (100, 2, 3, 0.5)]
    assert [(r["vec_id"], r["score"]) for r in top_k(df).filter("query_id = 0").orderBy("rank").collect()] == [(3, 1024 * 512 + 2048 * 512), (100, 1 << 20), (4, 0)]
    assert [shard_count(n, 64) for n in (0, 500, 9000, 50_000, 10**9)] == [1, 1, 8, 8, -(-(10**9) // 65_536)]


# --- the pipeline -------------------------------------------------------------------------------------
def test_pipeline(spark, tmp_path):
    import corpus_pipeline as pipeline

    rng = random.Random(12)
    words = ["".join(rng.choice(string.ascii_lowercase) for _ in range(5)) for _ in range(500)]
    texts, labels = [], []
    for i in range(300):
        text = " ".join(rng.choice(words) for _ in range(60))
        junk = i % 6 == 0
        texts.append(" ".join(w.upper() + "!!" for w in text.split()) if junk else text.capitalize() + ".")
        labels.append((i, int(not junk)))
    texts[10] = texts[9]
    texts[20] += " api_key = 'abcdefgh12345678'"
    documents(spark, texts, ["a", "b"]).drop("node").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = [r["doc_id"] for r in docs.collect()]
    good = [i for i, q in labels if q]
    assert sorted(kept["quality classifier"]) == good and sorted(kept["n-gram Jaccard join"]) == [i for i in good if i != 10]
    assert sorted(kept["secret scan"]) == sorted(kept["n-gram Jaccard join"])
    assert not docs.filter("text LIKE '%abcdefgh12345678%'").count() and max(map(kept["source mixing"].count, kept["source mixing"])) <= 2
    last = pipeline.run(spark, str(tmp_path))
    assert last.count() == docs.count() and last.filter("NOT round_trip").count() == 0
