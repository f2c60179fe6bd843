"""Language model by deleted interpolation of n-gram (bigram, unigram, uniform) estimates.

p(w | u) = l2(b) c(u, w) / c(u) + l1(b) c(w) / N + l0(b) / (V + 1), where b is the bucket (a power of two) of the
context's count c(u). The weights of each bucket come from expectation-maximisation on held-out counts: one
fold of the training documents is deleted from the counts, and its bigrams are predicted by the rest.
Scores then use the counts of all training documents.

How it runs. Texts are cut once into chunks of a bounded number of tokens (numbers into the chunk's own
word list), written to the shared folder. Word counts are summed over chunks. Words that make up a
thousandth of the tokens or more, 1024 at most, are head words: the pairs of two head words, which
include every pair that is frequent at all, are counted in a table of bounded size and scored where the
text is. Each other pair of each document goes, packed, to the bucket of the pair, where its count is
known; buckets send back one sum a document. What a task holds is a chunk or a bucket, both bounded.

The table of all words is broadcast while it has at most `broadcast_words` rows (its count is checked);
beyond that each chunk gets the counts of its own words by a join, with the same results.

Words are told apart by 64-bit hashes. Null and empty texts are the end token alone. Documents without
training data (an empty training set) get base and model scores of the uniform kind with N = 0, V = 0.
"""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolex.llm.common import Interner, crc_of, discard, segments, staged, words_of

CHUNK_TOKENS = 600_000
MERGE_WORDS = 2_000_000
BUCKET_ENTRIES = 400_000
BUCKETS_PER_TASK = 8
BROADCAST_WORDS = 6_000_000
HEAD = 1024
HEAD_SHARE = 1 / 1024
CONTEXT_BUCKETS = 32
GRID = 4  # histogram steps of held-out probabilities in a factor of two
END = b"\n"  # no word holds white space
START = np.uint64(0)
_ARRAYS = ("ids", "flags", "folds", "lengths", "words", "tokens")


def word_hash(word: bytes) -> int:
    return struct.unpack("<Q", hashlib.blake2b(word, digest_size=8).digest())[0] | 1  # 0 stands for the start of a text


# --- chunks ---------------------------------------------------------------------------------------
@dataclass
class Chunk:
    """Documents' ids, null flags, folds and token counts; sorted word hashes; tokens as numbers into them."""

    ids: np.ndarray
    flags: np.ndarray
    folds: np.ndarray
    lengths: np.ndarray
    words: np.ndarray
    tokens: np.ndarray
    extra: dict = field(default_factory=dict)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(context, token, document) of every token; context -1 at the start of a document."""
        starts, doc = segments(self.lengths)
        context = np.empty(len(self.tokens), np.int64)
        context[1:] = self.tokens[:-1]
        context[starts] = -1
        return context, self.tokens, doc


def chunked(docs: DataFrame, folds: int) -> DataFrame:
    kinds = dict(zip(_ARRAYS, ("<i8", "u1", "u1", "<u4", "<u8", "<u4"), strict=True))

    def run(batches):
        from pyspark import TaskContext

        task, nth = TaskContext.get().partitionId(), 0
        interner, ids, flags, fold, texts, held = Interner(), [], [], [], [], 0

        def packed():
            nonlocal nth
            hashes = np.fromiter(map(word_hash, interner.new), np.uint64, len(interner.new))
            order = np.argsort(hashes)
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            arrays = (np.array(ids, np.int64), np.array(flags), np.array(fold), np.array([len(t) for t in texts]), hashes[order], place[np.concatenate(texts)])
            row = [pa.array([(task << 24) + nth], pa.int64())] + [pa.array([a.astype(kinds[n]).tobytes()], pa.binary()) for n, a in zip(_ARRAYS, arrays, strict=True)]
            nth += 1
            return pa.record_batch(row, ["chunk", *_ARRAYS])

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                words = words_of(text)
                words.append(END)
                texts.append(interner.numbers(words))
                ids.append(doc_id or 0)
                flags.append(doc_id is None)
                fold.append(crc_of(doc_id) % folds)
                held += len(words)
                if held >= CHUNK_TOKENS:
                    yield packed()
                    interner, ids, flags, fold, texts, held = Interner(), [], [], [], [], 0
        if ids:
            yield packed()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "chunk long, " + ", ".join(f"{n} binary" for n in _ARRAYS))


def _chunk(row) -> Chunk:
    kinds = ("<i8", "u1", "u1", "<u4", "<u8", "<u4")
    arrays = [np.frombuffer(row[n], k) for n, k in zip(_ARRAYS, kinds, strict=True)]
    c = Chunk(*(a.astype(np.int64) if a.dtype.kind != "u" or a.dtype.itemsize < 8 else a for a in arrays))
    if "seen" in row and row["seen"] is not None:
        c.extra = {"seen": np.frombuffer(row["seen"], "<i8"), "rest": np.frombuffer(row["rest"], "<i8")}
    return c


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch[n][i].as_py() for n in batch.schema.names}


# --- word counts ----------------------------------------------------------------------------------
def word_counts(chunks: DataFrame) -> DataFrame:
    """(word, seen, rest): hashes with their counts in all training documents and in those not deleted."""

    def merged(parts):
        word, seen, rest = (np.concatenate(x) for x in zip(*parts, strict=True))
        word, of = np.unique(word, return_inverse=True)
        return [(word, *(np.bincount(of, weights=x, minlength=len(word)).astype(np.int64) for x in (seen, rest)))]

    def run(batches):
        parts, held = [], 0
        for row in _rows(batches):
            c = _chunk(row)
            fold = np.repeat(c.folds, c.lengths)
            seen = np.bincount(c.tokens, weights=fold != 0, minlength=len(c.words)).astype(np.int64)
            rest = np.bincount(c.tokens, weights=fold > 1, minlength=len(c.words)).astype(np.int64)
            some = seen > 0
            parts.append((c.words[some].view(np.int64), seen[some], rest[some]))
            held += int(some.sum())
            if held > MERGE_WORDS:  # a task's chunks are summed before the shuffle, as far as memory allows
                parts = merged(parts)
                if len(parts[0][0]) > MERGE_WORDS // 2:
                    yield pa.record_batch([pa.array(x) for x in parts[0]], ["word", "seen", "rest"])
                    parts = []
                held = len(parts[0][0]) if parts else 0
        if parts:
            yield pa.record_batch([pa.array(x) for x in merged(parts)[0]], ["word", "seen", "rest"])

    per_chunk = chunks.select("chunk", *_ARRAYS).mapInArrow(run, "word long, seen long, rest long")
    return per_chunk.groupBy("word").agg(F.sum("seen").alias("seen"), F.sum("rest").alias("rest"))


@dataclass
class Words:
    """Sorted head words; all words where they are few enough, with counts; sums over all of them."""

    tokens: int
    rest_tokens: int
    distinct: int
    head: np.ndarray
    all: np.ndarray | None = None
    seen: np.ndarray | None = None
    rest: np.ndarray | None = None
    extra_starts: tuple[int, int] = (0, 0)

    def counts(self, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """(seen, rest) of the chunk's words."""
        if self.all is None:
            return c.extra["seen"], c.extra["rest"]
        if not len(self.all):
            return np.zeros(len(c.words), np.int64), np.zeros(len(c.words), np.int64)
        at = np.minimum(np.searchsorted(self.all, c.words), len(self.all) - 1)
        hit = self.all[at] == c.words
        return np.where(hit, self.seen[at], 0), np.where(hit, self.rest[at], 0)

    def numbers(self, c: Chunk) -> np.ndarray:
        """Place of the chunk's words in the table; unknown words share the place after it, the start of a text (index -1) has the next."""
        n = len(self.all)
        at = np.minimum(np.searchsorted(self.all, c.words), max(n - 1, 0))
        found = np.where(self.all[at] == c.words, at, n) if n else np.full(len(c.words), 0)
        return np.append(found, n + 1).astype(np.uint32)

    def heads(self, c: Chunk) -> np.ndarray:
        """Number among the head words of each of the chunk's words, or -1; the start of a text is the last number."""
        at = np.minimum(np.searchsorted(self.head, c.words), max(len(self.head) - 1, 0))
        out = np.where(self.head[at] == c.words, at, -1) if len(self.head) else np.full(len(c.words), -1)
        return np.append(out, len(self.head))  # index -1: the start


def with_counts(chunks: DataFrame, counts: DataFrame) -> DataFrame:
    """Chunks with `seen` and `rest`, the counts of their own words, by a join: for word tables too large to send around."""

    def listed(batches):
        for row in _rows(batches):
            words = np.frombuffer(row["words"], "<i8")
            yield pa.record_batch([pa.array(np.full(len(words), row["chunk"])), pa.array(words)], ["chunk", "word"])

    def gathered(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.iloc[np.argsort(pdf["word"].to_numpy().view(np.uint64))]
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "seen": [pdf["seen"].to_numpy("<i8").tobytes()], "rest": [pdf["rest"].to_numpy("<i8").tobytes()]})

    own = chunks.select("chunk", "words").mapInArrow(listed, "chunk long, word long").join(counts, "word", "left").fillna(0, ["seen", "rest"])
    return chunks.join(own.groupBy("chunk").applyInPandas(gathered, "chunk long, seen binary, rest binary"), "chunk")


# --- pairs ----------------------------------------------------------------------------------------
def _pack(*columns: np.ndarray) -> bytes:
    """Columns as byte planes, compressed."""
    import zstandard

    body = [struct.pack("<IB", len(columns[0]), len(columns))]
    for c in columns:
        body.append(c.dtype.str.encode().ljust(4))
        body.append(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(body))


def _unpack(packed: bytes) -> list[np.ndarray]:
    import zstandard

    body = zstandard.ZstdDecompressor().decompress(packed)
    n, columns = struct.unpack_from("<IB", body)
    at, out = 5, []
    for _ in range(columns):
        kind = np.dtype(body[at : at + 4].decode().strip())
        planes = np.frombuffer(body, np.uint8, n * kind.itemsize, at + 4).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += 4 + n * kind.itemsize
    return out


def _mix(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    from chronolex.llm.common import mix64

    return mix64(u * np.uint64(0x9E3779B97F4A7C15) + mix64(w))


def tail_entries(c: Chunk, words: Words, buckets: int):
    """(bucket, packed entries) of the pairs that aren't two head words: document, times, fold, and either the numbers of context and
    token in the table of all words, or the pair's hash and the counts of both."""
    context, token, doc = c.pairs()
    heads = words.heads(c)
    tail = (heads[context] < 0) | (heads[token] < 0)
    context, token, doc = (x[tail].astype(np.int32) for x in (context, token, doc))
    hashes = np.append(c.words, START)
    key = _mix(hashes[context], hashes[token])
    order = np.lexsort((doc, key))
    key, context, token, doc = key[order], context[order], token[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(key)))
    key, context, token, doc = key[first], context[first], token[first], doc[first]
    small = np.uint16 if len(c.ids) <= 1 << 16 else np.uint32
    columns = [doc.astype(small), np.minimum(times, 2**32 - 1).astype(np.uint32), c.folds[doc].astype(np.uint8)]
    if words.all is not None:
        number = words.numbers(c)
        columns += [number[context], number[token]]
    else:
        seen, rest = (np.append(x, y) for x, y in zip(words.counts(c), words.extra_starts, strict=True))
        columns += [key, *(x.astype(np.uint64) for x in (seen[context], rest[context], seen[token], rest[token]))]
    of = (key % np.uint64(buckets)).astype(np.int64)
    # in order of the context within a bucket: its bytes then pack well
    order = np.lexsort((columns[4] if words.all is not None else key, columns[3], of))
    held, first = np.unique(of[order], return_index=True)  # the buckets that occur: work follows the entries, not the buckets
    ends = np.append(first, len(order))[1:]
    for b, at, to in zip(held.tolist(), first.tolist(), ends.tolist(), strict=True):
        yield b, _pack(*(x[order[at:to]] for x in columns))


def opened(columns: list[np.ndarray], words: Words) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of the entries' last columns: a key of the pair, and the counts (context's seen and rest, token's seen and rest)."""
    if words.all is None:
        return columns[0], [x.astype(np.float64) for x in columns[1:]]
    context, token = columns
    seen, rest = (np.concatenate([x, [0, y]]) for x, y in zip((words.seen, words.rest), words.extra_starts, strict=True))
    key = (context.astype(np.uint64) << np.uint64(32)) | token
    return key, [x.astype(np.float64) for x in (seen[context], rest[context], seen[token], rest[token])]


def head_counts(chunks: DataFrame, words: Words) -> DataFrame:
    """(pair, seen, rest, held): counts of pairs of head words, pair = context * (heads + 1) + token."""
    sent = chunks.sparkSession.sparkContext.broadcast(words.head)

    def run(batches):
        size = len(sent.value) + 1
        total: dict[str, np.ndarray] = {}
        for row in _rows(batches):
            c = _chunk(row)
            heads = Words(0, 0, 0, sent.value).heads(c)
            context, token, doc = c.pairs()
            context, token, fold = heads[context], heads[token], c.folds[doc]
            both = (context >= 0) & (token >= 0)
            key = (context * size + token)[both]
            for name, which in (("seen", fold != 0), ("rest", fold > 1), ("held", fold == 1)):
                total[name] = total.get(name, 0) + np.bincount(key, weights=which[both], minlength=size * size)
        if total:
            some = np.flatnonzero(total["seen"])
            yield pa.record_batch([pa.array(some)] + [pa.array(total[n][some].astype(np.int64)) for n in ("seen", "rest", "held")], ["pair", "seen", "rest", "held"])

    per_task = chunks.select("chunk", *_ARRAYS).mapInArrow(run, "pair long, seen long, rest long, held long")
    return per_task.groupBy("pair").agg(*(F.sum(n).alias(n) for n in ("seen", "rest", "held")))


# --- weights --------------------------------------------------------------------------------------
def context_bucket(count: np.ndarray) -> np.ndarray:
    return np.where(count > 0, 1 + np.log2(np.maximum(count, 1)).astype(np.int64), 0)


def _grid(p: np.ndarray, floor: float) -> np.ndarray:
    """Step of log2(p / floor) in a histogram; 0 for p = 0."""
    return np.where(p > 0, 1 + np.clip(np.round((np.log2(np.maximum(p, 1e-300) / floor) + 16) * GRID), 0, 4000), 0).astype(np.int64)


def _grid_value(step: np.ndarray, floor: float) -> np.ndarray:
    return np.where(step > 0, 2.0 ** ((step - 1) / GRID - 16) * floor, 0.0)


def held_out_histogram(pair_rest, context_rest, token_rest, weight, words: Words) -> dict[tuple[int, int, int], float]:
    """Held-out tokens by (context bucket, step of the bigram estimate, step of the unigram estimate)."""
    floor = 1 / (words.distinct + 1)
    p2 = pair_rest / np.maximum(context_rest, 1)
    p1 = token_rest / max(words.rest_tokens, 1)
    key = np.stack([context_bucket(context_rest), _grid(p2, floor), _grid(p1, floor)], axis=1)
    found, of = np.unique(key, axis=0, return_inverse=True)
    return {tuple(map(int, k)): float(v) for k, v in zip(found, np.bincount(of.ravel(), weights=weight, minlength=len(found)), strict=True)}


def mixture_weights(histogram: dict[tuple[int, int, int], float], floor: float, steps: int = 200) -> np.ndarray:
    """Rows (bigram, unigram, uniform) for each context bucket by expectation-maximisation; buckets without held-out tokens take the weights of all together."""

    def em(rows: list[tuple[float, float, float]]) -> np.ndarray:
        p = np.array([(_grid_value(np.array(i), floor), _grid_value(np.array(j), floor), floor) for i, j, _ in rows], float)
        weight = np.array([r[2] for r in rows])
        mix = np.full(3, 1 / 3)
        for _ in range(steps):
            share = p * mix
            share /= share.sum(axis=1, keepdims=True)
            mix = (share * weight[:, None]).sum(axis=0) / weight.sum()
        mix = np.maximum(mix, (0, 0, 1e-9))
        return mix / mix.sum()

    everything = [(i, j, n) for (_, i, j), n in histogram.items() if n > 0]
    default = em(everything) if everything else np.array([0.0, 0.5, 0.5])
    out = np.tile(default, (64, 1))
    for b in {k[0] for k in histogram}:
        rows = [(i, j, n) for (of, i, j), n in histogram.items() if of == b and n > 0]
        if rows:
            out[b] = em(rows)
    out[0] = (0.0, *(out[0][1:] / out[0][1:].sum()))  # an unseen context has no bigram estimate
    return out


def interpolated(pair, context, token, words: Words, weights: np.ndarray) -> np.ndarray:
    """log10 p from the counts of a pair, its context and its token."""
    mix = weights[context_bucket(context)]
    p = mix[:, 0] * pair / np.maximum(context, 1) + mix[:, 1] * token / max(words.tokens, 1) + mix[:, 2] / (words.distinct + 1)
    return np.log10(p)


# --- the operator ---------------------------------------------------------------------------------
def score_documents(docs: DataFrame, folds: int = 10, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Fold 0 is held out from all counts, fold 1 from those that the weights are learnt with."""
    spark = docs.sparkSession
    context_ = spark.sparkContext
    chunks = staged(chunked(docs, folds), "lm-chunks", "zstd")
    counts = staged(word_counts(chunks), "lm-words")
    total = counts.agg(F.count(F.lit(1)).alias("v"), F.sum("seen").alias("n"), F.sum("rest").alias("r")).first()
    n, v = total["n"] or 0, total["v"]
    top = counts.filter(F.col("seen") >= max(1, n * HEAD_SHARE)).orderBy(F.desc("seen"), "word").limit(HEAD).select("word").collect()
    words = Words(n, total["r"] or 0, v, np.sort(np.array([r["word"] for r in top], np.int64).view(np.uint64)))
    if v <= broadcast_words:
        known = counts.toArrow()
        order = np.argsort(known["word"].to_numpy().view(np.uint64))
        narrow = np.int32 if n < 1 << 31 else np.int64
        words.all = known["word"].to_numpy().view(np.uint64)[order]
        words.seen, words.rest = (known[c].to_numpy()[order].astype(narrow) for c in ("seen", "rest"))
        del known, order
    else:
        chunks = staged(with_counts(chunks, counts), "lm-counted-chunks", "zstd")
    # every document starts once, and ends once: the starts are counted as the end tokens are
    ends = counts.filter(F.col("word") == int(np.uint64(word_hash(END)).view(np.int64))).first()
    words.extra_starts = (ends["seen"], ends["rest"]) if ends else (0, 0)
    sent = context_.broadcast(words)
    names = [c for c in ("chunk", *_ARRAYS, "seen", "rest") if c in chunks.columns]

    size = len(words.head) + 1
    heads = np.zeros((3, size * size), np.int64)
    for r in head_counts(chunks, words).collect():  # pairs of head words: a bounded table
        heads[:, r["pair"]] = r["seen"], r["rest"], r["held"]
    by_head = counts.join(F.broadcast(spark.createDataFrame(top, "word long")), "word").collect() if top else []
    own = {np.int64(r["word"]).view(np.uint64): (r["seen"], r["rest"]) for r in by_head}
    head_own = np.array([own[w] for w in words.head] + [words.extra_starts], np.int64).reshape(size, 2)

    tasks = max(1, -(-n // (BUCKET_ENTRIES * BUCKETS_PER_TASK)))
    buckets = tasks * BUCKETS_PER_TASK

    def to_buckets(rows):
        for row in rows:
            row = row.asDict()
            for b, packed in tail_entries(_chunk(row), sent.value, buckets):
                yield b, (row["chunk"], packed)

    dealt = chunks.select(*names).rdd.mapPartitions(to_buckets).partitionBy(tasks)

    def entries_of(rows):
        """Per bucket: columns over all its entries, with the pair's counts; and runs of chunks."""
        held: dict[int, list] = {}
        for b, x in rows:
            held.setdefault(b, []).append(x)
        for b in sorted(held):
            parts = [_unpack(p) for _, p in held[b]]
            chunk = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
            held[b] = [(c, None) for c, _ in held[b]]
            doc, times, fold, *own = (np.concatenate(c) for c in zip(*parts, strict=True))
            del parts
            key, own = opened(own, sent.value)
            _, of = np.unique(key, return_inverse=True)
            times = times.astype(np.float64)
            seen = np.bincount(of, weights=times * (fold != 0))[of]
            rest = np.bincount(of, weights=times * (fold > 1))[of]
            yield [c for c, _ in held[b]], chunk, doc.astype(np.int64), times, fold, seen, rest, own
            held[b] = []

    def histogram(rows):
        found: dict = {}
        for _, _, _, times, fold, _, rest, (_, context_rest, _, token_rest) in entries_of(rows):
            some = fold == 1
            for k, x in held_out_histogram(rest[some], context_rest[some], token_rest[some], times[some], sent.value).items():
                found[k] = found.get(k, 0) + x
        yield from found.items()

    held_out = dict(dealt.mapPartitions(histogram).reduceByKey(lambda a, b: a + b).collect())  # cells of a fixed grid
    context, token = np.divmod(np.flatnonzero(heads[2]), size)
    if len(context):
        some = context * size + token
        for k, x in held_out_histogram(heads[1][some].astype(float), head_own[context, 1].astype(float), head_own[token, 1].astype(float), heads[2][some].astype(float), words).items():
            held_out[k] = held_out.get(k, 0) + x
    weights = mixture_weights(held_out, 1 / (v + 1))

    def sums(rows):
        found: dict[int, np.ndarray] = {}
        for names_, chunk, doc, times, _, seen, _, (context_seen, _, token_seen, _) in entries_of(rows):
            value = times * interpolated(seen, context_seen, token_seen, sent.value, weights)
            cuts = np.searchsorted(chunk, np.arange(len(names_) + 1))
            for i, c in enumerate(names_):
                some = slice(cuts[i], cuts[i + 1])
                part = np.bincount(doc[some], weights=value[some])
                had = found.get(c, np.empty(0))
                longer, shorter = (part, had) if len(part) >= len(had) else (had, part)
                longer[: len(shorter)] += shorter
                found[c] = longer
        yield from found.items()

    def add(a, b):
        longer, shorter = (a, b) if len(a) >= len(b) else (b, a)
        longer = longer.copy()
        longer[: len(shorter)] += shorter
        return longer

    parts = dealt.mapPartitions(sums).reduceByKey(add, tasks).map(lambda x: (x[0], bytearray(x[1].tobytes())))
    parts = spark.createDataFrame(parts, "chunk long, part binary")
    grid = np.arange(size * size)
    head_log = interpolated(heads[0].astype(float), head_own[grid // size, 0], head_own[grid % size, 0].astype(float), words, weights)
    head_log = context_.broadcast(head_log)

    def here(batches):
        for row in _rows(batches):
            c, words = _chunk(row), sent.value
            seen, _ = words.counts(c)
            starts, doc = segments(c.lengths)
            base = np.log10((seen + 0.1) / (words.tokens + 0.1 * (words.distinct + 1)))
            in_heads = words.heads(c)
            context, token, _ = c.pairs()
            hc, ht = in_heads[context], in_heads[token]
            head = np.where((hc >= 0) & (ht >= 0), head_log.value[np.maximum(hc, 0) * (len(words.head) + 1) + np.maximum(ht, 0)], 0.0)
            per = lambda x: np.bincount(doc, weights=x, minlength=len(c.ids))
            made = (c.ids, c.flags, c.folds, c.lengths, per(seen[c.tokens] > 0).astype(np.int64), per(base[c.tokens]), per(head))
            yield pa.record_batch([pa.array([row["chunk"]]), pa.array([_pack(*made)], pa.binary())], ["chunk", "made"])

    def finished(batches):
        for row in _rows(batches):
            ids, flags, fold, lengths, known, base, score = _unpack(row["made"])
            part = np.frombuffer(row["part"], np.float64) if row["part"] is not None else np.empty(0)
            score = score.copy()
            score[: len(part)] += part
            columns = [pa.array(ids, mask=flags.astype(bool)), pa.array(fold == 0), pa.array(lengths), pa.array(known), pa.array(np.full(len(ids), n)), pa.array(base), pa.array(score)]
            yield pa.record_batch(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    made = chunks.select(*names).mapInArrow(here, "chunk long, made binary").join(parts, "chunk", "left")
    return made.mapInArrow(finished, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
