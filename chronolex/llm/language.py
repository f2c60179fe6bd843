"""Language identification: averaged hashed subword embeddings with a linear softmax, and calibrated rejection.

A text's words are its runs of letters and marks, lower-cased. Each gives its subwords (the word with an end mark on
both sides, and its 1 to 4 character grams), hashed to buckets; the text is the mean of its subwords' embeddings, and
a linear layer with softmax turns that into a language. Embeddings and layer are learnt together by stochastic
gradient descent in numpy.

Learning takes a bounded sample: at most `sample` rows and `sample_bytes` of features, languages in turn, those with the
smallest hash of their id first. Each row also gives a fragment of few words, so that short texts are learnt, too. A
fifth of the rows is kept from the descent: on it a temperature is fitted to the confidence, and the least confidence
from which at most `errors` of the accepted rows are wrong becomes the bound of rejection. It runs on the driver
over these bounded rows, in a fixed order and with a fixed seed. Prediction covers every document's whole text.

Texts that are null or have no letter are `und` with score 0, and rejected. Rows without a language are not learnt
from, repeated rows once each. With no row to learn from all is `und`. Ties go to the language that is first
by code point. Very long texts are read whole, in slices of a task. lang, source and doc_id are never inputs of a
prediction; other columns are not read, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolex.llm.common import ENTRY_BYTES, MEMO_BYTES, Interner, crc_fold, memo, segments, slices

BUCKETS = 1 << 15
DIM = 16
GRAMS = 4
SAMPLE, SAMPLE_BYTES = 2048, 16 << 20
ERRORS = 0.01
UNKNOWN = "und"
#: counts of subwords of a training row; one of more is shared out by the mean anyway
_MOST_COUNT = 65535
_MEMO_WORDS = 6 * MEMO_BYTES // (2 * ENTRY_BYTES)
_LETTERS = regex.compile(r"[\p{L}\p{M}]+")


def subwords(token: str) -> np.ndarray:
    """Buckets of the subwords of a token's runs of letters; none where it has no letter."""
    out = []
    for run in _LETTERS.findall(token):
        if not any(c.isalpha() for c in run):
            continue
        marked = f"<{run}>"
        out.append(marked)
        for n in range(1, GRAMS + 1):
            out += [marked[i : i + n] for i in range(len(marked) - n + 1)]
    return np.array([zlib.crc32(g.encode("utf-8", "surrogatepass")) % BUCKETS for g in out], np.int64)


@dataclass
class Rows:
    """Sparse subword shares of n texts."""

    n: int
    row: np.ndarray
    bucket: np.ndarray
    share: np.ndarray

    @classmethod
    def of(cls, counted: list[tuple[np.ndarray, np.ndarray]]) -> Rows:
        sizes = np.array([len(b) for b, _ in counted], np.int64)
        _, row = segments(sizes) if len(sizes) else (None, np.empty(0, np.int64))
        share = [c / max(c.sum(), 1) for _, c in counted]
        return cls(len(counted), row, np.concatenate([b for b, _ in counted] or [np.empty(0, np.int64)]).astype(np.int64), np.concatenate(share or [np.empty(0)]))

    def pick(self, some: np.ndarray, starts: np.ndarray) -> Rows:
        lengths = starts[some + 1] - starts[some]
        begin, row = segments(lengths)
        at = np.repeat(starts[some] - begin, lengths) + np.arange(int(lengths.sum()))
        return Rows(len(some), row, self.bucket[at], self.share[at])


@dataclass
class Model:
    names: list[str]
    embedding: np.ndarray  # of buckets
    layer: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    bound: float = 0.0

    def table(self) -> np.ndarray:
        """What a bucket adds to each language: mean, layer and embedding are linear, so they can be taken together."""
        return (self.embedding @ self.layer).astype(np.float32)

    def margins(self, x: Rows) -> np.ndarray:
        return _means(self.embedding, x) @ self.layer + self.bias


def _means(embedding: np.ndarray, x: Rows) -> np.ndarray:
    out = np.empty((x.n, embedding.shape[1]))
    for d in range(embedding.shape[1]):
        out[:, d] = np.bincount(x.row, weights=embedding[x.bucket, d] * x.share, minlength=x.n)
    return out


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(x: Rows, labels: np.ndarray, names: list[str], epochs: int = 10, rate: float = 4.0, batch: int = 16, seed: int = 11) -> Model:
    """Cross entropy by minibatches, the rate falling to zero along a line."""
    rng = np.random.default_rng(seed)
    m = Model(names, rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)), np.zeros((DIM, len(names))), np.zeros(len(names)))
    starts, steps, done = np.searchsorted(x.row, np.arange(x.n + 1)), epochs * -(-x.n // batch), 0
    for _ in range(epochs):
        order = rng.permutation(x.n)
        for at in range(0, x.n, batch):
            some = order[at : at + batch]
            b, now = x.pick(some, starts), rate * (1 - done / steps)
            hidden = _means(m.embedding, b)
            slope = softmax(hidden @ m.layer + m.bias)
            slope[np.arange(len(some)), labels[some]] -= 1
            slope /= len(some)
            back = slope @ m.layer.T
            m.layer -= now * (hidden.T @ slope)
            m.bias -= 0.1 * now * slope.sum(axis=0)
            used, where = np.unique(b.bucket, return_inverse=True)
            pull = np.empty((len(used), DIM))
            for d in range(DIM):
                pull[:, d] = np.bincount(where, weights=back[b.row, d] * b.share, minlength=len(used))
            m.embedding[used] -= now * len(some) * pull
            done += 1
    return m


def calibrate(m: Model, x: Rows, labels: np.ndarray, errors: float = ERRORS) -> Model:
    """Sets the temperature of least cross entropy, and the least confidence above which at most `errors` of the rows are wrong."""
    if not x.n:
        return m
    margins, own = m.margins(x), (np.arange(x.n), labels)
    loss = lambda t: -np.log(np.maximum(softmax(margins / t)[own], 1e-12)).mean()
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    m.temperature = float(grid[np.argmin([loss(t) for t in grid])])
    p = softmax(margins / m.temperature)
    sure, wrong = p.max(axis=1), p.argmax(axis=1) != labels
    order = np.argsort(-sure, kind="stable")
    share = np.cumsum(wrong[order]) / np.arange(1, x.n + 1)
    last = np.flatnonzero((share <= errors) & np.append(sure[order][1:] != sure[order][:-1], True))
    m.bound = float(sure[order][last[-1]]) if len(last) else 1.0 + 1e-9
    return m


def _fragment(tokens: list[str], seed: int) -> list[str]:
    """One to eight consecutive tokens of a text."""
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 9))
    at = int(rng.integers(0, max(1, len(tokens) - n + 1)))
    return tokens[at : at + n]


def fit(docs: DataFrame, folds: int = 4, held_out: int = 2, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, errors: float = ERRORS) -> Model:
    """A model from at most `sample` rows of docs (doc_id, text, lang) whose fold isn't held out."""
    able = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_fold(F.col("doc_id"), folds) != held_out))
    # texts don't travel for this: ids first, by hash within a language, languages in turn
    keys = able.select("doc_id", "lang", F.xxhash64("text").alias("h"), F.xxhash64("doc_id").alias("o"))
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("o", "doc_id", "h"))
    keys = keys.distinct().withColumn("turn", turn).filter(F.col("turn") <= sample).orderBy("turn", "o", "doc_id", "h", "lang").limit(sample)
    drawn = able.withColumn("h", F.xxhash64("text")).join(F.broadcast(keys), (able["doc_id"].eqNullSafe(keys["doc_id"])) & (able["lang"] == keys["lang"]) & (F.xxhash64("text") == keys["h"]), "left_semi")
    drawn = drawn.dropDuplicates(["doc_id", "lang", "h"]).select("doc_id", "lang", "text", F.xxhash64("doc_id").alias("o"))

    def extract(batches):
        for some in (x for b in batches for x in slices(b)):
            for row in some.to_pylist():
                tokens = row["text"].lower().split()
                made = []
                for part in (tokens, _fragment(tokens, row["o"] & 0x7FFFFFFF)):
                    found = np.concatenate([subwords(t) for t in part] or [np.empty(0, np.int64)])
                    bucket, count = np.unique(found, return_counts=True)
                    made += [bucket.astype("<u2").tobytes(), np.minimum(count, _MOST_COUNT).astype("<u2").tobytes()]
                yield pa.record_batch([pa.array([row["o"]]), pa.array([zlib.crc32(row["text"].encode("utf-8", "surrogatepass"))], pa.int64()), pa.array([row["lang"]]), *(pa.array([x], pa.binary()) for x in made)], ["o", "h", "lang", "bucket", "count", "few", "few_count"])

    found = drawn.mapInArrow(extract, "o long, h long, lang string, bucket binary, count binary, few binary, few_count binary")
    # a window over `sample` rows at most
    size = F.octet_length("bucket") + F.octet_length("count") + F.octet_length("few") + F.octet_length("few_count")
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("o", "h"))
    held = F.sum(size).over(Window.orderBy("turn", "o", "h", "lang").rowsBetween(Window.unboundedPreceding, 0))
    found = found.withColumn("turn", turn).withColumn("held", held).filter(F.col("held") <= sample_bytes).collect()
    found.sort(key=lambda r: (r["turn"], r["o"], r["h"], r["lang"]))
    names = sorted({r["lang"] for r in found}, key=lambda x: x.encode("utf-32-be", "surrogatepass"))
    kept, known = ([], []), {x: i for i, x in enumerate(names)}
    for k, r in enumerate(found):
        for b, c in (("bucket", "count"), ("few", "few_count")):
            if len(r[b]):
                kept[k % 5 == 4].append((known[r["lang"]], np.frombuffer(r[b], "<u2"), np.frombuffer(r[c], "<u2").astype(np.float64)))
    learnt, apart = ((Rows.of([(b, c) for _, b, c in part]), np.array([y for y, *_ in part], np.int64)) for part in kept)
    if not learnt[0].n:
        return Model([], np.zeros((BUCKETS, DIM)), np.zeros((DIM, 0)), np.zeros(0))
    return calibrate(train(*learnt, names), *apart, errors)


class Scorer:
    """Sums of what the subwords of words add to each language; words met before are looked up."""

    def __init__(self, table: np.ndarray):
        self._table = table
        self._forget()

    def _forget(self) -> None:
        self._words = Interner()
        self._sums, self._counts, self._filled = np.zeros((1 << 12, self._table.shape[1])), np.zeros(1 << 12, np.int64), 0

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """For each text the summed additions of its subwords, and their number."""
        if len(self._words) > _MEMO_WORDS:
            self._forget()
        split = [t.lower().split() if t else [] for t in texts]
        numbers = self._words.numbers([w for words in split for w in words])
        fresh = self._words.new[self._filled :]
        if fresh:
            buckets = [subwords(w) for w in fresh]
            sizes = np.array([len(b) for b in buckets], np.int64)
            to = self._filled + len(fresh)
            while to > len(self._counts):
                self._sums, self._counts = np.concatenate([self._sums, np.zeros_like(self._sums)]), np.concatenate([self._counts, np.zeros_like(self._counts)])
            _, row = segments(sizes)
            added = self._table[np.concatenate(buckets)]
            for k in range(added.shape[1]):
                self._sums[self._filled : to, k] = np.bincount(row, weights=added[:, k], minlength=len(fresh))
            self._counts[self._filled : to] = sizes
            self._filled = to
        _, of = segments(np.array([len(w) for w in split], np.int64))
        sums = np.stack([np.bincount(of, weights=self._sums[numbers, k], minlength=len(texts)) for k in range(self._table.shape[1])], axis=1)
        return sums, np.bincount(of, weights=self._counts[numbers], minlength=len(texts)).astype(np.int64)


def predicted(docs: DataFrame, model: Model, folds: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every document of docs (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size for each language, whatever the corpus

    def run(batches):
        m = sent.value
        if m.names:
            key = zlib.crc32(m.layer.tobytes() + m.embedding.tobytes())
            scorer = memo(("language", key), lambda: Scorer(m.table()))
        for batch in batches:
            for some in slices(batch, size=2 << 20):
                n = some.num_rows
                name, score = [UNKNOWN] * n, np.zeros(n)
                if m.names:
                    sums, count = scorer(some["text"].to_pylist())
                    p = softmax((sums / np.maximum(count, 1)[:, None] + m.bias) / m.temperature)
                    best = p.argmax(axis=1)
                    score = np.where(count > 0, p[np.arange(n), best], 0.0)
                    name = [m.names[b] if c else UNKNOWN for b, c in zip(best.tolist(), count.tolist(), strict=True)]
                refused = [x == UNKNOWN or s < m.bound for x, s in zip(name, score.tolist(), strict=True)]
                yield pa.record_batch([some["doc_id"], some["held_out"], pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(refused, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "text")
    return asked.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, folds: int = 4, held_out: int = 2, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """Learn from docs (doc_id, text, lang) but for the fold held out, and predict for all of them."""
    return predicted(docs, fit(docs, folds, held_out, sample, sample_bytes), folds, held_out)
