"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), the pairs summed in linear time as
1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2). Inputs: the share of each hashed word among the
document's words, statistics of its characters, words and lines, and the metadata column n_chars.
Labels, lang, source and doc_id are never inputs.

Training takes at most `sample` labelled rows, those with the smallest hash of their id, from the folds
that are learnt from; it runs on the driver over these bounded rows, in a fixed order and with a fixed
seed. Scoring covers every document's whole text.

Null and empty texts have all-zero word and text statistics and get the score that follows; a null n_chars counts as
missing. Very long texts are read whole. Rows repeated in documents are scored each and learnt from once: of
the rows of a doc_id the least. Labels without a document or with a null label are passed over, repeated ones
count once, contradicting ones each. With no labelled row the model is neutral: 0.5. Other columns of any name
are kept by scored().
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from chronolex.llm.common import WordHashes, crc_fold, memo, segments, slices, unused

BUCKETS = 1 << 13
FACTORS = 8
SAMPLE = 8192
THRESHOLD = 0.3
STATISTICS = ("upper", "digits", "symbols", "spaces", "lines", "bars", "sentence ends", "long words", "word length", "distinct", "top word", "repeats", "log words", "log n_chars", "no n_chars")

_BYTE = np.arange(256)
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
_DIGIT = (_BYTE >= 48) & (_BYTE <= 57)
_SPACE = (_BYTE == 32) | ((_BYTE >= 9) & (_BYTE <= 13))
_SYMBOL = (_BYTE < 128) & ~_UPPER & ~_DIGIT & ~_SPACE & ~((_BYTE >= 97) & (_BYTE <= 122))


@dataclass
class Features:
    """Sparse word shares of n documents (row, bucket, share) and their dense statistics."""

    n: int
    row: np.ndarray
    bucket: np.ndarray
    share: np.ndarray
    dense: np.ndarray


def features(texts: list[str | None], n_chars: list[int | None]) -> Features:
    dense = np.zeros((len(texts), len(STATISTICS)))
    hashed, counts, hashes = [], [], memo("word hashes", WordHashes)
    for i, (text, chars) in enumerate(zip(texts, n_chars, strict=True)):
        raw = (text or "").encode()
        words = raw.split()
        counts.append(len(words))
        hashed.append(hashes(raw.lower().split()) if words else np.empty(0, np.uint64))
        dense[i, 13:] = np.log1p(max(chars or 0, 0)), chars is None
        if not words:
            continue
        of = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        first, times = np.unique(hashed[-1], return_counts=True)
        per = 1 / len(raw)
        dense[i, :13] = (
            of[_UPPER].sum() * per,
            of[_DIGIT].sum() * per,
            of[_SYMBOL].sum() * per,
            of[_SPACE].sum() * per,
            of[10] / len(words),
            of[124] / len(words),
            (of[33] + of[46] + of[63]) / len(words),
            (lengths > 15).mean(),
            lengths.mean(),
            len(first) / len(words),
            times.max() / len(words),
            (hashed[-1][1:] == hashed[-1][:-1]).mean() if len(words) > 1 else 0.0,
            np.log(len(words)),
        )
    counts = np.array(counts, np.int64)
    _, row = segments(counts)
    key = row * BUCKETS + ((np.concatenate(hashed) if hashed else np.empty(0, np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)
    key, times = np.unique(key, return_counts=True)
    row = key // BUCKETS
    return Features(len(texts), row, key % BUCKETS, times / np.maximum(counts, 1)[row], dense)


@dataclass
class Machine:
    bias: float
    linear: np.ndarray  # of buckets, then statistics
    factors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def margin(self, x: Features) -> np.ndarray:
        return self._forward(x, np.clip((x.dense - self.mean) / self.spread, -5, 5))[0]

    def scores(self, x: Features) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -35, 35)))

    def _forward(self, x: Features, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w, v = self.linear[:BUCKETS], self.factors[:BUCKETS]
        wd, vd = self.linear[BUCKETS:], self.factors[BUCKETS:]
        sums, squares = dense @ vd, (dense**2) @ (vd**2)
        line = self.bias + dense @ wd + np.bincount(x.row, weights=w[x.bucket] * x.share, minlength=x.n)
        for f in range(self.factors.shape[1]):
            part = v[x.bucket, f] * x.share
            sums[:, f] += np.bincount(x.row, weights=part, minlength=x.n)
            squares[:, f] += np.bincount(x.row, weights=part**2, minlength=x.n)
        return line + 0.5 * (sums**2 - squares).sum(axis=1), sums


def train(x: Features, labels: np.ndarray, epochs: int = 12, rate: float = 0.05, decay: float = 1e-5, seed: int = 7) -> Machine:
    """Logistic loss by AdaGrad over shuffled minibatches."""
    rng = np.random.default_rng(seed)
    size = BUCKETS + len(STATISTICS)
    mean, spread = (x.dense.mean(axis=0), x.dense.std(axis=0)) if x.n else (np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)))
    m = Machine(0.0, np.zeros(size), rng.normal(0, 0.01, (size, FACTORS)), mean, np.where(spread > 1e-9, spread, 1.0))
    if not x.n:
        m.factors[:] = 0
        return m
    dense_all = np.clip((x.dense - m.mean) / m.spread, -5, 5)
    starts = np.searchsorted(x.row, np.arange(x.n + 1))
    g_linear, g_factors, g_bias = np.full(size, 1e-8), np.full((size, FACTORS), 1e-8), 1e-8
    for _ in range(epochs):
        order = rng.permutation(x.n)
        for at in range(0, x.n, 128):
            some = order[at : at + 128]
            lengths = starts[some + 1] - starts[some]
            begin, row = segments(lengths)
            pick = np.repeat(starts[some] - begin, lengths) + np.arange(lengths.sum())
            b = Features(len(some), row, x.bucket[pick], x.share[pick], x.dense[some])
            dense = dense_all[some]
            margin, sums = m._forward(b, dense)
            slope = (1 / (1 + np.exp(-np.clip(margin, -35, 35))) - labels[some]) / len(some)
            used, where = np.unique(b.bucket, return_inverse=True)
            pull = slope[row] * b.share
            grad_w = np.bincount(where, weights=pull, minlength=len(used)) + decay * m.linear[used]
            grad_v = np.empty((len(used), FACTORS))
            for f in range(FACTORS):
                grad_v[:, f] = np.bincount(where, weights=pull * (sums[row, f] - m.factors[b.bucket, f] * b.share), minlength=len(used))
            grad_v += decay * m.factors[used]
            tail = slice(BUCKETS, None)
            grad_wd = dense.T @ slope + decay * m.linear[tail]
            grad_vd = (dense * slope[:, None]).T @ sums - ((dense**2).T @ slope)[:, None] * m.factors[tail] + decay * m.factors[tail]
            for values, memory, where_, grad in ((m.linear, g_linear, used, grad_w), (m.factors, g_factors, used, grad_v), (m.linear, g_linear, tail, grad_wd), (m.factors, g_factors, tail, grad_vd)):
                memory[where_] += grad**2
                values[where_] -= rate * grad / np.sqrt(memory[where_])
            g_bias += slope.sum() ** 2
            m.bias -= rate * slope.sum() / np.sqrt(g_bias)
    return m


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, sample: int = SAMPLE) -> Machine:
    """A machine from at most `sample` rows of labels (doc_id, quality) whose fold isn't held out."""
    rows = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (crc_fold(F.col("doc_id"), folds) != held_out))
    rows = rows.select("doc_id", "quality").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    drawn = docs.select("doc_id", "text", _chars(docs).alias("n_chars")).join(F.broadcast(rows), "doc_id")
    drawn = drawn.groupBy("doc_id", "quality").agg(F.min(F.struct("text", "n_chars")).alias("d")).select("doc_id", "quality", "d.*")

    def extract(batches):
        for batch in (x for b in batches for x in slices(b)):
            x = features(batch["text"].to_pylist(), batch["n_chars"].to_pylist())
            cut = np.searchsorted(x.row, np.arange(x.n + 1))
            parts = [(x.bucket[a:b].astype("<i4").tobytes(), x.share[a:b].astype("<f8").tobytes(), d.tobytes()) for a, b, d in zip(cut, cut[1:], x.dense, strict=False)]
            yield pa.record_batch([batch["doc_id"].cast(pa.int64()), batch["quality"].cast(pa.int32()), *(pa.array([p[k] for p in parts], pa.binary()) for k in range(3))], ["doc_id", "quality", "bucket", "share", "dense"])

    found = drawn.mapInArrow(extract, "doc_id long, quality int, bucket binary, share binary, dense binary").collect()  # a bounded sample
    found.sort(key=lambda r: (r["doc_id"], r["quality"], bytes(r["dense"]), bytes(r["bucket"])))
    buckets = [np.frombuffer(r["bucket"], "<i4") for r in found]
    row = np.repeat(np.arange(len(found)), [len(b) for b in buckets])
    empty = np.empty(0)
    x = Features(
        len(found),
        row.astype(np.int64),
        np.concatenate([*buckets, empty]).astype(np.int64),
        np.concatenate([*(np.frombuffer(r["share"], "<f8") for r in found), empty]),
        np.array([np.frombuffer(r["dense"]) for r in found]).reshape(len(found), len(STATISTICS)),
    )
    return train(x, np.array([float(r["quality"] == 1) for r in found]))


def _chars(docs: DataFrame):
    return F.col("n_chars").try_cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")


def scored(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD, names: tuple[str, str] = ("_score", "_predicted")) -> DataFrame:
    """docs with a score (double) and a prediction (int) under the given names; all columns of docs stay."""
    if {n.lower() for n in names} & {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has a column {names[0]} or {names[1]}")
    sent, kept = docs.sparkSession.sparkContext.broadcast(machine), docs.columns  # a fixed size, whatever the corpus

    def score(batches):
        for batch in batches:
            batch = batch.rename_columns(["0", "1", *kept])  # text and n_chars stand first
            for some in slices(batch, "0", 2000):
                s = sent.value.scores(features(some[0].to_pylist(), some[1].to_pylist()))
                yield pa.record_batch([*some.columns[2:], pa.array(s, pa.float64())], [*kept, names[0]])

    out = docs.select(F.col("text").alias(unused(docs, "text")), _chars(docs).alias(unused(docs, "n_chars_")), *(F.col(f"`{c}`") for c in kept))
    out = out.mapInArrow(score, StructType([*docs.schema.fields, StructField(names[0], DoubleType())]))
    return out.withColumn(names[1], (F.col(names[0]) >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    machine = fit(docs, labels, folds, held_out, sample)
    out = scored(docs.select("doc_id", "text", _chars(docs).alias("n_chars")), machine, threshold)
    return out.select("doc_id", (crc_fold(F.col("doc_id"), folds) == held_out).alias("held_out"), F.col("_score").alias("score"), F.col("_predicted").alias("predicted"))
