"""Secret scan: fixed patterns, and a randomness test battery with length-aware false-discovery control.

Patterns (assign, access, hex) give the base spans. The battery looks at maximal runs of key characters
that mix character classes and lie in no base span. It infers the encoding of a run (hex, base32, base36,
base62, base64), and tests it against uniformly random text of that encoding by a chi-squared test of its
alphabet, a runs test about the median symbol and a lag-one serial correlation. Fisher's sum of the three
tells how far from random the run is: small for keys, large for words.

What is controlled is the false discovery of secrets. The null hypothesis is that a run is words run together,
as identifiers and paths are. Its distribution of Fisher's sum is learnt from the corpus: letter and digit
pairs are counted over all texts, and runs of each encoding and length class are drawn from these counts, words
joined by capitals, digits or signs as the encoding allows, at the shortest length of the class. A run's p-value is the share of
drawn runs at least as random as it. Benjamini-Hochberg over all runs of similar length in the corpus then
bounds the share of words among what is reported as kind `random`. Short runs carry little evidence: a key is
missed rather than a word taken. What goes through the driver are counts by length class, encoding and step of
the sum, and of pairs: bounded tables.

Offsets are code points, ends exclusive. Null and empty texts have no spans, very long ones are scanned whole;
rows are independent of each other apart from the thresholds, so repeated rows get equal results. Other columns
of any name are kept where a table is returned whole.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from chronolex.llm.common import forget, slices, unused

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # maximal runs, so the same as runs of any length with short ones dropped
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")

#: fixed values: the alphabets of the encodings, smallest first
ENCODINGS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
_SETS = tuple((name, frozenset(alphabet), {c: i for i, c in enumerate(alphabet)}) for name, alphabet in ENCODINGS)
FALSE_DISCOVERY = 0.01
STEP, STEPS = 0.5, 1000  # Fisher's sum is counted in steps; the last holds all larger ones
LEAST, CLASSES = 20, 52  # characters of the shortest run; length classes, four to a doubling
DRAWN = 400_000  # characters drawn for a null distribution, of 200 to 10,000 runs
WORD_CHARACTERS = "0123456789abcdefghijklmnopqrstuvwxyz"
_BREAK = len(WORD_CHARACTERS)
_KIND = np.full(256, _BREAK, np.int64)  # of a byte: its place in WORD_CHARACTERS in either case, or a break between words
for _at, _c in enumerate(WORD_CHARACTERS):
    _KIND[[ord(_c), ord(_c.upper())]] = _at


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns."""
    found = []
    if ":" in text or "=" in text:
        found += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if any(len(w) >= 16 and _HEX.search(w) for w in text.split()):
        found += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def encoding_of(run: str) -> tuple[str, dict[str, int]] | None:
    """The smallest alphabet that holds the run; None for runs of one character class or of a capitalised word."""
    body = run.rstrip("=")
    digits = sum(c.isdigit() for c in body)
    upper, lower = any(c.isupper() for c in body[1:]), any(c.islower() for c in body)
    if not digits and not (upper and lower) or digits == len(body) or body.count("-") + body.count("_") + body.count("/") > len(body) // 6:
        return None
    chars = set(body)
    return next(((name, at) for name, allowed, at in _SETS if chars <= allowed), None)


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(x: np.ndarray, a: int) -> np.ndarray:
    """Fisher's sum of the three tests for each row of x, runs of equal length as places in an alphabet of a (even) symbols."""
    rows, n = x.shape
    observed = np.bincount((np.arange(rows)[:, None] * a + x).ravel(), minlength=rows * a).reshape(rows, a)
    chi = ((observed - n / a) ** 2).sum(axis=1) * a / n
    # a gamma law with the exact mean and variance of the statistic, by Wilson and Hilferty's cube root
    mean, variance = a - 1.0, 2.0 * (a - 1) * (n - 1) / n
    shape = mean**2 / variance
    uniform = _tails(((chi / mean) ** (1 / 3) - (1 - 1 / (9 * shape))) * math.sqrt(9 * shape))
    high = x > (a - 1) / 2
    n1 = high.sum(axis=1)
    n2 = n - n1
    runs = 1 + (high[:, 1:] != high[:, :-1]).sum(axis=1)
    mu = 1 + 2 * n1 * n2 / n
    var = np.maximum((mu - 1) * (mu - 2) / (n - 1), 1e-9)
    ordered = np.where((n1 > 0) & (n2 > 0), np.minimum(1, 2 * _tails(np.abs(runs - mu) / np.sqrt(var))), 2.0 ** (1 - min(n, 900)))
    d = x - x.mean(axis=1, keepdims=True)
    power = (d**2).sum(axis=1)
    z = np.abs((d[:, 1:] * d[:, :-1]).sum(axis=1)) / np.maximum(power, 1e-9) * math.sqrt(n)
    serial = np.where(power > 0, np.minimum(1, 2 * _tails(z)), 1e-300)
    return -2 * sum(np.log(np.maximum(p, 1e-300)) for p in (uniform, ordered, serial))


def _tails(z: np.ndarray) -> np.ndarray:
    return np.array([_normal_tail(v) for v in z])


def length_class(n: int) -> int:
    return min(int(4 * math.log2(n)), CLASSES - 1)


def candidates(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end, cell: length class and encoding, step of Fisher's sum) of the runs that the battery tests."""
    if not any(len(w) >= LEAST and _RUN.search(w) for w in text.split()):
        return []
    found = []
    for m in _RUN.finditer(text):
        inferred = encoding_of(m[0])
        if inferred:
            name, at = inferred
            body = m[0].rstrip("=")
            total = battery(np.array([[at[c] for c in body]]), len(at))[0]
            cell = length_class(len(body)) * len(ENCODINGS) + _NAMES.index(name)
            found.append((*m.span(), cell, min(int(total / STEP), STEPS - 1)))
    return found


_NAMES = [name for name, _ in ENCODINGS]


def drawn_words(pairs: np.ndarray, name: str, n: int, rows: int, seed: int = 11) -> np.ndarray:
    """Runs of n symbols (places in the encoding's alphabet) that are words run together, by counts of pairs of
    WORD_CHARACTERS and breaks: capitals where both cases belong to the encoding, digits or signs between words else."""
    alphabet = dict(ENCODINGS)[name]
    rng = np.random.default_rng(seed)
    cases = [c for c in ("lower", "upper") if any(getattr(x, f"is{c}")() for x in alphabet)]
    able = np.array([any(c in alphabet for c in (x, x.upper())) for x in WORD_CHARACTERS])
    weight = pairs.astype(float).copy()
    weight += 0.02 * weight.sum(axis=1, keepdims=True) * (weight.sum(axis=0) + 1) / (weight.sum() + len(weight)) + 1e-6
    weight[:_BREAK, :_BREAK] *= able[None, :]
    weight[_BREAK, :_BREAK] *= able
    weight[_BREAK, _BREAK] = 0
    step = np.cumsum(weight / weight.sum(axis=1, keepdims=True), axis=1)
    step[:, -1] = 1.0
    signs = [c for c in alphabet if not c.isalnum()]
    digits = [c for c in alphabet if c.isdigit()]
    joiners = signs or ([] if len(cases) == 2 else digits)
    place = {c: i for i, c in enumerate(alphabet)}
    lower = np.array([place.get(c, place.get(c.upper(), 0)) for c in WORD_CHARACTERS])
    upper = np.array([place.get(c.upper(), place.get(c, 0)) for c in WORD_CHARACTERS])
    if cases == ["upper"]:
        lower = upper
    joined = np.array([place[c] for c in joiners] or [0])
    out, state, first = np.zeros((rows, n), np.int64), np.full(rows, _BREAK), np.ones(rows, bool)
    for k in range(n):
        nxt = (rng.random(rows)[:, None] > step[state]).sum(axis=1)
        broke = nxt == _BREAK
        if joiners:
            first |= broke
        else:  # the next word begins at once
            again = (rng.random(rows)[:, None] > step[np.full(rows, _BREAK)]).sum(axis=1)
            first |= broke
            nxt, broke = np.where(broke, again, nxt), np.zeros(rows, bool)
        letter = np.minimum(nxt, _BREAK - 1)
        symbol = np.where(first & (len(cases) == 2), upper[letter], lower[letter])
        out[:, k] = np.where(broke, joined[rng.integers(0, len(joined), rows)], symbol)
        first &= broke
        state = nxt
    return out


def null_p_values(pairs: np.ndarray, cell: int) -> np.ndarray:
    """For each step of Fisher's sum, the probability that words run together come out there or below. Beyond the drawn
    runs a normal law of the sum's root, with a quarter added to its deviation, stands in."""
    size, name = cell // len(ENCODINGS), _NAMES[cell % len(ENCODINGS)]
    n = max(LEAST, math.ceil(2 ** (size / 4)))
    rows = int(np.clip(DRAWN // n, 200, 10_000))
    sums = battery(drawn_words(pairs, name, n, rows), len(dict(ENCODINGS)[name]))
    below = np.cumsum(np.bincount(np.minimum(sums / STEP, STEPS - 1).astype(np.int64), minlength=STEPS))
    root = np.sqrt(sums)
    edges = np.sqrt(STEP * (np.arange(STEPS) + 1))
    tail = _tails((root.mean() - edges) / max(1.25 * float(root.std()), 1e-9))
    p = (1 + below) / (1 + rows)
    return np.where(below < 10, np.minimum(p, np.maximum(tail, 1e-12)), p)


def discoveries(counts: dict[tuple[int, int], int], pairs: np.ndarray, level: float = FALSE_DISCOVERY) -> dict[int, int]:
    """Benjamini-Hochberg by length class over counts of (cell, step): the last step of each cell whose runs are reported."""
    p_of = {cell: null_p_values(pairs, cell) for cell in sorted({c for c, _ in counts})}
    out: dict[int, int] = {}
    for size in {c // len(ENCODINGS) for c in p_of}:
        mine = sorted((float(p_of[c][step]), n, c, step) for (c, step), n in counts.items() if c // len(ENCODINGS) == size)
        total, below, limit = sum(n for _, n, _, _ in mine), 0, -1.0
        for k, (p, n, _, _) in enumerate(mine):
            below += n
            if (k + 1 == len(mine) or mine[k + 1][0] > p) and p <= level * below / total:
                limit = p
        for c in (c for c in p_of if c // len(ENCODINGS) == size):
            reported = np.flatnonzero(p_of[c] <= limit)
            if len(reported):
                out[c] = int(reported[-1])
    return out


def thresholds(docs: DataFrame, level: float = FALSE_DISCOVERY) -> dict[int, int]:
    """discoveries() over all texts of docs: one pass, which counts the candidates outside base spans and the pairs of characters."""

    def run(batches):
        forget()
        counts, pairs = {}, np.zeros((_BREAK + 1) ** 2, np.int64)
        for batch in batches:
            for some in slices(batch):
                texts = [t for t in some["text"].to_pylist() if t]
                kinds = _KIND[np.frombuffer(" ".join(["", *texts, ""]).encode("utf-8"), np.uint8)]
                pairs += np.bincount(kinds[:-1] * (_BREAK + 1) + kinds[1:], minlength=len(pairs))
                for text in texts:
                    for _, _, cell, step in outside(candidates(text), text):
                        counts[cell, step] = counts.get((cell, step), 0) + 1
        rows = [(c, b, n) for (c, b), n in counts.items()] + [(-1, int(k), int(pairs[k])) for k in np.flatnonzero(pairs)]
        yield pa.record_batch([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["cell", "step", "n"])

    rows = docs.select("text").mapInArrow(run, "cell long, step long, n long").groupBy("cell", "step").agg(F.sum("n").alias("n")).collect()
    pairs = np.zeros((_BREAK + 1) ** 2, np.int64)
    for r in rows:
        if r["cell"] < 0:
            pairs[r["step"]] = r["n"]
    counts = {(r["cell"], r["step"]): r["n"] for r in rows if r["cell"] >= 0}
    return discoveries(counts, pairs.reshape(_BREAK + 1, -1), level)


def outside(found: list[tuple[int, int, int, int]], text: str) -> list[tuple[int, int, int, int]]:
    """The candidates that lie in no base span."""
    base = base_spans(text) if found else []
    return [x for x in found if not any(s <= x[0] and x[1] <= e for s, e, _ in base)]


def all_spans(text: str, last: dict[int, int]) -> list[tuple[int, int, str]]:
    """(start, end, kind) of base spans and of the battery's under the thresholds, by start, then kind."""
    found = [(s, e, "random") for s, e, cell, step in outside(candidates(text), text) if step <= last.get(cell, -1)]
    return sorted(base_spans(text) + found, key=lambda x: (x[0], KINDS.index(x[2])))


_SPANS = ArrayType(StructType([StructField(name, IntegerType()) for name in "sek"]))


def found_spans(docs: DataFrame, level: float = FALSE_DISCOVERY) -> DataFrame:
    """All columns of docs but text, and last `_spans` (with more underscores where docs has that name): an array of
    (s, e, k: place in KINDS) sorted by start, then kind."""
    last = thresholds(docs, level)
    kept = [c for c in docs.columns if c != "text"]
    name = unused(docs, "_spans")

    def scan(batches):
        forget()
        kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("k", pa.int32())]))
        for batch in batches:
            for some in slices(batch):
                rows = [[{"s": s, "e": e, "k": KINDS.index(k)} for s, e, k in all_spans(t or "", last)] for t in some["text"].to_pylist()]
                yield pa.record_batch([*(some[n] for n in kept), pa.array(rows, kind)], [*kept, name])

    return docs.mapInArrow(scan, docs.drop("text").schema.add(name, _SPANS))


def redacted(docs: DataFrame, level: float = FALSE_DISCOVERY, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of text replaced by the mark, and n_chars, where there is one, counted anew."""
    last = thresholds(docs, level)

    def run(batches):
        forget()
        for batch in batches:
            for some in slices(batch):
                columns = {n: some[n] for n in some.schema.names}
                texts = some["text"].to_pylist()
                made = [t and redact(t, [x[:2] for x in all_spans(t, last)], mark) for t in texts]
                columns["text"] = pa.array(made, pa.string())
                if "n_chars" in columns:
                    chars = [n if t is None or n is None or m == t else len(m) for n, t, m in zip(some["n_chars"].to_pylist(), texts, made, strict=True)]
                    columns["n_chars"] = pa.array(chars, some.schema.field("n_chars").type)
                yield pa.record_batch(list(columns.values()), list(columns))

    return docs.mapInArrow(run, docs.schema)


def digest_text(spans, kinds: tuple[str, ...] = KINDS):
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["k"]], x["s"].cast("string"), x["e"].cast("string"))), ",")


def secret_report(docs: DataFrame, level: float = FALSE_DISCOVERY) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans per document."""
    found = found_spans(docs.select("doc_id", "text"), level)
    number = [F.expr(f"cast(size(filter(_spans, x -> x.k = {k})) AS long)").alias(f"n_{KINDS[k]}") for k in range(3)]
    base = digest_text(F.filter("_spans", lambda x: x["k"] < 3))
    return found.select("doc_id", *number, F.sha2(base, 256).alias("base_sha256"), digest_text(F.col("_spans")).alias("spans"))


def redact(text: str, spans: list[tuple[int, int]], mark: str = "[SECRET]") -> str:
    """text with every maximal union of spans replaced by the mark."""
    out, at = [], 0
    for s, e in sorted(spans):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def base_sha256(text: str) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in base_spans(text)).encode()).hexdigest()
