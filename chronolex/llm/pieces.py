"""SentencePiece encoding and decoding with the N best segmentations.

The lattice of a text has an edge for every vocabulary piece that matches at a place, and a byte-fallback
edge for a character that no piece covers; a segmentation's score is the sum of its pieces' scores. A
forward Viterbi pass gives every node its best score from the start; these are exact heuristics for an A*
search backward from the end, which therefore takes segmentations in the order of their scores.

Pieces never cross the start of a word (the space mark) or a line break, so a text's lattice is a chain of
its units' lattices. A worker remembers the units it has solved, within MEMO_BYTES (beyond that it forgets units
met once and the rarest of the others, and solves them again when they come): forward and backward passes of
many units at once give best scores and the gap to the second best. The text's N best differ from its best in the
N - 1 units with the smallest gaps only; those units' N best come from A*, and a best-first merge joins
them. Every result is the exact N best of the whole text.

Decoding joins the pieces' bytes and drops the leading space mark, and gives back every text exactly: a
space mark in the text itself is told apart by a code outside Unicode and goes through byte fallback, too.
Pieces that repeat the space mark are not used. Ties are broken by the shorter last piece, again and again.

Null texts count as empty, which have no pieces. Very long texts are taken whole: short units are solved in
batches of a bounded number of characters, a unit of more than LONG characters alone, in steps over its edges.
Rows are independent of each other, so repeated rows get equal results; other columns are not read, whatever
their names. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolex.llm.common import ENTRY_BYTES, MEMO_BYTES, Interner, memo, memo_bytes, slices

MARK = "▁"
_TEXT_MARK = 0x110000  # a space mark of the text itself: no character has this code, and so no piece
LONG, BATCH_UNITS, BATCH_CHARS, BLOCK_CHARS = 48, 2048, 32_768, 1 << 15
FILTER_BITS = 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Model:
    """Pieces, scores and byte pieces of a SentencePiece vocabulary."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.byte_ids = np.zeros(256, np.int64)
        self.ids: dict[str, int] = {}
        self.scores = np.zeros(size)
        self.raw: list[bytes] = [b""] * size
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) and MARK not in piece[1:]:
                self.ids[piece] = i
                self.scores[i] = sp.get_score(i)
                self.raw[i] = piece.replace(MARK, " ").encode()
        self.fallback = float(min(self.scores)) - 10
        self.longest = max(map(len, self.ids))
        self.raw_array = np.array(self.raw, object)
        self._by_length = []
        for length in range(1, self.longest + 1):
            some = [(p, i) for p, i in self.ids.items() if len(p) == length]
            hashes = self._hash_all([p for p, _ in some]) if some else np.empty(0, np.uint64)
            order = np.argsort(hashes)
            self._by_length.append((hashes[order], np.array([i for _, i in some], np.int64)[order]))
        self._filter = np.zeros(1 << FILTER_BITS, bool)  # False where no piece has the hash
        for hashes, _ in self._by_length:
            self._filter[self._slot(hashes)] = True
        self._edge_scores = np.append(self.scores, [self.fallback, -np.inf])  # by id: -2 and -1 are the last two

    @staticmethod
    def _hash_all(pieces: list[str]) -> np.ndarray:
        out = np.zeros(len(pieces), np.uint64)
        for at, p in enumerate(pieces):
            h = 0
            for k, ch in enumerate(p):
                h += (ord(ch) + 1) * pow(int(_BASE), k, 1 << 64)
            out[at] = h & 0xFFFFFFFFFFFFFFFF
        return out

    @staticmethod
    def _slot(hashes: np.ndarray) -> np.ndarray:
        return (hashes * _MULTIPLIER >> np.uint64(64 - FILTER_BITS)).astype(np.int64)

    def edges(self, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1 none, -2 byte fallback) and scores of the piece of each length 1.. (as far as units go) at each place; left: characters to the unit's end."""
        n = len(codes)
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]))
            inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _INVERSE)]))
            prefix = np.concatenate([[np.uint64(0)], np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers[:n])])
        high = min(self.longest, int(left.max())) if n else 1
        ids = np.full((high, n), -1, np.int64)
        for length, (hashes, of) in enumerate(self._by_length[:high], 1):
            if not len(hashes):
                continue
            wanted = (prefix[length:] - prefix[:-length]) * inverse[: n - length + 1]
            at = np.flatnonzero(self._filter[self._slot(wanted)] & (left[: n - length + 1] >= length))
            wanted = wanted[at]
            place = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
            hit = hashes[place] == wanted
            ids[length - 1, at[hit]] = of[place[hit]]
        ids[0, ids[0] < 0] = -2
        return ids, self._edge_scores[ids]

    def arcs(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """All edges (start, length, id, score) of a unit by start, then length, a block of characters at a time."""
        for at in range(0, len(codes), BLOCK_CHARS):
            some = codes[at : at + BLOCK_CHARS + self.longest - 1]
            ids, scores = self.edges(some, np.arange(len(some), 0, -1))
            start, k = np.nonzero(ids[:, :BLOCK_CHARS].T != -1)
            yield start + at, k + 1, ids[k, start], scores[k, start]

    def fallback_ids(self, code: int) -> list[int]:
        """Byte pieces of a character."""
        return self.byte_ids[list((MARK if code == _TEXT_MARK else chr(code)).encode())].tolist()

    def decode(self, ids) -> str:
        return b"".join(self.raw[i] for i in ids)[1:].decode()


@lru_cache(maxsize=2)
def load(path: str) -> Model:
    return Model(path)


# --- units ----------------------------------------------------------------------------------------
def coded(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all units, as the lattice sees them, and the length of each: a leading space is the mark, a mark of the text is none."""
    texts = [u.decode() for u in units]
    size = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
    codes[codes == ord(MARK)] = _TEXT_MARK
    first = (np.cumsum(size) - size)[size > 0]
    codes[first[codes[first] == ord(" ")]] = ord(MARK)
    return codes, size


# --- one lattice ----------------------------------------------------------------------------------
def n_best(model: Model, codes: np.ndarray, n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n best (score, ids) of a unit or of a chain of units by forward Viterbi and backward A*.

    The heuristic is exact: an open path stands for a segmentation of just that score, so no more open paths
    than results still wanted need be kept, and the search takes about n steps a piece."""
    if not len(codes):
        return [(0.0, ())]
    forward = [0.0] + [-np.inf] * len(codes)
    blocks = []
    for start, length, piece, score in model.arcs(codes):
        blocks.append((start, length, piece, score))
        for s, k, x in zip(start.tolist(), length.tolist(), score.tolist(), strict=True):
            value = forward[s] + x
            if value > forward[s + k]:
                forward[s + k] = value
    start, length, piece, score = (np.concatenate(c) for c in zip(*blocks, strict=True))
    order = np.lexsort((length, start + length))  # edges by end, the shortest first
    length, piece, score = length[order], piece[order], score[order]
    cuts = np.searchsorted((start + np.concatenate([b[1] for b in blocks]))[order], np.arange(len(codes) + 2))
    found: list[tuple[float, tuple[int, ...]]] = []
    ahead = [(forward[-1], len(codes), 0.0, None)]  # (score of the best segmentation with this end, node, score behind, path)
    while ahead and len(found) < n:
        _, node, behind, path = ahead.pop(0)
        if node == 0:
            pieces: list[int] = []
            while path is not None:
                at, i, path = path
                pieces += [i] if i >= 0 else model.fallback_ids(int(codes[at]))
            found.append((behind, tuple(pieces)))
            continue
        some = slice(cuts[node], cuts[node + 1])
        children = []
        for k, i, x in zip(length[some].tolist(), piece[some].tolist(), score[some].tolist(), strict=True):
            children.append((behind + x + forward[node - k], node - k, behind + x, (node - k, i, path)))
        ahead = sorted(children + ahead, key=lambda x: -x[0])[: n - len(found)]  # stable: of equal ones the newest, of these the shortest
    return found


# --- many units at once ---------------------------------------------------------------------------
@dataclass
class Units:
    score: np.ndarray
    gap: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    ids: np.ndarray


def solve(model: Model, units: list[bytes]) -> Units:
    """Best score, gap to the second best (inf: none) and best ids of each unit.

    Units stand in columns, the longest first, and take their steps together."""
    codes, size = coded(units)
    base = np.cumsum(size) - size
    of = np.repeat(np.arange(len(units)), size)
    place = np.arange(len(codes)) - base[of]
    ids, scores = model.edges(codes, size[of] - place)
    order = np.argsort(-size, kind="stable")
    column = np.empty(len(units), np.int64)
    column[order] = np.arange(len(units))
    top, wide, all_ = int(size.max()), len(ids), np.arange(len(units))
    edge = np.full((wide, top + 1, len(units)), -np.inf)  # score of the piece of k + 1 characters at a place
    edge[:, place, column[of]] = scores
    active = np.searchsorted(-size[order], -np.arange(top + 1), side="right")  # units of at least p characters
    forward = np.full((top + 1, len(units)), -np.inf)
    forward[0] = 0.0
    last = np.zeros(forward.shape, np.int8)
    for p in range(1, top + 1):
        a = active[p]
        for k in range(1, min(p, wide) + 1):
            value = forward[p - k, :a] + edge[k - 1, p - k, :a]
            better = value > forward[p, :a]
            np.copyto(forward[p, :a], value, where=better)
            np.copyto(last[p, :a], k, where=better)
    backward = np.full((top + wide + 1, len(units)), -np.inf)
    backward[size[order], all_] = 0.0
    for p in range(top - 1, -1, -1):
        a = active[p + 1]
        for k in range(1, min(wide, top - p) + 1):
            np.maximum(backward[p, :a], edge[k - 1, p, :a] + backward[p + k, :a], out=backward[p, :a])
    total = forward[size, column]
    # the best paths, from the end; edges on them don't count for the second best
    walking, at = all_, size.copy()
    steps_unit, steps_place, steps_id = [], [], []
    while len(walking):
        k = last[at[walking], column[walking]].astype(np.int64)
        at[walking] -= k
        edge[k - 1, at[walking], column[walking]] = -np.inf
        start = base[walking] + at[walking]
        steps_unit.append(walking)
        steps_place.append(start)
        steps_id.append(ids[k - 1, start])
        walking = walking[at[walking] > 0]
    second = np.full(len(units), -np.inf)
    for k in range(1, wide + 1):
        through = forward[:top] + edge[k - 1, :top] + backward[k : k + top]
        np.maximum(second, through.max(axis=0), out=second)
    second = second[column]
    unit, where, piece = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (steps_unit, steps_place, steps_id))
    by = np.argsort(where, kind="stable")
    unit, where, piece = unit[by], where[by], piece[by]
    if (piece == -2).any():
        made_unit, made = [], []
        for u, w, i in zip(unit.tolist(), where.tolist(), piece.tolist(), strict=True):
            some = [i] if i >= 0 else model.fallback_ids(int(codes[w]))
            made += some
            made_unit += [u] * len(some)
        unit, piece = np.array(made_unit, np.int64), np.array(made, np.int64)
    lengths = np.bincount(unit, minlength=len(units))
    return Units(total, np.where(np.isfinite(second), total - second, np.inf), np.cumsum(lengths) - lengths, lengths, piece)


class Segmenter:
    """Solves texts unit by unit, remembering the units it has seen."""

    def __init__(self, path: str):
        import re

        self.model = load(path)
        self._cut = re.compile(rb"[ \n][^ \n]*").findall
        self._forget()

    def _forget(self) -> None:
        self._units, self._alternatives, self._bytes, self._used = Interner(), {}, 0, np.empty(0, np.int64)
        empty = np.empty(0)
        self._known = Units(empty, empty, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))

    def _forget_rare(self) -> None:
        """Forget units seen once, and of the others the rarest, until a half of the memo is free."""
        units, known, used, alternatives = self._units.new, self._known, self._used, self._alternatives
        order = np.argsort(-used, kind="stable")
        size = np.cumsum(np.fromiter(map(len, units), np.int64, len(units))[order] + ENTRY_BYTES)
        keep = np.sort(order[(used[order] > 1) & (size <= MEMO_BYTES // 2)])
        self._forget()
        self._units.numbers([units[i] for i in keep.tolist()])
        self._bytes, self._used = memo_bytes(self._units.new), used[keep] // 2
        room = MEMO_BYTES // 4
        for (unit, n), found in alternatives.items():
            if unit in self._units and room > 0:
                self._alternatives[unit, n] = found
                room -= memo_bytes([unit] * n)
        self._bytes += MEMO_BYTES // 4 - room
        lengths = known.lengths[keep]
        ends = np.cumsum(lengths)
        ids = known.ids[np.repeat(known.starts[keep] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
        self._known = Units(known.score[keep], known.gap[keep], ends - lengths, lengths, ids)

    def _learn(self) -> None:
        fresh = self._units.new[len(self._known.score) :]
        size = np.fromiter(map(len, fresh), np.int64, len(fresh))
        order = np.argsort(size, kind="stable")  # units of like lengths are solved together
        known, at, short = [], 0, int((size <= LONG).sum())
        while at < short:
            widest = size[order[min(at + BATCH_UNITS, short) - 1]]
            some = order[at : min(at + min(BATCH_UNITS, BATCH_CHARS // int(widest)), short)].tolist()
            known.append(solve(self.model, [fresh[i] for i in some]))
            at += len(some)
        for i in order[short:].tolist():
            best = self.unit_n_best(fresh[i], 2)
            gap, ids = best[0][0] - best[1][0] if len(best) > 1 else np.inf, np.array(best[0][1], np.int64)
            known.append(Units(np.array([best[0][0]]), np.array([gap]), np.zeros(1, np.int64), np.array([len(ids)]), ids))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        before = np.cumsum([len(self._known.ids)] + [len(k.ids) for k in known])
        made = [np.concatenate([getattr(k, c) + (b if c == "starts" else 0) for k, b in zip(known, before, strict=False)])[back] for c in ("score", "gap", "starts", "lengths")]
        old = self._known
        self._known = Units(*(np.concatenate(x) for x in zip((old.score, old.gap, old.starts, old.lengths), made, strict=True)), np.concatenate([old.ids, *(k.ids for k in known)]))
        self._bytes += int(size.sum()) + ENTRY_BYTES * len(fresh)

    def unit_n_best(self, unit: bytes, n: int) -> list[tuple[float, tuple[int, ...]]]:
        return n_best(self.model, coded([unit])[0], n)

    def numbers(self, texts: list[str | None]) -> list[np.ndarray]:
        if self._bytes > MEMO_BYTES:
            self._forget_rare()
        cut = [self._cut(b" " + text.encode()) if text else [] for text in texts]
        numbers = self._units.numbers([u for units in cut for u in units])
        if len(self._units.new) > len(self._known.score):
            self._learn()
        used = np.bincount(numbers, minlength=len(self._units.new))
        used[: len(self._used)] += self._used
        self._used = used
        return np.split(numbers, np.cumsum([len(c) for c in cut])[:-1]) if cut else []

    def best(self, numbers: np.ndarray) -> tuple[float, np.ndarray]:
        k = self._known
        lengths = k.lengths[numbers]
        ends = np.cumsum(lengths)
        ids = k.ids[np.repeat(k.starts[numbers] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
        return float(k.score[numbers].sum()), ids

    def text_n_best(self, numbers: np.ndarray, n: int) -> list[tuple[float, np.ndarray]]:
        """The n best (score, ids) of a text given by its units."""
        score, ids = self.best(numbers)
        found = [(score, ids)]
        gaps = self._known.gap[numbers]
        near = np.argsort(gaps, kind="stable")[: n - 1] if len(gaps) <= 4 * n else _smallest(gaps, n - 1)
        near = near[np.isfinite(gaps[near])]
        if not len(near):
            return found
        lists = []
        for place in near:
            unit = self._units.new[numbers[place]]
            if (unit, n) not in self._alternatives:
                self._alternatives[unit, n] = self.unit_n_best(unit, n)
                self._bytes += memo_bytes([unit] * n)
            lists.append(self._alternatives[unit, n])
        # best-first over the choice for each of these units; a state is reached by raising its last raised unit or a later one
        ahead, first = [], (0,) * len(near)
        seen = {first}

        def push(state):
            if state not in seen:
                seen.add(state)
                heapq.heappush(ahead, (sum(x[0][0] - x[i][0] for x, i in zip(lists, state, strict=True)), state))

        def raised(state):
            for j in range(len(state)):
                if state[j] + 1 < len(lists[j]):
                    push((*state[:j], state[j] + 1, *state[j + 1 :]))

        raised(first)
        lengths = self._known.lengths[numbers]
        starts = np.cumsum(lengths) - lengths
        while ahead and len(found) < n:
            loss, state = heapq.heappop(ahead)
            pieces, at = [], 0
            for j in np.argsort(near):
                if state[j]:
                    pieces += [ids[at : starts[near[j]]], np.array(lists[j][state[j]][1], np.int64)]
                    at = starts[near[j]] + lengths[near[j]]
            found.append((score - loss, np.concatenate([*pieces, ids[at:]])))
            raised(state)
        return found

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the text; a leading space mark is the one that encoding put there."""
        return b"".join(self.model.raw_array[ids].tolist())[1:]


def _smallest(gaps: np.ndarray, k: int) -> np.ndarray:
    """The k smallest, ties to the first."""
    if k <= 0:
        return np.empty(0, np.int64)
    limit = np.partition(gaps, k - 1)[k - 1]
    below, same = np.flatnonzero(gaps < limit), np.flatnonzero(gaps == limit)
    return np.concatenate([below, same[: k - len(below)]])


def _segmenter(path: str) -> Segmenter:
    return memo(("segmenter", path), lambda: Segmenter(path))


def segmented(docs: DataFrame, model: str, n: int = 3) -> DataFrame:
    """docs (doc_id, text) -> doc_id, ids of the best segmentation, and all n best scores and ids_crc32 (u32 little-endian), best first."""

    def run(batches):
        for row in _solved(batches, model, n):
            ids = pa.array([r[1][0][1].tolist() for r in row], pa.list_(pa.int32()))
            yield pa.record_batch([pa.array([r[0] for r in row], pa.int64()), ids, *_lists(row)], ["doc_id", "ids", "nbest_scores", "nbest_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>, nbest_scores array<double>, nbest_crc32 array<long>")


def digest(docs: DataFrame, model: str, n: int = 3) -> DataFrame:
    """Per document n_pieces, score, nbest_scores, nbest_crc32, and whether decoding each of the n best gives the text back."""

    def run(batches):
        segmenter = _segmenter(model)
        for row in _solved(batches, model, n):
            exact = [all(segmenter.decode(ids) == (text or "").encode() for _, ids in found) for _, found, text in row]
            columns = [pa.array([r[0] for r in row], pa.int64()), pa.array([len(r[1][0][1]) for r in row], pa.int64()), pa.array([r[1][0][0] for r in row], pa.float64())]
            yield pa.record_batch([*columns, *_lists(row), pa.array(exact, pa.bool_())], ["doc_id", "n_pieces", "score", "nbest_scores", "nbest_crc32", "round_trip"])

    schema = "doc_id long, n_pieces long, score double, nbest_scores array<double>, nbest_crc32 array<long>, round_trip boolean"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def _solved(batches, model: str, n: int):
    """Lists of (doc_id, n best, text)."""
    segmenter = _segmenter(model)
    for batch in batches:
        for some in slices(batch):
            texts = some["text"].to_pylist()
            numbers = segmenter.numbers(texts)
            yield [(d, segmenter.text_n_best(x, n), t) for d, x, t in zip(some["doc_id"].to_pylist(), numbers, texts, strict=True)]


def _lists(row) -> list[pa.Array]:
    scores = pa.array([[s for s, _ in r[1]] for r in row], pa.list_(pa.float64()))
    return [scores, pa.array([[zlib.crc32(i.astype("<u4").tobytes()) for _, i in r[1]] for r in row], pa.list_(pa.int64()))]
