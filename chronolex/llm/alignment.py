"""Cross-tokenizer alignment by a postings cogroup: which ids of two vocabularies cover the same bytes.

A text is encoded by a byte-level BPE (side A, of a space and the text) and by a SentencePiece BPE (side B, which
adds that space itself). Byte offsets where tokens of both sides end cut the tokens into groups; each A token of a
group is linked to each of its B tokens. An id pair's count is the number of documents that hold it linked.

1. Tasks encode whole texts in batches and write, for each batch and bucket of A ids, the postings of its id pairs
   (documents and multiplicities, sorted by pair), beside one row a document.
2. Counts are summed by pair, each batch's own first; the highest of each A id marks its best pairs.
3. The cogroup: counts and postings of a bucket meet in one partition, sorted by Spark so that the counts come first
   (the sort spills; a task holds one bucket's counts and one batch's postings). Buckets are salted by batch as
   postings grow, so the postings of a frequent id are dealt over many tasks. Contributions are summed by document.

Both sides break at a space or line feed that follows no white space, so such units are encoded once a worker, many
in a call, and met again by look-up. A text with a unit that does not give its bytes back is encoded whole.

Texts that are null, empty or not given back byte for byte by either side (such as those with U+2581) have no
tokens: zeros and an empty digest. Rows are documents: repeated ones count each, null doc_ids too. Very long texts
are one document of a batch of its own. Other columns are not read, whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolex.llm.common import ENTRY_BYTES, MEMO_BYTES, Interner, memo, segments, slices, staged

BUCKETS = 32
PART_BYTES = 32 << 20  # postings of a cogroup partition
_MEMO_UNITS = 5 * MEMO_BYTES // (2 * ENTRY_BYTES)
_JOIN_UNITS = 64
_HELD_PAIRS = 1 << 21
_WIDE = 1 << 12  # links of a group from which they are counted by distinct ids

#: white space, as the pre-tokenizer of side A sees it; _INNER is the part at which units do not break
_INNER = r"\t\x0b-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACES = r" \n" + _INNER
_UNITS = re.compile(f"[ \\n][{_SPACES}]*[^{_SPACES}]*(?:[{_INNER}][{_SPACES}]*[^{_SPACES}]*)*").findall
_ENDS_OPEN = re.compile(f"[{_SPACES}]\\Z").search


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class SideA:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        letters, size = byte_letters(), self._tokenizer.get_vocab_size()
        entries = [self._tokenizer.id_to_token(i) or "" for i in range(size)]
        self.bytes = [bytes(letters[c] for c in e) if all(c in letters for c in e) else e.encode() for e in entries]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts that begin with the space or line feed that stands before them."""
        return [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class SideB:
    SPACE = "▁"

    def __init__(self, path: str):
        import sentencepiece

        self._model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace(self.SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self._space = m.piece_to_id(self.SPACE)
        #: no piece goes on past a space or line feed that follows something else
        self.breaks = not any("\n" in p or re.search(f"[^{self.SPACE}]{self.SPACE}", p) for p in pieces)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts that begin with a space, which the model adds itself, or with a line feed, before which it adds one too many."""
        asked = [t[1:] if t[0] == " " else t for t in texts]
        made = self._model.encode(asked, num_threads=1)
        return [ids if t[0] == " " and a else [self._space] if not a else ids[1:] for t, a, ids in zip(texts, asked, made, strict=True)]


class Aligned:
    """Aligned units: of unit k, the tokens of both sides, groups, links and id pairs with multiplicities, and its groups as text."""

    def __init__(self, a: SideA, b: SideB, units: list[str], a_ids: np.ndarray, b_ids: np.ndarray):
        """a_ids, b_ids: tokens of all units in a row, both giving the units' bytes back; every unit ends where tokens of both end."""
        self.n = len(units)
        ends = np.cumsum(np.fromiter((len(u.encode()) for u in units), np.int64, len(units)))
        a_ends, b_ends = np.cumsum(a.lengths[a_ids]), np.cumsum(b.lengths[b_ids])
        cuts = np.intersect1d(a_ends, b_ends)
        a_group, b_group = np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends)
        per_a, per_b = np.bincount(a_group, minlength=len(cuts)), np.bincount(b_group, minlength=len(cuts))
        of_group = np.searchsorted(ends, cuts)
        self.n_a, self.n_b, self.n_groups, self.n_links = (np.bincount(of_group, weights=w, minlength=self.n).astype(np.int64) for w in (per_a, per_b, np.ones(len(cuts)), per_a * per_b))
        first_b = np.cumsum(per_b) - per_b
        wide = per_a * per_b > _WIDE
        each = np.where(wide[a_group], 0, per_b[a_group])
        begin, of_a = segments(each)
        at_b = np.repeat(first_b[a_group], each) + np.arange(len(of_a)) - np.repeat(begin, each)
        unit, pair, times = [of_group[a_group[of_a]]], [a_ids[of_a] << b.bits | b_ids[at_b]], [np.ones(len(of_a), np.int64)]
        first_a = np.cumsum(per_a) - per_a
        for g in np.flatnonzero(wide):
            xa, na = np.unique(a_ids[first_a[g] : first_a[g] + per_a[g]], return_counts=True)
            xb, nb = np.unique(b_ids[first_b[g] : first_b[g] + per_b[g]], return_counts=True)
            pair.append((xa[:, None] << b.bits | xb[None, :]).ravel())
            times.append((na[:, None] * nb[None, :]).ravel())
            unit.append(np.full(len(pair[-1]), of_group[g]))
        unit, pair, times = np.concatenate(unit), np.concatenate(pair), np.concatenate(times)
        order = np.lexsort((pair, unit))
        unit, pair, times = unit[order], pair[order], times[order]
        new = np.flatnonzero(np.concatenate([[True], (unit[1:] != unit[:-1]) | (pair[1:] != pair[:-1])])) if len(unit) else np.empty(0, np.int64)
        self.pair, self.times = pair[new], np.add.reduceat(times, new) if len(new) else times
        self.pairs = np.bincount(unit[new], minlength=self.n).astype(np.int64)
        said_a, said_b = list(map(str, a_ids.tolist())), list(map(str, b_ids.tolist()))
        pieces, i, j = [], 0, 0
        for x, y in zip(per_a.tolist(), per_b.tolist(), strict=True):
            pieces.append((said_a[i] if x == 1 else ",".join(said_a[i : i + x])) + "|" + (said_b[j] if y == 1 else ",".join(said_b[j : j + y])))
            i, j = i + x, j + y
        cut = np.cumsum(self.n_groups).tolist()
        self.text = [";".join(pieces[x:y]) for x, y in zip([0, *cut], cut, strict=False)]


class Aligner:
    """Aligns texts; units met before are looked up. A worker remembers a bounded number of them."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = SideA(a_path), SideB(b_path)
        self.b.bits = int(len(self.b.bytes) - 1).bit_length()
        self._forget()

    def _forget(self) -> None:
        self._units, self.text = Interner(), []
        empty = np.empty(0, np.int64)
        self._n = np.empty((0, 5), np.int64)  # tokens of A and B, groups, links, distinct pairs
        self._first, self._pair, self._times, self._odd = empty, empty, empty, np.empty(0, bool)

    def _joined(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Tokens of units that end in no white space, encoded many in a row; None where bytes or cuts do not agree."""
        rows = ["".join(units[k : k + _JOIN_UNITS]) for k in range(0, len(units), _JOIN_UNITS)]
        a, b = (np.array([x for ids in side.encode(rows) for x in ids], np.int64) for side in (self.a, self.b))
        raw = "".join(rows).encode()
        if b"".join(map(self.a.bytes.__getitem__, a)) != raw or b"".join(map(self.b.bytes.__getitem__, b)) != raw:
            return None
        ends = np.cumsum([len(u.encode()) for u in units])
        both = np.isin(ends, np.cumsum(self.a.lengths[a])) & np.isin(ends, np.cumsum(self.b.lengths[b]))
        return (a, b, ends) if both.all() else None

    def _each(self, units: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Units encoded each on its own: those that both sides give back, with their tokens, and which those are."""
        a, b = self.a.encode(units), self.b.encode(units)
        good = np.array([b"".join(map(self.a.bytes.__getitem__, x)) == u.encode() == b"".join(map(self.b.bytes.__getitem__, y)) for u, x, y in zip(units, a, b, strict=True)], bool)
        kept = [u for u, g in zip(units, good, strict=True) if g]
        return kept, *(np.array([x for ids, g in zip(side, good, strict=True) if g for x in ids], np.int64) for side in (a, b)), good

    def align(self, units: list[str]) -> tuple[Aligned, np.ndarray]:
        """The units that both sides give back, and which of the given ones those are."""
        kept, a, b, good = self._each(units)
        return Aligned(self.a, self.b, kept, a, b), good

    def _learn(self, units: list[str]) -> None:
        shut = [u for u in units if not _ENDS_OPEN(u)]
        found = self._joined(shut) if self.b.breaks and shut else None
        if found is not None:
            many, rest = Aligned(self.a, self.b, shut, *found[:2]), [u for u in units if _ENDS_OPEN(u)]
        else:
            many, rest = None, units
        one, good = self.align(rest)
        at, sizes = {}, [p for p in (many, one) if p is not None]
        base = len(self._pair)
        first, table, text, n = [], [], [], 0
        for part in sizes:
            first.append(base + np.cumsum(part.pairs) - part.pairs)
            table.append(np.stack([part.n_a, part.n_b, part.n_groups, part.n_links, part.pairs], axis=1))
            text += part.text
            base += len(part.pair)
            n += part.n
        names = (shut if many is not None else []) + [u for u, g in zip(rest, good, strict=True) if g]
        at = {u: k for k, u in enumerate(names)}
        place = np.array([at.get(u, n) for u in units], np.int64)
        table, first = np.concatenate([*table, np.zeros((1, 5), np.int64)]), np.concatenate([*first, [0]])
        text.append("")
        self._n = np.concatenate([self._n, table[place]])
        self._first = np.concatenate([self._first, first[place]])
        self._odd = np.concatenate([self._odd, place == n])
        self.text += [text[k] for k in place.tolist()]
        self._pair = np.concatenate([self._pair, *(p.pair for p in sizes)])
        self._times = np.concatenate([self._times, *(p.times for p in sizes)])

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each text its tokens of A and B, groups and links, and its groups' digest; then (text number, id pair, times) of all links."""
        if len(self._units.new) > _MEMO_UNITS:
            self._forget()
        per_text = [_UNITS(" " + t) if t else [] for t in texts]
        numbers = self._units.numbers([u for units in per_text for u in units])
        if len(self._units.new) > len(self.text):
            self._learn(self._units.new[len(self.text) :])
        counts = np.array([len(u) for u in per_text], np.int64)
        _, of = segments(counts)
        odd = np.bincount(of, weights=self._odd[numbers], minlength=len(texts)) > 0
        sums = np.stack([np.bincount(of, weights=self._n[numbers, k], minlength=len(texts)) for k in range(4)], axis=1).astype(np.int64)
        sums[odd] = 0
        at, digests = 0, []
        for k, n in enumerate(counts.tolist()):
            said = ";".join(map(self.text.__getitem__, numbers[at : at + n].tolist())) if n and not odd[k] else ""
            digests.append(hashlib.sha256(said.encode()).hexdigest() if said else "")
            at += n
        kept = ~odd[of]
        key, times = np.unique(of[kept] * (len(self.text) + 1) + numbers[kept], return_counts=True)
        doc, unit = key // (len(self.text) + 1), key % (len(self.text) + 1)
        each = self._n[unit, 4]
        begin, row = segments(each)
        pick = np.repeat(self._first[unit], each) + np.arange(len(row)) - np.repeat(begin, each)
        links = [(doc[row], self._pair[pick], self._times[pick] * times[row])]
        for k in np.flatnonzero(odd):
            whole, good = self.align([" " + texts[k]])
            if good[0]:
                sums[k] = whole.n_a[0], whole.n_b[0], whole.n_groups[0], whole.n_links[0]
                digests[k] = hashlib.sha256(whole.text[0].encode()).hexdigest()
                links.append((np.full(len(whole.pair), k), whole.pair, whole.times))
        return sums, digests, tuple(np.concatenate(c) for c in zip(*links, strict=True))


def _bucket(a: np.ndarray) -> np.ndarray:
    return (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % BUCKETS


_DOCUMENT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
_POSTINGS = "batch long, pos int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, bucket int, pairs binary, holders binary, docs binary, times binary"


def postings(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """docs (doc_id, text) -> a row a document (bucket null), and a row for each batch and bucket of A ids: id pairs in
    ascending order (u64), how many documents hold each (u32), those documents' positions in the batch (u16) and multiplicities (u32)."""

    def run(batches):
        aligner = memo(("aligner", a_path, b_path), lambda: Aligner(a_path, b_path))
        serial = TaskContext.get().partitionId() << 32
        for batch in batches:
            for some in slices(batch, size=2 << 20):
                sums, digests, (doc, pair, times) = aligner.batch(some["text"].to_pylist())
                n = some.num_rows
                bucket = _bucket(pair >> aligner.b.bits)
                order = np.lexsort((doc, pair, bucket))
                doc, pair, times, bucket = doc[order], pair[order], times[order], bucket[order]
                new = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])])) if len(pair) else np.empty(0, np.int64)
                doc, pair, bucket, times = doc[new], pair[new], bucket[new], np.add.reduceat(times, new) if len(new) else times
                rows = [(k, *(x[lo:hi] for x in (pair, doc, times))) for k in range(BUCKETS) if (lo := np.searchsorted(bucket, k)) < (hi := np.searchsorted(bucket, k + 1))]
                packed = []
                for k, p, d, t in rows:
                    head, holders = np.unique(p, return_counts=True)
                    packed.append((k, head.astype("<u8").tobytes(), holders.astype("<u4").tobytes(), d.astype("<u2").tobytes(), t.astype("<u4").tobytes()))
                nothing = [None] * len(packed)
                yield pa.record_batch(
                    [
                        pa.array([serial] * (n + len(packed)), pa.int64()),
                        pa.array([*range(n), *nothing], pa.int32()),
                        pa.array([*some["doc_id"].to_pylist(), *nothing], pa.int64()),
                        *(pa.array([*sums[:, k].tolist(), *nothing], pa.int64()) for k in range(4)),
                        pa.array([*digests, *nothing], pa.string()),
                        pa.array([*[None] * n, *(x[0] for x in packed)], pa.int32()),
                        *(pa.array([*[None] * n, *(x[k] for x in packed)], pa.binary()) for k in range(1, 5)),
                    ],
                    ["batch", "pos", *_DOCUMENT, "bucket", "pairs", "holders", "docs", "times"],
                )
                serial += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _POSTINGS)


def pair_counts(postings: DataFrame, bits: int) -> DataFrame:
    """(bucket, pair, n, best): in how many documents each id pair is linked, and whether no pair of its A id is in more."""

    def summed(held):
        pair, of = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        return pair, np.bincount(of, weights=np.concatenate([h[1] for h in held]), minlength=len(pair)).astype(np.int64)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for p, h in zip(batch["pairs"], batch["holders"], strict=True):
                held.append((np.frombuffer(p.as_buffer(), "<u8"), np.frombuffer(h.as_buffer(), "<u4").astype(np.int64)))
                size += len(held[-1][0])
                if size > _HELD_PAIRS:
                    held = [summed(held)]
                    size = len(held[0][0])
                    if size > _HELD_PAIRS // 2:
                        yield rows(held[0])
                        held, size = [], 0
        if held:
            yield rows(summed(held))

    def rows(found):
        return pa.record_batch([pa.array(_bucket(found[0] >> np.uint64(bits)), pa.int32()), pa.array(found[0].astype(np.int64)), pa.array(found[1])], ["bucket", "pair", "n"])

    parts = postings.filter("bucket IS NOT NULL").select("pairs", "holders").mapInArrow(run, "bucket int, pair long, n long")
    counts = parts.groupBy("bucket", "pair").agg(F.sum("n").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.shiftrightunsigned("pair", bits)))
    return counts.withColumn("best", F.col("n") == most)


def contributions(postings: DataFrame, counts: DataFrame) -> DataFrame:
    """(batch, pos, n_best, count_sum) of each document and bucket: postings meet their bucket's counts."""
    lists = postings.filter("bucket IS NOT NULL")
    size = lists.agg(F.sum(F.octet_length("docs") + F.octet_length("times") + F.octet_length("pairs"))).first()[0] or 0
    salts = max(1, -(-size // (BUCKETS * PART_BYTES)))
    part = lambda salt: (F.col("bucket") * F.lit(salts) + salt).cast("int").alias("part")
    streamed = lists.select(part(F.pmod(F.xxhash64("batch"), F.lit(salts))), F.lit(1).alias("kind"), "batch", "pairs", "holders", "docs", "times")
    tables = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select(part(F.col("salt")), F.lit(0).alias("kind"), "pair", "n", "best")
    met = tables.unionByName(streamed, allowMissingColumns=True).repartitionById(BUCKETS * salts, F.col("part")).sortWithinPartitions("part", "kind", "pair")

    def run(batches):
        held, table = [], None
        for batch in batches:
            cut = int(np.searchsorted(batch["kind"].to_numpy(), 1))
            if cut:
                held.append(tuple(batch[c].slice(0, cut).to_numpy(zero_copy_only=False) for c in ("pair", "n", "best")))
            if cut == batch.num_rows:
                continue
            if table is None:
                table = tuple(np.concatenate(c) for c in zip(*held, strict=True))
                held = []
            for row in batch.slice(cut).select(["batch", "pairs", "holders", "docs", "times"]).to_pylist():
                at = np.searchsorted(table[0], np.frombuffer(row["pairs"], "<u8").astype(np.int64))
                holders, docs, times = np.frombuffer(row["holders"], "<u4"), np.frombuffer(row["docs"], "<u2"), np.frombuffer(row["times"], "<u4").astype(np.float64)
                best = np.bincount(docs, weights=times * np.repeat(table[2][at], holders))
                total = np.bincount(docs, weights=times * np.repeat(table[1][at], holders))
                some = np.flatnonzero(np.bincount(docs))
                yield pa.record_batch([pa.array([row["batch"]] * len(some), pa.int64()), pa.array(some, pa.int32()), pa.array(best[some].astype(np.int64)), pa.array(total[some].astype(np.int64))], ["batch", "pos", "n_best", "count_sum"])

    columns = ["kind", "pair", "n", "best", "batch", "pairs", "holders", "docs", "times"]
    return met.select(columns).mapInArrow(run, "batch long, pos int, n_best long, count_sum long")


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document of docs (doc_id, text)."""
    import sentencepiece

    bits = int(sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size() - 1).bit_length()
    made = staged(postings(docs, a_path, b_path), "alignment", "zstd")
    given = contributions(made, staged(pair_counts(made, bits), "pair-counts"))
    sums = given.groupBy("batch", "pos").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    own = made.filter("bucket IS NULL").select("batch", "pos", *_DOCUMENT)
    out = own.join(sums, ["batch", "pos"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
