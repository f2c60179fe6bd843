"""Token-id files: canonical length-limited Huffman coding of ids from global counts.

A corpus is a folder of files in ascending document order. A file is a sequence of chunks, each
followed by one newline byte. A chunk is, little-endian:

    magic        8 bytes  b"CLHUF01\\n"
    bytes        u64      length of the whole chunk
    docs, ids    u64 u64  documents and ids in the chunk
    block        u32      ids of a block (the last one may be shorter)
    limit        u32      longest code in bits
    table        u32      length of the zlib-compressed code lengths, one byte an id of the vocabulary
    code lengths, then per document id i64, null flag u8 and number of ids u32,
    then the bit offset u64 of each block (the checkpoints), then the bit stream, most significant bit first

Only code lengths are stored: canonical codes follow from them. Blocks are independent: any of them
can be decoded from its checkpoint alone, and the reader decodes all blocks of a chunk side by side
by table look-up. A damaged or foreign file is refused with an error.

Null texts encode as empty ones. Documents stand by (doc_id, ids), null ids first, so that equal ids and
repeated rows each keep their own entry. A very long text is one document of one chunk, encoded whole. Other
columns are not read, whatever their names. An empty table makes no file and gives an empty result.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolex.llm.common import MEMO_BYTES, Interner, discard, memo, memo_bytes, slices, staged, work_path

MAGIC = b"CLHUF01\n"
HEAD = struct.Struct("<8sQQQIII")
BLOCK = 1024
LIMIT = 16
CHUNK_IDS = 2_000_000
FILE_IDS = 8_000_000
_MEMO_BYTES = 5 * MEMO_BYTES


# --- encoding texts -------------------------------------------------------------------------------
class WordEncoder:
    """Encodes texts with a tokenizer whose tokens cross neither white space nor the borders between
    letters, digits and signs, and which lower-cases.

    Words are looked up among those seen by this worker; a new word is cut into runs of letters, single
    digits and runs of signs, and new runs are encoded many in one call. A token that ends a run is told by
    the vocabulary's end-of-word mark. Words with anything but plain letters, digits and signs (apostrophes,
    combining marks, other scripts) are encoded each as it stands. The tokenizer looks for its added tokens before
    it lower-cases, so a word that spells one in any case is kept in its own."""

    LETTER = rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|[\xc5-\xca][\x80-\xbf])"
    SIGNS = rb"[!-&(-/:;=-`{-~]"
    END = "</w>"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        size = self._tokenizer.get_vocab_size()
        self._ends = np.array([(self._tokenizer.id_to_token(i) or "").endswith(self.END) for i in range(size)])
        self._plain = re.compile(rb"(?:%s+|[0-9]|%s+)+" % (self.LETTER, self.SIGNS)).fullmatch
        self._runs = re.compile(rb"%s+|[0-9]|%s+" % (self.LETTER, self.SIGNS)).findall
        self._added = [t.content.encode().lower() for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self._words, self._parts, self._bytes = Interner(), Interner(), 0
        self._of_words, self._of_parts = _Lists(), _Lists()

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_parts(self, parts: list[bytes]) -> None:
        for at in range(0, len(parts), 50_000):
            some = parts[at : at + 50_000]
            joined = [b" ".join(some[i : i + 50]).decode() for i in range(0, len(some), 50)]
            ids = np.array([x for e in self._encode(joined) for x in e], np.uint32)
            ends = np.flatnonzero(self._ends[ids]) + 1
            if len(ends) != len(some) or ends[-1] != len(ids):  # not a vocabulary with end marks
                made = self._encode([p.decode() for p in some])
                ids, lengths = np.array([x for e in made for x in e], np.uint32), np.array([len(e) for e in made], np.int64)
            else:
                lengths = np.diff(ends, prepend=0)
            self._of_parts.extend(ids, lengths)

    def _learn(self, words: list[bytes]) -> None:
        odd = [k for k, w in enumerate(words) if not self._plain(w)]
        runs = [self._runs(w) for w in words]
        for k in odd:
            runs[k] = []
        numbers = self._parts.numbers([r for run in runs for r in run])
        if len(self._parts.new) > len(self._of_parts):
            self._learn_parts(self._parts.new[len(self._of_parts) :])
        ids, lengths = self._of_parts.take(numbers)
        of = np.repeat(np.arange(len(words)), [len(run) for run in runs])
        per_word = np.bincount(of, weights=lengths, minlength=len(words)).astype(np.int64)
        if odd:
            pieces = np.split(ids, np.cumsum(per_word)[:-1])
            for k, e in zip(odd, self._encode([words[k].decode() for k in odd]), strict=True):
                pieces[k] = np.array(e, np.uint32)
            ids, per_word = np.concatenate(pieces), np.array([len(p) for p in pieces], np.int64)
        self._of_words.extend(ids, per_word)

    def batch(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        if self._bytes > _MEMO_BYTES:
            self._forget()
        per_text = [self._split(text.encode("utf-8")) if text else [] for text in texts]
        numbers = self._words.numbers([w for words in per_text for w in words])
        fresh = self._words.new[len(self._of_words) :]
        if fresh:
            self._learn(fresh)
            self._bytes += memo_bytes(fresh)
        at = 0
        for words in per_text:
            yield self._of_words.take(numbers[at : at + len(words)])[0]
            at += len(words)


    def _split(self, raw: bytes) -> list[bytes]:
        low = raw.lower()
        words = low.split()
        if any(x in low for x in self._added):
            words = [own if any(x in w for x in self._added) else w for own, w in zip(raw.split(), words, strict=True)]
        return words


class _Lists:
    """Growing list of id lists."""

    def __init__(self):
        self._ids, self._filled = np.empty(1 << 16, np.uint32), 0
        self._starts, self._lengths = np.empty(0, np.int64), np.empty(0, np.int64)

    def __len__(self) -> int:
        return len(self._starts)

    def extend(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        while self._filled + len(ids) > len(self._ids):
            self._ids = np.concatenate([self._ids, np.empty(len(self._ids), np.uint32)])
        self._ids[self._filled : self._filled + len(ids)] = ids
        self._starts = np.concatenate([self._starts, self._filled + np.cumsum(lengths) - lengths])
        self._lengths = np.concatenate([self._lengths, lengths])
        self._filled += len(ids)

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = self._lengths[numbers]
        if not len(numbers):
            return np.empty(0, np.uint32), lengths
        ends = np.cumsum(lengths)
        return self._ids[np.repeat(self._starts[numbers] - (ends - lengths), lengths) + np.arange(ends[-1])], lengths


def _encoder(path: str) -> WordEncoder:
    return memo(("word encoder", path), lambda: WordEncoder(path))


def id_type(vocabulary: int) -> str:
    """How ids wait for their code: two bytes each where the vocabulary allows it."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def encoded(docs: DataFrame, tokenizer: str, vocabulary: int, end_id: int = 1) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, ids): whole texts as ids of id_type(vocabulary), end_id appended."""
    kind = id_type(vocabulary)

    def run(batches):
        encoder = _encoder(tokenizer)
        end = np.array([end_id], kind)
        for batch in batches:
            for some in slices(batch):
                ids = [np.concatenate([made.astype(kind), end]).tobytes() for made in encoder.batch(some["text"].to_pylist())]
                yield pa.record_batch([some["doc_id"], pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary")


# --- the code -------------------------------------------------------------------------------------
def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits by package-merge; 0 for ids that never occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes of more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    # in each row of the merge, which entries are leaves: the cheapest 2n-2 of the last row pick the lengths
    rows, packages = [], np.empty(0)
    for _ in range(limit):
        merged = np.concatenate([weights, packages])
        leaf = np.concatenate([np.ones(len(weights), bool), np.zeros(len(packages), bool)])
        by = np.argsort(merged, kind="stable")
        merged, leaf = merged[by], leaf[by]
        rows.append(leaf)
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take = 2 * len(order) - 2
    for leaf in reversed(rows):
        leaves = int(leaf[:take].sum())
        lengths[order[:leaves]] += 1
        take = 2 * (take - leaves)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order of (length, id)."""
    codes = np.zeros(len(lengths), np.uint32)
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    if len(used):
        of = lengths[used].astype(np.int64)
        top = int(of.max())
        steps = np.left_shift(1, top - of)
        codes[used] = (np.cumsum(steps) - steps) >> (top - of)
    return codes


class Coder:
    def __init__(self, lengths: np.ndarray, limit: int = LIMIT):
        self.lengths, self.limit, self.codes = lengths, limit, canonical_codes(lengths)
        used = np.flatnonzero(lengths)
        used = used[np.argsort(lengths[used], kind="stable")]
        spans = np.left_shift(1, limit - lengths[used].astype(np.int64))
        self.symbol_at = np.zeros(1 << limit, np.uint32)
        self.length_at = np.zeros(1 << limit, np.uint8)
        self.symbol_at[: spans.sum()] = np.repeat(used, spans)
        self.length_at[: spans.sum()] = np.repeat(lengths[used], spans)
        self.packed_lengths = zlib.compress(lengths.astype(np.uint8).tobytes(), 6)

    def pack(self, ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, bytes]:
        """Bit offsets of the blocks, and the bits."""
        lengths = self.lengths[ids].astype(np.int64)
        if len(ids) and not lengths.all():
            raise ValueError("an id without a code")
        ends = np.cumsum(lengths)
        starts = ends - lengths
        out = np.zeros((int(ends[-1]) if len(ids) else 0) // 8 + 5, np.uint8)
        for at in range(0, len(ids), 1 << 18):
            some = slice(at, at + (1 << 18))
            first = int(starts[at]) >> 3
            word = self.codes[ids[some]].astype(np.uint64) << (np.uint64(32) - (starts[some] & 7).astype(np.uint64) - lengths[some].astype(np.uint64))
            where = (starts[some] >> 3) - first
            for k in range(4):  # bits of different codes never meet: adding is or-ing
                part = np.bincount(where + k, weights=((word >> np.uint64(24 - 8 * k)) & np.uint64(255)).astype(np.float64))
                out[first : first + len(part)] += part.astype(np.uint8)
        return starts[::block], out[: (int(ends[-1]) + 7) // 8 if len(ids) else 0].tobytes()

    def unpack(self, offsets: np.ndarray, bits: bytes, count: int, block: int) -> np.ndarray:
        """All blocks side by side: step k decodes the k-th id of every block by one table look-up each."""
        data = np.frombuffer(bits + b"\0" * 8, np.uint8).astype(np.uint32)
        wide = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
        out = np.zeros((len(offsets), block), np.uint32)
        at, last = offsets.astype(np.int64), count - (len(offsets) - 1) * block
        shift = np.uint32(32 - self.limit)
        for k in range(block):
            if k == last:  # the last block is shorter
                at = at[:-1]
            if not len(at):
                break
            peek = (wide[at >> 3] << (at & 7).astype(np.uint32)) >> shift
            out[: len(at), k] = self.symbol_at[peek]
            step = self.length_at[peek]
            if not step.all():
                raise ValueError("damaged bits")
            at = at + step
        return out.reshape(-1)[:count]


def write_chunk(coder: Coder, doc_ids: list[int | None], parts: list[np.ndarray], block: int = BLOCK) -> bytes:
    ids = np.concatenate(parts).astype(np.int64) if parts else np.empty(0, np.int64)
    offsets, bits = coder.pack(ids, block)
    body = b"".join(
        (
            coder.packed_lengths,
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.array([d is None for d in doc_ids], np.uint8).tobytes(),
            np.array([len(p) for p in parts], "<u4").tobytes(),
            offsets.astype("<u8").tobytes(),
            bits,
        )
    )
    return HEAD.pack(MAGIC, HEAD.size + len(body), len(doc_ids), len(ids), block, coder.limit, len(coder.packed_lengths)) + body


@lru_cache(maxsize=2)
def _coder(packed: bytes, limit: int) -> Coder:
    return Coder(np.frombuffer(zlib.decompress(packed), np.uint8), limit)


def read_chunks(content: bytes) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(doc ids, ids per document, all ids) of each chunk of a file."""
    at = 0
    while at < len(content):
        magic, size, docs, count, block, limit, table = HEAD.unpack_from(content, at)
        if magic != MAGIC or content[at + size : at + size + 1] != b"\n":
            raise ValueError("not a token-id file")
        p = at + HEAD.size
        coder = _coder(content[p : p + table], limit)
        p += table
        names = np.frombuffer(content, "<i8", docs, p)
        nulls = np.frombuffer(content, np.uint8, docs, p + 8 * docs)
        lengths = np.frombuffer(content, "<u4", docs, p + 9 * docs).astype(np.int64)
        blocks = -(-count // block)
        offsets = np.frombuffer(content, "<u8", blocks, p + 13 * docs)
        ids = coder.unpack(offsets, content[p + 13 * docs + 8 * blocks : at + size], count, block) if count else np.empty(0, np.uint32)
        yield [None if z else int(n) for n, z in zip(names, nulls, strict=True)], lengths, ids
        at += size + 1


# --- the operator ---------------------------------------------------------------------------------
def write_corpus(tokens: DataFrame, path: str, vocabulary: int, limit: int = LIMIT, file_ids: int = FILE_IDS) -> None:
    """tokens (doc_id, ids, and row, what tells repeated rows apart) into files of about file_ids ids under path, in
    ascending (doc_id, ids) order. Rows of one doc_id and equal ids are split between files, too, by row.

    The counts that come to the driver are one number an id of the vocabulary."""

    kind = id_type(vocabulary)

    def count(batches):
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for ids in batch["ids"].to_pylist():
                total += np.bincount(np.frombuffer(ids, kind), minlength=vocabulary)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["id", "n"])

    per_id = tokens.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(vocabulary, np.int64)
    for row in per_id:
        counts[row["id"]] = row["n"]
    lengths = code_lengths(counts, limit).tobytes()

    def write(batches):
        coder, names, parts, waiting = Coder(np.frombuffer(lengths, np.uint8), limit), [], [], 0
        for batch in batches:
            for name, ids in zip(batch["doc_id"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                names.append(name)
                parts.append(np.frombuffer(ids, kind))
                waiting += len(parts[-1])
                if waiting >= CHUNK_IDS:
                    yield pa.record_batch([pa.array([write_chunk(coder, names, parts)], pa.binary())], ["value"])
                    names, parts, waiting = [], [], 0
        if names:
            yield pa.record_batch([pa.array([write_chunk(coder, names, parts)], pa.binary())], ["value"])

    files = max(1, round(int(counts.sum()) / file_ids))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("ids"), *([F.col("row")] if "row" in tokens.columns else [])]
    placed = tokens.repartitionByRange(files, *order) if files > 1 else tokens.coalesce(1)
    placed = placed.sortWithinPartitions(*order).mapInArrow(write, "value binary")
    # the text sink writes the bytes of a string as they are; its line end is the newline after each chunk
    placed.select(F.col("value").cast("string")).write.option("compression", "none").text(path)


def read_corpus(spark, path: str) -> DataFrame:
    """Per document (file, at, doc_id, n_tokens, ids_crc32): at is the ids before it in its file."""

    def read(batches):
        for batch in batches:
            for file, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                before = 0
                for names, lengths, ids in read_chunks(content):
                    ends = np.cumsum(lengths)
                    raw = memoryview(ids.astype("<u4").tobytes())
                    crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                    columns = [pa.array([file] * len(names), pa.string()), pa.array(before + ends - lengths, pa.int64()), pa.array(names, pa.int64())]
                    columns += [pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())]
                    yield pa.record_batch(columns, ["file", "at", "doc_id", "n_tokens", "ids_crc32"])
                    before += int(lengths.sum())

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(read, "file string, at long, doc_id long, n_tokens long, ids_crc32 long")


def corpus_file(docs: DataFrame, tokenizer: str, end_id: int = 1, limit: int = LIMIT, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode docs, write the token-id files to the shared folder, read them back: doc_id, start, n_tokens, ids_crc32."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    vocabulary = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1)
    tokens = staged(encoded(docs, tokenizer, vocabulary, end_id), "token-ids", "zstd")
    tokens = tokens.withColumn("row", F.xxhash64("_metadata.file_name", "_metadata.row_index"))  # the same at every reading
    path = work_path(spark, "huffman")
    write_corpus(tokens, path, vocabulary, limit, file_ids)
    discard(tokens)
    read = staged(read_corpus(spark, path), "token-index")
    # ids before each file: one row a file
    totals = read.groupBy("file").agg(F.sum("n_tokens").alias("_n"))
    order = Window.orderBy(F.regexp_extract("file", r"part-(\d+)", 1).cast("long"), "file")
    base = totals.select(F.col("file").alias("_f"), (F.sum("_n").over(order) - F.col("_n")).alias("_base"))
    joined = read.join(F.broadcast(base) if base.count() <= 100_000 else base, F.col("file") == F.col("_f"))
    return joined.select("doc_id", (F.col("_base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
