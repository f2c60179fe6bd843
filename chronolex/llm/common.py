"""What the operators share: the shared work folder, words of a text, 64-bit mixing."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: `[^\x20\x09-\x0D]+` of the contracts; bytes.split() without arguments cuts at the same bytes.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: What a worker may remember of words, in bytes by rough count: of each word its own bytes and ENTRY_BYTES.
MEMO_BYTES, ENTRY_BYTES = 32 << 20, 200
_BATCH_BYTES, _BATCH_CONF = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir of the session.

    Where it is unset, a temporary folder stands in, but only in local mode."""
    conf = spark.sparkContext.getConf()
    base = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not conf.get("spark.master", "").startswith("local") or "cluster" in conf.get("spark.master", ""):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = f"file://{tempfile.mkdtemp(prefix='chronolex-')}"
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def _bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to 4 MB: by rows alone, batches of long texts hold gigabytes."""
    if int(spark.conf.get(_BATCH_CONF).rstrip("b")) > _BATCH_BYTES:
        spark.conf.set(_BATCH_CONF, str(_BATCH_BYTES))


def work_path(spark: SparkSession, name: str) -> str:
    _bounded_batches(spark)
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df written to the shared folder and read again: later stages start there, whatever executors get lost.

    zstd is for large tables that it makes much smaller: its buffers stay with the executor, outside the heap."""
    path = work_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the files of staged frames that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        for top in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(top)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    _bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores after it until no column of df has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_fold(column, folds: int):
    """crc32 of the id as decimal text, modulo folds; null ids count as empty text."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def crc_of(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def words_of(text: str | None) -> list[bytes]:
    """Words of the contracts, with A-Z (and nothing else) lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Interner(dict):
    """word -> dense number; numbers are given at first sight. `new` holds words in the order of their numbers."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.new)
        self.new.append(word)
        return n

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


class WordHashes:
    """64-bit hashes of words, each computed once per worker as long as it stays among the remembered ones."""

    def __init__(self):
        self._interner, self._hashes, self._filled, self._bytes = Interner(), np.empty(1 << 16, np.uint64), 0, 0

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if self._bytes > MEMO_BYTES:
            self.__init__()
        numbers = self._interner.numbers(words)
        fresh = self._interner.new[self._filled :]
        if fresh:
            made = np.frombuffer(b"".join([hashlib.blake2b(w, digest_size=8).digest() for w in fresh]), "<u8")
            while self._filled + len(made) > len(self._hashes):
                self._hashes = np.concatenate([self._hashes, np.empty(len(self._hashes), np.uint64)])
            self._hashes[self._filled : self._filled + len(made)] = made
            self._filled += len(made)
            self._bytes += memo_bytes(fresh)
        return self._hashes[numbers]


def memo_bytes(words: list[bytes]) -> int:
    return sum(map(len, words)) + ENTRY_BYTES * len(words)


_memo: dict = {}


def memo(key, make):
    """What a Python worker remembers between tasks, made at first use. A worker holds one such thing: asking for
    another, as a later stage of a pipeline does, lets go of it."""
    if key not in _memo:
        forget()
        _memo[key] = make()
    return _memo[key]


def forget() -> None:
    """Let go of what the worker remembers, down to the system: workers outlive stages, and their memory adds up."""
    if _memo:
        _memo.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library keeps what it was given
            pass


def slices(batch: pa.RecordBatch, column: str = "text", rows: int = 500, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with at most `rows` rows and, but for a longer text alone, `size` bytes of text."""
    lengths = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(lengths, dtype=np.int64), 0
    while at < batch.num_rows:
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right"))
        to = min(max(to, at + 1), at + rows, batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def segments(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of consecutive runs of the given lengths, and for each element the number of its run."""
    ends = np.cumsum(lengths)
    return ends - lengths, np.repeat(np.arange(len(lengths)), lengths)
