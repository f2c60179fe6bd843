r"""WARC archives: one gzip member a record, written by Spark's text sink, read by byte ranges.

Reader. Spark's text source cuts the archives into byte ranges, one task each, and each range at every
gzip magic (1F 8B 08); a piece belongs to the range in which it starts. A piece starts a candidate
member if its gzip header decodes and its first inflated bytes are a WARC version line. The magic can
also occur inside compressed data: a piece that meets an unfinished member continues it, and pieces
before a range's first member go, with the unfinished last member of the range before, to a small
second stage that joins them by (file, range); so do empty members and pieces too short to tell. So every record is read once, by the task in whose range
it starts, whatever the ranges are. Files need no index and no common record size.

Writer. The text sink writes the bytes of a value as they are and ends it with one byte; that byte is
the last one of the member (the top byte of its length, 0 below 16 MiB), so that files are plain
concatenated gzip members. A longer member is followed by an empty one, whose last byte is 0.

Damaged members, bytes between members and records without a WARC header raise an error. Null urls
leave their header out, null html is an empty payload, null ids are written as `null`; repeated rows are
records each. Very long payloads are one member each. Other columns of pages are not read, whatever their
names; an empty table gives an archive without records and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.llm.common import slices, staged, work_path

MAGIC = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"
PROBE = 512
BROADCAST_DIGESTS = 200_000  # some 15 MB
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
RECORD = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_length long, payload binary"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- members --------------------------------------------------------------------------------------
def record_member(record_id: str, record_type: str, uri: str | None, payload: bytes | None, length: int, digest: str, refers_to: str | None) -> bytes:
    """A response with its payload, or a revisit that names the record which has the payload of that length; as one gzip member."""
    lines = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    block = _HTTP % length
    if record_type == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    else:
        block += payload
    lines.append(f"Content-Length: {len(block)}")
    body = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return _gzip(body)


def _gzip(body: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = packer.compress(body) + packer.flush()
    return MAGIC + b"\0\0\0\0\0\0\xff" + packed + struct.pack("<II", zlib.crc32(body), len(body) & 0xFFFFFFFF)


def sink_value(member: bytes) -> bytes:
    """What the text sink must write before its zero byte."""
    if member[-1]:
        member += _gzip(b"")
    return member[:-1]


def opens_record(piece: bytes) -> bool:
    """Whether bytes that start with the magic decode as a gzip header and a WARC version line."""
    try:
        start = zlib.decompressobj(31).decompress(piece[:PROBE], 16)
    except zlib.error:
        return False
    return start.startswith(b"WARC/1.")


def _header_text(value: bytes) -> str:
    """UTF-8, as the standard has it, or else Latin-1."""
    try:
        return value.decode()
    except UnicodeDecodeError:
        return value.decode("latin-1")


def parse_record(body: bytes) -> tuple:
    """A decompressed member as a row of RECORD."""
    head, cut, rest = body.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not cut or not lines[0].startswith(b"WARC/1."):
        raise ValueError("no WARC header")
    fields = {k.strip().lower(): _header_text(v.strip()) for k, _, v in (line.partition(b":") for line in lines[1:])}
    block = rest[: int(fields[b"content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("record length and content disagree")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next((int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")), len(payload))
    kind, digest = fields[b"warc-type"], fields.get(b"warc-payload-digest", "").removeprefix("sha1:") or None
    if kind == "revisit":
        payload = None
    else:
        made = sha1_base32(payload)
        if digest not in (None, made) or length != len(payload):
            raise ValueError("payload and header disagree")
        digest = made
    refers = fields.get(b"warc-refers-to")
    return fields[b"warc-record-id"][1:-1], kind, fields.get(b"warc-target-uri"), refers and refers[1:-1], digest, length, payload


class _Member:
    """A member as far as it has been read."""

    def __init__(self, piece: bytes):
        self._inflate, self._out, self.raw = zlib.decompressobj(31), [], []
        self.feed(piece)

    def feed(self, piece: bytes) -> None:
        self.raw.append(piece)
        self._out.append(self._inflate.decompress(piece))

    @property
    def whole(self) -> bool:
        return self._inflate.eof

    def row(self) -> tuple | None:
        if self._inflate.unused_data.strip(b"\0"):
            raise ValueError("bytes between members")
        body = b"".join(self._out)
        return parse_record(body) if body else None


def join_pieces(pieces: Iterator[bytes], known: bool = False) -> Iterator[tuple[str, object]]:
    """Pieces of one range in order -> ("record", row), ("orphan", piece) before the first member, ("tail", bytes) of an unfinished last one.

    known: what follows a whole member, and comes first, is a member; else what can't be told to open a record is an orphan."""
    member = None
    for piece in pieces:
        if member is not None and not member.whole:
            member.feed(piece)
        elif member is None and not known and not opens_record(piece):
            yield "orphan", piece
            continue
        else:
            if member is not None:
                yield "record", member.row()
            member = _Member(piece)
    if member is not None:
        yield ("record", member.row()) if member.whole else ("tail", b"".join(member.raw))


# --- reading --------------------------------------------------------------------------------------
def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records (RECORD) of the gzipped archives under path; a revisit has no payload, its length is that of the payload it stands for."""
    pieces = spark.read.option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin-1")).text(path)
    pieces = pieces.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("piece"))
    names = [c.split()[0] for c in RECORD.split(", ")]
    kinds = [pa.string()] * 5 + [pa.int64(), pa.binary()]

    def rows_of(batches):
        for batch in batches:
            yield from zip(*(batch[k].to_pylist() for k in ("file", "start", "piece")), strict=True)

    def ranges(batches):
        """Runs of rows of the same range; a task may hold several."""
        rows, held = rows_of(batches), None
        held = next(rows, None)
        while held is not None:
            key = held[:2]

            def run():
                nonlocal held
                first = True
                while held is not None and held[:2] == key:
                    # what stands before a file's first magic must be nothing
                    if not (first and key[1] == 0):
                        yield MAGIC + held[2]
                    elif held[2].strip(b"\0"):
                        raise ValueError("the file does not start with a gzip member")
                    first, held = False, next(rows, None)

            yield key, run()

    def packed(records, loose):
        columns = [pa.array([r[i] for r in records] + [None] * len(loose), kind) for i, kind in enumerate(kinds)]
        loose = [(None,) * 4] * len(records) + loose
        columns += [pa.array([x[i] for x in loose], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.binary()))]
        return pa.record_batch(columns, [*names, "file", "start", "nth", "piece"])

    def scan(batches):
        records, loose, held = [], [], 0
        for (file, start), run in ranges(batches):
            for nth, (what, x) in enumerate(join_pieces(run)):
                if what == "record" and x is not None:
                    records.append(x)
                    held += len(x[-1] or b"")
                elif what != "record":
                    loose.append((file, start, nth, x))
                if len(records) >= 1000 or held > 8 << 20:
                    yield packed(records, [])
                    records, held = [], 0
        yield packed(records, loose)

    def stitch(pdf):
        import pandas as pd

        found, pieces = [], [bytes(x) for x in pdf.sort_values(["start", "nth"])["piece"]]
        # here what an unfinished member lacks follows it, so anything else opens a member: an empty one, or one that
        # a false magic cuts too early to tell at the start of its range
        for what, x in join_pieces(iter(pieces), known=True):
            if what != "record":
                raise ValueError("an archive has bytes that belong to no record")
            found += [x] * (x is not None)
        return pd.DataFrame(found, columns=names)

    scanned = pieces.mapInArrow(scan, f"{RECORD}, file string, start long, nth long, piece binary")
    whole = scanned.filter("file IS NULL").select(*names)
    # seldom any rows: a member that a false magic at the end of a range cuts, and its rest
    return whole.unionByName(scanned.filter("file IS NOT NULL").select("file", "start", "nth", "piece").groupBy("file").applyInPandas(stitch, RECORD))


# --- writing --------------------------------------------------------------------------------------
def write_warc(records: DataFrame, path: str) -> None:
    """records (record_id, record_type, target_uri, payload: null for revisits, payload_length, payload_digest, refers_to) as archives under path, one a task."""

    def members(batches):
        names = ("record_id", "record_type", "target_uri", "payload", "payload_length", "payload_digest", "refers_to")
        for batch in batches:
            for some in slices(batch, "payload"):
                made = [sink_value(record_member(*row)) for row in zip(*(some[n].to_pylist() for n in names), strict=True)]
                yield pa.record_batch([pa.array(made, pa.binary())], ["value"])

    written = records.mapInArrow(members, "value binary").select(F.col("value").cast("string"))
    written.write.option("lineSep", "\0").option("compression", "none").text(path)


def archived(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) with the record each becomes. Of records with equal payloads of at least
    min_bytes bytes that with the largest page_id is the response, the others revisit it; rows that share
    that id and payload are responses each."""
    pages = pages.select(F.col("page_id").cast("long"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    pages = pages.withColumn("sha1", F.sha1("payload")).withColumn("bytes", F.octet_length("payload").cast("long"))
    # a digest has one row here, summed before the shuffle; only digests of several pages are joined, where they are
    # few enough without moving a payload
    kept = pages.filter(F.col("bytes") >= min_bytes).groupBy("sha1", "bytes").agg(F.max("page_id").alias("kept_id"), F.count(F.lit(1)).alias("n"))
    kept = staged(kept.filter("n > 1").drop("n"), "warc-digests")
    joined = pages.join(F.broadcast(kept) if kept.count() <= BROADCAST_DIGESTS else kept, ["sha1", "bytes"], "left")
    revisit = F.col("kept_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept_id"))
    name = F.concat(F.lit("urn:x-page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))
    return joined.select(
        name.alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.when(~revisit, F.col("payload")).alias("payload"),
        F.col("bytes").alias("payload_length"),
        base32_of_hex(F.col("sha1"), 40).alias("payload_digest"),
        F.when(revisit, F.concat(F.lit("urn:x-page:"), F.col("kept_id").cast("string"))).alias("refers_to"),
    )


def base32_of_hex(column, digits: int):
    """Upper-case base32 of hexadecimal text whose bits divide into groups of five (40 digits are 32 groups)."""
    groups = [F.conv(F.substring(column, 1 + 5 * i, 5), 16, 32) for i in range(digits // 5)]
    plain = F.concat(*[F.lpad(g, 4, "0") for g in groups])
    return F.translate(plain, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Archive pages in the shared folder and read the archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = work_path(spark, "warc")
    write_warc(archived(pages, min_bytes), path)
    read = read_warc(spark, path)

    def page(column):
        return F.regexp_extract(column, r"^urn:x-page:(\d+|-\d+)$", 1).try_cast("long")

    return read.select(
        page("record_id").alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        page("refers_to").alias("refers_to"),
    )
