"""WARC archives of Zstandard frames: writer, reader, identical-payload revisits.

An archive is one file: a leading skippable frame with the dictionary, then one
Zstandard frame for each record.  Spark's text writer writes it: every row is a
frame, and the line separator is itself an empty skippable frame, so frames may
be written one by one under Spark's own commit protocol (a lost task leaves
nothing) and the file is a valid sequence of frames.  The reader gets whole
files (their size is bounded by the records of an archive and by the input split
that a writing task reads), takes the dictionary from the leading frame, cuts the
file at the frames' own block headers, decodes one frame at a time and checks
headers, lengths and digests.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staywise.llm.common import count_rows, cut, pick, prepare
from staywise.session import checkpoint_dir

# Fixed values of the Zstandard and WARC formats.
FRAME = 0xFD2FB528
DICTIONARY = 0xEC30A437
SKIPPABLE, SKIPPABLE_MASK = 0x184D2A50, 0xFFFFFFF0
DICTIONARY_FRAME = 0x184D2A5D
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("warc-record-id", "warc-type", "warc-date", "content-length")

#: An empty skippable frame; its eight bytes are ASCII, so it can separate lines.
SEPARATOR = struct.pack("<II", SKIPPABLE, 0).decode("ascii")
#: Records of one archive, and rows that a task may hold while it makes the dictionary.
ARCHIVE_RECORDS, SAMPLE_RECORDS, SAMPLE_BYTES = 4096, 256, 16 << 10
#: Size of a dictionary, and the least sample worth making one of.
DICTIONARY_BYTES, LEAST_SAMPLE = 32 << 10, 8
#: Repeated payloads up to this number are sent to all tasks; beyond it Spark joins.
BROADCAST_ROWS = 200_000
#: The greatest record that a reader accepts.
MOST_BYTES = 1 << 30


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


# ---------------------------------------------------------------- writing

def record(kind: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record: an HTTP message whose body is the payload; a revisit holds the message's head only."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + payload if kind == "response" else head
    fields = [("WARC-Type", kind), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", date)]
    if url is not None:  # bytes that a header cannot hold are escaped
        fields.append(("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]")))
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(refers_to))]
    fields += [("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
               ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n" + block + b"\r\n\r\n"


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def dictionary_of(samples: list[bytes]) -> bytes:
    """A dictionary made of sampled records; of few or tiny ones, none."""
    import zstandard

    samples = [s[:SAMPLE_BYTES] for s in samples]
    if len(samples) < LEAST_SAMPLE or sum(map(len, samples)) < 4 * DICTIONARY_BYTES:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, dict_id=1 << 20, level=3).as_bytes()
    except zstandard.ZstdError:  # samples that share nothing
        return b""


def skippable(data: bytes, magic: int = DICTIONARY_FRAME) -> bytes:
    return struct.pack("<II", magic, len(data)) + data


def payload_roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Payloads (``key``: SHA-1 and length) that several rows of at least
    ``least_bytes`` share: the largest page_id (null if all are null).  Only
    keys are shuffled, added up before."""
    keys = pages.where(F.length("payload") >= least_bytes).select("page_id", _key().alias("key"))
    return keys.groupBy("key").agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "largest")


def _key():
    return F.concat(F.sha1("payload"), F.lit(":"), F.length("payload").cast("string"))


def write(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = "2020-01-01T00:00:00Z", records: int = ARCHIVE_RECORDS,
          id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Archives of all rows in ``folder``, one or more for each task.

    Of rows with equal payloads of at least ``least_bytes`` bytes the one with
    the largest page_id is a ``response`` and the others are ``revisit`` records
    that refer to it; shorter payloads are all ``response``.  Rows equal in
    page_id and payload are the same page: at the largest id each is a
    ``response``.  A null payload is empty; a null page_id is smaller than any
    other.  No other column is read."""
    spark = pages.sparkSession
    prepare(spark)
    rows = pick(pages, page_id=id_col, url=url_col, payload=payload_col).select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("payload").cast("binary"), F.lit(b"")).alias("payload"))
    roles = cut(payload_roles(rows, least_bytes))
    if count_rows(roles) <= BROADCAST_ROWS:
        roles = F.broadcast(roles)
    rows = rows.withColumn("key", _key()).join(roles, "key", "left").select("page_id", "url", "payload", "largest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        frames, compress = 0, None
        for b in batches:
            made = []
            for page, url, payload, largest in zip(*(b.column(k).to_pylist() for k in range(4))):
                kind = "response" if largest is None or page == largest else "revisit"
                made.append(record(kind, page, url, payload, largest if kind == "revisit" else None, date))
            if compress is None:
                learnt = dictionary_of(made[:SAMPLE_RECORDS])
                shared = zstandard.ZstdCompressionDict(learnt) if learnt else None
                compress = zstandard.ZstdCompressor(level=3, dict_data=shared, write_checksum=True).compress
                lead = skippable(zstandard.ZstdCompressor(level=19).compress(learnt))
            out = []
            for r in made:
                if frames % records == 0:  # a new archive begins
                    out.append(lead)
                out.append(compress(r))
                frames += 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    # bytes pass through a string column unchanged, and an archive is its dictionary's row and the records'
    frames = rows.mapInArrow(run, "frame binary").select(F.col("frame").cast("string").alias("value"))
    frames.write.option("compression", "none").option("lineSep", SEPARATOR).option("maxRecordsPerFile", records + 1).text(folder)


# ---------------------------------------------------------------- reading

def frame_end(data: memoryview, at: int) -> tuple[int, int | None]:
    """(end of the Zstandard frame at ``at``, content size if the header tells it), from the block headers."""
    flags = data[at + 4]
    single, wide = flags >> 5 & 1, flags >> 6
    p = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3]
    width = (single, 2, 4, 8)[wide]
    size = int.from_bytes(data[p:p + width], "little") + (256 if wide == 1 else 0) if width else None
    p += width
    while True:
        block = int.from_bytes(_part(data, p, 3), "little")
        kind = block >> 1 & 3
        if kind == 3:
            raise ValueError("reserved block type")
        p += 3 + (1 if kind == 1 else block >> 3)
        if block & 1:
            p += 4 * (flags >> 2 & 1)
            _part(data, p, 0)
            return p, size


def _part(data: memoryview, at: int, n: int) -> memoryview:
    if at + n > len(data):
        raise ValueError("the archive ends inside a frame")
    return data[at:at + n]


def records_of(archive: bytes) -> Iterator[bytes]:
    """The decoded records of an archive, one frame each."""
    import zstandard

    data, at, decode = memoryview(archive), 0, None
    while at < len(data):
        magic, = struct.unpack("<I", _part(data, at, 4))
        if magic & SKIPPABLE_MASK == SKIPPABLE:
            size, = struct.unpack("<I", _part(data, at + 4, 4))
            held = bytes(_part(data, at + 8, size))
            if magic == DICTIONARY_FRAME:
                if at:
                    raise ValueError("the dictionary's frame does not lead")
                decode = _decoder(held)
            at += 8 + size
        elif magic == FRAME:
            end, size = frame_end(data, at)
            if size is not None and size > MOST_BYTES:
                raise ValueError(f"a record of {size} bytes")
            decode = decode or _decoder(b"")
            try:
                plain = decode(data[at:end])
            except zstandard.ZstdError as e:
                raise ValueError(f"frame at {at}: {e}") from e
            if size is not None and len(plain) != size:
                raise ValueError(f"frame at {at}: {len(plain)} bytes instead of {size}")
            yield plain
            at = end
        else:
            raise ValueError(f"no frame at {at}")


def _decoder(held: bytes):
    """Frames -> bytes with the dictionary that a leading frame holds (plain, compressed or none)."""
    import zstandard

    if len(held) >= 4 and struct.unpack("<I", held[:4])[0] == FRAME:
        held = zstandard.ZstdDecompressor().decompress(held, max_output_size=MOST_BYTES)
    if held and struct.unpack("<I", held[:4].ljust(4, b"\0"))[0] != DICTIONARY:
        raise ValueError("the leading frame holds no dictionary")
    tool = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held) if held else None)

    def decode(frame: memoryview) -> bytes:
        return tool.decompressobj().decompress(frame)

    return decode


def parsed(data: bytes) -> dict:
    """A record's fields, checked: version, header syntax, mandatory and
    repeated fields, block length, closing lines, digests, HTTP head."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (b"WARC/1.0", VERSION):
        raise ValueError(f"no WARC head: {lines[0][:20]!r}")
    fields = _fields(lines[1:])
    for name in MANDATORY:
        if name not in fields:
            raise ValueError(f"no {name}")
    size = _number(fields["content-length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"content length {size}, {len(rest) - 4} bytes")
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError("block digest differs")
    out = {"record_id": fields["warc-record-id"], "record_type": fields["warc-type"], "date": fields["warc-date"],
           "target_uri": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to"),
           "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, "payload_bytes": None, "payload": None}
    if out["record_type"] in ("response", "revisit"):
        http, gap, body = block.partition(b"\r\n\r\n")
        lines = http.split(b"\r\n")
        if not gap or not lines[0].startswith(b"HTTP/"):
            raise ValueError("no HTTP head")
        out["payload_bytes"] = _number(_fields(lines[1:]).get("content-length", ""))
        if out["record_type"] == "response":
            if len(body) != out["payload_bytes"] or out["payload_digest"] != base32_sha1(body):
                raise ValueError("payload length or digest differs")
            out["payload"] = body
        elif body or not out["refers_to"] or not out["payload_digest"]:
            raise ValueError("a revisit without reference or digest, or with a payload")
    return out


def _fields(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip() or name.lower().decode("latin-1") in out:
            raise ValueError(f"header line {line[:40]!r}")
        out[name.lower().decode("latin-1")] = value.strip().decode("utf-8", "strict")
    return out


def _number(text: str) -> int:
    if not (text.isascii() and text.isdigit()):
        raise ValueError(f"length {text!r}")
    return int(text)


RECORD_SCHEMA = ("path string, record_id string, record_type string, date string, target_uri string, refers_to string, "
                 "payload_digest string, payload_bytes long, payload binary, error string")


def read(spark: SparkSession, folder: str, payloads: bool = True, strict: bool = True) -> DataFrame:
    """One row per record of every archive below ``folder`` (``RECORD_SCHEMA``).

    ``strict``: the first invalid record or frame fails the job, with the
    archive's path.  Otherwise an invalid record is a row with only path and
    error, and an archive that breaks off gives the records before the break and
    one such row.  A folder without archives gives an empty result."""
    prepare(spark)
    names = ["path", *[c.split()[0] for c in RECORD_SCHEMA.split(", ")[1:]]]
    kinds = [pa.int64() if c.endswith("long") else pa.binary() if c.endswith("binary") else pa.string() for c in RECORD_SCHEMA.split(", ")]

    def rows(path: str, archive: bytes) -> Iterator[tuple]:
        frames, more = records_of(archive), True
        while more:
            try:
                r = parsed(data) | {"path": path, "error": None} if (data := next(frames, None)) is not None else None
            except ValueError as e:
                if strict:
                    raise ValueError(f"{path}: {e}") from e
                r, more = dict.fromkeys(names) | {"path": path, "error": str(e)}, frames.gi_frame is not None
            if r is None:
                return
            if not payloads:
                r["payload"] = None
            yield tuple(r[c] for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, archive in zip(b.column("path").to_pylist(), b.column("content")):
                held, size = [], 0
                for r in rows(path, archive.as_py()):
                    held.append(r)
                    size += len(r[names.index("payload")] or b"")
                    if len(held) == 512 or size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)

    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInArrow(run, RECORD_SCHEMA)


def round_trip(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, **cols: str) -> DataFrame:
    """Writes ``pages`` (see ``write``) to ``folder``, by default a new one in
    the shared folder, and reads the archives back (see ``read``): page_id,
    payload_bytes, payload_digest, record_type, refers_to of each record."""
    spark = pages.sparkSession
    prepare(spark)
    folder = folder or f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write(pages, folder, least_bytes, **cols)

    def page(column: str):
        return F.expr(f"try_cast(regexp_extract({column}, '^<urn:page:(-?[0-9]+)>$', 1) AS BIGINT)")

    return read(spark, folder, payloads=False).select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
