import base64
import hashlib
import os
import struct
import uuid

import pytest
import zstandard

from staywise.llm import queries, warc
from staywise.session import checkpoint_dir
from tests.llm.helpers import SF, clashing

SCHEMA = "page_id long, url string, html string"


def plain(rows, least=0):
    """Rows of the contract, sorted."""
    data = [(i, (h or "").encode()) for i, _, h in rows]
    groups = {}
    for i, p in data:
        groups.setdefault(p, []).append(i)
    out = []
    for i, p in data:
        named = [x for x in groups[p] if x is not None]
        top = max(named) if named and len(p) >= least else i
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if i == top else "revisit", None if i == top else top))
    return sorted(out, key=repr)


def result(df):
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def new_folder(spark):
    return f"{checkpoint_dir(spark)}/warc-test-{uuid.uuid4().hex}"


def local(folder):
    folder = folder.removeprefix("file://")
    return [open(os.path.join(folder, f), "rb").read() for f in sorted(os.listdir(folder)) if f.startswith("part-")]


def test_pages(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    got = queries.queries()["op13_warc"](spark, SF)
    assert dict(got.dtypes) == {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"}
    assert result(got) == plain(rows)


ODD = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (7, None, "same"), (None, "http://n", "same"), (3, "http://a/ü\r\nX-Evil: 1", ""), (4, "", None),
       (5, "http://a/5", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"), (6, "http://a/6", "\x00\x1aP*M\x18\x00\x00\x00\x00 ÿ 👍"), (8, "u", "x" * 3_000_000),
       (9, "u", "twice"), (9, "u", "twice"), (None, None, "only null"), (None, None, "only null"), (-4, "http://m", "minus"), (-9, "http://m", "minus")]


@pytest.mark.parametrize("least, records", [(0, 4096), (5, 2), (0, 1)])
def test_odd_pages(spark, least, records):
    df = clashing(spark.createDataFrame(ODD, SCHEMA)).repartition(2)
    folder = new_folder(spark)
    warc.write(df, folder, least, records=records)
    got = warc.read(spark, folder)
    back = {r["record_id"]: r for r in got.collect()}
    assert bytes(back["<urn:page:6>"]["payload"]).decode() == ODD[7][2] and back["<urn:page:3>"]["target_uri"] == "http://a/%C3%BC%0D%0AX-Evil:%201"
    assert back["<urn:page:7>"]["target_uri"] is None and back["<urn:page:4>"]["payload_bytes"] == 0
    assert result(warc.round_trip(df, new_folder(spark), least)) == plain(ODD, least)
    if records < 10:
        assert all(len(list(warc.records_of(a))) <= records for a in local(folder)) and len(local(folder)) >= len(ODD) // records


def test_archive_has_its_dictionary_and_one_frame_a_record(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").coalesce(1)
    folder = new_folder(spark)
    warc.write(pages, folder)
    archive, = local(folder)
    magic, size = struct.unpack("<II", archive[:8])
    assert magic == 0x184D2A5D
    learnt = zstandard.ZstdDecompressor().decompress(archive[8:8 + size])
    assert struct.unpack("<I", learnt[:4])[0] == 0xEC30A437
    # the library's own reader, over all frames, gives the records one after the other
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(learnt)).stream_reader(archive, read_across_frames=True)
    whole = reader.read()
    assert whole == b"".join(warc.records_of(archive)) and whole.count(b"WARC/1.1\r\n") >= pages.count()
    assert len(archive) < len(whole) / 2


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def frames(records, learnt=b"", packed=True, lead=True):
    shared = zstandard.ZstdCompressionDict(learnt) if learnt else None
    out = [warc.skippable(zstandard.ZstdCompressor().compress(learnt) if packed else learnt)] if lead else []
    for r in records:
        c = zstandard.ZstdCompressor(dict_data=shared).compressobj()  # a stream: no content size in the header
        out.append(c.compress(r) + c.flush())
    return b"".join(out)


def test_archives_of_other_writers():
    records = [warc.record("response", k, "http://x", bytes([65 + k % 26]) * k * 700, None, "2020-01-01T00:00:00Z") for k in range(300)]
    learnt = warc.dictionary_of([r + os.urandom(300) for r in records])
    assert learnt
    for archive in (frames(records, learnt), frames(records, learnt, packed=False), frames(records, lead=False), frames(records)):
        assert list(warc.records_of(archive)) == records
        assert [warc.parsed(r)["payload_bytes"] for r in records] == [k * 700 for k in range(300)]
    assert list(warc.records_of(warc.skippable(b"note", 0x184D2A51) + frames(records[:2], lead=False) + warc.skippable(b"", 0x184D2A50))) == records[:2]


GOOD = warc.record("response", 1, "http://x", b"body", None, "2020-01-01T00:00:00Z")
REVISIT = warc.record("revisit", 1, "http://x", b"body", 2, "2020-01-01T00:00:00Z")


@pytest.mark.parametrize("bad", [
    b"", b"WARC/9.9\r\n\r\n", GOOD[:-1], GOOD + b"x", GOOD.replace(b"body", b"BODY"), GOOD.replace(b"WARC-Date", b"WARC-Dato"),
    GOOD.replace(b"Content-Length: 4", b"Content-Length: 5"), GOOD.replace(b"WARC-Type: response", b"WARC-Type response"),
    GOOD.replace(b"WARC-Date:", b"WARC-Type: a\r\nWARC-Date:"), GOOD.replace(b"HTTP/1.1 200", b"XTTP/1.1 200"),
    REVISIT.replace(b"WARC-Refers-To", b"WARC-Refers-Xo"), GOOD.replace(b"Content-Length: 8", b"Content-Length: -8")])
def test_invalid_records(bad):
    assert warc.parsed(GOOD)["payload"] == b"body" and warc.parsed(REVISIT)["payload"] is None
    with pytest.raises(ValueError):
        warc.parsed(bad)


def test_broken_archives(spark):
    archive = frames([GOOD, REVISIT])
    good = len(list(warc.records_of(archive)))
    for bad in (archive[:-3], archive + b"tail", archive + archive, b"\x00" * 9, warc.skippable(b"no dictionary"), archive[:40]):
        with pytest.raises(ValueError):
            list(warc.records_of(bad))
    folder = new_folder(spark)
    os.makedirs(folder)
    for name, data in (("a", archive), ("b", archive[:-3]), ("c", frames([b"junk", GOOD]))):
        with open(f"{folder}/{name}.warc.zst", "wb") as f:
            f.write(data)
    rows = warc.read(spark, folder, strict=False).collect()
    by = {n: sorted((r["error"] is None for r in rows if r["path"].endswith(f"{n}.warc.zst")), reverse=True) for n in "abc"}
    assert by == {"a": [True] * good, "b": [True, False], "c": [True, False]}
    with pytest.raises(Exception, match="warc.zst"):
        warc.read(spark, folder).collect()
