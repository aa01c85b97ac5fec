"""WARC archives: round trips, other readers' view of the files, and what is said of broken ones."""

import glob
import hashlib
import io
import struct

import pytest
import zstandard

from tilewright.llm import warc
from tilewright.llm.common import Scratch

PAGES = [(i, f"http://h/{i % 7}/ä b", "<html>" + f"page {i % 40} " * (200 if i % 3 else 20) + "</html>") for i in range(300)]
PAGES += [(400, None, None), (401, "http://x\r\nWARC-Type: request", ""), (402, "", "é" * 499), (403, "", "é" * 499), (404, "", "é" * 500), (405, "", "é" * 500), (405, "", "é" * 500), (None, "n", "é" * 500), (None, "n", "only here " * 200), (406, "l", "\r\n\r\nWARC/1.1\r\n" * 90_000)]


def plain(pages, least=1000):
    last = {}
    for i, _, h in pages:
        if i is not None and len((h or "").encode()) >= least:
            last[h] = max(i, last.get(h, i))
    out = []
    for i, _, h in pages:
        raw = (h or "").encode()
        refers = last.get(h) if len(raw) >= least and last.get(h) != i else None
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def archives(spark, tmp_path_factory):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, payload string").repartition(3)
    folder = str(tmp_path_factory.mktemp("warc"))
    return warc.archive_pages(pages, Scratch(spark), folder=folder).cache(), folder


def test_round_trip(spark, archives):
    got = warc.read_pages(warc.read_archives(archives[0])).collect()
    assert sorted(map(tuple, got), key=str) == plain(PAGES)
    assert sum(r["record_type"] == "revisit" for r in got) > 100
    full = warc.read_archives(archives[0]).collect()
    texts = {h or "" for _, _, h in PAGES}
    assert {r["payload"].decode() for r in full if r["record_type"] == "response"} == texts
    by_id = {r["record_id"]: r for r in full if r["record_type"] == "response"}
    assert all(by_id[r["refers_to_id"]]["payload_digest"] == r["payload_digest"] for r in full if r["record_type"] == "revisit")
    assert all(r["problem"] is None for r in full)


def test_files_by_another_reader(spark, archives):
    rows, folder = archives
    paths = glob.glob(f"{folder}/*.warc.zst")
    assert sorted(r["path"] for r in rows.collect()) == sorted(paths)
    assert sorted(r["path"].split(":")[-1] for r in warc.list_archives(spark, folder).collect()) == sorted(paths)
    n = 0
    for path in paths:
        raw = open(path, "rb").read()
        magic, size = struct.unpack("<II", raw[:8])
        assert magic == 0x184D2A5D
        given = zstandard.ZstdCompressionDict(raw[8 : 8 + size])
        text = zstandard.ZstdDecompressor(dict_data=given).stream_reader(io.BytesIO(raw[8 + size :]), read_across_frames=True).read()
        while text:
            head, _, rest = text.partition(b"\r\n\r\n")
            length = int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0])
            assert head.startswith(b"WARC/1.1\r\n") and rest[length : length + 4] == b"\r\n\r\n"
            assert head.count(b"\r\nWARC-Type:") == 1
            text, n = rest[length + 4 :], n + 1
    assert n == len(PAGES) + len(paths)


def test_archives_are_rolled(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
    got = warc.write_archives(warc.mark_revisits(pages).coalesce(1), Scratch(spark), folder=str(tmp_path), archive_bytes=2000)  # no dictionary
    assert got.count() > 3 and got.agg({"records": "sum"}).collect()[0][0] == len(PAGES)
    assert sorted(map(tuple, warc.read_pages(warc.read_archives(got)).collect()), key=str) == plain(PAGES)
    assert open(got.first()["path"], "rb").read(4) == warc.FRAME


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_pages(warc.read_archives(warc.archive_pages(pages, Scratch(spark)))).count() == 0


GOOD = warc.page_record("5", "http://u", b"some payload", None, warc.DATE)
REVISIT = warc.page_record("5", "http://u", b"some payload", "6", warc.DATE)


def test_good_records():
    got = warc.parse(GOOD)
    assert (got["problem"], got["payload"], got["page_id"], got["payload_bytes"]) == (None, b"some payload", "5", 12)
    got = warc.parse(REVISIT)
    assert (got["problem"], got["payload"], got["refers_to"], got["payload_bytes"]) == (None, None, "6", 12)


@pytest.mark.parametrize(
    ("change", "problem"),
    [
        (lambda r: r[:-1], "content length"),
        (lambda r: r + b"x", "content length"),
        (lambda r: r + r, "content length"),
        (lambda r: r.replace(b"WARC/1.1", b"WARC/2.0"), "no WARC version"),
        (lambda r: r.replace(b"WARC-Date", b"WARC-Dote"), "no warc-date"),
        (lambda r: r.replace(b"WARC-Date: ", b"WARC-Date: x"), "date"),
        (lambda r: r.replace(b"WARC-Record-ID: <", b"WARC-Record-ID: "), "record id"),
        (lambda r: r.replace(b"WARC-Type: response", b"WARC-Type: other"), "unknown type"),
        (lambda r: r.replace(b"WARC-Type: response", b"WARC-Type: response\r\nwarc-type: revisit"), "twice"),
        (lambda r: r.replace(b"WARC-Type: response", b"WARC-Type: response\r\nno name"), "without a name"),
        (lambda r: r.replace(b"some payload", b"same payload"), "block digest"),
        (lambda r: r[: r.index(b"WARC-Block-Digest")] + r[r.index(b"\r\nContent-Length", r.index(b"WARC-Block")) + 2 :].replace(b"some", b"same"), "payload digest"),
        (lambda r: r[: r.index(b"WARC-Block-Digest")] + r[r.index(b"\r\nContent-Length", r.index(b"WARC-Block")) + 2 :].replace(b"ength: 12", b"ength: 13"), "payload length"),
        (lambda r: r[:30], "end of the headers"),
        (lambda r: b"\xff" + r, "UTF-8"),
        (lambda r: b"", "end of the headers"),
    ],
)
def test_broken_records(change, problem):
    assert problem in warc.parse(change(GOOD))["problem"]


def test_broken_revisits():
    assert "revisit" in warc.parse(REVISIT.replace(b"WARC-Refers-To:", b"WARC-Refers-Tu:"))["problem"]
    assert "revisit" in warc.parse(REVISIT.replace(b"sha1:", b"sha9:", 1))["problem"]


def archive(tmp_path, damage, dictionary=None):
    dictionary = dictionary or warc.train([warc.page_record(str(i), f"http://u/{i}", f"payload {i} {i * 7}".encode() * 9, None, warc.DATE) for i in range(200)])
    assert dictionary
    out = warc.Writer(str(tmp_path), dictionary, warc.DATE)
    for i in range(20):
        out.add(warc.page_record(str(i), "http://u", f"payload {i} ".encode() * 50, None, warc.DATE))
    [(path, n, size)] = out.done()
    raw = bytearray(open(path, "rb").read())
    assert (n, size) == (20, len(raw))
    offsets = [r["offset"] for r in warc.records_of(path)]
    damage(raw, offsets)
    open(path, "wb").write(raw)
    return list(warc.records_of(path))


def pages_of(rows):
    return [int(r["page_id"]) for r in rows if r["problem"] is None and r["record_type"] == "response"]


def test_frames_that_are_broken(tmp_path):
    def flip(raw, offsets):
        raw[offsets[6] + 12] ^= 255

    rows = archive(tmp_path, flip)
    assert sum(r["problem"] is not None for r in rows) >= 1 and pages_of(rows) == [i for i in range(20) if i != 5]

    def no_magic(raw, offsets):
        raw[offsets[3]] = 0

    rows = archive(tmp_path, no_magic)
    assert [r["problem"] for r in rows if r["problem"]] == ["no frame"] and pages_of(rows) == [i for i in range(20) if i != 2]

    def cut(raw, offsets):
        del raw[offsets[-1] + 9 :]

    rows = archive(tmp_path, cut)
    assert pages_of(rows) == list(range(19)) and rows[-1]["problem"] == "frame cut off"

    def between(raw, offsets):
        raw[offsets[2] : offsets[2]] = b"\x50\x2a\x4d\x18\x03\x00\x00\x00abc"

    assert pages_of(archive(tmp_path, between)) == list(range(20))


def test_dictionaries_that_are_broken(tmp_path):
    def other_magic(raw, offsets):
        raw[8:12] = b"none"

    rows = archive(tmp_path, other_magic)
    assert rows[0]["problem"] == "the leading frame holds no dictionary" and pages_of(rows) == []

    def packed(raw, offsets):  # a dictionary may be compressed itself
        size = struct.unpack("<I", raw[4:8])[0]
        small = zstandard.compress(bytes(raw[8 : 8 + size]))
        raw[4 : 8 + size] = struct.pack("<I", len(small)) + small

    assert pages_of(archive(tmp_path, packed)) == list(range(20))

    def short(raw, offsets):
        del raw[100:]

    assert [r["problem"] for r in archive(tmp_path, short)] == ["dictionary cut off"]


def test_a_broken_archive_ends_the_query(spark, tmp_path):
    out = warc.Writer(str(tmp_path), b"", warc.DATE)
    out.add(GOOD.replace(b"some payload", b"same payload"))
    files = spark.createDataFrame(out.done(), "path string, records long, bytes long")
    assert "block digest" in warc.read_archives(files).where("problem is not null").first()["problem"]
    with pytest.raises(Exception, match="block digest differs"):
        warc.read_pages(warc.read_archives(files)).collect()
