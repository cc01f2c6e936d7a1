import base64
import hashlib
import os
import struct

import pytest
import zstandard

from cadenza.llm import warc


def expected(rows):
    largest = {}
    for i, _, h in rows:
        if i is not None:
            largest[h or ""] = max(i, largest.get(h or "", i))
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        first = largest.get(h or "")
        refers = first if first is not None and first != i and sum((x[2] or "") == (h or "") for x in rows) > 1 else None
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if refers is None else "revisit", refers))
    return out


def test_round_trip(spark):
    rows = [(1, "http://a/x", "<p>é</p>"), (2, "http://a/y\r\nX: 1", "<p>é</p>"), (3, None, None), (4, "u", ""), (5, "u", "z" * 300_000), (6, "u", "WARC/1.1\r\n\r\n"), (7, "u", "WARC/1.1\r\n\r\n"), (7, "u", "WARC/1.1\r\n\r\n"), (None, "u", "lone"), (None, "u", "<p>é</p>")]
    rows += [(100 + i, f"http://h/{i}", f"<html><body>number {i} {'text ' * (i % 50)}</body></html>") for i in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as digest", "'y' as path").repartition(3)
    got = warc.archive_round_trip(df).collect()
    assert all(r.problem is None for r in got)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(expected(rows), key=str)
    assert {bytes(r.payload) for r in got if r.record_type == "response"} == {(h or "").encode() for _, _, h in rows}
    assert warc.archive_round_trip(df.limit(0)).collect() == []


def test_least_bytes_keeps_small_copies(spark):
    df = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "aaaa"), (4, "u", "aaaa")], "page_id long, url string, html string")
    assert {r.page_id: r.record_type for r in warc.archive_round_trip(df, 3).collect()} == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def _file(tmp_path, name, frames, dictionary=None, compressed=False):
    path = str(tmp_path / name)
    packer = zstandard.ZstdCompressor(dict_data=dictionary, write_checksum=True)
    with open(path, "wb") as out:
        if dictionary is not None:
            raw = dictionary.as_bytes()
            raw = zstandard.ZstdCompressor().compress(raw) if compressed else raw
            out.write(struct.pack("<II", warc.DICTIONARY_MAGIC, len(raw)) + raw)
        for f in frames:
            out.write(packer.compress(f))
    return path


@pytest.mark.parametrize("compressed", [False, True])
def test_dictionary_plain_or_compressed(spark, tmp_path, compressed):
    records = [warc.make_record(i, f"http://h/{i}", b"<p>" + b"word %d " % i * 40, None) for i in range(300)]
    made = warc.make_dictionary(records)
    assert made.dict_id() != 0
    path = _file(tmp_path, "a.warc.zst", records, made, compressed)
    rows = warc.read_archives(warc.list_archives(spark, str(tmp_path))).collect()
    assert [r.problem for r in rows] == [None] * 300 and os.path.basename(rows[0].path) == os.path.basename(path)
    assert {r.record_id for r in rows} == {f"urn:page:{i}" for i in range(300)}


def test_damage_is_reported(spark, tmp_path):
    good = warc.make_record(1, "u", b"hello", None)
    cases = {
        "length": good.replace(b"Content-Length: 5\r\n\r\nhello", b"Content-Length: 6\r\n\r\nhello"),
        "head": good.replace(b"WARC/1.1", b"WURC/1.1"),
        "missing": good.replace(b"WARC-Date", b"WARC-Dato"),
        "tail": good[:-2],
        "digest": good.replace(b"hello", b"hullo"),
    }
    for bad in cases.values():
        assert warc.parse_record(bad)["problem"]
    path = _file(tmp_path, "b.warc.zst", [good, cases["tail"], good])
    problems = [r.problem for r in warc.read_archives(spark.createDataFrame([(path,)], "path string")).collect()]
    assert problems[0] is None and problems[1] and problems[2] is None
    whole = open(path, "rb").read()
    for cut in (len(whole) - 3, len(whole) // 2, 5):
        with open(tmp_path / "c.warc.zst", "wb") as out:
            out.write(whole[:cut])
        assert list(warc.read_frames(str(tmp_path / "c.warc.zst")))[-1][2]


def test_any_id_comes_back(spark):
    ids = ["", " ", "a b", "x>", "<x>", "50%", "%41", "a+b", "line\r\nWARC-Type: x", "tab\t", "é中", "urn:page:1"]
    df = spark.createDataFrame([(i, "u", h) for i in ids for h in (f"own {i!r}", "shared")], "page_id string, url string, html string")
    got = warc.archive_round_trip(df).collect()
    assert all(r.problem is None for r in got)
    assert sorted(r.page_id for r in got) == sorted(ids * 2)
    assert {(r.page_id, r.refers_to) for r in got if r.record_type == "revisit"} == {(i, max(ids)) for i in ids if i != max(ids)}


def test_records_longer_than_a_chunk(spark, tmp_path):
    noise = os.urandom(5 * warc.CHUNK + 17)
    records = [warc.make_record(1, "u", b"short", None), warc.make_record(2, "u", noise, None), warc.make_record(3, "u", b"", None), warc.make_record(4, "u", noise[::-1], None)]
    path = str(tmp_path / "long.warc.zst")
    warc.write_file(path, iter(records))
    found = list(warc.read_frames(path))
    assert [r for _, r, _ in found] == records and [p for *_, p in found] == [None] * 4
    assert warc.parse_record(found[1][1])["payload"] == noise
    data = open(path, "rb").read()
    assert all(data[offset : offset + 4] == struct.pack("<I", warc.FRAME_MAGIC) for offset, *_ in found)
