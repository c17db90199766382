"""Operator 6: exact round trip, damage, and the rules for revisits."""
import base64
import hashlib
import io

import zstandard

from noteweave.llm import warc
from noteweave.llm.common import shared_dir

SF = "/root/testdata/sf0.001"


def archive(folder, payloads):
    a = warc.Archive(folder, "2020-01-01T00:00:00Z")
    for i, p in enumerate(payloads):
        a.add(warc.page_record(i, f"http://x/{i}", p, warc.sha1_32(p), None, False, "2020-01-01T00:00:00Z"))
    return a.close()[0]


def test_every_page_comes_back(spark):
    df = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r.page_id: r for r in df.collect()}
    got = warc.read_archives(spark, warc.write_archives(df, shared_dir(spark))).collect()
    assert all(r.problem is None for r in got)
    pages = {int(r.record_id.rpartition(":")[2]): r for r in got if r.record_type != "warcinfo"}
    assert pages.keys() == want.keys()
    for i, r in pages.items():
        raw = want[i].html.encode()
        assert r.target_uri == want[i].url and r.payload_bytes == len(raw)
        assert r.payload_digest == "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert bytes(pages[int(r.refers_to.rpartition(":")[2])].payload if r.record_type == "revisit" else r.payload) == raw


def test_odd_rows(spark):
    rows = [(1, "u\r\nX: y", None, 1), (2, None, "", 1), (3, "u", "é" * 100_000, 1), (3, "u", "é" * 100_000, 1), (None, "n", "é" * 100_000, 1), (None, "n", "only", 1), (7, "z", "a\r\n\r\nb", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    got = sorted(((r.page_id or 0), r.payload_bytes, r.record_type, r.refers_to) for r in warc.page_round_trip(df).collect())
    assert got == [(0, 4, "response", None), (0, 200_000, "revisit", 3), (1, 0, "revisit", 2), (2, 0, "response", None), (3, 200_000, "response", None), (3, 200_000, "response", None), (7, 6, "response", None)]
    assert warc.page_round_trip(df.limit(0)).collect() == []
    assert {r.record_type for r in warc.page_round_trip(df, min_bytes=1_000_000).collect()} == {"response"}


def test_damaged_archives(spark, tmp_path):
    uri = archive(f"file://{tmp_path}", [b"payload %d " % i * 50 for i in range(100)])
    data = open(uri[7:], "rb").read()
    assert [x for _, x in warc.frames(io.BytesIO(data), 7)] == [x for _, x in warc.frames(io.BytesIO(data))]
    (tmp_path / "cut").write_bytes(data[:-20])
    (tmp_path / "empty").write_bytes(b"")
    (tmp_path / "plain").write_bytes(zstandard.ZstdCompressor().compress(warc.record("response", "urn:x", "d", [], b"no http")))
    got = warc.read_archives(spark, spark.createDataFrame([(f"file://{tmp_path}/{n}",) for n in ("cut", "empty", "plain")], "uri string")).collect()
    assert sum(r.record_type == "response" and r.problem is None for r in got) == 99
    assert sorted(r.problem for r in got if r.problem) [0].startswith("no length") and any("breaks off" in (r.problem or "") for r in got)


def test_invalid_records():
    good = warc.page_record(1, "u", b"abc", warc.sha1_32(b"abc"), None, False, "d")
    assert warc.parsed(good)["problem"] is None and warc.parsed(good)["payload"] == b"abc"
    for bad in (good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"abc", b"abd"), good + b"x", good.replace(b"WARC-Date", b"Date"), good.replace(b"Length: 3", b"Length: 4"), b""):
        assert warc.parsed(bad)["problem"], bad


def test_compressed_dictionary_and_other_skippable_frames():
    inner = b"some dictionary text " * 20
    packed = zstandard.ZstdCompressor().compress(inner)
    frame = zstandard.ZstdCompressor(dict_data=warc.dictionary(inner)).compress(b"some dictionary text here")
    skip = (0x184D2A51).to_bytes(4, "little") + (3).to_bytes(4, "little") + b"abc"
    data = warc.struct.pack("<II", warc.DICT_FRAME, len(packed)) + packed + skip + frame + skip
    assert [x for _, x in warc.frames(io.BytesIO(data))] == [b"some dictionary text here"]
