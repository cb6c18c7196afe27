import gzip
import hashlib
import io
import os

import pytest

from corpus_kb.llm import warc
from corpus_kb.session import shared_dir

BIG = "<p>" + "x" * 2000


@pytest.fixture
def pages(spark):
    rows = [(1, "http://a/", BIG), (2, "http://b/\r\nx", BIG), (2, "http://b/", BIG), (3, None, None), (4, "u", ""), (5, "u", "small"), (6, "u", "small"), (None, "u", BIG),
            (7, "u", "é" * 999), (8, "u", "é" * 999), (9, "u", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" * 60)]
    return spark.createDataFrame([(*r, "extra", "d") for r in rows], "page_id long, url string, html string, payload string, digest string").repartition(3), rows


def expected(rows):
    data = [(i, (h or "").encode()) for i, _, h in rows]
    top = {}
    for i, b in data:
        if len(b) >= 1000 and i is not None:
            top[b] = max(top.get(b, i), i)
    out = []
    for i, b in data:
        refers = top[b] if b in top and sum(x == b for _, x in data) > 1 and top[b] != i else None
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


def test_round_trip(pages):
    df, rows = pages
    got = warc.round_trip(df).collect()
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=repr) == expected(rows)


def test_members_and_index(spark, pages):
    df, rows = pages
    root = shared_dir(spark, "warc_test")
    manifest = warc.write_archives(warc.with_duplicates(df), root, archive_bytes=3000)
    normal = warc.normalise(manifest, root).collect()
    assert sum(r.records for r in normal) == len(rows) and manifest.count() == len(normal) > 1
    for r in normal:
        local = r.path.removeprefix("file://")
        whole = open(local, "rb").read()
        lines = open(r["index"].removeprefix("file://")).read().splitlines()
        assert len(lines) == r.records
        # members by the index are complete gzip files and add up to the inflated whole
        spans = [(int(x.split('"offset": ')[1].split(",")[0]), int(x.split('"length": ')[1].rstrip("}"))) for x in lines]
        assert b"".join(gzip.decompress(whole[o : o + n]) for o, n in spans) == gzip.decompress(whole)
        assert sum(n for _, n in spans) == os.path.getsize(local)


def test_inflate_accepts_one_stream_or_many():
    parts = [warc.record(i, None, bytes([65 + i]) * 5000, hashlib.sha1(bytes([65 + i]) * 5000).hexdigest(), None) for i in range(3)]
    for data in (gzip.compress(b"".join(parts)), b"".join(map(gzip.compress, parts))):
        assert [raw for _, raw in warc.records(warc.inflate(io.BytesIO(data)))] == parts


def test_damage_is_an_error():
    raw = warc.record(1, None, b"abc", hashlib.sha1(b"abc").hexdigest(), None)
    with pytest.raises(ValueError):
        warc.parsed(raw.replace(b"\r\n\r\nabc", b"\r\n\r\nabd"))
    with pytest.raises(ValueError):
        list(warc.records(iter([raw[:-9]])))


def test_empty(pages):
    assert warc.round_trip(pages[0].limit(0)).count() == 0
