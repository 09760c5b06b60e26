import base64
import hashlib
import os
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from tessera.llm import warc
from tessera.llm.common import fresh_path

ROWS = [(1, "http://a/", "<p>one</p>"), (2, "http://b/ü ü\r\nX: y", "<p>one</p>"), (3, None, None), (4, "u", ""), (5, "u", "é" * 3_000_000), (6, "u", "<p>two\r\n\r\n</p>"), (None, "u", "<p>two\r\n\r\n</p>"), (7, "u", "tie"), (7, "u", "tie"), (None, "u", "lone"), (8, "u", "é" * 3_000_000)]


def brute(rows, least=0):
    groups = {}
    for i, _, html in rows:
        groups.setdefault(html or "", []).append(i)
    out = []
    for html, ids in groups.items():
        raw = html.encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        lead = max((i for i in ids if i is not None), default=None)
        for k, i in enumerate(ids):
            first = k == ids.index(lead) or len(raw) < least
            out.append((i, len(raw), digest, "response" if first else "revisit", None if first else lead))
    return sorted(out, key=str)


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, RID string, size int")


def written(spark, rows=ROWS, **kw):
    path = fresh_path(spark, "test-warc")
    return warc.write(pages(spark, rows), path, **kw), path


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_round_trip_equals_brute_force(spark):
    manifest, _ = written(spark)
    assert result(warc.digests(manifest)) == brute(ROWS)
    got = {(r.record_id, bytes(r.payload)) for r in warc.read(manifest, payload=True).where("record_type = 'response'").collect()}
    assert sorted(p for _, p in got) == sorted({(h or "").encode() for _, _, h in ROWS})
    assert result(warc.digests(written(spark, least=7)[0])) == brute(ROWS, 7)


def test_query_and_its_sql(spark, tmp_path):
    pages(spark).repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    assert result(warc.query(spark, str(tmp_path))) == brute(ROWS)


def test_hot_payload_small_archives_and_empty_table(spark):
    rows = [(i, "u", "hot" if i % 3 else f"page {i}") for i in range(3000)]
    manifest, path = written(spark, rows, archive_bytes=2000)
    assert manifest.count() > 8 and manifest.agg(F.sum("n_records")).first()[0] == 3000
    assert result(warc.digests(manifest)) == brute(rows)
    empty, _ = written(spark, [])
    assert empty.count() == 0 and warc.digests(empty).collect() == []


def test_any_decoder_reads_an_archive_with_its_dictionary(spark):
    manifest, _ = written(spark, [(i, f"http://x/{i}", "<html>some common words of pages</html>" * 5 + str(i)) for i in range(60)])
    file = manifest.first().file.removeprefix("file:")
    raw = open(file, "rb").read()
    magic, n = struct.unpack("<II", raw[:8])
    assert magic == 0x184D2A5D
    dictionary = zstandard.ZstdDecompressor().decompress(raw[8 : 8 + n])
    one = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).decompressobj()
    assert one.decompress(raw[8 + n :]).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")


def test_fetch_reads_one_record(spark):
    manifest, _ = written(spark)
    for r in warc.read(manifest, payload=True).where("record_type = 'response'").collect():
        assert warc.fetch(r.file, r.offset).payload == bytes(r.payload)


def test_urls_cannot_break_a_header(spark):
    manifest, _ = written(spark)
    urls = {r.target_uri for r in warc.read(manifest).collect()}
    assert "http://b/%C3%BC%20%C3%BC%0D%0AX:%20y" in urls and None in urls


GOOD = warc.page_record("<urn:page:1:x>", "http://a/", b"<p>", None, "2000-01-01T00:00:00Z")


@pytest.mark.parametrize(
    "raw",
    [
        b"",
        GOOD[:-1],
        GOOD + b"x",
        GOOD.replace(b"WARC/1.1", b"WARC/9.9"),
        GOOD.replace(b"WARC-Date: 2000-01-01T00:00:00Z", b"WARC-Date: yesterday"),
        GOOD.replace(b"WARC-Type: response\r\n", b""),
        GOOD.replace(b"WARC-Type: response\r\n", b"WARC-Type: response\r\nwarc-type: revisit\r\n"),
        GOOD.replace(b"<p>", b"<q>"),
        GOOD.replace(b"Content-Length: 3\r\n", b"Content-Length: 4\r\n"),
        GOOD.replace(b"<urn:page:1:x>", b"urn:page:1:x"),
        GOOD.replace(b"WARC-Target-URI:", b"WARC Target-URI:"),
        warc.page_record("<urn:page:1:x>", None, b"<p>", "<urn:page:2:x>", "2000-01-01T00:00:00Z").replace(b"WARC-Profile", b"X-Profile"),
    ],
)
def test_broken_records_are_named(raw):
    with pytest.raises(warc.Broken):
        warc.parse(raw)
    assert warc.parse(GOOD).payload == b"<p>"


def test_broken_frames_are_reported_and_passed_over(spark, tmp_path):
    manifest, _ = written(spark, [(i, "u", f"<html>{i}</html>" * 20) for i in range(30)])
    rows = sorted(warc.read(manifest).where("record_type = 'response'").collect(), key=lambda r: (r.file, r.offset))
    file = rows[0].file
    of = [r for r in rows if r.file == file]
    raw = bytearray(open(file.removeprefix("file:"), "rb").read())
    raw[of[1].offset + of[1].length // 2] ^= 0xFF
    broken = f"{tmp_path}/broken.warc.zst"
    open(broken, "wb").write(raw[: of[-1].offset + 9] if len(of) > 2 else raw)
    one = spark.createDataFrame([(broken, os.path.getsize(broken))], "file string, n_bytes long")
    got = warc.read(one, strict=False).collect()
    good = [page for r in got if r.problem is None and r.record_type == "response" for page in [r.record_id]]
    assert set(good) <= {r.record_id for r in of} and of[1].record_id not in good and of[0].record_id in good
    assert len(good) == len(of) - (2 if len(of) > 2 else 1)
    with pytest.raises(Exception, match="frame|digest|block"):
        warc.read(one).collect()


def test_dictionaries_of_few_samples():
    assert warc.train([]) == b"" and warc.train([b""]) == b"" and warc.train([b"abc"]) == b"abc"
