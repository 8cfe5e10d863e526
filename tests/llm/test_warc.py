"""WARC archives: round trips and the SQL of the query."""

import io
import os

import pytest
from check import compare, oracle

from slideloom.llm.queries import QUERIES, SQL
from slideloom.llm.warc import build_dictionary, digest, parse, read_archive, read_warc, record, write_archive, write_warc


@pytest.mark.parametrize("n", [1, 3, 400])
def test_archive_round_trip(n):
    records = [record(i, f"http://a/{i}", f"<p>page {i} é</p>".encode() * (i % 7 * 200), "X") for i in range(n)]
    out = io.BytesIO()
    size = write_archive(out, records)
    raw = out.getvalue()
    assert len(raw) == size and raw[:4] == bytes.fromhex("5D2A4D18")
    for chunk in (7, 1 << 20):
        assert list(read_archive(io.BytesIO(raw), chunk)) == records
    with pytest.raises(ValueError):
        list(read_archive(io.BytesIO(raw[:-3])))


def test_dictionary_pays():
    records = [record(i, f"http://host.example/{i}", (f"<html><body><nav>shared furniture of the site</nav><p>{i * 7919}</p>").encode(), "X") for i in range(500)]
    out = io.BytesIO()
    write_archive(out, records)
    import zstandard

    plain = sum(len(zstandard.ZstdCompressor().compress(r)) for r in records)
    assert len(build_dictionary(records)) > 256 and len(out.getvalue()) < 0.6 * plain


def test_records():
    r = parse(record(5, "http://a/b\r\nX: y", b"abc", digest(b"abc"), 2))
    assert r["fields"]["warc-refers-to"] == "<urn:page:2>" and r["payload"] == b"" and "Content-Length: 3" in r["http"]
    assert r["fields"]["warc-target-uri"] == "http://a/b%0D%0AX: y"
    with pytest.raises(ValueError):
        parse(record(5, None, b"abc", digest(b"abc")).replace(b"abc", b"abd"))


def test_files_and_rows(spark, tmp_path):
    rows = [(i, f"u{i}", f"<p>{i % 5}</p>" * (1 + i % 5)) for i in range(40)]
    rows += [(100, None, None), (101, "u", ""), (None, "n", "<p>0</p>"), (200, "long", "<b>é</b>" * 300_000), (7, "u7", rows[7][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS refers_to", "'x' AS _sha")
    archives = write_warc(df, str(tmp_path), archive_bytes=2_000)
    listed = archives.collect()
    assert len(listed) > 3 and all(os.path.getsize(a.path) == a.bytes for a in listed)
    got = read_warc(archives, str(tmp_path)).collect()
    assert len(got) == len(rows) == sum(a.records for a in listed)
    first = {}
    for i, _, h in rows:
        key = (h or "").encode()
        first[key] = min(first.get(key, i), i) if i is not None and first.get(key) is not None else (i if i is not None else first.get(key))
    left = {(i, u): (h or "").encode() for i, u, h in rows}
    for r in got:
        raw = left[r.page_id, r.url]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), digest(raw))
        new = r.page_id == first[raw]
        assert r.record_type == ("response" if new else "revisit") and r.refers_to == (None if new else first[raw])
        assert r.payload == (raw if new else None)
    assert write_warc(df.limit(0), str(tmp_path)).count() == 0
    small = write_warc(df, str(tmp_path / "b"), least=1_000)
    assert {r.page_id for r in read_warc(small, str(tmp_path / "b")).collect() if r.record_type == "revisit"} == set()


def test_matches_sql(spark, sf_dir):
    name = "op2_dictionary_warc"
    assert compare(QUERIES[name](spark, sf_dir), oracle(sf_dir), SQL[name]) == ""
