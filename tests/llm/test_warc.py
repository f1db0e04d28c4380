import hashlib

import pytest

from palisade.llm import warc as A

SCHEMA = "page_id bigint, url string, html string, digest string, value int"


def rows():
    big, bigger = "<p>" + "x" * 1200, "\r\n\r\nWARC/1.1\r\n" + "é" * 600
    return [(1, "http://a/1", big), (2, "http://a/2", big), (5, "http://a/ 5\r\n", big), (3, None, "small"), (4, "http://a/4", "small"), (6, "u", None), (7, "u", ""), (8, "u", bigger), (9, "u", bigger), (10, "u", "y" * 1000), (10, "u", "y" * 1000), (11, "u", "z" * 999), (12, "u", "z" * 999)]


def brute(pages):
    out = []
    for i, _, h in pages:
        b = (h or "").encode()
        top = max((j for j, _, g in pages if (g or "") == (h or "")))
        revisit = len(b) >= 1000 and i != top
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


def test_written_and_read(spark, tmp_path):
    df = spark.createDataFrame([(*r, "d", 1) for r in rows()], SCHEMA).repartition(3)
    A.write_archives(df, f"file://{tmp_path}/warc", file_records=4)
    records = A.read_archives(spark, f"file://{tmp_path}/warc").cache()
    got = A.resolve(records).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(rows())
    payloads = {r.page_id: r.payload for r in records.collect() if r.record_type == "response"}
    assert all(payloads[i] == (h or "").encode() for i, _, h in rows() if i in payloads)
    stored = sum(p.stat().st_size for p in (tmp_path / "warc").glob("part-*"))
    assert stored < sum(len((h or "").encode()) for _, _, h in rows()) + 13 * 600 - 3000


def test_one_record_for_each_page(spark, tmp_path):
    df = spark.createDataFrame([(*r, "d", 1) for r in rows()], SCHEMA)
    A.write_archives(df, f"file://{tmp_path}/w")
    found = [f for p in (tmp_path / "w").glob("part-*") for f, _ in A.parse(p.read_bytes())]
    assert len(found) == len(rows())
    assert all({"warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"} <= f.keys() for f in found)


def test_damage_is_seen():
    with pytest.raises(ValueError):
        list(A.parse(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n"))
    with pytest.raises(ValueError):
        list(A.parse(b"nothing\r\n\r\n"))


def test_empty_and_nulls(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    A.write_archives(empty, f"file://{tmp_path}/e")
    assert A.resolve(A.read_archives(spark, f"file://{tmp_path}/e")).collect() == []
    odd = spark.createDataFrame([(None, None, "x" * 2000, "d", 1), (None, None, "w" * 1500, "d", 1), (4, None, "x" * 2000, "d", 1)], SCHEMA)
    A.write_archives(odd, f"file://{tmp_path}/o")
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in A.resolve(A.read_archives(spark, f"file://{tmp_path}/o")).collect()}
    assert got == {(None, "revisit", 4, 2000), (None, "response", None, 1500), (4, "response", None, 2000)}


def test_files_are_bounded_by_bytes(spark, tmp_path):
    rows = [(i, None, "x" * (i * 37 % 90)) for i in range(100)] + [(200 + i, None, chr(97 + i) * 5000) for i in range(6)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(2)
    path = tmp_path / "bytes"
    A.write_archives(df, f"file://{path}", file_records=100, file_bytes=10_000)
    sizes = [[int(f["content-length"]) for f, _ in A.parse(x.read_bytes())] for x in path.glob("*.txt")]
    assert sum(map(len, sizes)) == 106 and all(sum(s) < 30_000 for s in sizes)
    assert all(len(s) <= 2 for s in sizes if max(s, default=0) > 5000)
    got = A.read_archives(spark, f"file://{path}").collect()
    assert sorted((r.page_id, r.payload_bytes) for r in got) == sorted((i, len(h)) for i, _, h in rows)
