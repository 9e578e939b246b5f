"""WARC archives: DuckDB oracle, byte-exact round trips, broken archives."""

import gzip

import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tessera.llm import warc
from tessera.llm.queries import WARC_SQL, op2_warc


@given(data=st.binary(max_size=400), size=st.integers(4, 50))
def test_chunk_framing_round_trip(data, size):
    assert warc.unchunked(warc.chunked(data, size)) == data
    assert b"".join(warc.cut(data, size)) == data and all(len(c) <= size for c in warc.cut(data, size))


def test_chunk_extensions_and_trailers():
    assert warc.unchunked(b"3;a=b\r\nabc\r\n0\r\nX: y\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunked(b"3\r\nabcd\r\n0\r\n\r\n")


@pytest.mark.parametrize("d", ["sf0.001", "sf0.01"])
def test_against_duckdb(spark, d):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '/root/testdata/{d}/pages.parquet'")
    got = op2_warc(spark, f"/root/testdata/{d}")
    want = con.execute(WARC_SQL)
    names = [c[0] for c in want.description]
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == sorted(want.fetchall())


def test_query_has_segments_to_reassemble(spark, tmp_path):
    """With the query's own parameters long pages come as continuation records, and archives stay small."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    warc.write_warc(pages, f"file://{tmp_path}/a")
    records = warc.read_records(spark, f"file://{tmp_path}/a")
    assert records.where("record_type = 'continuation'").count() >= 10
    assert warc.reassemble(records).count() == pages.count()
    long = spark.createDataFrame([(i, "u", "x" * 3_000_000 + str(i)) for i in range(12)], "page_id long, url string, html string").repartition(1)
    warc.write_warc(long, f"file://{tmp_path}/b")
    assert max(len(gzip.decompress(f.read_bytes())) for f in (tmp_path / "b").glob("*.gz")) < 64e6
    assert sorted(r.payload_bytes for r in warc.reassemble(warc.read_records(spark, f"file://{tmp_path}/b")).collect()) == [3_000_001] * 10 + [3_000_002] * 2


ODD = [(1, "u", "abc"), (2, "u\r\nX: y", "abc"), (3, None, None), (4, "v", ""), (5, "w", "äöü€😀\r\n\r\n" * 300), (5, "w", "äöü€😀\r\n\r\n" * 300), (None, "n", "only"), (9, "x", "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n")]


def test_payloads_survive_segments(spark, tmp_path):
    pages = spark.createDataFrame([(i, u, h, 7) for i, u, h in ODD], "page_id long, url string, html string, payload long")
    warc.write_warc(pages, f"file://{tmp_path}/a", segment_bytes=100)
    records = warc.read_records(spark, f"file://{tmp_path}/a", keep_payload=True)
    assert records.where("origin_id is not null").count() > 20
    rows = warc.reassemble(records, keep_payload=True).collect()
    payload = {r.payload_digest: r.payload for r in rows if r.record_type == "response"}
    assert sorted(((r.page_id, bytes(payload[r.payload_digest]).decode()) for r in rows), key=repr) == sorted(((i, h or "") for i, _, h in ODD), key=repr)
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in rows}
    assert {(1, "revisit", "2"), (2, "response", None), (3, "revisit", "4"), (4, "response", None)} <= kinds


def test_least_bytes_and_empty(spark):
    pages = spark.createDataFrame([(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    rows = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.round_trip(pages, min_bytes=5).collect()}
    assert rows == {1: ("response", None, 3), 2: ("response", None, 3), 3: ("revisit", 4, 6), 4: ("response", None, 6)}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_broken_archives_raise(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x" * 1000)], "page_id long, url string, html string")
    warc.write_warc(pages, f"file://{tmp_path}/a", segment_bytes=200)
    records = warc.read_records(spark, f"file://{tmp_path}/a")
    with pytest.raises(Exception, match="incomplete"):
        warc.reassemble(records.where("segment <> 3")).collect()
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.gz").write_bytes(gzip.compress(b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 9\r\n\r\nabc"))
    with pytest.raises(Exception, match="cut short"):
        warc.read_records(spark, f"file://{tmp_path}/b").collect()


def test_one_member_per_record_and_foreign_records(spark, tmp_path):
    record = b"WARC/1.0\r\nWARC-Type: %b\r\nWARC-Record-ID: <urn:x:%d>\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n"
    body = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nplain"
    parts = [record % (b"warcinfo", 1, 2, b"hi"), record % (b"response", 2, len(body), body)]
    (tmp_path / "x.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    rows = {r.record_type: r for r in warc.read_records(spark, f"file://{tmp_path}", keep_payload=True).collect()}
    assert set(rows) == {"warcinfo", "response"} and bytes(rows["response"].payload) == b"plain"
