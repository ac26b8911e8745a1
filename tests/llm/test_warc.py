import base64
import hashlib

import pytest

from marshgrid.llm import warc as W


def test_round_trip_with_copies(spark):
    rows = [(5, "http://a/\r\nX: 1", "é" * 10), (3, None, "é" * 10), (7, "http://b", None), (9, "http://c", ""), (1, "http://d", "long " * 200000),
            (None, "http://e", "\r\n\r\nWARC/1.1\r\n"), (11, "http://f", "solo"), (11, "http://f", "solo")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as file", "'x' as sha1").repartition(5)
    index = W.write_archives(pages)
    got = sorted(W.read_records(index).collect(), key=lambda r: (r.page_id or 0, r.payload_bytes))
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i, _, html in rows:
        raw = (html or "").encode()
        assert by[i].payload_bytes == len(raw) and by[i].payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert by[i].payload is None if by[i].record_type == "revisit" else bytes(by[i].payload) == raw
    assert {i: r.refers_to for i, r in by.items() if r.record_type == "revisit"} == {5: 3, 9: 7}
    # The index alone picks records: ranges are read for those only.
    some = W.read_records(index.where("page_id in (1, 7)")).collect()
    assert {r.page_id for r in some} == {1, 7}


def test_small_payloads_are_all_stored(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    got = {r.page_id: r.refers_to for r in W.read_records(W.write_archives(pages, min_bytes=3)).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 3}


def test_empty_table_and_damage(spark):
    assert W.read_records(W.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0
    with pytest.raises(ValueError):
        W.parse(W.record(1, "u", b"abc", W.digest_of(b"abd"), None))
