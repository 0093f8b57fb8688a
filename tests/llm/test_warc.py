import base64
import gzip
import hashlib

from gleanery.llm import warc
from tests.llm.helpers import rows_of

SCHEMA = "page_id long, url string, html string, first string, page string"


def brute(rows, least=0):
    first = {}
    for p, _, h in rows:
        first[h or ""] = min(first.get(h or "", p), p)
    out = []
    for p, _, h in rows:
        raw = (h or "").encode()
        same = len(raw) < least or first[h or ""] == p
        out.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if same else "revisit", None if same else first[h or ""]))
    return sorted(out, key=str)


ROWS = [(5, "http://x/1", "<p>é</p>"), (3, None, "<p>é</p>"), (9, "http://x/ \r\n2", None), (4, "http://x/3", ""), (7, "u", "z" * 300_000), (8, "u", "<p>é</p>"), (11, "v", "\r\n\r\n")]


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def found(df):
    return sorted(((r["page"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows_of(df)), key=str)


def test_round_trip(spark):
    for least in (0, 5):
        index = warc.write_archives(table(spark, ROWS).repartition(3), least_bytes=least)
        assert found(warc.read_records(index)) == brute(ROWS, least)
        assert len(rows_of(index)) == len(ROWS)
    payloads = {r["page"]: bytes(r["payload"]) for r in rows_of(warc.read_records(index.filter("record_type = 'response'"), payloads=True))}
    assert payloads == {p: (h or "").encode() for p, _, h in ROWS if p in payloads} and 7 in payloads


def test_selected_and_far_apart_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc, "GAP", 0)
    rows = [(i, f"http://x/{i}", str(i) * 50) for i in range(40)]
    index = warc.write_archives(table(spark, rows).coalesce(1))
    some = index.filter("page % 3 = 0")
    assert found(warc.read_records(some)) == [x for x in brute(rows) if x[0] % 3 == 0]


def test_repeated_rows_and_an_empty_table(spark):
    twice = [(1, "u", "x"), (1, "u", "x"), (2, "u", "x")]
    assert [x[3] for x in found(warc.read_records(warc.write_archives(table(spark, twice))))] == ["response", "response", "revisit"]
    assert found(warc.read_records(warc.write_archives(table(spark, [])))) == []


def test_a_damaged_record_is_refused():
    raw = gzip.decompress(warc.build_record(1, "u", b"payload", warc.sha1_base32(b"payload"), None))
    assert warc.parse_record(gzip.compress(raw))["payload"] == b"payload"
    try:
        warc.parse_record(gzip.compress(raw.replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n")))
    except ValueError:
        return
    raise AssertionError("a wrong payload was read")
