import base64
import hashlib

from attnlens.llm import warc

PAGES = [(1, "http://a/\r\n1", "abc\r\n"), (2, None, "abc\r\n"), (3, "u", None), (4, "u", ""), (5, "u", "x" * 1000 + "\r\n\r\nWARC/1.1\r\n\r\n"),
         (6, "u", "é\r\n\r\n\r\n"), (7, "u", "\r\n"), (8, "u", "\r\n\r\n"), (9, "u", "x" * 1000 + "\r\n\r\nWARC/1.1\r\n\r\n"), (None, "u", "abc\r\n"), (1, "http://a/\r\n1", "abc\r\n"), (12, "u", "\r"), (13, "u", "\n\r\n\r")]
SCHEMA = "page_id long, url string, html string, record string, kind int"


def expected(smallest=0):
    first = {}
    for i, _, h in PAGES:
        p = (h or "").encode()
        if i is not None:
            first[p] = min(i, first.get(p, i))
    out = []
    for i, _, h in PAGES:
        p = (h or "").encode()
        of = first.get(p) if len(p) >= smallest else i
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if of == i else "revisit", None if of == i else of))
    return sorted(out, key=str)


def test_round_trip_with_segments(spark):
    pages = spark.createDataFrame([(*p, "r", 1) for p in PAGES], SCHEMA)
    for smallest, chunk in ((0, 7), (0, 1 << 18), (6, 3)):
        rows = warc.round_trip(pages, smallest, chunk).collect()
        assert sorted((tuple(r) for r in rows), key=str) == expected(smallest)


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_page_id_with_several_payloads(spark):
    rows = [(5, "u", "A" * 9), (5, "u", "B"), (9, "u", "B"), (9, "u", "A" * 9), (5, "u", "C"), (11, "u", "C"), (12, None, "B")]
    want = sorted((i, len(p), base64.b32encode(hashlib.sha1(p.encode()).digest()).decode(), *(("response", None) if i == 5 else ("revisit", 5))) for i, _, p in rows)
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        got = warc.round_trip(spark.createDataFrame([(*r, "r", 1) for r in order], SCHEMA)).collect()
        assert sorted(tuple(r) for r in got) == want


def test_many_repeated_payloads_meet_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST", 0)
    pages = spark.createDataFrame([(*p, "r", 1) for p in PAGES] + [(100 + k, "u", "", "r", 1) for k in range(40)], SCHEMA)
    rows = warc.round_trip(pages).collect()
    assert sorted((tuple(r) for r in rows if (r.page_id or 0) < 100), key=str) == expected()
    assert [r.refers_to for r in rows if (r.page_id or 0) >= 100] == [3] * 40
