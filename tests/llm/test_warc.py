import base64
import gzip
import hashlib

from scorewright.llm import warc

HTML = ["<p>one</p>", "<p>two</p>", None, "", "<p>one</p>", "a\r\n\r\nWARC/1.1\r\nb\n", "é\U0001f600", "x" * 100_000, "<p>one</p>", "a\r\n\r\nWARC/1.1\r\nb\n"]


def pages(spark, html, extra="x"):
    rows = [(k, f"http://h.example/{k}\r\n ü", h, extra) for k, h in enumerate(html)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string")


def test_round_trip(spark, tmp_path):
    for least in (0, 11):
        out = str(tmp_path / f"w{least}")
        warc.write_archives(pages(spark, HTML), out, least_bytes=least, archive_bytes=50_000)
        rows = {r["page_id"]: r for r in warc.read_archives(spark, out, payloads=True).collect()}
        first = {}
        for k, h in enumerate(HTML):
            raw = (h or "").encode()
            r = rows[k]
            assert r["payload_bytes"] == len(raw)
            assert r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
            origin = first.setdefault(raw, k) if len(raw) >= least else k
            assert (r["record_type"], r["refers_to"]) == (("response", None) if origin == k else ("revisit", origin))
            assert (bytes(r["payload"]) == raw) if origin == k else r["payload"] is None
        assert len(rows) == len(HTML)


def test_fresh_headers(spark, tmp_path):
    out = str(tmp_path / "w")
    warc.write_archives(pages(spark, HTML[:5]), out, date="2020-01-02T03:04:05Z")
    data = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "w").glob("part-*")))
    records = list(warc.parse_archive(data))
    by_id = {f["x-page-id"]: f for f, _ in records}
    assert len({f["warc-record-id"] for f, _ in records}) == 5
    assert by_id["4"]["warc-refers-to"] == by_id["0"]["warc-record-id"]
    assert by_id["4"]["warc-refers-to-target-uri"] == by_id["0"]["warc-target-uri"]
    assert by_id["4"]["warc-refers-to-date"] == by_id["0"]["warc-date"] == "2020-01-02T03:04:05Z"
    assert "warc-refers-to" not in by_id["0"]


def test_repeated_null_ids_and_empty(spark, tmp_path):
    rows = [(1, "u", "p"), (1, "u", "p"), (None, None, "p"), (None, "v", "q"), (None, "v", "q"), (2, None, "p")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(table, str(tmp_path / "a"))
    got = sorted((str(r["page_id"]), r["record_type"], str(r["refers_to"])) for r in warc.read_archives(spark, str(tmp_path / "a")).collect())
    assert got == [("1", "response", "None"), ("1", "response", "None"), ("2", "revisit", "1"), ("None", "response", "None"), ("None", "response", "None"), ("None", "revisit", "1")]
    warc.write_archives(table.limit(0), str(tmp_path / "b"))
    assert warc.read_archives(spark, str(tmp_path / "b")).collect() == []
