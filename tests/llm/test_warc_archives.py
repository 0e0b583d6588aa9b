"""Archives are cut by bytes, and each record is a gzip member of its own."""

import gzip
import random

import pytest

from scorewright.llm import warc


def test_skewed_pages_stay_within_the_bound(spark, tmp_path):
    rng = random.Random(1)
    noise = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=n))
    html = [noise(20) for _ in range(3000)] + [noise(300_000) for _ in range(40)] + [noise(20) for _ in range(1000)]
    table = spark.createDataFrame([(k, f"http://h/{k}", h) for k, h in enumerate(html)], "page_id long, url string, html string")
    target = 1 << 20
    warc.write_archives(table, str(tmp_path / "w"), archive_bytes=target)
    sizes = [p.stat().st_size for p in (tmp_path / "w").glob("part-*")]
    assert len(sizes) > 6 and max(sizes) < target + 300_000
    rows = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read_archives(spark, str(tmp_path / "w"), payloads=True).collect()}
    assert rows == dict(enumerate(html))


def test_members_are_single_records(spark, tmp_path):
    table = spark.createDataFrame([(k, "u", "same" if k % 2 else f"own {k}") for k in range(50)], "page_id long, url string, html string")
    warc.write_archives(table, str(tmp_path / "w"))
    found = []
    for p in (tmp_path / "w").glob("part-*"):
        data = p.read_bytes()
        assert data.endswith(warc.PAD.encode())
        found += [len(list(warc.parse_archive(one))) for one in warc.members(data)]
        assert gzip.decompress(data) == b"".join(warc.members(data))  # other readers take the padding too
    assert found == [1] * 50


def test_broken_archives_raise():
    one = gzip.compress(b"x" * 1000, mtime=0)
    assert list(warc.members(b"")) == [] and list(warc.members(one + one + b"\0")) == [b"x" * 1000] * 2
    with pytest.raises(ValueError, match="cut short"):
        list(warc.members(one + one[:-3]))
