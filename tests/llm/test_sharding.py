import random
import zlib

import pytest

from scorewright.llm import sharding
from tests.llm.conftest import ODD, rows_of


def brute(sizes, shards):
    """Smallest capacity of a contiguous partition, by dynamic programming."""
    prefix = [0]
    for s in sizes:
        prefix.append(prefix[-1] + s)
    best = [0] + [float("inf")] * len(sizes)
    for _ in range(shards):
        best = [0] + [min(max(best[j], prefix[i] - prefix[j]) for j in range(i + 1)) for i in range(1, len(sizes) + 1)]
    return best[-1]


@pytest.mark.parametrize("seed", range(6))
def test_capacity_is_least(spark, monkeypatch, seed):
    monkeypatch.setattr(sharding, "LEVEL_BITS", 3)  # many levels
    rng = random.Random(seed)
    groups = {}
    for _ in range(150):
        h = rng.getrandbits(60) if rng.random() < 0.6 else (rng.getrandbits(6) | 0xABC << 40)
        groups[h] = rng.choice([1, 3, 10, 50, 400 * (seed % 3)]) + 1
    table = spark.createDataFrame(list(groups.items()), "h long, bytes long")
    for shards in (1, 3, 8):
        cuts, high = sharding.minimax_cuts(table, shards)
        assert high == brute([groups[h] for h in sorted(groups)], shards)
        loads = [0] * shards
        for h, n in groups.items():
            loads[sum(h >= c for c in cuts)] += n
        assert max(loads) == high and cuts == sorted(cuts)


def test_shards_of_documents(make_docs, prose):
    texts = [prose(5 + k % 60, k % 80) for k in range(120)] + [prose(9, 1)] * 60 + ODD
    rows = sharding.shard_by_bytes(make_docs(texts), 8).collect()
    assert len(rows) == len(texts)
    of_text, slots = {}, {}
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        assert of_text.setdefault(raw, r["shard"]) == r["shard"] and 0 <= r["shard"] < 8
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_repeated_rows_few_groups_and_empty(make_docs, tmp_path):
    docs = make_docs(rows_of(["a", "a", "b"]) + rows_of(["a"]) + [(None, None, *[None] * 6)])
    rows = sharding.shard_by_bytes(docs, 8).collect()
    assert len(rows) == 5 and len({(r["shard"], r["slot"]) for r in rows}) == 5
    assert sharding.shard_by_bytes(docs.limit(0), 8).collect() == []
    sharding.write_shards(docs, str(tmp_path / "out"), 2)
    assert docs.sparkSession.read.parquet(str(tmp_path / "out")).count() == 5
