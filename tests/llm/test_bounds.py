"""What a task holds does not grow with the data."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from scorewright.llm import decontam, simhash


def test_a_search_block_stays_within_its_bound():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=6)).encode() for _ in range(20_000)]
    many = 100_000
    items = [(str(k), rng.choices(vocabulary, k=500)) for k in range(many // 500)]
    tracemalloc.start()
    tables = decontam.window_tables(items, 10)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held / many * decontam.BLOCK_WORDS < 450 << 20
    at = [(p, sorted(names)) for t in tables for p, names in t.search([b"x", *items[3][1][7:40], b"y"])]
    assert at == [(k, ["3"]) for k in range(1, 25)]


def test_benchmark_of_many_blocks(make_docs, spark, prose):
    items = [prose(30, k) for k in range(20)] + [None, "", "alone here", prose(30, 3)]
    benchmark = spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string")
    docs = make_docs([f"{prose(9, 500)} {prose(30, k)} {prose(9, 501)}" for k in range(25)] + ["it was alone here", None])
    whole = decontam.contamination(docs, benchmark).collect()
    small = decontam.contamination(docs, benchmark, block_words=70).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, small)) and sum(r["contaminated"] for r in whole) == 21


@pytest.mark.parametrize("gathered", [1, 7, 50, 10**6])
def test_keys_come_whole(monkeypatch, gathered):
    rng = np.random.default_rng(6)
    start, key = rng.integers(0, 3, 400), rng.integers(0, 9, 400)
    order = np.lexsort((key, start))
    fp = np.arange(400)
    monkeypatch.setattr(simhash, "GATHERED", gathered)
    cuts = sorted(rng.choice(400, 12, replace=False))
    arrays = [pa.array(x[order]) for x in (fp, start, key)]
    table = pa.RecordBatch.from_arrays(arrays, names=["fp", "start", "key"])
    batches = [table.slice(a, b - a) for a, b in zip([0, *cuts], [*cuts, 400])]
    pieces = list(simhash._whole_keys(iter(batches)))
    assert np.concatenate([f for _, f in pieces]).tolist() == fp[order].tolist()
    of = {int(f): (int(s), int(k)) for f, s, k in zip(fp, start, key)}
    homes = [{of[int(f)] for f in fps} for _, fps in pieces]
    assert sum(map(len, homes)) == len(set(of.values()))
    if gathered > 400:
        assert len(pieces) == 1


def test_fingerprint_of_blocks_is_that_of_all(monkeypatch, prose):
    text = prose(5000, 3)
    want = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 64)
    assert simhash.fingerprint(text) == want
