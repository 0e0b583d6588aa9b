"""No node of the merge tree grows with the data, whatever the pieces' lengths."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewright.llm import packing
from tests.llm.test_packing import check, tokenizer  # noqa: F401


def sequential(fills, capacity):
    fit = packing.BestFit(capacity)
    for f in sorted(fills, reverse=True):
        fit.put(f, f)
    return Counter(tuple(sorted(held)) for _, held in fit.take(capacity))


@pytest.mark.parametrize("seed", range(30))
def test_the_plan_over_counts_is_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 20, 64])
    fills = [rng.randint(1, capacity) for _ in range(rng.randint(1, 400))]
    counts = Counter(fills)
    bins, ranks = {}, Counter()
    for fill, first, last, start, times in packing.planned(dict(counts), capacity):
        assert first == ranks[fill]
        ranks[fill] = last
        for rank in range(first, last):
            bins.setdefault(start + (rank - first) // times, []).append(fill)
    assert ranks == counts
    assert Counter(tuple(sorted(b)) for b in bins.values()) == sequential(fills, capacity)


def test_the_plan_is_small_for_many_bins():
    rng = random.Random(1)
    counts = {f: rng.randint(0, 10**12) for f in range(1, 1025)}
    assert len(packing.planned(counts, 1024)) < 5_000


def bins_of(spark, lengths):
    rows = [(k, n, False, [(k, 0, 0, n, 0)]) for k, n in enumerate(lengths)]
    return spark.createDataFrame(rows, packing._BIN)


def test_pieces_over_half_the_capacity_do_not_meet_in_one_task(spark, monkeypatch):
    lengths = [600] * 3000 + [424] * 1000 + [300] * 500
    bins = bins_of(spark, lengths)
    monkeypatch.setattr(packing, "_first_level", lambda *a: bins)
    largest = []
    level = packing._next_level
    monkeypatch.setattr(packing, "_next_level", lambda b, l, nodes, *a: largest.append(b.groupBy(F.pmod(F.xxhash64("seq"), F.lit(nodes))).count().agg(F.max("count")).first()[0]) or level(b, l, nodes, *a))
    rows = packing.pack(spark.range(0).select(F.col("id").alias("doc_id"), F.lit("").alias("text")), node_bins=200).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(lengths))) and max(largest) < 400
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in by_seq.values():
        held.sort()
        ends = np.cumsum([n for _, n in held])
        assert [o for o, _ in held] == [0, *ends[:-1]] and ends[-1] <= 1024
    assert 3000 <= len(by_seq) <= 3010  # each piece of 600 needs a sequence of its own


def test_small_nodes_give_whole_results(make_docs, prose, tokenizer):  # noqa: F811
    texts = [prose(40 + 300 * (k % 3), k) for k in range(120)] + [None, "", "x"]
    rows = packing.pack(make_docs(texts).repartition(7, "doc_id"), node_bins=5).collect()
    used = check(rows, texts, tokenizer, 1024)
    assert used <= 1.15 * sum(r["length"] for r in rows) / 1024 + 2
