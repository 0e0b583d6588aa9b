"""Boxed answers of any depth, dyadic covers, running task hashes, replicate sums."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewright.functions import extract as E
from scorewright.operators import aggregate as A
from scorewright.operators import requests as R
from scorewright.operators import stats


def plain_boxed(text):
    """The rule as it is said: every start, its own count of braces, the last that closes."""
    found, at = None, text.find("\\boxed{")
    while at != -1:
        depth = 0
        for k in range(at + 6, len(text)):
            depth += {"{": 1, "}": -1}.get(text[k], 0)
            if depth == 0:
                found = text[at + 7 : k]
                break
        at = text.find("\\boxed{", at + 1)
    return found


def test_boxed_at_any_depth(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choices(["\\boxed{", "{", "}", "x", "boxed", "\\", " é\n"], weights=[2, 2, 4, 2, 1, 1, 1], k=rng.randint(0, 30))) for _ in range(600)]
    texts += ["", "\\boxed{}", "\\boxed{" + "{" * 400 + "7" + "}" * 400 + "}", "\\boxed{a} \\boxed{b", "\\boxed{a \\boxed{b} c}", "} } \\boxed{a}", "\\boxed{" * 50_000, None]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    for r in df.select("t", E.boxed("t").alias("b")).collect():
        assert r["b"] == (None if r["t"] is None else plain_boxed(r["t"]) if len(r["t"]) < 100_000 else None)


def test_dyadic_covers(spark):
    rng = random.Random(7)
    spans = [(rng.randrange(3), a, a + rng.choice([1, 2, 5, 100, 10**6, 10**12])) for a in (rng.randrange(-2000, 2000) for _ in range(150))] + [(0, 5, 5), (0, 9, 2), (1, None, 4), (1, 4, None)]
    df = spark.createDataFrame(spans, "v int, a long, b long")
    nodes = df.where("a < b").select("a", "b", R.dyadic_cover(F.col("a"), F.col("b")).alias("n")).collect()
    for r in nodes:
        cells = sorted((n["node"] << n["level"], (n["node"] + 1) << n["level"]) for n in r["n"])
        assert cells[0][0] == r["a"] and cells[-1][1] == r["b"] and all(x[1] == y[0] for x, y in zip(cells, cells[1:]))
        assert len(cells) <= 2 * (r["b"] - r["a"]).bit_length()
    points = [(rng.randrange(3), rng.randrange(-3000, 5000)) for _ in range(300)] + [(1, None)]
    got = R.overlapping(spark.createDataFrame(points, "v int, at long"), df, "v", "at", "a", "b")
    want = sorted((v, p, a, b) for v, p in points for w, a, b in spans if v == w and None not in (p, a, b) and a <= p < b)
    assert sorted((r["v"], r["at"], r["a"], r["b"]) for r in got.collect()) == want
    halves = R.overlapping(spark.createDataFrame([(1, 1.5), (1, 2.25)], "v int, at double"), spark.createDataFrame([(1, 1.6, 2.3), (1, 0.2, 1.55)], "v int, a double, b double"), "v", "at", "a", "b")
    assert sorted((r["at"], r["a"]) for r in halves.collect()) == [(1.5, 0.2), (2.25, 1.6)]
    assert R.overlapping(spark.createDataFrame(points, "v int, at long"), df.limit(0), "v", "at", "a", "b").collect() == []


def test_task_hashes_run_over_batches(spark):
    rows = [(t, k, hashlib.sha256(f"{t}{k}".encode()).hexdigest()) for t, n in (("a", 25_000), ("b", 1), (None, 3)) for k in range(n)] + [("c", 1, None)]
    random.Random(8).shuffle(rows)
    df = spark.createDataFrame(rows, "task string, doc_id long, h string").repartition(5)
    want = {t: hashlib.sha256("".join(h for u, _, h in sorted(rows, key=lambda r: r[1]) if u == t and h).encode()).hexdigest() for t in ("a", "b", "c", None)}
    assert {r["task"]: r["task_hash"] for r in R.task_hash(df, "task", "doc_id", "h").collect()} == want
    assert R.task_hash(df.limit(0), "task", "doc_id", "h").collect() == []


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(9)
    rows = [(k, rng.choice(["x", "x", None]), rng.random() < 0.5, rng.random() < 0.4, rng.random(), rng.choices("ab c d e".split(), k=rng.randint(0, 9)), [rng.choices("ab c d e".split(), k=rng.randint(1, 9))]) for k in range(900)]
    return spark.createDataFrame(rows, "id long, s string, g boolean, p boolean, v double, c array<string>, refs array<array<string>>").repartition(5)


def test_weights_are_those_of_rows(spark, scored):
    drawn = stats.poisson_weights(scored.select("id", F.xxhash64(F.lit(7), "id").alias("state")), ["id"], 40, 7).collect()
    states = {r["id"]: r["state"] for r in drawn}
    weights = stats.replicate_weights(np.array(list(states.values()), np.int64), 40)
    made = {(i, k): int(w) for i, row in zip(states, weights) for k, w in enumerate(row) if w}
    assert made == {(r["id"], r["replicate"]): r["weight"] for r in drawn}


def test_corpus_metrics_equal_those_of_copied_rows(scored):
    def close(a, b):
        a, b = ({r["s"]: tuple(r)[1:] for r in x.collect()} for x in (a, b))
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)

    bleu = stats.bootstrap_sums(scored, ["s"], ["id"], A.bleu_counters("c", "refs"), A.bleu_score(2), 30)
    close(bleu, stats.bootstrap_aggregate(scored, ["s"], ["id"], lambda df, by: A.corpus_bleu(df, by, "c", "refs", 2).drop("bleu_1"), "bleu_2", 30))
    cells = A.binary_counters("g", "p")
    mcc = stats.bootstrap_sums(scored, ["s"], ["id"], cells, A.matthews_score(), 30)
    flags = lambda df: df.withColumns({"g": F.col("g").cast("int"), "p": F.col("p").cast("int"), "s": F.coalesce("s", F.lit("none"))})
    named = stats.bootstrap_aggregate(flags(scored), ["s"], ["id"], lambda df, by: A.matthews(df, by, "g", "p"), "mcc", 30)
    close(mcc.fillna("none", ["s"]), named)
    f1 = stats.bootstrap_sums(scored.where("s = 'x'"), [], ["id"], cells, A.f1_score(), 60).first()
    rows = scored.where("s = 'x'").select("g", "p").collect()
    rng, draws = random.Random(1), []
    for _ in range(400):
        own = rng.choices(rows, k=len(rows))
        tp, wrong = sum(r["g"] and r["p"] for r in own), sum(r["g"] != r["p"] for r in own)
        draws.append(2 * tp / (2 * tp + wrong))
    assert f1["boot_stderr"] == pytest.approx(np.std(draws), rel=0.3) and f1["low"] < np.mean(draws) < f1["high"]


def test_what_is_handed_on_does_not_grow_with_rows(spark):
    def parts(n):
        df = spark.range(n).select("id", (F.col("id") % 3).alias("k")).repartition(4)
        return stats._partial_sums(df, ["k"], ["id"], {"_v": F.col("id")}, 20, 7).count()

    assert parts(2_000) == parts(40_000) == 12
