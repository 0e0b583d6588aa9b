"""Mean distances to the nearest: what is ranked, where, and in which pieces."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark import AccumulatorParam, TaskContext
from pyspark.sql import functions as F

from scorewright.operators import nearest


class Counts(AccumulatorParam):
    def zero(self, value):
        return {}

    def addInPlace(self, a, b):  # noqa: N802
        for k, n in b.items():
            a[k] = a.get(k, 0) + n
        return a


def test_few_neighbours_are_ranked_and_by_many_tasks(spark, monkeypatch):
    """All that lies in 25 cells was ranked, some 1500 rows for a place, and one task made them."""
    seen, real = spark.sparkContext.accumulator({}, Counts()), F.hypot

    @F.udf("double")
    def counted(d):
        seen.add({TaskContext.get().partitionId(): 1})
        return d

    monkeypatch.setattr(nearest.F, "hypot", lambda a, b: counted(real(a, b)))
    n, xy = 1500, np.random.default_rng(3).normal(0, 1, (1500, 2))
    df = spark.createDataFrame([("s", float(x), float(y)) for x, y in xy], "g string, x double, y double")
    assert nearest.nearest_mean(df, ["g"], F.lit(30)).count() == n
    assert n * 30 <= sum(seen.value.values()) <= n * 150
    assert max(seen.value.values()) < 0.6 * sum(seen.value.values())


@pytest.mark.parametrize("piece", [256, 7])
def test_mean_of_the_nearest_in_pieces(spark, monkeypatch, piece):
    monkeypatch.setattr(nearest, "PIECE", piece)
    rng = np.random.default_rng(piece)
    sets = {"a": rng.normal(0, 1, (400, 2)), None: np.concatenate([np.repeat(rng.normal(0, 0.01, (40, 2)), 5, axis=0), [[1e4, -1e4], [5.0, 5.0]]]), "few": rng.normal(0, 1, (5, 2))}
    df = spark.createDataFrame([(g, float(x), float(y)) for g, xy in sets.items() for x, y in xy], "g string, x double, y double")
    got = {(r["g"], r["x"], r["y"]): (r["n"], r["far"]) for r in nearest.nearest_mean(df, ["g"], F.lit(12)).collect()}
    want = {}
    for g, xy in sets.items():
        far = np.sort(np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1)), axis=1)[:, 1:12].mean(axis=1)
        for (x, y), d in zip(xy.tolist(), far, strict=True):
            if g != "few":
                want[g, x, y] = (want.get((g, x, y), (0,))[0] + 1, pytest.approx(d))
    assert got == want


def test_candidates_come_in_several_batches(monkeypatch):
    monkeypatch.setattr(nearest, "ROWS", 5)
    x = np.arange(6.0)
    row = {"g": "s", "k": 2, "ax": x, "ay": x * 0, "ac": [1] * 6, "reach": [1.0] * 4 + [np.inf, np.nan], "ox": x, "oy": x * 0, "oc": [1] * 6}
    batch = pa.RecordBatch.from_pylist([row, {**row, "g": None, "reach": [0.0] * 6}])
    out = list(nearest._candidates([batch.slice(0, 0), batch]))
    rows = [(r["g"], r["x"], r["ox"]) for b in out for r in b.to_pylist()]
    near = [("s", a, o) for a in range(5) for o in range(6) if abs(a - o) <= 1] + [("s", 5, o) for o in range(6)]
    assert len(out) == 2 and rows == near + [(None, a, a) for a in range(6)]
