"""Rolling figures of a stream over several batches, out of order and late, against plain Python."""

import datetime
import math
import random
import uuid

import numpy as np
import pytest

from scorewright.streaming import streams as ST

SCHEMA = "reward string, step long, mean double, std double, ts timestamp"
DAY = datetime.datetime(2024, 3, 1)


def plain(rows, n):
    """Figures of accepted rows in the order of event time and step."""
    out = {}
    for name in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == name), key=lambda r: (r[4], r[1]))
        for k, r in enumerate(own):
            last = own[max(0, k - n + 1) : k + 1]
            held = [(i, x[2]) for i, x in enumerate(last) if x[2] is not None]
            stds = [x[3] for x in last if x[3] is not None]
            ref = 1.0 if name == "tool" else 0.0
            flags = [float(x[3] < 0.02 and abs(x[2] - ref) < 0.05) for x in last if x[2] is not None or x[3] >= 0.02]
            slope = float(np.polyfit(*zip(*held), 1)[0]) if len(held) >= 5 else 0.0
            avg = lambda v: sum(v) / len(v) if v else None
            out[name, r[1]] = (avg([v for _, v in held]), avg(stds), avg(flags), slope, len(held))
    return out


def test_steps_count_in_the_order_of_event_time(spark, tmp_path):
    rng = random.Random(5)
    at = lambda minute: DAY + datetime.timedelta(minutes=minute)
    rows = [(rng.choice(["tool", "view"]), k, rng.random() / 10 if rng.random() < 0.95 else None, rng.random() / 25, at(k)) for k in range(300)]
    parts = [[r for r in rows if b * 100 <= r[1] < b * 100 + 100] for b in range(3)]
    # some of the first part come with the second: those within an hour of its newest row in time, the others late
    moved = [r for r in parts[0] if r[1] % 9 == 4]
    parts[0] = [r for r in parts[0] if r not in moved]
    parts[1] += moved
    newest = max(r[4] for r in parts[0])
    late = [r for r in moved if r[4] <= newest - datetime.timedelta(hours=1)]
    assert late and len(late) < len(moved)
    for p in parts:
        rng.shuffle(p)

    source, sink, state = (str(tmp_path / x) for x in ("source", "sink", "state"))
    got = {}
    for k, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).repartition(3).write.mode("append").parquet(source)
        found = ST.rolling_rewards(spark.readStream.schema(SCHEMA).parquet(source), 20, "1 hour")
        with ST.keyed_state(spark):
            found.writeStream.outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).format("parquet").option("path", sink).start().awaitTermination()
        before = len(got)
        got = {(r["reward"], r["step"]): (r["rolling_mean"], r["rolling_std"], r["saturation"], r["slope"], r["n"]) for r in spark.read.parquet(sink).collect()}
        assert len(got) > before  # every batch lets the watermark pass some steps
    accepted = [r for r in rows if r not in late]
    top = max(r[4] for r in rows) - datetime.timedelta(hours=1)
    want = {k: v for k, v in plain(accepted, 20).items() if next(r for r in rows if (r[0], r[1]) == k)[4] <= top}
    assert got.keys() == want.keys()
    for k in want:
        a = [0.0 if x is None or isinstance(x, float) and math.isnan(x) else x for x in got[k]]
        assert a == pytest.approx([0.0 if x is None else x for x in want[k]], abs=1e-9), k


def test_the_setting_comes_back(spark):
    before = spark.conf.get(ST.STORE[0], None)
    with ST.keyed_state(spark):
        assert spark.conf.get(ST.STORE[0]) == ST.STORE[1]
    assert spark.conf.get(ST.STORE[0], None) == before


def test_first_valid_responses_over_batches(spark, tmp_path):
    """A key comes out once, whichever batch repeats it."""
    schema = "cache_key string, kind string, text string, ll array<double>, ts timestamp"
    source, name = str(tmp_path / "in"), f"t{uuid.uuid4().hex}"
    sink, state = str(tmp_path / "out"), str(tmp_path / name)
    for b in range(3):
        rows = [(f"k{k}", "generate_until", None if k == 3 else "x", None, DAY + datetime.timedelta(minutes=b)) for k in range(b, b + 4)]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        found = ST.tail_responses(spark.readStream.schema(schema).parquet(source), "1 day")
        found.writeStream.outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).format("parquet").option("path", sink).start().awaitTermination()
    assert sorted(r["cache_key"] for r in spark.read.parquet(sink).collect()) == ["k0", "k1", "k2", "k4", "k5"]


def test_waiting_steps_come_out_in_parts(monkeypatch):
    """A processor holds a few buckets at a time, and the figures do not depend on it."""
    rng, n = random.Random(8), 20

    class Store(dict):
        getValue = dict.__getitem__  # noqa: N815
        updateValue, removeKey = dict.__setitem__, dict.__delitem__  # noqa: N815
        exists = lambda self: "v" in self
        get = lambda self, *a: self["v"] if self.exists() else ()
        update = put = lambda self, v: self.__setitem__("v", v)

    timers = []
    handle = type("H", (), {"getMapState": lambda s, *a: Store(), "getValueState": lambda s, *a: Store(), "getListState": lambda s, *a: Store(), "registerTimer": lambda s, t: timers.append(t)})()
    rows = [(k, rng.random() if rng.random() < 0.9 else None, rng.random(), 0.0, DAY + datetime.timedelta(minutes=3 * k)) for k in range(3000)]
    given = ST.pd.DataFrame(rng.sample(rows, len(rows)), columns=["step", "mean", "std", "flag", "ts"])
    mark = int(rows[2500][4].replace(tzinfo=datetime.timezone.utc).timestamp() * 1000)
    got = []
    for at_once in (10_000, 100):
        monkeypatch.setattr(ST, "AT_ONCE", at_once)
        p = ST.RewardFigures("reward", n)
        p.init(handle)
        for a in range(0, 3000, 700):
            list(p.handleInputRows(("view",), iter([given[a : a + 700]]), None))
        times = type("T", (), {"getCurrentWatermarkInMs": lambda s: mark})()
        frames = list(p.handleExpiredTimer(("view",), times, None))
        assert len(frames) == 1 if at_once > 5000 else max(map(len, frames)) < 200
        got.append(ST.pd.concat(frames, ignore_index=True))
        assert got[-1]["step"].tolist() == list(range(2501))
        assert timers[-1] == int(rows[2501][4].replace(tzinfo=datetime.timezone.utc).timestamp() * 1000) + 1
        assert sum(len(v[0]) for v in p.waiting.values()) == 499 * ST.STEP.itemsize
    ST.pd.testing.assert_frame_equal(*got, rtol=1e-9)
