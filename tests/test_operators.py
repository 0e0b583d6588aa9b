"""Operators without SQL against plain Python."""

import json
import math
import random
from collections import Counter
from statistics import NormalDist, stdev

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scorewright.operators import aggregate as A
from scorewright.operators import grams, rollouts, sampling, spatial, stats
from scorewright.operators.graph import connected_components
from scorewright.sources import io


def brute_components(nodes, edges):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(k, k + 1) for k in range(300, 360)] + [(500, k) for k in range(501, 540)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == brute_components({n for e in real for n in e}, real)
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_bleu_chrf_cider(spark):
    rows = [(1, "the cat sat on the mat".split(), ["the cat is on the mat".split(), "there is a cat on the mat".split()]), (2, "a dog".split(), ["a dog ran".split()]), (3, [], ["x".split()])]
    df = spark.createDataFrame(rows, "id long, p array<string>, r array<array<string>>")
    grams = lambda t, n: Counter(tuple(t[k : k + n]) for k in range(len(t) - n + 1))
    m, tot, c, r = [0] * 4, [0] * 4, 0, 0
    for _, p, refs in rows:
        c += len(p)
        r += min((abs(len(x) - len(p)), len(x)) for x in refs)[1]
        for n in range(4):
            best = Counter()
            for x in refs:
                best |= grams(x, n + 1)
            m[n] += sum((grams(p, n + 1) & best).values())
            tot[n] += max(0, len(p) - n)
    bp = 1 if c >= r else math.exp(1 - r / c)
    got = A.corpus_bleu(df, [], "p", "r").first()
    for n in range(1, 5):
        want = 0 if min(m[:n]) == 0 else 100 * bp * math.exp(sum(math.log(a / b) for a, b in zip(m[:n], tot[:n])) / n)
        assert got[f"bleu_{n}"] == pytest.approx(want)
    text = spark.createDataFrame([("abcd ef", "abce f")], "p string, r string")
    p, q = "abcdef", "abcef"
    prec = [sum((grams(p, n) & grams(q, n)).values()) / max(1, len(p) - n + 1) for n in range(1, 6)]
    rec = [sum((grams(p, n) & grams(q, n)).values()) / max(1, len(q) - n + 1) for n in range(1, 6)]
    a, b = sum(prec) / 5, sum(rec) / 5
    assert A.corpus_chrf(text, [], "p", "r").first()["chrf"] == pytest.approx(100 * 5 * a * b / (4 * a + b))
    df_of = Counter(g for _, _, refs in rows for g in {(n, x) for ref in refs for n in range(1, 5) for x in grams(ref, n)})
    vec = lambda t, n: {g: k * (math.log(3) - math.log(max(1, df_of[n, g]))) for g, k in grams(t, n).items()}
    for row in A.cider(df, "id", "p", "r").collect():
        _, p, refs = rows[row["id"] - 1]
        want = 0
        for ref in refs:
            for n in range(1, 5):
                u, v = vec(p, n), vec(ref, n)
                nu, nv = (math.sqrt(sum(x * x for x in w.values())) for w in (u, v))
                if nu and nv:
                    want += sum(min(u.get(g, 0), x) * x for g, x in v.items()) / (nu * nv) * math.exp(-((len(p) - len(ref)) ** 2) / 72)
        assert row["cider"] == pytest.approx(10 * want / (4 * len(refs)))


def test_elo_balances_wins(spark):
    rng = random.Random(1)
    power = {"a": 1.0, "b": 2.0, "c": 4.0}
    rows = []
    for _ in range(900):
        x, y = rng.sample(sorted(power), 2)
        rows.append((x, y, "tie" if rng.random() < 0.1 else "A" if rng.random() < power[x] / (power[x] + power[y]) else "B"))
    got = {r["model"]: r["rating"] for r in A.elo(spark.createDataFrame(rows, "model_a string, model_b string, winner string"), "a").collect()}
    assert got["a"] == pytest.approx(1000) and got["a"] < got["b"] < got["c"]
    assert got["c"] - got["a"] == pytest.approx(400 * math.log10(4), abs=60)


def test_clustered_equals_plain_for_single_rows(spark):
    rows = [(k, float(k % 7)) for k in range(50)]
    r = stats.clustered_stderr(spark.createDataFrame(rows, "c long, v double"), [], "v", "c").first()
    assert r["stderr"] == pytest.approx(stdev(v for _, v in rows) / math.sqrt(50)) and r["stderr_clustered"] == pytest.approx(r["stderr"])


def test_t_distribution():
    assert stats.t_ppf(0.975, 10) == pytest.approx(2.228139, abs=1e-6) and stats.t_ppf(0.975, 1) == pytest.approx(12.7062, abs=1e-4)
    assert stats.t_cdf(2.0, 10) == pytest.approx(0.963306, abs=1e-6) and stats.t_cdf(-2.0, 10) == pytest.approx(1 - 0.963306, abs=1e-6)


def test_paired_and_power(spark):
    a = spark.createDataFrame([(k, float(k % 3), "x") for k in range(40)], "id long, score double, task string")
    b = spark.createDataFrame([(k, float(k % 2)) for k in range(5, 60)], "id long, score double")
    d = [k % 3 - k % 2 for k in range(5, 40)]
    r = stats.paired_ttest(a, b, "id", ["task"]).first()
    err = stdev(d) / math.sqrt(len(d))
    assert (r["n"], r["diff"], r["t"]) == (35, pytest.approx(sum(d) / 35), pytest.approx(sum(d) / 35 / err))
    assert r["high"] - r["diff"] == pytest.approx(stats.t_ppf(0.975, 34) * err) and 0 < r["p"] < 1
    same = stats.paired_ttest(a, a.drop("task"), "id", ["task"]).first()
    assert (same["p"], same["t"]) == (1.0, 0.0)
    p = stats.power(a, b, "id", 0.2).first()
    z = NormalDist().inv_cdf
    assert p["std_diff"] == pytest.approx(stdev(d)) and p["required_n"] == math.ceil(((z(0.975) + z(0.8)) * stdev(d) / 0.2) ** 2)


def test_combined_stderr(spark):
    parts = [("a", 1.0, 0.1, 20), ("b", 2.0, 0.2, 30), ("c", 1.5, 0.05, 10)]
    m, v, n = parts[0][1], parts[0][2] ** 2, parts[0][3]
    for _, m2, e2, n2 in parts[1:]:
        v = ((n - 1) * v + (n2 - 1) * e2**2) / (n + n2 - 1) + n * n2 / ((n + n2) * (n + n2 - 1)) * (m - m2) ** 2
        m, n = (m * n + m2 * n2) / (n + n2), n + n2
    got = stats.combined_stderr(spark.createDataFrame(parts, "k string, mean double, stderr double, n long"), [], "k").first()
    assert got["combined_stderr"] == pytest.approx(math.sqrt(v))


def test_bootstrap_is_near_the_standard_error(spark):
    rows = spark.createDataFrame([(k, float(k % 5)) for k in range(400)], "id long, v double")
    one = stats.bootstrap(rows, [], "v", ["id"], 200).first()
    assert one["boot_stderr"] == pytest.approx(stdev(k % 5 for k in range(400)) / 20, rel=0.2) and one["low"] < 2 < one["high"]
    assert stats.bootstrap(rows.repartition(7), [], "v", ["id"], 200).first()["boot_stderr"] == pytest.approx(one["boot_stderr"])


def test_samples(spark):
    df = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("string").alias("g"))
    assert [r[0] for r in sampling.shuffled(df, "doc_id").collect()] == [r[0] for r in sampling.shuffled(df.repartition(5), "doc_id").collect()]
    shots = sampling.fewshot(df, df, 4).collect()
    assert all(len(r["shots"]) == 4 and r["doc_id"] not in {s["doc_id"] for s in r["shots"]} for r in shots)
    opts = spark.createDataFrame([(k, ["w", "x", "y", "z"], "C") for k in range(30)], "id long, o array<string>, a string")
    out = sampling.shuffle_options(opts, "o", "a", "id").collect()
    assert all(sorted(r["o"]) == ["w", "x", "y", "z"] and r["o"][ord(r["a"]) - 65] == "y" for r in out) and len({tuple(r["o"]) for r in out}) > 5
    assert sampling.scaled_targets({"a": 1, "b": 99}, 10) == {"a": 1, "b": 10}


def test_adaptive_weights(spark):
    rng = random.Random(4)
    series = {n: [(rng.random(), rng.random() * 0.2) for _ in range(60)] for n in ("length", "tool")}
    rows = [(n, k, m, s) for n, xs in series.items() for k, (m, s) in enumerate(xs)]
    base, target = {"length": 0.15, "tool": 0.1}, {"length": 0.15, "tool": 0.1}
    got = {(r["reward"], r["step"]): r["weight"] for r in rollouts.adaptive_weights(spark.createDataFrame(rows, "reward string, step long, mean double, std double"), base, target).collect()}
    for step in (2, 10, 59):
        raw = {}
        for n, xs in series.items():
            past = xs[max(0, step - 49) : step + 1]
            if len(past) < 5:
                raw[n] = base[n]
                continue
            ref = 1.0 if n == "tool" else 0.0
            sat = sum(s < 0.02 and abs(m - ref) < 0.05 for m, s in past) / len(past)
            slope = float(np.polyfit(range(len(past)), [m for m, _ in past], 1)[0])
            m, s = past[-1]
            raw[n] = base[n] * max(0.1, min(2, s / target[n])) * (1 - max(0, sat - 0.3) / 0.7) * (1 + max(0, min(1, -slope / (abs(m) + 0.05))))
        for n in raw:
            assert got[n, step] == pytest.approx(raw[n] * sum(base.values()) / sum(raw.values()))


def test_dbscan_and_voxels_match_brute_force(spark):
    rng = random.Random(6)
    pts = [("s", k, rng.random(), rng.random(), 0.0, k % 2) for k in range(150)]
    df = spark.createDataFrame(pts, "scene_id string, point_id long, x double, y double, z double, label int")
    eps, least = 0.08, 4
    near = {p[1]: [q[1] for q in pts if q[5] == p[5] and q[1] != p[1] and math.dist(p[2:4], q[2:4]) <= eps] for p in pts}
    core = {k for k, v in near.items() if len(v) + 1 >= least}
    named = brute_components(core, [(a, b) for a in core for b in near[a] if b in core])
    for k, v in near.items():
        if k not in core and any(b in core for b in v):
            named[k] = min(named[b] for b in v if b in core)
    assert {r["point_id"]: r["cluster"] for r in spatial.dbscan(df, eps, least).collect()} == named
    vox = spatial.voxelize(df, 0.1)
    cells = {(r["label"], r["ix"], r["iy"], r["iz"]) for r in vox.collect()}
    touch = lambda a, b: a[0] == b[0] and sum(abs(x - y) for x, y in zip(a[1:], b[1:])) == 1
    want = Counter(Counter(brute_components(cells, [(a, b) for a in cells for b in cells if touch(a, b)]).values()).values())
    assert Counter(Counter(r["component"] for r in spatial.voxel_components(vox).collect()).values()) == want
    kept = spatial.denoise(vox, 1, 3).count()
    assert kept == sum(size * k for size, k in want.items() if size >= 3)


def test_hull_hierarchy_grid(spark):
    square = [("s", 1, float(x), float(y)) for x in (0, 1, 2) for y in (0, 1)]
    got = spatial.hull_geometry(spark.createDataFrame(square, "scene_id string, cluster long, x double, y double")).first()
    assert (got["hull_area"], got["major"], got["minor"]) == (pytest.approx(2), pytest.approx(2), pytest.approx(1))
    table = ("s", "table", 1, 0.0, 2.0, 0.0, 1.0, 0.0, 0.8)
    cup, shelf = ("s", "cup", 2, 0.5, 0.7, 0.4, 0.6, 0.82, 0.9), ("s", "shelf", 3, 5.0, 6.0, 5.0, 6.0, 0.0, 2.0)
    rows = [(s, lab, k, x0, x1, y0, y1, z0, z1, (x0 + x1) / 2, (y0 + y1) / 2, (x1 - x0) * (y1 - y0)) for s, lab, k, x0, x1, y0, y1, z0, z1 in (table, cup, shelf)]
    inst = spark.createDataFrame(rows, "scene_id string, label string, cluster long, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double, cx double, cy double, area double")
    tree = spatial.hierarchy(inst)
    assert [(r["cluster"], r["parent"], r["relation"]) for r in tree.collect()] == [(2, 1, "On_Top_Of")]
    doc = json.loads(spatial.hierarchy_document(inst, tree).first()["document"])
    assert [d["label"] for d in doc] == ["table", "shelf"] and doc[0]["children"][0]["label"] == "cup"
    bounds = spark.createDataFrame([("s", 0.0, 6.0, 0.0, 6.0)], "scene_id string, x_min double, x_max double, y_min double, y_max double")
    cells = {(r["row"], r["col"]): r["categories"] for r in spatial.grid_map(inst, bounds, 6).collect()}
    assert cells[0, 0] == ["cup", "table"] and cells[5, 5] == ["shelf"] and cells[1, 2] == ["table"]


def test_map_similarity_finds_the_turn(spark):
    gold = [("m", n, x, y) for n, x, y in (("a", 0.0, 0.0), ("b", 2.0, 1.0), ("c", 1.0, 3.0))]
    turned = [(m, n, y, -x) for m, n, x, y in gold]
    schema = "map_id string, name string, x double, y double"
    r = spatial.map_similarity(spark.createDataFrame(turned[:2], schema), spark.createDataFrame(gold, schema)).first()
    assert (r["direction"], r["rotation"], r["coverage"]) == (1.0, 90, pytest.approx(2 / 3))


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "f.txt").write_text("# mask frame\n1 10\n\nbroken\n2 20\n")
    assert [tuple(r) for r in io.read_frame_index(spark, str(tmp_path / "f.txt")).collect()] == [(1, 10), (2, 20)]
    (tmp_path / "r.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert [r["a"] for r in io.read_json_lines(spark, str(tmp_path / "r.jsonl"), "a int").collect()] == [1, 2]
    log = spark.createDataFrame([("t", 1, [["x"]], [["x"]]), ("u", 2, [["y"]], [["z"]])], "task string, doc_id long, resps array<array<string>>, filtered_resps array<array<string>>")
    io.write_samples(log, str(tmp_path / "log"))
    back = {r["task"]: r for r in spark.read.json(str(tmp_path / "log")).collect()}
    assert back["t"]["resps"] is None and back["u"]["resps"] == '[["y"]]' and back["u"]["filtered_resps"] == '[["z"]]'
    for k in range(2):
        io.append_audit(log.select("task", "doc_id"), str(tmp_path / "audit"))
    assert spark.read.json(str(tmp_path / "audit")).count() == 4
    io.write_submission(log, str(tmp_path / "sub"), "doc_id", "task")
    assert set(spark.read.json(str(tmp_path / "sub")).columns) == {"doc_id", "answer"}


def test_cider_over_groups_of_items(spark, monkeypatch):
    """The value does not depend on the groups that n-grams are counted in; they travel packed."""
    rng = random.Random(21)
    line = lambda: rng.choices("a b c d e".split(), k=rng.randint(0, 12))
    rows = [(k, line(), [line() for _ in range(rng.randint(1, 3))]) for k in range(120)] + [(200, None, [["a"]]), (201, ["a"], None), (202, ["a"], []), (203, ["a"], [None, ["a"]])]
    df = spark.createDataFrame(rows, "id long, p array<string>, r array<array<string>>").repartition(3)
    one = {r["id"]: r["cider"] for r in A.cider(df, "id", "p", "r").collect()}
    monkeypatch.setattr(A, "CIDER_TOKENS", 100)
    assert {r["id"]: r["cider"] for r in A.cider(df, "id", "p", "r").collect()} == pytest.approx(one, nan_ok=True)
    assert len(one) == len(rows) and one[200] == 0 and one[201] is None and one[202] is None and one[203] > 0
    given = df.select(F.col("id").alias("_id"), "p", "r", (F.col("id") % 5).alias("_g"))
    assert A._document_frequencies(given, 4, 3).count() <= 15
    assert A.cider(df.limit(0), "id", "p", "r").collect() == []


def test_cider_of_the_next_text(spark, monkeypatch):
    """Texts in runs of ids give what pairs of token arrays give: ids that are missing, null, negative or there twice, texts that are null or blank."""
    rng = random.Random(23)
    words = "a b c D \u00c9t\u00e9 \u4f60\u597d x\u00a0y " + "long" * 20
    line = lambda: "".join(rng.choice(words.split(" ")) + rng.choice([" ", "  ", "\n", "\t\x0b", "\r\n"]) for _ in range(rng.randint(0, 14)))
    rows = [(k, line()) for k in [*range(-70, 100), 130, 131, 131, 132, 132, 1 << 60, (1 << 60) + 1]] + [(140, None), (141, " \n"), (142, "a b"), (None, "a b c"), (None, "b c")]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    tokens = lambda c: F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != "")
    after = df.select((F.col("id") - 1).alias("id"), F.col("text").alias("r"))
    pairs = df.join(after, "id", "left").select("id", tokens("text").alias("p"), F.array(tokens("r")).alias("r"))
    listed = lambda out: sorted(((r["id"] is None, r["id"] or 0, round(r["cider"], 9)) for r in out.collect()))
    want = listed(A.cider(pairs, "id", "p", "r"))
    assert len(want) == len(rows) + 3 and listed(A.cider_of_next(df, "id", "text")) == want
    monkeypatch.setattr(A, "CIDER_TOKENS", 60)
    assert listed(A.cider_of_next(df, "id", "text")) == want
    assert A.cider_of_next(df.limit(0), "id", "text").collect() == []


def test_longer_grams_of_rare_pairs_are_not_moved(spark):
    """A group asks for an n-gram of three words or more only if all its pairs are in two items; packed hashes take few bytes."""
    rows = [(k, [f"w{k}a", "x", "y", "z", f"w{k}b"], [[f"w{k}a", "x", "y", "z", f"w{k}b"]], k % 2) for k in range(40)]
    given = spark.createDataFrame(rows, "_id long, p array<string>, r array<array<string>>, _g long")
    pairs = A._document_frequencies(given, 2, 1)
    longer = A._document_frequencies(given, 4, 1, A._item_lists, pairs)
    assert {r["_g"]: r["many"] for r in pairs.collect()} == {0: 3 + 40 + 2 + 40, 1: 3 + 40 + 2 + 40}
    assert [(r["many"], grams.unpacked_counts(r["counts"], r["many"]).tolist()) for r in longer.collect()] == [(1, [40])] * 2
    hashes = np.unique(np.random.default_rng(3).integers(0, 1 << 63, 50_000, dtype=np.uint64)) * np.uint64(2)
    counts = np.random.default_rng(4).choice([1, 2, 254, 255, 256, 70_000], len(hashes), p=[0.9, 0.06, 0.01, 0.01, 0.01, 0.01])
    for many in (1, 7):
        parts = grams.packed(hashes, counts, many)
        back = grams.unpacked(pa.chunked_array([[h for _, h, _ in parts]]), pa.chunked_array([[c for _, _, c in parts]]))
        assert (back[0] == hashes).all() and (back[1] == counts).all() and sum(len(h) + len(c) for _, h, c in parts) < 7 * len(hashes)


def test_hashes_of_words():
    """Equal words have equal hashes, others not: of any length, with zero bytes, null, in a slice."""
    words = [None, "", "\0", "\0\0", "a", "a\0", "abcdefgh", "abcdefgh\0", "abcdefghi", *("q" * k for k in range(2, 140)), "\u4f60\u597d"]
    own = grams.word_hashes(pa.array(words))
    assert len(set(own.tolist())) == len(words)
    assert grams.word_hashes(pa.array(["x", *words[::-1], "y"])[1:-1]).tolist() == own[::-1].tolist()
    assert len(grams.word_hashes(pa.array([], pa.string()))) == 0 and grams.word_hashes(pa.array(["", None])).tolist() == own[[1, 0]].tolist()


def test_matches_of_packed_grams():
    """Clipped matches are those of bags, whether tokens fit into 64 bits or are numbered again."""
    rng = random.Random(31)
    grams = lambda t, n: Counter(tuple(t[k : k + n]) for k in range(len(t) - n + 1))
    for many in (2, 30, 40_000):
        for _ in range(60):
            x, *refs = ([f"w{rng.randrange(many)}" for _ in range(rng.choice([0, 1, 5, 80, 300]))] for _ in range(rng.randint(1, 4)))
            for a, rs in ((x, refs), ("".join(chr(97 + len(w)) + w + "\U0001f600" * (many == 30) for w in x), ["".join(y) for y in refs])):
                for most in (4, 6):
                    want = []
                    for n in range(1, most + 1):
                        best = Counter()
                        for y in rs:
                            best |= grams(y, n)
                        want.append(sum((grams(a, n) & best).values()))
                    assert A._matches(a, rs, most) == want
    long = [f"w{k}" for k in range(70_000)]
    assert A._matches(long, [long[5:] + ["x"] * 9], 4) == [69_995, 69_994, 69_993, 69_992]
