"""Values of operators that have no SQL, and cases just beyond limits that once were."""

import difflib
import json
import math
import random
import re
from collections import Counter
from statistics import stdev

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewright.functions import extract as E
from scorewright.functions import metrics as M
from scorewright.functions import trajectory as T
from scorewright.operators import aggregate as A
from scorewright.operators import requests as R
from scorewright.operators import sampling, spatial, stats
from scorewright.plans import text
from scorewright.sources import io


def table_distance(a, b, swaps=False):
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            best = min(one[j] + 1, now[-1] + 1, one[j - 1] + (x != y))
            if swaps and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two[j - 2] + 1)
            now.append(best)
        two, one = one, now
    return one[-1]


def longest_common(x, y):
    row = [0] * (len(y) + 1)
    for u in x:
        last = 0
        for j, v in enumerate(y, 1):
            last, row[j] = row[j], last + 1 if u == v else max(row[j], row[j - 1])
    return row[-1]


def test_distances_and_common_sequences():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 80))) for _ in range(2))
        assert M._edits(a, b) == table_distance(a, b) and M._edits(a, b, swaps=True) == table_distance(a, b, True)
        assert M._common(list(a), list(b)) == longest_common(a, b)


def test_token_distance_of_many_distinct_tokens(spark):
    a = [f"t{k}" for k in range(25_000)]
    b = [t for k, t in enumerate(a) if k % 5000] + ["new", "words"]
    rows = spark.createDataFrame([(a, b), (b, b), ([], a), (None, a)], "a array<string>, b array<string>")
    got = [r[0] for r in rows.select(M.token_edit("a", "b")).collect()]
    assert got == [7, 0, 25_000, None]
    rate = A.error_rate(rows.where("a is not null").select(M.token_edit("a", "b").alias("d"), F.size("b").alias("n")), [], "d", "n").first()[0]
    assert rate == pytest.approx((7 + 25_000) / (2 * len(b) + 25_000))


def test_bags_with_numbers(spark):
    rng = random.Random(2)
    rows = [(rng.choices("abcde", k=rng.randint(0, 30)), rng.choices("abcde", k=rng.randint(0, 30))) for _ in range(60)]
    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select(M.token_overlap(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [sum((Counter(a) & Counter(b)).values()) for a, b in rows]


def consensus_form(text):
    """The form in plain Python: marks beside a space go, others become spaces."""
    text = text.lower().replace(",", "").replace("?", "").replace("'s", " 's").strip().replace("\n", " ").replace("\t", " ").strip()
    marks = [m for m in E.MARKS]
    near = {m: m + " " in text or " " + m in text for m in marks}
    for m in marks:
        text = text.replace(m, "" if near[m] else " ")
    out, left = [], E.STOPS
    for k, c in enumerate(text):
        if c == "." and left and not text[k + 1 : k + 2].isdigit():
            left -= 1
        else:
            out.append(c)
    words = [E.NUMBER_WORDS.get(w, w) for w in "".join(out).split()]
    return " ".join(E.CONTRACTIONS.get(w, w) for w in words if w not in E.ARTICLES)


def test_consensus_form(spark):
    rng = random.Random(3)
    bits = ["It", "is", "5.", "a", "The", "two", "dont", "wouldnt've", "mightnt", "dog's", "x-y", "- z", "(a)", "b/c", "1,000", "3.5", "e.g.", "...", "what?", "\t", "\n", "im", "somethingd", "Ünten"]
    texts = ["It is 5.", "x-ray - y", "let's go", "The two dogs' 1,000 a.b", ". " * 40 + "x.y"] + ["".join(rng.choice(bits) + rng.choice([" ", "", "  "]) for _ in range(rng.randint(1, 12))) for _ in range(200)]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", E.vqa_form("t").alias("v")).collect()
    assert {r["k"]: r["v"] for r in got} == {k: consensus_form(t) for k, t in enumerate(texts)}
    assert consensus_form("It is 5.") == "it is 5" and consensus_form("mightnt somethingd") == "mightn't something'd"


def test_stability_counts_every_repeat(spark):
    rows = spark.createDataFrame([("q", 1), ("q", 1), ("q", 1), ("r", 0)], "doc string, ok int")
    got = A.stability(rows, [], "doc", "ok").first()
    assert (got["expected_acc"], got["consensus_acc"], got["internal_variance"], got["consistency"]) == (0.75, 0.5, 0.0, 1.0)


def test_group_trees_of_any_depth(spark):
    edges = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(12)] + [("n3", "x"), ("n3", "x")], "parent string, child string")
    want = {(f"n{k}", "n12") for k in range(12)} | {(f"n{k}", "x") for k in range(4)}
    assert sorted(map(tuple, A.flatten_groups(edges).collect())) == sorted(want)
    assert A.flatten_groups(edges.limit(0)).collect() == []
    with pytest.raises(ValueError, match="contains itself"):
        A.flatten_groups(spark.createDataFrame([("r", "a"), ("a", "b"), ("b", "a")], "parent string, child string"))


def test_shots_come_from_the_whole_pool(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 7).alias("g"))
    shots = {r["doc_id"]: [s["doc_id"] for s in r["shots"]] for r in sampling.fewshot(docs, docs, 4).collect()}
    assert len(shots) == 3000 and all(len(set(s)) == 4 and d not in s for d, s in shots.items())
    drawn = Counter(x for s in shots.values() for x in s)
    assert sum(x >= 1000 for x in drawn) > 1900  # most rows beyond the first thousand are drawn
    assert abs(sum(n for x, n in drawn.items() if x < 1500) / 12_000 - 0.5) < 0.03
    again = {r["doc_id"]: [s["doc_id"] for s in r["shots"]] for r in sampling.fewshot(docs.repartition(7), docs.repartition(3), 4).collect()}
    assert again == shots
    few = sampling.fewshot(docs.limit(3), docs.orderBy("doc_id").limit(3), 5).collect()
    assert all(sorted(s["doc_id"] for s in r["shots"]) == sorted({0, 1, 2} - {r["doc_id"]}) for r in few)
    assert all(r["shots"] == [] for r in sampling.fewshot(docs.limit(3), docs.limit(0), 5).collect())
    first = sampling.fewshot(docs, docs, 3, mode="first").collect()
    assert all([s["doc_id"] for s in r["shots"]] == [x for x in range(4) if x != r["doc_id"]][:3] for r in first)


def test_numbered_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(sampling, "RANKED", 50)
    rows = spark.range(0, 3000, 3).repartition(5)
    assert sorted((r["id"], r["rn"]) for r in sampling.numbered(rows, "id").collect()) == [(3 * k, k) for k in range(1000)]


@pytest.mark.parametrize("few", [10**6, 40, 1])
def test_ranks_by_cells(spark, monkeypatch, few):
    monkeypatch.setattr(A, "SORTED", few)
    monkeypatch.setattr(A, "CELLS", 16)
    rng = random.Random(5)
    rows = [(g, rng.random() * 10 ** rng.randint(-3, 6) if g != "c" else float(rng.randint(0, 2))) for g in ("a", "b", "c", None) for _ in range(rng.randint(1, 600))] + [("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    want = {}
    for g, v in rows:
        if v is not None:
            want.setdefault(g, []).append(v)
    assert {r["g"]: r["v"] for r in A.upper_median(df, ["g"], "v").collect()} == {g: sorted(x)[len(x) // 2] for g, x in want.items()}
    health = {r["g"]: r["p95"] for r in A.request_health(df, ["g"], "v", F.lit(False), F.lit(False)).collect()}
    assert health == {g: sorted(x)[int(0.95 * (len(x) - 1))] for g, x in want.items()} | {"none": None}
    every = sorted(v for x in want.values() for v in x)
    assert A.upper_median(df, [], "v").first()["v"] == every[len(every) // 2]


def test_ratings_are_of_greatest_likelihood(spark):
    rng = random.Random(6)
    power = {f"m{k}": rng.random() * 2 for k in range(6)}
    rows = []
    for _ in range(600):
        x, y = rng.sample(sorted(power), 2)
        rows.append((x, y, "tie" if rng.random() < 0.1 else "A" if rng.random() < 1 / (1 + math.exp(power[y] - power[x])) else "B"))
    rows += [("best", "m0", "A"), ("m1", "worst", "A")]
    got = {r["model"]: r["rating"] for r in A.elo(spark.createDataFrame(rows, "model_a string, model_b string, winner string"), "m0").collect()}
    assert got["m0"] == pytest.approx(1000) and got["best"] is None and got["worst"] is None
    for m in power:  # expected wins are the wins, which makes the likelihood greatest
        won = expected = 0.0
        for a, b, w in rows:
            if m in (a, b) and got[a] is not None and got[b] is not None:
                won += 0.5 if w == "tie" else (w == "A") == (a == m)
                expected += 1 / (1 + 10 ** ((got[b if a == m else a] - got[m]) / 400))
        assert won == pytest.approx(expected, abs=1e-5)


def test_length_penalty_falls_back(spark):
    rows = [(None, None, "x" * 100), ([1, 1, 0, 1], [5] * 9, "x"), (None, [5] * 9, "x"), ([], None, "x" * 99)]
    df = spark.createDataFrame(rows, "mask array<int>, ids array<int>, t string")
    got = [r[0] for r in df.select(T.length_penalty("t", "mask", 2, 10, 8, ids="ids")).collect()]
    assert got == [-1.0, -1 / 8, -7 / 8, 0.0]
    turns = spark.createDataFrame([([[1, 0], [1, 1]], None), (None, [[1, 2, 3], [4]]), (None, None)], "mask array<array<int>>, ids array<array<int>>")
    got = [r[0] for r in turns.select(T.length_penalty(F.lit("xx"), "mask", 2, 10, 8, ids="ids", by_turn=True)).collect()]
    assert got == [-1 / 8, -2 / 8, 0.0]


def test_total_reward(spark):
    row = spark.createDataFrame([(0.5, 1.0, -0.25, -1.0)], "s double, a double, t double, l double")
    assert row.select(T.total_reward("s", "a", "t", "l")).first()[0] == pytest.approx(0.15 * 0.5 + 0.6 - 0.1 * 0.25 - 0.15)


def test_training_rows_and_categories(spark):
    raw = spark.createDataFrame([("<image>\nwhere?", "B", "pick", "among_1"), ("how many?", "3", "count", "aroundnew_2"), ("x", "y", "odd", "rotation_3")], "question string, answer string, question_type string, val_id string")
    rows = R.training_messages(raw, choice=("pick",), number=("count",), keep=("val_id",)).collect()
    assert [(r["messages"][0]["role"], r["messages"][0]["content"], r["solution"], r["answer_type"], r["val_id"]) for r in rows] == [("user", "<video>\nwhere?", "B", "mca", "among_1"), ("user", "<video>\nhow many?", "3", "na", "aroundnew_2")]
    assert [r[0] for r in raw.select(R.category_of(F.col("val_id"))).collect()] == ["among", "around", "rotation"]


def test_bootstrap_of_a_median(spark):
    rng = random.Random(8)
    values = [rng.gauss(10, 2) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(values)), "id long, v double")
    copies = stats.bootstrap_aggregate(rows, [], ["id"], lambda df, by: A.upper_median(df, by, "v"), "v", 60).first()
    weights = stats.bootstrap_aggregate(rows, [], ["id"], lambda df, by: A.weighted_median(df, by, "v", "weight"), "v", 60, weighted=True).first()
    assert tuple(copies) == pytest.approx(tuple(weights))
    draws = []
    for _ in range(300):
        draws.append(sorted(rng.choices(values, k=400))[200])
    assert weights["boot_stderr"] == pytest.approx(stdev(draws), rel=0.35) and weights["low"] < sorted(values)[200] < weights["high"]


def test_alignments(spark):
    rng = random.Random(9)
    rows = [(" ".join(rng.choices("abcdef", k=rng.randint(1, 25))), " ".join(rng.choices("abcdef", k=rng.randint(1, 8)))) for _ in range(60)]
    df = spark.createDataFrame(rows, "p string, h string")
    got = df.select(M.damerau_similarity("p", "h").alias("d"), M.ratcliff_similarity("p", "h").alias("r"), M.lcs_f(F.split("p", " "), F.split("h", " ")).alias("l")).collect()
    for (p, h), r in zip(rows, got, strict=True):
        a, b = p.split(), h.split()
        assert r["d"] == pytest.approx(1 - table_distance(p, h, True) / max(len(p), len(h)))
        assert r["r"] == pytest.approx(difflib.SequenceMatcher(None, p, h, autojunk=False).ratio())
        m = longest_common(a, b)
        want = 0.0 if not m else (1 + 1.44) * (m / len(a)) * (m / len(b)) / (m / len(b) + 1.44 * m / len(a))
        assert r["l"] == pytest.approx(want)


def test_merging_and_hulls(spark):
    rng = np.random.default_rng(4)
    rows = [("s", "chair", c, float(x), float(y), 0.0) for c, (cx, cy) in enumerate([(0, 0), (1.2, 0), (9, 9)]) for x, y in rng.normal((cx, cy), 0.3, (60, 2))]
    points = spark.createDataFrame(rows, "scene_id string, label string, cluster long, x double, y double, z double")
    merged = spatial.merge_near(points, 0.5)
    assert {r["cluster"] for r in merged.where("x < 5").select("cluster").collect()} == {0} and {r["cluster"] for r in merged.where("x > 5").select("cluster").collect()} == {2}
    got = {r["cluster"]: r for r in spatial.hull_geometry(points.repartition(9)).collect()}
    for c in range(3):
        xy = np.array([r[3:5] for r in rows if r[2] == c])
        corners = [p for p in xy if _is_corner(p, xy)]
        centre = np.mean(corners, axis=0)
        corners.sort(key=lambda p: math.atan2(*(p - centre)))
        h = np.array(corners)
        n = np.roll(h, -1, axis=0)
        assert got[c]["hull_area"] == pytest.approx(abs((h[:, 0] * n[:, 1] - n[:, 0] * h[:, 1]).sum()) / 2)


def _is_corner(p, xy):
    """A corner has all other points within half a turn of it."""
    turns = np.sort(np.arctan2(*(xy[(xy != p).any(axis=1)] - p).T[::-1]))
    return np.diff(np.append(turns, turns[0] + 2 * np.pi)).max() > np.pi


def test_contamination_with_and_without_a_filter(spark, monkeypatch):
    rng = random.Random(10)
    words = [f"w{k}" for k in range(60)]
    docs = [(k, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for k in range(80)] + [(80, None), (81, "")]
    asked = [(k, " ".join(docs[k][1].split()[3:20])) for k in range(30)] + [(30, None), (31, "too short")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "item_id long, text string")
    grams = lambda t: {tuple(w[k : k + 8]) for w in [(t or "").split()] for k in range(len(w) - 7)}
    want = sorted((a, b, len(grams(t) & grams(u)), len(grams(t) & grams(u)) / len(grams(u))) for a, t in docs for b, u in asked if grams(t) & grams(u))
    for bits in (24, 7):  # seven bits let nearly everything pass
        monkeypatch.setattr(R, "FILTER_BITS", bits)
        assert sorted(map(tuple, R.contamination(d, q).collect())) == want


def test_readers(spark, tmp_path):
    rows = [("k1", "generate_until", "t", 1, 0, "{}", "yes", 1.5), ("k2", "generate_until", "t", 2, 0, None, "", 2.5)]
    cache = spark.createDataFrame(rows, io.RESPONSE_CACHE)
    cache.write.parquet(str(tmp_path / "cache"))
    assert sorted(map(tuple, io.read_cache(spark, str(tmp_path / "cache")).collect())) == sorted(rows)
    eye = [1.0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1]
    frame = [("s", "f0", 1, 2, [2.0, 50.0], [1.0, 1.0], [3, 4], [1.0, 0, 0, 0, 1, 0, 0, 0, 1], [float(x) for x in eye])]
    schema = "scene_id string, frame string, h int, w int, depth array<float>, conf array<float>, mask array<int>, k array<double>, c2w array<double>"
    spark.createDataFrame([tuple([float(v) for v in x] if isinstance(x, list) and k in (7, 8) else x for k, x in enumerate(f)) for f in frame], schema).write.parquet(str(tmp_path / "frames"))
    got = spatial.back_project(io.read_frames(spark, str(tmp_path / "frames"))).collect()
    assert [(r["scene_id"], r["pixel"], r["x"], r["y"], r["z"], r["label"]) for r in got] == [("s", 0, 0.0, 0.0, 2.0, 3)]
    small = io.read_spread(spark, str(tmp_path / "cache"))
    assert small.count() == 2 and small.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert json.loads(spark.createDataFrame([(1,)], "a int").select(E.stringified(F.struct("a"))).first()[0]) == {"a": 1}


def test_swaps_of_many_pairs_are_stepped_together(spark):
    rng = random.Random(12)
    turned = lambda t: "".join(t[k : k + 2][:: rng.choice((1, -1))] for k in range(rng.randint(0, 1), len(t), 2))
    texts = ["".join(rng.choices("abcé", k=n)) for n in (0, 1, 2, 63, 64, 65, 127, 128, 129, 200, 700) for _ in range(4)]
    pairs = [(t, turned(t)) for t in texts] + list(zip(texts, reversed(texts), strict=True)) + [(list("abc"), ["b", "a", "x"])]
    assert M._edits_many(pairs, swaps=True) == [table_distance(a, b, True) for a, b in pairs]
    df = spark.createDataFrame([*pairs[:-1], (None, "a"), ("a", None)], "p string, h string").repartition(3)
    for r in df.select("p", "h", M.damerau_similarity("p", "h").alias("d")).collect():
        want = None if r["p"] is None or r["h"] is None else 1 - table_distance(r["p"], r["h"], True) / max(len(r["p"]), len(r["h"]), 1)
        assert r["d"] == (want if want is None else pytest.approx(want))


def test_bags_are_counted_in_batches(spark):
    rng = random.Random(13)
    bag = lambda: rng.choices(["a", "b", "the", "x y", ""], k=rng.randint(0, 12))
    rows = [(k, bag(), bag()) for k in range(200)] + [(200, None, ["a"]), (201, ["a"], None), (202, [None, "a", None], [None, None, "a", "a"]), (203, [], [])]
    df = spark.createDataFrame(rows, "id int, a array<string>, b array<string>").repartition(5)
    out = df.select("id", M.token_overlap(F.col("a"), F.col("b")).alias("n"))
    assert "sort_array" not in out._jdf.queryExecution().toString()
    got = {r["id"]: r["n"] for r in out.collect()}
    assert got[200] is None and got[201] is None and got[202] == 2  # nulls count once
    assert all(got[k] == sum((Counter(a) & Counter(b)).values()) for k, a, b in rows[:200])


def test_texts_are_cut_and_turned_once(spark):
    rows = spark.createDataFrame([("I say (B) or C.", ["x", "say"]), ("so it is the word apple in the end", ["pear", "Apple"]), (None, ["a", "b"])], "resp string, words array<string>")
    out = rows.select(E.choice_letter("resp", "words").alias("letter"), E.unique_option("resp", "words").alias("unique"))
    assert [tuple(r) for r in out.collect()] == [("B", "B"), ("B", "B"), (None, None)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 2 and plan.count("lower(resp") <= 1


def test_contractions_are_known_by_hash(spark):
    out = spark.createDataFrame([("Dont eat none of THE two apples youve got",)], "t string").select(E.vqa_form("t").alias("form"))
    assert out.first()[0] == "don't eat 0 of 2 apples you've got"
    assert out._jdf.queryExecution().optimizedPlan().toString().count("INSET") >= 2


def test_words_of_texts_go_to_the_distances_as_texts(spark, tmp_path):
    """Arrays of all words were split in expressions and sent over, which cost more than the distances."""
    rng = random.Random(18)
    made = lambda n: "".join(rng.choices(["Ab", "cd ", "é", "\n", "KK", "İ", "x-", "9", "ß", "Σ ", "\U0001f600", "the "], k=n))
    texts = [None, "", "  ", "One two", "one TWO three", *(made(n) for n in (1, 5, 30, 63, 64, 65, 200, 400) for _ in range(3))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'en' lang").write.parquet(str(tmp_path / "documents.parquet"))
    got = text.met_words(spark, str(tmp_path))
    words = [re.findall("[a-z]+", (t or "").lower()) for t in texts] + [[]]
    want = {}
    for k, (a, b) in enumerate(zip(words, words[1:], strict=False)):
        d = table_distance(a, b)
        want[k] = (d, len(b), pytest.approx(d / max(len(a), len(b), 1), abs=1e-6))
    assert {r["doc_id"]: (r["distance"], r["ref_len"], r["mixed"]) for r in got.collect()} == want
    rate = text.agg_error_rate(spark, str(tmp_path)).first()["error_rate"]
    assert rate == pytest.approx(sum(d for d, _, _ in want.values()) / sum(n for _, n, _ in want.values()), abs=1e-6)
    assert "split(" not in got._jdf.queryExecution().executedPlan().toString()
    pair = spark.createDataFrame([(None, "a"), ("a", None), ("a b", "b")], "p string, r string")
    found = [tuple(r[0]) if r[0] else None for r in pair.select(M.word_edit("p", "r")).collect()]
    assert found == [(None, None, None), (None, None, None), (1, 2, 1)]


def test_distances_of_long_lists_with_few_common_tokens():
    rng = random.Random(19)
    for n, m in ((1, 300), (29, 31), (30, 200), (60, 61), (150, 149), (300, 2)):
        a, b = ([rng.choice(letters) for _ in range(k)] for k, letters in ((n, "abcdefgh"), (m, "ghijklmnopa")))
        for x, y in ((a, b), (b, a), (a, a[::-1])):
            assert M._edits(x, y) == table_distance(x, y) and M._edits(x, y, swaps=True) == table_distance(x, y, True)
