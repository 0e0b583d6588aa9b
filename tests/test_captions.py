"""Caption objects and hidden spans against plain versions of their rules."""

import difflib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewright.functions import metrics as M
from scorewright.operators import aggregate as A
from scorewright.operators import captions as C

NAMES = [("dog", "dog", "dog"), ("hot dog", "hot dog", "hot dog"), ("puppy", "dog", "dog"), ("toilet seat", "toilet", "toilet"), ("toilet", "toilet", "toilet"), ("seat", "seat", "chair"), ("red fire truck", "truck", "truck"), ("fire", None, None), ("fire truck", "lorry", "truck"), ("baby animal", "animal", None)]


def plain(text, names, unless):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    known = {tuple(p.split()): (w or p, o) for p, w, o in names}
    at, found = 0, []
    while at < len(words):
        for n in (3, 2, 1):
            hit = known.get(tuple(words[at : at + n])) if at + n <= len(words) else None
            if hit:
                found.append(hit)
                at += n
                break
        else:
            at += 1
    has = {w for w, _ in found}
    found = [x for x in found if unless.get(x[0]) not in has]
    return [w for w, _ in found], [o for _, o in found if o is not None]


def test_caption_objects(spark):
    rng = random.Random(3)
    pool = [w for p, _, _ in NAMES for w in p.split()] + ["a", "the", "DOG,", "Fire-truck"]
    texts = [" ".join(rng.choices(pool, k=rng.randint(0, 40))) for _ in range(120)] + [None, "", " . ", "hot hot dog dog", "dog " * 5000, "a toilet and a seat", "two seats, one seat"]
    names = spark.createDataFrame(NAMES + [(None, "x", "y"), (" ", "x", "y")], "phrase string, word string, object string")
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumns({"first": F.lit("x"), "forms": F.lit(1)})
    unless = {"seat": "toilet", "dog": "truck"}
    for rules in ({}, unless):
        got = C.caption_objects(df, "id", "text", names, rules).collect()
        assert len(got) == len(texts)
        for r in got:
            assert (r["words"], r["objects"]) == plain(texts[r["id"]], NAMES, rules), texts[r["id"]]
    none = C.caption_objects(df, "id", "text", names.limit(0)).collect()
    assert len(none) == len(texts) and not any(r["objects"] for r in none)


def test_every_mention_counts(spark):
    rows = [("a", ["cat", "cat", "dog"], ["dog"]), ("b", ["cat"], ["cat", "cat", "dog"]), ("b", [], ["dog"]), ("b", None, None), ("c", [], [])]
    df = spark.createDataFrame(rows, "k string, p array<string>, g array<string>")
    got = {r["k"]: (r["object_rate"], r["caption_rate"], r["recall"]) for r in A.hallucination(df, ["k"], "p", "g").collect()}
    assert got["a"] == (pytest.approx(2 / 3), 1.0, 1.0) and got["b"] == (0.0, 0.0, pytest.approx(1 / 3)) and got["c"] == (None, 0.0, None)


def plain_span(p, h):
    words, gold = p.split(), h.split()
    refused = "I can't" in p or "I cannot" in p or "sorry" in p.lower() or "无法" in p or "抱歉" in p
    best, run = 0.0, []
    for k in range(len(words) - len(gold) + 1 if gold and not refused else 0):
        one = words[k : k + len(gold)]
        if set(one) & set(gold):
            ratio = difflib.SequenceMatcher(None, " ".join(one), h).ratio()
            if ratio > best:
                best, run = ratio, one
    if not run:
        return (0.0, "", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
    a, b = set(run), set(gold)
    precision, recall = len(a & b) / len(a), len(a & b) / len(b)
    bag = sum((Counter(run) & Counter(gold)).values())
    f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0
    return (best, " ".join(run), precision, recall, f1, len(a & b) / len(a | b), bag / len(gold), float(run == gold))


def test_hidden_spans(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abc", k=rng.randint(1, 3)))
    rows = [(" ".join(word() for _ in range(rng.randint(0, 60))), " ".join(word() for _ in range(rng.randint(0, 7)))) for _ in range(250)]
    rows += [("the the the the", "the cat the dog"), ("", ""), ("a b", "a b c"), ("x y z", "a b"), ("I'm Sorry a b", "a b"), ("a I cannot b", "b"), ("a  b\tc", "b  c"), (None, "a"), ("a", None), ("抱歉 a", "a")]
    long = [word() for _ in range(400)]
    rows += [(" ".join(long), " ".join(long[100:190])), (" ".join(long), " ".join(w[::-1] for w in long[50:120]))]
    df = spark.createDataFrame(rows, "p string, h string")
    got = df.select(M.hidden_span("p", "h").alias("s")).select("s.*").collect()
    for (p, h), r in zip(rows, got, strict=True):
        assert tuple(r) == ((None,) * 8 if p is None or h is None else pytest.approx(plain_span(p, h))), (p, h)
    the = got[250]
    assert (the["precision"], round(the["recall"], 3)) == (1.0, 0.333)


def test_whole_texts(spark):
    rng = random.Random(4)
    pairs = [("".join(rng.choices("ab é", k=rng.randint(0, 90))), "".join(rng.choices("ab é", k=rng.randint(0, 90)))) for _ in range(80)] + [("", ""), (None, "a"), ("a", None)]
    df = spark.createDataFrame(pairs, "a string, b string")
    same = lambda wide: df.select(M.edit_distance("a", "b", wide), M.edit_similarity("a", "b", wide), M.near_match("a", "b", 0.4, wide), M.anls("a", [F.col("b"), F.lit("ab")] if wide else F.array("b", F.lit("ab")), 0.2, wide)).collect()
    assert [tuple(r) for r in same(True)] == [tuple(r) for r in same(False)]


def test_spans_take_few_comparisons():
    """Blocks are difflib's, and a run is left as soon as it cannot reach the best."""
    rng = random.Random(12)
    codes = lambda t: np.frombuffer(t.encode("utf-32-le"), "<u4")
    counts = lambda t, kinds: np.array([[t[:k].count(c) for c in kinds] for k in range(len(t) + 1)])
    for _ in range(300):
        a, b = ("".join(rng.choices("ab c", k=rng.randint(1, 60))) for _ in range(2))
        want = sum(x.size for x in difflib.SequenceMatcher(None, a, b).get_matching_blocks())
        args = (M._runs_table(codes(a), codes(b)), counts(a, set(b)), counts(b, set(b)))
        asked = []
        assert M._blocks(*args, lambda most: bool(asked.append(most))) == want  # noqa: B023
        assert all(x >= y for x, y in zip(asked, asked[1:])) and asked[-1] == want
        assert M._blocks(*args, lambda most: True) is None
    whole, text = M.SPAN_CELLS, " ".join(rng.choices(["ab", "c", "abc", "b"], k=300))
    found = M._span(text, "c ab b abc c")
    try:
        M.SPAN_CELLS = 0
        assert M._span(text, "c ab b abc c") == found
    finally:
        M.SPAN_CELLS = whole


def test_distances_of_many_pairs(monkeypatch):
    """Pairs of any lengths stepped together have the distances of the plain table."""

    def plain_distance(a, b):
        row = list(range(len(b) + 1))
        for x in a:
            last, row = row, [row[0] + 1]
            for k, y in enumerate(b):
                row.append(min(last[k] + (x != y), last[k + 1] + 1, row[k] + 1))
        return row[-1]

    rng = random.Random(15)
    sizes = [0, 1, 2, 63, 64, 65, 127, 128, 129, 200]
    text = lambda: "".join(rng.choices("ab\U0001f600c", k=rng.choice(sizes)))
    pairs = [(text(), text()) for _ in range(150)] + [(text() * 2, "x" * rng.choice(sizes)) for _ in range(20)]
    pairs += [(a, a[:50] + "z" + a[51:]) for a, _ in pairs[:20]] + [(list(a), list(b)) for a, b in pairs[:40]]
    want = [plain_distance(a, b) for a, b in pairs]
    assert M._edits_many(pairs) == want and M._edits_many([]) == []
    for lanes, places in ((2, M.PLACES), (M.LANES, 300)):
        monkeypatch.setattr(M, "LANES", lanes)
        monkeypatch.setattr(M, "PLACES", places)
        assert M._edits_many(pairs) == want


def test_spans_of_many_texts_are_stepped_together(monkeypatch):
    """Runs of words of many texts are held against their hidden texts in one batch, with difflib's blocks; so are pieces of it."""
    rng = random.Random(14)
    pairs = []
    for letters in ("ab", "abc\u00e9", "etaoin shr", "\U0001f600\u4f60a\ud800"):
        word = lambda: "".join(rng.choices(letters.replace(" ", ""), k=rng.choice([1, 1, 2, 3, 5, 9])))  # noqa: B023, E731
        for _ in range(40):
            words = [word() for _ in range(rng.randint(0, 70))]
            gold = words[(k := rng.randint(0, 60)) : k + rng.randint(1, 12)] if rng.random() < 0.5 else [word() for _ in range(rng.randint(0, 12))]
            pairs.append((" ".join(words), rng.choice([" ", "  "]).join(w if rng.random() < 0.8 else word() for w in gold)))
    pairs += [("a" * 50, "a"), ("a " * 90, "a " * 20), ("ab " * 60, "ba " * 30), ("x" * 3000 + " y", "x y"), ("a b", ""), ("", "a"), ("a", "a"), ("", "")]
    pairs += [(" ".join(["ab", "ba", "abba"] * 60), " ".join(["abba", "b", "ab"] * 25))]

    def want(p, h):
        words, gold = p.split(), h.split()
        best, run = 0.0, []
        for k in range(len(words) - len(gold) + 1 if gold else 0):
            one = words[k : k + len(gold)]
            if set(one) & set(gold) and (ratio := difflib.SequenceMatcher(None, " ".join(one), h).ratio()) > best:
                best, run = ratio, one
        return best, run

    for letters in ("abcde", "etaoinshrdlcumwfgypbvkjxqz", "a" * 20 + "bcdefghijklmnopqrstuvw"):
        words = ["".join(rng.choices(letters, k=rng.randint(1, 8))) for _ in range(90)]
        pairs += [(" ".join(words), " ".join(w if rng.random() < 0.6 else w[::-1] for w in words[k : k + n])) for k, n in ((3, 50), (20, 55), (0, 70))]
    assert sum(len(h) >= M.JUNK_FROM for _, h in pairs) > 7
    calls, plain = [], M._matched
    monkeypatch.setattr(M, "_matched", lambda batch, junk: calls.append(len(batch)) or plain(batch, junk))
    all_of_them = [want(*x) for x in pairs]
    assert M._spans(pairs) == all_of_them and len(calls) == 2 and calls[0] > 50
    for name, value in (("SPAN_LETTERS", 300), ("SPAN_CELLS", 0), ("LONG_FROM", 5)):
        monkeypatch.setattr(M, name, value)
        assert M._spans(pairs) == all_of_them
    assert len(calls) > 100
