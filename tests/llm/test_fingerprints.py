import hashlib
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from scorewright.llm import fingerprints as fp
from tests.llm.conftest import ODD, rows_of


def long_hash(value, seed):
    """XXH64 of a long, as the engine hashes columns one after the other."""
    return xxhash.xxh64_intdigest(struct.pack("<Q", value), seed)


def brute(text, width=5):
    words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.split(r"[ \t\n\x0b\f\r]+", (text or "").lower()) if w]
    if not words:
        return set()
    out = set()
    for k in range(max(1, len(words) - width + 1)):
        h = 42
        for w in words[k : k + width]:
            h = long_hash(w, h)
        out.add(h - (1 << 64) if h >> 63 else h)
    return out


def low(hashes, size=fp.SIZE):
    return sorted(hashes)[:size]


@pytest.mark.parametrize("rows", [4, 10_000])
def test_matches_brute_force(spark, make_docs, prose, monkeypatch, rows):
    monkeypatch.setattr(fp, "BUCKET_ROWS", rows)
    texts = [prose(5 + 13 * k % 400, k) for k in range(40)] + [t for t in ODD if t is None or "\x00" not in t and " " not in t]
    ids = [3 * k - 20 for k in range(len(texts))]
    docs = make_docs([(i, t, *[None] * 6) for i, t in zip(ids, texts, strict=True)]).repartition(5)
    got = {r["doc_id"]: r for r in fp.edited_pairs(docs).collect()}
    assert len(got) == len(texts)
    for k, i in enumerate(ids):
        text, after = texts[k] or "", texts[(k + 1) % len(texts)] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        r, a, b, c = got[i], brute(text), brute(edited), brute(after)
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == ",".join(map(str, low(a)))
        assert r["edited_fingerprint"] == ",".join(map(str, low(b)))
        for near, other in (("near_edited", b), ("near_next", c)):
            union = low(set(low(a)) | set(low(other)))
            both = set(union) & set(low(a)) & set(low(other))
            assert r[near] == pytest.approx(len(both) / len(union) if union else 1.0)
            true = len(a & other) / len(a | other) if a | other else 1.0
            assert abs(r[near] - true) < 0.2
        assert r["n_shingles"] == pytest.approx(len(a), rel=0.4)


def test_order_of_repeated_and_null_ids(make_docs, monkeypatch):
    monkeypatch.setattr(fp, "BUCKET_ROWS", 1)
    docs = make_docs(rows_of(["a a", "b b", "c c"]) + rows_of(["a z"]) + [(None, "n1", *[None] * 6), (None, "n2", *[None] * 6)])
    rows = fp.with_next(docs.select(F.col("doc_id").alias("id"), "text"), ["text"]).collect()
    assert sorted((str(r["id"]), r["text"], r["next_text"]) for r in rows) == [
        ("0", "a a", "a z"), ("0", "a z", "b b"), ("1", "b b", "c c"), ("2", "c c", "a a"), ("None", "n1", "n2"), ("None", "n2", None),
    ]
    assert fp.edited_pairs(docs.limit(0)).collect() == []
    assert fp.edited_pairs(docs.where("doc_id is null")).count() == 2


def test_merge_and_containment(spark, prose):
    a, b = prose(300, 1), prose(300, 2)
    rows = [("k", a), ("k", b), ("k", a), ("j", ""), ("j", None), (None, a)]
    parts = fp.with_sketch(spark.createDataFrame(rows, "key string, text string"), F.col("text"), "s")
    merged = {r["key"]: r["sketch"] for r in fp.merge_sketches(parts, "key", "s").collect()}
    assert merged == {"k": low(brute(a) | brute(b)), "j": [], None: low(brute(a))}
    two = spark.createDataFrame([(low(brute(a)), low(brute(a) | brute(b)))], "a array<long>, b array<long>")
    inside, outside = two.select(fp.containment(F.col("a"), F.col("b")), fp.containment(F.col("b"), F.col("a"))).first()
    assert inside == 1.0 and abs(outside - 0.5) < 0.15


@pytest.mark.parametrize(("key", "sketch"), [("rank", "n"), ("h", "k"), ("a.b", "s"), ("low", "m"), ("x`y", "rank")])
def test_merging_under_any_names(spark, key, sketch):
    rows = [(1, [3, 9], "x"), (1, [5, 7], "y"), (2, [9], "z"), (3, [], "z"), (3, None, "z"), (None, [4], "z"), (None, [4, 1], "z"), (1, [3, 9], "x")]
    df = spark.createDataFrame(rows, "a int, b array<bigint>, h2 string").toDF(key, sketch, "rank2")
    merged = fp.merge_sketches(df, key, sketch, 3)
    assert merged.columns == [key, "sketch"]
    assert {r[0]: r[1] for r in merged.collect()} == {1: [3, 5, 7], 2: [9], 3: [], None: [1, 4]}
    assert fp.merge_sketches(df.limit(0), key, sketch).collect() == []


def test_shares_and_counts_of_the_edited_text(spark):
    texts = [" ".join(f"w{k}" for k in range(60)), " ".join(f"v{k}" for k in range(60)), "", None]
    rows = {r["doc_id"]: r for r in fp.edited_pairs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}

    def shingles(text):
        w = (text or "").split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}

    for k, text in enumerate(texts):
        n = len(text or "") // 4
        edited = (text or "")[: len(text or "") - n] + (texts[(k + 1) % 4] or "")[:n]
        a, b = shingles(text), shingles(edited)
        assert rows[k]["edited_kept"] == pytest.approx(len(a & b) / len(a) if a else 1.0) and rows[k]["n_together"] == len(a | b)
