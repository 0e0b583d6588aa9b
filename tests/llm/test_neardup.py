import random

import corpus_pipeline
from scorewright.llm import neardup
from tests.llm.conftest import ODD, rows_of


def jaccard(a, b):
    def of(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    return len(of(a) & of(b)) / len(of(a) | of(b))


def planted(n, seed):
    """Texts of their own, each followed by an edited copy of similarity 0.8 to 0.95."""
    rng, out = random.Random(seed), []
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    while len(out) < 2 * n:
        words = [word() for _ in range(rng.randint(120, 400))]
        copy = list(words)
        for at in rng.sample(range(len(copy)), rng.randint(1, len(copy) // 45)):
            copy[at] = word()
        a, b = " ".join(words), " ".join(copy)
        if 0.8 <= jaccard(a, b) <= 0.95:
            out += [a, b]
    return out


def test_the_stage_finds_edited_copies(spark, make_docs):
    texts = planted(300, 3)
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, make_docs(texts), "").collect()}
    assert all(2 * k in kept for k in range(300))
    assert sum(2 * k + 1 not in kept for k in range(300)) >= 298


def test_links_are_confirmed(make_docs):
    rng = random.Random(8)
    base = [f"w{k}" for k in range(100)]
    texts = [" ".join(base[: 100 - cut]) for cut in (0, 18, 22)]  # 78 and 74 of 96 shingles: 0.8125 and 0.77 to the first
    texts += [" ".join(rng.sample(base, 60)) for _ in range(5)]
    kept = {r["doc_id"] for r in neardup.keep_one(make_docs([texts[0], texts[2], *texts[3:]])).collect()}
    assert kept == set(range(7))
    assert {r["doc_id"] for r in neardup.keep_one(make_docs(texts[:2])).collect()} == {0}
    assert neardup.alike(set("abcd"), set("abcde")) and not neardup.alike(set("abc"), set("abcd"))


def test_one_large_group_leaves_no_pair(make_docs):
    rng = random.Random(4)
    base = [f"w{k}" for k in range(150)]
    texts = []
    for _ in range(120):
        words = list(base)
        for at in rng.sample(range(150), rng.randint(1, 8)):
            words[at] = f"x{rng.random()}"
        texts.append(" ".join(words))
    docs = make_docs(texts)
    kept = [r["text"] for r in neardup.keep_one(docs).collect()]
    assert kept and all(jaccard(a, b) < 0.8 for k, a in enumerate(kept) for b in kept[:k])


def test_rows_ids_and_odd_texts(make_docs):
    # two texts under one id both stay; of equal ones the smallest id, null ids last
    rows = [(1, "one text of its own"), (1, "quite another text here"), (5, "one Text of its own"), (None, "one text of its own"), (None, "alone without id"), (None, "alone without id"), (7, ""), (6, None), (8, " \n")]
    docs = make_docs([(a, t, *[None] * 6) for a, t in rows])
    got = sorted(((r["doc_id"], r["text"]) for r in neardup.keep_one(docs).collect()), key=str)
    assert got == sorted([(1, rows[0][1]), (1, rows[1][1]), (None, "alone without id"), (6, None)], key=str)
    assert neardup.keep_one(docs).columns == docs.columns
    assert neardup.keep_one(docs.limit(0)).collect() == []
    kept = {r["doc_id"] for r in neardup.keep_one(make_docs(rows_of(ODD))).collect()}
    assert kept == {0, 3, 4, 5, 6, 7, 8, 9}


def test_classes_of_simhash_are_candidates(make_docs, monkeypatch):
    """A copy that shares no minimum hashes is found by its fingerprint; one that is not alike stays."""
    rng = random.Random(17)
    words = [f"w{rng.random()}" for _ in range(2000)]
    near = list(words)
    near[1000] = "other"
    docs = make_docs([" ".join(words), " ".join(near), " ".join(rng.sample(words, 900)), "", None])
    monkeypatch.setattr(neardup, "band_keys", lambda text, width=5: neardup.np.array([hash((text, k)) for k in range(neardup.BANDS)], dtype=neardup.np.int64))
    assert {r["doc_id"] for r in neardup.keep_one(docs).collect()} == {0, 2, 3}
    keys = neardup.simhash_keys(neardup.with_keys(docs, "doc_id", "text", 5).withColumnRenamed("id", "place")).collect()
    assert {r["place"] for r in keys} == {0, 1, 3, 4} and len({r["key"] for r in keys}) == 2
