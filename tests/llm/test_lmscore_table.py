from collections import Counter

from pyspark.sql import functions as F

from scorewright.llm import lmscore
from tests.llm.test_lmscore import brute, split


def test_count_table_is_exact(make_docs, prose):
    texts = [prose(30 + k, k % 9) for k in range(30)] + [None, "", "one two three one two three"]
    table = lmscore.count_table(make_docs(texts), ranges=5, batch_words=200)
    words = [split(t) for t in texts]
    for n in (1, 2, 3):
        want = Counter(tuple(w[k : k + n]) for w in words for k in range(len(w) - n + 1))
        got = [r["count"] for r in table.where(F.col("n") == n).collect()]
        assert sorted(got) == sorted(want.values())
    assert table.select("n", "hash").distinct().count() == table.count()
    assert lmscore.count_table(make_docs(texts).limit(0)).collect() == []


def test_ranges_follow_the_corpus(make_docs, prose, monkeypatch):
    texts = [prose(200, k) for k in range(40)]
    sizes = {}
    monkeypatch.setattr(lmscore, "LEAST_REQUEST", 0)  # texts this small would have small requests
    for share in (1, 4):
        monkeypatch.setattr(lmscore, "RANGE_BYTES", sum(map(len, texts)) // 8)
        docs = make_docs(texts * share)
        parts = lmscore._layout(*lmscore._corpus(docs, "text"), None, None)[1]
        asked = lmscore._by_range(lmscore._requests(lmscore.numbered(docs, "doc_id", "text", 10**7), 3, parts), parts, 3)
        sizes[share] = (parts, asked.rdd.getNumPartitions())
    assert sizes[4][0] >= 4 * sizes[1][0] - 4 and sizes[4][1] == 3 * sizes[4][0]


def test_words_of_a_text_that_occurs_twice_are_all_full(make_docs, prose):
    texts = [prose(50, 1), prose(50, 1), prose(40, 2), "one", "one", "one two", "one two"]
    rows = {r["doc_id"]: r for r in lmscore.score_documents(make_docs(texts)).collect()}
    want = brute(texts, 3)
    for k, r in rows.items():
        assert r["n_seen"] == want[k][1]
        assert r["n_full"] == r["n_words"] or k == 2


def test_requests_do_not_become_small():
    """At any size a request has about as many n-grams as wanted, and batches and ranges stay within a task."""
    for words in (10**6, 10**9, 10**11, 10**12, 2 * 10**13):
        batch, parts = lmscore._layout(6 * words, words, None, None)
        assert batch / parts >= 0.9 * lmscore.LEAST_REQUEST and batch <= 4 * 10**7 and words / parts <= 4 * 10**7
    assert lmscore._layout(0, 0, None, None) == (lmscore.BATCH_WORDS, 1) and lmscore._layout(100, 20, 7, 3) == (7, 3)
