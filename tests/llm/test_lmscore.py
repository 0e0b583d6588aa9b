import math
from collections import Counter

import pytest

from scorewright.llm import lmscore
from tests.llm.conftest import ODD


def split(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\r\x0b\x0c":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def brute(texts, order, alpha=0.4):
    docs = [split(t) for t in texts]
    own = [[Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) for n in range(1, order + 1)] for w in docs]
    every = [sum((o[n] for o in own), Counter()) for n in range(order)]
    total = sum(map(len, docs))
    out = []
    for w, o in zip(docs, own):
        count = lambda g: every[len(g) - 1][g] - o[len(g) - 1][g]  # noqa: B023, E731
        score, seen = 0.0, 0
        for k in range(len(w)):
            longest = min(order, k + 1)
            for n in range(longest, 0, -1):
                g = tuple(w[k - n + 1 : k + 1])
                if count(g) > 0 or n == 1:
                    value = count(g) / count(g[:-1]) if n > 1 else max(count(g), 0.5) / max(1, total - len(w))
                    score += math.log(value) + (longest - n) * math.log(alpha)
                    seen += n == order and count(g) > 0
                    break
        out.append((len(w), seen, score))
    return out


@pytest.mark.parametrize(("order", "batch"), [(3, 150), (3, 10**7), (2, 60), (1, 90), (4, 200)])
def test_matches_brute_force(make_docs, prose, order, batch):
    texts = [prose(10 + 3 * k, k % 25) for k in range(40)] + [t for t in ODD if t is None or len(t) < 1000] + ["THE end", "Once"]
    got = lmscore.score_documents(make_docs(texts).repartition(3, "doc_id"), order=order, batch_words=batch).collect()
    want = brute(texts, order)
    assert len(got) == len(texts)
    for r in got:
        n, seen, score = want[r["doc_id"]]
        assert (r["n_words"], r["n_seen"]) == (n, seen) and r["log_score"] == pytest.approx(score, abs=1e-6)


def test_packed_integers():
    import numpy as np

    for width, values in ((4, [0, 1, 2**32 - 1]), (5, [2**40 - 1]), (8, [2**63, 5]), (4, [])):
        a = np.array(values, np.uint64)
        assert lmscore.unpack(lmscore.pack(a, width), width).tolist() == a.tolist()


def test_null_ids_and_empty(make_docs):
    docs = make_docs([(None, "a b c", *[None] * 6), (None, "a b c", *[None] * 6), (2, None, *[None] * 6)])
    rows = lmscore.score_documents(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_seen"]) for r in rows) == [("2", 0, 0), ("None", 3, 1), ("None", 3, 1)]
    assert lmscore.score_documents(docs.limit(0)).collect() == []
