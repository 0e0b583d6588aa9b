import hashlib
import re

import pytest

from scorewright.llm import decontam
from tests.llm.conftest import ODD


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items):
    w, hit, named = words(text), set(), set()
    for item, t in items:
        v = words(t)
        n = min(10, len(v))
        for k in range(len(v) - n + 1) if n else ():
            for at in range(len(w) - n + 1):
                if w[at : at + n] == v[k : k + n]:
                    hit.update(range(at, at + n))
                    named.add(str(item))
    return len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [decontam.BLOCK_WORDS, 40])
def test_matches_brute_force(spark, make_docs, prose, block):
    items = [(k, prose(8 + 4 * k, 900 + k)) for k in range(8)] + [(20, "Short ITEM, ok"), (21, "short item ok"), (3, "again id three"), (None, ""), (22, None), (23, "one")]
    texts = [prose(50, k) for k in range(12)]
    texts += [texts[k] + ", " + items[k][1].upper().replace(" ", " -- ") + " " + texts[k] for k in range(8)]
    texts += [" ".join(items[5][1].split()[4:17]), "a short item ok short item ok b", "again ID three!", *ODD[:-3], "One"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(make_docs(texts), bench, block_words=block).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == brute(texts[r["doc_id"]], items)
    kept = decontam.drop_contaminated(make_docs(texts), bench, block_words=block)
    assert kept.columns == make_docs(["a"]).columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if not r["contaminated"]}


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(make_docs([]).limit(0), none).collect() == []
    assert decontam.contamination(make_docs(["a b c"]), none).first()["contaminated"] is False
