import random

import numpy as np
import xxhash

from scorewright.llm import simhash
from tests.llm.conftest import ODD, rows_of


def brute_print(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({k: " " for k in (9, 10, 11, 12, 13)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints, limit=3):
    root = list(range(len(ids)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(ids)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= limit:
                root[max(find(a), find(b))] = min(find(a), find(b))
    low = {}
    for k, i in enumerate(ids):
        low.setdefault(find(k), []).append(i)
    return [min(low[find(k)]) for k in range(len(ids))]


def test_prints_and_components_match_brute_force(spark, make_docs, prose):
    texts = [prose(40, s) for s in range(60)]
    for s in range(40):  # near copies, some in chains
        words = texts[s].split()
        words[s % len(words)] = "changed"
        texts.append(" ".join(words))
    texts += [t.upper() for t in texts[:5]] + ODD
    got = {r["doc_id"]: r for r in simhash.near_duplicates(make_docs(texts)).collect()}
    prints = [brute_print(t) for t in texts]
    assert [got[k]["fingerprint"] for k in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[k]["component_id"] for k in range(len(texts))] == brute_components(list(range(len(texts))), prints)


def test_links_lose_no_pair(spark):
    rng = random.Random(3)
    prints = [rng.getrandbits(64) for _ in range(300)]
    for p in prints[:150]:
        for _ in range(3):
            prints.append(p ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(1, 4))}))
    prints += [prints[0] ^ 1 << b for b in range(64)]  # a family around one print
    prints = list(dict.fromkeys(prints))
    ids = list(range(len(prints)))
    table = spark.createDataFrame([(i, int(np.uint64(p).view(np.int64))) for i, p in zip(ids, prints)], "doc_id long, fp long")
    for limit in (0, 1, 3, 7):
        got = {r["doc_id"]: r["component_id"] for r in simhash.components(table, limit).collect()}
        assert [got[i] for i in ids] == brute_components(ids, prints, limit)


def test_repeated_and_null_ids(spark, make_docs):
    rows = rows_of(["one two three four"] * 3, 7) + rows_of(["one two three four"], 7) + [(None, "one two three four", *[None] * 6), (None, "lone text of its own here", *[None] * 6)]
    got = simhash.near_duplicates(make_docs(rows)).collect()
    assert len(got) == 6
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == [("7", "7"), ("7", "7"), ("8", "7"), ("9", "7"), ("None", "7"), ("None", "None")]
    kept = simhash.keep_one(make_docs(rows)).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["7", "None"]


def test_empty_table(make_docs):
    assert simhash.near_duplicates(make_docs([]).limit(0)).collect() == []
