"""The whole of identify against plain Python: text, declared, suffix, host over domain over table, own share left out."""

import math
import random
import re
import tracemalloc

import pytest
from pyspark.sql import functions as F

from scorewright.llm import langid

SF = "/root/testdata/sf0.01"


def plain(rows, model):
    names = [*model.languages, langid.UNKNOWN]
    many = len(names)

    def softmax(scores):
        top = max(scores)
        w = [math.exp(s - top) for s in scores]
        return [x / sum(w) for x in w]

    found = []
    for text, declared, url in rows:
        at = langid.trigram_buckets(text).tolist()
        n = len(at)
        sums = [sum(float(model.table[b, k]) for b in at) for k in range(many - 1)] + [-n * math.log(langid.BUCKETS)]
        ll = [s * langid.TEMPER / (langid.TEMPER + n) for s in sums] if n else [0.0] * many
        host = re.match(r"[a-z]+://(?:[^/?#@]*@)?([^/?#:]*)", (url or "").lower())
        host = host[1] if host else ""
        domain = re.search(r"[^.]+\.[^.]+$", host)
        said = re.match(r"\s*([a-z]+)", (declared or "").lower())
        found.append((n, ll, softmax(ll) if n else [0.0] * many, host, domain[0] if domain else "", said[1] if said else ""))
    add = lambda keep: [sum(f[2][k] for f in found if keep(f)) for k in range(many)]
    table = add(lambda f: True)
    base = [(x + 1) / (sum(table) + many) for x in table]
    out = []
    for n, ll, own, host, domain, said in found:
        if not n:
            out.append((langid.UNKNOWN, 1.0))
            continue
        near = add(lambda f: f[4] == domain)  # noqa: B023
        smooth = [(near[k] + langid.SMOOTH * base[k]) / (sum(near) + langid.SMOOTH) for k in range(many)]
        here = [max(x - y, 0) for x, y in zip(add(lambda f: f[3] == host), own)]  # noqa: B023
        scores = [math.log((here[k] + langid.SMOOTH * smooth[k]) / (sum(here) + langid.SMOOTH)) + ll[k] for k in range(many)]
        suffix = re.search(r"\.(co\.uk|[a-z]{2})$", host)
        for name, right in ((said, langid.DECLARED_RIGHT), (langid.SUFFIXES.get(suffix[1]) if suffix else None, langid.SUFFIX_RIGHT)):
            if name in names and name != langid.UNKNOWN:
                scores = [s + math.log(right if names[k] == name else (1 - right) / (many - 1)) for k, s in enumerate(scores)]
        post = softmax(scores)
        best = max(range(many), key=lambda k: post[k])
        out.append((names[best], post[best]))
    return out


def test_identify_matches_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs, per_language=40)
    rng = random.Random(3)
    texts = [r["text"] for r in docs.orderBy("doc_id").limit(120).collect()]
    hosts = ["a.x.de", "b.x.de", "www.y.fr", "z.co.uk", "q.com", "r.com", None]
    rows = []
    for k in range(160):
        words = rng.choice(texts).split() or ["x"]
        at = rng.randrange(len(words))
        host = rng.choice(hosts)
        rows.append((" ".join(words[at : at + rng.choice([1, 2, 3, 30])]), rng.choice([None, "", "de", "EN-us", "fr", "xx", "und"]), host and f"https://u@{host}:8/p"))
    rows += [(None, "de", "https://a.x.de/"), ("", None, None), ("12 !!", "fr", "https://q.com"), ("en", "de", "https://www.y.fr/x")]
    table = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id long, text string, declared string, url string")
    found, (key,) = langid.identify(table.repartition(5), model, "text", F.col("declared"), F.col("url"), ["id"])
    got = {r["id"]: (r["said"], r["confidence"]) for r in found.select(key, F.col("lang").alias("said"), "confidence").collect()}
    for k, (lang, confidence) in enumerate(plain(rows, model)):
        assert got[k][1] == pytest.approx(confidence, abs=1e-5)
        assert got[k][0] == lang or abs(confidence - 0.5) < 1e-3


def test_every_label_is_a_language(spark):
    rows = [(k, f"wort{k} {'ab' * (k % 7)} text", f"l{k:03d}") for k in range(260)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.fit(docs).languages == [f"l{k:03d}" for k in range(260)]


def test_a_long_text_needs_no_row_for_each_trigram(spark):
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"), per_language=40)
    text = "langer text mit worten " * 100_000
    tracemalloc.start()
    n, _ = model.evidence(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 2_000_000 and peak < 400 << 20
