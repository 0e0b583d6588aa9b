import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewright.llm import langid
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.length("text") > 80)
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    model = langid.fit(docs.where(half), per_language=40)
    assert model.languages == ["de", "en", "es", "fr"]
    found, back = langid.identify(docs.where(~half), model)
    rows = found.select(*back[2:3], F.col("lang").alias("said")).collect()
    assert len(rows) > 300 and np.mean([r[0] == r[1] for r in rows]) > 0.98


def test_fusion_matches_formula():
    names = ["de", "en", langid.UNKNOWN]
    text, own = np.log([[0.2, 0.5, 0.3]]), np.array([[0.2, 0.5, 0.3]])
    host, domain = np.array([[3.2, 1.5, 0.3]]), np.array([[0.6, 0.3, 0.1]])
    prior = (np.array([3, 1, 0]) + langid.SMOOTH * domain[0]) / (4 + langid.SMOOTH)
    want = prior * [0.2, 0.5, 0.3] * np.array([0.9, 0.05, 0.05])
    got = langid.fuse(names, text, own, host, domain, [(["de"], 0.9), (["xx"], 0.7)])
    assert got[0] == pytest.approx(want / want.sum())


def test_evidence_moves_short_texts(spark):
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"), per_language=40)
    rows = [(k, "en", "de", "https://www.zeitung.de/x") for k in range(30)] + [(100, "en", None, None)]
    table = spark.createDataFrame(rows, "id long, text string, declared string, url string")
    found, back = langid.identify(table, model, "text", F.col("declared"), F.col("url"))
    rows = found.select(*back, F.col("lang").alias("said"), "confidence").collect()
    told = next(r for r in rows if r["id"] == 0)
    alone = next(r for r in rows if r["id"] == 100)
    assert told["said"] == "de" and alone["confidence"] < 1 and len(rows) == 31


def test_odd_rows_and_reject(make_docs, spark):
    known = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang = 'en'").collect()]
    junk = ["12345 !!!", "xqzj kvwq zzxk jjqv wkxz qqzx vjkq xzwv kqjx zvqw " * 5]
    texts = [*known, *junk, *ODD]
    docs = make_docs(texts)
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert set(range(len(known))) <= ids
    n = len(known)
    assert ids.isdisjoint({n, n + 1, n + 2, n + 3, n + 4})  # junk, null, empty, white space
    assert langid.keep_identified(docs.limit(0)).collect() == []
    assert langid.keep_identified(docs.withColumn("lang", F.lit(None).cast("string"))).collect() == []


def test_hosts_and_markup(spark):
    html = '<!doctype html><HTML class="x" lang=\'fr-FR\'><script>var a="</p>";</script><p>Un&amp;deux<!-- x --></p>'
    row = spark.createDataFrame([(html, "HTTP://u@Www.Ex.Fr:80/a?b")], "h string, u string")
    got = row.select(langid.markup_language(F.col("h")), langid.markup_text(F.col("h")), langid.host_of(F.col("u")), langid.host_of(F.lit("src0"))).first()
    assert (got[0], got[1].split(), got[2], got[3]) == ("fr", ["Un", "deux"], "www.ex.fr", "src0")
