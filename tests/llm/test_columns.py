"""Operators take tables with odd column names, keep them, and do not mind nulls, repeats or no rows."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorewright.llm import decontam, fingerprints, langid, lmscore, neardup, packing, secrets, sharding, simhash
from scorewright.llm.rows import PIECE, pieces, with_arrow_columns

ODD_NAMES = ["a.b", "x-y", "_h", "_text", "c0", "i0", "n0", "node", "key", "hits", "spans", "redacted", "lang", "post", "host", "_words", "back`tick"]


@pytest.fixture(scope="module")
def docs(spark):
    inner = T.StructType([T.StructField("x-y", T.IntegerType()), T.StructField("a.b", T.StringType())])
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    fields += [T.StructField(n, T.StringType()) for n in ODD_NAMES] + [T.StructField("nested", inner)]
    texts = ["the quick brown fox jumps over it", "the quick brown fox jumps over it", None, "", "token = abcdefghijklmn0p", "eine andere sprache mit worten", None]
    rows = [(None if k == 6 else k, t, "src", 3, *(f"{n} {k}" for n in ODD_NAMES), (k, "z")) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, T.StructType(fields))


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "brown fox jumps")], "item_id long, text string")


KEEPING = {
    "redact": lambda d, b: secrets.redact_secrets(d),
    "clean": lambda d, b: decontam.drop_contaminated(d, b),
    "languages": lambda d, b: langid.keep_identified(d),
    "near": lambda d, b: neardup.keep_one(d),
    "simhash": lambda d, b: simhash.keep_one(d),
    "sketch": lambda d, b: fingerprints.with_sketch(d, F.col("text"), "sketch").drop("sketch"),
}


@pytest.mark.parametrize("name", KEEPING)
def test_columns_come_back(docs, benchmark, name):
    out = KEEPING[name](docs, benchmark)
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    given = {r["a.b"]: r for r in docs.collect()}
    rows = out.collect()
    assert rows
    for r in rows:
        was = given[r["a.b"]]
        same = [c for c in docs.columns if c not in ("text", "n_chars")]
        assert [r[c] for c in same] == [was[c] for c in same]
    assert KEEPING[name](docs.limit(0), benchmark).collect() == []


OTHERS = {
    "secrets": (lambda d, b: secrets.secret_report(d), 7),
    "shards": (lambda d, b: sharding.shard_by_bytes(d, 3, keep=["a.b", "shard`s"] if "shard`s" in d.columns else ["a.b"]), 7),
    "pack": (lambda d, b: packing.pack(d), 7),
    "pairs": (lambda d, b: fingerprints.edited_pairs(d), 7),
    "classes": (lambda d, b: simhash.near_duplicates(d), 7),
    "scores": (lambda d, b: lmscore.score_documents(d), 7),
    "windows": (lambda d, b: decontam.contamination(d, b), 7),
}


@pytest.mark.parametrize("name", OTHERS)
def test_other_columns_do_not_matter(docs, benchmark, name):
    make, many = OTHERS[name]
    assert make(docs, benchmark).count() == many
    assert make(docs.limit(0), benchmark).count() == 0


def test_shards_are_the_optimum_of_the_documents(spark):
    """The largest shard of real documents is as small as any contiguous cut of the groups allows."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    groups = docs.select(sharding.text_hash(F.coalesce("text", F.lit(""))).alias("h"), (F.octet_length(F.coalesce("text", F.lit(""))) + 1).alias("n"))
    sizes = [r["n"] for r in groups.groupBy("h").agg(F.sum("n").alias("n")).orderBy("h").collect()]
    best = [[0] + [sum(sizes)] * len(sizes)]
    total = [0]
    for s in sizes:
        total.append(total[-1] + s)
    for _ in range(8):  # best[k][i]: least largest part of the first i groups in k parts
        last = best[-1]
        best.append([0] + [min(max(last[j], total[i] - total[j]) for j in range(i)) for i in range(1, len(sizes) + 1)])
    loads = sharding.shard_by_bytes(docs, 8).groupBy("shard").agg(F.sum("size").alias("n")).agg(F.max("n")).first()[0]
    assert loads == best[8][-1]


def test_shard_folders_need_a_free_name(docs, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "a"), 2)
    back = docs.sparkSession.read.parquet(str(tmp_path / "a"))
    assert back.count() == 7 and set(back.columns) == {*docs.columns, "shard"}
    with pytest.raises(ValueError, match="shard"):
        sharding.write_shards(docs.withColumn("shard", F.lit(1)), str(tmp_path / "b"), 2)


def test_batches_become_objects_in_pieces(spark):
    rows = spark.createDataFrame([(k, "x" * 100_000) for k in range(40)] + [(40, None), (41, "")], "id long, text string").coalesce(1)
    start = lambda: lambda texts: [pa.array([sum(len(t or "") for t in texts)] * len(texts), pa.int64())]
    out, back = with_arrow_columns(rows, [F.col("text")], start, "held long", ["id"])
    got = out.select(*back, "held").collect()
    assert sorted(r["id"] for r in got) == list(range(42))
    assert 0 < max(r["held"] for r in got) <= 2 * PIECE
    batch = pa.RecordBatch.from_pydict({"t": ["y" * n for n in range(3000)]})
    found = list(pieces(batch))
    assert len(found) > 1 and pa.Table.from_batches(found).equals(pa.Table.from_batches([batch]))
    assert list(pieces(batch.slice(0, 0))) == []
