import corpus_pipeline
from scorewright.llm import decontam, langid, packing, secrets

SF = "/root/testdata/sf0.001"


def first_of_groups(texts):
    """Smallest id of each group that pairs of five-word Jaccard 0.8 or more connect, over all pairs."""
    shingles = {}
    for k, t in texts.items():
        w = (t or "").lower().split()
        shingles[k] = {tuple(w[at : at + 5]) for at in range(max(1, len(w) - 4))}
    first = {k: k for k in texts}
    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and 5 * len(shingles[a] & shingles[b]) >= 4 * len(shingles[a] | shingles[b]):
                low, high = sorted((first[a], first[b]))
                first = {k: low if v == high else v for k, v in first.items()}
    return set(first.values())


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontaminate", "secret_scan", "pack"]
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now, stage(spark, now, SF)
        assert now.columns == docs.columns
        left, kept = {r["doc_id"] for r in before.collect()}, {r["doc_id"]: r["text"] for r in now.collect()}
        if name == "near_dedup":
            assert set(kept) == first_of_groups({r["doc_id"]: r["text"] for r in before.collect()})
        elif name == "decontaminate":
            assert left - set(kept) == {r["doc_id"] for r in decontam.contamination(before, bench).collect() if r["contaminated"]}
        else:
            assert set(kept) == left or name == "language_id"
    assert all(not secrets.base_spans(t) for t in kept.values())
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in rows} == set(kept)
    for r in rows:
        if r["piece"] == 0:
            ids = packing.token_ids(kept[r["doc_id"]])
            assert r["length"] == packing.pieces_of(len(ids) // 4 + 1)[0][1]
    assert langid.UNKNOWN == "und"


def test_the_whole_pipeline_takes_odd_documents(spark, tmp_path, prose, make_docs):
    """Nulls in any column, repeated rows, very long and empty texts, columns that operators use themselves, and no rows at all."""
    rows = [(k, f"The {prose(60, k)} and the end of it is that", "en", "src0", 10, "x", k, "y") for k in range(12)]
    rows += [rows[0], (None, rows[3][1], None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (50, "", "en", None, 0, "", None, ""), (51, "the and of to in " * 40_000, None, "src1", 1, "x", 1, "y")]
    docs = make_docs(rows)
    for name, table in (("full", docs), ("none", docs.limit(0))):
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([(1, rows[5][1]), (2, None), (None, "")], "item_id long, text string").write.parquet(str(tmp_path / name / "benchmark.parquet"))
    packed = corpus_pipeline.run(spark, str(tmp_path / "full")).collect()
    ids = {r["doc_id"] for r in packed}
    assert 5 not in ids and {0, 1, 2, 4} <= ids and 50 not in ids
    assert sum(r["doc_id"] == 0 and r["piece"] == 0 for r in packed) == 1
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []
