import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scorewright.llm import packing
from tests.llm.conftest import ODD


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


TEXTS = ["Hello  world", " lead", "trail ", "a\nb \n c\t d", "it's don't  we'll", "x y  z", "a b  c", "tab\t word", "é è", "<|endoftext|> x", "1 22 333 ½ ²", "end\n", "\n start", "a 　b"]


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", TEXTS + ODD[:7])
def test_ids_are_those_of_the_tokenizers_library(tokenizer, text):
    assert np.frombuffer(packing.token_ids(text), "<u4").tolist() == ids_of(tokenizer, text)


def test_ids_of_prose(tokenizer, spark):
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect():
        assert np.frombuffer(packing.token_ids(r["text"]), "<u4").tolist() == ids_of(tokenizer, r["text"])


def check(rows, texts, tokenizer, capacity):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert sorted(by_doc) == list(range(len(texts)))
    for k, pieces in by_doc.items():
        ids = np.array([*ids_of(tokenizer, texts[k]), 2], "<u4")
        pieces.sort(key=lambda r: r["piece"])
        at = 0
        for number, r in enumerate(pieces):
            assert (r["piece"], r["start"]) == (number, at)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
        assert all(r["length"] == capacity for r in pieces[1:])
        assert len(pieces) == 1 or len(ids) > capacity
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r["offset"])
        ends = np.cumsum([r["length"] for r in pieces])
        assert [r["offset"] for r in pieces] == [0, *ends[:-1]] and ends[-1] <= capacity
    return len(by_seq)


def test_pieces_and_sequences(make_docs, prose, tokenizer):
    texts = [prose(3 + 7 * (k * k % 31), k) for k in range(200)] + ODD
    docs = make_docs(texts).repartition(13, "doc_id")
    rows = packing.pack(docs).collect()
    used = check(rows, texts, tokenizer, 1024)
    total = sum(r["length"] for r in rows)
    assert used <= -(-total // 1024) + 2


def test_levels_merge_underfull_bins(make_docs, prose, tokenizer):
    texts = [prose(60, k) for k in range(40)]
    docs = make_docs(texts).repartition(40, "doc_id")
    rows = packing.pack(docs, capacity=1024).collect()
    used = check(rows, texts, tokenizer, 1024)
    assert used <= -(-sum(r["length"] for r in rows) // 1024) + 2  # not one for each of 40 tasks


def test_best_fit_takes_the_tightest_bin():
    fit = packing.BestFit(10)
    for item, n in [("a", 6), ("b", 7), ("c", 3), ("d", 4)]:
        fit.put(item, n)
    assert sorted(held for _, held in fit.take(10)) == [["a", "d"], ["b", "c"]]
    assert packing.pieces_of(2500) == [(0, 452), (452, 1024), (1476, 1024)]
    assert packing.pieces_of(2048) == [(0, 1024), (1024, 1024)] and packing.pieces_of(1) == [(0, 1)]


def test_repeated_rows_and_empty_table(make_docs):
    docs = make_docs([(1, "a b", *[None] * 6), (1, "a b", *[None] * 6), (None, None, *[None] * 6)])
    rows = packing.pack(docs).collect()
    assert len(rows) == 3 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 3
    assert packing.pack(docs.where(F.lit(False))).collect() == []
