import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from scorewright.llm import packing

TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> x", "end\n<|endoftext|>\n start  ", "word one<|endoftext|>two  three <|endoftext|>", "<|endoftext |> <|ENDOFTEXT|>"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("text", TEXTS)
def test_the_added_token_is_one_id(tokenizer, text):
    assert np.frombuffer(packing.token_ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_pieces_hold_the_added_token(tokenizer, make_docs):
    for r in packing.pack(make_docs(TEXTS)).collect():
        ids = np.array([*tokenizer.encode(TEXTS[r["doc_id"]], add_special_tokens=False).ids, 2], "<u4")
        assert (r["length"], r["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))
