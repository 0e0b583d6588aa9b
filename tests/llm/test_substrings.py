import random
import re

import numpy as np
import pyarrow as pa
import pytest

from scorewright.llm import substrings
from tests.llm.conftest import ODD, rows_of


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows, width=13):
    first, last = {}, 1 << 63
    for i, text in rows:
        w, key = words(text), last if i is None else i
        for k in range(len(w) - width + 1):
            gram = tuple(w[k : k + width])
            first[gram] = min(first.get(gram, last), key)
    out = []
    for i, text in rows:
        w, gone, key = words(text), set(), last if i is None else i
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < key:
                gone.update(range(k, k + width))
        out.append((i, len(w), len(gone), " ".join(x for n, x in enumerate(w) if n not in gone)))
    return sorted(out, key=repr)


def result(df, **options):
    return sorted((tuple(r) for r in substrings.drop_repeats(df, **options).collect()), key=repr)


def corpus(prose):
    rng = random.Random(9)
    passage = prose(60, 77)
    texts = [prose(80, k) for k in range(30)]
    texts += [" ".join(words(texts[k])[: 20 + k]) + "\n" + passage + " tail" for k in range(10)]  # a passage of many documents
    texts += [texts[3]] * 4 + [passage + "\t" + passage, "  ".join(words(prose(80, 5))[10:23]), " ".join(words(texts[7])[:12])]
    for k in range(12):  # near copies
        w = words(texts[20])
        w[rng.randrange(80)] = "changed"
        texts.append(" ".join(w))
    return texts + ODD


@pytest.mark.parametrize("width, short", [(13, 7), (13, 13), (13, 4), (12, 3), (5, 7), (1, 7)])
def test_matches_brute_force(spark, make_docs, prose, width, short):
    texts = corpus(prose)
    texts = texts if width > 1 else [t for t in texts if len(t or "") < 10_000]
    rows = rows_of(texts)
    rows = [rows[k] for k in np.random.default_rng(1).permutation(len(rows)).tolist()]
    rows += [(None, texts[4], "en", "s", 1, "x", 0, "y"), (None, prose(30, 500), "en", "s", 1, "x", 0, "y"), (None, prose(30, 500), "en", "s", 1, "x", 0, "y")]
    rows += [(7, texts[7] + " " + texts[9], "en", "s", 1, "x", 0, "y"), (7, texts[2], "en", "s", 1, "x", 0, "y"), (-4, texts[11], "en", "s", 1, "x", 0, "y")]
    assert result(make_docs(rows), width=width, short=short) == brute([r[:2] for r in rows], width)


def test_small_batches_give_the_same(monkeypatch, prose):
    """What a task compares itself and what it asks add up, whatever its batches."""
    ids, texts = list(range(40)), [prose(40, k % 9) for k in range(40)]
    held = substrings.Words(pa.array(texts))
    h, check, text = substrings._asked(held, None, [13], 0)
    for size in (1, 3, 40):
        late = set()
        asked: dict = {}
        for at in range(0, 40, size):
            own = (text >= at) & (text < at + size)
            for batch in substrings._compared([(h[own], check[own], text[own])], True):
                for key, c, i, known in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                    if known:
                        late.add((key, i))
                    else:
                        asked.setdefault((key, c), []).append(i)
        for (key, _), found in asked.items():
            assert len(found) <= -(-40 // size)  # one for each batch
            late |= {(key, i) for i in found if i > min(found)}
        want = {(int(x), int(i)) for x, i in zip(h.view(np.int64), text) if i > text[h.view(np.int64) == x].min()}
        assert late == want and len(ids) == 40


def test_words_are_those_of_the_text():
    texts = ["ab cd", None, "", "ab", "cd\x0bef  gh\n", "é x é x", "w" * 300, "w" * 301, "\x00", "abcdefgh abcdefgh\x00 i"]
    found = substrings.Words(pa.array(texts, pa.string()).slice(1))
    flat = [(k, w) for k, t in enumerate(texts[1:]) for w in words(t)]
    assert found.text.tolist() == [k for k, _ in flat]
    by = {}
    for h, (_, w) in zip(found.hash.tolist(), flat, strict=True):
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by)


def test_lengths():
    assert substrings.lengths_of(13) == [7, 13] and substrings.lengths_of(50) == [7, 13, 25, 50] and substrings.lengths_of(5) == [5]


def test_empty(make_docs):
    assert result(make_docs([]).limit(0)) == []
