import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from scorewright.llm import merkle
from tests.llm.conftest import ODD

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def brute_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][k : k + 8]) for k in range(0, len(levels[-1]), 8)])
    return levels


def brute(rows):
    """Rows as (doc_id, source, lang, n_chars, text) -> sorted results."""
    rows = [tuple(r) for r in rows]
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees, places = {}, {}
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = brute_levels([leaf(r) for r in own])
        places[lang] = own
    tops = brute_levels([trees[lang][-1][0] for lang in langs])
    out = []
    for at, lang in enumerate(langs):
        for k, r in enumerate(places[lang]):
            now, proof, changed = leaf(r), "", r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                changed = (*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            now = leaf(changed)
            for levels, p in ((trees[lang], k), (tops, at)):
                for level in levels[:-1]:
                    run = level[p // 8 * 8 : p // 8 * 8 + 8]
                    proof += "".join(run[: p % 8] + run[p % 8 + 1 :])
                    now = H(*run[: p % 8], now, *run[p % 8 + 1 :])
                    p //= 8
            out.append((r[0], leaf(r), trees[lang][-1][0], tops[-1][0], H(proof), now, now == tops[-1][0]))
    return sorted(out, key=repr)


def result(df, **options):
    return sorted((tuple(r) for r in merkle.tampered_folds(df, COLUMNS, **options).collect()), key=repr)


def table(spark, rows):
    schema = "doc_id long, source string, lang string, n_chars long, text string, tree long, pos string, `a.b` int, digest int"
    return spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], schema)


@pytest.mark.parametrize("steps", [1, 2, 4])
def test_matches_brute_force(spark, prose, steps):
    rows = [(k * 3 % 700, f"s{k % 3}", "en", k, prose(4, k).title()) for k in range(530)]
    rows += [(k, None, "de", None, prose(3, k).upper()) for k in range(9)] + [(k, "s", f"l{k}", 3, "Text") for k in range(70)]
    rows += [(1000 + k, "s", None, 3, t) for k, t in enumerate(ODD)] + [(None, "s", "en", 3, "No ID")] * 3 + [(5, "s", "de", 3, None)] * 12 + [(7, "s", "", 3, "A")]
    got = result(table(spark, rows), steps=steps)
    assert got == brute(rows)
    assert {r[-1] for r in got} == {True, False}


def test_lone_rows_and_empty_tables(spark):
    assert result(table(spark, []).limit(0)) == []
    one = [(3, "s", "en", 1, "Ab")]
    assert result(table(spark, one)) == brute(one)
    assert result(table(spark, one + [(4, "s", None, 1, "x")])) == brute(one + [(4, "s", None, 1, "x")])


def test_a_fold_resumes_the_state_of_its_slot():
    parent = merkle.Parent([H(str(k)) for k in range(6)])
    assert parent.digest == H(*parent.children)
    for slot in range(6):
        assert parent.fold(slot, parent.children[slot]) == parent.digest
        assert parent.fold(slot, H("other")) == H(*parent.children[:slot], H("other"), *parent.children[slot + 1 :])


def test_manifest_parts(spark):
    rows = [(k, "s", "ab"[k % 2], k, str(k)) for k in range(40)]
    found = merkle.Manifest(table(spark, rows), COLUMNS)
    parts = {r["part"]: (r["size"], r["subroot"]) for r in found.parts.collect()}
    want = {x: (20, brute_levels([leaf(r) for r in rows if r[2] == x])[-1][0]) for x in "ab"}
    assert parts == want and found.root == H(want["a"][1], want["b"][1])
    # without a replacement every row folds to the root
    assert found.folds().where(~F.col("verified")).count() == 0
