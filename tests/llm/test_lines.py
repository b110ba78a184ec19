"""op12 against brute force: both modes, hot lines, repeated rows, nulls, clashing columns."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.llm import op12_lines

ENDS = " \t\n\x0b\x0c\r"
AZ = {i: i + 32 for i in range(65, 91)}
ROWS = [(1, "Copy\nown 1\n copy \n\n"), (1, "Copy\nown 1\n copy \n\n"), (1, "other\nCOPY"), (None, "copy\nnull"), (None, None), (2, ""), (3, "é\nÉ\n\x0bcopy\r"), (4, "a\n" * 3000 + "copy\na"), (5, "own 1")]


def brute(rows, min_docs, keep_first):
    lines = [(r or "").split("\n") for _, r in rows]
    keys = [[x.strip(ENDS).translate(AZ) for x in ls] for ls in lines]
    df = Counter(k for ks in keys for k in set(ks) if k)
    out = []
    for i, (doc, text) in enumerate(rows):
        kept = []
        for p, (x, k) in enumerate(zip(lines[i], keys[i], strict=True)):
            if k and df[k] >= min_docs:
                places = [(r[0] is not None, r[0] or 0, op_hash[r[1]], q) for r, ks in zip(rows, keys, strict=True) for q, y in enumerate(ks) if y == k] if keep_first else []
                if not keep_first or (doc is not None, doc or 0, op_hash[text], p) != min(places):
                    continue
            kept.append(x)
        out.append((doc, len(lines[i]), len(lines[i]) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


op_hash: dict = {}


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ROWS, "doc_id long, text string")
    op_hash.update({r[0]: r[1] for r in d.select("text", F.xxhash64("text")).collect()})
    return d


@pytest.mark.parametrize("heavy", [2000, 3])
@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("min_docs", [1, 2, 4])
def test_brute_force(docs, monkeypatch, heavy, keep_first, min_docs):
    monkeypatch.setattr(op12_lines, "HEAVY", heavy)
    got = op12_lines.apply(docs, op12_lines.bitmaps(docs, min_docs=min_docs, keep_first=keep_first), digest=True)
    assert sorted(map(tuple, got.collect()), key=str) == brute(ROWS, min_docs, keep_first)


def test_bitmaps_are_sparse(docs):
    found = {r["n_dropped"]: r["dropped"] for r in op12_lines.bitmaps(docs, min_docs=5).collect()}
    assert found[2] == {0: 0b101} and found[1] in ({0: 1}, {0: 2}, {0: 4}, {46: 1 << (3000 - 46 * 64)})
    assert all(len(m) == 1 for m in found.values())


def test_texts_and_columns(docs):
    wide = docs.select("*", *[F.lit(7).alias(c) for c in ("N_LINES", "n_dropped", "h", "_id", "_bits", "th", "first")])
    got = op12_lines.apply(wide, op12_lines.bitmaps(wide, min_docs=5))
    assert len({c.lower() for c in got.columns}) == len(got.columns) == 9
    texts = {(r["doc_id"], r["text"]) for r in got.collect()}
    assert (1, "own 1\n\n") in texts and (None, None) in texts and (None, "null") in texts and (3, "é\nÉ") in texts
    none = docs.limit(0)
    assert op12_lines.apply(none, op12_lines.bitmaps(none)).collect() == []
