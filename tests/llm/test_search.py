"""op13 against brute force: many segments, shards, blocks of items, ties, nulls, repeated rows; the bisection on planted halves."""

import itertools
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import op13_search

AZ = {i: i + 32 for i in range(65, 91)}
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(AZ))


def brute(docs, items, top):
    tf = [Counter(terms(t)) for _, t in docs]
    n_docs, total = sum(bool(c) for c in tf), sum(sum(c.values()) for c in tf)
    df = Counter(t for c in tf for t in c)
    out = []
    for item, text in items:
        scored = []
        for (doc, _), c in zip(docs, tf, strict=True):
            m = 50 + (50 * sum(c.values()) * n_docs) // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                scored.append((-s, doc is None, doc or 0))
        out += [(item, i + 1, None if null else doc, -s) for i, (s, null, doc) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(9)
    vocab = ["".join(rng.choice(list("abcdeé1"), 3)) for _ in range(80)]
    docs = [(None, "abc def"), (1, None), (2, ""), (3, "... ;;"), (None, " ".join(vocab))]
    for i in range(300):
        topic = vocab[:40] if i % 2 else vocab[40:]
        docs.append((i + 4, "-".join(rng.choice(topic, int(rng.integers(1, 60)))).title()))
    docs += docs[10:20] + [(9999, " ".join(vocab * 100))]
    items = [(i, " ".join(rng.choice(vocab, 8))) for i in range(12)] + [(20, None), (21, "zzzz"), (None, vocab[0]), (None, vocab[0]), (22, f"{vocab[1]} {vocab[1]}")]
    return docs, items


@pytest.mark.parametrize(("segment", "shard", "block", "seeds", "top"), [(8 << 20, 128, 256, 4, 50), (3000, 4, 5, 2, 5), (8 << 20, 8, 256, 1, 3)])
def test_brute_force(spark, rows, tmp_path, monkeypatch, segment, shard, block, seeds, top):
    docs, items = rows
    for k, v in (("SEGMENT", segment), ("SHARD", shard), ("BLOCK", block), ("SEEDS", seeds), ("HELD", 5)):
        monkeypatch.setattr(op13_search, k, v)
    d = spark.createDataFrame(docs, "doc_id long, text string").select("*", F.lit(1).alias("shard"), F.lit(1).alias("terms")).repartition(3)
    index = op13_search.build(d, f"{tmp_path}/index")
    got = op13_search.search(index, spark.createDataFrame(items, "item_id long, text string"), top)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, top)


def test_shards_are_skipped(spark, rows, monkeypatch):
    """With the documents of two topics apart, a search does not score the other topic's shards."""
    docs = [d for d in rows[0] if d[0] and 4 <= d[0] < 304]
    monkeypatch.setattr(op13_search, "SHARD", 16)
    batch = op13_search.shards_of(op13_search.pa.array([d[0] for d in docs]), op13_search.pa.array([d[1] for d in docs]), itertools.count())
    shards = [{c: batch[c][i] for c in batch.schema.names} for i in range(batch.num_rows)]
    pure = [len({x % 2 for x in r["ids"].as_py()}) == 1 for r in shards]
    assert sum(pure) >= 0.8 * len(pure)
    assert sorted(x for r in shards for x in r["ids"].as_py()) == sorted(d[0] for d in docs)
    items = op13_search.Items([docs[0][1]])
    df = Counter(t for _, text in docs for t in set(terms(text)))
    items.settle(len(docs), sum(len(terms(t)) for _, t in docs), {i: df[t] for i, t in enumerate(items.terms.to_pylist())})
    best = [items.scores(r, np.array([0])).max() for r in shards]
    bounds = [items.bounds(r)[0] for r in shards]
    assert all(b >= s for b, s in zip(bounds, best, strict=True)) and sum(b < max(best) for b in bounds) >= 0.4 * len(bounds)


def test_bisection_lowers_the_cost():
    rng = np.random.default_rng(1)
    group = rng.permutation(np.repeat([0, 1, 2, 3], 32))
    pairs = {(d, int(group[d] * 20 + rng.integers(20))) for d in range(128) for _ in range(15)}
    doc, term = np.array(sorted(pairs)).T
    leaf = op13_search.bisected(doc, term, 128, 80, 2)
    assert (np.bincount(leaf) == 32).all()
    assert max(Counter(group[leaf == k]).most_common(1)[0][1] for k in range(4)) == 32 and all(Counter(group[leaf == k]).most_common(1)[0][1] >= 24 for k in range(4))


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    index = op13_search.build(none, f"{tmp_path}/none")
    assert op13_search.search(index, items).collect() == [] and op13_search.search(index, items.limit(0)).collect() == []
    one = op13_search.build(spark.createDataFrame([(1, None), (2, "...")], "doc_id long, text string"), f"{tmp_path}/wordless")
    assert op13_search.search(one, items).collect() == []


def test_a_task_gets_few_shards_at_once(spark, tmp_path, monkeypatch):
    op, kind = op13_search, type(spark.range(1))
    before, real, seen = spark.conf.get(op.BATCH), kind.mapInArrow, []

    def spied(self, *args, **kwargs):
        seen.append(int(spark.conf.get(op.BATCH)))
        return real(self, *args, **kwargs)

    monkeypatch.setattr(kind, "mapInArrow", spied)
    docs = spark.range(300).selectExpr("id doc_id", "concat('word w', id % 7) text")
    index = op.build(docs, str(tmp_path / "index"))
    found = op.search(index, spark.createDataFrame([(1, "w3 word")], "item_id int, text string"))
    assert [r["doc_id"] for r in found.orderBy("rank").limit(3).collect()] == [3, 10, 17]
    assert seen[0] == op.BATCH_DOCS and set(seen[1:]) == {op.BATCH_SHARDS} and len(seen) >= 4 and spark.conf.get(op.BATCH) == before
