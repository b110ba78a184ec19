"""Ranked lexical search over a clustered index.

build() cuts the documents as they are read into segments of SEGMENT bytes of text, reorders each by recursive graph bisection
(halves trade documents while that lowers the log-gap cost of their terms) and writes one row for each shard of about SHARD
neighbours: ids, lengths, terms, postings, and for each term which of them are the skyline of (tf, length), whose best impact
under any statistics is the term's exact maximum in the shard. No text is shuffled; any number of segments can be built apart.

search() takes the items in blocks. Statistics of their terms come from the index. A shard's bound for an item is the sum of its
terms' maxima. First each item's SEEDS shards of the highest bounds anywhere are scored, which gives a 50th score; then every
task goes through its shards by falling bound and scores an item only where the bound reaches that score or the task's own
50th, so a skipped shard can hold no result, not even a tie. Places in the new order are mapped back to doc_id before ties are
settled. Scores are integers below 2**53 and their sums exact.

Defined cases: null or empty texts have no terms and are never found; a null doc_id is kept and comes last among equal scores;
repeated rows are documents of their own; items without terms give no rows; each item row is an item, repeated ones too, null
ids as well; a very long text is a segment of its own; other columns are not read; empty tables give no rows.
"""

from __future__ import annotations

import contextlib
import itertools
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, ensure_checkpoint_dir, read
from .packed import FOLD

TOP = 50
#: Text of a segment, documents of a shard, rounds of trades at each level, shards that give the first 50th score, items of a block.
SEGMENT, SHARD, ROUNDS, SEEDS, BLOCK = 4 << 20, 128, 4, 4, 256
#: Shards that a task holds at once.
HELD = 16
#: Documents and shards in a batch between a task and its Python worker, and bytes of a row group of the index: a task's memory follows these,
#: not the size of its part of the input, which grows until Spark cuts it.
BATCH_DOCS, BATCH_SHARDS, ROW_GROUP = 1000, 64, 8 << 20
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[65:91] = IN_WORD[97:123] = IN_WORD[128:] = True
INDEX = (
    "shard bigint, n_held int, n_words bigint, ids array<bigint>, lens array<int>, terms array<string>, starts array<int>, docs array<smallint>, tfs array<int>, "
    "sky binary"
)


def tokens_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct terms, and term and text number of each place."""
    texts = texts.fill_null("").cast(pa.large_string())
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    data = FOLD[np.insert(data, off[1:-1], 10)]
    inside = IN_WORD[data]
    edge = np.diff(np.concatenate([[False], inside, [False]]).view(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    at = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(data[inside])]).dictionary_encode()
    first = np.searchsorted(start, off[:-1] + np.arange(len(texts)))
    return words.dictionary.cast(pa.binary()).cast(pa.string()), words.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(texts)), np.diff(np.append(first, len(start))))


def bisected(doc: np.ndarray, term: np.ndarray, n_docs: int, n_terms: int, levels: int) -> np.ndarray:
    """The leaf of each document: 2**levels of nearly equal size, by recursive graph bisection over the (doc, term) pairs.

    All nodes of a level trade at once. A document's gain is what moving it alone would take off the log-gap cost
    d * log2(n / (d + 1)) of its terms, d being a term's degree in a half of n documents."""
    many = np.bincount(term, minlength=n_terms) > 1
    keep = many[term]
    doc, term = doc[keep].astype(np.int32), (np.cumsum(many, dtype=np.int32) - 1)[term[keep]]
    n_terms = int(many.sum())
    log = np.log2(np.arange(1, n_docs + 3))
    half = np.zeros(n_docs, np.int64)
    for level in range(levels):
        order = np.argsort(half, kind="stable")
        size = np.bincount(half, minlength=1 << level)
        rank = np.arange(n_docs) - np.repeat(np.cumsum(size) - size, size)
        side = np.empty(n_docs, np.int64)
        side[order] = rank >= np.repeat((size + 1) // 2, size)
        half = 2 * half + side
        for _ in range(ROUNDS):
            size = np.bincount(half, minlength=2 << level)
            own = half[doc] * n_terms + term
            degree = np.bincount(own, minlength=(2 << level) * n_terms)
            a, b = degree[own], degree[own + np.where(half[doc] & 1, -n_terms, n_terms)]
            logs = np.log2(np.maximum(size, 1))
            n, m = logs[half][doc], logs[half ^ 1][doc]
            gain = a * (n - log[a]) - (a - 1) * (n - log[a - 1]) + b * (m - log[b]) - (b + 1) * (m - log[b + 1])
            gain = np.bincount(doc, weights=gain, minlength=n_docs)
            order = np.lexsort((-gain, half))
            first = np.cumsum(size) - size
            pairs = np.minimum(size[0::2], size[1::2])
            which = np.repeat(np.arange(len(pairs)), pairs)
            rank = np.arange(len(which)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
            left, right = order[first[2 * which] + rank], order[first[2 * which + 1] + rank]
            trade = gain[left] + gain[right] > 1e-9
            if not trade.any():
                break
            half[left[trade]] += 1
            half[right[trade]] -= 1
    return half


def ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... n[0] of them, and so on."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def shards_of(ids: pa.Array, texts: pa.Array, number: Iterator[int]) -> pa.RecordBatch:
    """The rows of one segment."""
    terms, code, doc = tokens_of(texts)
    n_docs, n_terms = len(texts), len(terms)
    lens = np.bincount(doc, minlength=n_docs)
    key, tf = np.unique(doc * max(n_terms, 1) + code, return_counts=True)
    doc, code = key // max(n_terms, 1), key % max(n_terms, 1)
    leaf = bisected(doc, code, n_docs, n_terms, max(0, math.ceil(math.log2(n_docs / SHARD)))) if n_docs else np.zeros(0, np.int64)
    order = np.argsort(leaf, kind="stable")
    place = np.empty(n_docs, np.int64)
    sizes = np.bincount(leaf) if n_docs else np.zeros(0, np.int64)
    place[order] = np.arange(n_docs) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    # postings by shard, term and, best first, (tf, length): the skyline is where the length falls below all before
    by = np.lexsort((lens[doc], -tf, code, leaf[doc]))
    shard, code, doc, tf = leaf[doc[by]], code[by], doc[by], tf[by]
    new = np.ones(len(by), bool)
    new[1:] = (code[1:] != code[:-1]) | (shard[1:] != shard[:-1])
    group = np.cumsum(new) - 1
    span = int(lens.max()) + 1 if n_docs else 1
    low = np.minimum.accumulate((len(by) - group) * span + lens[doc]) if len(by) else group
    sky = new.copy()
    sky[1:] |= low[1:] < low[:-1]
    rows = []
    for s, (a, b) in enumerate(itertools.pairwise(np.searchsorted(shard, np.arange(len(sizes) + 1)))):
        own = order[np.sum(sizes[:s]) : np.sum(sizes[: s + 1])]
        at = np.flatnonzero(new[a:b])
        rows.append({
            "shard": next(number), "n_held": int((lens[own] > 0).sum()), "n_words": int(lens[own].sum()), "ids": ids.take(pa.array(own)), "lens": lens[own], "terms": terms.take(pa.array(code[a:b][at])),
            "starts": np.append(at, b - a), "docs": place[doc[a:b]], "tfs": tf[a:b], "sky": np.packbits(sky[a:b]).tobytes(),
        })
    kinds = {"shard": pa.int64(), "n_held": pa.int32(), "n_words": pa.int64(), "ids": pa.list_(pa.int64()), "terms": pa.list_(pa.string()), "docs": pa.list_(pa.int16()), "sky": pa.binary()}
    whole = lambda x: x.astype(np.int32) if isinstance(x, np.ndarray) else x
    names = [c.split()[0] for c in INDEX.split(", ")]
    return pa.record_batch([pa.array([whole(r[c]) for r in rows], kinds.get(c, pa.list_(pa.int32()))) for c in names], names=names)


def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = itertools.count(TaskContext.get().partitionId() << 32)
    held, size = [], 0
    for batch in batches:
        lengths = pc.binary_length(batch["text"]).fill_null(0).to_numpy(zero_copy_only=False)
        a = 0
        for i, n in enumerate(lengths):
            if size and size + n > SEGMENT:
                held.append(batch.slice(a, i - a))
                yield from segment(held, number)
                held, size, a = [], 0, i
            size += int(n) + 64
        held.append(batch.slice(a))
    yield from segment(held, number)


def segment(held: list[pa.RecordBatch], number: Iterator[int]) -> Iterator[pa.RecordBatch]:
    if held and sum(b.num_rows for b in held):
        t = pa.Table.from_batches(held)
        one = lambda c: pa.concat_arrays(t[c].chunks)
        rows = shards_of(one("doc_id"), one("text"), number)
        for a in range(0, rows.num_rows, HELD):
            yield rows.slice(a, HELD)


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Plans made meanwhile send at most so many rows at once to a Python worker."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def build(docs: DataFrame, path: str) -> DataFrame:
    """Writes the index of docs (doc_id, text) as Parquet and returns it."""
    with batches_of(docs.sparkSession, BATCH_DOCS):
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(indexed, INDEX)
        rows.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return docs.sparkSession.read.schema(INDEX).parquet(path)


class Items:
    """A block of items: uses, 1 where an item (row) has a term (column), and each term's weight."""

    def __init__(self, texts: list[str | None]):
        terms, code, item = tokens_of(pa.array(texts, pa.string()))
        self.terms = terms
        self.uses = np.zeros((len(texts), len(terms)))
        self.uses[item, code] = 1.0
        self.weight, self.n_docs, self.n_words = np.zeros(len(terms), np.int64), 0, 1

    def settle(self, n_docs: int, n_words: int, df: dict[int, int]) -> None:
        self.n_docs, self.n_words = n_docs, max(n_words, 1)
        for k, n in df.items():
            self.weight[k] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1)))

    def impact(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        tf, n = tf.astype(np.int64), n.astype(np.int64)
        m = 50 + (50 * n * self.n_docs) // self.n_words
        return (1_000_000_000 * tf) // (1000 * tf + 20 * m)

    def held(self, row: dict) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the block's terms that the shard has, and where they are in the shard, ascending."""
        at = pc.index_in(self.terms, row["terms"].values).fill_null(-1).to_numpy(zero_copy_only=False)
        mine = np.flatnonzero(at >= 0)
        mine = mine[np.argsort(at[mine])]
        return mine, at[mine]

    def bounds(self, row: dict) -> np.ndarray:
        """The highest score that any document of the shard could have, for each item."""
        mine, at = self.held(row)
        if not len(mine):
            return np.zeros(len(self.uses))
        starts = numbers(row["starts"])
        where = ranges(starts[at], starts[at + 1] - starts[at])
        up = where[np.unpackbits(np.frombuffer(row["sky"].as_buffer(), np.uint8))[where] == 1]  # the first of each term is one
        most = np.maximum.reduceat(self.impact(numbers(row["tfs"])[up], numbers(row["lens"])[numbers(row["docs"])[up]]), np.searchsorted(up, starts[at]))
        return self.uses[:, mine] @ (self.weight[mine] * most).astype(float)

    def scores(self, row: dict, which: np.ndarray) -> np.ndarray:
        """Scores of the items `which` (rows) for the shard's documents (columns)."""
        mine, at = self.held(row)
        starts, lens = numbers(row["starts"]), numbers(row["lens"])
        n = starts[at + 1] - starts[at]
        where = ranges(starts[at], n)
        doc = numbers(row["docs"])[where]
        part = np.zeros((len(mine), len(lens)))
        part[np.repeat(np.arange(len(mine)), n), doc] = np.repeat(self.weight[mine], n) * self.impact(numbers(row["tfs"])[where], lens[doc])
        return self.uses[np.ix_(which, mine)] @ part


def numbers(x: pa.Scalar) -> np.ndarray:
    return x.values.to_numpy(zero_copy_only=False)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Up to HELD shards at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, HELD):
            yield [{c: batch[c][i] for c in batch.schema.names} for i in range(a, min(a + HELD, batch.num_rows))]


def statistics(index: DataFrame, items: Items) -> None:
    """Numbers of documents and words, and the documents of each of the items' terms, into items."""
    about = index.agg(F.sum("n_held").alias("n"), F.sum("n_words").alias("l")).first()
    terms = items.terms

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(terms), np.int64)
        for rows in rows_of(batches):
            for row in rows:
                at = pc.index_in(terms, row["terms"].values).fill_null(-1).to_numpy(zero_copy_only=False)
                starts = numbers(row["starts"])
                df[at >= 0] += (starts[at + 1] - starts[at])[at >= 0]
        has = np.flatnonzero(df)
        yield pa.record_batch([pa.array(has, pa.int32()), pa.array(df[has], pa.int64())], names=["k", "df"])

    found = index.select("terms", "starts").mapInArrow(count, "k int, df bigint").groupBy("k").agg(F.sum("df").alias("df"))
    items.settle(about["n"] or 0, about["l"] or 0, {r["k"]: r["df"] for r in found.collect()})  # a row for each term of the block


class Best:
    """For each item the TOP documents so far, and its least score worth having."""

    def __init__(self, least: np.ndarray, top: int):
        self.least, self.top = least.copy(), top
        self.score, self.id = [np.zeros(0)] * len(least), [np.zeros(0, np.int64)] * len(least)

    def add(self, item: int, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score[item], score]), np.concatenate([self.id[item], ids])
        first = np.lexsort((ids, -score))[: self.top]
        self.score[item], self.id[item] = score[first], ids[first]
        if len(first) == self.top:
            self.least[item] = max(self.least[item], score[first[-1]])


#: Stands for a null id in a task: behind all others.
NO_ID = np.iinfo(np.int64).max
FOUND = "item int, doc_id bigint, score bigint"


def visit(items: Items, least: np.ndarray, top: int, only: dict[int, list[int]] | None = None):
    """A task: its shards by falling bound, each scored for the items whose bound reaches their least score; only: items by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(least, top)
        for rows in rows_of(batches):
            bounds = [items.bounds(r) for r in rows]
            for k in sorted(range(len(rows)), key=lambda k: -bounds[k].max(initial=0)):
                which = np.flatnonzero((bounds[k] >= best.least) & (bounds[k] > 0))
                if only is not None:
                    which = np.intersect1d(which, only.get(rows[k]["shard"].as_py(), []))
                if not len(which):
                    continue
                ids = rows[k]["ids"].values.fill_null(NO_ID).to_numpy(zero_copy_only=False)
                scores = items.scores(rows[k], which)
                good = (scores >= best.least[which, None]) & (scores > 0)
                for x in np.flatnonzero(good.any(axis=1)):
                    best.add(int(which[x]), scores[x, good[x]], ids[good[x]])
        n = [len(s) for s in best.score]
        ids = np.concatenate([*best.id, np.zeros(0, np.int64)])
        yield pa.record_batch([pa.array(np.repeat(np.arange(len(n)), n), pa.int32()), pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(np.concatenate([*best.score, np.zeros(0)]).astype(np.int64))], names=["item", "doc_id", "score"])

    return run


def ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def seeds(index: DataFrame, items: Items) -> dict[int, list[int]]:
    """The SEEDS shards of the highest bounds for each item: items by shard."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, bound = np.zeros(0, np.int64), np.zeros((len(items.uses), 0))
        for rows in rows_of(batches):
            shard = np.concatenate([shard, [r["shard"].as_py() for r in rows]])
            bound = np.hstack([bound, np.array([items.bounds(r) for r in rows]).T])
            if bound.shape[1] > SEEDS:
                keep = np.unique(np.argpartition(-bound, SEEDS - 1, axis=1)[:, :SEEDS])
                shard, bound = shard[keep], bound[:, keep]
        item, col = np.nonzero(bound)
        yield pa.record_batch([pa.array(item, pa.int32()), pa.array(shard[col].astype(np.int64)), pa.array(bound[item, col].astype(np.int64))], names=["item", "shard", "bound"])

    order = Window.partitionBy("item").orderBy(F.desc("bound"), "shard")
    rows = index.drop("ids", "n_held", "n_words").mapInArrow(best, "item int, shard bigint, bound bigint")
    out: dict[int, list[int]] = {}
    for r in rows.withColumn("o", F.row_number().over(order)).filter(F.col("o") <= SEEDS).collect():  # SEEDS rows for each item of the block
        out.setdefault(r["shard"], []).append(r["item"])
    return out


def search(index: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of the `top` best documents for each row of items (item_id, text)."""
    with batches_of(index.sparkSession, BATCH_SHARDS):
        return _search(index, items, top)


def _search(index: DataFrame, items: DataFrame, top: int) -> DataFrame:
    out, asked = [], items.select("item_id", "text").toLocalIterator()
    spark = index.sparkSession
    while block := list(itertools.islice(asked, BLOCK)):
        own = Items([r["text"] for r in block])
        statistics(index, own)
        least = np.zeros(len(block))
        first = seeds(index, own)
        wanted = F.broadcast(spark.createDataFrame([(k,) for k in first], "shard bigint"))
        nearest = index.join(wanted, "shard", "left_semi").mapInArrow(visit(own, least, top, first), FOUND)
        for r in ranked(nearest, top).filter(F.col("rank") == top).select("item", "score").collect():  # a row an item at most
            least[r["item"]] = r["score"]
        found = ranked(index.mapInArrow(visit(own, least, top), FOUND), top)
        names = F.broadcast(spark.createDataFrame([(k, r["item_id"]) for k, r in enumerate(block)], f"item int, item_id {dict(items.dtypes)['item_id']}"))
        out.append(cut(found.join(names, "item").select("item_id", "rank", "doc_id", "score")))
    if not out:
        return spark.createDataFrame([], f"item_id {dict(items.dtypes)['item_id']}, rank int, doc_id bigint, score bigint")
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/search-{uuid.uuid4().hex}"
    return search(build(read(spark, sf_dir, "documents"), path), read(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH dw AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM documents
), tf AS (SELECT doc_id, term, count(*) AS tf FROM dw GROUP BY ALL),
dn AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY ALL),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM dn),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM df, s),
m AS (SELECT doc_id, 100 - 50 + ((50 * n * docs) // total) AS m FROM dn, s),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark
), r AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL
), o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 50
"""
