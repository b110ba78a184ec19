"""Removal of repeated passages, found by difference-cover anchors.

Runs of ANCHOR words are hashed only at places whose number modulo PERIOD is in COVER. COVER is a perfect difference
cover: for any two places there is a k < PERIOD with both place + k in it, so two equal windows of WINDOW = PERIOD +
ANCHOR - 1 words always share an anchor at one offset inside both. Anchors that occur again anywhere mark the windows
around them; only these are hashed in full (128 bits) and compared over the corpus, which extends each anchor match to
whole windows. Words covered by a window that starts elsewhere too are removed.

Both comparisons use packed keys (see packed.py): a passage in very many documents is sent once a group.

Rows are dealt to groups by id, text and place in the table, so that a million equal rows part too. docs must be a written
table or a projection of one, where places are the same in every run of a lost task.

Windows are compared by 128-bit hashes of their words. The texts are shuffled once; the three passes read that shuffle.

Defined cases: null and empty texts have no words and lose none; texts of fewer than WINDOW words lose none; windows
that repeat inside one document count, overlapping ones too; equal rows are documents of their own (each repeats the
other), with null ids as well; a null id is kept; a very long text is one row of one group; other columns are kept, but those
named like a result (n_words, n_removed, kept_sha256; case does not count) are replaced by it; an empty table gives no rows.
A text with removals becomes its kept words joined by one space.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, plain, read
from .packed import FORWARD, REPLY, Words, counts_of, dealt, forward, groups_for, replies, squeeze, unique

WINDOW, PERIOD = 35, 21
#: A perfect difference set modulo 21: every difference occurs exactly once.
COVER = (0, 1, 4, 14, 16)
ANCHOR = WINDOW - PERIOD + 1


def _anchors(w: Words) -> np.ndarray:
    """Numbers of the words at which an anchor starts."""
    at_cover = np.isin(np.arange(PERIOD), COVER)
    room = np.repeat(w.n, w.n) - w.pos
    return np.flatnonzero(at_cover[w.pos % PERIOD] & (room >= ANCHOR) & (np.repeat(w.n, w.n) >= WINDOW))


def _anchor_keys(w: Words, n: int):
    at = _anchors(w)
    return at, *unique(squeeze(w.runs(ANCHOR)[at], n))


def _candidates(w: Words, reply: pa.Table, n: int) -> np.ndarray:
    """Numbers of the words at which a window with a repeated anchor starts."""
    at, keys, local, where = _anchor_keys(w, n)
    hot = at[((counts_of(reply, keys, n, small=True) > 1) | (local > 1))[where]]
    mark = np.zeros(len(w.doc) + 1, np.int64)
    first = w.first[w.doc[hot]]
    last = first + w.n[w.doc[hot]] - WINDOW
    a, b = np.maximum(hot - PERIOD + 1, first), np.minimum(hot, last)
    ok = a <= b
    np.add.at(mark, a[ok], 1)
    np.add.at(mark, b[ok] + 1, -1)
    return np.flatnonzero(np.cumsum(mark[:-1]) > 0)


def _window_keys(w: Words, at: np.ndarray):
    return unique(w.runs(WINDOW)[at], w.runs(WINDOW, 1)[at])


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """docs with n_words and n_removed, and the shortened text; with digest, key, the two numbers and kept_sha256 only."""
    n = groups_for(docs, text)
    docs = docs.select(key, text) if digest else plain(docs, "n_words", "n_removed")
    group, place = fresh(docs, "g"), fresh(docs, "place")
    parts = dealt(docs.withColumn(place, F.monotonically_increasing_id()), [key, text, place], n, group).drop(place)
    names = [c for c in docs.columns if c != text]

    def first_pass(t: pa.Table) -> pa.Table:
        _, keys, _, _ = _anchor_keys(Words(t[text]), n)
        return forward(t[group][0].as_py(), keys, n, small=True)

    def second_pass(t: pa.Table, r: pa.Table) -> pa.Table:
        if not t.num_rows:
            return forward(0, [np.zeros(0, np.uint64)] * 2, n)
        w = Words(t[text], seeds=2)
        keys, _, _ = _window_keys(w, _candidates(w, r, n))
        return forward(t[group][0].as_py(), keys, n)

    def last_pass(t: pa.Table, r: pa.Table) -> pa.Table:
        w = Words(t[text], seeds=2)
        mine = {k: r.filter(pa.compute.equal(r["stage"], k)) for k in (1, 2)}
        at = _candidates(w, mine[1], n)
        keys, local, where = _window_keys(w, at)
        bad = at[((counts_of(mine[2], keys, n) > 1) | (local > 1))[where]]
        mark = np.zeros(len(w.doc) + 1, np.int64)
        np.add.at(mark, bad, 1)
        np.add.at(mark, bad + WINDOW, -1)
        gone = np.cumsum(mark[:-1]) > 0
        removed = np.bincount(w.doc[gone], minlength=t.num_rows)
        out = []
        for i, x in enumerate(t[text].to_pylist()):
            if not digest and not removed[i]:
                out.append(x)
                continue
            kept = (x or "").encode().split()
            if removed[i]:
                keep = ~gone[w.first[i] : w.first[i] + w.n[i]]
                kept = [kept[k] for k in np.flatnonzero(keep)]
            joined = b" ".join(kept)
            out.append(hashlib.sha256(joined).hexdigest() if digest else joined.decode())
        cols = [t[c] for c in names] + [pa.array(out, pa.string()), pa.array(w.n, pa.int64()), pa.array(removed, pa.int64())]
        return pa.table(cols, names=[*names, "kept_sha256" if digest else text, "n_words", "n_removed"])

    # all passes group the same frame, so that its shuffle is made once
    one = replies(parts.groupBy(group).applyInArrow(first_pass, FORWARD), 0)
    two = replies(parts.groupBy(group).cogroup(one.groupBy("g")).applyInArrow(second_pass, FORWARD), 2)
    told = one.withColumn("stage", F.lit(1)).unionByName(two.withColumn("stage", F.lit(2)))
    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in names] + [f"`{'kept_sha256' if digest else text}` string", "n_words bigint", "n_removed bigint"])
    return parts.groupBy(group).cogroup(told.groupBy("g")).applyInArrow(last_pass, schema)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read(spark, sf_dir, "documents"), digest=True).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(0, len(w) - 34)) AS i FROM d WHERE len(w) >= 35),
v AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 35], ' ') AS win FROM i),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY win) AS n FROM v),
p AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM c WHERE n > 1),
x AS (SELECT d.doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM d WHERE doc_id IN (SELECT doc_id FROM p)),
k AS (
  SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.p) FILTER (p.p IS NULL) AS kept, count(p.p) AS n_removed
  FROM x LEFT JOIN p ON x.doc_id = p.doc_id AND x.p = p.p GROUP BY x.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN k.doc_id IS NULL THEN array_to_string(w, ' ') ELSE coalesce(kept, '') END) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
