"""Phrase collocation mining over packed word ids.

1. Words are counted by lang; those that stand MIN_COUNT times in their lang get ids from 1 on (a word of two langs gets two).
2. Texts are encoded: pieces end at rare words too, as no candidate holds one. Each word that has a frequent word after it gives a
   key of MOST words: ids of 32 bits, zeros behind the piece's end. A task sorts its keys (radix, 16 bits a pass; planes
   that are all one value are left out), counts equal ones and cuts them at the borders of key ranges: a block a range.
3. A range sorts the keys of its blocks in the same way. Runs of equal prefixes are the counts of phrases of 2 to MOST words.
   A run inside the range is whole; the runs of its first and last key may go on next door, and are summed.
   A frequent pair of words spreads over as many ranges as its keys need, and a frequent key is one entry a chunk.
4. Candidates look up the counts of the two parts of each cut; decimals of 38 digits hold the products.

The borders of the ranges are quantiles of keys in a sample of SAMPLE_BYTES of text; they decide how even the ranges are, not
what is counted. The dictionary is broadcast up to DICT_BYTES; beyond it documents are dealt to groups, whose distinct
words are joined with the dictionary (a row for each word of a group) and met with the group's texts again.

Defined cases: null and empty texts have no words; a null lang is `und`, as is the lang of that name; each row counts, repeated
ones too; a very long text is cut into steps only between texts; other columns are not read; an empty table, or one without
a word that stands MIN_COUNT times, gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, read
from .packed import FOLD, dealt, groups_for

MIN_COUNT, MOST, TOP = 100, 5, 2000
DICT_BYTES = 64 << 20
#: Text of one numpy step, of the sample for borders, and keys of one range.
STEP, SAMPLE_BYTES, RANGE_KEYS = 8 << 20, 32 << 20, 2 << 20
BREAK, GAP = (10, 11, 12, 13, 33, 44, 46, 58, 59, 63), (9, 32)
#: What each byte is: 0 of a word, 1 between words, 2 between pieces.
KIND = np.zeros(256, np.uint8)
KIND[list(GAP)], KIND[list(BREAK)] = 1, 2
COUNTED, BLOCKS, RUNS = "lang string, word string, n bigint", "r int, keys binary, counts binary", "key binary, len int, a bigint"


class Pieces:
    """The words of texts: word (a pa.Array of distinct ones), code (of each place), lang (number in langs) and joined (the next place is in the same piece)."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        texts = texts.fill_null("").cast(pa.large_string())
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
        data = FOLD[np.insert(data, (off - off[0])[1:-1], 10)]  # a text ends a piece
        kind = KIND[data]
        inside = kind == 0
        edge = np.diff(np.concatenate([[False], inside, [False]]).view(np.int8))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        breaks = np.concatenate([[0], np.cumsum(kind == 2, dtype=np.int32)])
        self.joined = np.zeros(len(start), bool)
        self.joined[:-1] = breaks[start[1:]] == breaks[end[:-1]]
        at = np.concatenate([[0], np.cumsum(end - start)])
        words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data[inside])]).dictionary_encode()
        self.word, self.code = words.dictionary, words.indices.to_numpy(zero_copy_only=False)
        begin = (off[:-1] - off[0]) + np.arange(len(texts))
        first = np.searchsorted(start, begin)
        coded = langs.fill_null("und").dictionary_encode()
        self.langs = coded.dictionary
        self.lang = np.repeat(coded.indices.to_numpy(zero_copy_only=False), np.diff(np.append(first, len(start))))


def steps(table: pa.Table | pa.RecordBatch, size: int | None = None) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Texts and langs of about `size` bytes at a time."""
    t = pa.table(table).combine_chunks() if isinstance(table, pa.Table) else table
    texts, langs = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (t["text"], t["lang"]))
    sizes = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0)
    a = 0
    while a < len(texts):
        done = sizes[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(sizes, done + (size or STEP), "right")))
        yield texts[a:b], langs[a:b]
        a = b


def word_pairs(p: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (lang, word) of the pieces: their numbers, and the count of each."""
    both, n = np.unique(p.lang.astype(np.int64) * len(p.word) + p.code, return_counts=True) if len(p.code) else (np.zeros(0, np.int64),) * 2
    return both // max(len(p.word), 1), both % max(len(p.word), 1), n


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts, langs in steps(batch):
            p = Pieces(texts, langs)
            lang, word, n = word_pairs(p)
            yield pa.record_batch([p.langs.take(pa.array(lang)).cast(pa.string()), p.word.take(pa.array(word)).cast(pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], names=["lang", "word", "n"])


def radix(keys: np.ndarray) -> np.ndarray:
    """Order of the rows of 32-bit unsigned numbers: by stable passes of 16 bits, the last column's low half first."""
    order = np.arange(len(keys))
    for c in range(keys.shape[1] - 1, -1, -1):
        for half in (0, 16):
            digit = (keys[:, c] >> np.uint32(half)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def runs(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sum of each one's numbers."""
    order = radix(keys)
    keys, n = keys[order], n[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
    at = np.flatnonzero(new)
    return keys[at], np.add.reduceat(n, at) if len(at) else n


def grams(p: Pieces, ids: np.ndarray) -> np.ndarray:
    """Keys of the places that a frequent word follows; ids: a number for each place, 0 for rare words."""
    known = ids > 0
    on = np.zeros(len(ids), bool)
    on[:-1] = p.joined[:-1] & known[:-1] & known[1:]
    at = np.flatnonzero(on)
    keys = np.zeros((len(at), MOST), np.uint32)
    padded = np.concatenate([ids, np.zeros(MOST, ids.dtype)])
    on = np.concatenate([on, np.zeros(MOST, bool)])
    keys[:, 0] = ids[at]
    go = np.ones(len(at), bool)
    for k in range(1, MOST):
        go &= on[at + k - 1]
        keys[:, k] = np.where(go, padded[at + k], 0)
    return keys


def _bytes(keys: np.ndarray) -> np.ndarray:
    """Big-endian rows, which sort as the keys."""
    return np.ascontiguousarray(keys.astype(">u4")).view(f"S{4 * MOST}").ravel()


def blocks(keys: np.ndarray, borders: np.ndarray) -> pa.RecordBatch:
    """Keys of a step, sorted, counted and cut at the borders."""
    keys, n = runs(keys, np.ones(len(keys), np.uint32))
    packed = _bytes(keys)
    cuts = np.concatenate([[0], np.searchsorted(packed, borders), [len(keys)]]) if len(borders) else np.array([0, len(keys)])
    has = np.flatnonzero(np.diff(cuts))
    # columns lie one after another, as equal high bytes compress well
    body = [np.ascontiguousarray(keys[cuts[r] : cuts[r + 1]].T).tobytes() for r in has]
    return pa.record_batch([pa.array(has, pa.int32()), pa.array(body, pa.binary()), pa.array([n[cuts[r] : cuts[r + 1]].astype(np.uint32).tobytes() for r in has], pa.binary())], names=["r", "keys", "counts"])


def phrases(t: pa.Table, least: int) -> pa.Table:
    """One range: its phrases of 2 to MOST words that stand `least` times, and those at its ends whatever their number."""
    keys = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32).reshape(MOST, -1).T for x in t["keys"]])
    n = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in t["counts"]]).astype(np.int64)
    keys, n = runs(keys, n)
    new, out = np.zeros(len(keys), bool), []
    new[0] = True
    new[1:] = keys[1:, 0] != keys[:-1, 0]
    for k in range(1, MOST):
        new[1:] |= keys[1:, k] != keys[:-1, k]
        at = np.flatnonzero(new)
        a = np.add.reduceat(n, at)
        has = (keys[at, k] > 0) & ((a >= least) | (at == 0) | (at == at[-1]))
        found = keys[at[has]].copy()
        found[:, k + 1 :] = 0
        out.append((_bytes(found), np.full(len(found), k + 1), a[has]))
    raw = np.concatenate([x[0] for x in out]) if out else np.zeros(0, f"S{4 * MOST}")
    body = pa.Array.from_buffers(pa.binary(4 * MOST), len(raw), [None, pa.py_buffer(raw.tobytes())]).cast(pa.binary())
    return pa.table([body, pa.array(np.concatenate([x[1] for x in out]), pa.int32()), pa.array(np.concatenate([x[2] for x in out]), pa.int64())], names=["key", "len", "a"])


class Dictionary:
    """Ids of the frequent words, by lang; held whole in a task where it is small enough to be broadcast."""

    def __init__(self, lang: pa.Array, word: pa.Array, ids: np.ndarray):
        self.langs, self.words = pc.unique(lang), pc.unique(word)
        at = pc.index_in(lang, self.langs).to_numpy(zero_copy_only=False).astype(np.int64) * len(self.words) + pc.index_in(word, self.words).to_numpy(zero_copy_only=False)
        order = np.argsort(at)
        self.at, self.ids = at[order], ids[order]

    def of(self, p: Pieces) -> np.ndarray:
        """The id of each place's word; 0: rare."""
        if not len(self.at) or not len(p.code):
            return np.zeros(len(p.code), np.uint32)
        lang, word, _ = word_pairs(p)
        x = pc.index_in(p.langs, self.langs).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)[lang]
        y = pc.index_in(p.word.cast(pa.binary()), self.words).fill_null(-1).to_numpy(zero_copy_only=False)[word]
        key = x * len(self.words) + y
        where = np.minimum(np.searchsorted(self.at, key), len(self.at) - 1)
        found = np.where((x >= 0) & (y >= 0) & (self.at[where] == key), self.ids[where], 0).astype(np.uint32)
        pair = lang * len(p.word) + word  # ascending
        return found[np.searchsorted(pair, p.lang.astype(np.int64) * len(p.word) + p.code)]


def dictionary_of(t: pa.Table) -> Dictionary:
    t = t.combine_chunks()
    flat = lambda c, kind: pa.concat_arrays([x.cast(kind) for x in t[c].chunks]) if t.num_rows else pa.array([], kind)
    return Dictionary(flat("lang", pa.string()), flat("word", pa.string()).cast(pa.binary()), t["id"].to_numpy().astype(np.uint32))


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word and n over all texts."""
    return docs.select("text", "lang").mapInArrow(counted, COUNTED).groupBy("lang", "word").agg(F.sum("n").alias("n"))


def numbered(words: DataFrame) -> DataFrame:
    """words with id from 1 on, by lang and word: each range of them is numbered from the count of those before it."""
    ranged = cut(words.repartitionByRange("lang", "word").sortWithinPartitions("lang", "word").withColumn("_p", F.spark_partition_id()))
    sizes = {r["_p"]: r["count"] for r in ranged.groupBy("_p").count().collect()}  # a number for each partition
    before, first = 1, {}
    for p in sorted(sizes):
        first[p] = before
        before += sizes[p]
    if before > 1 << 32:
        raise ValueError("ids have 32 bits: raise min_count")
    begins = F.broadcast(docs_of(ranged, [(p, n) for p, n in first.items()]))
    row = F.row_number().over(Window.partitionBy("_p").orderBy("lang", "word"))
    return ranged.join(begins, "_p").select("lang", "word", "n", (F.col("first") + row - 1).cast("long").alias("id"))


def docs_of(like: DataFrame, rows: list[tuple[int, int]]) -> DataFrame:
    return like.sparkSession.createDataFrame(rows, "_p int, first long")


def encoded(docs: DataFrame, words: DataFrame, size: int) -> Callable[[Callable, str], DataFrame]:
    """A function that runs over steps of (pieces, ids): by a broadcast dictionary of `size` bytes, or by groups that ask for their own words."""
    if size <= DICT_BYTES:
        held = docs.sparkSession.sparkContext.broadcast(dictionary_of(words.select("lang", "word", "id").toArrow()))

        def over(f: Callable, schema: str) -> DataFrame:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for texts, langs in steps(batch):
                        p = Pieces(texts, langs)
                        yield f(p, held.value.of(p))

            return docs.mapInArrow(run, schema)

        return over

    n = groups_for(docs, of=STEP)
    parts = dealt(docs.withColumn("_r", F.monotonically_increasing_id()), ["text", "_r"], n).drop("_r")

    def asked(t: pa.Table) -> pa.Table:
        out = []
        for texts, langs in steps(t):
            p = Pieces(texts, langs)
            lang, word, _ = word_pairs(p)
            out.append(pa.table([pa.array([t["g"][0].as_py()] * len(lang), pa.int32()), p.langs.take(pa.array(lang)).cast(pa.string()), p.word.take(pa.array(word)).cast(pa.binary()).cast(pa.string())], names=["g", "lang", "word"]))
        return pa.concat_tables(out)

    told = parts.groupBy("g").applyInArrow(asked, "g int, lang string, word string").distinct().join(words.select("lang", "word", "id"), ["lang", "word"])

    def over_groups(f: Callable, schema: str) -> DataFrame:
        def run(t: pa.Table, r: pa.Table) -> pa.Table:
            own = dictionary_of(r)
            return pa.Table.from_batches([f(p, own.of(p)) for p in (Pieces(*x) for x in steps(t))] or [f(Pieces(pa.array([], pa.string()), pa.array([], pa.string())), np.zeros(0, np.uint32))])

        return parts.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(run, schema)

    return over_groups


def borders_of(docs: DataFrame, words: DataFrame, total: int, size: int, n_keys: int) -> np.ndarray:
    """Borders of ranges of about RANGE_KEYS keys, from keys of a sample of the texts: at most SAMPLE_BYTES of them and 2**16 keys."""
    n = math.ceil(n_keys / RANGE_KEYS)
    if n < 2:
        return np.zeros(0, f"S{4 * MOST}")
    share = min(1.0, SAMPLE_BYTES / max(total, 1))
    some = docs.sample(fraction=share, seed=11) if share < 1 else docs
    every = max(1, int(n_keys * share) >> 15)

    def pick(p: Pieces, ids: np.ndarray) -> pa.RecordBatch:
        keys = grams(p, ids)
        got = _bytes(keys[np.random.default_rng(len(keys)).random(len(keys)) * every < 1])
        return pa.record_batch([pa.Array.from_buffers(pa.binary(4 * MOST), len(got), [None, pa.py_buffer(got.tobytes())]).cast(pa.binary())], names=["key"])

    raw = encoded(some, words, size)(pick, "key binary").limit(1 << 16).toArrow()["key"]
    keys = np.sort(np.array([x.as_py() for x in raw], dtype=f"S{4 * MOST}"))
    return np.unique(keys[(np.arange(1, n) * len(keys)) // n]) if len(keys) else keys


def lookups(cand: DataFrame, words: DataFrame) -> DataFrame:
    """cand with n, and for each its lowest-scoring cut: k, l, r and score."""
    def part(first: object, size: object) -> object:
        return F.rpad(F.substr(F.col("key"), first, size), 4 * MOST, F.lit(b"\x00"))

    known = cand.select("key", "a").unionByName(words.select(F.rpad(F.to_binary(F.lpad(F.hex("id"), 8, "0"), F.lit("hex")), 4 * MOST, F.lit(b"\x00")).alias("key"), F.col("n").alias("a")))
    cuts = cand.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("len") - 1)))
    cuts = cuts.withColumns({"one": part(F.lit(1), 4 * F.col("k")), "two": part(4 * F.col("k") + 1, 4 * (F.col("len") - F.col("k")))})
    cuts = cuts.join(known.select(F.col("key").alias("one"), F.col("a").alias("l")), "one").join(known.select(F.col("key").alias("two"), F.col("a").alias("r")), "two")
    wide = "decimal(19,0)"
    score = F.expr(f"(cast(1000 * a as {wide}) * cast(n as {wide})) div (cast(l as {wide}) * cast(r as {wide}))")
    best = cuts.withColumn("score", score).groupBy("key").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"), F.first("lang").alias("lang"), F.first("n").alias("n"), F.first("len").alias("len"), F.first("a").alias("a"))
    return best.select("key", "lang", "len", "a", "n", "b.score", "b.k", "b.l", "b.r")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """The first `top` phrases of each lang: lang, rank, phrase, a, l, r, n, score."""
    docs = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    all_words = cut(word_counts(docs))
    totals = cut(all_words.groupBy("lang").agg(F.sum("n").alias("n")))  # a row a lang
    words = cut(numbered(all_words.filter(F.col("n") >= min_count)))
    about = words.agg(F.sum(F.octet_length("word") + F.octet_length("lang") + 16).alias("bytes"), F.sum("n").alias("n")).first()
    size, n_keys = about["bytes"] or 0, about["n"] or 0
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    over = encoded(docs, words, size)
    borders = borders_of(docs, words, total, size, n_keys)
    dealt_keys = over(lambda p, ids: blocks(grams(p, ids), borders), BLOCKS)
    found = dealt_keys.groupBy("r").applyInArrow(lambda t: phrases(t, min_count), RUNS)
    found = found.groupBy("key", "len").agg(F.sum("a").alias("a")).filter(F.col("a") >= min_count)
    langs = words.groupBy("lang").agg(F.min("id").alias("first"), F.max("id").alias("last")).join(totals, "lang")
    id_at = lambda k: F.conv(F.hex(F.substr(F.col("key"), k, F.lit(4))), 16, 10).cast("long")
    lead = id_at(F.lit(1))
    cand = cut(found.withColumn("lead", lead).join(F.broadcast(langs), F.col("lead").between(F.col("first"), F.col("last"))).select("key", "len", "a", "lang", "n"))

    # a phrase of one word more with the same count takes its two parts with it; longer ones do so by steps
    longer = cand.filter("len > 2").select("a", "len", F.explode(F.array(
        F.rpad(F.substr(F.col("key"), F.lit(1), 4 * (F.col("len") - 1)), 4 * MOST, F.lit(b"\x00")), F.rpad(F.substr(F.col("key"), F.lit(5), 4 * (F.col("len") - 1)), 4 * MOST, F.lit(b"\x00")))).alias("key"))
    kept = cand.join(longer.select("key", "a").distinct(), ["key", "a"], "left_anti")
    scored = lookups(cand, words).join(kept.select("key"), "key", "left_semi")
    # ties at the border stay until the phrases are spelled
    near = scored.withColumn("at", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).filter(F.col("at") <= top)
    spelled = near.withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("len") - 1)))
    spelled = spelled.withColumn("id", id_at(4 * F.col("pos") + 1)).join(words.select("id", "word"), "id")
    ranked = spelled.groupBy("key", "lang", "a", "n", "score", "l", "r").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return ranked.withColumn("rank", place.cast("long")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, w, unnest(range(0, len(w) - k + 1)) AS i FROM w, range(1, 6) AS s(k) WHERE len(w) >= k),
f AS (SELECT lang, k, array_to_string(w[i + 1 : i + k], ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
x AS (SELECT lang, k, phrase, a, w, unnest(range(1, k)) AS cut FROM c),
y AS (
  SELECT x.lang, x.k, x.phrase, a, cut, l.f AS l, r.f AS r, n, CAST(1000 * CAST(a AS HUGEINT) * n // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM x JOIN f l ON l.lang = x.lang AND l.k = cut AND l.phrase = array_to_string(w[1 : cut], ' ')
  JOIN f r ON r.lang = x.lang AND r.k = x.k - cut AND r.phrase = array_to_string(w[cut + 1 : x.k], ' ') JOIN t ON t.lang = x.lang
), b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase, k ORDER BY score, cut) AS o FROM y),
d AS (
  SELECT DISTINCT s.lang, s.phrase FROM c s JOIN c l ON l.lang = s.lang AND l.k > s.k AND 100 * l.a >= 100 * s.a
    AND contains(' ' || l.phrase || ' ', ' ' || s.phrase || ' ')
), z AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
  FROM b WHERE o = 1 AND NOT EXISTS (SELECT 1 FROM d WHERE d.lang = b.lang AND d.phrase = b.phrase)
)
SELECT * FROM z WHERE rank <= 2000
"""
