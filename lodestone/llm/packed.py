"""Which keys of a corpus occur again elsewhere, at about eight bytes of shuffle a key.

Documents are dealt to groups by a hash of their id and text. Each group sorts the distinct keys of its documents and sends one
block of packed keys to every range of the key space (forward). A range compares its blocks and sends back, in the order of
each block, how many groups have each key (reply). The group computes its keys again from the same documents and reads the
answer by position. A key that is frequent within a group is sent once, so a hot key costs one entry a group, never one a
row; nothing is collected on the driver.

Hashes are computed on whole Arrow columns with numpy; texts stay UTF-8 bytes. A word's hash is the sum of one random number
for each of its bytes, drawn by the byte and its place (tabulation), so no pattern of words makes hashes equal by design; a
run's hash is a polynomial over the hashes of its words.

Defined cases: null and empty texts have no words; a group without any key sends nothing and hears nothing; rows equal in id
and text (and null ids with equal texts) are dealt to one group, all others apart, unless the caller deals by the row's place too.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
U = np.uint64
#: Text of one group and one numpy step, in bytes.
GROUP_BYTES, STEP = 4 << 20, 1 << 18
_MASK = (1 << 64) - 1
_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Places of a word whose random numbers stand in a table; those of later places are mixed when needed.
PLACES = 64
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_drawn = [np.random.default_rng(97 + i).integers(0, 1 << 64, PLACES << 8, dtype=np.uint64, endpoint=False) for i in range(2)]


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverses modulo 2**64, for i < n at least."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(n, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b & _MASK, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        _powers[base] = both[0], both[1]
    return _powers[base]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


class Words:
    """Words of a column of texts: n (a text), first (word number where a text begins), doc and pos (a word), hashes."""

    def __init__(self, column: pa.ChunkedArray | pa.Array, fold: bool = False, seeds: int = 1):
        texts = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.large_string())
        texts = texts.fill_null("").cast(pa.large_string())
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
        off = off - off[0]
        if fold:
            data = FOLD[data]
        self.buf = np.insert(data, off[1:-1], 10) if len(texts) > 1 else data
        begin = off[:-1] + np.arange(len(texts))
        edge = np.diff(np.concatenate([[False], ~SPACE[self.buf], [False]]).view(np.int8))
        kind = np.int32 if len(self.buf) < 1 << 31 else np.int64
        self.start, self.end = np.flatnonzero(edge == 1).astype(kind), np.flatnonzero(edge == -1).astype(kind)
        del edge
        self.first = np.searchsorted(self.start, begin)
        self.n = np.diff(np.append(self.first, len(self.start)))
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), self.n)
        self.pos = np.arange(len(self.start), dtype=kind) - np.repeat(self.first.astype(kind), self.n)
        self.hashes = [self._hash(s) for s in range(seeds)]

    def _hash(self, seed: int) -> np.ndarray:
        out = np.empty(len(self.start), np.uint64)
        drawn, a = _drawn[seed], 0
        while a < len(out):
            lo = self.start[a]
            b = max(a + 1, int(np.searchsorted(self.end, lo + STEP, "right")))
            s, e = self.start[a:b] - lo, self.end[a:b] - lo
            size = int(e[-1])
            place = np.arange(size, dtype=s.dtype) - np.repeat(s, np.diff(np.append(s, s.dtype.type(size))))
            at = (np.minimum(place, PLACES) << 8) | self.buf[lo : lo + size]
            value = drawn[np.minimum(at, len(drawn) - 1)]
            late = np.flatnonzero(place >= PLACES)
            if len(late):
                far = (place[late].astype(np.uint64) << U(8)) | self.buf[lo : lo + size][late]
                value[late] = mix(mix(far + U(_BASE[seed])) + U(_BASE[1 - seed]))
            sums = np.zeros(size + 1, np.uint64)
            np.cumsum(value, out=sums[1:])
            out[a:b] = mix(sums[e] - sums[s] + (e - s).astype(np.uint64) * U(_BASE[seed]))
            a = b
        return out

    def runs(self, k: int, seed: int = 0) -> np.ndarray:
        """Hash of k words from each word on; without meaning where a text has fewer left."""
        h = self.hashes[seed]
        out = np.zeros(len(h), np.uint64)
        step = max(STEP // 8, 4 * k)
        for a in range(0, max(len(h) - k + 1, 0), step):
            x = h[a : a + step + k - 1]
            p, q = powers(_BASE[seed], len(x) + 1)
            sums = np.zeros(len(x) + 1, np.uint64)
            np.cumsum(x * p[: len(x)], out=sums[1:])
            m = len(x) - k + 1
            out[a : a + m] = mix((sums[k:] - sums[: m]) * q[:m] + U(k))
        return out


def groups_for(docs: DataFrame, text: str = "text", of: int = GROUP_BYTES) -> int:
    """Number of groups: about `of` bytes of text each; with many groups larger ones, as blocks number their square."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(1, math.ceil(total / min(max(of, math.isqrt(total) * 16), 32 * of)))


def ranges_of(key: np.ndarray, n: int) -> np.ndarray:
    """Number of the range of the key space, ascending with the key."""
    return ((key >> U(32)) * U(n) >> U(32)).astype(np.int64)


#: Bytes of a squeezed key within its range.
SMALL = 4


def squeeze(key: np.ndarray, n: int) -> np.ndarray:
    """Keys with all but the range and SMALL bytes left out, ascending by range: for questions where a key that seems to
    occur again and doesn't does no harm."""
    return (ranges_of(key, n).astype(np.uint64) << U(8 * SMALL)) | (key & U((1 << 8 * SMALL) - 1))


def unique(*key: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Sorted distinct keys of one or two columns, the number of each, and where each input row's key is among them."""
    order = np.argsort(key[0], kind="stable") if len(key) == 1 else np.lexsort(key[::-1])
    s = [k[order] for k in key]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([x[1:] != x[:-1] for x in s], axis=0)
    at = np.flatnonzero(new)
    where = np.empty(len(order), np.int64)
    where[order] = np.cumsum(new) - 1
    return [x[at] for x in s], np.diff(np.append(at, len(order))), where


FORWARD = "range int, g int, keys binary"
REPLY = "g int, range int, flags binary, counts binary"
FORWARD_ARROW = pa.schema([("range", pa.int32()), ("g", pa.int32()), ("keys", pa.binary())])
REPLY_ARROW = pa.schema([("g", pa.int32()), ("range", pa.int32()), ("flags", pa.binary()), ("counts", pa.binary())])


def _range(keys: list[np.ndarray], n: int, small: bool) -> np.ndarray:
    return (keys[0] >> U(8 * SMALL)).astype(np.int64) if small else ranges_of(keys[0], n)


def forward(g: int, keys: list[np.ndarray], n: int, small: bool = False) -> pa.Table:
    """Blocks of the sorted distinct keys, one for each range that has any; small: keys are squeezed."""
    r = _range(keys, n, small)
    which, at = np.unique(r, return_index=True)
    ends = np.append(at, len(r))[1:]
    rows = np.stack(keys, axis=1) if len(keys) > 1 else keys[0]
    if small:
        rows = rows.view(np.uint8).reshape(-1, 8)[:, :SMALL]
    blocks = [rows[a:b].tobytes() for a, b in zip(at, ends, strict=True)]
    return pa.table([pa.array(which, pa.int32()), pa.array([g] * len(which), pa.int32()), pa.array(blocks, pa.binary())], schema=FORWARD_ARROW)


def answer(blocks: pa.Table, width: int) -> pa.Table:
    """For each block: a bit a key, set if another block has it; for those the number of blocks, up to 65535. Width: columns
    of a key, 0 for squeezed keys."""
    raw = []
    for x in blocks["keys"]:
        block = np.frombuffer(x.as_buffer(), np.uint8)
        if width == 0:
            full = np.zeros((len(block) // SMALL, 8), np.uint8)
            full[:, :SMALL] = block.reshape(-1, SMALL)
            raw.append(full.view(np.uint64))
        else:
            raw.append(block.view(np.uint64).reshape(-1, width))
    width = max(width, 1)
    every = np.concatenate(raw) if raw else np.zeros((0, width), np.uint64)
    _, count, where = unique(*[every[:, i] for i in range(width)])
    count, flags, counts, a = np.minimum(count[where], 65535), [], [], 0
    for x in raw:
        c = count[a : a + len(x)]
        a += len(x)
        flags.append(np.packbits(c > 1).tobytes())
        counts.append(c[c > 1].astype(np.uint16).tobytes())
    return pa.table([blocks["g"], blocks["range"], pa.array(flags, pa.binary()), pa.array(counts, pa.binary())], schema=REPLY_ARROW)


def replies(blocks: DataFrame, width: int) -> DataFrame:
    return blocks.groupBy("range").applyInArrow(lambda t: answer(t, width), REPLY)


def counts_of(reply: pa.Table, keys: list[np.ndarray], n: int, small: bool = False) -> np.ndarray:
    """How many groups have each of the sorted distinct keys."""
    out = np.ones(len(keys[0]), np.int64)
    r = _range(keys, n, small)
    rows = {x["range"]: x for x in reply.to_pylist()}
    which, at = np.unique(r, return_index=True)
    for k, a, b in zip(which, at, np.append(at, len(r))[1:], strict=True):
        flag = np.unpackbits(np.frombuffer(rows[int(k)]["flags"], np.uint8), count=b - a).astype(bool)
        part = out[a:b]
        part[flag] = np.frombuffer(rows[int(k)]["counts"], np.uint16)
    return out


def dealt(docs: DataFrame, columns: list[str], n: int, group: str = "g") -> DataFrame:
    """docs with the column group: that of each row, by a hash of the columns."""
    return docs.withColumn(group, F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int"))
