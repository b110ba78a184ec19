"""N-gram Jaccard join by grouped prefixes, to connected components.

1. Sets of hashed word shingles are made a group of documents at a time; a packed exchange (packed.py) tells how often each
   shingle occurs. Shingles of one document only can't be shared, so a document keeps its others ("core"), rarest first.
   A document with fewer than 75 % of such shingles can't link with a different set.
2. Documents of equal sets are one representative, whose id is their smallest.
3. With all shingles ordered by frequency, two linked sets share one of their first n - ceil(0.75 n) + 1. Representatives
   with identical prefixes and size become one group, and an inverted index from prefix shingles to groups gives candidate
   groups, which size and position bounds filter.
4. Links only matter by what they connect. Members are first verified against a pivot, the member with the fewest unshared
   shingles in a posting list; then, pivot rounds later, whatever lies in one posting list but in different components is
   compared in full, so no component misses a link, while a large group of near copies costs about one comparison a member.
   Posting lists and groups that are still split are joined in blocks of about BLOCK members, so none is one task's work.

Sets are compared by 64-bit shingle hashes. Defined cases: null and empty texts have empty sets and are alone, their
component_id being their own id; texts of fewer than SHINGLE words have one shingle; equal rows are one set; a document with a
null id links like any other and its component_id is the smallest id of its component that is not null, null if there is none;
a very long text is one row of one group; other columns are not read, so none can clash; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, kept, read, release
from .packed import FORWARD, U, Words, counts_of, dealt, forward, groups_for, mix, replies, squeeze, unique

SHINGLE, PERCENT = 5, 75
PIVOT_ROUNDS = 2
#: Members of a posting list or group in one block of its self-join, about.
BLOCK = 1000


class Sets:
    """Distinct shingles of each text: doc and hash, sorted by text and hash; n and two sums that identify a set."""

    def __init__(self, column: pa.ChunkedArray):
        w = Words(column, fold=True)
        room = np.repeat(w.n, w.n) - w.pos
        h = w.runs(SHINGLE)
        at = np.flatnonzero(room >= SHINGLE)
        docs, hashes = [w.doc[at]], [h[at]]
        del h, at, room
        for k in range(1, SHINGLE):
            short = w.first[w.n == k]
            if len(short):
                docs.append(w.doc[short])
                hashes.append(w.runs(k)[short])
        d, h = np.concatenate(docs), np.concatenate(hashes)
        del docs, hashes
        order = np.lexsort((h, d))
        d, h = d[order], h[order]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
        self.doc, self.hash = d[new], h[new]
        self.n = np.bincount(self.doc, minlength=len(w.n))
        self.end = np.cumsum(self.n)
        self.sums = []
        for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
            run = np.zeros(len(self.hash) + 1, np.uint64)
            np.cumsum(mix(self.hash ^ U(c)), out=run[1:])
            self.sums.append((run[self.end] - run[self.end - self.n]).view(np.int64))


def least(n: np.ndarray | int):
    """Smallest overlap of a set of n with any set it links to."""
    return -(-PERCENT * n // 100)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """docs: k, t. k, n, s1, s2 (the set's identity) and, for sets that might link, core: shared shingles, rarest first."""
    n_groups = groups_for(docs, "t")
    parts = dealt(docs, ["k", "t"], n_groups)

    def ask(t: pa.Table) -> pa.Table:
        keys, _, _ = unique(squeeze(Sets(t["t"]).hash, n_groups))
        return forward(t["g"][0].as_py(), keys, n_groups, small=True)

    def tell(t: pa.Table, r: pa.Table) -> pa.Table:
        s = Sets(t["t"])
        keys, local, where = unique(squeeze(s.hash, n_groups))
        groups = counts_of(r, keys, n_groups, small=True)
        shared, freq = ((groups > 1) | (local > 1))[where], groups[where]
        order = np.lexsort((s.hash, freq, s.doc))
        order = order[shared[order]]
        m = np.bincount(s.doc[order], minlength=len(s.n))
        ok = (m >= least(s.n)) & (s.n > 0)
        _, seen = np.unique(np.stack([s.sums[0], s.sums[1], s.n], axis=1), axis=0, return_index=True)
        once = np.zeros(len(s.n), bool)
        once[seen] = True
        ok &= once
        flat = s.hash.view(np.int64)[order]
        take = np.repeat(ok, m)
        sizes = np.where(ok, m, 0)
        core = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(flat[take], pa.int64()), mask=pa.array(~ok))
        return pa.table({"k": t["k"], "n": pa.array(s.n, pa.int64()), "s1": pa.array(s.sums[0]), "s2": pa.array(s.sums[1]), "core": core})

    answers = replies(parts.groupBy("g").applyInArrow(ask, FORWARD), 0)
    kind = dict(docs.dtypes)["k"]
    return parts.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(tell, f"k {kind}, n bigint, s1 bigint, s2 bigint, core array<bigint>")


def enough(a: Column, b: Column) -> Column:
    """Overlap that two sets of these sizes need for a link."""
    return F.ceil(PERCENT * (a + b) / (100 + PERCENT))


def verified(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Of pairs (a, b and other columns) those that link."""
    one = reps.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("core").alias("ca"))
    two = reps.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("core").alias("cb"))
    both = pairs.join(one, "a").join(two, "b").withColumn("x_", F.size(F.array_intersect("ca", "cb")))
    return both.filter(100 * F.col("x_") >= PERCENT * (F.col("na") + F.col("nb") - F.col("x_"))).select(pairs.columns)


def components(label: DataFrame, links: DataFrame) -> DataFrame:
    """label: rep and comp so far; links: pairs (x, y) of different comps. rep and comp with the links added.

    The smallest labels of the components that links connect spread with pointer jumping; each round is kept, and only components
    with a link take part."""
    links, n = kept(links.distinct())
    if not n:
        return label
    edges, _ = kept(links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    root = edges.groupBy("x").agg(F.least("x", F.min("y")).alias("m"))
    root, open_ = kept(root)
    while open_:
        near = edges.join(root.select(F.col("x").alias("y"), F.col("m").alias("my")), "y").groupBy("x").agg(F.min("my").alias("near"))
        step = root.join(near, "x").select("x", F.col("m").alias("was"), F.least("m", "near").alias("to"))
        jump = root.select(F.col("x").alias("to"), F.col("m").alias("of_to"))
        root, open_ = kept(step.join(jump, "to", "left").select("x", F.least("to", "of_to").alias("m"), "was"), "m <> was")
        root = root.select("x", "m")
    named = root.select(F.col("x").alias("comp"), "m")
    return kept(label.join(named, "comp", "left").select("rep", F.coalesce("m", "comp").alias("comp")))[0]


def compatible() -> Column:
    """Size bound on na, nb."""
    return 100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb")


def prefix_of() -> Column:
    """The shared shingles among the first n - ceil(0.75 n) + 1; null if there are none."""
    size = (F.col("n") - F.ceil(PERCENT * F.col("n") / 100) + 1 - (F.col("n") - F.size("core"))).cast("int")
    return F.when(size > 0, F.slice("core", F.lit(1), F.greatest(size, F.lit(1))))


def within(rows: DataFrame, key: str) -> DataFrame:
    """Pairs (a, b) of rows of one key and different components (x, y) that sizes allow. rows: key, rep, comp, n, at (place of the key in the
    prefix). A long list is dealt to blocks of about BLOCK rows, every two of which meet under a key of their own."""
    many = rows.groupBy(key).agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count("*").alias("c"))
    many = many.filter("c1 <> c2").select(key, F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(many, key).withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    one = rows.select(key, F.col("mine").alias("p"), every.alias("q"), F.col("rep").alias("a"), F.col("comp").alias("x"), F.col("n").alias("na"), F.col("at").alias("i"))
    two = rows.select(key, every.alias("p"), F.col("mine").alias("q"), F.col("rep").alias("b"), F.col("comp").alias("y"), F.col("n").alias("nb"), F.col("at").alias("j"))
    room = 1 + F.least(F.col("na") - F.col("i") - 1, F.col("nb") - F.col("j") - 1)
    fit = (F.col("a") < F.col("b")) & (F.col("x") != F.col("y")) & compatible() & (room >= enough(F.col("na"), F.col("nb")))
    return one.join(two, [key, "p", "q"]).filter(fit).select("a", "b", "x", "y")


def link_components(reps: DataFrame) -> DataFrame:
    """reps: rep, n, core. rep and comp of the representatives that may link; all others are alone."""
    reps = reps.withColumns({"pre": prefix_of(), "odd": F.col("n") - F.size("core")})
    groups = reps.groupBy("n", "pre").agg(F.min(F.struct("odd", "rep")).alias("lead"), F.count("*").alias("size"))
    groups = groups.select("n", "pre", F.col("lead.rep").alias("gid"), F.col("lead.odd").alias("odd"), "size")
    member, _ = kept(reps.select("rep", "n", "odd", "pre").join(groups.select("n", "pre", "gid"), ["n", "pre"]).select("rep", "n", "odd", "gid"))
    lists = groups.select("gid", "n", "odd", F.posexplode("pre").alias("at", "tok"))
    shared = lists.groupBy("tok").agg(F.count("*").alias("c")).filter("c > 1").select("tok")
    lists, _ = kept(lists.join(shared, "tok", "left_semi").withColumn("at", F.col("at") + F.col("odd")))

    inside = member.filter("rep <> gid").select(F.col("rep").alias("a"), F.col("gid").alias("b"))
    comp, first = reps.select("rep", F.col("rep").alias("comp")), True
    for _ in range(PIVOT_ROUNDS):
        open_lists = lists
        if not first:  # pivots of components other than that of the list's best member
            lead = lists.join(comp.withColumnRenamed("rep", "gid"), "gid")
            top = lead.groupBy("tok").agg(F.min(F.struct("odd", "gid", "comp")).alias("top"), F.min("comp").alias("c1"), F.max("comp").alias("c2"))
            open_lists = lead.join(top.filter("c1 <> c2").select("tok", "top"), "tok").filter(F.col("comp") != F.col("top.comp"))
        pivot = open_lists.groupBy("tok").agg(F.min(F.struct("odd", "gid", "n")).alias("p"))
        near = lists.withColumnRenamed("n", "na").join(pivot, "tok").withColumn("nb", F.col("p.n")).filter((F.col("gid") != F.col("p.gid")) & compatible())
        pairs = near.select("gid", F.col("p.gid").alias("b")).distinct()
        pairs = pairs.join(member.select("gid", F.col("rep").alias("a")), "gid").select("a", "b")
        if first:  # each is a component of its own
            pairs = pairs.unionByName(inside).withColumns({"x": F.col("a"), "y": F.col("b")})
        else:
            ca, cb = comp.select(F.col("rep").alias("a"), F.col("comp").alias("x")), comp.select(F.col("rep").alias("b"), F.col("comp").alias("y"))
            pairs = pairs.join(ca, "a").join(cb, "b").filter("x <> y").select("a", "b", "x", "y")
        comp, first = components(comp, verified(pairs.distinct(), reps).select("x", "y")), False
    # whatever still shares a posting list or a group across components
    posted = lists.join(member.select("gid", "rep"), "gid").join(comp, "rep").select("tok", "rep", "comp", "n", "at")
    alike = member.join(comp, "rep").select("gid", "rep", "comp", "n", F.lit(0).cast("long").alias("at"))
    pairs = within(posted, "tok").unionByName(within(alike, "gid")).distinct()
    return components(comp, verified(pairs, reps).select("x", "y"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles and component_id of each document."""
    sets = cut(shingle_sets(docs.select(F.col(key).alias("k"), F.col(text).alias("t"))))
    release(docs.sparkSession)
    same = ["s1", "s2", "n"]
    ids = sets.filter("n > 0").groupBy(*same).agg(F.min("k").alias("id"))
    # sets with a prefix shingle that another set has in its prefix too
    posted = sets.filter("core is not null").select("s1", F.explode(prefix_of()).alias("tok"))
    common = posted.groupBy("tok").agg(F.min("s1").alias("a"), F.max("s1").alias("b")).filter("a <> b").select("tok")
    busy = posted.join(common, "tok", "left_semi").select("s1").distinct()
    cores = sets.filter("core is not null").join(busy, "s1", "left_semi").groupBy(*same).agg(F.first("core").alias("core"))
    may = cut(cores.withColumn("rep", F.monotonically_increasing_id()))  # numbers are kept with the rows
    release(docs.sparkSession)
    comp = link_components(may.select("rep", "n", "core"))
    placed = may.select(*same, "rep").join(comp, "rep").select(*same, "comp").join(ids, same)
    least_id = placed.groupBy("comp").agg(F.min("id").alias("component_id"))
    linked = placed.join(least_id, "comp").select(*same, "component_id")
    named = ids.join(linked.withColumn("hit", F.lit(True)), same, "left").select(*same, F.when(F.col("hit"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"), F.lit(True).alias("known"))
    out = sets.select("k", "n", *[F.when(F.col("n") > 0, F.col(c)).alias(c) for c in ("s1", "s2")]).join(named, same, "left")
    return out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("known"), F.col("component_id")).otherwise(F.col("k")).alias("component_id"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + least(len(w), 5)], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(0, len(w) - least(len(w), 5) + 1)) AS i FROM d WHERE len(w) > 0)
), c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
f AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
r AS (SELECT s.* FROM s SEMI JOIN f USING (g)),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM r a JOIN r b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM x JOIN c p ON p.doc_id = a JOIN c q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
t AS (SELECT doc_id AS a, doc_id AS z FROM d UNION SELECT t.a, l.b FROM t JOIN l ON l.a = t.z)
SELECT d.doc_id, CAST(coalesce(max(c.n), 0) AS BIGINT) AS n_shingles, min(z) AS component_id
FROM d LEFT JOIN c ON c.doc_id = d.doc_id JOIN t ON t.a = d.doc_id GROUP BY d.doc_id
"""
