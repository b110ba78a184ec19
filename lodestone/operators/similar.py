"""Exact similarity joins of names below all pairs.

Each join makes candidates by equi-joins on signatures that every pair at or above the threshold must share, and scores
these alone; no pair that reaches the threshold is lost, at any number of names.

* edit_pairs: a partition index. A name of length L may be d(L) = floor((1 - least) * L) edits from another one of at most its
  length, so one of d + 1 even segments stands in the shorter one unchanged, near its own place. Longer names are indexed by
  (L, segment number, segment), shorter ones ask for the substrings at the places that the edits left and right of a segment allow.
* set_pairs: a prefix index. Of two sets with Jaccard similarity at least t, both hold one of the rarest |s| - ceil(t * |s|) + 1
  tokens of either, tokens in one order of frequency.
* affix_pairs: names that are a beginning or an end of another one, by equality with all beginnings and ends.
* word_pairs: names whose words agree up to synonyms and, if near, two edits. The first words of a name, the rarest first, must
  hold one that the other name has or has something close to; closeness is joined between distinct words, by edit index.

Frequent signatures are split by adaptive skew joins, as both sides are plain equi-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import text

from .materialize import settle

#: Scores are rounded to six places before they are compared; thresholds give way by this much.
SLACK = 1e-6


def names_of(df: DataFrame, column: str = "name") -> DataFrame:
    return df.select(F.col(column).alias("name")).filter("name is not null").distinct()


def _ordered(names: DataFrame, name: str) -> DataFrame:
    return names.select(F.col("name").alias(name))


def allowed(length: Column, least: float, most: int | None) -> Column:
    """Edits that a name of this length may be from a shorter one."""
    d = F.floor((1 - least + SLACK) * length).cast("int")
    return d if most is None else F.least(d, F.lit(most))


def _places(length: Column, d: Column, i: Column) -> tuple[Column, Column]:
    """Begin and length of segment i of d + 1: the later ones are longer by one where the length does not divide."""
    n = d + 1
    base = F.floor(length / n).cast("int")
    short = n - length % n
    return i * base + F.greatest(i - short, F.lit(0)), base + F.when(i >= short, 1).otherwise(0)


def _segments(x: Column, length: Column, d: Column) -> Column:
    def one(i: Column) -> Column:
        begin, size = _places(length, d, i)
        return F.struct(length.alias("L"), i.alias("i"), F.substring(x, begin + 1, size).alias("s"))

    return F.transform(F.sequence(F.lit(0), d), one)


def _asked(x: Column, length: Column, longer: Column, d: Column) -> Column:
    """The substrings of x that may equal a segment of a name `longer` long: before it at most i edits, behind it at most d - i."""
    gap = longer - length

    def one(i: Column) -> Column:
        begin, size = _places(longer, d, i)
        low = F.greatest(begin - i, begin - gap - (d - i), F.lit(0))
        high = F.least(begin + i, begin - gap + (d - i), length - size)
        at = F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda p: F.struct(longer.alias("L"), i.alias("i"), F.substring(x, p + 1, size).alias("s")))

    return F.flatten(F.transform(F.sequence(F.lit(0), d), one))


def edit_candidates(longer: DataFrame, shorter: DataFrame, least: float, most: int | None = None) -> DataFrame:
    """a (of longer), b (of shorter, at most as long): every pair within the allowed edits is among them."""
    one = longer.select(F.col("name").alias("a"), F.char_length("name").alias("n")).filter("n > 0").withColumn("d", allowed(F.col("n"), least, most))
    one = one.select("a", F.inline(_segments(F.col("a"), F.col("n"), F.col("d"))))
    two = shorter.select(F.col("name").alias("b"), F.char_length("name").alias("n")).filter("n > 0")
    top = F.floor(F.col("n") / (least - SLACK)).cast("int") + 1
    two = two.withColumn("m", F.explode(F.sequence(F.col("n"), top if most is None else F.least(top, F.col("n") + most))))
    two = two.withColumn("d", allowed(F.col("m"), least, most)).filter(F.col("m") - F.col("n") <= F.col("d"))
    two = two.select("b", F.inline(_asked(F.col("b"), F.col("n"), F.col("m"), F.col("d"))))
    return one.join(two, ["L", "i", "s"]).select("a", "b").distinct()


def edit_pairs(left: DataFrame, right: DataFrame, least: float, most: int | None = None) -> DataFrame:
    """a (of left), b (of right) and score: all pairs of distinct names (column name) with edit similarity of at least `least` > 0;
    most: and at most so many edits. Equal names are pairs, empty names of none."""
    one = edit_candidates(left, right, least, most)
    two = edit_candidates(right, left, least, most).select(F.col("b").alias("a"), F.col("a").alias("b"))
    p = one.unionByName(two).distinct()
    n = F.greatest(F.char_length("a"), F.char_length("b"))
    d = allowed(n, least, most)
    # a distance beyond the allowed one is given as -1, early
    p = p.filter(F.levenshtein("a", "b") <= d).withColumn("score", text.edit_similarity(F.col("a"), F.col("b")))
    return p.filter(F.col("score") >= least - SLACK)


def prefixes(sets: DataFrame, least: float, freq: DataFrame, whole: bool = False) -> DataFrame:
    """name, n (size) and token of each set's rarest tokens: as many as must hold one that is matched if a share `least` of all is."""
    rows = sets.select("name", F.size("s").alias("n"), F.explode("s").alias("token")).join(freq, "token")
    if whole:
        return rows.select("name", "n", "token")
    place = F.row_number().over(W.partitionBy("name").orderBy("f", "token"))
    keep = F.col("n") - F.ceil((least - SLACK) * F.col("n")) + 1
    return rows.withColumn("o", place).filter(F.col("o") <= keep).select("name", "n", "token")


def set_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """a, b, score: all pairs of rows (name, s: an array without repeats) with Jaccard similarity of at least `least` > 0."""
    freq = left.select(F.explode("s").alias("token")).unionByName(right.select(F.explode("s").alias("token"))).groupBy("token").agg(F.count("*").alias("f"))
    one, two = (prefixes(x, least, freq).select(F.col("name").alias(k), F.col("n").alias(f"n{k}"), "token") for x, k in ((left, "a"), (right, "b")))
    sizes = (F.least("na", "nb") >= (least - SLACK) * F.greatest("na", "nb"))
    p = one.join(two, "token").filter(sizes).select("a", "b").distinct()
    p = p.join(left.select(F.col("name").alias("a"), F.col("s").alias("sa")), "a").join(right.select(F.col("name").alias("b"), F.col("s").alias("sb")), "b")
    return p.withColumn("score", text.jaccard(F.col("sa"), F.col("sb"))).filter(F.col("score") >= least - SLACK).select("a", "b", "score")


def affix_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """a, b: one is a beginning or an end of the other; case does not count."""
    def parts(x: DataFrame, own: str, key: str) -> DataFrame:
        low = F.lower("name")
        n = F.char_length(low)
        cuts = F.sequence(F.lit(0), n)
        both = F.concat(F.transform(cuts, lambda k: F.substring(low, F.lit(1), k)), F.transform(cuts, lambda k: F.substring(low, k + 1, n)))
        return x.select(F.col("name").alias(own), F.explode(F.array_distinct(both)).alias(key))

    whole = lambda x, own: x.select(F.col("name").alias(own), F.lower("name").alias("k"))
    return parts(left, "a", "k").join(whole(right, "b"), "k").select("a", "b").unionByName(whole(left, "a").join(parts(right, "b", "k"), "k").select("a", "b")).distinct()


def token(word: Column) -> Column:
    """A word's synonym group, or the word: equal for two words that are equal or stand for one another."""
    group = text.synonym_group(word)
    return F.when(group.isNotNull(), F.concat(F.lit("#"), group)).otherwise(word)


def close_words(left: DataFrame, right: DataFrame) -> DataFrame:
    """x, y: distinct words (column name) that are equal, of one synonym group, or within two edits if the longer has four letters."""
    one, two = (x.select(F.col("name").alias(k), token(F.col("name")).alias("t")) for x, k in ((left, "x"), (right, "y")))
    # two edits of four letters or more: a similarity of one half and more holds for all of them
    near = edit_pairs(left.filter("name <> ''"), right.filter("name <> ''"), 0.25, 2).filter(F.greatest(F.char_length("a"), F.char_length("b")) >= 4)
    return one.join(two, "t").select("x", "y").unionByName(near.select(F.col("a").alias("x"), F.col("b").alias("y"))).distinct()


def word_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """a, b: all pairs where semantic similarity or close overlap of the words of the names may reach `least`.

    Both scores are at most the share of words of a that b has something close to, so of a's words (with repeats) at least
    ceil(least * n) are matched and one of any n - ceil(least * n) + 1 is; the words that fewest names have are asked for. Neither
    score can be reached by a name b of more than n / least words: of distinct ones for the overlap, of all for the other."""
    one, two = (x.select("name", text.name_words(F.col("name")).alias("w")).filter(F.size("w") > 0) for x in (left, right))
    has = settle(two.select(F.col("name").alias("b"), F.size(F.array_distinct("w")).alias("nb"), F.explode(F.array_distinct("w")).alias("y")))
    words = one.select("name", F.size("w").alias("n"), F.posexplode("w").alias("pos", "x"))
    distinct = lambda df, c: df.select(F.col(c).alias("name")).distinct()
    close = settle(close_words(distinct(words, "x"), distinct(has, "y")))
    freq = close.join(has.groupBy("y").agg(F.count("*").alias("f")), "y").groupBy("x").agg(F.sum("f").alias("f"))
    place = F.row_number().over(W.partitionBy("name").orderBy(F.coalesce("f", F.lit(0)), "x", "pos"))
    keep = F.col("n") - F.ceil((least - SLACK) * F.col("n")) + 1
    asked = words.join(freq, "x", "left").withColumn("o", place).filter(F.col("o") <= keep).select(F.col("name").alias("a"), "n", "x").distinct()
    p = asked.join(close, "x").join(has, "y").filter(F.col("nb") * (least - SLACK) <= F.col("n"))
    return p.select("a", "b").distinct()


def name_score(a: Column, b: Column) -> Column:
    """The highest of edit, semantic and affix similarity and close overlap, to six places."""
    wa, wb = text.name_words(a), text.name_words(b)
    return F.round(F.greatest(text.edit_similarity(F.lower(a), F.lower(b)), text.semantic_similarity(wa, wb), text.affix_similarity(a, b), text.close_overlap(wa, wb)), 6)


def lower_edit_candidates(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """a, b: pairs whose lower-case forms have edit similarity of at least `least`; empty names meet empty ones."""
    low = lambda x: x.select(F.lower("name").alias("name")).distinct()
    p = edit_pairs(low(left), low(right), least).select(F.col("a").alias("la"), F.col("b").alias("lb"))
    p = p.join(left.select(F.col("name").alias("a"), F.lower("name").alias("la")), "la").join(right.select(F.col("name").alias("b"), F.lower("name").alias("lb")), "lb").select("a", "b")
    empty = lambda x, k: x.filter("name = ''").select(F.col("name").alias(k), F.lit(1).alias("e"))
    return p.unionByName(empty(left, "a").join(empty(right, "b"), "e").select("a", "b"))


def name_pairs(left: DataFrame, right: DataFrame, least: float = 0.7) -> DataFrame:
    """a (of left), b (of right) and score: all pairs of distinct names (column name) with a name_score of at least `least`, 0.25 or more.

    Affixes score between 0.7 and 0.9; for a lower threshold all of them are pairs."""
    left, right = settle(names_of(left)), settle(names_of(right))
    p = lower_edit_candidates(left, right, least).unionByName(word_pairs(left, right, least))
    if least <= 0.9:
        p = p.unionByName(affix_pairs(left, right))
    return p.distinct().withColumn("score", name_score(F.col("a"), F.col("b"))).filter(F.col("score") >= least)


def _spelled(name: Column) -> Column:
    return F.array_join(text.name_words(name), " ")


def concept_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """a, b and score: all pairs of distinct names (column name) with a concept similarity of at least `least`, 0.25 or more."""
    left, right = settle(names_of(left)), settle(names_of(right))
    spell = lambda x: x.select(_spelled(F.col("name")).alias("name")).distinct()
    p = edit_pairs(spell(left), spell(right), least).select(F.col("a").alias("la"), F.col("b").alias("lb"))
    p = p.unionByName(spell(left).filter("name = ''").select(F.col("name").alias("la"), F.col("name").alias("lb")))
    p = p.join(left.select(F.col("name").alias("a"), _spelled(F.col("name")).alias("la")), "la").join(right.select(F.col("name").alias("b"), _spelled(F.col("name")).alias("lb")), "lb").select("a", "b")
    if least <= 0.85:
        # a name asks for the other words of its concepts, so that names of one word do not meet
        def words(x: DataFrame, own: str, others: bool) -> DataFrame:
            def of(i: int, group: tuple[str, ...]) -> Column:
                first = F.coalesce(*[F.when(F.contains(_spelled(F.col("name")), F.lit(w)), F.lit(w)) for w in group])
                mine = F.array_except(F.array(*map(F.lit, group)), F.array(first)) if others else F.array(first)
                return F.when(first.isNull(), F.array().cast("array<struct<g:int,w:string>>")).otherwise(F.transform(mine, lambda w: F.struct(F.lit(i).alias("g"), w.alias("w"))))

            return x.select(F.col("name").alias(own), F.inline(F.flatten(F.array(*[of(i, g) for i, g in enumerate(text.CONCEPTS)]))))

        p = p.unionByName(words(left, "a", True).join(words(right, "b", False), ["g", "w"]).select("a", "b"))
    return p.distinct().withColumn("score", text.concept_similarity(F.col("a"), F.col("b"))).filter(F.col("score") >= least)


def first_fits(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Greedy grouping in rounds: kind, canonical, variant, score and group_mean of rows (kind, name, ord) and pairs (a, b, score).

    In the order of (ord, name) the first name of a kind that is free takes the later free names that are its pairs. So a name is
    canonical if and only if none of its earlier pairs is; each round settles the names whose earlier pairs are settled: those with a
    canonical one among them are variants, those without are canonical. Names of one kind need not meet in one task."""
    own = rows.groupBy("kind", "name").agg(F.min("ord").alias("ord"))
    place = settle(own.select("kind", "name", F.struct("ord", "name").alias("at")))
    one, two = (place.select("kind", F.col("name").alias(k), F.col("at").alias(f"at_{k}")) for k in "ab")
    # before: the earlier pairs of each name
    before = settle(pairs.join(one, "a").join(two, ["b", "kind"]).filter(F.col("at_a") < F.col("at_b")).select("kind", F.col("a").alias("early"), F.col("at_a"), F.col("b").alias("name"), "score"))
    todo, heads = place.select("kind", "name"), None
    edges = before.select("kind", "early", "name")
    while True:
        waits = edges.select("kind", "name").distinct()
        new = settle(todo.join(waits, ["kind", "name"], "left_anti"))
        heads = new if heads is None else heads.unionByName(new)
        taken = edges.join(new.withColumnRenamed("name", "early"), ["kind", "early"], "left_semi").select("kind", "name").distinct()
        gone = new.unionByName(taken)
        todo = settle(todo.join(gone, ["kind", "name"], "left_anti"))
        if todo.isEmpty():
            break
        # a variant takes nobody, so its pairs wait for it no longer
        left = edges.join(taken, ["kind", "name"], "left_anti")
        edges = settle(left.join(gone.withColumnRenamed("name", "early"), ["kind", "early"], "left_anti"))
    found = before.join(heads.withColumnRenamed("name", "early"), ["kind", "early"], "left_semi")
    first = found.groupBy("kind", "name").agg(F.min(F.struct("at_a", "early", "score")).alias("x"))
    # a canonical name has no canonical pair before it
    groups = first.select("kind", F.col("x.early").alias("canonical"), F.col("name").alias("variant"), F.round("x.score", 6).alias("score"))
    mean = F.round(F.avg("score").over(W.partitionBy("kind", "canonical")), 6)
    return groups.withColumn("group_mean", mean)
