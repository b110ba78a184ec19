"""Quality rules as a learned decision list, with DataFrame functions only.

Features of each text are Spark expressions. From the features of labelled documents (at most about SAMPLE a class, chosen
by a hash of the id) sequential covering learns an ordered list of threshold conjunctions for bad documents: a rule grows
by the condition with the best gain on two thirds of the labelled rows, is pruned on the remaining third, is kept while it
is precise there, and takes the rows it covers away. The driver only sees counts per cell of a grid of feature quantiles.
The list becomes one CASE expression, so applying it is a projection of the scan.

A repeated five-word window is found by its hash, combined from those of its words (array_distinct shortens the array), and only
texts with such a repeat compare the windows' words themselves, so the count is exact.

Defined cases: null and empty texts have no words and fail the base rules; null labels and labels without a document are
not learned from; repeated label rows count once, and of documents that share an id the one of the least features is learned from; with no labels, or none of a class, there are no rules and the base
decides; ties between conditions go to the first feature and threshold; repeated rows are documents of their own; a null id is
kept and never learned from; a very long text is one row; other columns are kept by features(), but those named like a result
(case does not count) are replaced by it; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, label_sample, let, plain, read, tokens

RUN = 5
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\f\r"
#: Labelled rows of each class to learn from, about.
SAMPLE = 4000
BINS, MAX_RULES, MAX_CONDITIONS = 16, 8, 4
MIN_COVER, MIN_PRECISION = 5, 0.9
#: What the rules may test; all are ratios or counts per document.
LEARNED = ("n_words", "mean_chars", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "bar_share", "kind_share")

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
INNER = ("_w", "_l", "_lines", "_upper", "_digit", "_bar", "_kinds")


def repeats(w: Column) -> Column:
    """Words inside windows of RUN words found twice or more in the array."""
    n = F.size(w)
    at = F.sequence(F.lit(1), n - RUN + 1)

    def runs(h: Column) -> Column:
        """Hashes of RUN = 2 + 2 + 1 words from each place on; zip_with fills the places past the end, which are cut."""
        both = lambda x, y: F.xxhash64(x, y)
        from_ = lambda x, k: F.slice(x, F.lit(k + 1), F.greatest(F.size(x) - k, F.lit(0)))
        of_four = lambda two: F.zip_with(two, from_(two, 2), both)
        five = F.zip_with(let(F.zip_with(h, from_(h, 1), both), of_four), from_(h, 4), both)
        return F.slice(five, F.lit(1), F.greatest(F.size(h) - RUN + 1, F.lit(0)))

    pairs = F.array_sort(F.transform(at, lambda i: F.struct(F.array_join(F.slice(w, i, F.lit(RUN)), " ").alias("v"), i.alias("i"))))

    def twice(p: Column) -> Column:
        same = lambda x, k: F.coalesce(x["v"] == F.get(p, k)["v"], F.lit(False))
        return F.filter(p, lambda x, k: same(x, k - 1) | same(x, k + 1))

    places = F.array_sort(F.transform(let(pairs, twice), lambda x: x["i"]))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    count = F.aggregate(
        places, zero,
        lambda a, i: F.struct((a["n"] + i + RUN - F.greatest(a["end"], i)).alias("n"), (i + RUN).alias("end")),
        lambda a: a["n"],
    )
    distinct = let(let(F.transform(w, lambda x: F.xxhash64(x)), runs), lambda h: F.size(F.array_distinct(h)) == F.size(h))
    return F.when((n < RUN) | distinct, F.lit(0)).otherwise(count)


def removed(text: Column, chars: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, chars, ""))


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without its text, with the counts and the learned features."""
    docs = plain(docs, *COUNTS, *LEARNED, *INNER)
    t = F.coalesce(F.col(text), F.lit(""))
    # bound by let(): a plan that moved these expressions into the lambdas would compute them for every word
    about_words = let(tokens(t), lambda w: F.struct(F.size(w).alias("n"), repeats(w).alias("again"), F.size(F.array_distinct(w)).alias("kinds")))
    lines = F.filter(F.split(t, "\n"), lambda x: F.char_length(F.translate(x, BLANKS, "")) > 0)
    about_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    d = docs.select(
        *[c for c in docs.columns if c != text], about_words.alias("_w"), about_lines.alias("_l"),
        F.char_length(F.translate(t, BLANKS, "")).cast("long").alias("word_chars"), removed(t, SYMBOLS).cast("long").alias("n_symbols"),
        removed(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("_upper"), removed(t, "0123456789").alias("_digit"), removed(t, "|").alias("_bar"),
    )
    d = d.withColumns({
        "n_words": F.col("_w.n").cast("long"), "n_dup_lines": F.col("_l.dup").cast("long"), "n_repeat_words": F.col("_w.again").cast("long"),
        "_lines": F.col("_l.n"), "_kinds": F.col("_w.kinds"),
    })
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return d.withColumns({
        "mean_chars": F.col("word_chars") / words, "symbol_share": F.col("n_symbols") / chars,
        "dup_line_share": F.col("n_dup_lines") / F.greatest("_lines", F.lit(1)), "repeat_share": F.col("n_repeat_words") / words,
        "upper_share": F.col("_upper") / chars, "digit_share": F.col("_digit") / chars, "bar_share": F.col("_bar") / words,
        "kind_share": F.col("_kinds") / words,
    }).drop("_w", "_l", "_lines", "_upper", "_digit", "_bar", "_kinds")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    bound: float

    def column(self) -> Column:
        return F.col(self.feature) > self.bound if self.above else F.col(self.feature) <= self.bound


Rule = tuple[Condition, ...]


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> list[Rule]:
    """Ordered rules; a document that one of them covers is bad."""
    some = label_sample(labels.select(F.col(key).alias("k"), F.col(label).alias("y")), {0: SAMPLE, 1: SAMPLE})[0].withColumnsRenamed({"k": "_k", "y": "_y"})
    f = features(docs.select(key, text).join(F.broadcast(some), docs[key] == some["_k"]), text).filter(~base_failed())
    one = f.groupBy(key, "_y").agg(F.min(F.struct(*LEARNED)).alias("_f"))  # one row a label
    f = cut(one.select(key, "_y", "_f.*"))
    if not f.limit(1).count():
        return []
    points = [i / BINS for i in range(1, BINS)]
    row = f.agg(*[F.percentile(F.col(c).cast("double"), points).alias(c) for c in LEARNED], *[F.percentile(F.when(F.col("_y") == 0, F.col(c).cast("double")), points).alias(f"bad_{c}") for c in LEARNED]).first()
    bounds = {c: sorted({*row[c], *(row[f"bad_{c}"] or [])}) for c in LEARNED}
    cell = [sum([F.when(F.col(c) > b, 1).otherwise(0) for b in bounds[c]], F.lit(0)).alias(c) for c in LEARNED]
    part = (F.pmod(F.xxhash64(F.col(key), F.lit("prune")), F.lit(3)) == 0).alias("prune")
    cells = f.select("_y", part, *cell).groupBy("prune", *LEARNED).agg(F.count_if(F.col("_y") == 0).alias("bad"), F.count_if(F.col("_y") == 1).alias("good"))
    rows = cells.collect()  # no more rows than the sample
    grid = np.array([[r[c] for c in LEARNED] for r in rows])
    held = np.array([r["prune"] for r in rows])
    bad, good = np.array([r["bad"] for r in rows]), np.array([r["good"] for r in rows])

    def covers(rule: list[tuple[int, bool, int]]) -> np.ndarray:
        hit = np.ones(len(rows), bool)
        for f, above, k in rule:
            hit &= (grid[:, f] > k) == above
        return hit

    def value(hit: np.ndarray) -> float:
        p, n = bad[hit].sum(), good[hit].sum()
        return (p - n) / (p + n) if p + n else -1.0

    def best_condition(left: np.ndarray) -> tuple[int, bool, int] | None:
        """Of the largest gain p * (log2 precision after - log2 precision before)."""
        p0, n0 = bad[left].sum(), good[left].sum()
        best, gain = None, 1e-9
        for f, c in enumerate(LEARNED):
            size = len(bounds[c]) + 1
            p, n = (np.cumsum(np.bincount(grid[left, f], x[left], size))[:-1] for x in (bad, good))
            for above in (True, False):
                ps, ns = (p0 - p, n0 - n) if above else (p, n)
                g = np.where(ps >= MIN_COVER, ps * (np.log2(np.maximum(ps, 1) / np.maximum(ps + ns, 1)) - np.log2(p0 / (p0 + n0))), 0)
                if len(g) and g.max() > gain:
                    best, gain = (f, above, int(g.argmax())), g.max()
        return best

    rules: list[Rule] = []
    open_rows = np.ones(len(rows), bool)
    while len(rules) < MAX_RULES and bad[open_rows & ~held].sum() >= MIN_COVER:
        rule: list[tuple[int, bool, int]] = []
        left = open_rows & ~held
        while len(rule) < MAX_CONDITIONS and good[left].any() and (best := best_condition(left)):
            rule.append(best)
            left = left & covers([best])
        while len(rule) > 1 and value(covers(rule[:-1]) & open_rows & held) >= value(covers(rule) & open_rows & held):
            rule.pop()
        hit = covers(rule) & open_rows
        tested = hit & held  # rows that the rule was not grown on
        if not rule or bad[hit].sum() < MIN_COVER or bad[tested].sum() < max(1, MIN_PRECISION * (bad[tested] + good[tested]).sum()):
            break
        rules.append(tuple(Condition(LEARNED[f], above, float(bounds[LEARNED[f]][k])) for f, above, k in rule))
        open_rows &= ~hit
    return rules


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that covers the row (from 1), else 0."""
    out = None
    for i, rule in enumerate(rules, 1):
        all_of = F.lit(True)
        for c in rule:
            all_of = all_of & c.column()
        out = F.when(all_of, i) if out is None else out.when(all_of, i)
    return F.lit(0) if out is None else out.otherwise(0)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rules = learn(docs, read(spark, sf_dir, "labels"))
    f = features(docs).withColumns({"base_failed": base_failed(), "rule": verdict(rules)})
    return f.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule",
    )
