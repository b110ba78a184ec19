"""The similarity joins against all pairs, on random names with shared words, repeats, empty names and cases."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import similar

WORDS = "get fetch user account id name total amount item items status state by data order ordr lst list usr sync x".split()


def some_names(seed, n, letters="abc"):
    r, out = random.Random(seed), set()
    while len(out) < n:
        kind = r.random()
        if kind < 0.45:
            w = [r.choice(WORDS) for _ in range(r.randint(1, 5))]
            out.add(w[0] + "".join(x.title() for x in w[1:]) if r.random() < 0.7 else "_".join(w))
        elif kind < 0.6 and out:
            x = list(r.choice(sorted(out)) or "q")
            for _ in range(r.randint(1, 3)):
                k = r.randrange(len(x) + 1)
                x[k : k + r.randint(0, 1)] = r.choice(["", "z", "e"])
            out.add("".join(x))
        else:
            out.add("".join(r.choice(letters) for _ in range(r.randint(0, 9))))
    return sorted(out)


def frame(spark, names):
    return spark.createDataFrame([(n,) for n in names], "name string")


def every(spark, one, two, score):
    p = frame(spark, one).select(F.col("name").alias("a")).crossJoin(frame(spark, two).select(F.col("name").alias("b")))
    return p.withColumn("score", score(F.col("a"), F.col("b")))


def rows(df):
    return sorted((r["a"], r["b"], round(r["score"], 6)) for r in df.collect())


@pytest.mark.parametrize("least", [0.3, 0.5, 0.6, 0.7, 0.85, 1.0])
def test_edit_pairs(spark, least):
    one, two = some_names(1, 120), some_names(2, 110)
    want = every(spark, one, two, text.edit_similarity).filter((F.col("a") != "") & (F.col("b") != "") & (F.round("score", 6) >= least))
    assert rows(similar.edit_pairs(frame(spark, one), frame(spark, two), least)) == rows(want)


def test_few_edits(spark):
    one = some_names(5, 150, "ab")
    want = every(spark, one, one, lambda a, b: F.levenshtein(a, b)).filter("score <= 2 and a <> '' and b <> ''")
    got = similar.edit_pairs(frame(spark, one), frame(spark, one), 0.25, 2)
    near = {(r["a"], r["b"]) for r in want.collect() if 1 - r["score"] / max(len(r["a"]), len(r["b"])) >= 0.25}
    assert {(r["a"], r["b"]) for r in got.collect()} == near


@pytest.mark.parametrize("least", [0.2, 0.5, 0.8])
def test_set_pairs(spark, least):
    r = random.Random(3)
    make = lambda k: spark.createDataFrame([(f"{k}{i}", sorted({r.choice("abcdefghijkl") for _ in range(r.randint(1, 9))})) for i in range(60)], "name string, s array<string>")
    one, two = make("p"), make("q")
    pairs = one.select(F.col("name").alias("a"), F.col("s").alias("sa")).crossJoin(two.select(F.col("name").alias("b"), F.col("s").alias("sb")))
    want = pairs.withColumn("score", text.jaccard(F.col("sa"), F.col("sb"))).filter(F.round("score", 6) >= least)
    assert rows(similar.set_pairs(one, two, least)) == rows(want)


@pytest.mark.parametrize("least", [0.4, 0.7, 0.9])
def test_name_pairs(spark, least):
    one, two = some_names(7, 110), some_names(8, 130)
    want = every(spark, one, two, similar.name_score).filter(F.col("score") >= least)
    assert rows(similar.name_pairs(frame(spark, one), frame(spark, two), least)) == rows(want)


def test_candidates_are_few(spark):
    r = random.Random(11)
    names = frame(spark, {"".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(8, 20))) for _ in range(3000)})
    n = similar.edit_candidates(names, names, 0.7).count()
    assert n < 0.01 * 3000**2


@pytest.mark.parametrize("least", [0.4, 0.75, 0.85])
def test_concept_pairs(spark, least):
    one, two = some_names(17, 90), some_names(18, 90)
    want = every(spark, one, two, text.concept_similarity).filter(F.col("score") >= least)
    assert rows(similar.concept_pairs(frame(spark, one), frame(spark, two), least)) == rows(want)


def test_first_fits(spark):
    r = random.Random(6)
    names = [(k, n, r.randint(0, 40)) for k in ("x", "y") for n in some_names(20, 70, "ab")]
    d = spark.createDataFrame(names + names[:9], "kind string, name string, ord int")
    n = frame(spark, {x[1] for x in names if x[1]})
    near = similar.edit_pairs(n, n, 0.6).filter("a <> b")
    score = {(p["a"], p["b"]): p["score"] for p in near.collect()}
    want = []
    for kind in ("x", "y"):
        order = [x[1] for x in sorted((x for x in names if x[0] == kind), key=lambda x: (x[2], x[1]))]
        free = set(order)
        for a in order:
            if a in free:
                free.discard(a)
                mine = [b for b in order if b in free and (a, b) in score]
                free -= set(mine)
                want += [(kind, a, b, round(score[a, b], 6), round(sum(round(score[a, x], 6) for x in mine) / len(mine), 6)) for b in mine]
    assert sorted(map(tuple, similar.first_fits(d, near).collect())) == sorted(want) and len(want) > 40
    assert similar.first_fits(d.limit(0), near).collect() == []


def test_part_queries(spark, tmp_path):
    import duckdb

    from lodestone.plans import names

    r = random.Random(4)
    rows_ = [(i, n, f"Brand#{r.randint(1, 4)}", f"T{r.randint(0, 2)}") for i, n in enumerate(some_names(30, 160) * 2)]
    spark.createDataFrame([*rows_[40:], (999, None, "Brand#1", "T1")], "p_partkey long, p_name string, p_brand string, p_type string").filter("p_name <> '' or p_name is null").write.parquet(f"{tmp_path}/part.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet' WHERE p_name IS NOT NULL")
    for name in ("fuzzy_names", "structural_drift", "type_suggestion", "greedy_groups"):
        got = names.QUERIES[name](spark, str(tmp_path))
        want = c.sql(f"SELECT {', '.join(got.columns)} FROM ({names.ORACLES[name]})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want) and want, name


def test_top3_by_falling_thresholds(spark, tmp_path):
    from pyspark.sql import Window as W

    from lodestone.plans import names

    spark.createDataFrame([(x,) for x in some_names(31, 140)], "p_name string").write.parquet(f"{tmp_path}/part.parquet")

    def score(a, b):
        return F.round(F.greatest(text.edit_similarity(F.lower(a), F.lower(b)), text.affix_similarity(a, b), text.jaccard(text.name_words(a), text.name_words(b))), 6)

    want = every(spark, some_names(31, 140), some_names(31, 140), score).filter("a <> b and score >= 0.3 and score < 1")
    want = want.withColumn("rank", F.row_number().over(W.partitionBy("a").orderBy(F.desc("score"), "b"))).filter("rank <= 3")
    assert sorted(map(tuple, names.fuzzy_top3(spark, str(tmp_path)).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("least", [0.3, 0.75])
def test_drift_is_all_pairs(spark, least):
    from lodestone.operators import more_rules

    r = random.Random(12)
    kinds = ("interface", "class")
    files = []
    for i in range(24):
        name = r.choice(["UserAccount", "UserAcount", "CustomerProfile", "OrderItem", "OrdrItem", "Purchase", "Payment", "Box"]) + r.choice(["", "", "Data"])
        props = r.sample(["id", "name", "total", "email", "state", "price"], r.choice([0, 0, 2, 3, 4]))
        files.append((f"f{i}.ts", f"export {r.choice(kinds)} {name} {{\n" + "".join(f"  {p}: string;\n" for p in props) + "}\n"))
    d = spark.createDataFrame(files, "relative_path string, content string")
    e = more_rules.entities(d)
    a, b = (e.select([F.col(c).alias(f"{c}_{x}") for c in e.columns]) for x in "ab")
    p = a.crossJoin(b).filter("kind_a = kind_b and concat(file_a, ':', line_a) < concat(file_b, ':', line_b) and file_a <> file_b and name_a <> name_b")
    n = text.concept_similarity(F.col("name_a"), F.col("name_b"))
    both = (F.size("props_a") > 0) & (F.size("props_b") > 0)
    s = F.when(both, 0.4 * n + 0.6 * text.jaccard(F.col("props_a"), F.col("props_b"))).otherwise(n)
    want = p.filter(s >= least).select("file_b", "line_b", F.concat("name_b", F.lit(" is like "), "name_a").alias("m"))
    got = more_rules.drift(d, least).select("file", "line", "message")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 5
