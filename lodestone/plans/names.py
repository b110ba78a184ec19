"""Similar names: distinct names meet by the signatures of operators.similar; only what may reach a threshold is scored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import similar
from lodestone.operators.materialize import settle
from lodestone.sources.tables import table


def part_names(spark, d) -> DataFrame:
    return settle(similar.names_of(table(spark, d, "part"), "p_name"))


def fuzzy_names(spark, d):
    n = part_names(spark, d)
    p = similar.edit_pairs(n, n, 0.7).filter("a < b")
    return p.select("a", "b", F.round("score", 6).alias("score")).filter("score >= 0.7")


def fuzzy_top3(spark, d):
    """The three most similar other names, of those with a score from 0.3 to below 1: a name that has three pairs above a threshold
    needs no others, so only the rest goes on to the next lower one."""
    n = part_names(spark, d)
    left, out = n, None
    a, b = F.col("a"), F.col("b")
    score = F.round(F.greatest(text.edit_similarity(F.lower(a), F.lower(b)), text.affix_similarity(a, b), text.jaccard(text.name_words(a), text.name_words(b))), 6)
    words = lambda x: x.select("name", F.array_distinct(text.name_words(F.col("name"))).alias("s"))
    for least in (0.75, 0.5, 0.3):
        p = similar.lower_edit_candidates(left, n, least).unionByName(similar.affix_pairs(left, n)).unionByName(similar.set_pairs(words(left), words(n), least).select("a", "b"))
        p = p.filter("a <> b").distinct().withColumn("score", score).filter((F.col("score") >= least) & (F.col("score") < 1))
        ranked = p.withColumns({"rank": F.row_number().over(W.partitionBy("a").orderBy(F.desc("score"), "b")), "n": F.count("*").over(W.partitionBy("a"))})
        found = settle(ranked.filter("rank <= 3"))
        if least > 0.3:
            left = settle(left.join(found.filter("n >= 3").select(F.col("a").alias("name")), "name", "left_anti"))
            found = found.filter("n >= 3")
        found = found.select("a", "b", "score", "rank")
        out = found if out is None else out.unionByName(found)
    return out


def structural_drift(spark, d):
    """Names of similar spelling whose sets of brands differ or agree: 0.4 of the one and 0.6 of the other make at least 0.5, so the sets
    agree by a sixth."""
    sets = settle(table(spark, d, "part").filter("p_name is not null").groupBy(F.col("p_name").alias("name")).agg(F.collect_set("p_brand").alias("s")))
    p = similar.set_pairs(sets, sets, 1 / 6).filter("a < b")
    score = 0.4 * text.edit_similarity(F.col("a"), F.col("b")) + 0.6 * F.col("score")
    return p.select("a", "b", F.round(score, 6).alias("score")).filter("score >= 0.5")


def type_suggestion(spark, d):
    """For each name of a part the most similar other name, suffixes stripped."""
    n = part_names(spark, d)
    stem = n.select("name", F.regexp_replace("name", "(ed|er|et|ing)$", "").alias("k"))
    same = stem.select(F.col("name").alias("a"), "k").join(stem.select(F.col("name").alias("b"), "k"), "k").select("a", "b", F.lit(0.95).alias("score"))
    p = similar.edit_pairs(n, n, 0.6).unionByName(same).filter("a <> b")
    # a pair of one stem has 0.95, whatever its edits
    p = p.groupBy("a", "b").agg(F.round(F.coalesce(F.max(F.when(F.col("score") == 0.95, 0.95)), F.max("score")), 6).alias("score")).filter("score > 0.6")
    rank = F.row_number().over(W.partitionBy("a").orderBy(F.desc("score"), "b"))
    return p.withColumn("rank", rank).filter("rank = 1").drop("rank")


def camel_split(spark, d):
    """Values of categories in camel and Pascal case."""
    parts = ("c_mktsegment", "customer"), ("o_orderpriority", "orders"), ("p_type", "part"), ("n_name", "nation")
    out = None
    for c, t in parts:
        v = table(spark, d, t).select(F.lit(c).alias("category"), F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_").alias("value")).distinct()
        out = v if out is None else out.unionByName(v)
    return out.select("category", "value", text.restyle(F.col("value"), "camelCase").alias("camel"), text.restyle(F.col("value"), "PascalCase").alias("pascal"))


def greedy_groups(spark, d):
    """Of each type of parts: names in the order of their first part take later names, which are like them by three quarters, for variants."""
    p = table(spark, d, "part").filter("p_name is not null")
    n = part_names(spark, d)
    near = similar.edit_pairs(n, n, 0.75).filter("a <> b and round(score, 6) >= 0.75")
    return similar.first_fits(p.select(F.col("p_type").alias("kind"), F.col("p_name").alias("name"), F.col("p_partkey").alias("ord")), near)


QUERIES = {f.__name__: f for f in (fuzzy_names, fuzzy_top3, structural_drift, type_suggestion, camel_split, greedy_groups)}
_N = "n AS (SELECT DISTINCT p_name AS name FROM part), p AS (SELECT x.name AS a, y.name AS b FROM n x, n y WHERE x.name <> y.name)"
_ED = "(1 - CAST(levenshtein({0}, {1}) AS DOUBLE) / greatest(length({0}), length({1})))"
_JAC = "(CAST(len(list_intersect({0}, {1})) AS DOUBLE) / len(list_distinct(list_concat({0}, {1}))))"
ORACLES = {
    "fuzzy_names": f"WITH {_N} SELECT * FROM (SELECT a, b, round({_ED.format('a', 'b')}, 6) AS score FROM p WHERE a < b) WHERE score >= 0.7",
    "fuzzy_top3": f"""WITH {_N}, s AS (SELECT a, b, round(greatest({_ED.format('lower(a)', 'lower(b)')},
  CASE WHEN ends_with(a, b) THEN 0.8 WHEN ends_with(b, a) OR starts_with(b, a) THEN 0.7 WHEN starts_with(a, b) THEN 0.75 ELSE 0.0 END,
  {_JAC.format("string_split(lower(a), ' ')", "string_split(lower(b), ' ')")}), 6) AS score FROM p)
SELECT * FROM (SELECT a, b, score, CAST(row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS INTEGER) AS rank FROM s WHERE score >= 0.3 AND score < 1) WHERE rank <= 3""",
    "structural_drift": f"""WITH {_N}, s AS (SELECT p_name, list(DISTINCT p_brand) AS v FROM part GROUP BY p_name)
SELECT * FROM (SELECT a, b, round(0.4 * {_ED.format('a', 'b')} + 0.6 * {_JAC.format('sa.v', 'sb.v')}, 6) AS score
FROM p JOIN s sa ON sa.p_name = a JOIN s sb ON sb.p_name = b WHERE a < b) WHERE score >= 0.5""",
    "type_suggestion": f"""WITH {_N}, s AS (SELECT a, b, round(CASE WHEN regexp_replace(a, '(ed|er|et|ing)$', '') = regexp_replace(b, '(ed|er|et|ing)$', '') THEN 0.95
  ELSE {_ED.format('a', 'b')} END, 6) AS score FROM p)
SELECT a, b, score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rank FROM s WHERE score > 0.6) WHERE rank = 1""",
    "greedy_groups": f"""WITH RECURSIVE o AS (
  SELECT kind, name, row_number() OVER (PARTITION BY kind ORDER BY ord, name) AS k FROM (SELECT p_type AS kind, p_name AS name, min(p_partkey) AS ord FROM part WHERE p_name IS NOT NULL GROUP BY ALL)
), r AS (
  SELECT kind, k, [name] AS heads FROM o WHERE k = 1
  UNION ALL SELECT o.kind, o.k, CASE WHEN len(list_filter(heads, lambda h: {_ED.format('h', 'name')} >= 0.75)) > 0 THEN heads ELSE list_append(heads, name) END
  FROM r JOIN o ON o.kind = r.kind AND o.k = r.k + 1
), l AS (SELECT kind, max_by(heads, k) AS heads FROM r GROUP BY kind),
v AS (SELECT kind, list_filter(heads, lambda h: {_ED.format('h', 'name')} >= 0.75)[1] AS canonical, name AS variant FROM o JOIN l USING (kind) WHERE NOT list_contains(heads, name)),
s AS (SELECT *, round({_ED.format('canonical', 'variant')}, 6) AS score FROM v)
SELECT *, round(avg(score) OVER (PARTITION BY kind, canonical), 6) AS group_mean FROM s""",
    "camel_split": """WITH v AS (SELECT 'c_mktsegment' AS category, c_mktsegment AS v FROM customer UNION SELECT 'o_orderpriority', o_orderpriority FROM orders
  UNION SELECT 'p_type', p_type FROM part UNION SELECT 'n_name', n_name FROM nation),
x AS (SELECT DISTINCT category, regexp_replace(lower(v), '[^a-z0-9]+', '_', 'g') AS value FROM v),
w AS (SELECT *, list_filter(string_split(value, '_'), lambda s: s <> '') AS ws FROM x),
c AS (SELECT *, list_transform(ws, lambda s: upper(s[1]) || s[2:]) AS cs FROM w)
SELECT category, value, ws[1] || array_to_string(cs[2:], '') AS camel, array_to_string(cs, '') AS pascal FROM c""",
}
