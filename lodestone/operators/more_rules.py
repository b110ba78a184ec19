"""Rules that look at files, scopes and components as wholes, and a registry for rules of one's own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import scopes, tokens
from lodestone.operators.lines import latch, lines_of
from lodestone.operators.materialize import settle
from lodestone.operators.rules import RULES, shaped
from lodestone.operators.similar import concept_pairs, set_pairs


def _file(files: DataFrame, where, rule: str, severity: str, message: str) -> DataFrame:
    return shaped(files.filter(where).withColumn("line", F.lit(1)), rule, severity, F.lit(message), "relative_path")


def domains(edges: DataFrame, allowed: list[tuple[str, str]] = ()) -> DataFrame:
    """Imports from one domain folder into another that is not allowed; `shared` and `common` are open to all."""
    def name(c: str):
        return F.regexp_extract(c, r"(?:^|/)(?:domains?|modules|contexts|features)/([^/]+)/", 1)

    d = edges.withColumns({"a": name("src"), "b": name("dst")}).filter("a <> '' and b <> '' and a <> b and b not in ('shared', 'common')")
    if allowed:
        d = d.filter(~F.struct("a", "b").isin(*[F.struct(F.lit(x), F.lit(y)) for x, y in allowed]))
    return shaped(d.withColumn("line", F.lit(1)), "ddd-boundaries", "error", F.concat("a", F.lit(" uses "), "b"), "src")


def ddd_files(files: DataFrame) -> DataFrame:
    c = F.col("content")
    a = _file(files, F.col("relative_path").rlike("(?i)entity") & c.rlike(r"constructor\s*\([^)]*[Rr]epository"), "ddd-boundaries", "warning", "entity with a repository")
    b = _file(files, c.rlike(r"class\s+\w*Aggregate") & ~c.rlike("(?i)validate|invariant"), "ddd-boundaries", "warning", "aggregate root without invariants")
    r = _file(files, F.col("relative_path").rlike("(?i)repository") & c.rlike(r"(?i)calculate\w*\s*\(|applyDiscount"), "ddd-boundaries", "warning", "business logic in a repository")
    return a.unionByName(b).unionByName(r)


def transactions(files: DataFrame) -> DataFrame:
    """Several remote calls between begin and commit; several writes outside transaction and try; steps without compensation."""
    rows = lines_of(files.select("relative_path", "content"))
    rows = rows.withColumn("open", latch(F.col("line").rlike(r"(?i)begin(transaction)?\s*\("), F.col("line").rlike(r"(?i)(commit|rollback)\w*\s*\("), ["relative_path"], ["line_no"]))
    remote = rows.filter((F.col("open") == 1) & F.col("line").rlike(r"(?i)\b(fetch|axios|http\w*|grpc)\b"))
    many = remote.groupBy("relative_path").agg(F.count("*").alias("n"), F.min("line_no").alias("line")).filter("n > 1")
    a = shaped(many, "distributed-transactions", "error", F.format_string("%d remote calls in a transaction", "n"), "relative_path")
    c = F.col("content")
    writes = F.regexp_count(c, F.lit(r"\.(save|insert|update|delete|create)\s*\("))
    b = _file(files, (writes > 1) & ~c.rlike("(?i)transaction") & ~(c.rlike(r"\btry\b") & c.rlike(r"\b(catch|finally)\b")), "distributed-transactions", "warning", "several writes without a transaction")
    s = _file(files, c.rlike("(?i)saga") & c.rlike("(?i)step") & ~c.rlike("(?i)compensat|rollback"), "distributed-transactions", "warning", "saga without compensation")
    return a.unionByName(b).unionByName(s)


def resilience_files(files: DataFrame) -> DataFrame:
    client = F.col("relative_path").rlike("(?i)(service|client|adapter)") & F.col("content").rlike(r"(?i)\b(fetch|axios|http)\b")
    a = _file(files, client & ~F.col("content").rlike("(?i)circuit|breaker"), "resilience-patterns", "warning", "no circuit breaker")
    return a.unionByName(_file(files, client & ~F.col("content").rlike("(?i)retry|retries"), "resilience-patterns", "warning", "no retry"))


def data_classes(files: DataFrame) -> DataFrame:
    """Classes of files named as models, entities or transfer objects that nothing validates."""
    name = F.regexp_extract("content", r"class\s+(\w+)", 1)
    named = F.regexp_extract("relative_path", r"([^/]*)$", 1).rlike("(?i)model|entity|dto")
    bare = files.filter(named & (name != "") & ~F.col("content").rlike("@Valid|validate|IsNotEmpty|IsString|class-validator"))
    return shaped(bare.withColumn("line", F.lit(1)), "data-flow-integrity", "warning", F.concat(F.lit("data class without validation: "), name), "relative_path")


def leaks(files: DataFrame) -> DataFrame:
    """Listeners and intervals in files that never take one away."""
    pairs = ((r"addEventListener\s*\(", "removeEventListener", "listener"), (r"setInterval\s*\(", "clearInterval", "interval"))
    out = None
    for made, undone, what in pairs:
        rows = lines_of(files.filter(~F.col("content").contains(undone)).select("relative_path", "content")).filter(F.col("line").rlike(made))
        one = shaped(rows, "performance-antipatterns", "warning", F.lit(f"{what} without cleanup"), "relative_path", "line_no")
        out = one if out is None else out.unionByName(one)
    return out


def floating(files: DataFrame) -> DataFrame:
    """Calls of async functions of the project that are statements by themselves: neither awaited, returned, assigned, chained nor void."""
    shapes = tokens.shapes_of(files, "(")
    known = tokens.functions(None, shapes).filter("is_async").select("name").distinct()
    alone = tokens.calls(None, shapes).filter("alone").join(known, "name", "left_semi")
    return shaped(alone, "async-discrepancies", "error", F.concat(F.lit("floating call of "), "name"), "relative_path")


def mixed_async(files: DataFrame) -> DataFrame:
    rows = lines_of(files.select("relative_path", "content")).filter(F.col("line").rlike(r"\bawait\b.*\.(then|catch)\s*\("))
    return shaped(rows, "async-discrepancies", "warning", F.lit("await mixed with then"), "relative_path", "line_no")


def entities(files: DataFrame) -> DataFrame:
    """kind, name, file, line and property names (lower case, sorted) of interfaces, object types and classes, at any indentation."""
    tree, heads = tokens.tree_of(files)
    blocks = settle(tokens.bodies(heads).filter("role in ('interface', 'type', 'class') and name is not null"))
    props = tokens.members(tree, blocks).groupBy("relative_path", F.col("block").alias("n")).agg(F.array_sort(F.collect_set(F.lower("name"))).alias("props"))
    d = blocks.join(props, ["relative_path", "n"], "left")
    return d.select(F.col("role").alias("kind"), "name", F.col("relative_path").alias("file"), "line", F.coalesce("props", F.array().cast("array<string>")).alias("props"))


def drift(files: DataFrame, least: float = 0.75, allowed: list[list[str]] = ()) -> DataFrame:
    """Pairs of entities of one kind in different files that seem to be one concept: 0.4 name + 0.6 properties. Whole names (in
    lower case) of one group of allowed may stand beside one another.

    Two entities with properties need a Jaccard similarity of (least - 0.4) / 0.6, and meet by their rarest properties; where that is no
    bound, also by similar names, as without a common property only the name counts. An entity without properties meets others by
    similar names."""
    e = settle(entities(files).withColumn("id", F.concat_ws(":", "file", "line")))
    fields = ("id", "name", "file", "line", "props")
    a, b = (e.select("kind", *[F.col(c).alias(f"{c}_{x}") for c in fields]) for x in "ab")
    sets = e.filter(F.size("props") > 0).select(F.col("id").alias("name"), F.col("props").alias("s"))
    share = (least - 0.4) / 0.6
    met = set_pairs(sets, sets, share if share > 0 else 1e-5).select(F.col("a").alias("id_a"), F.col("b").alias("id_b"))
    p = a.join(met, "id_a").join(b, ["kind", "id_b"])

    def named(x: DataFrame, y: DataFrame, score: float) -> DataFrame:
        near = concept_pairs(x.select(F.col("name_a").alias("name")), y.select(F.col("name_b").alias("name")), max(score, 0.25)).select(F.col("a").alias("name_a"), F.col("b").alias("name_b"))
        return x.join(near, "name_a").join(y, ["kind", "name_b"])

    bare = lambda x, k: x.filter(F.size(f"props_{k}") == 0)
    p = p.unionByName(named(bare(a, "a"), b, least)).unionByName(named(a, bare(b, "b"), least))
    if share <= 0 and least <= 0.4:
        p = p.unionByName(named(a, b, least / 0.4))
    p = p.distinct()
    p = p.filter("id_a < id_b and file_a <> file_b and name_a <> name_b")
    names = text.concept_similarity(F.col("name_a"), F.col("name_b"))
    for group in allowed:
        p = p.filter(~(F.lower("name_a").isin(*group) & F.lower("name_b").isin(*group)))
    score = F.when((F.size("props_a") > 0) & (F.size("props_b") > 0), 0.4 * names + 0.6 * text.jaccard(F.col("props_a"), F.col("props_b"))).otherwise(names)
    p = p.withColumn("score", score).filter(F.col("score") >= least)
    return shaped(p, "context-drift-patterns", "warning", F.concat("name_b", F.lit(" is like "), "name_a"), "file_b", "line_b")


HOOKS = ("useEffect", "useCallback", "useMemo")


def to_closing(code: Column, opening: str = "(", closing: str = ")") -> Column:
    """The code up to the parenthesis that closes its first one; empty if none does."""
    def step(s: Column, c: Column) -> Column:
        depth = s["depth"] + F.when(c == opening, 1).when(c == closing, -1).otherwise(0)
        end = F.when((s["end"] == 0) & (c == closing) & (depth == 0), s["n"] + 1).otherwise(s["end"])
        return F.struct(depth.alias("depth"), (s["n"] + 1).alias("n"), end.alias("end"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.substr(code, F.lit(1), F.aggregate(F.split(code, ""), start, step)["end"])


def hook_dependencies(files: DataFrame) -> DataFrame:
    """What a hook reads of its component and its dependency list leaves out, by the scopes of names."""
    d = scopes.missing_dependencies(files.filter(F.col("relative_path").rlike(r"\.[jt]sx$")), HOOKS)
    return shaped(d, "react/missing-dependency-array", "warning", F.concat(F.lit("not in the dependency list: "), F.array_join("names", ", ")))


def component_names(files: DataFrame) -> DataFrame:
    """Functions that return markup but whose name has no capital first letter."""
    w = W.partitionBy("relative_path").orderBy("line_no").rowsBetween(0, 30)
    rows = lines_of(files.filter(F.col("relative_path").rlike(r"\.[jt]sx$")).select("relative_path", "content"))
    rows = rows.withColumn("body", F.concat_ws("\n", F.collect_list("line").over(w))).withColumn("name", F.regexp_extract("line", r"^\s*(?:export\s+)?(?:default\s+)?(?:function|const)\s+([a-z]\w*)\s*[=(]", 1))
    odd = rows.filter((F.col("name") != "") & ~F.col("name").startswith("use") & F.col("body").rlike(r"(?s)(return|=>)\s*\(?\s*<[A-Za-z]"))
    return shaped(odd, "react/inconsistent-component-naming", "warning", F.concat("name", F.lit(" should be "), text.pascal_component(F.col("name"))), "relative_path", "line_no")


MORE: dict[str, Callable[[DataFrame], DataFrame]] = {
    "ddd-boundaries": ddd_files, "distributed-transactions": transactions, "resilience-files": resilience_files, "leaks": leaks, "floating": floating,
    "mixed-async": mixed_async, "data-classes": data_classes, "context-drift-patterns": drift, "react/missing-dependency-array": hook_dependencies, "react/inconsistent-component-naming": component_names,
}


def register(name: str, rule: Callable[[DataFrame], DataFrame]) -> None:
    """A rule of one's own: it takes the files frame and gives file, line, rule, severity, message. Used by validate()."""
    RULES[name] = rule


for _name, _rule in MORE.items():
    register(_name, _rule)
