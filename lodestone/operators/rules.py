"""Rules over source files: each gives rows (file, line, rule, severity, message).

All line patterns run in one pass: a line's findings are one array, exploded once. Options of a rule are honoured; a comment
`lodestone-disable-line <rule>` silences a line.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import extract, graph, tokens
from lodestone.operators.lines import floored_counter, latch, lines_of
from lodestone.operators.materialize import settle

COMMENT = r"^\s*(//|\*|/\*|#)"


@dataclass(frozen=True)
class LineRule:
    rule: str
    message: str
    pattern: str
    severity: str = "warning"
    files: str = ""
    #: Lines before and after in which the guard may stand that makes the line right.
    guard: str = ""
    before: int = 0
    after: int = 0
    #: Words of which a line that fits has one (in small letters where the pattern begins with (?i)); files and lines without are not searched.
    need: tuple[str, ...] = ()


LINE_RULES = (
    LineRule("type-safety", "explicit any", r":\s*any\b|<any>|\bas\s+any\b", files=r"\.tsx?$", need=("any",)),
    LineRule("type-safety", "non-null assertion", r"\w!\.|\w!\[", files=r"\.tsx?$", need=("!.", "![")),
    LineRule("type-safety", "eval", r"\beval\s*\(|\bnew\s+Function\s*\(", "error", need=("eval", "Function")),
    LineRule("performance-antipatterns", "synchronous call", r"\b(readFileSync|writeFileSync|existsSync|execSync)\s*\(", need=("Sync",)),
    LineRule("performance-antipatterns", "infinite loop", r"\bwhile\s*\(\s*true\s*\)|\bfor\s*\(\s*;\s*;\s*\)", need=("while", "for")),
    LineRule("data-flow-integrity", "sensitive value in a log", r"(?i)(console\.|logger\.|\blog\().*(password|secret|token|api_?key|credit_?card|ssn)", "error", need=("password", "secret", "token", "api", "credit", "ssn")),
    LineRule("resilience-patterns", "empty catch", r"catch\s*(\([^)]*\))?\s*\{\s*\}", need=("catch",)),
    LineRule("resilience-patterns", "external call without timeout", r"(?i)\b(fetch|axios|http|request)\s*(\.\w+)?\(", guard=r"(?i)timeout|abort", before=10, after=9, need=("fetch", "axios", "http", "request")),
    LineRule("security-context", "route without guard", r"\b(app|router)\.(get|post|put|patch|delete)\s*\(", "error", r"(?i)(controller|route|api|handler)", r"(?i)auth|guard|protect|jwt", 5, 1, need=("app.", "router.")),
    LineRule("api-versioning", "unversioned route", r"\b(app|router)\.(get|post|put|patch|delete)\s*\(\s*['\"]/(?!api/v\d|v\d)", files=r"(?i)(controller|route|api)", need=("app.", "router.")),
    LineRule("hardcoded-secrets", "AWS key", r"AKIA[0-9A-Z]{16}", "error", need=("AKIA",)),
    LineRule("hardcoded-secrets", "private key", r"-----BEGIN (RSA |EC )?PRIVATE KEY-----", "error", need=("PRIVATE KEY",)),
    LineRule("hardcoded-secrets", "password in code", r"(?i)(password|passwd|pwd|secret|api_?key)\s*[:=]\s*['\"][^'\"]{8,}['\"]", "error", need=("password", "passwd", "pwd", "secret", "api")),
    LineRule("hardcoded-secrets", "token in code", r"eyJ[\w-]{10,}\.[\w-]{10,}\.[\w-]{5,}", "error", need=("eyJ",)),
    LineRule("hardcoded-secrets", "database address with a password", r"\b\w+://[^\s:@/]+:[^\s:@/]+@", "error", need=("://",)),
    LineRule("async-discrepancies", "await on a plain value", r"\bawait\s+(\d|['\"`\[{]|true\b|false\b|null\b|undefined\b|new\s+(?!Promise\b))", need=("await",)),
    LineRule("type-safety", "deep access without a check", r"\b(response|data|result|user|params|query)(\.\w+){3,}", files=r"\.tsx?$", guard=r"\bif\s*\(|&&|!==?\s*(null|undefined)", before=5, need=("response", "data", "result", "user", "params", "query")),
    LineRule("data-flow-integrity", "sensitive value in a request", r"(?i)\breq(uest)?\.(body|query|params)\.?\w*(password|secret|token|api_?key|credit_?card|ssn)", "error", need=("req",)),
    LineRule("security-context", "response without security headers", r"\bres(ponse)?\.(send|json)\s*\(", "info", r"(?i)(controller|route|api|handler)", r"(?i)helmet|setHeader|res\.set\(", 20, 0, need=(".send", ".json")),
    LineRule("security-context", "sensitive field in a response", r"(?i)\bres(ponse)?\.(send|json)\s*\(.*(password|secret|token|api_?key|credit_?card|ssn)", "error", need=(".send", ".json")),
    LineRule("api-versioning", "breaking change left to do", r"(?i)\bTODO\b.*\bbreaking\b", files=r"(?i)(controller|route|api)", need=("breaking",)),
    LineRule("api-versioning", "deprecated without a replacement", r"@deprecated\b", files=r"(?i)(controller|route|api)", guard=r"(?i)\buse\b|\breplacement\b", before=2, after=2, need=("@deprecated",)),
)


def shaped(df: DataFrame, rule: str, severity: str, message: Column, file: str = "file", line: str = "line") -> DataFrame:
    return df.select(F.col(file).alias("file"), F.col(line).cast("int").alias("line"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), message.alias("message"))


def line_findings(files: DataFrame, rules: tuple[LineRule, ...] = LINE_RULES) -> DataFrame:
    def needed(r: LineRule, text: Column, small: Column) -> Column:
        text = small if r.pattern.startswith("(?i)") else text
        return functools.reduce(Column.__or__, [F.contains(text, F.lit(w)) for w in r.need])

    def found(line: Column, i: Column) -> Column:
        checks = []
        for k, r in enumerate(rules):
            hit = line.rlike(r.pattern) & ~line.rlike(COMMENT) & ~line.contains(f"lodestone-disable-line {r.rule}")
            if r.guard:  # a slice of the file's own lines, read only where the line hits
                near = F.slice("lines", F.greatest(i + 1 - r.before, F.lit(1)), r.after + 1 + F.least(i, F.lit(r.before)))
                hit = hit & ~F.array_join(near, "\n").rlike(r.guard)
            hit = F.array_contains("asked", k) & (needed(r, line, F.lower(line)) & hit if r.need else hit)
            checks.append(F.when(hit, F.struct((i + 1).alias("line"), F.lit(r.rule).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(r.message).alias("message"))))
        return F.array_compact(F.array(*checks))

    # the rules that a file's path and words ask for; only files with one are split
    path, text = F.col("relative_path"), F.coalesce("content", F.lit(""))
    asked = [(path.rlike(r.files) if r.files else F.lit(True)) & (needed(r, F.col("text"), F.col("small")) if r.need else F.lit(True)) for r in rules]
    rows = files.select("relative_path", text.alias("text"), F.lower(text).alias("small"))
    rows = rows.select("relative_path", "text", F.array_compact(F.array(*[F.when(x, k) for k, x in enumerate(asked)])).alias("asked"))
    rows = rows.select("relative_path", "asked", F.when(F.size("asked") > 0, F.split("text", "\n")).alias("lines"))
    each = rows.select(F.col("relative_path").alias("file"), F.inline(F.flatten(F.transform("lines", found))))
    return each.select("file", "line", "rule", "severity", "message")


def line_rules(files: DataFrame) -> DataFrame:
    """What lines show by themselves, and JSON.parse outside the braces of a try."""
    parse = tokens.calls(None, tokens.shapes_of(files, "(").filter("tries = 0")).filter("on = 'JSON' and name = 'parse'")
    return line_findings(files).unionByName(shaped(parse, "type-safety", "warning", F.lit("JSON.parse outside try"), "relative_path"))


def n_plus_one(files: DataFrame) -> DataFrame:
    """Database calls inside a loop; a line with more closing than opening braces ends it."""
    rows = lines_of(files.select("relative_path", "content"))
    loop = F.col("line").rlike(r"\b(for|while)\s*\(|\.(forEach|map)\s*\(")
    ends = F.length(F.regexp_replace("line", "[^}]", "")) > F.length(F.regexp_replace("line", "[^{]", ""))
    rows = rows.withColumns({"open": latch(loop, ends, ["relative_path"], ["line_no"]), "starts": loop})
    call = F.col("line").rlike(r"\.(find|findOne|findById|query|save|update|delete)\s*\(|\bSELECT\b")
    return shaped(rows.filter(call & (F.col("starts") | (F.col("open") == 1))), "performance-antipatterns", "warning", F.lit("query in a loop"), "relative_path", "line_no")


def nesting(files: DataFrame, most: int = 3) -> DataFrame:
    rows = lines_of(files.select("relative_path", "content"))
    loops = F.when(F.col("line").rlike(r"\b(for|while)\s*\("), 1).otherwise(0) - F.when(F.col("line").rlike(r"^\s*\}\s*$"), 1).otherwise(0)
    deep = floored_counter(rows, loops, ["relative_path"], ["line_no"]).filter((F.col("depth") > most) & F.col("line").rlike(r"\b(for|while)\s*\("))
    return shaped(deep, "performance-antipatterns", "warning", F.lit("deeply nested loop"), "relative_path", "line_no")


def sought(deps: DataFrame) -> DataFrame:
    """Dependencies whose file should be there: neither virtual modules nor styles and pictures."""
    return deps.filter(~F.col("target").rlike(r"^(virtual:|~)|\.(css|scss|svg|png|jpg)$"))


def unresolved_imports(files: DataFrame, inventory: DataFrame, aliases: dict[str, str] | None = None, deps: DataFrame | None = None) -> DataFrame:
    """Relative and aliased imports of nothing among all paths of the project. deps: the dependencies of files, if they are known."""
    deps = sought(extract.dependencies(files) if deps is None else deps)
    miss = extract.resolved(deps, inventory, aliases or {"@/": "src/"}).filter("file is null")
    return shaped(miss, "ai-hallucinated-imports", "error", F.concat(F.lit("import of a file that is not there: "), "target"), "source")


def circular(edges: DataFrame, longest: int = graph.MAX_CYCLE) -> DataFrame:
    c = graph.cycles(edges, longest).select(F.col("cycle")[0].alias("file"), F.lit(1).alias("line"), F.array_join("cycle", " -> ").alias("p"))
    return shaped(c, "circular-dependencies", "warning", F.concat(F.lit("cycle: "), "p"))


def layers(edges: DataFrame, files: DataFrame, allowed: DataFrame) -> DataFrame:
    bad = graph.forbidden(edges, files.filter("layer is not null").select(F.col("relative_path").alias("id"), "layer"), allowed)
    return shaped(bad, "layer-dependencies", "error", F.concat("source_layer", F.lit(" may not use "), "target_layer"), "src")


DECLARED = r"^\s*(?:async\s+)?function\s+(\w+)|^\s*(?:const|let)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>"


def orphans(files: DataFrame, ignore: str = r"^(main|init|setup|render|handler|default|_.*)$") -> DataFrame:
    """Functions of scripts that are not exported and whose name stands nowhere else in the project."""
    rows = lines_of(files.filter("language in ('typescript', 'javascript')").filter(~F.col("relative_path").rlike(r"(test|spec)\.")).select("relative_path", "content"))
    name = F.coalesce(F.nullif(F.regexp_extract("line", DECLARED, 1), F.lit("")), F.nullif(F.regexp_extract("line", DECLARED, 2), F.lit("")))
    declared = rows.withColumn("name", name).filter("name is not null and length(name) > 2").filter(~F.col("name").rlike(ignore))
    words = rows.withColumn("declares", name).select("declares", F.explode(F.regexp_extract_all("line", F.lit(r"[A-Za-z_$][\w$]*"), F.lit(0))).alias("name"))
    used = words.filter("declares is null or declares <> name").select("name").distinct()
    return shaped(declared.join(used, "name", "left_anti"), "orphaned-functions", "warning", F.concat(F.lit("never used: "), "name"), "relative_path", "line_no")


def phantom_types(files: DataFrame) -> DataFrame:
    """Type names after `:` that no file defines or imports."""
    rows = lines_of(files.filter(F.col("relative_path").rlike(r"\.tsx?$")).select("relative_path", "content"))
    refs = rows.select("relative_path", "line_no", F.explode(F.regexp_extract_all("line", F.lit(r"(?::\s*|extends\s+|implements\s+|<\s*|[|&]\s*|\bas\s+)([A-Z]\w*)"), F.lit(1))).alias("name"))
    defs = rows.select(F.explode(F.regexp_extract_all("line", F.lit(r"\b(?:interface|type|class|enum)\s+([A-Z]\w*)"), F.lit(1))).alias("name"))
    imported = rows.filter(F.col("line").rlike(r"^\s*import\b")).select("relative_path", F.explode(F.regexp_extract_all("line", F.lit(r"[A-Z]\w*"), F.lit(0))).alias("name"))
    # Names that the language itself defines.
    known = ("Array", "Promise", "Record", "Map", "Set", "Date", "Error", "Partial", "Required", "Readonly", "Pick", "Omit", "Function", "Object", "String", "Number", "Boolean", "RegExp", "Buffer")
    miss = refs.filter(~F.col("name").isin(*known)).join(defs.distinct(), "name", "left_anti").join(imported.distinct(), ["relative_path", "name"], "left_anti")
    return shaped(miss, "phantom-type-references", "error", F.concat(F.lit("type is defined nowhere: "), "name"), "relative_path", "line_no")


def casing(files: DataFrame) -> DataFrame:
    """Names of functions and variables that differ from a file's dominant style (70 % of five at least)."""
    rows = lines_of(files.select("relative_path", "content"))
    name = F.regexp_extract("line", r"\b(?:function|const|let|var|def)\s+([A-Za-z_]\w+)", 1)
    ids = rows.withColumn("name", name).filter("length(name) >= 2").withColumn("style", text.casing(F.col("name"))).filter("style not in ('unknown', 'SCREAMING_SNAKE_CASE', 'PascalCase')")
    n = ids.groupBy("relative_path", "style").agg(F.count("*").alias("n"))
    w = W.partitionBy("relative_path")
    top = n.withColumns({"total": F.sum("n").over(w), "rank": F.row_number().over(w.orderBy(F.desc("n"), "style"))}).filter("rank = 1 and total >= 5 and n >= 0.7 * total")
    odd = ids.join(top.select("relative_path", F.col("style").alias("main")), "relative_path").filter("style <> main")
    return shaped(odd, "inconsistent-casing", "warning", F.concat("name", F.lit(" is not "), "main"), "relative_path", "line_no")


def log_only_catch(files: DataFrame) -> DataFrame:
    """A catch whose next lines log and then close, without throwing, returning or calling anything else."""
    rows = lines_of(files.select("relative_path", "content"))
    w = W.partitionBy("relative_path").orderBy("line_no")
    rows = rows.withColumn("after", F.concat_ws("\n", F.collect_list("line").over(w.rowsBetween(1, 3))))
    hit = F.col("line").rlike(r"\bcatch\s*(\([^)]*\))?\s*\{\s*$") & F.col("after").rlike(r"^\s*(console|logger|log)\.\w+\([^\n]*\n\s*\}")
    return shaped(rows.filter(hit), "resilience-patterns", "warning", F.lit("catch that only logs"), "relative_path", "line_no")


def unnecessary_async(files: DataFrame, ignore: str = r"^(main|init|setup|handler|render)$") -> DataFrame:
    """Async functions whose lines, up to the next function at their depth, hold no await and no Promise type in the first two.

    A function's lines are those from its own to the first closing brace at its indentation."""
    rows = lines_of(files.filter("language in ('typescript', 'javascript')").select("relative_path", "content"))
    head = r"^(\s*)(?:export\s+)?(?:default\s+)?(?:async\s+function\s+(\w+)|(?:const|let)\s+(\w+)\s*=\s*async\b)"
    w = W.partitionBy("relative_path").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("at", F.last(F.when(F.col("line").rlike(head), F.col("line_no")), ignorenulls=True).over(w)).filter("at is not null")
    own = F.when(F.col("line_no") == F.col("at"), F.col("line"))
    rows = rows.withColumn("head", F.first(own, ignorenulls=True).over(W.partitionBy("relative_path", "at")))
    one_line = F.col("head").rlike(r"\}\s*;?\s*$")
    end = (F.col("line_no") > F.col("at")) & F.col("line").rlike(r"^\s*\}") & (F.length(F.regexp_extract("line", r"^(\s*)", 1)) <= F.length(F.regexp_extract("head", head, 1)))
    rows = rows.withColumn("shut", F.coalesce(F.max(end.cast("int")).over(W.partitionBy("relative_path", "at").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.filter((F.col("shut") == 0) & (~one_line | (F.col("line_no") == F.col("at"))))
    waits = F.max(F.col("line").rlike(r"\bawait\b").cast("int"))
    typed = F.max((F.col("line").rlike("Promise<") & (F.col("line_no") <= F.col("at") + 1)).cast("int"))
    body = rows.groupBy("relative_path", "at").agg(F.first("head").alias("head"), waits.alias("waits"), typed.alias("typed")).filter("waits = 0 and typed = 0")
    name = F.coalesce(F.nullif(F.regexp_extract("head", head, 2), F.lit("")), F.nullif(F.regexp_extract("head", head, 3), F.lit("")))
    body = body.withColumn("name", name).filter(~F.col("name").rlike(ignore))
    return shaped(body, "async-discrepancies", "warning", F.concat(F.lit("async without await: "), "name"), "relative_path", "at")


RULES: dict[str, Callable[..., DataFrame]] = {"lines": line_rules, "n-plus-one": n_plus_one, "nesting": nesting, "orphaned-functions": orphans, "phantom-type-references": phantom_types, "inconsistent-casing": casing, "log-only-catch": log_only_catch, "unnecessary-async": unnecessary_async}


def mutating_calls(files: DataFrame) -> DataFrame:
    rows = lines_of(files.select("relative_path", "content")).filter(~F.col("line").rlike(COMMENT))
    name = F.regexp_extract("line", r"\w\.(push|pop|shift|unshift|splice|sort|reverse)\s*\(", 1)
    return shaped(rows.withColumn("name", name).filter("name <> ''"), "data-flow-integrity", "info", F.concat(F.lit("array changed in place: "), "name"), "relative_path", "line_no")


def type_assertions(files: DataFrame) -> DataFrame:
    rows = lines_of(files.filter(F.col("relative_path").rlike(r"\.tsx?$")).select("relative_path", "content")).filter(~F.col("line").rlike(COMMENT + r"|^\s*(import|export)\b"))
    hit = F.col("line").rlike(r"\bas\s+(?!const\b|any\b)[A-Za-z]|[=(,]\s*<[A-Z]\w*>\s*\w")
    return shaped(rows.filter(hit), "type-safety", "info", F.lit("type assertion"), "relative_path", "line_no")


#: Rules that run only where they are asked for by name.
OPTIONAL: dict[str, Callable[..., DataFrame]] = {"mutating-calls": mutating_calls, "type-assertions": type_assertions}


# Layers, words of paths that tell them (the first layer that has one), and the layers that each may use.
LAYER_WORDS = (
    ("presentation", ("controller", "handler", "view", "component", "page"), ("application", "domain")),
    ("application", ("service", "usecase", "application"), ("domain", "infrastructure")),
    ("domain", ("entity", "domain", "model", "aggregate", "value-object"), ()),
    ("infrastructure", ("repository", "adapter", "infrastructure", "persistence"), ("domain",)),
)


def layers_by_name(edges: DataFrame, words: tuple = LAYER_WORDS) -> DataFrame:
    """Edges between layers that are told by words of their paths and that the table does not allow."""
    def layer(c: str) -> Column:
        return F.coalesce(*[F.when(F.lower(c).rlike("|".join(of)), w) for w, of, _ in words])

    d = edges.withColumns({"a": layer("src"), "b": layer("dst")}).filter("a <> b")
    ok = F.lit(False)
    for w, _, allowed in words:
        ok = ok | ((F.col("a") == w) & F.col("b").isin(*allowed) if allowed else F.lit(False))
    return shaped(d.filter(~ok), "layer-dependencies", "error", F.concat("a", F.lit(" may not use "), "b"), "src")


def validate(
    files: DataFrame, only: list[str] | None = None, inventory: DataFrame | None = None, levels: dict[str, str] | None = None, specs: DataFrame | None = None,
    schemas: DataFrame | None = None, shared: str | None = None, callers: str | None = None, allowed: DataFrame | None = None,
) -> DataFrame:
    """All findings. levels: rule to severity or `off`, which is left out of the result.

    Groups that need more than the files run where that is given: contracts (specs: OpenAPI texts; schemas: GraphQL texts),
    signatures (shared and callers: patterns of paths), layers (allowed: pairs of layers; files has layer); imports, cycles
    and domains always do."""
    from lodestone.operators import contracts, more_rules, react  # noqa: F401  react registers its rules

    files = settle(files)
    rest: dict[str, DataFrame] = {}

    def deps() -> DataFrame:
        if "deps" not in rest:
            rest["deps"] = settle(extract.dependencies(files))
        return rest["deps"]

    def edges() -> DataFrame:
        if "edges" not in rest:
            rest["edges"] = settle(extract.edges(deps(), files))
        return rest["edges"]

    groups: dict[str, Callable[[], DataFrame] | None] = {name: (lambda r=rule: r(files)) for name, rule in (RULES | OPTIONAL).items()}
    groups["imports"] = lambda: unresolved_imports(files, inventory if inventory is not None else files, deps=deps())
    groups["cycles"] = lambda: circular(edges())
    groups["domains"] = lambda: more_rules.domains(edges())
    if specs is not None:
        groups["contracts"] = lambda: contracts.mismatches(files, specs)
    if schemas is not None:
        groups["graphql"] = lambda: contracts.graphql_mismatches(files, schemas)
    if shared and callers:
        groups["signatures"] = lambda: contracts.signatures(files, shared, callers)
        groups["fields"] = lambda: contracts.field_misses(files, shared, callers)
    if allowed is not None:
        groups["layers"] = lambda: layers(edges(), files, allowed)
    for name in only or []:
        if name not in groups:
            raise ValueError(f"no rule group {name}, or something that it needs is not given")
    wanted = only or [g for g in groups if g not in OPTIONAL]
    found = functools.reduce(DataFrame.unionByName, [groups[g]() for g in groups if g in wanted])
    for rule, level in (levels or {}).items():
        found = found.filter(F.col("rule") != rule) if level == "off" else found.withColumn("severity", F.when(F.col("rule") == rule, {"warn": "warning"}.get(level, level)).otherwise(F.col("severity")))
    return found
