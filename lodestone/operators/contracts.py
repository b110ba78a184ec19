"""API calls against an API description, and calls against exported functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import extract, tokens
from lodestone.operators.lines import lines_of
from lodestone.operators.materialize import settle
from lodestone.operators.routes import first_fitting
from lodestone.operators.rules import shaped
from lodestone.operators.similar import name_pairs, name_score

METHODS = ("get", "post", "put", "patch", "delete", "head", "options")
SERVER = r"(?i)(^|/)(server|api|backend|controllers?|routes?)/"


def endpoints(specs: DataFrame) -> DataFrame:
    """specs(content): OpenAPI JSON. ord, method, path, deprecated, required (query names); path-level parameters count."""
    param = "struct<name:string,`in`:string,required:boolean>"
    op = f"struct<deprecated:boolean,parameters:array<{param}>>"
    item = ",".join([*(f"{m}:{op}" for m in METHODS), f"parameters:array<{param}>"])
    d = specs.select(F.from_json("content", f"struct<paths:map<string,struct<{item}>>>").alias("s"))
    d = d.select(F.explode("s.paths").alias("path", "item"))
    each = F.array_compact(F.array(*[F.when(F.col(f"item.{m}").isNotNull(), F.struct(F.lit(m.upper()).alias("method"), F.col(f"item.{m}").alias("op"))) for m in METHODS]))
    d = d.select("path", "item", F.explode(each).alias("x"))
    every = F.concat(F.coalesce("item.parameters", F.array().cast(f"array<{param}>")), F.coalesce("x.op.parameters", F.array().cast(f"array<{param}>")))
    required = F.transform(F.filter(every, lambda p: (p["in"] == "query") & F.coalesce(p["required"], F.lit(False))), lambda p: p["name"])
    return d.select("x.method", "path", F.coalesce("x.op.deprecated", F.lit(False)).alias("deprecated"), required.alias("required"))


def graphql_fields(schemas: DataFrame) -> DataFrame:
    """schemas(content): operation (Query, Mutation, Subscription), field, deprecated."""
    block = F.explode(F.regexp_extract_all("content", F.lit(r"(?s)(type\s+(?:Query|Mutation|Subscription)\s*\{[^}]*\})"), F.lit(1)))
    d = schemas.select(block.alias("b")).select(F.regexp_extract("b", r"type\s+(\w+)", 1).alias("operation"), F.explode(F.split(F.regexp_extract("b", r"(?s)\{(.*)\}", 1), "\n")).alias("line"))
    return d.select("operation", F.regexp_extract("line", r"^\s*(\w+)\s*(?:\([^)]*\))?\s*:", 1).alias("field"), F.contains("line", F.lit("@deprecated")).alias("deprecated")).filter("field <> ''")


def api_calls(files: DataFrame) -> DataFrame:
    """file, line, method, path (with {param}) and query names of calls in files that are no server's; a fetch may name its method on a later line."""
    rows = lines_of(files.filter(~F.col("relative_path").rlike(SERVER)).select("relative_path", "content"))
    verb = r"\b(?:axios|http|httpClient|api)\.(get|post|put|patch|delete)\s*(?:<[^>]*>)?\(\s*['\"`]([^'\"`]+)['\"`]"
    get = r"\bfetch\s*\(\s*['\"`]([^'\"`]+)['\"`]"
    # options on later lines: the method that comes next, if no line that closes them comes before it
    back = W.partitionBy("relative_path").orderBy(F.desc("line_no")).rowsBetween(W.unboundedPreceding, 0)
    named = F.upper(F.regexp_extract("line", r"\bmethod\s*:\s*['\"`](\w+)['\"`]", 1))
    rows = rows.withColumn("named", F.last(F.when(named != "", F.struct("line_no", named.alias("method"))), ignorenulls=True).over(back))
    rows = rows.withColumn("closed", F.last(F.when(F.col("line").rlike(r"^\s*\}\s*\)"), F.col("line_no")), ignorenulls=True).over(back))
    open_ = F.col("line").rlike(get + r"\s*,\s*(\{[^}]*)?$") & (F.col("named.line_no") <= F.coalesce("closed", F.col("named.line_no")))
    method = F.when(named != "", named).when(open_, F.col("named.method")).otherwise("")
    call = (
        F.when(F.col("line").rlike(verb), F.struct(F.upper(F.regexp_extract("line", verb, 1)).alias("method"), F.regexp_extract("line", verb, 2).alias("url")))
        .when(F.col("line").rlike(get), F.struct(F.when(method == "", "GET").otherwise(method).alias("method"), F.regexp_extract("line", get, 1).alias("url")))
    )
    d = rows.withColumn("x", call).filter("x is not null")
    path = F.regexp_replace(text.route(F.col("x.url")), r"^https?://[^/]+", "")
    return d.select(F.col("relative_path").alias("file"), F.col("line_no").alias("line"), "x.method", path.alias("path"), text.query_names(F.col("x.url")).alias("query"))


def mismatches(files: DataFrame, specs: DataFrame) -> DataFrame:
    """Calls of endpoints that no description has, of deprecated ones, and without required query parameters.

    The path itself comes before patterns that fit it (see routes.py), these in their order."""
    ends, calls = settle(endpoints(specs)), api_calls(files)
    route = first_fitting(calls, ends.select("method", F.col("path").alias("route")))
    best = ends.groupBy("method", F.col("path").alias("route")).agg(F.min(F.struct("deprecated", "required")).alias("e"))
    d = calls.join(route.join(best, ["method", "route"]).drop("route"), ["method", "path"], "left")
    lacks = F.array_except("e.required", "query")
    message = (
        F.when(F.col("e").isNull(), F.concat(F.lit("unknown endpoint "), "method", F.lit(" "), "path"))
        .when(F.col("e.deprecated"), F.concat(F.lit("deprecated endpoint "), "path"))
        .when(F.size(lacks) > 0, F.concat(F.lit("missing query parameter "), F.array_join(lacks, ", ")))
    )
    return shaped(d.withColumn("m", message).filter("m is not null"), "contract-mismatch", "error", F.col("m"))


def exported_functions(files: DataFrame, among: str = "") -> DataFrame:
    """name, kind (function, arrow, method), file, line, least and most parameters and their names; of one name and kind of call (plain, or on an
    object) the last in order of file and line counts."""
    d = tokens.functions(None, tokens.shapes_of(files, "(")).filter("exported and name <> 'constructor'").withColumn("on", F.col("kind") == "method").withColumnRenamed("relative_path", "file")
    d = d.filter(F.col("file").rlike(among))
    return d.groupBy("name", "on").agg(F.max_by(F.struct("file", "line", "least", "most", F.array_compact("params").alias("params")), F.struct("file", "line")).alias("x")).select("name", "on", "x.*")


def graphql_calls(files: DataFrame) -> DataFrame:
    """file, line, operation (Query, Mutation, Subscription) and the fields selected at its top, of gql templates."""
    start = r"gql`\s*(query|mutation|subscription)\b[^{]*\{([^`]*)"
    whole = files.select("relative_path", F.posexplode(F.split("content", r"(?=gql`)")).alias("k", "piece"), "content").filter(F.col("piece").startswith("gql`"))
    before = F.array_join(F.slice(F.split("content", r"(?=gql`)"), F.lit(1), F.col("k")), "")
    rows = whole.select("relative_path", (F.length(before) - F.length(F.replace(before, F.lit("\n"))) + 1).alias("line"), F.initcap(F.regexp_extract("piece", start, 1)).alias("operation"), F.regexp_extract("piece", start, 2).alias("body")).filter("operation <> ''")
    flat = F.col("body")
    for _ in range(6):  # selections within selections and arguments go, from the inside out
        flat = F.regexp_replace(flat, r"\{[^{}]*\}|\([^()]*\)", " ")
    top = F.regexp_extract_all(F.regexp_replace(F.regexp_replace(flat, r"\}[\s\S]*$", ""), r"\w+\s*:\s*", ""), F.lit(r"(?<![\w.@$])([A-Za-z_]\w*)"), F.lit(1))
    return rows.select(F.col("relative_path").alias("file"), "line", "operation", F.explode(top).alias("field")).distinct()


def graphql_mismatches(files: DataFrame, schemas: DataFrame) -> DataFrame:
    """Fields of operations that no schema has, and deprecated ones."""
    known = graphql_fields(schemas).groupBy("operation", "field").agg(F.max("deprecated").alias("deprecated"))
    d = graphql_calls(files).filter(~F.col("field").isin("__typename")).join(known, ["operation", "field"], "left")
    message = F.when(F.col("deprecated").isNull(), F.concat(F.lit("unknown field "), "operation", F.lit("."), "field")).when(F.col("deprecated"), F.concat(F.lit("deprecated field "), "operation", F.lit("."), "field"))
    return shaped(d.withColumn("m", message).filter("m is not null"), "contract-mismatch", "error", F.col("m"))


def exported_fields(files: DataFrame) -> DataFrame:
    """type and field of exported interfaces and types written over several lines."""
    rows = lines_of(files.select("relative_path", "content"))
    w = W.partitionBy("relative_path").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    head = r"^\s*export\s+(?:interface|type)\s+(\w+)[^{]*\{\s*$"
    state = F.when(F.col("line").rlike(head), F.regexp_extract("line", head, 1)).when(F.col("line").rlike(r"^\s*\}"), F.lit(""))
    rows = rows.withColumn("type", F.last(state, ignorenulls=True).over(w)).filter("type <> ''")
    return rows.withColumn("name", F.regexp_extract("line", r"^\s*(?:readonly\s+)?(\w+)\??\s*:", 1)).filter("name <> ''").select("type", "name").distinct()


#: Fields and methods that values of the language itself have.
BUILTIN_FIELDS = ("length", "push", "map", "filter", "forEach", "then", "catch", "find", "join", "split", "slice", "toString", "log", "error", "keys", "values", "data", "current", "target", "value")


# Packages, names of the objects that files which import them get from them, and fields of those.
LIBRARIES = (
    (("reactflow", "@xyflow/react"), "node edge connection viewport", "data sourceHandle targetHandle markerEnd markerStart interactionWidth zIndex parentNode expandParent extent positionAbsolute dragging"),
    (("recharts",), "payload entry item tick activePayload", "dataKey payload fill stroke strokeWidth activeDot dot legendType tickFormatter tickLine axisLine cartesianGrid"),
    (("chart.js",), "dataset tooltip chart scale", "datasetIndex dataIndex parsed raw formattedValue"),
    (("d3",), "datum node link simulation", "datum fx fy vx vy cx cy"),
    (("express",), "req res next app router", "params query body headers cookies session locals baseUrl originalUrl hostname ip method path protocol secure xhr statusCode"),
    (("fastify",), "request reply fastify", "params query body headers raw server"),
    (("socket.io",), "socket io", "handshake rooms nsp connected disconnected"),
    (("mongoose",), "doc model schema query", "_id isModified isNew toObject toJSON markModified populate"),
    (("sequelize",), "instance model sequelize", "dataValues isNewRecord changed"),
    (("@prisma/client",), "prisma", "findUnique findMany create update upsert deleteMany"),
    (("next",), "router page", "pathname query asPath basePath locale isReady isFallback"),
    (("next/router",), "router", "pathname query asPath basePath locale isReady isFallback"),
    (("zustand",), "store state", "getState setState subscribe destroy"),
    (("@reduxjs/toolkit",), "store state action slice", "payload type meta error dispatch getState"),
    (("redux",), "store state action", "payload type meta error dispatch getState"),
)


def foreign(files: DataFrame) -> DataFrame:
    """file, kind (object or field) and word: what a file's accesses of these names owe to packages that it imports, be it by
    LIBRARIES or by the imported name itself."""
    deps = extract.dependencies(files).filter(~F.col("target").rlike(r"^(\.|/|~|@/)")).select(F.col("source").alias("file"), "target", "imports")
    own = deps.select("file", F.explode(F.transform("imports", lambda s: F.coalesce(s["alias"], s["name"]))).alias("word")).select("file", F.lit("object").alias("kind"), "word")
    words = [(lib, kind, w) for libs, objects, fields in LIBRARIES for lib in libs for kind, ws in (("object", objects), ("field", fields)) for w in ws.split()]
    table = F.broadcast(files.sparkSession.createDataFrame(words, "target string, kind string, word string"))  # LIBRARIES only
    return deps.select("file", "target").distinct().join(table, "target").select("file", "kind", "word").unionByName(own).distinct()


def field_misses(files: DataFrame, shared: str, callers: str, ignore: list[str] | None = None) -> DataFrame:
    """Fields read in files like callers that no exported type has but that are like one: `x.emial` for `email`. Objects and
    fields of imported packages are left out."""
    known = exported_fields(files.filter(F.col("relative_path").rlike(shared))).select("name").distinct()
    rows = lines_of(files.filter(F.col("relative_path").rlike(callers)).select("relative_path", "content")).filter(~F.col("line").rlike(r"^\s*(//|\*|import\b)"))
    read = rows.select(F.col("relative_path").alias("file"), F.col("line_no").alias("line"), F.explode(F.regexp_extract_all("line", F.lit(r"(?<![\w.'\"/])([A-Za-z_]\w*\.[A-Za-z_]\w*)(?!\s*\()"), F.lit(1))).alias("access"))
    read = read.filter(~text.field_ignored(F.col("access"), ignore or [])).withColumn("name", F.substring_index("access", ".", -1)).filter(~F.col("name").isin(*BUILTIN_FIELDS))
    other = foreign(files.filter(F.col("relative_path").rlike(callers)))
    read = read.withColumn("object", F.substring_index("access", ".", 1))
    for kind, column in (("object", "object"), ("field", "name")):
        read = read.join(other.filter(F.col("kind") == kind).select("file", F.col("word").alias(column)), ["file", column], "left_anti")
    near = similar_names(read, known).filter("rank = 1").select(F.col("a").alias("name"), "b")
    return shaped(read.join(near, "name"), "function-signature-matching", "error", F.concat("access", F.lit(" may be "), "b"))


def calls(files: DataFrame) -> DataFrame:
    """file, line, name, on (whether on an object), args (number) and named (names of the properties of literal objects among them)."""
    tree, heads = tokens.tree_of(files)
    objects = tokens.bodies(heads).filter("role = 'object' and around = '('")
    named = tokens.members(tree, objects).join(objects.select("relative_path", F.col("n").alias("block"), F.col("up").alias("n")), ["relative_path", "block"])
    named = named.groupBy("relative_path", "n").agg(F.array_sort(F.collect_set("name")).alias("named"))
    d = tokens.calls(tree, heads).join(named, ["relative_path", "n"], "left")
    return d.select(F.col("relative_path").alias("file"), "line", "name", F.col("on").isNotNull().alias("on"), "args", F.coalesce("named", F.array().cast("array<string>")).alias("named"))


def named_arguments(used: DataFrame, known: DataFrame, least: float = 0.7) -> DataFrame:
    """Arguments written `name: value` whose name no parameter of the called function has but that is like one."""
    d = used.join(known.select("name", "on", "params"), ["name", "on"]).withColumn("arg", F.explode("named"))
    d = d.filter(~F.array_contains("params", F.col("arg"))).select("file", "line", "name", "arg", F.explode(F.array_distinct("params")).alias("param")).withColumn("score", name_score(F.col("arg"), F.col("param")))
    best = d.groupBy("file", "line", "name", "arg").agg(F.max("score").alias("score"), F.min_by("param", F.struct(-F.col("score"), "param")).alias("param")).filter(F.col("score") >= least)
    return shaped(best, "function-signature-matching", "error", F.format_string("argument %s of %s may be %s", "arg", "name", "param"))


def similar_names(names: DataFrame, known: DataFrame, least: float = 0.7, top: int = 3) -> DataFrame:
    """For each name that known does not have: its most similar known names, of all that reach `least`."""
    have = known.select(F.col("name").alias("b")).distinct()
    odd = names.select(F.col("name").alias("a")).distinct().join(have, F.col("a") == F.col("b"), "left_anti")
    pairs = name_pairs(odd.withColumnRenamed("a", "name"), have.withColumnRenamed("b", "name"), least).filter(F.col("score") < 1)
    return pairs.withColumn("rank", F.row_number().over(W.partitionBy("a").orderBy(F.desc("score"), "b"))).filter(F.col("rank") <= top)


def signatures(files: DataFrame, shared: str, callers: str) -> DataFrame:
    """Calls in files like callers against functions exported by files like shared: wrong counts, near misses of names and of
    named arguments."""
    known = exported_functions(files, shared)
    used = settle(calls(files).filter(F.col("file").rlike(callers)))
    wrong = used.join(known.select("name", "on", "least", "most"), ["name", "on"]).filter("args < least or args > most")
    counts = shaped(wrong, "function-signature-matching", "error", F.format_string("%s takes %d to %d arguments, not %d", "name", "least", "most", "args"))
    # near misses of plain calls; of methods only names that some exported class has can be told from those of others
    plain, local = used.filter("not on"), tokens.functions(None, tokens.shapes_of(files, "(")).select(F.col("relative_path").alias("file"), "name").distinct()
    plain = plain.join(local, ["file", "name"], "left_anti")
    near = similar_names(plain, known.filter("not on")).filter("rank = 1").select(F.col("a").alias("name"), "b")
    return counts.unionByName(named_arguments(used, known)).unionByName(shaped(plain.join(near, "name"), "function-signature-matching", "error", F.concat("name", F.lit(" may be "), "b")))
