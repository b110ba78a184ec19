"""Projects, contracts, layers and fixes on files written from the driver tables; SQL states the rows from the keys alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import contracts, extract, fixes, graph, more_rules, react, rules
from lodestone.plans.code import _sql, _union, filled, keys
from lodestone.sources import project
from lodestone.sources.tables import table


def written(spark, d, **templates: str) -> DataFrame:
    """Files of all nations: each value is `path|content`; the names of the arguments say nothing."""
    out = None
    for t in templates.values():
        path, content = t.split("|", 1)
        one = keys(spark, d).select(filled(path).alias("relative_path"), filled(content).alias("content")).distinct()
        out = one if out is None else out.unionByName(one)
    return out


def names(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()


def name_concepts(spark, d):
    """Names of concepts beside one another, and beside a name without one."""
    n = keys(spark, d).select("n", F.explode(F.array(*map(F.lit, ("getUser", "fetchCustomer", "deleteOrder", "removePurchase", "getUsr")))).alias("a"))
    pairs = n.withColumn("b", F.lit("retrieveMember"))
    return pairs.select("n", "a", "b", F.round(text.concept_similarity(F.col("a"), F.col("b")), 6).alias("score"))


def affix_scores(spark, d):
    pairs = (("userEmail", "email"), ("xEmail", "email"), ("total", "totalAmount"), ("amount", "totalAmount"), ("emailField", "email"), ("same", "same"), ("one", "two"))
    n = keys(spark, d).select("n", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])).alias("x"))
    return n.select("n", "x.a", "x.b", text.affix_similarity(F.col("x.a"), F.col("x.b")).alias("score"))


def component_names_of_parts(spark, d):
    """Names of parts as component names, and whether they bear an acronym."""
    snake = F.regexp_replace("name", "[^A-Za-z0-9]+", "_")
    return names(spark, d).select("name", text.pascal_component(snake).alias("component"), text.has_acronym(F.upper("name")).alias("acronym"))


def ignored_fields(spark, d):
    n = keys(spark, d).select("n", F.explode(F.array(*map(F.lit, ("props.any", "other.id", "x.name", "props", "a.b.id")))).alias("access"))
    return n.filter(text.field_ignored(F.col("access"), ["props.*", "*.id"])).select("n", "access")


_PKG = """packages/n{n}/package.json|{{"name": "n{n}", "dependencies": {{"react": "{n}.0", "lib{r}": "1"}}, "devDependencies": {{"vue": "2"}}, "workspaces": ["apps/a{n}"]}}"""


def project_packages(spark, d):
    return project.packages(written(spark, d, a=_PKG))


def project_framework(spark, d):
    return project.framework(written(spark, d, a=_PKG, b="manage.py|x"))


def project_languages(spark, d):
    return project.languages(written(spark, d, a="a/n{n}.ts|x", b="a/n{n}.py|x", c="a/r{r}.go|x", e="a/n{n}.md|x"))


def project_workspaces(spark, d):
    return project.workspaces(written(spark, d, a=_PKG, b="""package.json|{{"workspaces": ["packages/*"]}}""", c="nx.json|{{}}"))


def path_aliases(spark, d):
    return project.aliases(written(spark, d, a="""n{n}/tsconfig.json|{{"compilerOptions": {{"baseUrl": "./src", "paths": {{"@lib{n}/*": ["lib{r}/*", "x"], "#core": ["core/index"]}}}}}}"""))


def missing_packages(spark, d):
    f = project.described(written(spark, d, a=_PKG, b="""src/n{n}.ts|import a from 'react';\nimport b from 'lib{r}/sub';\nimport c from 'lost{n}';\nimport d from '@scope/lost{r}/x';\nimport e from './near';\nimport fs from 'fs';\n"""))
    return project.missing_packages(extract.dependencies(f), written(spark, d, a=_PKG)).select("source", "package", "line")


def project_settings(spark, d):
    f = written(spark, d, a="""lodestone.config.json|{{"name": "p", "root": ".", "languages": ["python"], "patterns": {{"include": ["src/**/*.ts"], "exclude": ["**/skip/**"]}}}}""", b="src/n{n}.ts|x", c="src/skip/n{n}.ts|x", e="other/n{n}.ts|x")
    return project.chosen(f, project.settings(f)).select("relative_path")


def contract_calls(spark, d):
    spec = """{"paths": {"/users/{id}": {"get": {"parameters": [{"name": "v", "in": "query", "required": true}]}}, "/old": {"get": {"deprecated": true}}}}"""
    f = project.described(written(spark, d, a="client/n{n}.ts|fetch(`/users/${{id}}?v=1`);\nfetch('/users/{n}');\naxios.post('/none{n}');\nfetch('/old');\n"))
    return rules.validate(f, ["contracts"], specs=spark.createDataFrame([(spec,)], "content string")).select("file", "line", "rule", "message")


def graphql_fields_unknown(spark, d):
    schema = spark.createDataFrame([("type Query {\n  user(id: ID!): User\n  old: Int @deprecated\n}",)], "content string")
    f = project.described(written(spark, d, a="client/n{n}.ts|const x = 1;\nconst q = gql`query Q($id: ID!) {{\n  user(id: $id) {{ name {{ deep }} }}\n  old\n  lost{n}\n}}`;\n"))
    return contracts.graphql_mismatches(f, schema).select("file", "line", "message")


_SHARED = "shared/n{n}.ts|export function getUser{n}(id: string, deep?: boolean) {{}}\nexport interface Thing{n} {{\n  email{n}: string\n  total: number\n}}\n"


def signature_calls(spark, d):
    f = project.described(written(spark, d, a=_SHARED, b="client/n{n}.ts|getUser{n}();\ngetUser{n}('1');\n"))
    return rules.validate(f, ["signatures"], shared="^shared/", callers="^client/").select("file", "line", "rule", "message")


def field_misses(spark, d):
    f = project.described(written(spark, d, a=_SHARED, b="client/n{n}.ts|show(thing.totl);\nshow(thing.total);\nshow(list.length);\nshow(props.totl);\n"))
    return contracts.field_misses(f, "^shared/", "^client/", ["props.*"]).select("file", "line", "message")


def layer_imports(spark, d):
    f = project.described(written(spark, d, a="ui/n{n}.ts|import a from '../db/n{n}';\n", b="db/n{n}.ts|import b from '../ui/n{n}';\n"))
    f = f.withColumn("layer", F.substring_index("relative_path", "/", 1))
    allowed = spark.createDataFrame([("ui", "db")], "source_layer string, target_layer string")
    return rules.validate(f, ["layers"], allowed=allowed).select("file", "line", "rule", "message")


def layers_by_name(spark, d):
    """Layers told by a word of the path: a service may not use a controller."""
    f = project.described(written(spark, d, a="x/user{n}.controller.ts|import s from './user{n}.service';\n", b="x/user{n}.service.ts|import c from './user{n}.controller';\n"))
    return rules.layers_by_name(extract.edges(extract.dependencies(f), f)).select("file", "message")


def domain_imports(spark, d):
    f = project.described(written(spark, d, a="domains/a{r}/n{n}.ts|import b from '../b/x';\nimport s from '../shared/y';\n", b="domains/b/x.ts|", c="domains/shared/y.ts|"))
    return more_rules.domains(extract.edges(extract.dependencies(f), f)).select("file", "rule", "message")


def named_arguments(spark, d):
    f = project.described(written(spark, d, a="shared/n{n}.ts|export function save{n}({{ userName, age }}) {{}}\n", b="client/n{n}.ts|save{n}({{ usrName: x, age: 3 }});\nsave{n}({{ userName: x, zebra: 3 }});\n"))
    return rules.validate(f, ["signatures"], shared="^shared/", callers="^client/").select("file", "line", "rule", "message")


def data_classes(spark, d):
    f = project.described(written(spark, d, a="a/n{n}.model.ts|class Model{n} {{}}\n", b="a/n{n}.dto.ts|class Dto {{ @IsString() a }}\n", c="model/n{n}.ts|class X {{}}\n"))
    return rules.validate(f, ["data-classes"]).select("file", "line", "rule", "message")


def prop_drilling(spark, d):
    """A property that three components of three files hand on, of which the last one uses it."""
    f = project.described(written(spark, d, a="a/n{n}.tsx|import {{ Mid }} from '../b/n{n}';\nexport function Top{n}({{ account{n} }}) {{\n  return <Mid account{n}={{ account{n} }} />;\n}}\n", b="b/n{n}.tsx|import {{ Low }} from '../c/n{n}';\nexport const Mid{n} = ({{ account{n} }}) => <Low {{ ...account{n} }} />;\n", c="c/n{n}.tsx|export function Low{n}({{ account{n} }}) {{\n  return <b>{{account{n}.name}}</b>;\n}}\n"))
    return react.prop_drilling(f).select("file", "line", "rule", "message")


def directory_roles(spark, d):
    return project.directory_roles(written(spark, d, a="web{n}/components/x.ts|x", b="back{n}/x.ts|app.get('/');\nprisma; jwt;\n", c="lib{n}/utils/x.ts|x", e="odd{n}/x.ts|x"))


_TYPO = "client/n{n}.ts|getUsr{n}('1');\nconst a = getUsr{n}; // getUsr{n}x\n"


def fix_plan(spark, d):
    found = keys(spark, d).select(F.concat(F.lit("client/n"), "n", F.lit(".ts")).alias("file"), F.lit(1).alias("line"), F.concat(F.lit("getUsr"), "n", F.lit(" may be getUser"), "n").alias("message"))
    return fixes.preview(written(spark, d, a=_TYPO), fixes.renames(found)).select("relative_path", "line_no", "before", "after")


def concept_drift(spark, d):
    f = project.described(written(spark, d, a="a/n{n}.ts|interface GetUser{n} {{\n  id{n}: string\n  mail{n}: string\n}}\n", b="b/n{n}.ts|interface FetchUser{n} {{\n  id{n}: string\n  mail{n}: string\n}}\n"))
    return more_rules.drift(f).select("file", "line", "rule", "message")


def focus_graph(spark, d):
    """Files that those of the first nation reach within two imports."""
    f = project.described(written(spark, d, a="src/n{n}.ts|import a from './n{m}';\n"))
    return graph.reach(extract.edges(extract.dependencies(f), f), spark.createDataFrame([("src/n5.ts",)], "id string"), 2)


_ALL = (name_concepts, affix_scores, component_names_of_parts, ignored_fields, project_packages, project_framework, project_languages, project_workspaces, path_aliases, missing_packages, project_settings, contract_calls,
        graphql_fields_unknown, signature_calls, field_misses, layer_imports, layers_by_name, domain_imports, fix_plan, concept_drift, focus_graph, named_arguments, data_classes, prop_drilling, directory_roles)
QUERIES = {q.__name__: q for q in _ALL}
_N = "CAST(n_nationkey AS INTEGER) AS n"
_SCORES = (("getUser", "0.85"), ("fetchCustomer", "0.85"), ("deleteOrder", "round(1 - CAST(levenshtein('delete order', 'retrieve member') AS DOUBLE) / 15, 6)"), ("removePurchase", "round(1 - CAST(levenshtein('remove purchase', 'retrieve member') AS DOUBLE) / 15, 6)"), ("getUsr", "0.85"))


def _rows(*rows: str) -> str:
    return _union(list(rows))


def _found(file: str, line: int, rule: str, message: str) -> str:
    return f"{_sql(file)} AS file, CAST({line} AS INTEGER) AS line, '{rule}' AS rule, {_sql(message)} AS message"


_AFFIX = (("userEmail", "email", 0.9), ("xEmail", "email", 0.8), ("total", "totalAmount", 0.7), ("amount", "totalAmount", 0.7), ("emailField", "email", 0.75), ("same", "same", 0.8), ("one", "two", 0.0))
ORACLES = {
    "name_concepts": _rows(*[f"{_N}, '{a}' AS a, 'retrieveMember' AS b, CAST({s} AS DOUBLE) AS score" for a, s in _SCORES]),
    "affix_scores": _rows(*[f"{_N}, '{a}' AS a, '{b}' AS b, CAST({s} AS DOUBLE) AS score" for a, b, s in _AFFIX]),
    "component_names_of_parts": f"""SELECT DISTINCT p_name AS name, array_to_string(list_transform(list_filter(string_split(regexp_replace(p_name, '[^A-Za-z0-9]+', '_', 'g'), '_'), lambda x: x <> ''), lambda x: upper(x[1]) || x[2:]), '') AS component,
regexp_matches(upper(p_name), '{"|".join(text.ACRONYMS)}') AS acronym FROM part""",
    "ignored_fields": _rows(f"{_N}, 'props.any' AS access", f"{_N}, 'other.id' AS access"),
    "project_packages": _rows(*[f"{_sql('packages/n{n}/package.json')} AS manifest, '{s}' AS section, {_sql(p)} AS package, {_sql(v)} AS version" for s, p, v in (("dependencies", "react", "{n}.0"), ("dependencies", "lib{r}", "1"), ("devDependencies", "vue", "2"))]),
    "project_framework": "SELECT 'react' AS framework",
    "project_languages": "SELECT 'typescript' AS language, count(*) AS files FROM nation UNION ALL SELECT 'python', count(*) FROM nation UNION ALL SELECT 'go', count(DISTINCT n_regionkey) FROM nation",
    "project_workspaces": f"SELECT {_sql('packages/n{n}')} AS path, 'folder' AS why FROM nation UNION ALL SELECT 'packages/*', 'listed' UNION ALL SELECT 'nx.json', 'marker'",
    "path_aliases": _rows(f"{_sql('@lib{n}/')} AS prefix, {_sql('src/lib{r}/')} AS folder", "'#core' AS prefix, 'src/core/index' AS folder"),
    "missing_packages": _rows(f"{_sql('src/n{n}.ts')} AS source, {_sql('lost{n}')} AS package, CAST(3 AS INTEGER) AS line", f"{_sql('src/n{n}.ts')} AS source, {_sql('@scope/lost{r}')} AS package, CAST(4 AS INTEGER) AS line"),
    "project_settings": f"SELECT {_sql('src/n{n}.ts')} AS relative_path FROM nation",
    "contract_calls": _rows(_found("client/n{n}.ts", 2, "contract-mismatch", "missing query parameter v"), _found("client/n{n}.ts", 3, "contract-mismatch", "unknown endpoint POST /none{n}"), _found("client/n{n}.ts", 4, "contract-mismatch", "deprecated endpoint /old")),
    "graphql_fields_unknown": _rows(*[f"{_sql('client/n{n}.ts')} AS file, CAST(2 AS INTEGER) AS line, {_sql(m)} AS message" for m in ("deprecated field Query.old", "unknown field Query.lost{n}")]),
    "signature_calls": _rows(_found("client/n{n}.ts", 1, "function-signature-matching", "getUser{n} takes 1 to 2 arguments, not 0")),
    "field_misses": _rows(f"{_sql('client/n{n}.ts')} AS file, CAST(1 AS INTEGER) AS line, 'thing.totl may be total' AS message"),
    "layer_imports": _rows(_found("db/n{n}.ts", 1, "layer-dependencies", "db may not use ui")),
    "layers_by_name": _rows(f"{_sql('x/user{n}.service.ts')} AS file, 'application may not use presentation' AS message"),
    "domain_imports": _rows(f"{_sql('domains/a{r}/n{n}.ts')} AS file, 'ddd-boundaries' AS rule, {_sql('a{r} uses b')} AS message"),
    "fix_plan": _rows(f"{_sql('client/n{n}.ts')} AS relative_path, CAST(1 AS INTEGER) AS line_no, {_sql('getUsr{n}(')} || chr(39) || '1' || chr(39) || ');' AS before, {_sql('getUser{n}(')} || chr(39) || '1' || chr(39) || ');' AS after",
                      f"{_sql('client/n{n}.ts')} AS relative_path, CAST(2 AS INTEGER) AS line_no, {_sql('const a = getUsr{n}; // getUsr{n}x')} AS before, {_sql('const a = getUser{n}; // getUsr{n}x')} AS after"),
    "concept_drift": _rows(_found("b/n{n}.ts", 1, "context-drift-patterns", "FetchUser{n} is like GetUser{n}")),
    "named_arguments": _rows(_found("client/n{n}.ts", 1, "function-signature-matching", "argument usrName of save{n} may be userName")),
    "data_classes": _rows(_found("a/n{n}.model.ts", 1, "data-flow-integrity", "data class without validation: Model{n}")),
    "prop_drilling": _rows(_found("c/n{n}.tsx", 1, "react/prop-drilling-detection", "account{n} goes through 3 components, from Top{n} to Low{n}")),
    "directory_roles": _rows(*[f"{_sql(f)} AS folder, '{r}' AS role" for f, r in (("web{n}", "client"), ("back{n}", "server"), ("lib{n}", "shared"))]),
    "focus_graph": "SELECT 'src/n5.ts' AS id, 0 AS distance UNION ALL SELECT 'src/n4.ts', 1 UNION ALL SELECT 'src/n3.ts', 2",
}
