"""The engine on small inputs written here."""

from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import extract, graph, reports, rules
from lodestone.operators.lines import quiet
from lodestone.sources import files as src
from lodestone.streaming import changes

FILES = {
    "src/a.ts": "import { b } from './b';\nimport x from './missing';\nexport function alpha(v: any) {\n  return eval(v);\n}\n",
    "src/b.ts": "import { a } from './a'\nfunction neverUsed() {}\nconst ok: Ghost = 1;\nfor (const q of qs) {\n  db.find(q);\n}\n",
    "src/c/index.ts": "import y from '@/a';\nconst apiKey = 'abcdefghijkl';\r\ntry { } catch (e) {}\n",
    "empty.py": "",
    "m.py": "from os import path\nimport sys\nclass Alpha:\n    def _x(self): pass\nLIMIT = 3\n",
}


def frame(spark):
    return src.described(spark.createDataFrame(list(FILES.items()), "relative_path string, content string"))


def rows(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.collect()}


def test_imports_and_edges(spark):
    f = frame(spark)
    deps = extract.dependencies(f)
    assert rows(deps, "source", "target") >= {("src/a.ts", "./b"), ("src/a.ts", "./missing"), ("m.py", "os"), ("m.py", "sys")}
    assert rows(extract.edges(deps, f, {"@/": "src/"}), "src", "dst") == {("src/a.ts", "src/b.ts"), ("src/b.ts", "src/a.ts"), ("src/c/index.ts", "src/a.ts")}
    assert rows(extract.exports(f), "relative_path", "name", "type") == {("src/a.ts", "alpha", "function"), ("m.py", "Alpha", "class"), ("m.py", "LIMIT", "variable")}


def test_rules(spark):
    got = rows(rules.validate(frame(spark)), "file", "line", "rule")
    assert {
        ("src/a.ts", 3, "type-safety"), ("src/a.ts", 4, "type-safety"), ("src/a.ts", 2, "ai-hallucinated-imports"), ("src/b.ts", 2, "orphaned-functions"),
        ("src/b.ts", 3, "phantom-type-references"), ("src/b.ts", 5, "performance-antipatterns"), ("src/c/index.ts", 2, "hardcoded-secrets"),
        ("src/c/index.ts", 3, "resilience-patterns"), ("src/a.ts", 1, "circular-dependencies"),
    } <= got
    assert not any(f == "empty.py" for f, _, _ in got)
    assert "type-safety" not in {r for _, _, r in rows(rules.validate(frame(spark), ["lines"], levels={"type-safety": "off"}), "file", "line", "rule")}


def test_partitions_do_not_matter(spark):
    f = frame(spark)
    assert rows(rules.line_findings(f.repartition(7)), "file", "line", "message") == rows(rules.line_findings(f.coalesce(1)), "file", "line", "message")


def test_reports(spark):
    f = spark.createDataFrame([("f", 1, "r", "error", "m"), ("f", None, "r", "info", "n")], "file string, line int, rule string, severity string, message string")
    assert reports.health(f).first()["score"] == 89
    assert reports.failing(f, "warning").count() == 1
    assert '"startLine":1' in reports.sarif(f.filter("line is null")).first()["result"]
    assert reports.markdown(f).count() == 2
    assert reports.health(f.limit(0)).first()["score"] == 100


def test_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 1), (4, 4), (3, 5)], "src int, dst int")
    assert {tuple(r["cycle"]) for r in graph.cycles(e, 4).collect()} == {(1, 2), (1, 2, 3), (4,)}
    assert graph.cycles(e.limit(0)).count() == 0


def test_text(spark):
    d = spark.createDataFrame([("getUserName", "fetch_user_name"), ("", ""), ("HTTPServer", "x")], "a string, b string")
    r = d.select(text.name_words(F.col("a")).alias("w"), text.edit_similarity(F.col("a"), F.col("b")).alias("e"), text.semantic_similarity(text.name_words(F.col("a")), text.name_words(F.col("b"))).alias("s"), text.casing(F.col("b")).alias("c"), text.restyle(F.col("b"), "camelCase").alias("k")).collect()
    assert r[0]["w"] == ["get", "user", "name"] and abs(r[0]["s"] - 2.9 / 3) < 1e-9 and r[0]["c"] == "snake_case" and r[0]["k"] == "fetchUserName"
    assert r[1]["e"] == 1.0 and r[1]["s"] == 0.0 and r[2]["w"] == ["http", "server"]
    assert spark.range(1).select(text.fold_path(F.lit("a/./b/../c/../../d"))).first()[0] == "d"


def test_globs_and_layers(spark):
    import re

    assert re.match(src.glob_regex("src/**/*.{ts,tsx}"), "src/x/y.tsx") and not re.match(src.glob_regex("src/*.ts"), "src/x/y.ts")
    got = rows(src.with_layer(frame(spark), [("ui", ["/SRC/c"]), ("core", ["src"])]), "relative_path", "layer")
    assert ("src/c/index.ts", "ui") in got and ("src/a.ts", "core") in got and ("m.py", None) in got


def test_scan(spark, tmp_path):
    for name, content in FILES.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(content)
    got = src.scan(spark, str(tmp_path), ["**/*.ts"], ["**/c/**"])
    assert rows(got, "relative_path") == {("src/a.ts",), ("src/b.ts",)}


def test_stream_equals_batch(spark, tmp_path):
    import datetime as dt

    log = [("p%d" % (i % 3), "unlink" if i % 4 == 3 else "change", dt.datetime(2024, 1, 1, 0, 0, i), i) for i in range(12)]
    schema = "path string, type string, ts timestamp, seq long"
    for k in range(3):
        spark.createDataFrame(log[4 * k : 4 * k + 4], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = changes.keep_state(stream, str(tmp_path / "state"), str(tmp_path / "cp"))
    q.awaitTermination()
    last = spark.read.parquet(str(tmp_path / "state" / "v=2")).filter("type <> 'unlink'")
    assert rows(last, "path", "seq") == rows(changes.replay(spark.createDataFrame(log, schema)), "path", "seq")


def test_quiet(spark):
    d = spark.createDataFrame([(1, 1, "2024-01-01 00:00:00"), (1, 2, "2024-01-01 00:00:01"), (1, 3, "2024-01-01 01:00:00")], "k int, id int, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert rows(quiet(d, ["k"], "ts", 60, ["id"]), "id", "merged") == {(2, 2), (3, 1)}


def test_contracts(spark):
    from lodestone.operators import contracts

    spec = '{"paths": {"/users/{id}": {"get": {"parameters": [{"name": "v", "in": "query", "required": true}]}}, "/old": {"get": {"deprecated": true}}}}'
    specs = spark.createDataFrame([(spec,)], "content string")
    calls = "fetch(`/users/${id}?v=1`)\nfetch('/users/3')\naxios.post('/users/3')\nfetch('/old')\n"
    f = src.described(spark.createDataFrame([("client/a.ts", calls), ("server/b.ts", "fetch('/x')")], "relative_path string, content string"))
    got = rows(contracts.mismatches(f, specs), "line", "message")
    assert got == {(2, "missing query parameter v"), (3, "unknown endpoint POST /users/3"), (4, "deprecated endpoint /old")}
    sdl = spark.createDataFrame([("type Query {\n  user(id: ID!): User\n  old: Int @deprecated\n}",)], "content string")
    assert rows(contracts.graphql_fields(sdl), "field", "deprecated") == {("user", False), ("old", True)}


def test_signatures(spark):
    from lodestone.operators import contracts

    files = [("shared/u.ts", "export function getUserById(id: string, deep?: boolean) {}\n"), ("client/c.ts", "getUserById()\nfetchUserById('1')\ngetUserById('1', true)\n")]
    f = src.described(spark.createDataFrame(files, "relative_path string, content string"))
    got = rows(contracts.signatures(f, "^shared/", "^client/"), "line", "message")
    assert got == {(1, "getUserById takes 1 to 2 arguments, not 0"), (2, "fetchUserById may be getUserById")}


def test_more_rules(spark):
    from lodestone.operators import more_rules as m

    files = [
        ("a/user.ts", "interface UserProfile {\n  id: string\n  mail: string\n}\n"),
        ("b/account.ts", "interface UserProfil {\n  id: string\n  mail: string\n}\nasync function load() {}\nload();\nawait load();\n"),
        ("c/tx.ts", "db.begin()\nfetch('x')\naxios.get('y')\ndb.commit()\nfetch('z')\n"),
        ("d/list.tsx", "const [count, setCount] = useState(0)\nuseEffect(() => {\n  show(count)\n}, [])\nfunction item() {\n  return <b/>\n}\nwindow.addEventListener('x', y)\n"),
    ]
    f = src.described(spark.createDataFrame(files, "relative_path string, content string"))
    assert rows(m.drift(f), "file", "line") == {("b/account.ts", 1)}
    assert rows(m.floating(f), "file", "line") == {("b/account.ts", 6)}
    assert ("c/tx.ts", 2, "2 remote calls in a transaction") in rows(m.transactions(f), "file", "line", "message")
    assert rows(m.hook_dependencies(f), "file", "line") == {("d/list.tsx", 2)}
    assert rows(m.component_names(f), "line") == {(5,)} and rows(m.leaks(f), "line") == {(8,)}
    e = spark.createDataFrame([("modules/a/x.ts", "modules/b/y.ts"), ("modules/a/x.ts", "modules/shared/z.ts")], "src string, dst string")
    assert m.domains(e).count() == 1 and m.domains(e, [("a", "b")]).count() == 0
    assert "context-drift-patterns" in rules.RULES
