"""Brackets are read where a file lies: nothing by tokens is shuffled or stored."""

import random

from lodestone.operators import extract, fixes, rules
from lodestone.operators import tokens as T
from lodestone.sources.files import described

CODE = "class A { m(x: Map<a, b>, { k, l }) { try { JSON.parse(x) } catch { JSON.parse(f(`${ a },${ b }`)) } } }\nexport const g = async (...r) => { JSON.parse(r)\n};\n"


def frame(spark):
    return described(spark.createDataFrame([("a.ts", CODE), ("b.ts", None)], "relative_path string, content string"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nothing_is_shuffled(spark):
    files = frame(spark)
    tree, heads = T.tree_of(files)
    for df in (T.calls(tree, heads), T.functions(tree, heads), T.bodies(heads), rules.line_rules(files)):
        assert "Exchange" not in plan(df) and "Window" not in plan(df)
    assert {(r["name"], r["args"]) for r in T.calls(tree, heads).collect()} == {("parse", 1), ("f", 1)}
    assert {(r["name"], r["kind"], tuple(r["params"]), r["least"], r["most"]) for r in T.functions(tree, heads).collect()} == {("m", "method", ("x", None, "k", "l"), 2, 2), ("g", "arrow", ("r",), 0, 1000)}
    assert {r["line"] for r in rules.line_rules(files).filter("message = 'JSON.parse outside try'").collect()} == {1, 2}


def test_heads_are_those_of_the_tree(spark):
    files = frame(spark)
    tree, heads = T.tree_of(files)
    assert sorted(map(str, T.heads(tree).collect())) == sorted(map(str, heads.collect()))


def test_guards_are_lines_near(spark):
    lines = [*["x"] * 3, "const t = timeout;", *["x"] * 10, "fetch(a);", *["x"] * 9, "fetch(b);", *["x"] * 9, "abort();"]
    files = spark.createDataFrame([("a.ts", "\n".join(lines))], "relative_path string, content string")
    assert [r["line"] for r in rules.line_findings(files).collect()] == [15, 25]


def test_marks_are_those_of_scan():
    random.seed(5)
    parts = [*"ab1 \n\t;,.(){}[]<>`$'\"/\\=?:@é*", "${", "//", "/*", "*/", "return ", "/a/"]
    for _ in range(3000):
        text = "".join(random.choices(parts, k=random.randint(0, 50)))
        assert list(T.marks(text)) == [x for x in T.scan(text) if x[0] in ("comment", "regex", "template")], text


def test_only_the_asked_half_is_parsed(spark, monkeypatch):
    from lodestone.operators import parsers

    def no(text):
        raise AssertionError

    monkeypatch.setattr(parsers.script, "parts", (parsers.script_imports, no))
    assert parsers.PARSERS["typescript"].parts[0]("import a from './b';")[0][0] == "./b"
    assert extract.dependencies(frame(spark)).collect() == []


def test_texts_of_files_move_once(spark):
    files = frame(spark)
    calls = spark.createDataFrame([("a.ts", 1, "parse", "read"), ("a.ts", 2, "parse", "read")], "file string, line int, old string, new string")
    done = fixes.changed(files, calls)
    assert plan(done).count("Join") == 1
    assert [r["content"] for r in done.collect()] == [CODE.replace("parse", "read")]


def test_scopes_need_no_window(spark):
    from lodestone.operators import more_rules

    code = "function A({ p }) { const a = p; useEffect(() => { { const a = 2; show(a) } show(a, p) }, [p]); }"
    found = more_rules.hook_dependencies(described(spark.createDataFrame([("a.tsx", code)], "relative_path string, content string")))
    assert "Window" not in plan(found)
    assert [r["message"] for r in found.collect()] == ["not in the dependency list: a"]


def test_shapes_are_heads():
    random.seed(6)
    parts = [*"ab1 \n\t;,.(){}[]<>`$'\"/\\=?:@é*()(){}", "${", "//", "/*", "*/", "return ", "/a/", "try {", "class A {", "a, b", "(x)", "({ k, l })", "'s, )'", "catch", "f(a, { b: [1] })", "=>", " if (a) { ", "`t ${ f(2) }\n`"]
    place = ("relative_path", "n", "line", "column")
    for _ in range(800):
        texts = ["".join(random.choices(parts, k=random.randint(0, 60))) for _ in range(3)]
        known, want = T._Shapes(), []
        for i, text in enumerate([*texts, None]):
            known.read(str(i), text)
            want += [{"relative_path": str(i), **dict(zip(T.COLUMNS, r, strict=True))} for r in T.nested(text, False)]
        got = [{**a, **r} for r in known.batch().to_pylist() for a in r.pop("at")]
        got.sort(key=lambda r: (r["relative_path"], r["n"]))
        assert got == [{c: T._kept(r[c]) if c == "outer" else r[c] for c in (*place, *T._SHAPE)} for r in want], texts


def test_shapes_say_once_what_is_alike(spark):
    rows = [(f"{i}.ts", f"const f{i % 3} = (a, [b]) => {{\n" + "  if (a) { call(bar(1), 'x') }\n" * 50 + "}\n") for i in range(40)]
    files = described(spark.createDataFrame(rows, "relative_path string, content string").coalesce(1))
    shapes = T.shapes_of(files)
    assert shapes.count() < 30 and plan(T.calls(None, shapes)).count("Generate") == 1
    tree, heads = T.tree_of(files)
    for of in (T.calls, T.functions):
        assert sorted(map(str, of(None, shapes).collect())) == sorted(map(str, of(tree, heads).collect()))


def test_shapes_of_the_asked_brackets(spark):
    files = frame(spark)
    shapes, some = T.shapes_of(files), T.shapes_of(files, "(")
    assert {r["text"] for r in some.select("text").collect()} == {"("}
    assert sorted(map(str, T.calls(None, some).collect())) == sorted(map(str, T.calls(None, shapes).collect()))
