"""Declarations, what uses mean, and dependencies of hooks, on shadowed names."""

from lodestone.operators import more_rules, scopes, tokens


def frame(spark, files):
    from lodestone.sources.files import described

    return described(spark.createDataFrame(list(files.items()), "relative_path string, content string"))


def test_declarations_and_uses(spark):
    code = (
        "const a = 1, b = a;\nfunction f({ a, k: [c, d = { e: b }], ...g }: { h: string }, i = a) {\n  for (const a of c) { log(a); }\n  return a;\n}\n"
        "try { f(a); } catch (a) { log(a); }\nconst m = (x: number): number => x + b;\nlist.map(a => a + x, a);\nclass K { run(a) { return a; } }\n"
    )
    tree, heads = tokens.tree_of(frame(spark, {"a.ts": code}))
    declared = scopes.declarations(tree, heads).join(tree.select("relative_path", "n", "line"), ["relative_path", "n"])
    got = {(r["name"], r["line"], r["kind"]) for r in declared.collect()}
    assert got == {
        ("a", 1, "variable"), ("b", 1, "variable"), ("f", 2, "function"), ("a", 2, "param"), ("c", 2, "param"), ("d", 2, "param"), ("g", 2, "param"), ("i", 2, "param"),
        ("a", 3, "variable"), ("a", 6, "param"), ("m", 7, "variable"), ("x", 7, "param"), ("a", 8, "param"), ("K", 9, "class"), ("a", 9, "param"),
    }
    at = tree.select("relative_path", tree.n.alias("at"), tree.line.alias("from"))
    uses = {(r["name"], r["line"], r["from"]) for r in scopes.meant(scopes.uses(tree), scopes.declarations(tree, heads)).join(at, ["relative_path", "at"]).collect()}
    assert uses == {
        ("a", 1, 1), ("b", 2, 1), ("a", 2, 2), ("c", 3, 2), ("a", 3, 3), ("a", 4, 2), ("f", 6, 2), ("a", 6, 1), ("a", 6, 6), ("x", 7, 7), ("b", 7, 1), ("a", 8, 8), ("a", 8, 1), ("a", 9, 9),
    }


def test_missing_dependencies(spark):
    code = {
        "a.tsx": "const top = 1;\nexport function A({ id, load, user: { name } }) {\n  const [n, setN] = useState(0);\n  const boxRef = useRef(null), el = useRef(0);\n"
        "  useEffect(() => {\n    const n = top;\n    load(n);\n    setN(id.length);\n    el.current = boxRef.current;\n  }, []);\n"
        "  const f = React.useCallback((id) => { return items.map(name => name + id + n); }, [n]);\n  useMemo(() => ({ id: 1, name, n }), [id, name,]);\n  useEffect(() => { log(n); });\n}\n",
        "b.tsx": "", "c.ts": "useEffect(() => { x }, [])",
    }
    got = {(r["file"], r["line"], r["message"]) for r in more_rules.hook_dependencies(frame(spark, code)).collect()}
    assert got == {("a.tsx", 5, "not in the dependency list: id"), ("a.tsx", 12, "not in the dependency list: n")}


def test_a_text_is_read_as_its_tokens():
    import random

    random.seed(4)
    parts = ["useEffect(() => {", "}, [a])", "\n", "const ", "let a = 1, b", "var [s, setS] = useState(0);", "function f(a, { b: c = 2 }, ...d) {", *"{}()[],;ab:=", "x => x + a", "for (const a of b) {", "catch (e) {", "// c\n", "'s'", "`t ${a}`", "?.a", "return"]
    for _ in range(500):
        text = "".join(random.choices(parts, k=random.randint(0, 40)))
        rows = [dict(zip(tokens.COLUMNS, r, strict=True)) for r in tokens.nested(text, True)]
        rows = [tuple(r[c] for c in scopes._FIELDS) for r in rows if r["kind"] != "comment"]
        read = scopes._File.read(text)
        assert [tuple(getattr(r, c) for c in scopes._FIELDS) for r in read.rows] == rows, text
        assert list(scopes._declared(read)) == list(scopes._declared(scopes._File.of(rows))), text
