"""Properties handed down and old state, on small components."""

from lodestone.operators import react, rules


def frame(spark, files):
    from lodestone.sources.files import described

    return described(spark.createDataFrame(list(files.items()), "relative_path string, content string"))


def rows(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.collect()}


CHAIN = {
    "a.tsx": "import { Mid } from './b';\nexport function Top({ account, theme }) {\n  return <Mid account={account} theme={theme} />;\n}\n",
    "b.tsx": "import { Low } from './c';\nexport const Mid = ({ account, theme = x }: Props) => (\n  <Low {...account} theme={theme} />\n);\n",
    "c.tsx": "export function Low({ account, token }) {\n  return <b>{account.name}</b>;\n}\nfunction Other({ token }) {\n  return <Leaf token={token} />;\n}\n",
}


def test_usages(spark):
    got = rows(react.prop_usages(frame(spark, CHAIN)), "file", "line", "component", "prop", "passed", "used")
    assert got == {
        ("a.tsx", 2, "Top", "account", True, False), ("b.tsx", 2, "Mid", "account", True, False), ("c.tsx", 1, "Low", "account", False, True),
        ("c.tsx", 1, "Low", "token", False, False), ("c.tsx", 4, "Other", "token", True, False),
    }


def test_drilling(spark):
    f = frame(spark, CHAIN)
    assert rows(react.prop_drilling(f), "file", "line", "message") == {("c.tsx", 1, "account goes through 3 components, from Top to Low")}
    assert react.prop_drilling(f, most=4).count() == 0
    apart = {k: v.replace("import", "// import") for k, v in CHAIN.items()}
    assert react.prop_drilling(frame(spark, apart)).count() == 0
    assert react.prop_drilling(f.limit(0)).count() == 0


STATE = "const [count, setCount] = useState(0);\n"


def stale(spark, code):
    return rows(react.stale_closures(frame(spark, {"s.tsx": STATE + code})), "line", "message")


def test_intervals(spark):
    assert stale(spark, "setInterval(() => {\n  show(count);\n}, 5);\n") == {(2, "interval callback may hold old state: count")}
    assert stale(spark, "setInterval(() => setCount(c => c + 1), 5);\nshow(count);\n") == set()
    assert stale(spark, "setInterval(() => setCount((c) => c + 1), count);\n") == set()
    assert stale(spark, "setInterval(() => {\n  const count = 3;\n  show(count);\n}, 5);\n") == set()
    assert stale(spark, "setInterval((count) => show(count), 5);\n") == set()


def test_only_effects_without_dependencies(spark):
    effect = "useEffect(() => {\n  window.addEventListener('x', () => show(count));\n  setTimeout(() => show(count), 5);\n}, [%s]);\n"
    assert stale(spark, effect % "") == {(3, "listener callback may hold old state: count"), (4, "timeout callback may hold old state: count")}
    assert stale(spark, effect % "count") == set()


def test_async_after_await(spark):
    code = "const f = async () => {\n  %s\n  await load();\n  %s\n};\n"
    assert stale(spark, code % ("x();", "show(count);")) == {(2, "async callback may hold old state: count")}
    assert stale(spark, code % ("show(count);", "x();")) == set()


def test_registered(spark):
    assert {"react/prop-drilling-detection", "react/stale-closure-patterns"} <= set(rules.RULES)
