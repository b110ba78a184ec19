"""Tokens, brackets and what is read off them."""

import re

import pytest
from pyspark.sql import functions as F

from lodestone.operators import tokens as T

CODE = '''import { a } from './a'; // import lost from './b';
const s = `import x from "y" ${ call(`inner ${deep({k: 1})} end`, 2) } tail`;
const r = /[/"']+\\/(a|b)/g, q = a / b / c;
export function m(a: Map<string, number>, f: (x: number) => void, c?: string, ...rest: any[]): Promise<Map<string, number>> {
if (a) {
            try {
    JSON.parse(a);
  } catch (e) { log(e) }
    }
  JSON.parse(b);
}
export const add = async (a, b = {x: [1, 2]}) => {
  return foo(bar(1), 2);
};
foo({a: 1, b: 2});
foo('a, b',
  [1, 2],
);
save().catch(console.log);
if (x) save();
await save();
  save()
this.save();
export class Box<T> extends Base {
  private size = 1;
  name?: string;
  items: Array<{ id: number, label: string }> = [];
  constructor(private readonly db: Db, x: number) { super(x); }
  async load(id: string, depth = 2): Promise<void> { this.db.find(id, { a: 1 }, 3) }
}
interface Face { id: number; label: string, on(e: Event): void }
type Shape = {
'full name': string
  round: boolean
};
'''


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "relative_path string, content string")


@pytest.fixture(scope="module")
def tree(spark):
    t = T.structure(T.tokens(frame(spark, {"x.ts": CODE, "none.ts": None, "empty.ts": "", "open.ts": "f(a, { b: [1 "}))).cache()
    yield t, T.heads(t).cache()


def test_places():
    for text in (CODE, "`a${`b${1}c`}d`", "'open\nx", "/* open", "`open ${ x", "a\n\n b", "}`x`", "é ☃ 'ü'"):
        for _n, kind, word, at, line, column in T.lex(text):
            assert text[at : at + len(word)] == word and line == text.count("\n", 0, at) + 1 and column == at - (text.rfind("\n", 0, at) + 1) + 1
        assert re.sub(r"\s", "", "".join(w for _, _, w, *_ in T.lex(text))) in (re.sub(r"\s", "", text),)


def test_kinds():
    kinds = [(k, w) for _, k, w, *_ in T.lex(CODE)]
    assert ("comment", "// import lost from './b';") in kinds and ("regex", "/[/\"']+\\/(a|b)/g") in kinds
    assert ("template", "`import x from \"y\" ") in kinds and ("template", " end`") in kinds and kinds.count(("punct", "${")) == 2
    assert [w for k, w in kinds if k == "word" and w == "import"] == ["import"]


def test_sql(spark):
    T.register(spark)
    frame(spark, {"q.ts": "a ? 'b' : `c`"}).createOrReplaceTempView("some_files")
    got = spark.sql("SELECT kind, text, line, column FROM some_files, LATERAL lex(content) ORDER BY n").collect()
    assert [tuple(r) for r in got] == [("word", "a", 1, 1), ("punct", "?", 1, 3), ("string", "'b'", 1, 5), ("punct", ":", 1, 9), ("template", "`c`", 1, 11)]


def test_brackets_brute_force(tree):
    rows = sorted(tree[0].filter("relative_path = 'x.ts'").collect(), key=lambda r: r["n"])
    stack, partner, up, level = [], {}, {}, {}
    for r in rows:
        closing = r["kind"] == "punct" and r["text"] in T.CLOSE
        if closing:
            partner[r["n"]] = stack.pop()
            partner[partner[r["n"]]] = r["n"]
        up[r["n"]], level[r["n"]] = (stack[-1] if stack else -1), len(stack)
        if r["kind"] == "punct" and r["text"] in T.OPEN:
            stack.append(r["n"])
    assert not stack
    for r in rows:
        assert (r["match"], r["up"], r["level"]) == (partner.get(r["n"]), up[r["n"]], level[r["n"]]), r


def test_bodies(tree):
    got = [(r["role"], r["name"], r["line"], r["to"]) for r in T.bodies(tree[1]).filter("relative_path = 'x.ts'").orderBy("n").collect() if r["role"] != "object"]
    assert got == [
        ("function", "m", 4, 11), ("if", None, 5, 9), ("try", None, 6, 8), ("catch", None, 8, 8), ("arrow", "add", 12, 14), ("class", "Box", 24, 30),
        ("method", "constructor", 28, 28), ("method", "load", 29, 29), ("interface", "Face", 31, 31), ("type", "Shape", 32, 35),
    ]
    assert [r["match"] for r in tree[1].filter("relative_path = 'open.ts'").collect()] == [None] * 3


def test_functions(tree):
    got = {r["name"]: (r["kind"], r["exported"], r["is_async"], r["params"], r["least"], r["most"]) for r in T.functions(*tree).collect()}
    assert got == {
        "m": ("function", True, False, ["a", "f", "c", "rest"], 2, 1000), "add": ("arrow", True, True, ["a", "b"], 1, 2),
        "constructor": ("method", True, False, ["db", "x"], 2, 2), "load": ("method", True, True, ["id", "depth"], 1, 2),
    }


def test_calls(tree):
    got = [(r["line"], r["on"], r["name"], r["args"], r["alone"]) for r in T.calls(*tree).filter("relative_path = 'x.ts'").orderBy("n").collect()]
    assert got == [  # `catch` after a dot is a call too, but its name is kept for blocks
        (2, None, "call", 2, False), (2, None, "deep", 1, False), (7, "JSON", "parse", 1, False), (8, None, "log", 1, True), (10, "JSON", "parse", 1, False), (13, None, "foo", 2, False),
        (13, None, "bar", 1, False), (15, None, "foo", 1, True), (16, None, "foo", 2, True), (19, None, "save", 0, False), (20, None, "save", 0, True), (21, None, "save", 0, False),
        (22, None, "save", 0, True), (23, "this", "save", 0, True), (29, "db", "find", 3, False),
    ]


def test_members(tree):
    t, h = tree
    names = T.bodies(h).filter("role in ('class', 'interface', 'type')").select("relative_path", F.col("n").alias("block"), F.col("name").alias("of"))
    got: dict = {}
    for r in T.members(t, T.bodies(h).filter("role in ('class', 'interface', 'type')")).join(names, ["relative_path", "block"]).collect():
        got.setdefault(r["of"], set()).add(r["name"])
    assert got == {"Box": {"size", "name", "items"}, "Face": {"id", "label"}, "Shape": {"full name", "round"}}


def test_within(tree):
    t, h = tree
    rows = T.within(t, T.bodies(h).filter("role = 'try'"), "guarded").filter("text = 'parse'").collect()
    assert {r["line"]: r["guarded"] for r in rows} == {7: 1, 10: 0}
