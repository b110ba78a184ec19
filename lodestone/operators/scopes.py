"""Names by scope: where scripts declare names, from where to where they hold, and which declaration a use means.

All is read off the tree of brackets (tokens.py): a scope is a range of tokens, so an inner declaration hides an outer one of the same
name wherever it stands, over any number of lines. Declared are variables (patterns too, at any depth), parameters, caught errors,
loop variables, functions and classes. `var` holds in its block as `let` does; names that nothing in the file declares have no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators.materialize import stored
from lodestone.operators.tokens import _END, _NO_END, _SIDE, GENERIC, GO_ON, HEAD, NAME, scan

FILE_END = 2**31 - 1
#: Words that are never names of variables.
KEYWORDS = (
    "const", "let", "var", "function", "class", "extends", "return", "if", "else", "for", "while", "do", "switch", "case", "default", "break", "continue", "try", "catch", "finally", "throw",
    "new", "delete", "typeof", "instanceof", "in", "of", "void", "await", "async", "yield", "this", "super", "null", "true", "false", "undefined", "import", "export", "from", "as", "type", "interface",
)


class Token:
    """What is read of a token, as columns of tokens.nested() have it; own: the tokens of its bracket, i: its place among them, at: its offset."""

    __slots__ = ("n", "kind", "text", "match", "up", "around", "stmt", "head", "own", "i", "at")

    def __init__(self, n: int, kind: str, text: str, match: int | None, up: int, around: str | None, stmt: int, head: str | None, own: list, at: int | None):
        self.n, self.kind, self.text, self.match, self.up, self.around, self.stmt, self.head, self.own, self.i, self.at = n, kind, text, match, up, around, stmt, head, own, len(own), at

    def near(self, k: int) -> str | None:
        i = self.i + k
        return self.own[i].text if 0 <= i < len(self.own) else None

    def after(self, a: int, b: int) -> str:
        return " ".join([x.text for x in self.own[self.i + a : self.i + b]])


#: Columns of tokens.nested() that a Token is made of.
_FIELDS = ("n", "kind", "text", "match", "up", "around", "stmt", "head")


_ARROW = re.compile(r"^(?:: [^,;={}]*)?=>", re.A)
_ARROW_BLOCK = re.compile(r"^(?:: [^,;={}]*)?=> \{", re.A)
_LOOP = re.compile(r"\bfor(?: await)?$", re.A)
_CAUGHT = re.compile(r"(?:^|[ }])catch$", re.A)
_FUNCTION = re.compile(rf"\bfunction(?: \*)?(?: {NAME})?{GENERIC}$", re.A)
_METHOD, _METHOD_BLOCK = re.compile(rf"{NAME}{GENERIC}$", re.A), re.compile(r"^(?:: [^,;=]*)?\{", re.A)
_CONTROL = re.compile(r"\b(?:if|while|switch|with|for|await|catch)$", re.A)
_DECLARES, _BEGINS, _STARTS = re.compile(r"\b(?:const|let|var)$", re.A), re.compile(r"(?:^|,)$"), re.compile(r"(?:^|,|:|\.\.\.|\()$")
_STATE = re.compile(r"^\] = (?:React \. )?use(?:State|Reducer)\b", re.A)
_REF = re.compile(r"= (?:React \. )?useRef\b", re.A)
_WORD = re.compile(rf"^{NAME}$", re.A)
_SKIP = frozenset(KEYWORDS)


class _File:
    """A file's tokens but comments, and those of each bracket by its number."""

    def __init__(self):
        self.rows: list[Token] = []
        self.own: dict[int, list[Token]] = {-1: []}
        self.opened: dict[int, Token] = {}
        self.ends: dict[int, tuple[list, list, list]] = {}
        self.first: dict[int, dict[int, str]] = {}

    def _add(self, r: Token) -> None:
        r.own.append(r)
        self.rows.append(r)
        if r.head is not None:
            self.opened[r.n], self.own[r.n] = r, []

    @classmethod
    def of(cls, rows: list[tuple]) -> _File:
        """From rows of _FIELDS in order."""
        f = cls()
        for n, kind, text, match, up, around, stmt, head in rows:
            f._add(Token(n, kind, text, match, up, around, stmt, head, f.own[up], None))
        return f

    @classmethod
    def read(cls, text: str | None) -> _File:
        """From a text, as tokens.nested() reads it."""
        f, text = cls(), text or ""
        # of the bracket that is open: its tokens, itself, where its statement began and that one's number
        own, inside, begin, stmt, stack = f.own[-1], None, 0, 0, []
        for n, (kind, word, at) in enumerate(scan(text)):
            if kind == "comment":
                continue
            side, closed = _SIDE.get(word, 0) if kind == "punct" else 0, None
            if side < 0 and stack:
                closed, (own, inside, begin, stmt) = inside, stack.pop()
            if own:
                last = own[-1]
                before = last.text
                if before == ";" or before == "}" or (kind == "word" and before[-1] in _END and word not in GO_ON and before not in _NO_END and text.find("\n", last.at, at) >= 0):
                    stmt, begin = stmt + 1, len(own)
            head = " ".join([x.text for x in own[max(begin, len(own) - HEAD) :]]) if side > 0 else None
            up, around = (-1, None) if inside is None else (inside.n, inside.text)
            r = Token(n, kind, word, None if closed is None else closed.n, up, around, stmt, head, own, at)
            f._add(r)
            if side > 0:
                stack.append((own, inside, begin, stmt))
                own, inside, begin, stmt = f.own[n], r, 0, 0
            elif closed is not None:
                closed.match = n
        return f

    def _far(self, r: Token) -> tuple[list, list, list]:
        """Of the tokens of r's bracket: the first brace's end, the first `,` `;` or new statement, and the first `,` or `;`, from two tokens on."""
        if r.up not in self.ends:
            own = r.own
            blocks, stops, commas = [None] * len(own), [None] * len(own), [None] * len(own)
            block = stop = comma = None
            for i in range(len(own) - 3, -1, -1):
                far = own[i + 2]
                if far.text == "{" and far.match is not None:
                    block = far.match
                if far.text in (",", ";"):
                    stop = comma = far.n
                elif far.stmt > own[i + 1].stmt:
                    stop = far.n
                blocks[i], stops[i], commas[i] = block, stop, comma
            self.ends[r.up] = blocks, stops, commas
        return self.ends[r.up]

    def block(self, r: Token) -> int | None:
        return self._far(r)[0][r.i]

    def stop(self, r: Token) -> int | None:
        return self._far(r)[1][r.i]

    def comma(self, r: Token) -> int | None:
        return self._far(r)[2][r.i]

    def opens(self, r: Token) -> str:
        """The first token of r's statement."""
        if r.up not in self.first:
            self.first[r.up] = {x.stmt: x.text for x in reversed(r.own)}
        return self.first[r.up][r.stmt]

    def shut(self, up: int) -> int | None:
        """The end of a bracket."""
        r = self.opened.get(up)
        return r.match if r is not None and r.match is not None and r.match > r.n else None


def _first(*ends: int | None) -> int:
    return next((x for x in ends if x is not None), FILE_END)


def _lists(f: _File) -> dict[int, tuple[str, int]]:
    """Brackets whose names hold behind them too: parameters, caught errors and heads of loops; with the end of what they hold in."""
    out = {}
    for r in f.rows:
        if r.head is None or r.text != "(":
            continue
        after = r.after(2, 15)
        arrow = _ARROW.search(after)
        if not arrow and _LOOP.search(r.head):
            kind, braced = "loop", after.startswith("{")
        elif arrow or _CAUGHT.search(r.head) or _FUNCTION.search(r.head) or (_METHOD.search(r.head) and _METHOD_BLOCK.search(after) and not _CONTROL.search(r.head)):
            kind, braced = "param", not arrow or bool(_ARROW_BLOCK.search(after))
        else:
            continue
        out[r.n] = kind, _first(f.block(r) if braced else None, f.stop(r), f.shut(r.up))
    return out


def _declared(f: _File) -> Iterator[tuple[str, int, str, int, int]]:
    """name, n, kind, lo and hi."""
    lists = _lists(f)

    def held(name: str, n: int, kind: str, up: int) -> tuple[str, int, str, int, int]:
        return name, n, kind, up, _first(lists[up][1] if up in lists else None, f.shut(up))

    roots: list[tuple] = []  # patterns that are open: bracket, whether it is state, whether it stands in a list
    last, values = None, []
    for r in f.rows:
        while roots and r.n >= roots[-1]:
            roots.pop()
        while values and r.n >= values[-1]:
            values.pop()
        if r.head is not None and r.text in ("{", "["):
            variable, listed = bool(_DECLARES.search(r.head)), r.up in lists
            if variable or (listed and _BEGINS.search(r.head)):
                last = r, variable and r.text == "[" and bool(_STATE.search(r.after(1, 6))), listed
                if r.match is not None:
                    roots.append(r.match)
            elif roots and not _STARTS.search(r.head) and r.match is not None:
                values.append(r.match)
        if r.kind != "word":
            continue
        plain, p, x = r.text not in _SKIP, r.near(-1), r.near(1)
        if plain and (p in ("const", "let", "var") or (p == "," and r.around in (None, "{") and f.opens(r) in ("const", "let", "var"))):
            yield held(r.text, r.n, "ref" if _REF.search(r.after(1, 6)) else "variable", r.up)
        if plain and p in ("function", "class") and _WORD.search(r.text):
            yield held(r.text, r.n, p, r.up)
        # in a pattern, but for the values of defaults; a name holds where the pattern's root is declared
        if roots and not values and r.around in ("{", "[") and (p in (None, ",", "...") or (p == ":" and r.around == "{")) and x not in (":", "."):
            root, state, listed = last
            of_state = state and r.up == root.n
            yield held(r.text, r.n, ("state" if p is None else "setter") if of_state else "param" if listed else "variable", root.up)
        if plain and r.around == "(" and p in (None, ",", "...") and x != "." and lists.get(r.up, ("",))[0] == "param":
            yield held(r.text, r.n, "param", r.up)
        # x => ...: a parameter without a list, but no type of what a function gives
        if x == "=>" and not (p == ":" and r.near(-2) == ")"):
            yield r.text, r.n, "param", r.n, _first(f.block(r) if r.after(1, 6).startswith("=> {") else None, f.comma(r), f.shut(r.up))


DECLARED = "relative_path string, name string, n int, kind string, lo int, hi int"


def declarations(tree: DataFrame, heads: DataFrame) -> DataFrame:
    """relative_path, name, n (its token), kind (variable, state, setter, ref, param, function, class), lo and hi: the tokens between which it holds."""

    def run(t: pa.Table) -> pa.Table:
        rows = sorted(zip(*(t[c].to_pylist() for c in _FIELDS), strict=True), key=lambda r: r[0])
        found = [(t["relative_path"][0].as_py(), *d) for d in _declared(_File.of(rows))]
        cols = list(zip(*found, strict=True)) or [[]] * 6
        return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32()), strict=True)], names=["relative_path", "name", "n", "kind", "lo", "hi"])

    return tree.select("relative_path", *_FIELDS).groupBy("relative_path").applyInArrow(run, DECLARED)


def uses(tree: DataFrame) -> DataFrame:
    """relative_path, n, name, line and called (whether a `(` follows): words that stand for values, not members, keys or keywords."""
    own = W.partitionBy("relative_path", "up").orderBy("n")
    p, x = F.lag("text").over(own), F.lead("text").over(own)
    key = (x == ":") & (F.col("around") == "{") & (p.isNull() | (p == ","))
    d = tree.withColumns({"member": F.coalesce(p.isin(".", "?."), F.lit(False)), "key": F.coalesce(key, F.lit(False)), "called": F.coalesce(x == "(", F.lit(False))})
    d = d.filter((F.col("kind") == "word") & ~F.col("member") & ~F.col("key") & ~F.col("text").isin(*KEYWORDS))
    return d.select("relative_path", "n", F.col("text").alias("name"), "line", "called")


def meant(used: DataFrame, declared: DataFrame) -> DataFrame:
    """used with kind, lo, hi and at (token) of the innermost declaration around each; those of no declaration, and declarations themselves, are left out."""
    d = declared.select("relative_path", "name", F.col("n").alias("at"), "kind", "lo", "hi")
    hit = used.join(d, ["relative_path", "name"]).filter("n between lo and hi")
    best = hit.groupBy(*used.columns).agg(F.max(F.struct("lo", "at", "kind", "hi")).alias("d"))
    return best.select(*used.columns, "d.kind", "d.lo", "d.hi", "d.at").filter("n <> at")


def stable(name: Column) -> Column:
    """Names that never change between renders, whatever declares them."""
    # Patterns of names.
    return name.rlike(r"^set[A-Z]") | name.rlike(r"^dispatch$") | name.rlike(r"^navigate$") | name.rlike(r"Ref$")


_FACTS = {
    "relative_path": pa.string(), "name": pa.string(), "n": pa.int32(), "kind": pa.string(), "lo": pa.int32(), "hi": pa.int32(), "called": pa.bool_(), "hook_n": pa.int32(), "match": pa.int32(),
    "deps": pa.int32(), "deps_end": pa.int32(), "line": pa.int32(), "column": pa.int32(), "hook": pa.string(),
}
_SPARK = {pa.int32(): "int", pa.string(): "string", pa.bool_(): "boolean"}


def _used(f: _File, head: re.Pattern, text: str) -> Iterator[tuple]:
    """name, n, called and the hook (n, match, deps, deps_end, line, column, hook) of words in a hook's call that stand for values."""
    hook, line, last = None, 1, 0
    for r in f.rows:
        if r.text == "(" and r.head is not None and r.match is not None and (m := head.search(r.head)):
            line, last = line + text.count("\n", last, r.at), r.at
            for d in f.own[r.n]:
                if d.text == "[" and d.head is not None and (d.near(2) is None or (d.near(2) == "," and d.near(3) is None)):
                    hook = r.n, r.match, d.n, d.match, line, r.at - text.rfind("\n", 0, r.at), m[1]
        if hook is None or r.kind != "word" or r.n >= hook[1] or r.text in _SKIP:
            continue
        p, x = r.near(-1), r.near(1)
        if p not in (".", "?.") and not (x == ":" and r.around == "{" and p in (None, ",")):
            yield r.text, r.n, x == "(", *hook


def _facts(files: DataFrame, hooks: tuple[str, ...]) -> DataFrame:
    """Declarations (kind is not null) of files(relative_path, content) and what their hooks read, file by file where they lie."""
    named = re.compile("|".join(hooks))
    head = re.compile(rf"(?:^|[^.\w$ ] ?|[\w)}}\]] |\bReact \. )({'|'.join(hooks)}){GENERIC}$", re.A)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 200):
                part, rows = b.slice(a, 200), []
                for path, text in zip(part["relative_path"].to_pylist(), part["content"].to_pylist(), strict=True):
                    if text is None or not named.search(text):
                        continue
                    f = _File.read(text)
                    used = [(path, name, n, None, None, None, *rest) for name, n, *rest in _used(f, head, text)]
                    if used:
                        names = {u[1] for u in used}
                        rows += used
                        rows += [(path, *d, *[None] * 8) for d in _declared(f) if d[0] in names]
                    for own in f.own.values():  # tokens and these lists name each other, so nothing else frees them soon
                        own.clear()
                cols = list(zip(*rows, strict=True)) or [[]] * len(_FACTS)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _FACTS.values(), strict=True)], list(_FACTS))

    return files.select("relative_path", "content").mapInArrow(run, ", ".join(f"`{c}` {_SPARK[t]}" for c, t in _FACTS.items()))


def missing_dependencies(files: DataFrame, hooks: tuple[str, ...]) -> DataFrame:
    """file, line, column, hook and names: what a hook's callback reads of the component around it and its dependency list leaves out.

    Read are variables, properties and parameters declared around the call, not in it; setters, refs and stable() names are none, nor
    are names that are only called. State counts at the top of a file too. A hook without a list as its last argument is left out."""
    facts = stored(_facts(files, hooks))
    hook = ("hook_n", "match", "deps", "deps_end", "line", "column", "hook")
    rows = meant(facts.filter("kind is null").select("relative_path", "name", "n", "called", *hook), facts.filter("kind is not null").select("relative_path", "name", "n", "kind", "lo", "hi"))
    outer = (F.col("at") < F.col("hook_n")) & (((F.col("lo") >= 0) & (F.col("hi") > F.col("match"))) | (F.col("kind") == "state"))
    read = (F.col("n") < F.col("deps")) & ~F.col("called") & ~F.col("kind").isin("setter", "ref", "class", "function") & ~stable(F.col("name"))
    listed = (F.col("n") > F.col("deps")) & (F.col("n") < F.col("deps_end"))
    by_name = rows.groupBy("relative_path", "name", *hook).agg(F.max(outer & read).alias("read"), F.max(listed).alias("listed")).filter("read and not coalesce(listed, false)")
    each = by_name.groupBy("relative_path", *hook).agg(F.array_sort(F.collect_set("name")).alias("names"))
    return each.select(F.col("relative_path").alias("file"), "line", "column", "hook", "names")
