"""Tokens of script files as rows, and the tree of brackets over them.

`lex` is a table function (registered for SQL by register()): a text gives its tokens with kind, offset, line and column, so that strings,
templates with their nested code, regular expressions and comments are told apart once. A file is read where it lies, with a stack of
its brackets: nested() gives each token its level, its partner and the bracket around it, and each bracket what stands before, in and
behind it. So no token is shuffled, sorted or stored: bodies(), calls() and functions() are expressions over the rows of brackets, and
heads_of() gives these alone. members() and within() go by the rows of tokens. Indentation never counts.

Code says the same over and over: shapes_of() gives each kind of bracket once a batch, with its places, and reads a short bracket such as
`(a, [b])` once a task. calls() and functions() take shapes as they take heads, so that their patterns run once a shape.

Defined cases: a null or empty text has no tokens; a string, template or comment that nothing closes runs to the end of its line or
text; a bracket without a partner has a null match.
"""

from __future__ import annotations

import re
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCHEMA = "n int, kind string, text string, offset int, line int, `column` int"
_PARTS = (
    r"(?P<word>[^\W\d][\w$]*|[$#@][\w$]*)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)|(?P<number>\d[\w.]*)",
    r"(?P<punct>[()\[\]{},;]|=>|\?\.(?!\d)|\.\.\.|&&=?|\|\|=?|\?\?=?|[=!]==?|[<>]=|[-+*/%&|^]=|\+\+|--|\*\*|\S)",
)
_PLAIN = re.compile("|".join(re.sub(r"\?P<\w+>", "?:", p) for p in (_PARTS[0].split("|(?P<comment>")[0], _PARTS[0].rsplit("|", 1)[1], _PARTS[1])))
_LETTER = re.compile(r"[^\W\d]|[$#@]")
_TOKEN = re.compile(rf"\s*(?:{'|'.join(_PARTS)})", re.S)
#: A short bracket: eight pieces at most (runs of other signs, strings, templates, brackets), three others in it at most one in another, and no slash.
_PIECES = r"[^()\[\]{}\"'`/]{1,100}+", r"\"(?:\\[^\n]|[^\"\\\n]){0,100}+\"", r"'(?:\\[^\n]|[^'\\\n]){0,100}+'", r"`(?:\\.|[^`\\$]|\$(?!\{)|\$\{(?:[^()\[\]{}\"'`/]|\([^()\[\]{}\"'`/]*+\))*+\}){0,100}+`"
_SHORT = "(?!)"
for _ in range(4):
    _SHORT = rf"[(\[{{](?:{'|'.join(_PIECES)}|{_SHORT}){{0,8}}+[)\]}}]"
_GROUPED = re.compile(rf"\s*(?:(?P<run>[^\s()\[\]{{}},;\"'`/][^()\[\]{{}},;\"'`/\n]*)|{_PARTS[0]}|(?P<group>{_SHORT})|{_PARTS[1]})", re.S)
#: By pattern: names of its groups, and the numbers of two.
_NAMES = {p: ({i: name for name, i in p.groupindex.items()}, p.groupindex["punct"], p.groupindex["comment"]) for p in (_TOKEN, _GROUPED)}
_CHUNK = re.compile(r"(?:\\.|[^`\\$]|\$(?!\{))*", re.S)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
#: Words after which a slash begins a regular expression.
_BEFORE_REGEX = ("return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "await", "yield")


def scan(text: str, grouped: bool = False) -> Iterator[tuple[str, str, int]]:
    """kind, text and offset of each token but white space. A template gives its pieces of text, and between them `${`, the tokens of the code, and `}`.

    grouped: outside of templates a short bracket is one token of kind group, and what stands between quotes, slashes, brackets, `,`, `;` and lines' ends one of kind run."""
    at, before, holes, run = 0, "", [], 0
    while at < len(text):
        token = _GROUPED if grouped and not holes else _TOKEN
        names, punct, comment = _NAMES[token]
        for m in token.finditer(text, at):
            i = m.lastindex
            word, begin = m[i], m.start(i)
            if i == punct:
                if word == "`" or (holes and word == "}" and holes[-1] == 0):
                    break  # a template begins or goes on
                if run and word[0] == "/":
                    before = _PLAIN.findall(before)[-1]
                if word[0] == "/" and (before in ("", *_BEFORE_REGEX) or not re.match(r"[\w$)\]}`'\"]", before[-1])) and (r := _REGEX.match(text, begin)):
                    before, at, run = r[0], r.end(), 0
                    yield "regex", before, begin
                    m = None
                    break
                if holes:
                    holes[-1] += (word == "{") - (word == "}")
            if i != comment:
                before, run = word, i == 1 and grouped and not holes
            yield names[i], word, begin
        else:
            return
        if m is None:
            continue
        at, run = begin + 1, 0
        if word == "}":
            holes.pop()
            yield "punct", "}", begin
            begin = at
        at = _CHUNK.match(text, at).end()
        if text.startswith("${", at):
            yield "template", text[begin:at], begin
            yield "punct", "${", at
            holes.append(0)
            at, before = at + 2, "${"
        else:
            at = min(at + 1, len(text))
            yield "template", text[begin:at], begin
            before = "`"


_COARSE = re.compile(r"(?P<run>[^/'\"`{}]+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)|(?P<sign>[/{}`])", re.S)


def marks(text: str) -> Iterator[tuple[str, str, int]]:
    """The comments, regular expressions and pieces of templates of scan(): what lies between quotes, slashes and braces is passed over as one run."""
    at, run, before, holes = 0, "", "", []
    while at < len(text):
        for m in _COARSE.finditer(text, at):
            kind, word, begin = m.lastgroup, m[0], m.start()
            if kind == "run":
                run = word if word.strip() else run
            elif kind == "comment":
                yield kind, word, begin
            elif kind == "string":
                run, before = "", word
            elif word == "/":
                for t in _TOKEN.finditer(run):
                    before = t[t.lastindex]
                run = ""
                if (before in ("", *_BEFORE_REGEX) or not re.match(r"[\w$)\]}`'\"]", before[-1])) and (r := _REGEX.match(text, begin)):
                    before, at = r[0], r.end()
                    yield "regex", before, begin
                    m = None
                    break
                before = "/"
            elif word == "`" or (word == "}" and holes and holes[-1] == 0):
                break
            else:
                run, before = "", word
                if holes:
                    holes[-1] += (word == "{") - (word == "}")
        else:
            return
        if m is None:
            continue
        begin += word == "}"
        if word == "}":
            holes.pop()
        at = _CHUNK.match(text, begin + (word == "`")).end()
        run = ""
        if text.startswith("${", at):
            yield "template", text[begin:at], begin
            holes.append(0)
            at, before = at + 2, "${"
        else:
            at = min(at + 1, len(text))
            yield "template", text[begin:at], begin
            before = "`"


def lex(text: str | None) -> Iterator[tuple]:
    line, begin, last = 1, 0, 0
    for n, (kind, word, at) in enumerate(scan(text or "")):
        if ends := text.count("\n", last, at):
            line, begin = line + ends, text.rindex("\n", last, at) + 1
        last = at
        yield n, kind, word, at, line, at - begin + 1


class _Lexer:
    def eval(self, text: str) -> Iterator[tuple]:
        yield from lex(text)


lexer = F.udtf(_Lexer, returnType=SCHEMA, useArrow=True)


def register(spark: SparkSession, name: str = "lex") -> None:
    """Makes the lexer callable from SQL: SELECT ... FROM files, LATERAL lex(content)."""
    spark.udtf.register(name, lexer)


OPEN, CLOSE = ("(", "[", "{", "${"), (")", "]", "}")
_SIDE = dict.fromkeys(OPEN, 1) | dict.fromkeys(CLOSE, -1)
#: A line that begins with one of these goes on with the one before.
GO_ON = ("of", "in", "as", "instanceof", "extends", "implements", "from", "is", "satisfies")
#: Words and last characters behind which a line's end ends no statement, and may end one.
_NO_END = ("return", "typeof", "new", "await", "void", "extends", "else", "case")
_END = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_$)]}'\"`")
#: Tokens before a bracket that its head shows.
HEAD = 24
_KINDS = {
    "n": pa.int32(), "kind": pa.string(), "text": pa.string(), "offset": pa.int32(), "line": pa.int32(), "column": pa.int32(), "level": pa.int32(), "match": pa.int32(), "up": pa.int32(), "around": pa.string(),
    "stmt": pa.int32(), "to": pa.int32(), "head": pa.string(), "then": pa.string(), "same": pa.bool_(), "outer": pa.string(), "tries": pa.int32(), "args": pa.int32(), "parts": pa.list_(pa.string()), "taken": pa.list_(pa.string()),
}
COLUMNS = tuple(_KINDS)
_MATCH, _STMT, _TO, _THEN, _SAME, _ARGS, _PARTS, _TAKEN = (list(_KINDS).index(c) for c in ("match", "stmt", "to", "then", "same", "args", "parts", "taken"))
_SPARK = {pa.int32(): "int", pa.string(): "string", pa.bool_(): "boolean", pa.list_(pa.string()): "array<string>"}
_TREE = "relative_path string, " + ", ".join(f"`{c}` {_SPARK[t]}" for c, t in _KINDS.items())


class _Bracket:
    """A bracket that is open, or the top (row None): its own tokens so far, where its statement began, the commas and the names that patterns take."""

    __slots__ = ("row", "n", "sign", "head", "tries", "texts", "begin", "stmt", "at", "commas", "taken", "wait", "kept")

    def __init__(self, row: list | None, n: int, sign: str | None, head: str | None, tries: int):
        self.row, self.n, self.sign, self.head, self.tries = row, n, sign, head, tries
        self.texts, self.begin, self.stmt, self.at, self.commas, self.taken, self.wait, self.kept = [], 0, 0, 0, [], [], None, None

    def parts(self, commas: list[int]) -> list[list[str]]:
        """The own tokens between commas; a last comma makes no part."""
        texts = self.texts
        if not commas:
            return [texts] if texts else []
        return [t for a, b in zip([0, *(c + 1 for c in commas)], [*commas, len(texts)], strict=True) if (t := texts[a:b])]

    def end(self, around: _Bracket) -> tuple[int, list[str] | None, list[str] | None]:
        """args, parts and taken of the bracket."""
        own = self.parts(self.commas)
        args, parts, taken = len(own), None, None
        if self.sign == "(":
            if self.commas and ("<" in self.texts or ">" in self.texts):  # these are brackets too where types stand
                deep, commas = 0, []
                for i, t in enumerate(self.texts):
                    deep += (t == "<") - (t == ">")
                    if t == "," and deep == 0:
                        commas.append(i)
                own = self.parts(commas)
            parts, taken = [" ".join(p) for p in own], self.taken
        elif self.sign == "{" and around.sign == "(" and (not self.head or self.head[-1] == ","):
            around.taken += [p[0] for p in own]
        return args, parts, taken


def nested(text: str | None, every: bool) -> list[list]:
    """Rows (as _KINDS) of a text's tokens, or of the brackets that open alone.

    level: brackets around; match: n of the partner; up: n of the bracket around (-1: none); around: its text; stmt: number of the statement among
    those of the same bracket, which ends at `;`, behind a `}`, or at a line's end where a name begins the next. A bracket that opens has
    head: the tokens of the same bracket and statement before it, brackets there without what is inside; to: the line of its partner; then: the
    token behind the partner; same: whether that is of the same statement; outer: the head of the bracket around; tries: braces of a `try` around
    it; args: its parts at commas; and a `(` has parts: those where `<` and `>` are brackets too; taken: the first tokens of the parts
    of braces that stand at the beginning of a part."""
    text, rows = text or "", []
    inside, stack, low = _Bracket(None, -1, None, None, 0), [], 0
    line, begin, last = 1, 0, 0
    for n, (kind, word, at) in enumerate(scan(text)):
        side = _SIDE.get(word, 0) if kind == "punct" else 0
        if every or side:
            if ends := text.count("\n", last, at):
                line, begin = line + ends, text.rindex("\n", last, at) + 1
            last = at
        if kind == "comment":
            if every:
                rows.append([n, kind, word, at, line, at - begin + 1, *[None] * (len(_KINDS) - 6)])
            continue
        closed = None
        if side < 0:
            if stack:
                closed, inside = inside, stack.pop()
                closed.row[_ARGS], closed.row[_PARTS], closed.row[_TAKEN] = closed.end(inside)
            else:
                low -= 1
        texts = inside.texts
        if texts:
            before = texts[-1]
            if before == ";" or before == "}" or (kind == "word" and before[-1] in _END and word not in GO_ON and before not in _NO_END and text.find("\n", inside.at, at) >= 0):
                inside.stmt, inside.begin = inside.stmt + 1, len(texts)
            if inside.wait is not None:
                inside.wait[_THEN], inside.wait[_SAME], inside.wait = word, inside.stmt == inside.wait[_STMT], None
        inside.at = at
        if side > 0:
            head = " ".join(texts[max(inside.begin, len(texts) - HEAD) :])
            row = [n, kind, word, at, line, at - begin + 1, low + len(stack), None, inside.n, inside.sign, inside.stmt, None, head, None, False, inside.head, inside.tries, 0, None, None]
            rows.append(row)
            stack.append(inside)
            tries = inside.tries + (word == "{" and len(texts) > inside.begin and texts[-1] == "try")
            texts.append(word)
            inside = _Bracket(row, n, word, head, tries)
            continue
        if closed is not None:
            closed.row[_MATCH], closed.row[_TO], inside.wait = n, line, closed.row
        if every:
            rows.append([n, kind, word, at, line, at - begin + 1, low + len(stack), closed.n if closed is not None else None, inside.n, inside.sign, inside.stmt, *[None] * (len(_KINDS) - 11)])
        if word == "," and kind == "punct":
            inside.commas.append(len(texts))
        texts.append(word)
    while stack:  # what nothing closes
        closed, inside = inside, stack.pop()
        closed.row[_ARGS], closed.row[_PARTS], closed.row[_TAKEN] = closed.end(inside)
    return rows


#: Rows that a task passes on at once.
_SENT = 20000


def _read(files: DataFrame, every: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(paths: list[str], rows: list[list]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [[]] * len(_KINDS)
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), *[pa.array(c, k) for c, k in zip(cols, _KINDS.values(), strict=True)]], ["relative_path", *_KINDS])

        paths, rows = [], []
        for b in batches:
            for path, text in zip(b["relative_path"].to_pylist(), b["content"].to_pylist(), strict=True):
                own = nested(text, every)
                paths += [path] * len(own)
                rows += own
                if len(rows) >= _SENT:
                    yield sent(paths, rows)
                    paths, rows = [], []
        yield sent(paths, rows)

    return files.select("relative_path", "content").mapInArrow(run, _TREE)


def tokens(files: DataFrame) -> DataFrame:
    """relative_path and the tokens of files(relative_path, content), comments included, with the columns of nested()."""
    return _read(files, True)


def structure(tokens_: DataFrame) -> DataFrame:
    """Tokens but comments."""
    return tokens_.filter("kind <> 'comment'")


_HEADS = ("relative_path", "n", "match", "up", "around", "stmt", "level", "text", "line", "column", "to", "head", "then", "same", "outer", "tries", "args", "parts", "taken")


def heads(tree: DataFrame, *columns: str) -> DataFrame:
    """The brackets that open among structure()."""
    return tree.filter((F.col("kind") == "punct") & F.col("text").isin(*OPEN)).select(*_HEADS, *columns)


def heads_of(files: DataFrame) -> DataFrame:
    """heads() of files(relative_path, content) without rows for all tokens."""
    return _read(files, False).select(*_HEADS)


_SHAPE = {
    "text": pa.string(), "around": pa.string(), "head": pa.string(), "then": pa.string(), "same": pa.bool_(), "outer": pa.string(), "tries": pa.int32(), "level": pa.int32(), "args": pa.int32(),
    "parts": pa.list_(pa.string()), "taken": pa.list_(pa.string()),
}
_PLACE = ("relative_path", "n", "line", "column")
_SHAPES = ", ".join(f"`{c}` {_SPARK[t]}" for c, t in _SHAPE.items()) + ", at array<struct<relative_path:string,n:int,line:int,`column`:int>>"
_OF_ROW = [COLUMNS.index(c) for c in _SHAPE]
_N, _LINE, _COLUMN, _OUTER, _TRIES, _LEVEL = (COLUMNS.index(c) for c in ("n", "line", "column", "outer", "tries", "level"))
#: Shapes and short brackets that a task remembers, and places that it passes on at once.
_KNOWN, _PLACES = 50_000, 100_000


def _kept(head: str | None) -> str | None:
    """A head that may be a class's, an interface's or a type's."""
    return head if head and ("class" in head or "interface" in head or "type" in head) else None


class _Shapes:
    """Brackets that open, as numbers of shapes with places."""

    def __init__(self, texts: tuple[str, ...] = OPEN):
        self.number, self.texts = None, texts
        self.clear()

    def clear(self) -> None:
        if self.number is None or max(map(len, (self.number, self.own, self.short, self.runs))) > _KNOWN:
            self.number, self.own, self.short, self.runs = {}, {}, {}, {}
            self.held = [((), (), (), ())]
        self.paths, self.counts, self.flat = [], [], []

    def of(self, shape: tuple) -> int:
        return self.number.setdefault(shape, len(self.number))

    def _short(self, word: str, level: int, tries: int, outer: str | None) -> tuple:
        """A short bracket's tokens, args, parts, taken, the first tokens of its parts and where `held` has what opens in it: shapes, tokens, lines and columns, from its own."""
        around, own, *inner = nested(f"({word})", False)
        ids = []
        for r in inner:
            r[_OUTER] = outer if r[_LEVEL] == 2 else _kept(r[_OUTER])
            r[_LEVEL] += level - 1
            r[_TRIES] += tries
            ids.append(self.of(tuple([tuple(r[i]) if isinstance(r[i], list) else r[i] for i in _OF_ROW])))
        if inner:
            self.held.append((ids, [r[_N] - 1 for r in inner], [r[_LINE] - 1 for r in inner], [r[_COLUMN] - (2 if r[_LINE] == 1 else 0) for r in inner]))
        args, parts, taken = (tuple(own[i]) if isinstance(own[i], list) else own[i] for i in (_ARGS, _PARTS, _TAKEN))
        return around[_MATCH] - 1, args, parts, taken, around[_TAKEN], len(self.held) - 1 if inner else 0

    def _follow(self, wait: list | tuple, then: str | None, same: bool) -> None:
        """What stands behind a bracket that is closed."""
        if type(wait) is list:
            wait[3], wait[4] = then, same
            return
        at, word, known, head, sign, outer, tries, level, _ = wait
        key = word, head, sign, outer, tries, level, then, same
        i = self.own.get(key)
        if i is None:
            i = self.own[key] = self.of((word[0], sign, head, then, same, outer, tries, level, *known[1:4]))
        self.flat[at] = i

    def read(self, path: str, text: str | None) -> None:
        """The brackets of nested(text, False)."""
        text, rows, n, flat, before_it = text or "", [], -1, self.flat, len(self.flat)
        inside, stack, low = _Bracket(None, -1, None, None, 0), [], 0
        line, begin, last = 1, 0, 0
        for kind, word, at in scan(text, True):
            n += 1
            if kind == "comment":
                continue
            closed, short, own, side = None, kind == "group", None, 0
            if kind == "run":
                found = self.runs.get(word)
                if found is None:
                    own = _PLAIN.findall(word)
                    found = self.runs[word] = own, own[0], "word" if _LETTER.match(own[0]) else "punct"
                own, word, kind = found
            elif short or (kind == "punct" and (side := _SIDE.get(word, 0)) > 0):
                side = 1
                if ends := text.count("\n", last, at):
                    line, begin = line + ends, text.rindex("\n", last, at) + 1
                last = at
            elif side:
                if stack:
                    closed, inside = inside, stack.pop()
                    closed.row[8:11] = closed.end(inside)
                    if closed.wait is not None:
                        self._follow(closed.wait, None, False)
                else:
                    low -= 1
            texts = inside.texts
            if texts:
                before = texts[-1]
                if before == ";" or before == "}" or (kind == "word" and before[-1] in _END and word not in GO_ON and before not in _NO_END and text.find("\n", inside.at, at) >= 0):
                    inside.stmt, inside.begin = inside.stmt + 1, len(texts)
                if inside.wait is not None:
                    self._follow(inside.wait, word[0] if short else word, inside.stmt == inside.wait[-1])
                    inside.wait = None
            inside.at = at
            if own is not None:
                texts += own
                n += len(own) - 1
                continue
            if side > 0:
                level, column = low + len(stack), at - begin + 1
                head = " ".join(texts[max(inside.begin, len(texts) - HEAD) :])
                tries = inside.tries + (word[0] == "{" and len(texts) > inside.begin and texts[-1] == "try")
                if not short:
                    row = [word, inside.sign, head, None, False, inside.kept, inside.tries, level, 0, None, None, n, line, column, inside.stmt]
                    rows.append(row)
                    texts.append(word)
                    stack.append(inside)
                    inside = _Bracket(row, n, word, head, tries)
                    inside.kept = _kept(head)
                    continue
                key = word, level, tries, _kept(head)
                known = self.short.get(key)
                if known is None:
                    known = self.short[key] = self._short(*key)
                inside.wait = len(flat), word, known, head, inside.sign, inside.kept, inside.tries, level, inside.stmt
                flat += -1, n, line, column, known[5]
                if word[0] == "{" and inside.sign == "(" and (not head or head[-1] == ","):
                    inside.taken += known[4]
                texts += word[0], word[-1]
                inside.at = at + len(word) - 1
                n += known[0] - 1
                continue
            if closed is not None:
                inside.wait = closed.row
            if word == "," and kind == "punct":
                inside.commas.append(len(texts))
            texts.append(word)
        while stack:  # what nothing closes
            closed, inside = inside, stack.pop()
            closed.row[8:11] = closed.end(inside)
            if closed.wait is not None:
                self._follow(closed.wait, None, False)
        if inside.wait is not None:
            self._follow(inside.wait, None, False)
        for r in rows:
            if r[9] is not None:
                r[9], r[10] = tuple(r[9]), tuple(r[10])
            flat += self.of(tuple(r[:11])), *r[11:14], 0
        self.paths.append(path)
        self.counts.append((len(flat) - before_it) // 5)

    def batch(self) -> pa.RecordBatch:
        """The shapes since the last batch with their places."""
        ids, ns, lines, columns, held = np.array(self.flat, np.int32).reshape(-1, 5).T
        files = np.repeat(np.arange(len(self.paths)), self.counts)
        # what short brackets hold, a piece each
        sizes = np.array([len(h[0]) for h in self.held])[held]
        own, starts = np.repeat(np.arange(len(held)), sizes), np.cumsum([0, *(len(h[0]) for h in self.held)])
        inner = starts[held][own] + np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        of = [np.array([x for h in self.held for x in h[i]], np.int32)[inner] for i in range(4)]
        ids, ns, files = np.append(ids, of[0]), np.append(ns, ns[own] + of[1]), np.append(files, files[own])
        columns, lines = np.append(columns, np.where(of[2] == 0, columns[own], 0) + of[3]), np.append(lines, lines[own] + of[2])
        shapes = list(self.number)
        keep = np.array([x[0] in self.texts for x in shapes], bool)[ids]
        ids, ns, files, lines, columns = (x[keep] for x in (ids, ns, files, lines, columns))
        order = np.argsort(ids, kind="stable")
        found, firsts = np.unique(ids[order], return_index=True)
        cols = list(zip(*[shapes[i] for i in found], strict=True)) or [[]] * len(_SHAPE)
        places = pa.StructArray.from_arrays([pa.array(self.paths, pa.string()).take(pa.array(files[order])), *[pa.array(x[order]) for x in (ns, lines, columns)]], _PLACE)
        at = pa.ListArray.from_arrays(pa.array(np.append(firsts, len(ids)).astype(np.int32)), places)
        self.clear()
        return pa.RecordBatch.from_arrays([*[pa.array(c, k) for c, k in zip(cols, _SHAPE.values(), strict=True)], at], [*_SHAPE, "at"])


def shapes_of(files: DataFrame, *texts: str) -> DataFrame:
    """heads_of(files) by shape, of all brackets or of these: what is alike in them, and `at`: their relative_path, n, line and column. One shape may
    have several rows. outer is null where it is the head of no class, interface or type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Shapes(texts or OPEN)
        for b in batches:
            for path, text in zip(b["relative_path"].to_pylist(), b["content"].to_pylist(), strict=True):
                known.read(path, text)
                if len(known.flat) >= 5 * _PLACES:
                    yield known.batch()
        yield known.batch()

    scripts = files.filter(F.col("relative_path").rlike(SCRIPT))
    return scripts.select("relative_path", "content").mapInArrow(run, _SHAPES)


def _placed(d: DataFrame, *columns: str) -> DataFrame:
    """These columns with the places of heads, or of shapes."""
    return d.select(*columns, F.inline("at")) if "at" in d.columns else d.select(*columns, *_PLACE)


NAME = r"[A-Za-z_$][\w$]*"
GENERIC = r"(?: < .* >)?"
RESULT = r"(?: : .*)?"


_KIND_WORD = rf"\b(class|interface|enum|namespace) ({NAME})[^=()]*$"
_CONTROL = r"\b(if|for|while|switch|catch|with)(?: await)? \( \)$"
_FUNCTION = rf"\bfunction(?: \*)?(?: ({NAME}))?{GENERIC} \( \){RESULT}$"
_ARROW = rf"(?:\b(?:const|let|var) ({NAME})(?: : [^=]*)? = )?(?:async )?(?:\( \)|{NAME}){RESULT} =>$"
_METHOD = rf"(?:^|[;}}] |[ ,])({NAME})(?: \?)?{GENERIC} \( \){RESULT}$"
_ALIAS = rf"\btype ({NAME}){GENERIC} =$"
_WORD = r"\b(try|else|finally|do)$"


def role_of(h: Column) -> Column:
    """What a brace with this head is."""
    return (
        F.when(h.rlike(_WORD), F.regexp_extract(h, _WORD, 1)).when(h == "catch", "catch").when(h.rlike(_CONTROL), F.regexp_extract(h, _CONTROL, 1)).when(h.rlike(_ALIAS), "type").when(h.rlike(_ARROW), "arrow")
        .when(h.rlike(_FUNCTION), "function").when(h.rlike(_KIND_WORD), F.regexp_extract(h, _KIND_WORD, 1)).when(h.rlike(_METHOD) & ~h.rlike(r"[=(,:?]$"), "method").otherwise("object")
    )


def bodies(heads_: DataFrame) -> DataFrame:
    """Braces with what they are: role (try, else, finally, do, if, for, while, switch, catch, class, interface, enum, namespace, type, function,
    arrow, method or object) and name; line and to are its first and last lines."""
    h = F.col("head")
    name = (
        F.when(F.col("role") == "type", F.regexp_extract(h, _ALIAS, 1)).when(F.col("role") == "arrow", F.regexp_extract(h, _ARROW, 1)).when(F.col("role") == "function", F.regexp_extract(h, _FUNCTION, 1))
        .when(F.col("role").isin("class", "interface", "enum", "namespace"), F.regexp_extract(h, _KIND_WORD, 2)).when(F.col("role") == "method", F.regexp_extract(h, _METHOD, 1))
    )
    return heads_.filter("text = '{'").withColumn("role", role_of(h)).withColumn("name", F.nullif(name, F.lit("")))


def within(tree: DataFrame, blocks: DataFrame, name: str) -> DataFrame:
    """tree with `name`: how many of the blocks (relative_path, n, match) stand around each token."""
    edge = blocks.filter("match is not null").select("relative_path", F.inline(F.array(F.struct("n", F.lit(1).alias("step")), F.struct(F.col("match").alias("n"), F.lit(-1).alias("step")))))
    w = W.partitionBy("relative_path").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    return tree.join(edge, ["relative_path", "n"], "left").withColumn(name, F.sum(F.coalesce("step", F.lit(0))).over(w)).drop("step")


#: Words before a bracket that are no calls.
NO_CALLS = ("if", "for", "while", "switch", "catch", "return", "function", "typeof", "await", "super", "constructor", "require", "import", "with", "new", "void", "yield", "of", "in", "async")


def calls(tree: DataFrame | None, heads_: DataFrame) -> DataFrame:
    """Calls among heads or shapes: relative_path, line, column, name, on (what the method is called on: the name before the dot; null for a plain call), args (their number),
    named (names of `name: value` in an argument that is a literal object) and alone: whether the call is a statement by itself."""
    call = rf"(?:^|[^.\w$])(?:({NAME}|\)|\]) \??\. )?({NAME}){GENERIC}$"
    d = heads_.filter("text = '('").withColumns({"name": F.regexp_extract("head", call, 2), "on": F.nullif(F.regexp_extract("head", call, 1), F.lit(""))})
    d = d.filter((F.col("name") != "") & ~F.col("name").isin(*NO_CALLS) & ~F.col("head").rlike(rf"\b(function|new|get|set|abstract)(?: \*)? {NAME}{GENERIC}$"))
    # declarations: a list with a body behind it, or at the top of a class or type without a value
    top = (F.col("around") == "{") & role_of(F.col("outer")).isin("class", "interface", "type")
    d = d.filter(~F.col("then").eqNullSafe("{") & (~F.coalesce(top, F.lit(False)) | F.contains("head", F.lit(" = "))))
    single = rf"^(?:(?:if|while|for)(?: await)? \( \) |else )*(?:this \. )?{NAME}$"
    d = d.withColumn("alone", F.col("head").rlike(single) & (F.col("around").isNull() | (F.col("around") == "{")) & (F.col("then").isNull() | (F.col("then") == ";") | ~F.col("same")))
    return _placed(d, "name", "on", "args", "alone").select("relative_path", "n", "line", "column", "name", "on", "args", "alone")


def functions(tree: DataFrame | None, heads_: DataFrame) -> DataFrame:
    """Functions by declaration, arrow and method, among heads or shapes: relative_path, n, line, name, kind (function, arrow, method), exported, is_async, params (names, then those that patterns take out of objects),
    least and most (numbers of arguments; 1000: no end)."""
    h = F.col("head")
    declared = rf"^(export )?(?:default )?(?:declare )?(async )?function(?: \*)? ({NAME}){GENERIC}$"
    arrow = rf"^(export )?(?:const|let|var) ({NAME})(?: : [^=]*)? = (async ?)?(?:< .* >)?$"
    method = rf"^(?:@\w+ (?:\( \) )?)*(?:(?:public|private|protected|static|override|readonly) )*(async )?(?:\* )?({NAME}){GENERIC}$"
    in_class = (F.col("around") == "{") & (role_of(F.col("outer")) == "class")
    lists = heads_.filter("text = '('").withColumn("out", F.when(in_class, F.col("outer").rlike(r"^export\b")))
    is_arrow = h.rlike(arrow) & F.col("then").isin("=>", ":")
    is_method = F.col("out").isNotNull() & h.rlike(method) & F.coalesce(F.col("then").isin("{", ":"), F.lit(False)) & ~h.rlike(rf"\b(if|for|while|switch|catch)$")
    kind = F.when(h.rlike(declared), "function").when(is_arrow, "arrow").when(is_method, "method")
    d = lists.withColumn("kind", kind).filter("kind is not null")
    pick = lambda f, a, m: F.when(F.col("kind") == "function", F.regexp_extract(h, declared, f)).when(F.col("kind") == "arrow", F.regexp_extract(h, arrow, a)).otherwise(F.regexp_extract(h, method, m))
    first = lambda x: F.substring_index(x, " ", 1)
    named = lambda x: F.when(first(x) == "...", F.regexp_extract(x, rf"^\.\.\. ({NAME})", 1)).otherwise(F.regexp_extract(x, rf"^(?:@\w+ (?:\( \) )?)*(?:(?:public|private|protected|readonly) )*({NAME})", 1))
    free = lambda x: (first(x) == "...") | x.rlike(rf"^[^:=]*\?(?: :|$)| = |^{NAME} =$")
    d = d.select(
        *[c for c in (*_PLACE, "at") if c in d.columns], pick(3, 2, 2).alias("name"), "kind", (F.when(F.col("kind") == "method", F.col("out")).otherwise(h.startswith("export"))).alias("exported"), (F.trim(pick(2, 3, 1)) == "async").alias("is_async"),
        F.filter("parts", lambda x: first(x) != "this").alias("parts"), F.array_sort(F.array_distinct(F.filter("taken", lambda x: x.rlike(rf"^{NAME}$")))).alias("inner"),
    )
    # names that a pattern takes out of an object are parameters by name too
    params = F.concat(F.transform("parts", lambda x: F.nullif(named(x), F.lit(""))), "inner")
    most = F.when(F.exists("parts", lambda x: first(x) == "..."), 1000).otherwise(F.size("parts"))
    d = d.withColumns({"params": params, "least": F.size(F.filter("parts", lambda x: ~free(x))), "most": most.cast("int")})
    return _placed(d, "name", "kind", "exported", "is_async", "params", "least", "most").select("relative_path", "n", "line", "name", "kind", "exported", "is_async", "params", "least", "most")


def members(tree: DataFrame, blocks: DataFrame) -> DataFrame:
    """Properties at the top of blocks: relative_path, block (n), name, line. A property is a name before `:`, `?`, `!` or, in a class, `=` or `;`."""
    rows = tree.join(blocks.select("relative_path", F.col("n").alias("up"), "role"), ["relative_path", "up"])
    w = W.partitionBy("relative_path", "up").orderBy("n")
    before, after = F.lag("text").over(w), F.lead("text").over(w)
    begins = before.isNull() | before.isin(";", ",", "}", "public", "private", "protected", "readonly", "static", "declare", "override") | (F.lag("line").over(w) < F.col("line"))
    is_one = begins & F.col("kind").isin("word", "string") & (after.isin(":", "?", "!") | ((F.col("role") == "class") & after.isin("=", ";")))
    return rows.withColumn("hit", is_one).filter("hit").select("relative_path", F.col("up").alias("block"), F.regexp_replace("text", "^['\"]|['\"]$", "").alias("name"), "line")


#: Paths of files that the lexer reads.
SCRIPT = r"\.[cm]?[jt]sx?$"
_trees: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def tree_of(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """structure() and heads() of the scripts among files. Neither is stored: a task reads its files where they lie."""
    if files not in _trees:
        scripts = files.filter(F.col("relative_path").rlike(SCRIPT))
        _trees[files] = structure(tokens(scripts)), heads_of(scripts)
    return _trees[files]
