"""What a source file imports and exports, by language: small scanners that Spark runs on each file of a batch.

A parser takes a text and gives imports (target, type, line, symbols, dynamic, type_only) and exports (name, type, line, default).
A symbol is (name, alias, is_default, is_namespace). Comments, and the texts of templates of scripts, are blanked first, so that places stay. `register_parser` adds or
replaces a language.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from lodestone.operators.tokens import marks

Symbol = tuple[str, str | None, bool, bool]
Import = tuple[str, str, int, list[Symbol], bool, bool]
Export = tuple[str, str, int, bool]
Parser = Callable[[str], tuple[list[Import], list[Export]]]

_COMMENT_OR_STRING = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)


def bare(text: str) -> str:
    """The text with comments of the C family blanked, newlines kept."""
    return _COMMENT_OR_STRING.sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0][0] == "/" else m[0], text)


def bare_script(text: str) -> str:
    """The text with comments, regular expressions and the texts of templates blanked, newlines kept: the code inside templates stays."""
    out, at = [], 0
    for _kind, word, begin in marks(text):
        out += [text[at:begin], "\n".join([" " * len(x) for x in word.split("\n")])]
        at = begin + len(word)
    return "".join(out) + text[at:]


def line_at(text: str, place: int) -> int:
    return text.count("\n", 0, place) + 1


def named(part: str, word: str = "as") -> Iterator[Symbol]:
    """Symbols of a comma list with aliases."""
    for item in part.split(","):
        words = item.split()
        if words and words[0] == "type" and len(words) > 1:
            words = words[1:]
        if words:
            yield words[0], words[2] if len(words) == 3 and words[1] == word else None, False, False


_QUOTED = r"(?P<q>['\"])(?P<to>[^'\"\n]+)(?P=q)"
_FROM = re.compile(r"(?:^|;)[ \t]*(?P<kind>import|export)\s+(?P<type>type\s+(?!from\b))?(?P<what>[^'\"();=]*?)\s*from\s*" + _QUOTED, re.M)
_PLAIN = re.compile(r"(?:^|;)[ \t]*import\s*" + _QUOTED, re.M)
_CALLED = re.compile(r"(?<![\w.$])(?P<kind>import|require)\s*\(\s*" + _QUOTED + r"\s*\)")
_LOCAL = re.compile(r"(?:^|;)[ \t]*export\s*\{(?P<what>[^}]*)\}(?!\s*from)", re.M)
_DECLARED = re.compile(
    r"^[ \t]*(?P<out>export\s+)?(?P<default>default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?"
    r"(?P<kind>function|class|interface|type|enum|namespace|module|const\s+enum|const|let|var)\b\s*\*?\s*(?P<name>[\w$]+)?(?P<rest>[^\n]*)", re.M,
)
_ARROW = re.compile(r"=\s*(?:async\s*)?(?:function\b|(?:\([^)]*\)|[\w$]+)\s*(?::[^=]*)?=>)")
_DEFAULT = re.compile(r"^[ \t]*export\s+default\s+(?!(?:async\s+)?function\b|(?:abstract\s+)?class\b|interface\b)", re.M)


def _kind(m: re.Match) -> str:
    kind = m["kind"].split()[-1]
    if kind in ("const", "let", "var"):
        return "function" if _ARROW.match(m["rest"].lstrip()) or _ARROW.search(m["rest"]) else "variable"
    return "namespace" if kind == "module" else kind


def script_imports(text: str) -> list[Import]:
    code, imports = bare_script(text), []
    for m in _FROM.finditer(code):
        what, line = m["what"].strip(), line_at(code, m.start("kind"))
        symbols: list[Symbol] = []
        braces = re.search(r"\{([^}]*)\}", what)
        for item in re.sub(r"\{[^}]*\}", "", what).split(","):
            words = item.split()
            if words[:2] == ["*", "as"] and len(words) == 3:
                symbols.append((words[2], None, False, True))
            elif len(words) == 1 and words[0] != "*":
                symbols.append((words[0], None, True, False))
        symbols += named(braces[1]) if braces else []
        kind = "re-export" if m["kind"] == "export" else "type-import" if m["type"] else "import" if symbols else "side-effect"
        imports.append((m["to"], kind, line, symbols, False, bool(m["type"])))
    imports += [(m["to"], "side-effect", line_at(code, m.start("q")), [], False, False) for m in _PLAIN.finditer(code)]
    for m in _CALLED.finditer(code):
        dynamic = m["kind"] == "import"
        imports.append((m["to"], "dynamic-import" if dynamic else "require", line_at(code, m.start()), [], dynamic, False))
    return imports


def script_exports(text: str) -> list[Export]:
    code, exports = bare_script(text), []
    local: dict[str, str] = {}
    for m in _DECLARED.finditer(code):
        name, line = m["name"], line_at(code, m.start("kind"))
        if name and name not in ("extends",):
            local[name] = _kind(m)
        if m["out"]:
            if name and name != "extends":
                exports.append((name, _kind(m), line, bool(m["default"])))
            if m["default"]:
                exports.append(("default", _kind(m), line, True))
    for m in _DEFAULT.finditer(code):
        rest = re.match(r"([\w$]+)\s*;?", code[m.end() :])
        exports.append(("default", local.get(rest[1], "variable") if rest else "variable", line_at(code, m.end() - 1), True))
    for m in _LOCAL.finditer(code):
        for name, alias, _, _ in named(m["what"]):
            exports.append((alias or name, local.get(name, "variable"), line_at(code, m.start("what")), alias == "default"))
    return exports


def script(text: str) -> tuple[list[Import], list[Export]]:
    """TypeScript and JavaScript."""
    return script_imports(text), script_exports(text)


# a parser whose halves can be had alone names them, so that neither is made for nothing
script.parts = script_imports, script_exports


_PY_IMPORT = re.compile(r"^[ \t]*(?:from\s+(?P<module>[.\w]+)\s+)?import\s+(?P<what>\([^)]*\)|[^\n#;]+)", re.M)
_PY_NAMES = re.compile(r"^(?:(?P<class>class)\s+|(?:async\s+)?(?P<function>def)\s+|(?P<variable>)(?=[A-Z_][A-Z0-9_]*\s*(?::[^=\n]*)?=(?!=)))(?P<name>\w+)", re.M)
_PY_ALL = re.compile(r"^__all__\s*(?:\+?=)\s*[\[(]([^\])]*)[\])]", re.M)


def python(text: str) -> tuple[list[Import], list[Export]]:
    imports, exports = [], []
    for m in _PY_IMPORT.finditer(text):
        line, symbols = line_at(text, m.start("what")), list(named(re.sub(r"#[^\n]*", "", m["what"]).strip("()\\ \n")))
        if m["module"]:
            imports.append((m["module"], "python-import", line, symbols, False, False))
        else:
            imports += [(s[0], "python-import", line, [s], False, False) for s in symbols]
    listed = {x for m in _PY_ALL.finditer(text) for x in re.findall(r"['\"](\w+)['\"]", m[1])}
    for m in _PY_NAMES.finditer(text):
        name = m["name"]
        if name != "__all__" and (not name.startswith("_") or name in listed):
            exports.append((name, "class" if m["class"] else "function" if m["function"] else "variable", line_at(text, m.start()), False))
    return imports, exports


_JAVA_IMPORT = re.compile(r"^[ \t]*import\s+(?:static\s+)?([\w.]+?)(?:\.\*)?\s*;", re.M)
_JAVA_TYPE = re.compile(r"^[ \t]*public\s+(?:[a-z]+\s+)*?(class|interface|enum)\s+(\w+)")
_JAVA_METHOD = re.compile(r"^[ \t]*public\s+(?:(?:static|final|abstract|synchronized)\s+)*(?:<[^>]*>\s*)?[\w<>\[\], .?]+\s+(\w+)\s*\(")


def java(text: str) -> tuple[list[Import], list[Export]]:
    code, exports, depth = bare(text), [], 0
    imports = [(m[1], "java-import", line_at(code, m.start(1)), [], False, False) for m in _JAVA_IMPORT.finditer(code)]
    for n, line in enumerate(code.split("\n"), 1):
        if m := _JAVA_TYPE.match(line):
            exports.append((m[2], m[1], n, False))
        elif depth > 0 and (m := _JAVA_METHOD.match(line)):
            exports.append((m[1], "function", n, False))
        depth += line.count("{") - line.count("}")
    return imports, exports


_GO_ONE = re.compile(r"^[ \t]*(?:(?P<alias>[\w.]+)[ \t]+)?\"(?P<to>[^\"\n]+)\"", re.M)
_GO_IMPORT = re.compile(r"^import\s*(?:\((?P<block>[^)]*)\)|(?P<one>[^\n(]+))", re.M)
_GO_NAME = re.compile(r"^(func|type|const|var)\s+(?:\([^)]*\)\s*)?([A-Z]\w*)", re.M)
_GO_KINDS = {"func": "function", "type": "type", "const": "constant", "var": "variable"}


def go(text: str) -> tuple[list[Import], list[Export]]:
    code, imports = bare(text), []
    for m in _GO_IMPORT.finditer(code):
        group = "block" if m["block"] is not None else "one"
        for x in _GO_ONE.finditer(m[group]):
            symbols = [(x["to"].rsplit("/", 1)[-1], x["alias"], False, True)] if x["alias"] else []
            imports.append((x["to"], "go-import", line_at(code, m.start(group) + x.start("to")), symbols, False, False))
    return imports, [(m[2], _GO_KINDS[m[1]], line_at(code, m.start()), False) for m in _GO_NAME.finditer(code)]


_RUST_USE = re.compile(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:use\s+(?P<path>[\w:]+?)(?:::\{(?P<many>[^;]*)\}|\s+as\s+(?P<alias>\w+)|(?:::(?P<all>\*)))?\s*;|extern\s+crate\s+(?P<crate>\w+))", re.M)
_RUST_NAME = re.compile(r"^[ \t]*pub(?:\([^)]*\))?\s+(?:(?:async|unsafe|extern(?:\s+\"[^\"]*\")?)\s+|const\s+(?=(?:async\s+|unsafe\s+)*fn\b))*(fn|struct|enum|trait|type|const|static|mod)\s+(\w+)", re.M)
_RUST_KINDS = {"fn": "function", "struct": "class", "trait": "interface", "const": "constant", "static": "variable", "mod": "module"}


def rust(text: str) -> tuple[list[Import], list[Export]]:
    code, imports = bare(text), []
    for m in _RUST_USE.finditer(code):
        if m["crate"]:
            target, symbols = m["crate"], []
        elif m["many"] is not None:
            target, symbols = m["path"], list(named(m["many"].replace("{", " ").replace("}", " ")))
        else:
            target = m["path"]
            symbols = [("*", None, False, True)] if m["all"] else [(target.rsplit("::", 1)[-1], m["alias"], False, False)]
        imports.append((target, "rust-use", line_at(code, m.end()), symbols, False, False))
    return imports, [(m[2], _RUST_KINDS.get(m[1], m[1]), line_at(code, m.start(1)), False) for m in _RUST_NAME.finditer(code)]


PARSERS: dict[str, Parser] = {"typescript": script, "javascript": script, "python": python, "java": java, "go": go, "rust": rust}


def register_parser(language: str, parser: Parser | None) -> None:
    """Sets the parser of a language; None takes it away."""
    if parser is None:
        PARSERS.pop(language, None)
    else:
        PARSERS[language] = parser
