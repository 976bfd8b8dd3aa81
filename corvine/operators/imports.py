"""What source files import, by the grammar of each language's own import forms.

A file is cut into tokens first: words, strings and marks, without comments. So what looks like an
import in a comment or a string is none, and an import may run over several lines.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

#: Comments, strings, words and single marks. `hash_comments`: # starts a comment.
_MARKS = r"""(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|(?P<word>[^\W\d][\w$]*)|(?P<end>\n)|(?P<mark>::|[^\s\w])"""
_SLASHED = re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|" + _MARKS)
_HASHED = re.compile(r"#[^\n]*|" + _MARKS)

Token = tuple[str, str]


def tokens(text: str, pattern: re.Pattern = _SLASHED) -> list[Token]:
    """(kind, text) of strings (without quotes), words, marks and line ends."""
    out = []
    for m in pattern.finditer(text):
        if m.lastgroup:
            out.append((m.lastgroup, m[0][1:-1] if m.lastgroup == "string" else m[0]))
    return out


def _solid(found: list[Token]) -> list[Token]:
    return [t for t in found if t[0] != "end"]


def _script(text: str) -> Iterator[str]:
    """import ... from "x", export ... from "x", import "x", import("x") and require("x")."""
    found = _solid(tokens(text))
    for i, (kind, name) in enumerate(found):
        if kind != "word" or (i and found[i - 1] == ("mark", ".")):
            continue
        after = found[i + 1 : i + 3]
        if name in ("import", "require") and len(after) == 2 and after[0] == ("mark", "(") and after[1][0] == "string":
            yield after[1][1]
        elif name == "import" and after and after[0][0] == "string":
            yield after[0][1]
        elif name == "from" and after and after[0][0] == "string" and i and (found[i - 1][0] == "word" or found[i - 1][1] in "}*"):
            yield after[0][1]


def _java(text: str) -> Iterator[str]:
    """import a.b.C; import static a.b.C.f; import a.b.*; the last names the package."""
    found = _solid(tokens(text))
    for i, t in enumerate(found):
        if t != ("word", "import") or (i and found[i - 1][1] not in (";", "}")):
            continue
        name, j = [], i + 1
        while j < len(found) and found[j] != ("mark", ";") and (found[j][0] == "word" or found[j][1] in ".*"):
            name.append(found[j][1] if found[j] != ("word", "static") else "")
            j += 1
        if name := re.sub(r"\.\*$", "", "".join(name)):
            yield name


def _go(text: str) -> Iterator[str]:
    """import "x", import name "x", and groups of these in brackets."""
    found = _solid(tokens(text))
    i = 0
    while i < len(found):
        if found[i] == ("word", "import"):
            grouped = found[i + 1 : i + 2] == [("mark", "(")]
            i += 1 + grouped
            while i < len(found) and found[i] != ("mark", ")"):
                if found[i][0] == "string":
                    yield found[i][1]
                    if not grouped:
                        break
                elif found[i][0] == "word" or found[i][1] in "._;":
                    if not grouped and found[i][0] == "word" and found[i][1] in ("func", "type", "var", "const"):
                        break
                else:
                    break
                i += 1
        i += 1


def _rust(text: str) -> Iterator[str]:
    """mod a; and all leaves of use trees: use a::{b, c::d}, use a::b as c, use a::*. Parts are joined by dots."""
    found = _solid(tokens(text))

    def tree(i: int, before: list[str]) -> tuple[list[str], int]:
        """Leaves of the tree at i, and where it ends."""
        name, leaves = list(before), []
        while i < len(found):
            kind, t = found[i]
            if t == "{":
                i += 1
                while i < len(found) and found[i][1] != "}":
                    more, i = tree(i, name)
                    leaves += more
                    i += i < len(found) and found[i][1] == ","
                return leaves, i + 1
            if t == "as":
                i += 2
            elif kind == "word":
                if t != "self" or not name:
                    name.append(t)
                i += 1
            elif t in ("::", "*"):
                i += 1
            else:
                break
        return [".".join(name)] if name else [], i

    for i, t in enumerate(found):
        if i and found[i - 1][1] not in (";", "}", "{", ")", "]", "pub"):
            continue
        if t == ("word", "use"):
            yield from tree(i + 1, [])[0]
        elif t == ("word", "mod") and i + 2 < len(found) and found[i + 2][1] in (";", "{"):
            if found[i + 2][1] == ";":
                yield found[i + 1][1]


def _ruby(text: str) -> Iterator[str]:
    """require "x", require_relative "x" and load "x", with or without brackets."""
    found = tokens(text, _HASHED)
    for i, t in enumerate(found):
        if t[0] == "word" and t[1] in ("require", "require_relative", "load") and (not i or found[i - 1][1] not in (".", "def")):
            after = [x for x in found[i + 1 : i + 3] if x != ("mark", "(")]
            if after and after[0][0] == "string":
                yield after[0][1]


def _c(text: str) -> Iterator[str]:
    """#include "x" and #include <x>, alone on their lines; using x; of C#."""
    bare = re.sub(r"/\*[\s\S]*?(?:\*/|\Z)", lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    for line in bare.split("\n"):
        line = line.strip()
        if line.startswith("#"):
            directive, _, rest = line[1:].strip().partition("include")
            rest = rest.strip()
            closing = {'"': '"', "<": ">"}.get(rest[:1])
            if not directive and closing and closing in rest[1:]:
                yield rest[1 : rest.index(closing, 1)]


def _python(text: str) -> Iterator[str]:
    """Modules of import and from ... import, in order; of a file that can't be parsed, those of lines that can."""
    try:
        body = [ast.parse(text)]
    except (SyntaxError, ValueError, RecursionError):
        body = []
        for line in text.split("\n"):
            if line.split()[:1] in (["import"], ["from"]):
                try:
                    body.append(ast.parse(line.strip()))
                except (SyntaxError, ValueError):
                    continue
    for part in body:
        nodes = [n for n in ast.walk(part) if isinstance(n, (ast.Import, ast.ImportFrom))]
        for n in sorted(nodes, key=lambda n: (n.lineno, n.col_offset)):
            if isinstance(n, ast.Import):
                yield from (a.name for a in n.names)
            elif n.module:
                yield n.module


# File types by the language whose import forms they have.
LANGUAGES = {
    "python": ((".py", ".pyi", ".pyx"), _python),
    "js": ((".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs"), _script),
    "java": ((".java",), _java),
    "go": ((".go",), _go),
    "rust": ((".rs",), _rust),
    "ruby": ((".rb",), _ruby),
    "c": ((".c", ".h", ".cpp", ".hpp", ".cc", ".cs"), _c),
}
BY_SUFFIX = {ext: (lang, find) for lang, (extensions, find) in LANGUAGES.items() for ext in extensions}


def imported(ext: str, text: str) -> tuple[str, list[str]]:
    """The language, and its import strings in file order, each once."""
    lang, find = BY_SUFFIX[ext]
    return lang, list(dict.fromkeys(x for x in find(text) if x))
