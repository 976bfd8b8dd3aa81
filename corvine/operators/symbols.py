"""Symbols of source files: classes, methods and functions with their lines, arguments, docs and calls."""

from __future__ import annotations

import ast
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import decoded
from ..schemas import SYMBOLS

# File types by the extractor that reads them.
PYTHON = (".py", ".pyi", ".pyx")
BRACED = (".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".c", ".h", ".cpp", ".hpp", ".cc", ".cs", ".java", ".kt", ".kts", ".go", ".rs", ".swift", ".dart", ".php", ".lua")
RUBY = (".rb",)

NO_SYMBOLS, BROKEN = "No top-level classes or functions", "Unparseable source"


def _symbol(kind: str, owner: str, name: str, start: int, end: int, args: str = "", is_async: bool = False, docstring: str = "", calls=()) -> dict:
    return {"kind": kind, "owner": owner, "name": name, "start_line": start, "end_line": end, "args": args, "is_async": is_async, "docstring": docstring, "calls": sorted(set(calls))}


class PythonSymbols:
    """Top-level classes with their direct methods, and top-level functions, from the syntax tree."""

    def extract(self, path: str, text: str) -> list[dict]:
        out = []
        for node in ast.parse(text).body:
            if isinstance(node, ast.ClassDef):
                out.append(_symbol("class", "", node.name, node.lineno, node.end_lineno, docstring=ast.get_docstring(node) or ""))
                out += [self._function("method", node.name, m) for m in node.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))]
            elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                out.append(self._function("function", "", node))
        return out

    def _function(self, kind: str, owner: str, node) -> dict:
        called = (c.func for c in ast.walk(node) if isinstance(c, ast.Call))
        names = [f.id if isinstance(f, ast.Name) else f.attr for f in called if isinstance(f, (ast.Name, ast.Attribute))]
        args = ", ".join(a.arg + (f": {ast.unparse(a.annotation)}" if a.annotation else "") for a in node.args.args if a.arg != "self")
        return _symbol(kind, owner, node.name, node.lineno, node.end_lineno, args, isinstance(node, ast.AsyncFunctionDef), ast.get_docstring(node) or "", names)


class BracedSymbols:
    """Declarations of curly-brace languages. Strings and comments are blanked first, so that every brace left is structure."""

    noise = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
    types = re.compile(r"\b(?:class|interface|struct|enum|trait|protocol)[ \t]+([A-Za-z_]\w*)[^;{}()=]*\{")
    named = re.compile(r"\b(?:function\b\s*\*?|fn|func|fun)\s*(?:\([^()]*\)\s*)?([A-Za-z_]\w*)\s*(?:<[^<>()]*>|\[[^\[\]()]*\])?\s*\(([^()]*)\)")
    arrow = re.compile(r"\b(?:const|let|var)\s+([A-Za-z_$]\w*)\s*(?::[^=;]*)?=\s*(?:async\b\s*)?(?:\(([^()]*)\)|([A-Za-z_$]\w*))\s*(?::[^=;{}]*)?=>")
    typed = re.compile(r"(?:(?<=[;{}\n])|\A)[ \t]*((?:[A-Za-z_][\w:<>,.\[\]*&?]*[ \t]+)*)[*&]*([A-Za-z_~]\w*)\s*\(([^(){};]*)\)[^(){};=]*\{")
    called = re.compile(r"\b([A-Za-z_]\w*)\s*\(")
    keywords = frozenset("if for while switch catch return else new do try function fn func fun sizeof match loop defer synchronized using lock".split())

    def extract(self, path: str, text: str) -> list[dict]:
        bare = self.noise.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
        breaks = [i for i, c in enumerate(bare) if c == "\n"]
        closing = self._pairs(bare)
        line = lambda at: bisect_right(breaks, at - 1) + 1

        def body_end(at: int) -> int:
            opening = bare.find("{", at)
            stop = bare.find(";", at)
            return closing.get(opening, at) if opening >= 0 and not 0 <= stop < opening else at

        classes = [(m.start(), body_end(m.end() - 1), m[1]) for m in self.types.finditer(bare)]
        found: dict[int, tuple[str, str, int]] = {}
        for pattern, name, args in ((self.named, (1,), (2,)), (self.arrow, (1,), (2, 3)), (self.typed, (2,), (3,))):
            for m in pattern.finditer(bare):
                at = m.start(name[0])
                if m[name[0]] not in self.keywords and at not in found and not (pattern is self.typed and set(m[1].split()) & self.keywords):
                    found[at] = m[name[0]], " ".join(next((m[i] for i in args if m[i] is not None), "").split()), body_end(m.end() - (pattern is self.typed))
        out = []
        inside = lambda at: next((c for c in reversed(classes) if c[0] < at < c[1]), None)
        functions = []
        for at, (name, args, end) in sorted(found.items()):
            start = bare.rfind("\n", 0, at) + 1
            head = bare[start:at]
            owner = inside(at)
            functions.append((owner, _symbol("method" if owner else "function", owner[2] if owner else "", name, line(at), line(end), args, "async" in head.split() or "async" in bare[at : bare.find("{", at)].split(), "", [c for c in self.called.findall(bare[at + len(name) : end + 1]) if c not in self.keywords])))
        for c in classes:
            out.append(_symbol("class", "", c[2], line(c[0]), line(c[1])))
            out += [f for owner, f in functions if owner is c]
        return out + [f for owner, f in functions if owner is None]

    @staticmethod
    def _pairs(bare: str) -> dict[int, int]:
        """Where each opening brace closes."""
        stack, pairs = [], {}
        for m in re.finditer(r"[{}]", bare):
            if m[0] == "{":
                stack.append(m.start())
            elif stack:
                pairs[stack.pop()] = m.start()
        return pairs


class RubySymbols:
    """Classes, modules and defs, paired with their `end` by a stack of open blocks."""

    opens = re.compile(r"^\s*(def|class|module|do|if|unless|while|until|for|begin|case)\b|\bdo\b\s*(?:\|[^|]*\|)?\s*$|=\s*(?:if|case|begin|unless)\b")
    named = re.compile(r"^\s*(class|module|def)\s+(?:self\.)?([A-Za-z_][\w:]*[?!=]?)\s*(?:\(([^)]*)\))?")
    closes = re.compile(r"^\s*end\b")

    def extract(self, path: str, text: str) -> list[dict]:
        out, stack, owners = [], [], []
        for n, raw in enumerate(text.split("\n"), 1):
            code = re.sub(r"#.*$", "", raw)
            if self.opens.search(code) and not re.search(r"\bend\s*$", code.strip()[3:] if code.strip() != "end" else ""):
                m, symbol = self.named.match(code), None
                if m:
                    kind = "class" if m[1] in ("class", "module") else "method" if owners else "function"
                    symbol = _symbol(kind, owners[-1] if owners and kind == "method" else "", m[2], n, n, m[3] or "")
                    out.append(symbol)
                    if kind == "class":
                        owners.append(m[2])
                stack.append(symbol)
            elif self.closes.match(code) and stack:
                symbol = stack.pop()
                if symbol:
                    symbol["end_line"] = n
                    if symbol["kind"] == "class":
                        owners.pop()
        return out


EXTRACTORS = {**dict.fromkeys(PYTHON, PythonSymbols()), **dict.fromkeys(BRACED, BracedSymbols()), **dict.fromkeys(RUBY, RubySymbols())}
FIELDS = ("kind", "owner", "name", "start_line", "end_line", "args", "is_async", "docstring", "calls")
TYPES = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.list_(pa.string()))


def symbols(files: DataFrame, extractors: dict | None = None) -> DataFrame:
    """From path, ext and content, the symbols of SYMBOLS. A file that can't be parsed has none."""
    known = EXTRACTORS | (extractors or {})

    def run(batches):
        for batch in batches:
            paths, ordinals, rows = [], [], []
            for path, ext, text in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                if ext in known:
                    try:
                        found = known[ext].extract(path, text or "")
                    except (SyntaxError, ValueError, RecursionError):
                        found = []
                    paths += [path] * len(found)
                    ordinals += range(len(found))
                    rows += found
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(ordinals, pa.int32()), *[pa.array([r[f] for r in rows], t) for f, t in zip(FIELDS, TYPES, strict=True)]], names=["path", "ordinal", *FIELDS])

    return files.select("path", "ext", decoded(F.col("content"))).mapInArrow(run, SYMBOLS)


def summaries(files: DataFrame, found: DataFrame) -> DataFrame:
    """path and summary of every file: its classes and its functions by name."""
    def listed(kind: str) -> Column:
        entries = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("ordinal", "name"))))
        return F.transform(entries, lambda s: s["name"])

    lists = found.groupBy("path").agg(listed("class").alias("c"), listed("function").alias("f"))
    part = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{label}: "), F.array_join(c, ", ")))
    text = F.concat_ws(" | ", part("Classes", "c"), part("Functions", "f"))
    return files.select("path").join(lists, "path", "left").select("path", F.when(F.coalesce(F.length(text), F.lit(0)) > 0, text).otherwise(NO_SYMBOLS).alias("summary"))
