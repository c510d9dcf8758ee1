"""Parsing source files to symbols, edges and inheritance, as nested rows that explode into three tables.

Python files go through the interpreter's own syntax tree, the other languages through the lexers of this package: a
pass over the tokens keeps the stack of open bodies, so that symbols know what they are in and calls whose they are.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.sources import lexing
from orrery.sources.lexing import STRING, WORD, Source

PARSED = (
    "path string, language string, symbols array<struct<id:string,kind:string,range_start_line:int,range_end_line:int,signature:string,docstring:string>>,"
    " edges array<struct<from_id:string,to_name:string,to_path:string,kind:string>>, inheritance array<struct<class_id:string,base_name:string,base_path:string>>, warnings array<string>"
)
#: Words that look like calls but are none.
_NO_CALL = frozenset("if for while switch catch return function func fn match loop else typeof new await super with case def class import require go defer select make async".split())


class _Result:
    def __init__(self, path: str):
        self.path = path
        self.symbols: list[tuple] = [(path, "module", 1, 1, None, None)]
        self.edges: list[tuple] = []
        self.bases: list[tuple] = []
        self.warnings: list[str] = []
        self.seen: set[tuple] = set()

    def imported(self, name: str, module: str, line: int, text: str, relative: str | None = None) -> None:
        """An import edge and a module symbol named by the last part of the module."""
        self.edges.append((self.path, name, relative, "imports"))
        last = [x for x in re.split(r"[/.:{}, ]+", module) if x]
        if last and (self.path, last[-1]) not in self.seen:
            self.seen.add((self.path, last[-1]))
            self.symbols.append((f"{self.path}::{last[-1]}", "module", line, line, text, None))

    def symbol(self, owner: str, name: str, kind: str, first: int, last: int, signature: str | None, doc: str | None) -> str:
        ident = f"{owner}::{name}"
        self.symbols.append((ident, kind, first, last, signature, doc))
        return ident


def parse_text(path: str, text: str, language: str) -> _Result:
    """Symbols, edges and bases of one file. Never raises: what cannot be parsed is told in the warnings."""
    out = _Result(path)
    text = lexing.without_mark(text)
    try:
        if language == "python":
            _python(out, text)
        else:
            source = lexing.scan(text, language, path.endswith("x"))
            if source.fault:
                out.warnings.append(f"{source.fault[1]} at line {source.line(source.fault[0])}")
            {"go": _go, "rust": _rust}.get(language, _script)(out, source)
    except (SyntaxError, ValueError, RecursionError, IndexError) as e:
        out.warnings.append(f"partial parse: {str(e)[:120]}")
    return out


def _python(out: _Result, text: str) -> None:
    tree = ast.parse(text)
    lines = text.split("\n")

    def calls(body: list, owner: str) -> None:
        todo = list(body)
        while todo:
            node = todo.pop()
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                continue
            if isinstance(node, ast.Call):
                f = node.func
                name = f.attr if isinstance(f, ast.Attribute) else f.id if isinstance(f, ast.Name) else None
                if name:
                    out.edges.append((owner, name, None, "calls"))
            todo.extend(ast.iter_child_nodes(node))

    def walk(body: list, owner: str, in_class: bool) -> None:
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                ident = out.symbol(owner, node.name, "method" if in_class else "function", node.lineno, node.end_lineno, lines[node.lineno - 1].strip(), ast.get_docstring(node))
                calls(node.body, ident)
                walk(node.body, ident, False)
            elif isinstance(node, ast.ClassDef):
                ident = out.symbol(owner, node.name, "class", node.lineno, node.end_lineno, lines[node.lineno - 1].strip(), ast.get_docstring(node))
                for base in node.bases:
                    name = ast.unparse(base)
                    out.bases.append((ident, name, None))
                    out.edges.append((ident, name, None, "extends"))
                walk(node.body, ident, True)
            elif isinstance(node, ast.Import):
                for a in node.names:
                    out.imported(a.name, a.name, node.lineno, lines[node.lineno - 1].strip())
            elif isinstance(node, ast.ImportFrom):
                module = "." * node.level + (node.module or "")
                for a in node.names:
                    name = f"{module}.{a.name}" if module and not module.endswith(".") else module + a.name
                    out.imported(name, module.strip(".") or a.name, node.lineno, lines[node.lineno - 1].strip(), module if module.startswith(".") else None)
            elif isinstance(node, (ast.If, ast.Try, ast.With, ast.For, ast.While)):
                for part in ("body", "orelse", "finalbody"):
                    walk(getattr(node, part, []) or [], owner, in_class)
                for handler in getattr(node, "handlers", []) or []:
                    walk(handler.body, owner, in_class)

    walk(tree.body, out.path, False)


def _line_of(s: Source, i: int) -> str:
    start = s.text.rfind("\n", 0, s.starts[i]) + 1
    end = s.text.find("\n", start)
    return s.text[start : end if end >= 0 else len(s.text)].strip()


def _doc_above(s: Source, i: int) -> str | None:
    """The comments that end on the line above token i."""
    line, parts = s.line(s.starts[i]) - 1, []
    for begin, end in reversed(s.comments):
        if end > s.starts[i] or s.line(end - 1) > line:
            continue
        if s.line(end - 1) < line:
            break
        parts.append(re.sub(r"^/\*+|\*/$|^\s*\*(?!/) ?|^//[/!]? ?", "", s.text[begin:end], flags=re.M).strip())
        line = s.line(begin) - 1
    return "\n".join(reversed(parts)) or None


def _over(s: Source, k: int) -> int:
    """Behind token k, or behind the brackets it opens."""
    end = s.partner.get(k, k)
    return (end if end > k else k) + 1


def _close(s: Source, i: int, limit: int) -> int:
    """The brace body that begins at or behind token i: its closing token, else i."""
    k = i
    while k < limit and s.kinds[k] not in ("{", ";"):
        k = _over(s, k) if s.kinds[k] in ("(", "[") else k + 1
    return s.partner.get(k, i) if k < limit and s.kinds[k] == "{" else i


def _calls(out: _Result, s: Source, spans: list[tuple[int, int, str]]) -> None:
    """Calls within bodies belong to the innermost one; calls outside of bodies to none."""
    spans.sort(key=lambda x: (x[0], -x[1]))
    stack: list[tuple[int, int, str]] = []
    at = 0
    for i in range(len(s.kinds)):
        while stack and i > stack[-1][1]:
            stack.pop()
        while at < len(spans) and spans[at][0] <= i:
            if spans[at][1] >= i:
                stack.append(spans[at])
            at += 1
        if stack and s.kinds[i] == "(" and i and s.kinds[i - 1] == WORD and i - 1 > stack[-1][0] and s.values[i - 1] not in _NO_CALL:
            if i > 1 and s.values[i - 2] in ("function", "func", "fn", "def"):
                continue
            out.edges.append((stack[-1][2], s.values[i - 1], None, "calls"))


def _script(out: _Result, s: Source) -> None:
    """JavaScript and TypeScript."""
    n, kinds, values, ts = len(s.kinds), s.kinds, s.values, s.language == "typescript"
    spans: list[tuple[int, int, str]] = []
    owners: list[tuple[int, str]] = []
    members: dict[int, str] = {}
    for i in range(n):
        while owners and i > owners[-1][0]:
            owners.pop()
        owner = owners[-1][1] if owners else out.path
        if kinds[i] != WORD or i and kinds[i - 1] in (".", "?."):
            continue
        word, after = values[i], values[i + 1] if i + 1 < n else ""
        line = s.line(s.starts[i])
        if i in members and kinds[i + 1 : i + 2] in (["("], ["<"]):
            end = _close(s, i + 1, n)
            if end > i:
                ident = out.symbol(members[i], word, "method", line, s.line(s.starts[end]), _line_of(s, i), _doc_above(s, i))
                spans.append((i, end, ident))
                owners.append((end, ident))
        elif word == "function" and i + 1 < n and (kinds[i + 1] == WORD or after == "*" and kinds[i + 2 : i + 3] == [WORD]):
            at = i + 1 if kinds[i + 1] == WORD else i + 2
            end = _close(s, at, n)
            ident = out.symbol(owner, values[at], "function", line, s.line(s.starts[end]), _line_of(s, i), _doc_above(s, _first(s, i)))
            spans.append((at, end, ident))
            owners.append((end, ident))
        elif word == "class" and i + 1 < n and kinds[i + 1] == WORD and after not in ("extends", "implements"):
            end = _close(s, i + 1, n)
            ident = out.symbol(owner, after, "class", line, s.line(s.starts[end]), _line_of(s, i), _doc_above(s, _first(s, i)))
            opened = s.partner.get(end, i)
            _heritage(out, s, ident, i + 2, opened, ts)
            for m in _member_names(s, opened, end):
                members[m] = ident
            owners.append((end, ident))
        elif ts and word in ("namespace", "module") and kinds[i + 1 : i + 3] == [WORD, "{"]:
            end = _close(s, i + 1, n)
            ident = out.symbol(owner, after, "module", line, s.line(s.starts[end]), _line_of(s, i), _doc_above(s, _first(s, i)))
            owners.append((end, ident))
        elif ts and word in ("interface", "enum", "type") and i + 1 < n and kinds[i + 1] == WORD and not s.begins[i + 1] and kinds[i + 2 : i + 3] in (["{"], ["="], ["<"], [WORD]):
            end = _close(s, i + 1, n)
            out.symbol(owner, after, "interface" if word == "interface" else "type", line, s.line(s.starts[end]), _line_of(s, i), _doc_above(s, _first(s, i)))
            if word == "interface":
                _heritage(out, s, f"{owner}::{after}", i + 2, s.partner.get(end, i), ts)
        elif word in ("const", "let", "var") and i + 3 < n and kinds[i + 1] == WORD:
            k = i + 2
            while k < n and kinds[k] not in ("=", ";") and not (s.begins[k] and kinds[k] == WORD):
                k = _over(s, k)
            if k < n and kinds[k] == "=" and _is_function(s, k + 1):
                end = _close(s, k + 1, n)
                end = end if end > k + 1 else k + 1
                ident = out.symbol(owner, after, "function", line, s.line(s.starts[end]), _line_of(s, i), _doc_above(s, _first(s, i)))
                spans.append((i + 1, end, ident))
                owners.append((end, ident))
        elif word == "import" and s.begins[i]:
            k = i + 1
            while k < n and kinds[k] != STRING and kinds[k] != ";":
                k += 1
            if k < n and kinds[k] == STRING:
                module = values[k][1:-1]
                out.imported(module, module, line, _line_of(s, i), module if module.startswith(".") else None)
        elif word == "require" and not ts and kinds[i + 1 : i + 3] == ["(", STRING]:
            module = values[i + 2][1:-1]
            out.imported(module, module, line, _line_of(s, i), module if module.startswith(".") else None)
    _calls(out, s, spans)


def _first(s: Source, i: int) -> int:
    """The first token of the line's statement that token i is in, such as its export."""
    while i > 0 and not s.begins[i]:
        i -= 1
    return i


def _is_function(s: Source, i: int) -> bool:
    if i < len(s.kinds) and s.values[i] == "async":
        i += 1
    if i >= len(s.kinds):
        return False
    if s.values[i] == "function":
        return True
    if s.kinds[i] == WORD:
        return s.kinds[i + 1 : i + 2] == ["=>"]
    if s.kinds[i] == "(" and i in s.partner:
        k = s.partner[i] + 1
        while k < len(s.kinds) and s.kinds[k] not in ("=>", ";", "{", "=") and not s.begins[k]:
            k += 1
        return k < len(s.kinds) and s.kinds[k] == "=>"
    return False


def _member_names(s: Source, opened: int, end: int) -> Iterator[int]:
    """Names before a parenthesis directly in a class body."""
    i = opened + 1
    while i < end:
        if s.kinds[i] in ("(", "[", "{") and i in s.partner:
            if s.kinds[i] == "(" and s.kinds[i - 1] == WORD and (i < 2 or s.kinds[i - 2] not in ("=", ".", "@", "=>")):
                yield i - 1
            i = s.partner[i]
        i += 1


def _heritage(out: _Result, s: Source, ident: str, i: int, end: int, ts: bool) -> None:
    kind, name = None, ""
    depth = 0
    for k in range(i, end + 1):
        v = s.values[k]
        if s.kinds[k] == "<":
            depth += 1
        if v in ("extends", "implements") and not depth or k == end or s.kinds[k] == "," and not depth:
            if kind and name:
                out.bases.append((ident, name, None))
                out.edges.append((ident, name, None, kind))
            name = ""
            kind = (v if ts else "extends") if v in ("extends", "implements") else kind
        elif kind:
            name += v
        if s.kinds[k] == ">":
            depth -= 1


def _go(out: _Result, s: Source) -> None:
    n, kinds, values = len(s.kinds), s.kinds, s.values
    spans: list[tuple[int, int, str]] = []
    for i in range(n):
        if kinds[i] != WORD or not s.begins[i]:
            continue
        if values[i] == "func":
            at, owner = i + 1, out.path
            if kinds[at : at + 1] == ["("] and at in s.partner:
                inside = [values[k] for k in range(at + 1, s.partner[at]) if kinds[k] == WORD]
                owner, at = f"{out.path}::{inside[-1]}" if inside else out.path, s.partner[at] + 1
            if kinds[at : at + 1] == [WORD]:
                end = _close(s, at, n)
                ident = out.symbol(owner, values[at], "method" if owner != out.path else "function", s.line(s.starts[i]), s.line(s.starts[end]), _line_of(s, i), _doc_above(s, i))
                spans.append((at, end, ident))
        elif values[i] == "type" and kinds[i + 1 : i + 2] == [WORD]:
            end = _close(s, i + 1, n)
            out.symbol(out.path, values[i + 1], "interface" if values[i + 2 : i + 3] == ["interface"] else "type", s.line(s.starts[i]), s.line(s.starts[end]), _line_of(s, i), _doc_above(s, i))
        elif values[i] == "import":
            k = i + 1
            last = s.partner.get(k, k + 1)
            for j in range(k, min(n, last + 1)):
                if kinds[j] == STRING:
                    out.imported(values[j][1:-1], values[j][1:-1], s.line(s.starts[j]), _line_of(s, j))
    _calls(out, s, spans)


def _rust(out: _Result, s: Source) -> None:
    n, kinds, values = len(s.kinds), s.kinds, s.values
    spans: list[tuple[int, int, str]] = []
    owners: list[tuple[int, str, str]] = []
    for i in range(n):
        while owners and i > owners[-1][0]:
            owners.pop()
        owner, inside = (owners[-1][1], owners[-1][2]) if owners else (out.path, "")
        if kinds[i] != WORD:
            continue
        word, line = values[i], s.line(s.starts[i])
        if word == "fn" and kinds[i + 1 : i + 2] == [WORD]:
            end = _close(s, i + 1, n)
            ident = out.symbol(owner, values[i + 1], "method" if inside == "impl" else "function", line, s.line(s.starts[end]), _line_of(s, i), _doc_above(s, _first(s, i)))
            spans.append((i + 1, end, ident))
            owners.append((end, ident, "fn"))
        elif word in ("struct", "enum", "trait", "type") and kinds[i + 1 : i + 2] == [WORD] and kinds[i - 1 : i] != ["."]:
            end = _close(s, i + 1, n)
            ident = out.symbol(owner, values[i + 1], "interface" if word == "trait" else "type", line, s.line(s.starts[end]), _line_of(s, i), _doc_above(s, _first(s, i)))
            if word == "trait":
                owners.append((end, ident, "impl"))
        elif word == "mod" and kinds[i + 1 : i + 3] == [WORD, "{"]:
            end = _close(s, i + 1, n)
            owners.append((end, out.symbol(owner, values[i + 1], "module", line, s.line(s.starts[end]), _line_of(s, i), _doc_above(s, _first(s, i))), "mod"))
        elif word == "impl" and (s.begins[i] or kinds[i - 1] in ("}", ";", "]")):
            end = _close(s, i + 1, n)
            names, depth = [[]], 0
            for k in range(i + 1, s.partner.get(end, i + 1)):
                depth += (kinds[k] == "<") - (kinds[k] == ">")
                if values[k] == "for" and not depth:
                    names.append([])
                elif kinds[k] == WORD and not depth and values[k] != "where":
                    names[-1].append(values[k])
            last = [x[-1] for x in names if x]
            if len(last) == 2:
                ident = out.symbol(owner, f"impl_{last[0]}_for_{last[1]}", "type", line, s.line(s.starts[end]), _line_of(s, i), None)
                out.edges.append((ident, last[0], None, "implements"))
                out.bases.append((ident, last[0], None))
                owners.append((end, ident, "impl"))
            elif last:
                owners.append((end, f"{owner}::{last[0]}", "impl"))
        elif word == "use" and (s.begins[i] or values[i - 1] == "pub"):
            k = i + 1
            while k < n and kinds[k] != ";":
                k += 1
            module = "".join(values[i + 1 : k])
            out.imported(module, module, line, _line_of(s, i))
    _calls(out, s, spans)


def parse(files: DataFrame) -> DataFrame:
    """One nested row per file: ``path, language, symbols, edges, inheritance, warnings``.

    ``files``: ``path, language, text``; rows without a path, text or a known language are left out. Each file is parsed
    whole in one task; nothing is shuffled.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, language, text in zip(batch["path"], batch["language"], batch["text"]):
                r = parse_text(path, text, language)
                rows.append((path, language, [dict(zip(("id", "kind", "range_start_line", "range_end_line", "signature", "docstring"), x)) for x in r.symbols],
                             [dict(zip(("from_id", "to_name", "to_path", "kind"), x)) for x in r.edges], [dict(zip(("class_id", "base_name", "base_path"), x)) for x in r.bases], r.warnings))
            yield pd.DataFrame(rows, columns=["path", "language", "symbols", "edges", "inheritance", "warnings"])

    rows = files.select("path", "language", "text").filter("path is not null and text is not null").filter(F.col("language").isin("python", "javascript", "typescript", "go", "rust"))
    return rows.mapInPandas(run, PARSED)


def tables_of(parsed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Symbols, parser edges and inheritance of parsed files; a repeated id keeps its first lines."""
    symbols = parsed.select("path", "language", F.explode("symbols").alias("x")).select("x.id", "path", "language", "x.kind", "x.range_start_line", "x.range_end_line", "x.signature", "x.docstring")
    edges = parsed.select(F.explode("edges").alias("x")).select("x.*")
    bases = parsed.select(F.explode("inheritance").alias("x")).select("x.*").distinct()
    return symbols, edges, bases
