"""Functions and methods of source files with their documentation (problem 1).

A packrat parser runs parsing-expression grammars of declarations over the tokens of ``lexing``, one grammar per
language, at the places where a declaration may begin. Every result of a rule at a place is kept, so no token is
parsed twice by the same rule. The semantic action of a declaration joins it with its documentation by source offsets.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from orrery.sources import lexing
from orrery.sources.lexing import STRING, WORD, Source

Rule = Callable[["Packrat", int], int]


class Packrat:
    """One parse: the tokens and the memory of rules. A rule returns the place behind its match, or -1."""

    __slots__ = ("source", "kinds", "values", "size", "memory", "names")

    def __init__(self, source: Source):
        self.source, self.kinds, self.values = source, source.kinds, source.values
        self.size = len(source.kinds)
        self.memory: dict[tuple[int, int], int] = {}
        self.names: dict[int, int] = {}


def rule(body: Rule) -> Rule:
    """A rule whose results are remembered."""
    number = id(body)

    def run(p: Packrat, i: int) -> int:
        key = (number, i)
        found = p.memory.get(key)
        if found is None:
            p.memory[key] = -1
            found = p.memory[key] = body(p, i)
        return found

    return run


def word(*values: str) -> Rule:
    """One of these words."""
    allowed = frozenset(values)
    return lambda p, i: i + 1 if i < p.size and p.kinds[i] == WORD and p.values[i] in allowed else -1


def mark(*values: str) -> Rule:
    """One of these marks of punctuation."""
    allowed = frozenset(values)
    return lambda p, i: i + 1 if i < p.size and p.kinds[i] in allowed else -1


def any_word(p: Packrat, i: int) -> int:
    """Any word."""
    return i + 1 if i < p.size and p.kinds[i] == WORD else -1


def name(p: Packrat, i: int) -> int:
    """A word, remembered as the name of the declaration that is being parsed."""
    if i < p.size and p.kinds[i] == WORD:
        p.names[i] = i
        return i + 1
    return -1


def text(p: Packrat, i: int) -> int:
    """A string."""
    return i + 1 if i < p.size and p.kinds[i] == STRING else -1


def group(opener: str) -> Rule:
    """Brackets with all that is in them."""

    def run(p: Packrat, i: int) -> int:
        if i < p.size and p.kinds[i] == opener:
            end = p.source.partner.get(i)
            return end + 1 if end is not None else -1
        return -1

    return run


def seq(*parts: Rule) -> Rule:
    """All parts in order."""

    def run(p: Packrat, i: int) -> int:
        for part in parts:
            i = part(p, i)
            if i < 0:
                return -1
        return i

    return run


def first(*parts: Rule) -> Rule:
    """The first part that matches."""

    def run(p: Packrat, i: int) -> int:
        for part in parts:
            end = part(p, i)
            if end >= 0:
                return end
        return -1

    return run


def maybe(part: Rule) -> Rule:
    """The part or nothing."""

    def run(p: Packrat, i: int) -> int:
        end = part(p, i)
        return end if end >= 0 else i

    return run


def many(part: Rule) -> Rule:
    """The part as often as it matches."""

    def run(p: Packrat, i: int) -> int:
        while True:
            end = part(p, i)
            if end <= i:
                return i
            i = end

    return run


def ahead(part: Rule) -> Rule:
    """The part must follow, but is not taken."""
    return lambda p, i: i if part(p, i) >= 0 else -1


def absent(part: Rule) -> Rule:
    """The part must not follow."""
    return lambda p, i: i if part(p, i) < 0 else -1


def angles(p: Packrat, i: int) -> int:
    """Angle brackets, which the lexer does not pair."""
    if i >= p.size or p.kinds[i] != "<":
        return -1
    depth = 0
    while i < p.size:
        kind = p.kinds[i]
        if kind == "<":
            depth += 1
        elif kind == ">" and p.kinds[i - 1] != "=>":
            depth -= 1
            if depth == 0:
                return i + 1
        elif kind in ("(", "[", "{"):
            i = p.source.partner.get(i, p.size)
        elif kind in (")", "]", "}", ";"):
            return -1
        i += 1
    return -1


parens, squares, braces = group("("), group("["), group("{")
generic = rule(maybe(angles))
# A type: everything up to what can only follow one.
type_atom = first(parens, squares, braces, angles, any_word, text, mark(".", "|", "&", "?", "*", "=>", "-", "...", "::"), lambda p, i: i + 1 if i < p.size and p.kinds[i] in ("n", "l") else -1)
js_type_atom = first(parens, squares, angles, any_word, text, mark(".", "|", "&"), lambda p, i: i + 1 if i < p.size and p.kinds[i] == "n" else -1)
js_type = rule(first(seq(parens, mark("=>"), many(js_type_atom)), seq(braces, many(js_type_atom)), seq(js_type_atom, many(js_type_atom))))
result = maybe(seq(mark(":"), js_type))
arrow = rule(seq(maybe(word("async")), first(seq(generic, parens, result, mark("=>")), seq(any_word, mark("=>")))))
function_value = rule(seq(maybe(word("async")), word("function"), maybe(mark("*")), maybe(any_word), generic, parens))
exported = maybe(seq(word("export"), maybe(word("default")), maybe(word("declare"))))
js_function = rule(seq(exported, maybe(word("declare")), maybe(word("async")), word("function"), maybe(mark("*")), name, generic, parens))
js_bound = rule(seq(exported, word("const", "let", "var"), name, maybe(mark("!")), result, mark("="), first(arrow, function_value)))
modifier = seq(word("public", "private", "protected", "static", "abstract", "override", "readonly", "async", "accessor", "declare"), absent(mark("(", "=", ":", ";", "?", "<", "}")))
accessor = maybe(seq(word("get", "set"), absent(mark("(", "=", ":", ";", "?", "<"))))
js_method = rule(seq(many(modifier), accessor, maybe(mark("*")), first(name, text, squares), maybe(mark("?")), generic, parens, result, ahead(mark("{", ";"))))
js_field = rule(seq(many(modifier), name, maybe(mark("!", "?")), result, mark("="), first(arrow, function_value)))
go_function = rule(seq(word("func"), maybe(seq(parens, ahead(any_word))), name, maybe(squares), parens))
rust_function = rule(
    seq(maybe(seq(word("pub"), maybe(parens))), many(first(word("default", "const", "async", "unsafe"), seq(word("extern"), maybe(text)))), word("fn"), name, generic, parens)
)
python_function = rule(seq(maybe(word("async")), word("def"), name, maybe(squares), parens))

_JS_START = frozenset("export async function const let var declare".split())
_RUST_START = frozenset("pub fn default const async unsafe extern".split())


class Declaration(NamedTuple):
    """A function with its documentation by offsets and as cleaned text."""

    name: str
    start: int
    start_line: int
    signature: str
    parameters: tuple[str, ...]
    doc: str | None


def declarations(source: Source, documented: bool = False) -> list[Declaration]:
    """All functions and methods of a text, in order; with ``documented`` only those that documentation belongs to, of
    which most places where none stands need not be parsed."""
    return {"python": _python, "go": _go, "rust": _rust}.get(source.language, _js)(source, documented)


def _found(p: Packrat, i: int, end: int, doc: str | None) -> Declaration:
    s = p.source
    own = max((k for k in p.names if i <= k < end), default=None)
    for k in range(i, end):
        if k in p.names:
            own = k
            break
    # The parameters are the last parentheses of the declaration's head.
    parameters: tuple[str, ...] = ()
    for k in range(end - 1, i - 1, -1):
        if s.kinds[k] == ")" and k in s.partner and (own is None or s.partner[k] > own):
            opened = s.partner[k]
            if own is not None and opened == own + 1 or s.kinds[opened - 1] in (">", "]", "=", "function", "async", WORD):
                parameters = tuple(s.values[j] for j in range(opened + 1, k) if s.kinds[j] == WORD)
                break
    head = " ".join(s.text[s.starts[i] : s.end(end - 1)].split())
    return Declaration(s.values[own] if own is not None else "", s.starts[i], s.line(s.starts[i]), head, parameters, doc)


def _js(s: Source, documented: bool) -> list[Declaration]:
    p, out, members = Packrat(s), [], set()
    kinds, values, partner = s.kinds, s.values, s.partner
    for i in _places(values, "class"):
        if kinds[i] == WORD and (i == 0 or kinds[i - 1] not in (".", "?.")):
            k = i + 1
            while k < p.size and kinds[k] not in ("{", ";", ")"):
                k = partner[k] + 1 if kinds[k] in ("(", "[") and k in partner else k + 1
            if k < p.size and kinds[k] == "{" and k in partner:
                members.update(_members(s, k))
    comments = _comments(s)
    # Only what begins a line or a member can have documentation above it.
    for i in sorted(members.union(s.firsts)):
        if i >= p.size:
            break
        member = i in members
        if not member and not (kinds[i] == WORD and values[i] in _JS_START):
            continue
        doc = _above(s, comments, i)
        if documented and doc is None:
            continue
        if member:
            end = js_method(p, i)
            end = end if end >= 0 else js_field(p, i)
            if end >= 0 and values[i] not in ("if", "for", "while", "switch", "return", "catch"):
                out.append(_found(p, i, end, doc))
        else:
            end = js_function(p, i)
            end = end if end >= 0 else js_bound(p, i)
            if end >= 0:
                out.append(_found(p, i, end, doc))
    return out


def _places(values: list[str], value: str) -> list[int]:
    """Where a value stands."""
    out, at = [], -1
    try:
        while True:
            at = values.index(value, at + 1)
            out.append(at)
    except ValueError:
        return out


def _members(s: Source, opened: int) -> list[int]:
    """The tokens at which members of a class begin, behind decorators."""
    out, i, end, start = [], opened + 1, s.partner[opened], True
    while i < end:
        if start and s.kinds[i] == "@":
            i += 2
            while i < end and s.kinds[i] == ".":
                i += 2
            if i < end and s.kinds[i] == "(" and i in s.partner:
                i = s.partner[i] + 1
            continue
        if start and s.kinds[i] != ";":
            out.append(i)
            start = False
        if s.kinds[i] in ("(", "[", "{") and i in s.partner:
            brace = s.kinds[i] == "{"
            i = s.partner[i] + 1
            # A brace ends a member unless its value goes on.
            if brace and i < end and s.kinds[i] not in (";", ",", ".", ")", "=", ":", "|", "&", "?"):
                start = True
            continue
        if s.kinds[i] == ";":
            start = True
        elif i + 1 < end and s.begins[i + 1] and s.kinds[i] not in ("=", "=>", ",", ":", "|", "&", "(", ".") and s.kinds[i + 1] in (WORD, "@", "[", "*"):
            start = True
        i += 1
    return out


def _go(s: Source, documented: bool) -> list[Declaration]:
    p, comments = Packrat(s), _comments(s)
    out = []
    for i in _places(s.values, "func"):
        if s.begins[i] and s.kinds[i] == WORD:
            doc = _above(s, comments, i)
            end = go_function(p, i) if doc is not None or not documented else -1
            if end >= 0:
                out.append(_found(p, i, end, doc))
    return out


def _rust(s: Source, documented: bool) -> list[Declaration]:
    p, comments = Packrat(s), _comments(s)
    out, behind = [], -1
    for i in range(p.size):
        if i <= behind or s.kinds[i] != WORD or s.values[i] not in _RUST_START:
            continue
        if not (s.begins[i] or i == 0 or s.kinds[i - 1] in (";", "{", "}", "]")):
            continue
        doc = _above(s, comments, i)
        if documented and doc is None:
            continue
        end = rust_function(p, i)
        if end >= 0:
            behind = end - 1
            out.append(_found(p, i, end, doc))
    return out


def _python(s: Source, documented: bool) -> list[Declaration]:
    p, out = Packrat(s), []
    for i in _places(s.values, "def"):
        if s.kinds[i] != WORD:
            continue
        if i and s.values[i - 1] == "async" and s.kinds[i - 1] == WORD:
            i -= 1
        end = python_function(p, i)
        if end < 0:
            continue
        k = end
        if k < p.size and s.kinds[k] == "->":
            while k < p.size and s.kinds[k] != ":":
                k = s.partner[k] + 1 if s.kinds[k] in ("(", "[", "{") and k in s.partner else k + 1
        doc = None
        if k < p.size and s.kinds[k] == ":":
            j, parts = k + 1, []
            while j < p.size and s.kinds[j] == STRING and (j == k + 1 or not s.begins[j]):
                parts.append(s.values[j])
                j += 1
            if parts and (j >= p.size or s.begins[j] or s.kinds[j] == ";"):
                doc = _python_text(parts)
        if documented and doc is None:
            continue
        out.append(_found(p, i, end, doc))
    return out


def _python_text(parts: list[str]) -> str | None:
    out = []
    for part in parts:
        quote = min(x for x in (part.find('"'), part.find("'")) if x >= 0)
        prefix, body = part[:quote].lower(), part[quote:]
        if "b" in prefix or "f" in prefix or "t" in prefix:
            return None
        mark_size = 3 if body[:3] in ('"""', "'''") else 1
        body = body[mark_size:-mark_size]
        out.append(body if "r" in prefix else body.replace("\\\n", "").replace("\\n", "\n").replace('\\"', '"').replace("\\'", "'"))
    return "\n".join("".join(out).splitlines())


def _comments(s: Source) -> dict[int, tuple[int, int]]:
    """Comments that stand alone on their lines, by the line they end on; runs of line comments are one comment."""
    out: dict[int, tuple[int, int]] = {}
    text = s.text
    for begin, end in s.comments:
        before = text[text.rfind("\n", 0, begin) + 1 : begin]
        if before.strip():
            continue
        stop = text.find("\n", end)
        if text[end : stop if stop >= 0 else len(text)].strip():
            continue
        line = s.line(begin)
        if text.startswith("//", begin):
            above = out.get(line - 1)
            if above and text.startswith("//", above[0]):
                begin = above[0]
        else:
            line += text.count("\n", begin, end)
        out[line] = (begin, end)
    return out


def _above(s: Source, comments: dict[int, tuple[int, int]], i: int) -> str | None:
    """The documentation of the declaration that begins at token i."""
    line = s.line(s.starts[i]) - 1
    while i > 0 and line not in comments:
        start = _attribute_start(s, i)
        if start is None or s.line(s.end(i - 1) - 1) < line:
            return None
        line, i = s.line(s.starts[start]) - 1, start
    if line not in comments:
        return None
    begin, end = comments[line]
    return strip_comment(s.text[begin:end])


def _attribute_start(s: Source, i: int) -> int | None:
    """Where the attribute or decorator right before token i begins."""
    k = i - 1
    if s.language == "rust":
        if s.kinds[k] == "]" and k in s.partner and s.partner[k] > 0 and s.kinds[s.partner[k] - 1] == "#":
            return s.partner[k] - 1
        return None
    if s.language == "go":
        return None
    if s.kinds[k] == ")" and k in s.partner:
        k = s.partner[k] - 1
    while k > 1 and s.kinds[k] == WORD and s.kinds[k - 1] == ".":
        k -= 2
    return k - 1 if k > 0 and s.kinds[k] == WORD and s.kinds[k - 1] == "@" else None


def strip_comment(comment: str) -> str:
    """The text of a comment without its marks."""
    if comment.startswith("/*"):
        body = re.sub(r"^/\*+!?|\*+/$", "", comment)
        return "\n".join(re.sub(r"^[ \t]*\*(?!\*)[ \t]?", "", x).rstrip() for x in body.splitlines()).strip()
    return "\n".join(re.sub(r"^[ \t]*//[/!]*[ \t]?", "", x).rstrip() for x in comment.splitlines()).strip()
