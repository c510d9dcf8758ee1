"""The pushdown pass over the tokens of Python source: blocks on a stack of indents, brackets on a stack of frames.

Logical lines come from the lexer. Each is read as one statement (or several, parted by semicolons); what stands between
keywords is read by one loop that knows whether a value has just ended, with one frame per open bracket.
"""

from __future__ import annotations

import re

from orrery.sources import lexing
from orrery.sources.lexing import NUMBER, STRING, WORD, Source

Fault = tuple[int, str]

_KEYWORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
_CONSTANTS = frozenset(("True", "False", "None"))
#: Keywords that an expression may hold, apart from the constants.
_EXPRESSION = frozenset("and or not in is if else for async lambda await yield".split())
_BINARY = frozenset("/ // % & | ^ << >> == != < > <= >= @".split())
#: Operators whose right side cannot begin with ``not``.
_TIGHTER = _BINARY | frozenset(("+", "-", "**", "~"))
_AUGMENTED = frozenset("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split())
_COMPOUND = frozenset("if elif else while for with try except finally def class async".split())
#: What may stand directly over these headers at the same indent.
_FOLLOWS = {"elif": ("if", "elif"), "else": ("if", "elif", "for", "while", "except", "try"), "except": ("try", "except"), "finally": ("try", "except", "else")}
_ESCAPE = re.compile(r"\\(?:x(?![\da-fA-F]{2})|u(?![\da-fA-F]{4})|U(?!(?:000\d|0010|00[0-9])[\da-fA-F]{4})|N(?!\{[^{}]+\}))")
_BYTE_ESCAPE = re.compile(r"\\x(?![\da-fA-F]{2})")
_LEADING_ZERO = re.compile(r"0[\d_]*[1-9][\d_]*\Z|.*(?:__|_\Z|_[.eEjJ])|0[xXoObB]_?\Z")
_PLAIN_FIELD = re.compile(r"\s*[^\W\d]\w*(?:\.[^\W\d]\w*)*\s*(?:![rsa])?\s*\Z")


class _Wrong(Exception):
    """The first thing that is not valid: the number of its token and the reason."""


class _Frame:
    """An open bracket: its kind, and what its current element has had so far."""

    __slots__ = ("kind", "opened", "terns", "fors", "pair", "colons", "keyed", "starred", "had_keyed", "had_double")

    def __init__(self, kind: str, opened: int):
        self.kind, self.opened = kind, opened
        self.terns = self.fors = self.colons = 0
        self.pair = self.keyed = self.starred = self.had_keyed = self.had_double = False


def fault_of(source: Source) -> Fault | None:
    """Offset and reason of the first thing found that is not valid, or None."""
    if source.fault:
        return source.fault
    try:
        _Reader(source).run()
    except _Wrong as wrong:
        at, why = wrong.args
        return (source.starts[at] if at < len(source.starts) else len(source.text)), why
    return None


class _Reader:
    def __init__(self, source: Source):
        self.s, self.kinds, self.values, self.partner = source, source.kinds, source.values, source.partner
        self.n = len(source.kinds)

    def run(self) -> None:
        s, text = self.s, self.s.text
        firsts = [i for i in s.firsts if i < self.n]
        if self.n and not firsts:
            firsts = [0]
        # Blocks: widths of the indent with wide and with narrow tabs, the header that opened it, the last header read in it.
        blocks: list[list] = [[0, 0, "", ""]]
        waits = ""
        head = -1
        for k, a in enumerate(firsts):
            b = firsts[k + 1] if k + 1 < len(firsts) else self.n
            begin = s.starts[a]
            left = text[text.rfind("\n", 0, begin) + 1 : begin]
            if "\f" in left:
                left = left[left.rfind("\f") + 1 :]
            if "\t" in left:
                wide = narrow = 0
                for c in left:
                    wide, narrow = (wide // 8 + 1) * 8 if c == "\t" else wide + 1, narrow + 1
            else:
                wide = narrow = len(left)
            top = blocks[-1]
            if waits:
                if wide <= top[0]:
                    raise _Wrong(a, "block expected")
                blocks.append([wide, narrow, waits, ""])
            elif wide > top[0]:
                raise _Wrong(a, "unexpected indent")
            else:
                while wide < blocks[-1][0]:
                    self._closed(blocks.pop(), a)
                if wide != blocks[-1][0]:
                    raise _Wrong(a, "indent of no block")
            top = blocks[-1]
            if narrow != top[1]:
                raise _Wrong(a, "tabs and blanks mixed")
            word = self.values[a] if self.kinds[a] == WORD else ""
            before = top[3]
            if word in _FOLLOWS and before not in _FOLLOWS[word]:
                raise _Wrong(a, f"{word} without its statement")
            if before == "try" and word not in ("except", "finally"):
                raise _Wrong(a, "try without except or finally")
            if before == "@" and self.kinds[a] != "@" and word not in ("def", "class") and not (word == "async" and a + 1 < b and self.values[a + 1] == "def"):
                raise _Wrong(a, "decorator of nothing")
            if top[2] == "match" and word != "case":
                raise _Wrong(a, "case expected")
            header, open_block = self.line(a, b, top[2] == "match")
            # The else of a try may only be followed by finally; that of others ends the statement.
            top[3] = ("else" if before == "except" else "") if header == "else" else header
            waits = header if open_block else ""
            head = a
        if waits:
            raise _Wrong(self.n, "block expected")
        for block in reversed(blocks):
            self._closed(block, self.n if head >= 0 else 0)

    @staticmethod
    def _closed(block: list, at: int) -> None:
        if block[3] == "try":
            raise _Wrong(at, "try without except or finally")
        if block[3] == "@":
            raise _Wrong(at, "decorator of nothing")

    # Statements.

    def line(self, a: int, b: int, cases: bool) -> tuple[str, bool]:
        """Reads a logical line; the header's word ("" for simple statements) and whether a block must follow."""
        kinds, values = self.kinds, self.values
        word = values[a] if kinds[a] == WORD else ""
        if kinds[a] == "@":
            self.expression(a + 1, b, named=True)
            return "@", False
        if word in _COMPOUND:
            colon = self.colon(a, b)
            if colon < 0:
                raise _Wrong(a, "header without a colon")
            self.header(word, a, colon)
            if word == "async":
                word = values[a + 1]
        elif cases or word == "match" and kinds[b - 1] == ":" and b - a > 2 and (kinds[a + 1] in (WORD, STRING, NUMBER, "(", "[", "{", "-", "*") and not (kinds[a + 1] == WORD and values[a + 1] in ("in", "is", "and", "or", "if", "not"))) and self.colon(a, b) == b - 1:
            colon = self.colon(a, b)
            if colon < 0:
                raise _Wrong(a, "header without a colon")
            if cases:
                self.pattern(a + 1, colon)
            else:
                self.expression(a + 1, colon, tuples=True, stars=True)
        else:
            self.simple(a, b)
            return "", False
        if colon + 1 >= b:
            return word, True
        self.simple(colon + 1, b)
        return word, False

    def colon(self, a: int, b: int) -> int:
        """The colon that ends the header, or -1."""
        kinds, lambdas, i = self.kinds, 0, a
        while i < b:
            kind = kinds[i]
            if kind == ":":
                if not lambdas:
                    return i
                lambdas -= 1
            elif kind == WORD:
                if self.values[i] == "lambda":
                    lambdas += 1
            elif kind in "([{" and kind:
                i = self.partner.get(i, b)
            i += 1
        return -1

    def header(self, word: str, a: int, colon: int) -> None:
        kinds, values = self.kinds, self.values
        if word in ("if", "elif", "while"):
            self.expression(a + 1, colon, named=True)
        elif word in ("else", "try", "finally"):
            if colon != a + 1:
                raise _Wrong(a + 1, "colon expected")
        elif word == "for":
            at = self.find(a + 1, colon, "in")
            self.targets(a + 1, at)
            self.expression(at + 1, colon, tuples=True, stars=True)
        elif word == "with":
            self.with_items(a + 1, colon)
        elif word == "except":
            i = a + 1
            if i < colon and kinds[i] == "*":
                i += 1
                if i == colon:
                    raise _Wrong(i, "exception expected")
            if i < colon:
                end = colon
                if colon - i > 2 and kinds[colon - 2] == WORD and values[colon - 2] == "as":
                    self.name(colon - 1)
                    end = colon - 2
                self.expression(i, end)
        elif word == "def":
            self.name(a + 1)
            i = self.type_parameters(a + 2)
            if i >= colon or kinds[i] != "(":
                raise _Wrong(i, "parameters expected")
            end = self.partner.get(i, colon)
            self.parameters(i + 1, end, True)
            if end + 1 != colon:
                if kinds[end + 1] != "->":
                    raise _Wrong(end + 1, "colon expected")
                self.expression(end + 2, colon)
        elif word == "class":
            self.name(a + 1)
            i = self.type_parameters(a + 2)
            if i < colon and kinds[i] == "(":
                end = self.partner.get(i, colon)
                if end > i + 1:
                    self.expression(i, end + 1, call=True)
                i = end + 1
            if i != colon:
                raise _Wrong(i, "colon expected")
        elif word == "async":
            if values[a + 1] not in ("def", "for", "with") or kinds[a + 1] != WORD:
                raise _Wrong(a + 1, "async of no statement")
            self.header(values[a + 1], a + 1, colon)

    def type_parameters(self, i: int) -> int:
        if i < self.n and self.kinds[i] == "[":
            end = self.partner.get(i, self.n)
            if end == i + 1:
                raise _Wrong(end, "type parameter expected")
            return end + 1
        return i

    def name(self, i: int, end: int | None = None) -> None:
        if i >= (self.n if end is None else end) or self.kinds[i] != WORD or self.values[i] in _KEYWORDS:
            raise _Wrong(i, "name expected")

    def find(self, a: int, b: int, word: str) -> int:
        """The first such keyword outside brackets."""
        i = a
        while i < b:
            if self.kinds[i] == WORD and self.values[i] == word:
                return i
            i = self.partner.get(i, i) + 1 if self.kinds[i] in ("(", "[", "{") else i + 1
        raise _Wrong(min(b, self.n), f"{word} expected")

    def parts(self, a: int, b: int, mark: str) -> list[tuple[int, int]]:
        """The parts between marks outside brackets and parameter lists of lambdas."""
        out, i, start, lambdas = [], a, a, 0
        kinds = self.kinds
        while i < b:
            kind = kinds[i]
            if kind in ("(", "[", "{"):
                i = self.partner.get(i, b)
            elif kind == WORD and self.values[i] == "lambda":
                lambdas += 1
            elif kind == ":" and lambdas:
                lambdas -= 1
            elif kind == mark and not lambdas:
                out.append((start, i))
                start = i + 1
            i += 1
        out.append((start, b))
        return out

    def with_items(self, a: int, b: int) -> None:
        kinds = self.kinds
        if a >= b:
            raise _Wrong(a, "value expected")
        if kinds[a] == "(" and self.partner.get(a) == b - 1:
            inner = self.parts(a + 1, b - 1, ",")
            if any(self._as(x, y) >= 0 for x, y in inner):
                if inner[-1][0] >= inner[-1][1]:
                    inner.pop()
                for x, y in inner:
                    self.with_item(x, y)
                return
        for x, y in self.parts(a, b, ","):
            self.with_item(x, y)

    def _as(self, a: int, b: int) -> int:
        i = a
        while i < b:
            if self.kinds[i] == WORD and self.values[i] == "as":
                return i
            i = self.partner.get(i, i) + 1 if self.kinds[i] in ("(", "[", "{") else i + 1
        return -1

    def with_item(self, a: int, b: int) -> None:
        at = self._as(a, b)
        self.expression(a, at if at >= 0 else b, named=at < 0)
        if at >= 0:
            self.target(at + 1, b)

    def pattern(self, a: int, b: int) -> None:
        """Patterns are only read for adjacent values and brackets."""
        if a >= b:
            raise _Wrong(a, "pattern expected")
        i, value = a, False
        while i < b:
            kind, word = self.kinds[i], self.values[i]
            if kind == WORD and word == "if" and value:
                self.expression(i + 1, b, named=True)
                return
            if kind in (WORD, NUMBER, STRING):
                if kind == WORD and word == "as":
                    if not value:
                        raise _Wrong(i, "pattern expected")
                    value = False
                elif kind == WORD and word in _KEYWORDS and word not in _CONSTANTS:
                    raise _Wrong(i, "keyword in the place of a value")
                elif value and not (kind == STRING and self.kinds[i - 1] == STRING):
                    raise _Wrong(i, "two values with nothing between")
                else:
                    value = True
            elif kind in ("(", "[", "{"):
                value = False
            elif kind in (")", "]", "}"):
                if not value and self.kinds[i - 1] not in ("(", "[", "{", ","):
                    raise _Wrong(i, "operator without its value")
                value = True
            elif kind in (",", "|", ":", "=", ".", "+"):
                if not value:
                    raise _Wrong(i, "operator without its value")
                value = False
            elif kind in ("-", "*", "**"):
                value = False
            else:
                raise _Wrong(i, "not of a pattern")
            i += 1
        if not value and self.kinds[b - 1] != ",":
            raise _Wrong(b - 1, "operator without its value")

    def simple(self, a: int, b: int) -> None:
        """Simple statements, parted by semicolons."""
        kinds = self.kinds
        if ";" in kinds[a:b]:
            parts = self.parts(a, b, ";")
            if parts[-1][0] >= parts[-1][1]:
                parts.pop()
            for x, y in parts:
                if x >= y:
                    raise _Wrong(x, "statement expected")
                self.statement(x, y)
        else:
            self.statement(a, b)

    def statement(self, a: int, b: int) -> None:
        kinds, values = self.kinds, self.values
        word = values[a] if kinds[a] == WORD else ""
        if word in _KEYWORDS and word not in _CONSTANTS and word not in ("not", "lambda", "await", "yield"):
            if word in ("pass", "break", "continue"):
                if b != a + 1:
                    raise _Wrong(a + 1, "end of the line expected")
            elif word == "return":
                if b > a + 1:
                    self.expression(a + 1, b, tuples=True, stars=True)
            elif word == "raise":
                if b > a + 1:
                    at = next((i for i in range(a + 1, b) if kinds[i] == WORD and values[i] == "from" and self.outer(a, i)), -1)
                    self.expression(a + 1, at if at >= 0 else b)
                    if at >= 0:
                        self.expression(at + 1, b)
            elif word == "del":
                self.targets(a + 1, b, delete=True)
            elif word == "assert":
                parts = self.parts(a + 1, b, ",")
                if len(parts) > 2:
                    raise _Wrong(parts[2][0], "end of the line expected")
                for x, y in parts:
                    self.expression(x, y)
            elif word in ("global", "nonlocal"):
                for x, y in self.parts(a + 1, b, ","):
                    self.name(x, y)
                    if y != x + 1:
                        raise _Wrong(min(x + 1, self.n - 1), "comma expected")
            elif word == "import":
                for x, y in self.parts(a + 1, b, ","):
                    self.imported(x, y, True)
            elif word == "from":
                self.import_from(a, b)
            elif word in _COMPOUND:
                raise _Wrong(a, "statement with a block in the place of a simple one")
            else:
                raise _Wrong(a, "keyword in the place of a statement")
            return
        if word == "type" and b - a > 3 and kinds[a + 1] == WORD and values[a + 1] not in _KEYWORDS and (kinds[a + 2] in ("=", "[")):
            i = self.type_parameters(a + 2)
            if i >= b or kinds[i] != "=":
                raise _Wrong(i, "value expected")
            self.expression(i + 1, b)
            return
        # Assignments are told from expressions by what stands outside brackets.
        equals, colon, augmented, lambdas, i = [], -1, -1, 0, a
        while i < b:
            kind = kinds[i]
            if kind in ("(", "[", "{"):
                i = self.partner.get(i, b)
            elif kind == WORD:
                if values[i] == "lambda":
                    lambdas += 1
            elif kind == ":":
                if lambdas:
                    lambdas -= 1
                elif colon < 0:
                    colon = i
                else:
                    raise _Wrong(i, "colon in the place of an operator")
            elif kind == "=":
                if not lambdas:
                    equals.append(i)
            elif kind in _AUGMENTED:
                if augmented >= 0 or equals or colon >= 0:
                    raise _Wrong(i, "assignment within an expression")
                augmented = i
            i += 1
        if augmented >= 0:
            if equals:
                raise _Wrong(equals[0], "assignment within an expression")
            if kinds[augmented - 1] == "]" and self.partner.get(augmented - 1) == a or kinds[augmented - 1] == ")" and self.partner.get(augmented - 1) == a and any(kinds[k] == "," for k in range(a, augmented)):
                raise _Wrong(a, "assignment to what holds no value")
            self.target(a, augmented)
            self.expression(augmented + 1, b, tuples=True, stars=True, yields=True)
        elif colon >= 0:
            if equals and (equals[0] < colon or len(equals) > 1):
                raise _Wrong(colon, "colon in the place of an operator")
            self.target(a, colon, annotated=True)
            self.expression(colon + 1, equals[0] if equals else b)
            if equals:
                self.expression(equals[0] + 1, b, tuples=True, stars=True, yields=True)
        elif equals:
            start = a
            for at in equals:
                self.targets(start, at)
                start = at + 1
            self.expression(start, b, tuples=True, stars=True, yields=True)
        else:
            self.expression(a, b, tuples=True, stars=True, yields=True)

    def outer(self, a: int, i: int) -> bool:
        """Whether token i stands outside the brackets opened since a."""
        k = a
        while k < i:
            k = self.partner.get(k, k) + 1 if self.kinds[k] in ("(", "[", "{") else k + 1
        return k == i

    def imported(self, a: int, b: int, dotted: bool) -> None:
        self.name(a, b)
        i = a + 1
        while dotted and i < b and self.kinds[i] == ".":
            self.name(i + 1, b)
            i += 2
        if i < b:
            if self.values[i] != "as" or b != i + 2:
                raise _Wrong(i, "comma expected")
            self.name(i + 1)

    def import_from(self, a: int, b: int) -> None:
        kinds, values = self.kinds, self.values
        i = a + 1
        dots = 0
        while i < b and kinds[i] in (".", "..."):
            i += 1
            dots += 1
        if i < b and not (values[i] == "import" and dots):
            self.name(i)
            i += 1
            while i < b and kinds[i] == ".":
                self.name(i + 1, b)
                i += 2
        if i >= b or kinds[i] != WORD or values[i] != "import":
            raise _Wrong(min(i, self.n), "import expected")
        i += 1
        if i < b and kinds[i] == "*":
            if b != i + 1:
                raise _Wrong(i + 1, "end of the line expected")
            return
        if i < b and kinds[i] == "(":
            if self.partner.get(i) != b - 1:
                raise _Wrong(b - 1, "end of the line expected")
            parts = self.parts(i + 1, b - 1, ",")
            if len(parts) > 1 and parts[-1][0] >= parts[-1][1]:
                parts.pop()
        else:
            parts = self.parts(i, b, ",")
        for x, y in parts:
            if x >= y:
                raise _Wrong(min(x, self.n), "name expected")
            self.imported(x, y, False)

    # Targets.

    def targets(self, a: int, b: int, delete: bool = False) -> None:
        """Targets parted by commas, with stars."""
        if a >= b:
            raise _Wrong(min(a, self.n), "name expected")
        parts = self.parts(a, b, ",")
        if len(parts) > 1 and parts[-1][0] >= parts[-1][1]:
            parts.pop()
        stars = 0
        for x, y in parts:
            if x < y and self.kinds[x] == "*" and not delete:
                x += 1
                stars += 1
            self.target(x, y, delete)
        if stars > 1:
            raise _Wrong(a, "two starred targets")

    def target(self, a: int, b: int, delete: bool = False, annotated: bool = False) -> None:
        kinds, values = self.kinds, self.values
        if a >= b:
            raise _Wrong(min(a, self.n), "name expected")
        if b == a + 1:
            if kinds[a] != WORD or values[a] in _KEYWORDS:
                raise _Wrong(a, "assignment to what holds no value")
            return
        last = kinds[b - 1]
        opened = self.partner.get(b - 1) if last in (")", "]") else None
        if opened == a:
            # A group or a list of targets.
            if annotated and (last == "]" or "," in kinds[a:b]):
                raise _Wrong(a, "assignment to what holds no value")
            if b > a + 2:
                self.targets(a + 1, b - 1, delete)
            return
        if last == ")" or last in (STRING, NUMBER, "}", "..."):
            raise _Wrong(a, "assignment to what holds no value")
        if last == WORD and (kinds[b - 2] != "." or values[b - 1] in _KEYWORDS):
            raise _Wrong(b - 1, "assignment to what holds no value")
        i = a
        while i < b:
            kind = kinds[i]
            if kind in ("(", "[", "{"):
                i = self.partner.get(i, b)
            elif kind not in (WORD, STRING, NUMBER, ".") or kind == WORD and values[i] in _KEYWORDS and kinds[i - 1] != ".":
                raise _Wrong(i, "assignment to what holds no value")
            i += 1
        self.expression(a, b)

    def parameters(self, a: int, b: int, annotated: bool) -> None:
        """Parameters of a function or a lambda."""
        kinds, values = self.kinds, self.values
        if a >= b:
            return
        parts = self.parts(a, b, ",")
        if len(parts) > 1 and parts[-1][0] >= parts[-1][1]:
            parts.pop()
        default = star = bare = slash = double = False
        for x, y in parts:
            if x >= y:
                raise _Wrong(min(x, self.n), "parameter expected")
            if double:
                raise _Wrong(x, "parameter behind the last one")
            kind = kinds[x]
            if kind == "/":
                if y != x + 1 or slash or star or x == a:
                    raise _Wrong(x, "parameter expected")
                slash = True
                continue
            if kind == "*":
                if star:
                    raise _Wrong(x, "two starred parameters")
                star = True
                if y == x + 1:
                    bare = True
                    continue
                x += 1
            elif kind == "**":
                double = True
                if bare:
                    raise _Wrong(x, "named parameter expected")
                x += 1
            bare = False
            self.name(x, y)
            i = x + 1
            if i < y and kinds[i] == ":":
                if not annotated:
                    raise _Wrong(i, "annotation in a lambda")
                ends = self.parts(i + 1, y, "=")
                self.expression(*ends[0], stars=kind == "*")
                i = ends[0][1]
            if i < y:
                if kinds[i] != "=" or kind in ("*", "**"):
                    raise _Wrong(i, "comma expected")
                self.expression(i + 1, y)
                if not star:
                    default = True
            elif default and not star and not double:
                raise _Wrong(x, "parameter without a default behind one with")
        if bare:
            raise _Wrong(b - 1 if b <= self.n else self.n, "named parameter expected")

    # Expressions.

    def expression(self, a: int, b: int, tuples: bool = False, stars: bool = False, yields: bool = False, named: bool = False, call: bool = False) -> None:
        """Tokens a to b as one expression, or with ``tuples`` several parted by commas.

        ``stars``, ``yields`` and ``named`` allow starred parts, yield and assignment expressions outside brackets;
        ``call`` reads the first parenthesis as arguments.
        """
        kinds, values = self.kinds, self.values
        if a >= b:
            raise _Wrong(min(a, self.n), "value expected")
        if b == a + 1:
            kind = kinds[a]
            if kind == WORD:
                if values[a] in _KEYWORDS and values[a] not in _CONSTANTS and not (yields and values[a] == "yield"):
                    raise _Wrong(a, "keyword in the place of a value")
            elif kind == STRING:
                self.string(a)
            elif kind == NUMBER:
                if _LEADING_ZERO.match(values[a]) and not set(values[a]) & set(".eEjJxXoObB") or "_" in values[a] and _LEADING_ZERO.match(values[a]):
                    raise _Wrong(a, "malformed number")
            elif kind != "...":
                raise _Wrong(a, "value expected")
            return
        frame = _Frame("top", a)
        frames = [frame]
        value, optional = False, False
        i = a - 1
        while i + 1 < b:
            i += 1
            kind = kinds[i]
            if kind == WORD:
                word = values[i]
                if word not in _KEYWORDS or word in _CONSTANTS:
                    if value:
                        raise _Wrong(i, "two values with nothing between")
                    value, optional = True, False
                    continue
                if word not in _EXPRESSION:
                    raise _Wrong(i, "keyword in the place of a value")
                if word == "not":
                    if value:
                        if i + 1 >= b or values[i + 1] != "in":
                            raise _Wrong(i, "two values with nothing between")
                        i += 1
                    elif i > a and (kinds[i - 1] in _TIGHTER or kinds[i - 1] == WORD and values[i - 1] in ("in", "is") or kinds[i - 1] == WORD and values[i - 1] == "not" and i - 2 > a and values[i - 2] == "is"):
                        raise _Wrong(i, "operator without its value")
                    value = False
                elif word in ("and", "or", "in", "is"):
                    if not value:
                        raise _Wrong(i, "operator without its value")
                    if word == "is" and i + 1 < b and kinds[i + 1] == WORD and values[i + 1] == "not":
                        i += 1
                    value = False
                elif word == "if":
                    if not value:
                        raise _Wrong(i, "operator without its value")
                    if not frame.fors:
                        frame.terns += 1
                    value = False
                elif word == "else":
                    if not value or not frame.terns:
                        raise _Wrong(i, "else without its condition")
                    frame.terns -= 1
                    value = False
                elif word == "async":
                    if not value or i + 1 >= b or values[i + 1] != "for":
                        raise _Wrong(i, "keyword in the place of a value")
                elif word == "for":
                    if not value or frame.terns or frame.kind in ("top", "sub"):
                        raise _Wrong(i, "keyword in the place of an operator")
                    frame.fors += 1
                    at = self.find(i + 1, b, "in")
                    self.targets(i + 1, at)
                    i, value = at, False
                elif word == "lambda":
                    if value:
                        raise _Wrong(i, "two values with nothing between")
                    at = self.colon(i + 1, b)
                    if at < 0:
                        raise _Wrong(i, "lambda without a colon")
                    self.parameters(i + 1, at, False)
                    i = at
                elif word == "await":
                    if value:
                        raise _Wrong(i, "two values with nothing between")
                else:
                    # yield, alone or with what it yields
                    if value or not (i == a and yields or kinds[i - 1] == "(" and frame.kind == "group"):
                        raise _Wrong(i, "keyword in the place of a value")
                    if i + 1 < b and kinds[i + 1] == WORD and values[i + 1] == "from":
                        i += 1
                    else:
                        optional = True
                continue
            if kind == STRING:
                if value and kinds[i - 1] != STRING:
                    raise _Wrong(i, "two values with nothing between")
                self.string(i)
                value, optional = True, False
            elif kind == NUMBER:
                if value:
                    raise _Wrong(i, "two values with nothing between")
                number = values[i]
                if (number[0] == "0" and len(number) > 1 or "_" in number) and _LEADING_ZERO.match(number) and not (set(number) & set(".eEjJxXoObB") and "_" not in number):
                    raise _Wrong(i, "malformed number")
                value, optional = True, False
            elif kind == ".":
                if not value or i + 1 >= b or kinds[i + 1] != WORD or values[i + 1] in _KEYWORDS:
                    raise _Wrong(i, "operator without its value")
                i += 1
            elif kind == "(" or kind == "[":
                frame = _Frame(("call" if kind == "(" else "sub") if value or call and i == a else "group" if kind == "(" else "list", i)
                frames.append(frame)
                value = optional = False
            elif kind == "{":
                if value:
                    raise _Wrong(i, "two values with nothing between")
                frame = _Frame("brace", i)
                frames.append(frame)
                optional = False
            elif kind == ")" or kind == "]" or kind == "}":
                if len(frames) == 1:
                    raise _Wrong(i, "closer without opener")
                previous = kinds[i - 1]
                if not value and not optional:
                    empty = i - 1 == frame.opened
                    if not (empty and frame.kind != "sub" or previous == "," and i - 2 != frame.opened or previous == ":" and frame.kind == "sub"):
                        raise _Wrong(i, "operator without its value")
                if frame.terns:
                    raise _Wrong(i, "condition without its else")
                if value:
                    self.element(frame, i)
                if frame.kind == "brace" and value and frame.pair is None:
                    raise _Wrong(i, "value expected")
                frames.pop()
                frame = frames[-1]
                value, optional = True, False
            elif kind == ",":
                if not value and not optional and not (frame.kind == "sub" and kinds[i - 1] == ":"):
                    raise _Wrong(i, "operator without its value")
                if frame.terns or frame.fors:
                    raise _Wrong(i, "comma in the place of an operator")
                if frame.kind == "top" and not tuples:
                    raise _Wrong(i, "comma in the place of an operator")
                self.element(frame, i)
                frame.colons, value = 0, False
            elif kind == "=":
                before = kinds[i - 2]
                if frame.kind != "call" or not value or kinds[i - 1] != WORD or values[i - 1] in _KEYWORDS or not (before == "," or i - 2 == frame.opened):
                    raise _Wrong(i, "assignment within an expression")
                frame.keyed, value = True, False
            elif kind == ":":
                if frame.terns:
                    raise _Wrong(i, "condition without its else")
                if frame.kind == "sub":
                    frame.colons += 1
                    if frame.colons > 2:
                        raise _Wrong(i, "colon in the place of an operator")
                    if not value and kinds[i - 1] not in ("[", ",", ":"):
                        raise _Wrong(i, "operator without its value")
                elif frame.kind == "brace" and value and not frame.colons:
                    frame.colons = 1
                else:
                    raise _Wrong(i, "colon in the place of an operator")
                value = False
            elif kind == ":=":
                before = kinds[i - 2] if i - 2 >= a else ""
                if not value or kinds[i - 1] != WORD or frame.kind == "top" and not named or frame.kind == "call" and frame.keyed or before == ".":
                    raise _Wrong(i, "assignment within an expression")
                value = False
            elif kind == "*" or kind == "**":
                if not value:
                    before = kinds[i - 1] if i > a else ""
                    first = i == a or before == "," or i - 1 == frame.opened or optional
                    if not first or frame.kind == "top" and not stars or kind == "**" and frame.kind not in ("call", "brace"):
                        raise _Wrong(i, "operator without its value")
                    if frame.kind == "call":
                        frame.starred = True
                        if kind == "**":
                            frame.had_double = True
                        elif frame.had_double:
                            raise _Wrong(i, "starred argument behind a double one")
                    elif frame.kind == "brace" and kind == "**":
                        frame.colons = 1
                value = optional = False
            elif kind == "+" or kind == "-":
                value = optional = False
            elif kind == "~":
                if value:
                    raise _Wrong(i, "two values with nothing between")
                optional = False
            elif kind in _BINARY:
                if not value:
                    raise _Wrong(i, "operator without its value")
                value = False
            elif kind == "...":
                if value:
                    raise _Wrong(i, "two values with nothing between")
                value, optional = True, False
            else:
                raise _Wrong(i, "unexpected mark")
        if len(frames) > 1:
            raise _Wrong(min(b, self.n), "premature end")
        if frame.terns:
            raise _Wrong(min(b, self.n), "condition without its else")
        if not value and not optional and not (tuples and kinds[b - 1] == "," and b - 1 > a):
            raise _Wrong(b - 1, "operator without its value")

    @staticmethod
    def element(frame: _Frame, at: int) -> None:
        """An element of a bracket ends."""
        if frame.kind == "call":
            if frame.keyed:
                frame.had_keyed = True
            elif not frame.starred and (frame.had_keyed or frame.had_double):
                raise _Wrong(at, "positional argument behind a named one")
            frame.keyed = frame.starred = False
        elif frame.kind == "brace":
            # A set and a dictionary cannot be mixed.
            now = "pair" if frame.colons else "item"
            if frame.pair and frame.pair != now:
                raise _Wrong(at, "pairs and items mixed")
            frame.pair = now
            frame.colons = 0

    def string(self, i: int) -> None:
        """Escapes and the fields of a string."""
        text = self.values[i]
        at = 0
        while text[at] not in "\"'":
            at += 1
        prefix = text[:at].lower()
        if "\\" in text and "r" not in prefix:
            if (_BYTE_ESCAPE if "b" in prefix else _ESCAPE).search(text.replace("\\\\", "")):
                raise _Wrong(i, "malformed escape")
        if not prefix:
            return
        if prefix not in ("r", "u", "b", "f", "br", "rb", "fr", "rf"):
            raise _Wrong(i, "two values with nothing between")
        if "b" in prefix and not text.isascii():
            raise _Wrong(i, "sign beyond ASCII in bytes")
        if "f" in prefix and ("{" in text or "}" in text):
            wide = 3 if text.startswith(('"""', "'''"), at) else 1
            self.fields(i, text[at + wide : -wide])

    def fields(self, i: int, body: str, nested: bool = False) -> None:
        """The replacement fields of an f-string."""
        at, size = 0, len(body)
        while at < size:
            c = body[at]
            if c == "}":
                if not nested and body.startswith("}}", at):
                    at += 2
                    continue
                raise _Wrong(i, "closer without opener")
            if c != "{":
                at += 1
                continue
            if not nested and body.startswith("{{", at):
                at += 2
                continue
            depth, k = 1, at + 1
            while k < size and depth:
                if body[k] in "{[(":
                    depth += 1
                elif body[k] in "}])":
                    depth -= 1
                elif body[k] in "\"'":
                    end = body.find(body[k], k + 1)
                    k = end if end > 0 else k
                k += 1
            if depth:
                raise _Wrong(i, "premature end of a field")
            self.field(i, body[at + 1 : k - 1])
            at = k

    def field(self, i: int, field: str) -> None:
        if _PLAIN_FIELD.match(field) and field.strip().split("!")[0].strip() not in _KEYWORDS:
            return
        # The format behind a colon, the conversion behind an exclamation mark and a last equals sign are no part of the value.
        end, rest = _value_end(field), ""
        if end < len(field):
            field, rest = field[:end], field[end + 1 :]
        source = lexing.scan(field, "python")
        size = len(source.kinds)
        if size and source.kinds[-1] == "=":
            size -= 1
        if source.fault:
            raise _Wrong(i, "field that cannot be read")
        if not size:
            raise _Wrong(i, "empty field")
        try:
            _Reader(source).expression(0, size, tuples=True, stars=True, yields=True)
        except _Wrong as wrong:
            raise _Wrong(i, f"field: {wrong.args[1]}") from None
        if "{" in rest:
            self.fields(i, rest, True)


def _value_end(field: str) -> int:
    """Where the value of a field ends: before a colon or an exclamation mark outside brackets and strings."""
    depth, at = 0, 0
    while at < len(field):
        c = field[at]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c in "\"'":
            end = field.find(c, at + 1)
            at = end if end > 0 else at
        elif depth == 0 and (c == ":" or c == "!" and not field.startswith("!=", at)):
            return at
        at += 1
    return len(field)
