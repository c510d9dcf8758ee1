"""The pushdown pass over the tokens of Rust source: a reader of its grammar that goes down a level at every opener.

What stands between the delimiters of a macro is only matched, as the language has it.
"""

from __future__ import annotations

import re

from orrery.sources.lexing import LIFETIME, NUMBER, STRING, WORD, Source

_KEYWORDS = frozenset("as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while".split())
_PATH_WORDS = frozenset("self Self super crate".split())
_BINARY = frozenset("+ - * / % & | ^ && || == != < <= <<".split())
_ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<=".split())
_BLOCKS = frozenset("if match loop while for unsafe".split())
_ITEMS = frozenset("use mod fn struct enum trait impl static type extern pub".split())
#: What ends an expression that may be left out.
_ENDS = frozenset((")", "]", "}", ";", ",", "=>", ""))
_INDEX = re.compile(r"\d+(?:\.\d+)?\Z")


class _Wrong(Exception):
    """The first thing that is not valid: the number of its token and the reason."""


def fault_of(source: Source) -> tuple[int, str] | None:
    """Offset and reason of the first thing found that is not valid, or None."""
    reader = _Reader(source)
    try:
        reader.items("")
        if reader.i < reader.n:
            raise reader.wrong("closer without opener")
    except _Wrong as wrong:
        at, why = wrong.args
        return (source.starts[at] if at < reader.n else len(source.text)), why
    except RecursionError:
        return None
    return None


class _Reader:
    def __init__(self, s: Source):
        self.kinds, self.values = [*s.kinds, "", "", ""], [*s.values, "", "", ""]
        self.starts, self.partner, self.n, self.i = [*s.starts, 1 << 60, 1 << 61, 1 << 62], s.partner, len(s.kinds), 0

    # Tokens.

    def wrong(self, why: str) -> _Wrong:
        return _Wrong(min(self.i, self.n), why)

    def take(self, mark: str) -> bool:
        if self.kinds[self.i] == mark:
            self.i += 1
            return True
        return False

    def need(self, mark: str, why: str = "") -> None:
        if self.kinds[self.i] != mark:
            raise self.wrong(why or f"{mark} expected")
        self.i += 1

    def word(self, at: int = 0) -> str:
        return self.values[self.i + at] if self.kinds[self.i + at] == WORD else ""

    def open(self) -> bool:
        """Takes a less-than sign that opens; of two that were read as one mark the second is left."""
        if self.kinds[self.i] == "<<":
            self.kinds[self.i] = "<"
            return True
        return self.take("<")

    def take_word(self, word: str) -> bool:
        if self.values[self.i] == word and self.kinds[self.i] == WORD:
            self.i += 1
            return True
        return False

    def name(self, why: str = "name expected") -> None:
        if self.kinds[self.i] != WORD or self.values[self.i] in _KEYWORDS:
            raise self.wrong(why)
        self.i += 1

    def skip(self) -> None:
        """Over an opener and all that it holds."""
        if self.kinds[self.i] not in ("(", "[", "{"):
            raise self.wrong("delimiter expected")
        close = self.partner.get(self.i)
        if close is None:
            raise self.wrong("premature end")
        self.i = close + 1

    def listed(self, closer: str, read) -> None:
        """Parts parted by commas up to a closer, which is taken."""
        while self.kinds[self.i] != closer:
            read()
            if not self.take(","):
                break
        self.need(closer, "comma or closer expected")

    def attributes(self, inner: bool = False) -> bool:
        found = False
        while self.kinds[self.i] == "#" and (self.kinds[self.i + 1] == "[" or inner and self.kinds[self.i + 1] == "!" and self.kinds[self.i + 2] == "["):
            found = found or self.kinds[self.i + 1] == "["
            self.i += 1 if self.kinds[self.i + 1] == "[" else 2
            self.skip()
        return found

    # Items.

    def items(self, closer: str, member: bool = False) -> None:
        while True:
            marked = self.attributes(True)
            if self.i >= self.n or self.kinds[self.i] == "}":
                if marked:
                    raise self.wrong("attribute without an item")
                break
            if not self.item(member):
                raise self.wrong("not an item")
        if closer:
            self.need(closer, "premature end")

    def visibility(self) -> bool:
        if not self.take_word("pub"):
            return False
        if self.kinds[self.i] == "(" and self.word(1) in ("crate", "super", "self", "in"):
            self.skip()
        return True

    def item(self, member: bool = False) -> bool:
        """Reads an item, if one begins here."""
        public = self.visibility()
        word = self.word()
        if not word:
            if public:
                raise self.wrong("item expected")
            return False
        if word == "default" and self.kinds[self.i + 1] == WORD and self.word(1) in ("fn", "const", "async", "unsafe", "type", "impl", "extern"):
            self.i += 1
            word = self.word()
        if word in ("const", "async", "unsafe", "extern", "safe") and self._function_ahead():
            while self.word() != "fn":
                self.i += 1
            word = "fn"
        if word == "unsafe" and self.word(1) in ("impl", "trait", "extern", "mod", "auto"):
            self.i += 1
            word = self.word()
        if word == "auto" and self.word(1) == "trait":
            self.i += 1
            word = "trait"
        if word == "fn":
            self.function()
        elif word == "const":
            if self.kinds[self.i + 1] == "{" and not public:
                return False
            self.i += 1
            self.take_word("mut")
            self.name()
            self.need(":", "constant without a type")
            self.type()
            if self.take("="):
                self.expression()
            elif not member:
                raise self.wrong("value expected")
            self.need(";", "semicolon expected")
        elif word == "type":
            self.i += 1
            self.name()
            self.generics()
            if self.take(":"):
                self.bounds()
            self.where()
            if self.take("="):
                self.type()
                self.where()
            self.need(";", "semicolon expected")
        elif self._macro_ahead():
            if public:
                raise self.wrong("item expected")
            if word == "macro_rules" and self.kinds[self.i + 2] == WORD:
                self.i += 3
            else:
                self.path()
                self.i += 1
            braces = self.kinds[self.i] == "{"
            self.skip()
            if not braces:
                self.need(";", "semicolon expected")
        elif member:
            if public or word in _ITEMS:
                raise self.wrong("not an item of a member list")
            return False
        elif word == "use":
            self.i += 1
            self.use_tree()
            self.need(";", "semicolon expected")
        elif word == "mod":
            self.i += 1
            self.name()
            if not self.take(";"):
                self.need("{", "block expected")
                self.items("}")
        elif word == "struct" or word == "union" and self.kinds[self.i + 1] == WORD:
            self.struct()
        elif word == "enum":
            self.i += 1
            self.name()
            self.generics()
            self.where()
            self.need("{", "variants expected")
            self.listed("}", self.variant)
        elif word == "trait":
            self.i += 1
            self.name()
            self.generics()
            if self.take("="):
                self.bounds()
                self.where()
                self.need(";")
                return True
            if self.take(":"):
                self.bounds()
            self.where()
            self.need("{", "block expected")
            self.items("}", True)
        elif word == "impl":
            self.i += 1
            self.generics()
            self.take_word("const")
            self.take("!")
            self.type()
            if self.take_word("for"):
                self.type()
            self.where()
            self.need("{", "block expected")
            self.items("}", True)
        elif word == "static":
            if self.kinds[self.i + 1] in ("|", "||") or self.word(1) == "move":
                return False
            self.i += 1
            self.take_word("mut")
            self.name()
            self.need(":", "constant without a type")
            self.type()
            if self.take("="):
                self.expression()
            self.need(";", "semicolon expected")
        elif word == "extern":
            self.i += 1
            if self.take_word("crate"):
                if not self.take_word("self"):
                    self.name()
                if self.take_word("as"):
                    self.name()
                self.need(";", "semicolon expected")
            else:
                self.take(STRING)
                self.need("{", "block expected")
                while True:
                    self.attributes(True)
                    if self.kinds[self.i] == "}":
                        break
                    if not self.item():
                        raise self.wrong("not an item")
                self.i += 1
        else:
            if public:
                raise self.wrong("item expected")
            return False
        return True

    def _function_ahead(self) -> bool:
        k = self.i
        while self.kinds[k] == WORD and self.values[k] in ("const", "async", "unsafe", "extern", "safe") or self.kinds[k] == STRING and self.values[k - 1] == "extern":
            k += 1
        return self.kinds[k] == WORD and self.values[k] == "fn"

    def _macro_ahead(self) -> bool:
        k = self.i
        if self.kinds[k] == WORD and self.values[k] in _KEYWORDS and self.values[k] not in _PATH_WORDS:
            return False
        k += self.kinds[k] == "::"
        while self.kinds[k] == WORD and self.kinds[k + 1] == "::":
            k += 2
        return self.kinds[k] == WORD and self.kinds[k + 1] == "!" and self.kinds[k + 2] in ("(", "[", "{", WORD) and self.starts[k + 2] - self.starts[k + 1] >= 1

    def use_tree(self) -> None:
        self.take("::")
        while True:
            if self.take("{"):
                self.listed("}", self.use_tree)
                return
            if self.take("*"):
                return
            if self.word() in _PATH_WORDS:
                self.i += 1
            else:
                self.name()
            if not self.take("::"):
                break
        if self.take_word("as"):
            self.name()

    def function(self) -> None:
        self.i += 1
        self.name("function without a name")
        self.generics()
        self.need("(", "function without parameters")
        self.listed(")", self.parameter)
        if self.take("->"):
            self.type()
        self.where()
        if not self.take(";"):
            if self.kinds[self.i] != "{":
                raise self.wrong("function without a body")
            self.block()

    def parameter(self) -> None:
        self.attributes()
        if self.take("..."):
            return
        start = self.i
        if self.take("&"):
            self.take(LIFETIME)
        self.take_word("mut")
        if self.take_word("self"):
            if self.take(":"):
                self.type()
            return
        self.i = start
        self.pattern(False)
        self.need(":", "type expected")
        if not self.take("..."):
            self.type()

    def struct(self) -> None:
        self.i += 1
        self.name("item without a name")
        self.generics()
        self.where()
        if self.take("{"):
            self.listed("}", self.field)
        elif self.take("("):
            self.listed(")", self.tuple_field)
            self.where()
            self.need(";", "semicolon expected")
        else:
            self.need(";", "fields expected")

    def field(self) -> None:
        self.attributes()
        self.visibility()
        self.name()
        self.need(":", "type expected")
        self.type()
        if self.take("="):
            self.expression()

    def tuple_field(self) -> None:
        self.attributes()
        self.visibility()
        self.type()

    def variant(self) -> None:
        self.attributes()
        self.visibility()
        self.name()
        if self.take("{"):
            self.listed("}", self.field)
        elif self.take("("):
            self.listed(")", self.tuple_field)
        if self.take("="):
            self.expression()

    def generics(self) -> None:
        if self.open():
            self.listed(">", self.generic)

    def generic(self) -> None:
        self.attributes()
        if self.take(LIFETIME):
            if self.take(":"):
                self.bounds()
        elif self.take_word("const"):
            self.name()
            self.need(":", "type expected")
            self.type()
            if self.take("="):
                self.constant()
        else:
            self.name()
            if self.take(":"):
                self.bounds()
            if self.take("="):
                self.type()

    def constant(self) -> None:
        """A constant among type arguments."""
        if self.kinds[self.i] == "{":
            self.block()
        else:
            self.take("-")
            if self.kinds[self.i] not in (NUMBER, STRING, WORD):
                raise self.wrong("value expected")
            self.i += 1

    def where(self) -> None:
        if not self.take_word("where"):
            return
        while self.kinds[self.i] not in ("{", ";", "=", ""):
            if self.take(LIFETIME):
                self.need(":", "bounds expected")
                self.bounds()
            else:
                self.higher()
                self.type(False)
                self.need(":", "bounds expected")
                self.bounds()
            if not self.take(","):
                break

    def higher(self) -> None:
        if self.word() == "for" and self.kinds[self.i + 1] == "<":
            self.i += 1
            self.generics()

    def bounds(self) -> None:
        while True:
            if self.kinds[self.i] in (",", ">", "{", "=", ";", ")", "where") or self.word() == "where":
                return
            self.bound()
            if not self.take("+"):
                return

    def bound(self) -> None:
        if self.take(LIFETIME):
            return
        if self.take("("):
            self.bound()
            self.need(")")
            return
        if self.word() == "use" and self.kinds[self.i + 1] == "<":
            self.i += 1
            self.generics()
            return
        self.take("?")
        if self.take("~"):
            self.take_word("const")
        self.take_word("const")
        self.take_word("async")
        self.higher()
        self.type_path()

    # Types and paths.

    def type(self, sums: bool = True) -> None:
        kind = self.kinds[self.i]
        if kind == "&" or kind == "&&":
            self.i += 1
            self.take(LIFETIME)
            self.take_word("mut")
            self.type(False)
        elif kind == "(":
            self.i += 1
            self.listed(")", self.type)
        elif kind == "[":
            self.i += 1
            self.type()
            if self.take(";"):
                self.expression()
            self.need("]", "closer expected")
        elif kind == "*":
            self.i += 1
            if self.word() not in ("const", "mut"):
                raise self.wrong("const or mut expected")
            self.i += 1
            self.type(False)
        elif kind == "!":
            self.i += 1
        elif kind == WORD:
            word = self.values[self.i]
            if word in ("impl", "dyn") and (self.kinds[self.i + 1] in (WORD, LIFETIME, "?", "(", "::", "<", "~")):
                self.i += 1
                if sums:
                    self.bounds()
                else:
                    self.bound()
                return
            if word == "for":
                self.higher()
                word = self.word()
            if word in ("unsafe", "extern", "fn"):
                self.take_word("unsafe")
                if self.take_word("extern"):
                    self.take(STRING)
                if not self.take_word("fn"):
                    raise self.wrong("type expected")
                self.need("(", "parameters expected")
                self.listed(")", self.bare_parameter)
                if self.take("->"):
                    self.type(False)
                return
            self.type_path()
            if self.kinds[self.i] == "!" and self.kinds[self.i + 1] in ("(", "[", "{"):
                self.i += 1
                self.skip()
            elif sums and self.kinds[self.i] == "+" and self.kinds[self.i + 1] in (LIFETIME, WORD, "?"):
                self.i += 1
                self.bounds()
        elif kind in ("::", "<", "<<"):
            self.type_path()
        else:
            raise self.wrong("type expected")

    def bare_parameter(self) -> None:
        self.attributes()
        if self.take("..."):
            return
        if self.kinds[self.i] == WORD and self.kinds[self.i + 1] == ":":
            self.i += 2
        self.type()

    def type_path(self) -> None:
        if self.open():
            self.qualified()
        else:
            self.take("::")
            self.type_segment()
        while self.take("::"):
            self.type_segment()

    def qualified(self) -> None:
        """The rest of ``<Type as Trait>::``, of which the last mark is left."""
        self.type()
        if self.take_word("as"):
            self.type_path()
        self.need(">", "closer expected")
        if self.kinds[self.i] != "::":
            raise self.wrong("path expected")

    def type_segment(self) -> None:
        word = self.word()
        if not word or word in _KEYWORDS and word not in _PATH_WORDS:
            raise self.wrong("type expected")
        self.i += 1
        if self.kinds[self.i] == "::" and self.kinds[self.i + 1] in ("<", "<<", "("):
            self.i += 1
        if self.open():
            self.listed(">", self.type_argument)
        elif self.kinds[self.i] == "(":
            self.i += 1
            self.listed(")", self.type)
            if self.take("->"):
                self.type(False)

    def type_argument(self) -> None:
        kind = self.kinds[self.i]
        if kind == LIFETIME:
            self.i += 1
        elif kind in (NUMBER, STRING, "-", "{") or kind == WORD and self.values[self.i] in ("true", "false"):
            self.constant()
        else:
            self.type()
            if self.take("="):
                if self.kinds[self.i] in (NUMBER, STRING, "-", "{"):
                    self.constant()
                else:
                    self.type()
            elif self.take(":"):
                self.bounds()

    def path(self) -> None:
        """A path among expressions, with type arguments behind ``::`` only."""
        if self.open():
            self.qualified()
        else:
            self.take("::")
            self.segment()
        while self.kinds[self.i] == "::":
            self.i += 1
            if self.open():
                self.listed(">", self.type_argument)
            else:
                self.segment()

    def segment(self) -> None:
        word = self.word()
        if not word or word in _KEYWORDS and word not in _PATH_WORDS:
            raise self.wrong("operator without its value")
        self.i += 1

    # Patterns.

    def pattern(self, several: bool = True) -> None:
        if several:
            self.take("|")
        self.single()
        while several and self.take("|"):
            self.single()

    def patterns(self, closer: str) -> None:
        self.listed(closer, self.pattern)

    def single(self) -> None:
        kind = self.kinds[self.i]
        if kind == "&" or kind == "&&":
            self.i += 1
            self.take_word("mut")
            self.single()
            return
        if kind == "(":
            self.i += 1
            self.patterns(")")
            return
        if kind == "[":
            self.i += 1
            self.patterns("]")
            return
        if kind == ".." or kind == "..=":
            self.i += 1
            if self.kinds[self.i] in (NUMBER, STRING, "-") or self.kinds[self.i] == WORD and self.word() not in ("if",):
                self.bound_of_range()
            return
        if kind in (NUMBER, STRING, "-"):
            self.bound_of_range()
        elif kind in (WORD, "<", "<<", "::"):
            word = self.values[self.i]
            if word in ("ref", "mut"):
                self.i += 1
                if word == "ref":
                    self.take_word("mut")
                self.name()
                if self.take("@"):
                    self.single()
                return
            if word == "box":
                self.i += 1
                self.single()
                return
            if word == "const" and self.kinds[self.i + 1] == "{":
                self.i += 1
                self.block()
            elif word in ("true", "false"):
                self.i += 1
            else:
                self.path()
                if self.kinds[self.i] == "!":
                    self.i += 1
                    self.skip()
                    return
                if self.take("@"):
                    self.single()
                    return
                if self.take("("):
                    self.patterns(")")
                    return
                if self.take("{"):
                    self.listed("}", self.field_pattern)
                    return
        else:
            raise self.wrong("pattern expected")
        if self.kinds[self.i] in ("..", "..=", "..."):
            self.i += 1
            if self.kinds[self.i] in (NUMBER, STRING, "-", "::", "<") or self.kinds[self.i] == WORD and self.word() != "if":
                self.bound_of_range()

    def bound_of_range(self) -> None:
        self.take("-")
        if self.kinds[self.i] in (NUMBER, STRING):
            self.i += 1
        else:
            self.path()

    def field_pattern(self) -> None:
        self.attributes()
        if self.take(".."):
            return
        if self.kinds[self.i] in (NUMBER, WORD) and self.kinds[self.i + 1] == ":":
            self.i += 2
            self.pattern()
            return
        self.take_word("box")
        self.take_word("ref")
        self.take_word("mut")
        self.name()

    # Statements.

    def block(self) -> None:
        self.need("{", "block expected")
        while self.kinds[self.i] != "}":
            if self.i >= self.n:
                raise self.wrong("premature end")
            self.statement()
        self.i += 1

    def statement(self) -> None:
        if self.take(";"):
            return
        marked = self.attributes(True)
        if self.kinds[self.i] == "}" and marked:
            raise self.wrong("attribute without an item")
        word = self.word()
        if word == "let":
            self.i += 1
            self.pattern()
            if self.take(":"):
                self.type()
            if self.take("="):
                self.expression()
                if self.take_word("else"):
                    self.block()
            self.need(";", "two values with nothing between")
            return
        if word and (word in _ITEMS or word in ("const", "async", "unsafe", "auto", "union", "default", "macro_rules")) and not (word in ("union", "auto", "default") and self.kinds[self.i + 1] != WORD):
            if not (word in ("async", "unsafe") and self.kinds[self.i + 1] in ("{",) or word == "async" and (self.word(1) == "move" or self.kinds[self.i + 1] in ("|", "||"))) and self.item():
                return
        # What ends in a brace ends the statement.
        if self.kinds[self.i] == "{" or word in _BLOCKS or word == "async" and self.kinds[self.i + 1] == "{" or word == "const" and self.kinds[self.i + 1] == "{" or self.kinds[self.i] == LIFETIME and self.kinds[self.i + 1] == ":":
            self.operand(True, True)
            if self.kinds[self.i] not in (".", "?"):
                self.take(";")
                return
            self.rest()
            return
        elif self._macro_ahead():
            start = self.i
            self.path()
            self.i += 1
            braces = self.kinds[self.i] == "{"
            self.skip()
            if braces and self.kinds[self.i] not in (".", "?"):
                self.take(";")
                return
            self.i = start
        self.rest(False)

    def rest(self, begun: bool = True) -> None:
        """An expression as a statement, or what follows its first value."""
        self.expression(True, begun)
        if not self.take(";") and self.kinds[self.i] != "}":
            raise self.wrong("two values with nothing between")

    # Expressions.

    def expression(self, structs: bool = True, begun: bool = False) -> None:
        """One expression; without ``structs`` a brace behind a path opens a block. Of one ``begun`` the first value is read."""
        kinds, values = self.kinds, self.values
        self.attributes()
        if kinds[self.i] in ("..", "..="):
            self.i += 1
            if kinds[self.i] in _ENDS or kinds[self.i] == "{" and not structs:
                return
        while True:
            # Marks before a value.
            while not begun:
                kind = kinds[self.i]
                if kind in ("-", "!", "*"):
                    self.i += 1
                elif kind in ("&", "&&"):
                    self.i += 1
                    if self.word() == "raw" and self.word(1) in ("const", "mut"):
                        self.i += 2
                    else:
                        self.take_word("mut")
                else:
                    break
            if begun:
                self.hang()
                begun = False
            elif kind == WORD and values[self.i] == "let":
                self.i += 1
                self.pattern()
                self.need("=", "value expected")
                # Only what binds tighter than the lazy operators belongs to it; the loop reads on.
                continue
            elif self.operand(structs):
                return
            while kinds[self.i] == WORD and values[self.i] == "as":
                self.i += 1
                self.type(False)
            kind = kinds[self.i]
            if kind in _BINARY or kind in _ASSIGN:
                self.i += 1
            elif kind == ">":
                at = self.i
                self.i += 1
                while self.i - at < 3 and kinds[self.i] in (">", "=") and self.starts[self.i] == self.starts[at] + self.i - at:
                    self.i += 1
                    if kinds[self.i - 1] == "=":
                        break
            elif kind in ("..", "..="):
                self.i += 1
                if kinds[self.i] in _ENDS or kinds[self.i] == "{" and not structs:
                    return
            else:
                return

    def arguments(self) -> None:
        self.i += 1
        self.listed(")", self.expression)

    def operand(self, structs: bool, statement: bool = False) -> bool:
        """A value with what hangs on it; tells whether nothing can follow it. As a ``statement`` without what hangs on it."""
        kinds, values = self.kinds, self.values
        kind = kinds[self.i]
        if kind == LIFETIME:
            self.i += 1
            self.need(":", "colon expected")
            if self.word() not in ("loop", "while", "for") and kinds[self.i] != "{":
                raise self.wrong("loop expected")
            return self.operand(structs, statement)
        if kind == NUMBER or kind == STRING:
            self.i += 1
        elif kind == "(":
            self.i += 1
            self.listed(")", self.expression)
        elif kind == "[":
            self.i += 1
            if kinds[self.i] != "]":
                self.expression()
                if self.take(";"):
                    self.expression()
                    self.need("]", "closer expected")
                else:
                    if kinds[self.i] != "]":
                        self.need(",", "comma or closer expected")
                    self.listed("]", self.expression)
            else:
                self.i += 1
        elif kind == "{":
            self.block()
        elif kind in ("|", "||"):
            self.closure(structs)
            return True
        elif kind in ("<", "<<", "::"):
            self.path()
            if kinds[self.i] == "!" and kinds[self.i + 1] in ("(", "[", "{"):
                self.i += 1
                self.skip()
            else:
                self.literal(structs)
        elif kind == WORD:
            word = values[self.i]
            if word == "if":
                self.if_()
            elif word == "match":
                self.match()
            elif word == "loop":
                self.i += 1
                self.block()
            elif word == "while":
                self.i += 1
                self.expression(False)
                self.block()
            elif word == "for":
                if kinds[self.i + 1] == "<":
                    self.higher()
                    self.closure(structs)
                    return True
                self.i += 1
                self.pattern()
                if not self.take_word("in"):
                    raise self.wrong("in expected")
                self.expression(False)
                self.block()
            elif word == "unsafe" or word == "const" and kinds[self.i + 1] == "{":
                self.i += 1
                self.block()
            elif word in ("async", "move", "static") or word == "const":
                while self.word() in ("async", "move", "static", "const"):
                    self.i += 1
                if kinds[self.i] == "{":
                    self.block()
                else:
                    self.closure(structs)
                    return True
            elif word in ("return", "break", "continue"):
                self.i += 1
                if word != "return" and kinds[self.i] == LIFETIME:
                    self.i += 1
                if word != "continue" and kinds[self.i] not in _ENDS and not (kinds[self.i] == "{" and not structs):
                    self.expression(structs)
                return True
            elif word in ("true", "false"):
                self.i += 1
            else:
                self.path()
                if kinds[self.i] == "!" and kinds[self.i + 1] in ("(", "[", "{"):
                    self.i += 1
                    self.skip()
                else:
                    self.literal(structs)
        else:
            raise self.wrong("operator without its value")
        if not statement:
            self.hang()
        return False

    def hang(self) -> None:
        """What hangs on a value: fields, calls, places, question marks."""
        kinds, values = self.kinds, self.values
        while True:
            kind = kinds[self.i]
            if kind == ".":
                self.i += 1
                if kinds[self.i] == NUMBER:
                    if not _INDEX.match(values[self.i]):
                        raise self.wrong("operator without its value")
                    self.i += 1
                    continue
                if not self.take_word("await"):
                    self.name("operator without its value")
                    if kinds[self.i] == "::":
                        self.i += 1
                        if not self.open():
                            raise self.wrong("type arguments expected")
                        self.listed(">", self.type_argument)
                        if kinds[self.i] != "(":
                            raise self.wrong("arguments expected")
            elif kind == "?":
                self.i += 1
            elif kind == "(":
                self.arguments()
            elif kind == "[":
                self.i += 1
                self.expression()
                self.need("]", "comma or closer expected")
            else:
                return

    def literal(self, structs: bool) -> None:
        """The fields of a struct behind its path."""
        if structs and self.kinds[self.i] == "{" and self.kinds[self.i - 1] in (WORD, ">"):
            self.i += 1
            self.listed("}", self.field_value)

    def field_value(self) -> None:
        self.attributes()
        if self.take(".."):
            if self.kinds[self.i] != "}":
                self.expression()
            return
        if self.kinds[self.i] == NUMBER:
            self.i += 1
            self.need(":", "value expected")
            self.expression()
            return
        if self.word() == "self":
            raise self.wrong("name expected")
        self.name()
        if self.take(":"):
            self.expression()

    def closure(self, structs: bool = True) -> None:
        if not self.take("||"):
            self.need("|", "parameters expected")
            while self.kinds[self.i] != "|":
                self.attributes()
                self.pattern(False)
                if self.take(":"):
                    self.type()
                if not self.take(","):
                    break
            self.need("|", "comma or closer expected")
        if self.take("->"):
            self.type(False)
            self.block()
        else:
            self.expression(structs)

    def if_(self) -> None:
        while True:
            self.i += 1
            self.expression(False)
            self.block()
            if not self.take_word("else"):
                return
            if self.word() != "if":
                self.block()
                return

    def match(self) -> None:
        self.i += 1
        self.expression(False)
        self.need("{", "block expected")
        self.attributes(True)
        while self.kinds[self.i] != "}":
            self.attributes()
            self.pattern()
            if self.take_word("if"):
                self.expression()
            self.need("=>", "arm without an arrow")
            if self.kinds[self.i] in (",", "}"):
                raise self.wrong("arm without a value")
            if self.kinds[self.i] == "{":
                self.block()
                if self.kinds[self.i] in (".", "?"):
                    self.expression(True, True)
                    if not self.take(",") and self.kinds[self.i] != "}":
                        raise self.wrong("comma or closer expected")
                else:
                    self.take(",")
            else:
                block = self.word() in _BLOCKS
                self.expression()
                if not self.take(",") and self.kinds[self.i] != "}" and not (block and self.kinds[self.i - 1] == "}"):
                    raise self.wrong("comma or closer expected")
        self.i += 1
