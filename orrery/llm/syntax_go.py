"""The pushdown pass over the tokens of Go source: a reader of its grammar that goes down a level at every opener.

A line end counts as a semicolon behind a value, a closer and a few words, as the language has it.
"""

from __future__ import annotations

from orrery.sources.lexing import NUMBER, STRING, WORD, Source

_KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_ENDING = frozenset("break continue fallthrough return".split())
_CLOSERS = frozenset((NUMBER, STRING, ")", "]", "}", "++", "--"))
_BINARY = frozenset("|| && == != < <= > >= + - | ^ * / % << >> & &^".split())
_ASSIGN = frozenset(":= = += -= *= /= %= &= |= ^= <<= >>= &^=".split())
_UNARY = frozenset("+ - ! ^ * & <- ~".split())
_TYPE_WORDS = frozenset("struct map chan interface func".split())


class _Wrong(Exception):
    """The first thing that is not valid: the number of its token and the reason."""


def fault_of(source: Source) -> tuple[int, str] | None:
    """Offset and reason of the first thing found that is not valid, or None."""
    reader = _Reader(source)
    try:
        reader.file()
    except _Wrong as wrong:
        at, why = wrong.args
        return (source.starts[at] if at < reader.n else len(source.text)), why
    except RecursionError:
        return None
    return None


class _Reader:
    def __init__(self, s: Source):
        self.kinds, self.values, self.begins, self.n, self.i = [*s.kinds, ""], [*s.values, ""], s.begins, len(s.kinds), 0
        # The token before which a line end was taken as the semicolon it stands for.
        self.fresh = -1
        # Whether a specification is the first of its group: only later constants may repeat the value above.
        self.first = True

    # Tokens.

    def wrong(self, why: str) -> _Wrong:
        return _Wrong(self.i, why)

    def ended(self) -> bool:
        """Whether a line end, or the end of the file, stands before the next token as a semicolon."""
        i = self.i
        if i >= self.n:
            return True
        if i == self.fresh or not i or not self.begins[i]:
            return False
        kind = self.kinds[i - 1]
        if kind == WORD:
            word = self.values[i - 1]
            return word not in _KEYWORDS or word in _ENDING
        return kind in _CLOSERS

    def at(self, mark: str) -> bool:
        """Whether the next token is this mark, with no semicolon before it."""
        return self.kinds[self.i] == mark and not self.ended()

    def word(self) -> str:
        """The next token if it is a word, else nothing."""
        return self.values[self.i] if self.kinds[self.i] == WORD else ""

    def take(self, mark: str) -> bool:
        if self.kinds[self.i] == mark and not self.ended():
            self.i += 1
            return True
        return False

    def need(self, mark: str, why: str) -> None:
        if not self.take(mark):
            raise self.wrong(why)

    def name(self) -> None:
        if self.kinds[self.i] != WORD or self.values[self.i] in _KEYWORDS or self.ended():
            raise self.wrong("name expected")
        self.i += 1

    def end(self) -> None:
        """The end of a statement."""
        if self.kinds[self.i] == ";":
            self.i += 1
        elif self.ended():
            self.fresh = self.i
        elif self.kinds[self.i] not in (")", "}"):
            raise self.wrong("two values with nothing between")

    def closer(self, mark: str) -> None:
        """A closer, which may begin a line only behind a comma or an opener."""
        if self.kinds[self.i] != mark:
            raise self.wrong("comma or closer expected")
        if self.ended():
            raise self.wrong("missing comma before the line end")
        self.i += 1

    # Declarations.

    def file(self) -> None:
        if not self.n or self.values[0] != "package" or self.kinds[0] != WORD:
            raise _Wrong(0, "no package clause")
        self.i = 1
        if self.ended():
            raise self.wrong("no package clause")
        self.name()
        self.end()
        imports = True
        while self.i < self.n:
            word = self.word()
            if self.kinds[self.i] == ";":
                self.i += 1
                continue
            if word == "import":
                if not imports:
                    raise self.wrong("import behind a declaration")
                self.group(self.import_spec)
            elif word == "func":
                imports = False
                self.i += 1
                self.function()
            elif word in ("var", "const", "type"):
                imports = False
                self.declaration(word)
            else:
                raise self.wrong("not a declaration")
            self.end()
            if self.kinds[self.i] in (")", "}"):
                raise self.wrong("closer without opener")

    def group(self, spec) -> None:
        """One specification, or several in parentheses."""
        self.i += 1
        self.first = True
        if self.ended() and self.i < self.n:
            raise self.wrong("specification expected")
        if self.kinds[self.i] != "(":
            spec()
            return
        self.i += 1
        while self.kinds[self.i] != ")":
            if self.i >= self.n:
                raise self.wrong("premature end")
            spec()
            self.first = False
            self.end()
        self.i += 1

    def import_spec(self) -> None:
        if self.kinds[self.i] == "." or self.kinds[self.i] == WORD:
            self.i += 1
        if self.kinds[self.i] != STRING or self.values[self.i][0] == "'":
            raise self.wrong("path expected")
        self.i += 1

    def declaration(self, word: str) -> None:
        self.group({"var": self.var_spec, "const": self.const_spec, "type": self.type_spec}[word])

    def names(self) -> None:
        self.name()
        while self.take(","):
            self.name()

    def var_spec(self) -> None:
        self.names()
        if not self.at("="):
            self.type()
        if self.take("="):
            self.expressions()

    def const_spec(self) -> None:
        self.names()
        if not self.first and (self.ended() or self.kinds[self.i] in (";", ")")):
            return
        if not self.at("="):
            self.type()
        self.need("=", "value expected")
        self.expressions()

    def type_spec(self) -> None:
        self.name()
        if self.at("[") and self._generic():
            self.type_parameters()
        self.take("=")
        self.type()

    def _generic(self) -> bool:
        """Whether a bracket holds type parameters and not the length of an array."""
        i = self.i + 1
        if self.kinds[i] != WORD or self.values[i] in _KEYWORDS:
            return False
        after = self.kinds[i + 1]
        return after in (WORD, ",", "[", "~", "*", "(") and not (after == "*" and self.kinds[i + 3] == "]" and self.kinds[i + 2] == NUMBER)

    def type_parameters(self) -> None:
        self.i += 1
        while True:
            self.names()
            self.constraint()
            if not self.take(","):
                break
            if self.kinds[self.i] == "]":
                break
        self.closer("]")

    def constraint(self) -> None:
        while True:
            self.take("~")
            self.type()
            if not self.take("|"):
                return

    def function(self) -> None:
        if self.at("("):
            self.parameters()
        self.name()
        if self.at("["):
            self.type_parameters()
        self.signature()
        if self.at("{"):
            self.block()

    def signature(self) -> None:
        if not self.at("("):
            raise self.wrong("parameters expected")
        self.parameters()
        if self.at("("):
            self.parameters()
        elif not self.ended() and self._begins_type():
            self.type()

    def parameters(self) -> None:
        self.i += 1
        while self.kinds[self.i] != ")":
            if self.take("..."):
                self.type()
            else:
                self.type()
                if not self.ended() and self.kinds[self.i] not in (",", ")"):
                    self.take("...")
                    self.type()
            if not self.take(","):
                break
        self.closer(")")

    # Types.

    def _begins_type(self) -> bool:
        kind = self.kinds[self.i]
        if kind == WORD:
            return self.values[self.i] not in _KEYWORDS or self.values[self.i] in _TYPE_WORDS
        return kind in ("*", "[", "(", "<-")

    def type(self) -> None:
        if self.ended():
            raise self.wrong("type expected")
        kind = self.kinds[self.i]
        if kind == WORD:
            word = self.values[self.i]
            if word not in _KEYWORDS:
                self.i += 1
                if self.take("."):
                    self.name()
                if self.at("[") and self.kinds[self.i + 1] != "]":
                    self.i += 1
                    self.type()
                    while self.take(","):
                        if self.kinds[self.i] == "]":
                            break
                        self.type()
                    self.closer("]")
                return
            if word not in _TYPE_WORDS:
                raise self.wrong("keyword in the place of a type")
            self.i += 1
            if word == "func":
                self.signature()
            elif word == "map":
                self.need("[", "key expected")
                self.type()
                self.closer("]")
                self.type()
            elif word == "chan":
                self.take("<-")
                self.type()
            else:
                self.need("{", "fields expected")
                self.fields(word == "struct")
        elif kind == "*":
            self.i += 1
            self.type()
        elif kind == "[":
            self.i += 1
            if not self.take("]"):
                if not self.take("..."):
                    self.expression()
                self.closer("]")
            self.type()
        elif kind == "(":
            self.i += 1
            self.type()
            self.closer(")")
        elif kind == "<-":
            self.i += 1
            if self.word() != "chan":
                raise self.wrong("type expected")
            self.type()
        else:
            raise self.wrong("type expected")

    def fields(self, struct: bool) -> None:
        while self.kinds[self.i] != "}":
            if self.i >= self.n:
                raise self.wrong("premature end")
            if self.kinds[self.i] == ";":
                self.i += 1
                continue
            if not struct:
                if self.kinds[self.i] == WORD and self.kinds[self.i + 1] == "(":
                    self.name()
                    self.signature()
                else:
                    self.constraint()
            else:
                if self.kinds[self.i] == "*":
                    self.type()
                else:
                    start = self.i
                    self.name()
                    if self.at(","):
                        while self.take(","):
                            self.name()
                        self.type()
                    elif self.at(".") or self.ended() or self.kinds[self.i] in ("}", ";", STRING):
                        self.i = start
                        self.type()
                    elif self.at("[") and self._embedded_generic():
                        self.i = start
                        self.type()
                    else:
                        self.type()
                if self.kinds[self.i] == STRING and not self.ended():
                    self.i += 1
            self.end()
        self.i += 1

    def _embedded_generic(self) -> bool:
        """Whether ``Name[...]`` ends its line: an embedded type with arguments."""
        depth, k = 0, self.i
        while k < self.n:
            if self.kinds[k] == "[":
                depth += 1
            elif self.kinds[k] == "]":
                depth -= 1
                if not depth:
                    return k > self.i + 1 and (k + 1 >= self.n or bool(self.begins[k + 1]) or self.kinds[k + 1] in ("}", ";", STRING))
            k += 1
        return False

    # Statements.

    def block(self) -> None:
        self.i += 1
        self.statements()
        if self.kinds[self.i] != "}":
            raise self.wrong("premature end")
        self.i += 1

    def statements(self) -> None:
        while True:
            kind = self.kinds[self.i]
            if kind == "}" or self.i >= self.n:
                return
            if kind == WORD and self.values[self.i] in ("case", "default"):
                return
            if kind == ";":
                self.i += 1
                continue
            self.statement()
            self.end()
            if self.kinds[self.i] == ")":
                raise self.wrong("closer without opener")

    def statement(self) -> None:
        word = self.word()
        if word in _KEYWORDS:
            if word in ("var", "const", "type"):
                self.declaration(word)
            elif word == "return":
                self.i += 1
                if not self.ended() and self.kinds[self.i] not in (";", "}"):
                    self.expressions()
            elif word in ("break", "continue", "goto"):
                self.i += 1
                if word == "goto" or not self.ended() and self.kinds[self.i] == WORD:
                    self.name()
            elif word == "fallthrough":
                self.i += 1
            elif word == "if":
                self.if_statement()
            elif word == "for":
                self.for_statement()
            elif word == "switch":
                self.switch_statement()
            elif word == "select":
                self.i += 1
                self.need("{", "block expected")
                self.cases(True)
            elif word in ("go", "defer"):
                self.i += 1
                self.expression()
                if self.kinds[self.i - 1] != ")":
                    raise self.wrong("call expected")
            elif word == "func" and self.kinds[self.i + 1] == WORD:
                raise self.wrong("function declared in a block")
            elif word in _TYPE_WORDS:
                self.simple()
            else:
                raise self.wrong("keyword in the place of a statement")
        elif self.kinds[self.i] == "{":
            self.block()
        elif word and self.kinds[self.i + 1] == ":" and not self.begins[self.i + 1]:
            # A label, with or without a statement.
            self.i += 2
            if self.kinds[self.i] not in ("}", ";") and self.i < self.n:
                self.statement()
        else:
            self.simple()

    def simple(self, header: bool = False, ranged: bool = False) -> str:
        """A simple statement; tells whether it was an ``expression``, a ``range`` or something else."""
        if ranged and self.word() == "range":
            self.i += 1
            self.expression(header)
            return "range"
        start = self.i
        self.expressions(header)
        kind = self.kinds[self.i]
        if self.ended():
            return "expression"
        if kind in _ASSIGN:
            if kind == ":=" and any(self.kinds[k] not in (WORD, ",") for k in range(start, self.i)):
                raise self.wrong("assignment to no name")
            if self.kinds[self.i - 1] in (NUMBER, STRING) and self.i == start + 1:
                raise self.wrong("assignment to what holds no value")
            self.i += 1
            if ranged and self.word() == "range":
                self.i += 1
                self.expression(header)
                return "range"
            self.expressions(header)
            return "other"
        if kind in ("++", "--"):
            self.i += 1
            return "other"
        if kind == "<-":
            self.i += 1
            self.expression(header)
            return "other"
        return "expression"

    def body(self) -> None:
        if not self.at("{"):
            raise self.wrong("block expected")
        self.block()

    def if_statement(self) -> None:
        while True:
            self.i += 1
            kind = "other"
            if not self.at(";"):
                if self.at("{"):
                    raise self.wrong("condition without a value")
                kind = self.simple(True)
            if self.at(";") or self.ended() and self.kinds[self.i] != "{":
                self.end()
                if self.at("{"):
                    raise self.wrong("condition without a value")
                kind = self.simple(True)
            if kind != "expression":
                raise self.wrong("condition without a value")
            self.body()
            if self.word() != "else" or self.ended():
                return
            self.i += 1
            if self.word() == "if":
                continue
            self.body()
            return

    def for_statement(self) -> None:
        self.i += 1
        if not self.at("{"):
            kind = "other" if self.at(";") else self.simple(True, True)
            if kind != "range" and self.at(";"):
                self.i += 1
                if not self.at(";"):
                    if self.simple(True) != "expression":
                        raise self.wrong("condition without a value")
                self.need(";", "semicolon expected")
                if not self.at("{"):
                    self.simple(True)
            elif kind == "other":
                raise self.wrong("condition without a value")
        self.body()

    def switch_statement(self) -> None:
        self.i += 1
        if not self.at("{"):
            if not self.at(";"):
                self.simple(True)
            if self.take(";") and not self.at("{"):
                self.simple(True)
        self.need("{", "block expected")
        self.cases(False)

    def cases(self, select: bool) -> None:
        while self.kinds[self.i] != "}":
            word = self.word()
            if word == "case":
                self.i += 1
                if select:
                    self.simple()
                else:
                    self.expressions()
            elif word == "default":
                self.i += 1
            else:
                raise self.wrong("case expected")
            self.need(":", "colon expected")
            self.statements()
            if self.i >= self.n:
                raise self.wrong("premature end")
        self.i += 1

    # Expressions.

    def expressions(self, header: bool = False) -> None:
        self.expression(header)
        while self.take(","):
            self.expression(header)

    def expression(self, header: bool = False) -> None:
        """One expression; in a ``header`` a brace behind a name opens the body and no literal."""
        kinds, values = self.kinds, self.values
        while True:
            while kinds[self.i] in _UNARY:
                self.i += 1
            self.operand(header)
            if kinds[self.i] in _BINARY and not self.ended():
                self.i += 1
                continue
            return

    def operand(self, header: bool) -> None:
        kinds, values = self.kinds, self.values
        i = self.i
        kind = kinds[i]
        literal = False
        if kind == WORD:
            word = values[i]
            if word not in _KEYWORDS:
                if self.ended():
                    raise self.wrong("operator without its value")
                self.i += 1
                literal = not header
            elif word == "func":
                self.i += 1
                self.signature()
                if self.at("{"):
                    self.block()
            elif word in _TYPE_WORDS:
                self.type()
                literal = True
            else:
                raise self.wrong("operator without its value")
        elif kind == NUMBER or kind == STRING:
            if self.ended():
                raise self.wrong("operator without its value")
            self.i += 1
        elif kind == "(":
            self.i += 1
            if self._type_ahead():
                self.type()
            else:
                self.expression()
            self.closer(")")
        elif kind == "[":
            self.type()
            literal = True
        else:
            raise self.wrong("operator without its value")
        while not self.ended():
            kind = kinds[self.i]
            if kind == ".":
                self.i += 1
                if self.take("("):
                    if self.word() == "type":
                        self.i += 1
                    else:
                        self.type()
                    self.closer(")")
                else:
                    self.name()
            elif kind == "(":
                self.i += 1
                self.arguments()
                literal = False
            elif kind == "[":
                self.i += 1
                self.index()
            elif kind == "{" and literal:
                self.elements()
            else:
                return

    def _type_ahead(self) -> bool:
        """Whether a parenthesis holds a type that is no expression too."""
        kind = self.kinds[self.i]
        return kind == "<-" and self.values[self.i + 1] == "chan" or kind == "*" and self.kinds[self.i + 1] == "["

    def arguments(self) -> None:
        while self.kinds[self.i] != ")":
            self.expression()
            self.take("...")
            if not self.take(","):
                break
        self.closer(")")

    def index(self) -> None:
        colons, values = 0, 0
        while self.kinds[self.i] != "]":
            if self.take(":"):
                colons += 1
                if colons > 2:
                    raise self.wrong("two values with nothing between")
                continue
            self.expression()
            values += 1
            if not colons and self.take(","):
                continue
            if self.kinds[self.i] not in (":", "]"):
                raise self.wrong("comma or closer expected")
        if not colons and not values:
            raise self.wrong("operator without its value")
        self.closer("]")

    def elements(self) -> None:
        self.i += 1
        while self.kinds[self.i] != "}":
            self.element()
            if self.take(":"):
                self.element()
            if not self.take(","):
                break
        self.closer("}")

    def element(self) -> None:
        if self.kinds[self.i] == "{":
            self.elements()
        else:
            self.expression()
