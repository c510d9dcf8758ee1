"""The pushdown pass over the tokens of JavaScript and TypeScript: a reader of their grammar that goes down a level at
every opener. Where a text can be read in two ways, the likelier one is tried first and the other if it fails.
"""

from __future__ import annotations

from orrery.sources.lexing import NUMBER, STRING, WORD, Source

_RESERVED = frozenset("break case catch class const continue debugger default delete do else enum export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false".split())
_VALUES = frozenset("this super null true false".split())
_BINARY = frozenset("+ - * / % ** & | ^ && || ?? == != === !== < <= <<".split())
_ASSIGN = frozenset("= += -= *= /= %= **= <<= &= |= ^= &&= ||= ??=".split())
_PREFIX = frozenset("+ - ! ~".split())
_PREFIX_WORDS = frozenset("typeof void delete".split())
_MEMBER_WORDS = frozenset("static async get set accessor public private protected readonly abstract override declare".split())
_JS_MEMBER_WORDS = frozenset("static async get set accessor".split())
_PARAMETER_WORDS = frozenset("public private protected readonly override".split())
#: What follows the name of a member that is not a modifier.
_AFTER_KEY = frozenset(("(", "=", ";", "}", ":", "?", "!", "<", ",", ""))
_FLAGS = frozenset("dgimsuvy")


class _Wrong(Exception):
    """The first thing that is not valid: the number of its token and the reason."""


def fault_of(source: Source, ts: bool) -> tuple[int, str] | None:
    """Offset and reason of the first thing found that is not valid, or None."""
    reader = _Reader(source, ts)
    try:
        reader.file()
    except _Wrong as wrong:
        at, why = wrong.args
        return (source.starts[at] if at < reader.n else len(source.text)), why
    except RecursionError:
        return None
    return None


class _Reader:
    def __init__(self, s: Source, ts: bool):
        self.kinds, self.values, self.begins = [*s.kinds, "", "", ""], [*s.values, "", "", ""], [*s.begins, 1, 1, 1]
        self.starts, self.partner, self.n, self.i, self.ts = [*s.starts, 1 << 60, 1 << 61, 1 << 62], s.partner, len(s.kinds), 0, ts
        # Open functions; namespaces and top level, where imports may stand; no arrow with a result type in a condition's middle;
        # the part of a conditional type behind its word extends; what is only declared; arrows with a result type so far.
        self.functions, self.outer, self.plain_arrows, self.in_extends, self.ambient, self.typed = 0, True, False, False, False, 0

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

    def take_word(self, word: str) -> bool:
        if self.kinds[self.i] == WORD and self.values[self.i] == word:
            self.i += 1
            return True
        return False

    def name(self) -> None:
        """A name that may be bound."""
        if self.kinds[self.i] != WORD or self.values[self.i] in _RESERVED or self.values[self.i][0] == "#":
            raise self.wrong("name expected")
        self.i += 1

    def end(self) -> None:
        """The end of a statement: a semicolon, a closing brace or a line end."""
        if self.kinds[self.i] == ";":
            self.i += 1
        elif self.kinds[self.i] != "}" and not self.begins[self.i]:
            raise self.wrong("two values with nothing between")

    def tried(self, read) -> bool:
        """Whether a reading works; if not, nothing is taken."""
        start, functions = self.i, self.functions
        try:
            read()
            return True
        except _Wrong:
            self.i, self.functions = start, functions
            return False

    # Statements.

    def file(self) -> None:
        self.statements("")
        if self.i < self.n:
            raise self.wrong("closer without opener")

    def statements(self, closer: str) -> None:
        while self.i < self.n and self.kinds[self.i] != "}":
            self.statement()
        if closer and self.kinds[self.i] != closer:
            raise self.wrong("premature end")

    def block(self, outer: bool = False) -> None:
        self.need("{", "block expected")
        was, self.outer = self.outer, outer
        self.statements("}")
        self.outer = was
        self.i += 1

    def function_body(self) -> None:
        self.functions += 1
        plain, self.plain_arrows = self.plain_arrows, False
        self.block()
        self.plain_arrows = plain
        self.functions -= 1

    def statement(self, single: bool = False) -> None:
        kind = self.kinds[self.i]
        if kind == "{":
            self.block()
            return
        if kind == ";":
            self.i += 1
            return
        if kind == "@":
            self.decorators()
            self.take_word("export")
            self.take_word("default")
            if self.ts:
                self.take_word("abstract")
            if self.word() != "class":
                raise self.wrong("decorator of nothing")
            self.class_(True)
            return
        word = self.word()
        if word:
            read = _STATEMENTS.get(word)
            if read and (self.ts or word not in _TS_STATEMENTS):
                if read(self, single):
                    return
            elif self.kinds[self.i + 1] == ":" and word not in _RESERVED:
                self.i += 2
                self.statement()
                return
        self.expression()
        self.end()

    def condition(self) -> None:
        self.i += 1
        self.need("(", "condition without parentheses")
        self.expression()
        self.need(")", "condition without an end")

    def if_(self, _: bool) -> bool:
        self.condition()
        self.statement(True)
        if self.take_word("else"):
            self.statement(True)
        return True

    def while_(self, _: bool) -> bool:
        self.condition()
        self.statement(True)
        return True

    def do(self, _: bool) -> bool:
        self.i += 1
        self.statement(True)
        if self.word() != "while":
            raise self.wrong("while expected")
        self.condition()
        self.take(";")
        return True

    def for_(self, _: bool) -> bool:
        self.i += 1
        self.take_word("await")
        self.need("(", "condition without parentheses")
        if self.kinds[self.i] != ";":
            word = self.word()
            if word in ("var", "const") or word == "let" and self.kinds[self.i + 1] in (WORD, "{", "[") and self.values[self.i + 1] not in ("of", "in") or word in ("using", "await") and self.kinds[self.i + 1] == WORD and self.values[self.i + 1] != "of":
                self.i += 1 if word != "await" else 2
                self.binding()
                if self.ts and self.take(":"):
                    self.type()
                if self.word() not in ("of", "in"):
                    if self.take("="):
                        self.assignment(True)
                    while self.take(","):
                        self.declarator(True, False)
            else:
                self.expression(True)
            if self.take_word("of"):
                self.assignment()
                self.need(")", "condition without an end")
                self.statement(True)
                return True
            if self.take_word("in"):
                self.expression()
                self.need(")", "condition without an end")
                self.statement(True)
                return True
        self.need(";", "semicolon expected")
        if self.kinds[self.i] != ";":
            self.expression()
        self.need(";", "semicolon expected")
        if self.kinds[self.i] != ")":
            self.expression()
        self.need(")", "condition without an end")
        self.statement(True)
        return True

    def variables(self, single: bool) -> bool:
        word = self.word()
        following = self.kinds[self.i + 1]
        if word == "let" and following not in (WORD, "{", "["):
            return False
        if word == "let" and single:
            return False
        if word == "const" and self.ts and self.word(1) == "enum":
            self.i += 1
            return self.enum(single)
        if single and word == "const":
            raise self.wrong("declaration in the place of a statement")
        self.i += 1
        self.declarator(False, word == "const", word)
        while self.take(","):
            self.declarator(False, word == "const", word)
        self.end()
        return True

    def declarator(self, no_in: bool, const: bool, word: str = "") -> None:
        pattern = self.kinds[self.i] in ("{", "[")
        if word in ("let", "const") and self.word() == "let":
            raise self.wrong("reserved word as a name")
        self.binding()
        typed = False
        if self.ts:
            self.take("!")
            if self.take(":"):
                self.type()
                typed = True
        if self.take("="):
            self.assignment(no_in)
        elif (const or pattern) and (not self.ts or not typed) and not self.ambient:
            raise self.wrong("declaration without a value")

    def using(self, _: bool) -> bool:
        if self.word() == "await":
            if self.word(1) != "using" or self.kinds[self.i + 2] != WORD or self.begins[self.i + 2]:
                return False
            self.i += 1
        if self.kinds[self.i + 1] != WORD or self.begins[self.i + 1] or self.word(1) in ("in", "instanceof", "of", "as"):
            return False
        self.i += 1
        self.declarator(False, True)
        self.end()
        return True

    def return_(self, _: bool) -> bool:
        if not self.functions:
            raise self.wrong("return outside a function")
        self.i += 1
        if self.kinds[self.i] not in (";", "}") and not self.begins[self.i]:
            self.expression()
        self.end()
        return True

    def jump(self, _: bool) -> bool:
        self.i += 1
        if self.kinds[self.i] == WORD and not self.begins[self.i]:
            self.name()
        self.end()
        return True

    def throw(self, _: bool) -> bool:
        self.i += 1
        if self.begins[self.i]:
            raise self.wrong("operator without its value")
        self.expression()
        self.end()
        return True

    def try_(self, _: bool) -> bool:
        self.i += 1
        self.block()
        caught = self.take_word("catch")
        if caught:
            if self.take("("):
                self.binding()
                if self.ts and self.take(":"):
                    self.type()
                self.need(")")
            self.block()
        if self.take_word("finally"):
            self.block()
        elif not caught:
            raise self.wrong("try without catch or finally")
        return True

    def switch(self, _: bool) -> bool:
        self.condition()
        self.need("{", "block expected")
        was, self.outer = self.outer, False
        while self.kinds[self.i] != "}":
            if self.take_word("case"):
                self.expression()
            elif not self.take_word("default"):
                raise self.wrong("case expected")
            self.need(":", "colon expected")
            while self.i < self.n and self.kinds[self.i] != "}" and self.word() not in ("case", "default"):
                self.statement()
            if self.i >= self.n:
                raise self.wrong("premature end")
        self.outer = was
        self.i += 1
        return True

    def debugger(self, _: bool) -> bool:
        self.i += 1
        self.end()
        return True

    def function_statement(self, _: bool) -> bool:
        if self.word() == "async":
            if self.word(1) != "function" or self.begins[self.i + 1]:
                return False
            self.i += 1
        self.function(True)
        return True

    def class_statement(self, _: bool) -> bool:
        if self.word() == "abstract":
            if self.word(1) != "class" or self.begins[self.i + 1]:
                return False
            self.i += 1
        self.class_(True)
        return True

    def import_(self, _: bool) -> bool:
        if self.kinds[self.i + 1] in ("(", "."):
            return False
        if not self.outer:
            raise self.wrong("import in a block")
        self.i += 1
        if self.kinds[self.i] == STRING:
            self.i += 1
        else:
            if self.word() in ("type", "defer") and self.ts and (self.kinds[self.i + 1] in ("{", "*") or self.kinds[self.i + 1] == WORD and (self.word(1) != "from" or self.word(2) == "from")):
                self.i += 1
            if self.kinds[self.i] == WORD:
                self.name()
                if self.ts and self.take("="):
                    self.assignment()
                    self.end()
                    return True
                if self.kinds[self.i] != WORD:
                    self.need(",", "from expected")
                    if self.kinds[self.i] not in ("{", "*"):
                        raise self.wrong("names expected")
            if self.take("*"):
                if not self.take_word("as"):
                    raise self.wrong("as expected")
                self.name()
            elif self.kinds[self.i] == "{":
                self.specifiers()
            if not self.take_word("from"):
                raise self.wrong("from expected")
            if self.kinds[self.i] != STRING:
                raise self.wrong("path expected")
            self.i += 1
        self.attributes()
        self.end()
        return True

    def attributes(self) -> None:
        if self.word() in ("with", "assert") and self.kinds[self.i + 1] == "{" and not self.begins[self.i]:
            self.i += 1
            self.object()

    def specifiers(self) -> None:
        """Names in braces, each maybe under another name."""
        self.i += 1
        while self.kinds[self.i] != "}":
            if self.ts and self.word() == "type" and self.kinds[self.i + 1] in (WORD, STRING) and (self.word(1) != "as" or self.word(2) == "as" or self.kinds[self.i + 2] in (",", "}")):
                self.i += 1
            for _ in range(2):
                if self.kinds[self.i] not in (WORD, STRING):
                    raise self.wrong("name expected")
                self.i += 1
                if not self.take_word("as"):
                    break
            if not self.take(","):
                break
        self.need("}", "comma or closer expected")

    def export(self, single: bool) -> bool:
        if not self.outer:
            raise self.wrong("export in a block")
        self.i += 1
        word = self.word()
        if word == "default":
            self.i += 1
            word = self.word()
            if self.kinds[self.i] == "@":
                self.decorators()
                word = self.word()
            if word == "function" or word == "async" and self.word(1) == "function" and not self.begins[self.i + 1]:
                if word == "async":
                    self.i += 1
                self.function(False, True)
            elif word == "class" or word == "abstract" and self.word(1) == "class":
                if word == "abstract":
                    self.i += 1
                self.class_(False)
            elif self.ts and word == "interface":
                self.interface(single)
            else:
                self.assignment()
                self.end()
            return True
        if self.ts and word == "type" and self.kinds[self.i + 1] in ("{", "*"):
            self.i += 1
            word = ""
        if self.take("*"):
            if self.take_word("as"):
                if self.kinds[self.i] not in (WORD, STRING):
                    raise self.wrong("name expected")
                self.i += 1
            if not self.take_word("from"):
                raise self.wrong("from expected")
            self.need(STRING, "path expected")
            self.attributes()
            self.end()
        elif self.kinds[self.i] == "{":
            self.specifiers()
            if self.take_word("from"):
                self.need(STRING, "path expected")
                self.attributes()
            self.end()
        elif self.ts and self.take("="):
            self.expression()
            self.end()
        elif self.ts and word == "as" and self.word(1) == "namespace":
            self.i += 2
            self.name()
            self.end()
        elif self.kinds[self.i] == "@":
            self.statement()
        elif word in ("var", "let", "const", "function", "class", "async") or self.ts and word in ("interface", "type", "enum", "namespace", "module", "declare", "abstract", "import"):
            if not _STATEMENTS[word](self, False):
                raise self.wrong("declaration expected")
        else:
            raise self.wrong("declaration expected")
        return True

    # TypeScript's declarations.

    def interface(self, _: bool) -> bool:
        if self.kinds[self.i + 1] != WORD or self.begins[self.i + 1]:
            return False
        self.i += 1
        self.name()
        self.type_parameters()
        if self.take_word("extends"):
            self.type()
            while self.take(","):
                self.type()
        if self.kinds[self.i] != "{":
            raise self.wrong("members expected")
        self.object_type()
        return True

    def alias(self, _: bool) -> bool:
        if self.kinds[self.i + 1] != WORD or self.begins[self.i + 1] or self.kinds[self.i + 2] not in ("=", "<"):
            return False
        self.i += 1
        self.name()
        self.type_parameters()
        self.need("=", "value expected")
        self.type()
        self.end()
        return True

    def enum(self, _: bool) -> bool:
        self.i += 1
        self.name()
        self.need("{", "members expected")
        while self.kinds[self.i] != "}":
            if self.kinds[self.i] not in (WORD, STRING, "["):
                raise self.wrong("name expected")
            self.key()
            if self.take("="):
                self.assignment()
            if not self.take(","):
                break
        self.need("}", "comma or closer expected")
        return True

    def namespace(self, _: bool) -> bool:
        word = self.word()
        if word == "global":
            if self.kinds[self.i + 1] != "{":
                return False
            self.i += 1
        else:
            if self.begins[self.i + 1] or not (self.kinds[self.i + 1] == WORD and self.kinds[self.i + 2] in ("{", ".") or word == "module" and self.kinds[self.i + 1] == STRING):
                return False
            self.i += 2
            while self.take("."):
                self.name()
            if self.kinds[self.i] != "{":
                self.end()
                return True
        functions, self.functions = self.functions, 0
        self.block(True)
        self.functions = functions
        return True

    def declare(self, _: bool) -> bool:
        if self.begins[self.i + 1] or self.word(1) not in ("var", "let", "const", "function", "class", "abstract", "enum", "namespace", "module", "global", "interface", "type", "async"):
            return False
        self.i += 1
        was, self.ambient = self.ambient, True
        found = _STATEMENTS[self.word()](self, False)
        self.ambient = was
        return found

    # Functions and classes.

    def decorators(self) -> None:
        while self.take("@"):
            if self.kinds[self.i] == "(":
                self.i += 1
                self.expression()
                self.need(")")
                continue
            if self.kinds[self.i] != WORD:
                raise self.wrong("decorator expected")
            self.i += 1
            while True:
                if self.take("."):
                    if self.kinds[self.i] != WORD:
                        raise self.wrong("name expected")
                    self.i += 1
                elif self.kinds[self.i] == "(":
                    self.arguments()
                elif not (self.ts and self.kinds[self.i] == "<" and self.tried(self.type_arguments)):
                    break

    def function(self, named: bool, default: bool = False) -> None:
        """From the word ``function``; without a body only in TypeScript."""
        self.i += 1
        self.take("*")
        if self.kinds[self.i] == WORD:
            self.name()
        elif named:
            raise self.wrong("function without a name or parameters")
        self.signature()
        if self.kinds[self.i] == "{":
            self.function_body()
        elif self.ts and (named or default):
            self.end()
        else:
            raise self.wrong("function without a body")

    def signature(self) -> None:
        if self.ts:
            self.type_parameters()
        self.parameters()
        if self.ts and self.take(":"):
            self.type(True)

    def parameters(self) -> None:
        self.need("(", "parameters expected")
        while self.kinds[self.i] != ")":
            if self.kinds[self.i] == "@":
                self.decorators()
            if self.ts:
                while self.word() in _PARAMETER_WORDS and self.kinds[self.i + 1] in (WORD, "{", "["):
                    self.i += 1
            rest = self.take("...")
            if self.ts and self.word() == "this":
                self.i += 1
            else:
                self.binding()
            if self.ts:
                self.take("?")
                if self.take(":"):
                    self.type()
            if self.take("="):
                if rest:
                    raise self.wrong("value of a rest parameter")
                self.assignment()
            if not self.take(","):
                break
            if rest:
                raise self.wrong("parameter behind the last one")
        self.need(")", "comma or closer expected")

    def binding(self) -> None:
        """A name or a pattern that is bound."""
        kind = self.kinds[self.i]
        if kind == "[":
            self.i += 1
            while self.kinds[self.i] != "]":
                if self.take(","):
                    continue
                rest = self.take("...")
                self.binding()
                if not rest and self.take("="):
                    self.assignment()
                if not self.take(","):
                    break
            self.need("]", "comma or closer expected")
        elif kind == "{":
            self.i += 1
            while self.kinds[self.i] != "}":
                if self.take("..."):
                    self.binding()
                else:
                    plain = self.kinds[self.i] == WORD
                    reserved = plain and self.values[self.i] in _RESERVED
                    self.key()
                    if self.take(":"):
                        self.binding()
                    elif not plain or reserved:
                        raise self.wrong("colon expected")
                    if self.take("="):
                        self.assignment()
                if not self.take(","):
                    break
            self.need("}", "comma or closer expected")
        else:
            self.name()

    def key(self) -> None:
        """The name of a member."""
        kind = self.kinds[self.i]
        if kind == "[":
            self.i += 1
            self.assignment()
            self.need("]", "closer expected")
        elif kind == WORD or kind == NUMBER or kind == STRING and self.values[self.i][0] in "\"'":
            self.i += 1
        else:
            raise self.wrong("name expected")

    def class_(self, named: bool) -> None:
        self.i += 1
        if self.kinds[self.i] == WORD and self.values[self.i] not in ("extends", "implements"):
            self.name()
        elif named:
            raise self.wrong("class without a name")
        if self.ts:
            self.type_parameters()
        if self.take_word("extends"):
            self.operand(True)
            if self.ts and self.kinds[self.i] == "<":
                self.type_arguments()
        if self.ts and self.take_word("implements"):
            self.type()
            while self.take(","):
                self.type()
        self.need("{", "class without a body")
        functions, outer = self.functions, self.outer
        self.outer = False
        while self.kinds[self.i] != "}":
            if self.i >= self.n:
                raise self.wrong("premature end")
            self.member()
        self.functions, self.outer = functions, outer
        self.i += 1

    def member(self) -> None:
        kinds = self.kinds
        if self.take(";"):
            return
        if kinds[self.i] == "@":
            self.decorators()
        words = _MEMBER_WORDS if self.ts else _JS_MEMBER_WORDS
        while kinds[self.i] == WORD and self.values[self.i] in words:
            if self.values[self.i] == "static" and kinds[self.i + 1] == "{":
                self.i += 1
                self.function_body()
                return
            if kinds[self.i + 1] in _AFTER_KEY or self.begins[self.i + 1] and self.values[self.i] not in ("static", "public", "private", "protected", "readonly", "abstract", "override"):
                break
            self.i += 1
        self.take("*")
        if self.ts and kinds[self.i] == "[" and kinds[self.i + 1] == WORD and kinds[self.i + 2] == ":":
            self.i += 3
            self.type()
            self.need("]", "closer expected")
            if self.take(":"):
                self.type()
            self.end()
            return
        self.key()
        if self.ts and kinds[self.i] in ("?", "!"):
            self.i += 1
        if kinds[self.i] == "(" or self.ts and kinds[self.i] == "<":
            self.signature()
            if kinds[self.i] == "{":
                self.function_body()
            elif self.ts:
                self.end()
            else:
                raise self.wrong("function without a body")
            return
        if self.ts and self.take(":"):
            self.type()
        if self.take("="):
            self.functions += 1
            self.assignment()
            self.functions -= 1
        self.end()

    # Expressions.

    def expression(self, no_in: bool = False) -> None:
        self.assignment(no_in)
        while self.kinds[self.i] == ",":
            self.i += 1
            self.assignment(no_in)

    def assignment(self, no_in: bool = False) -> None:
        kinds, values = self.kinds, self.values
        target = True
        while True:
            # Marks and words before a value.
            while True:
                kind = kinds[self.i]
                if kind in _PREFIX:
                    self.i += 1
                elif kind == "++" or kind == "--":
                    self.i += 1
                elif kind == WORD and values[self.i] in _PREFIX_WORDS:
                    self.i += 1
                elif kind == WORD and values[self.i] == "await" and kinds[self.i + 1] in (WORD, STRING, NUMBER, "(", "[", "{", "+", "-", "!") and not self.begins[self.i + 1] and self.word(1) not in ("in", "of", "instanceof"):
                    self.i += 1
                elif kind == WORD and values[self.i] == "yield":
                    self.i += 1
                    if self.begins[self.i] or kinds[self.i] in (")", "]", "}", ",", ";", ":", ""):
                        return
                    self.take("*")
                    self.assignment(no_in)
                    return
                elif kind == "<" and self.ts:
                    if self.tried(self.generic_arrow):
                        return
                    # An older way to write ``as``.
                    self.i += 1
                    if not self.take_word("const"):
                        self.type()
                    self.need(">", "closer expected")
                else:
                    break
                target = False
            what = self.operand()
            if what == "arrow":
                if not target:
                    raise self.wrong("function in the place of a value")
                return
            kind = kinds[self.i]
            if (kind == "++" or kind == "--") and not self.begins[self.i]:
                if what not in ("target", "group"):
                    raise self.wrong("assignment to what holds no value")
                self.i += 1
                what = "other"
                kind = kinds[self.i]
            while kind == WORD and self.ts and values[self.i] in ("as", "satisfies") and not self.begins[self.i]:
                self.i += 1
                if self.word() == "const":
                    self.i += 1
                else:
                    self.type()
                what = "group"
                kind = kinds[self.i]
            if kind in _BINARY:
                self.i += 1
            elif kind == ">":
                at = self.i
                while kinds[self.i] == ">" and self.starts[self.i] == self.starts[at] + self.i - at and self.i - at < 3:
                    self.i += 1
                if kinds[self.i] == "=" and self.starts[self.i] == self.starts[at] + self.i - at:
                    shift = self.i - at > 1
                    self.i += 1
                    if shift:
                        if not (target and what in ("target", "group")):
                            raise self.wrong("assignment to what holds no value")
                        self.assignment(no_in)
                        return
            elif kind == WORD and (values[self.i] == "instanceof" or values[self.i] == "in" and not no_in):
                self.i += 1
            elif kind == "?":
                self.i += 1
                self.middle()
                self.need(":", "colon expected")
                self.assignment(no_in)
                return
            elif kind in _ASSIGN:
                if not (target and what in ("target", "group", "pattern")) or what == "pattern" and kind != "=":
                    raise self.wrong("assignment to what holds no value")
                self.i += 1
                self.assignment(no_in)
                return
            else:
                return
            target = False

    def middle(self) -> None:
        """The part of a condition between its question mark and its colon."""
        start, was = self.i, self.plain_arrows
        functions, typed = self.functions, self.typed
        try:
            self.plain_arrows = False
            self.assignment()
            if self.kinds[self.i] == ":":
                self.plain_arrows = was
                return
        except _Wrong:
            # Another reading differs only where an arrow with a result type was taken.
            if self.typed == typed:
                raise
        if self.typed != typed:
            self.i, self.functions, self.plain_arrows = start, functions, True
            self.assignment()
        self.plain_arrows = was

    def arrow_body(self) -> None:
        if self.begins[self.i]:
            raise self.wrong("line end before an arrow")
        self.need("=>", "arrow expected")
        if self.kinds[self.i] == "{":
            self.function_body()
        else:
            self.functions += 1
            self.assignment()
            self.functions -= 1

    def generic_arrow(self) -> None:
        self.type_parameters()
        self.typed_arrow()

    def typed_arrow(self) -> None:
        self.parameters()
        if self.ts and self.take(":"):
            self.type(True)
        self.arrow_body()

    def _arrow_ahead(self) -> bool:
        """Reads an arrow function at a parenthesis, if one stands there."""
        close = self.partner.get(self.i)
        if close is None:
            return False
        after = self.kinds[close + 1]
        if after == "=>":
            self.parameters()
            self.arrow_body()
            return True
        if self.ts and after == ":" and not self.plain_arrows and self.tried(self.typed_arrow):
            self.typed += 1
            return True
        return False

    def template(self) -> None:
        """The parts of a template with what stands between them."""
        while self.values[self.i].endswith("${") and self.values[self.i][0] in "`}":
            self.i += 1
            self.expression()
            if self.kinds[self.i] != STRING or self.values[self.i][0] != "}":
                raise self.wrong("two values with nothing between")
        self.i += 1

    def operand(self, heritage: bool = False) -> str:
        """A value with what hangs on it; tells whether it is a ``target``, a ``pattern``, a ``group``, an ``arrow`` or ``other``."""
        kinds, values = self.kinds, self.values
        kind, what = kinds[self.i], "other"
        if kind == WORD:
            word = values[self.i]
            if kinds[self.i + 1] == "=>" and word not in _RESERVED:
                self.i += 1
                self.arrow_body()
                return "arrow"
            if word == "function":
                self.function(False)
            elif word == "class":
                self.class_(False)
            elif word == "new":
                self.new()
            elif word == "import":
                if kinds[self.i + 1] not in ("(", "."):
                    raise self.wrong("import in the place of a value")
                self.i += 1
            elif word == "async" and not self.begins[self.i + 1] and (self.word(1) == "function" or kinds[self.i + 1] == WORD and kinds[self.i + 2] == "=>" or kinds[self.i + 1] in ("(", "<")):
                self.i += 1
                if self.word() == "function":
                    self.function(False)
                elif kinds[self.i] == WORD:
                    self.name()
                    self.arrow_body()
                    return "arrow"
                elif kinds[self.i] == "<":
                    if self.ts and self.tried(self.generic_arrow):
                        return "arrow"
                    what = "target"
                elif self._arrow_ahead():
                    return "arrow"
            elif word in _RESERVED and word not in _VALUES:
                raise self.wrong("keyword in the place of a value")
            else:
                self.i += 1
                what = "other" if word in _VALUES else "target"
                if word[0] == "#" and self.word() != "in":
                    raise self.wrong("private name in the place of a value")
        elif kind == NUMBER:
            self.i += 1
        elif kind == STRING:
            value = values[self.i]
            if value[0] == "`":
                self.template()
            elif value[0] == "}":
                raise self.wrong("operator without its value")
            else:
                if value[0] == "/":
                    flags = value[value.rindex("/") + 1 :]
                    if len(set(flags)) != len(flags) or not _FLAGS.issuperset(flags):
                        raise self.wrong("flags of a regular expression")
                self.i += 1
        elif kind == "(":
            if self._arrow_ahead():
                return "arrow"
            self.i += 1
            plain, self.plain_arrows = self.plain_arrows, False
            self.expression()
            self.plain_arrows = plain
            self.need(")", "comma or closer expected")
            what = "group"
        elif kind == "[":
            self.array()
            what = "pattern"
        elif kind == "{":
            self.object()
            what = "pattern"
        elif kind == "@":
            self.decorators()
            if self.word() != "class":
                raise self.wrong("decorator of nothing")
            self.class_(False)
        else:
            raise self.wrong("operator without its value")
        while True:
            kind = kinds[self.i]
            if kind == ".":
                if kinds[self.i + 1] != WORD:
                    self.i += 1
                    raise self.wrong("operator without its value")
                self.i += 2
                what = "target"
            elif kind == "(":
                self.arguments()
                what = "other"
            elif kind == "[":
                self.i += 1
                plain, self.plain_arrows = self.plain_arrows, False
                self.expression()
                self.plain_arrows = plain
                self.need("]", "comma or closer expected")
                what = "target"
            elif kind == "?.":
                self.i += 1
                if kinds[self.i] == WORD:
                    self.i += 1
                elif kinds[self.i] not in ("(", "[") and not (kinds[self.i] == STRING and values[self.i][0] == "`") and not (self.ts and kinds[self.i] == "<"):
                    raise self.wrong("operator without its value")
                what = "other"
            elif kind == STRING and values[self.i][0] == "`":
                self.template()
                what = "other"
            elif kind == "!" and self.ts and not self.begins[self.i]:
                self.i += 1
            elif kind == "<" and self.ts:
                start = self.i
                if not self.tried(self.type_arguments) or not (kinds[self.i] in ("(", ")", "]", "}", ",", ";", ":", ".", "?.", "=", "", "==", "===", "!=", "!==", "&&", "||", "??", "?", "{") or kinds[self.i] == STRING and values[self.i][0] == "`" or self.begins[self.i]) or heritage and kinds[self.i] not in ("(",):
                    self.i = start
                    return what
                what = "other"
            else:
                return what

    def new(self) -> None:
        self.i += 1
        if self.take("."):
            if not self.take_word("target"):
                raise self.wrong("target expected")
            return
        kind = self.kinds[self.i]
        if kind == WORD and self.values[self.i] == "new":
            self.new()
        elif kind == WORD and self.values[self.i] == "function":
            self.function(False)
        elif kind == WORD and self.values[self.i] == "class":
            self.class_(False)
        elif kind == WORD:
            if self.values[self.i] in _RESERVED and self.values[self.i] not in _VALUES and not (self.values[self.i] == "import" and self.kinds[self.i + 1] == "."):
                raise self.wrong("keyword in the place of a value")
            self.i += 1
        elif kind == "(":
            self.i += 1
            self.expression()
            self.need(")")
        elif kind in ("[", "{", STRING, NUMBER):
            self.operand()
            return
        else:
            raise self.wrong("operator without its value")
        while True:
            if self.kinds[self.i] == "." and self.kinds[self.i + 1] == WORD:
                self.i += 2
            elif self.kinds[self.i] == "[":
                self.i += 1
                self.expression()
                self.need("]")
            elif self.kinds[self.i] == "!" and self.ts:
                self.i += 1
            elif self.kinds[self.i] == "<" and self.ts:
                if not self.tried(self.type_arguments):
                    return
            else:
                break
        if self.kinds[self.i] == "(":
            self.arguments()

    def arguments(self) -> None:
        self.i += 1
        plain, self.plain_arrows = self.plain_arrows, False
        while self.kinds[self.i] != ")":
            self.take("...")
            self.assignment()
            if not self.take(","):
                break
        self.plain_arrows = plain
        self.need(")", "comma or closer expected")

    def array(self) -> None:
        self.i += 1
        plain, self.plain_arrows = self.plain_arrows, False
        while self.kinds[self.i] != "]":
            if self.take(","):
                continue
            self.take("...")
            self.assignment()
            if not self.take(","):
                break
        self.plain_arrows = plain
        self.need("]", "comma or closer expected")

    def object(self) -> None:
        kinds = self.kinds
        self.need("{", "object expected")
        plain, self.plain_arrows = self.plain_arrows, False
        while kinds[self.i] != "}":
            if self.take("..."):
                self.assignment()
            else:
                while kinds[self.i] == WORD and self.values[self.i] in ("async", "get", "set") and kinds[self.i + 1] not in _AFTER_KEY:
                    self.i += 1
                star = self.take("*")
                bare = kinds[self.i] == WORD
                reserved = bare and (self.values[self.i] in _RESERVED or self.values[self.i][0] == "#")
                self.key()
                if kinds[self.i] == "(" or self.ts and kinds[self.i] == "<":
                    self.signature()
                    if kinds[self.i] != "{":
                        raise self.wrong("function without a body")
                    self.function_body()
                elif star:
                    raise self.wrong("parameters expected")
                elif self.take(":"):
                    self.assignment()
                elif not bare or reserved:
                    raise self.wrong("colon expected")
                elif self.take("="):
                    # Only in a pattern that something is assigned to.
                    self.assignment()
            if not self.take(","):
                break
        self.plain_arrows = plain
        self.need("}", "comma or closer expected")

    # Types.

    def type_parameters(self) -> None:
        if not self.take("<"):
            return
        while True:
            while self.word() in ("const", "in", "out") and self.kinds[self.i + 1] == WORD and not (self.word(1) == "extends"):
                self.i += 1
            self.name()
            if self.take_word("extends"):
                self.type()
            if self.take("="):
                self.type()
            if not self.take(",") or self.kinds[self.i] == ">":
                break
        self.need(">", "closer expected")

    def type_arguments(self) -> None:
        self.need("<")
        while True:
            self.type()
            if not self.take(",") or self.kinds[self.i] == ">":
                break
        self.need(">", "closer expected")

    def type(self, result: bool = False) -> None:
        """A type; as a ``result`` also a predicate."""
        if result and self.word() == "asserts" and self.kinds[self.i + 1] == WORD and not self.begins[self.i + 1]:
            self.i += 2
            if self.take_word("is"):
                self.type()
            return
        if result and self.kinds[self.i] == WORD and self.word(1) == "is" and not self.begins[self.i + 1]:
            self.i += 2
            self.type()
            return
        self.union()
        if self.word() == "extends" and not self.begins[self.i]:
            self.conditional()
        elif self.word() == "extends" and self.kinds[self.i - 1] != "}":
            start = self.i
            if not self.tried(self.conditional):
                self.i = start

    def conditional(self) -> None:
        self.i += 1
        was, self.in_extends = self.in_extends, True
        self.union()
        self.in_extends = was
        self.need("?", "question mark expected")
        self.type()
        self.need(":", "colon expected")
        self.type()

    def union(self) -> None:
        if self.kinds[self.i] in ("|", "&"):
            self.i += 1
        self.simple_type()
        while self.kinds[self.i] in ("|", "&"):
            self.i += 1
            self.simple_type()

    def simple_type(self) -> None:
        kinds, values = self.kinds, self.values
        kind = kinds[self.i]
        if kind == WORD:
            word = values[self.i]
            if word in ("keyof", "unique", "readonly") and kinds[self.i + 1] in (WORD, "(", "[", "{", STRING):
                self.i += 1
                self.simple_type()
                return
            if word in ("keyof", "readonly"):
                raise self.wrong("type expected")
            if word == "infer" and kinds[self.i + 1] == WORD:
                self.i += 2
                if self.word() == "extends":
                    # A bound, unless it is the condition's own word.
                    def bound() -> None:
                        self.i += 1
                        self.union()
                        if self.kinds[self.i] == "?" and not self.in_extends:
                            raise self.wrong("a condition")

                    self.tried(bound)
                return
            if word == "abstract" and self.word(1) == "new":
                self.i += 1
                word = "new"
            if word == "new":
                self.i += 1
                self.type_parameters()
                self.parameters()
                self.need("=>", "arrow expected")
                self.type()
                return
            if word == "asserts" and kinds[self.i + 1] == WORD and not self.begins[self.i + 1]:
                self.type(True)
                return
            if word == "typeof":
                self.i += 1
                if self.word() == "import":
                    self.import_type()
                else:
                    if kinds[self.i] != WORD:
                        raise self.wrong("name expected")
                    self.i += 1
                    while self.take("."):
                        if kinds[self.i] != WORD:
                            raise self.wrong("name expected")
                        self.i += 1
                if kinds[self.i] == "<" and not self.begins[self.i]:
                    self.type_arguments()
            elif word == "import":
                self.import_type()
            else:
                if word in _RESERVED and word not in ("this", "null", "true", "false", "void"):
                    raise self.wrong("keyword in the place of a type")
                self.i += 1
                while kinds[self.i] == ".":
                    self.i += 1
                    if kinds[self.i] != WORD:
                        raise self.wrong("name expected")
                    self.i += 1
                if kinds[self.i] == "<" and not self.begins[self.i]:
                    self.type_arguments()
                elif self.word() == "is" and not self.begins[self.i]:
                    self.i += 1
                    self.type()
                    return
        elif kind == STRING:
            if values[self.i][0] == "`":
                while values[self.i].endswith("${"):
                    self.i += 1
                    self.type()
                    if kinds[self.i] != STRING or values[self.i][0] != "}":
                        raise self.wrong("closer expected")
                self.i += 1
            else:
                self.i += 1
        elif kind == NUMBER:
            self.i += 1
        elif kind == "-" and kinds[self.i + 1] == NUMBER:
            self.i += 2
        elif kind == "{":
            self.object_type()
        elif kind == "[":
            self.i += 1
            while kinds[self.i] != "]":
                self.take("...")
                if kinds[self.i] == WORD and (kinds[self.i + 1] == ":" or kinds[self.i + 1] == "?" and kinds[self.i + 2] == ":"):
                    self.i += 1
                    self.take("?")
                    self.i += 1
                self.type()
                self.take("?")
                if not self.take(","):
                    break
            self.need("]", "comma or closer expected")
        elif kind == "(":
            close = self.partner.get(self.i, self.n)
            if kinds[min(close + 1, self.n)] == "=>" and self.tried(self.function_type):
                return
            self.i += 1
            self.type()
            self.need(")", "closer expected")
        elif kind == "<":
            self.type_parameters()
            self.parameters()
            self.need("=>", "arrow expected")
            self.type(True)
            return
        else:
            raise self.wrong("type expected")
        while kinds[self.i] == "[" and not self.begins[self.i]:
            self.i += 1
            if not self.take("]"):
                self.type()
                self.need("]", "closer expected")

    def function_type(self) -> None:
        self.parameters()
        self.need("=>", "arrow expected")
        self.type(True)

    def import_type(self) -> None:
        self.i += 1
        self.need("(")
        self.type()
        if self.take(","):
            self.object()
        self.need(")")
        while self.take("."):
            self.i += 1
        if self.kinds[self.i] == "<":
            self.type_arguments()

    def object_type(self) -> None:
        kinds = self.kinds
        self.i += 1
        while kinds[self.i] != "}":
            if self.i >= self.n:
                raise self.wrong("premature end")
            if kinds[self.i] in ("+", "-"):
                self.i += 1
            while kinds[self.i] == WORD and self.values[self.i] in ("readonly", "get", "set") and kinds[self.i + 1] in (WORD, STRING, NUMBER, "["):
                self.i += 1
            if kinds[self.i] == WORD and self.values[self.i] == "new" and kinds[self.i + 1] in ("(", "<"):
                self.i += 1
                self.signature()
            elif kinds[self.i] in ("(", "<"):
                self.signature()
            elif kinds[self.i] == "[" and kinds[self.i + 1] == WORD and (kinds[self.i + 2] == ":" or self.word(2) == "in"):
                self.i += 3
                self.type()
                if self.take_word("as"):
                    self.type()
                self.need("]", "closer expected")
                if kinds[self.i] in ("+", "-"):
                    self.i += 1
                self.take("?")
                if self.take(":"):
                    self.type()
            else:
                self.key()
                self.take("?")
                if kinds[self.i] in ("(", "<"):
                    self.signature()
                elif self.take(":"):
                    self.type()
            if kinds[self.i] in (";", ","):
                self.i += 1
            elif kinds[self.i] != "}" and not self.begins[self.i]:
                raise self.wrong("two values with nothing between")
        self.i += 1


#: Readers of statements by their first word; each tells whether it was one.
_STATEMENTS = {
    "if": _Reader.if_, "for": _Reader.for_, "while": _Reader.while_, "with": _Reader.while_, "do": _Reader.do, "switch": _Reader.switch, "try": _Reader.try_, "return": _Reader.return_,
    "throw": _Reader.throw, "break": _Reader.jump, "continue": _Reader.jump, "debugger": _Reader.debugger, "var": _Reader.variables, "let": _Reader.variables, "const": _Reader.variables,
    "using": _Reader.using, "await": _Reader.using, "function": _Reader.function_statement, "async": _Reader.function_statement, "class": _Reader.class_statement, "abstract": _Reader.class_statement,
    "import": _Reader.import_, "export": _Reader.export, "interface": _Reader.interface, "type": _Reader.alias, "enum": _Reader.enum, "namespace": _Reader.namespace,
    "module": _Reader.namespace, "global": _Reader.namespace, "declare": _Reader.declare,
}
_TS_STATEMENTS = frozenset("abstract interface type enum namespace module global declare".split())
