"""Lexers of Python, JavaScript, TypeScript, Go and Rust with a pushdown stack of openers.

A lexer keeps source offsets, marks the tokens that begin a line, and matches brackets on a stack while it reads, so
that code inside strings, templates and comments is never taken for code. What it cannot read (an unterminated
literal, a character no token starts with, a closer without its opener, an opener without its closer) is kept as a
fault with its place.
"""

from __future__ import annotations

import re
from bisect import bisect_right

#: Language of a file by extension.
EXTENSIONS = {
    "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "go": "go", "rs": "rust",
}

#: Kinds of tokens: identifier or keyword, number, string (templates and regular expressions too), lifetime; punctuation is its own kind.
WORD, NUMBER, STRING, LIFETIME = "w", "n", "s", "l"

CLOSER = {"(": ")", "[": "]", "{": "}"}

#: Merge-conflict markers and heads of diff hunks at the start of a line.
CONFLICT = re.compile(r"^(?:<{7}|>{7}|\|{7})(?: .*)?\r?$|^={7}\r?$|^@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@", re.M)

_SPACE = r"[ \t\r\f\v ]*"
_NAME = r"[^\W\d]\w*"
_QUOTED = r"\"(?:[^\"\\\n]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*'"

_JS = re.compile(
    _SPACE + r"""(?:(\n\s*)|(//[^\n]*)|(/\*[^*]*\*+(?:[^/*][^*]*\*+)*/)|(\#?(?:[^\W\d]|\$)[\w$]*)
    |((?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)n?)
    |(""" + _QUOTED + r""")|(`)
    |(\.\.\.|=>|===|!==|\*\*=|&&=|\|\|=|\?\?=|<<=|==|!=|<=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|<<|[-+*/%&|^!~<>=?:;,.(){}\[\]@]))""",
    re.X,
)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-zA-Z]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)")
_GO = re.compile(
    _SPACE + r"""(?:(\n\s*)|(//[^\n]*)|(/\*[^*]*\*+(?:[^/*][^*]*\*+)*/)|(""" + _NAME + r""")
    |((?:0[xX][\da-fA-F_.]+(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)i?)
    |("(?:[^"\\\n]|\\.)*"|`[^`]*`|'(?:[^'\\\n]|\\(?:[abfnrtv\\'"]|x[\da-fA-F]{2}|u[\da-fA-F]{4}|U[\da-fA-F]{8}|[0-7]{3}))')|(\Z(?!\Z))
    |(\.\.\.|<<=|>>=|&\^=|&\^|<-|:=|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|[-+*/%&|^!~<>=:;,.(){}\[\]]))""",
    re.X,
)
_RUST = re.compile(
    _SPACE + r"""(?:(\n\s*)|(//[^\n]*)|(/\*)|((?:r\#)?(?!b?r\#*\"|[bc]\"|b'|cr\#*\")""" + _NAME + r""")
    |((?:0x[\da-fA-F_]+|0b[01_]+|0o[0-7_]+|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?)(?:[iu](?:8|16|32|64|128|size)|f32|f64)?)
    |([bc]?"(?:[^"\\]|\\[\s\S])*"|[bc]?r(\#*)".*?"\7(?!\#)|b?'(?:[^'\\\n]|\\(?:[nrt\\0'"]|x[\da-fA-F]{2}|u\{[\da-fA-F_]{1,8}\}))'|('""" + _NAME + r""")(?!'))
    |(\.\.=|\.\.\.|<<=|::|->|=>|==|!=|<=|&&|\|\||\.\.|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|[-+*/%&|^!~<>=?:;,.(){}\[\]@\#$]))""",
    re.X | re.S,
)
_PY = re.compile(
    _SPACE + r"""(?:(\n\s*)|(\#[^\n]*)|(\\\r?\n)|((?:[rRbBuUfFtT]{1,2}(?=["']))?(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?'''|""" + _QUOTED + r"""))
    |((?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?[\d_]+)?)[jJ]?)
    |(""" + _NAME + r""")
    |(\.\.\.|\*\*=|//=|>>=|<<=|:=|->|==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|\*\*|//|<<|>>|[-+*/%&|^~<>=:;,.(){}\[\]@!]))""",
    re.X,
)
_RUST_COMMENT = re.compile(r"/\*|\*/")
_AFTER_VALUE = frozenset("wns")

#: Words after which a slash in JavaScript starts a regular expression.
_BEFORE_REGEX = frozenset("return typeof instanceof in of new delete void throw case do else yield await".split())


class Source:
    """Tokens of one text: kinds, values, offsets, whether each begins a line, its partner bracket; comments; the first fault."""

    __slots__ = ("text", "language", "kinds", "values", "starts", "begins", "firsts", "partner", "comments", "fault", "_lines")

    def __init__(self, text: str, language: str):
        self.text, self.language = text, language
        self.kinds: list[str] = []
        self.values: list[str] = []
        self.starts: list[int] = []
        self.begins = bytearray()
        self.firsts: list[int] = []
        self.partner: dict[int, int] = {}
        self.comments: list[tuple[int, int]] = []
        self.fault: tuple[int, str] | None = None
        self._lines: list[int] | None = None

    def blame(self, at: int, why: str) -> None:
        if self.fault is None:
            self.fault = (at, why)

    def end(self, i: int) -> int:
        """The offset behind token i."""
        return self.starts[i] + len(self.values[i])

    def line(self, at: int) -> int:
        """The 1-based line of an offset."""
        if self._lines is None:
            self._lines = [m.end() for m in re.finditer("\n", self.text)]
        return bisect_right(self._lines, at) + 1


def without_mark(text: str) -> str:
    """The text without its byte order mark."""
    return text[1:] if text.startswith("﻿") else text


def language_of(path: str) -> str | None:
    """Language by extension, or None."""
    return EXTENSIONS.get(path.rpartition(".")[2].lower()) if "." in path else None


#: Marks that change nothing but the list of tokens.
_PLAIN_MARKS = frozenset("... => === !== == != <= && || ?? ?. ++ -- += -= *= %= &= |= ^= ** << - + * % & | ^ ! ~ > = ? : ; , . @ := <- &^ >= >> :: -> .. ..=".split())


def scan(text: str, language: str, jsx: bool = False) -> Source:
    """Tokens of a text without byte order mark."""
    if language == "python":
        return _scan_python(text)
    out = Source(text, language)
    kinds, values = out.kinds, out.values
    ends: list[int] = []
    add_kind, add_value, add_end = kinds.append, values.append, ends.append
    firsts: list[int] = []
    js, rust = language in ("javascript", "typescript"), language == "rust"
    match = (_JS if js else _GO if language == "go" else _RUST).match
    at, size, fresh = 0, len(text), True
    stack: list[tuple[str, int]] = []
    if js and text.startswith("#!"):
        at = text.find("\n") if "\n" in text else size
    while at < size:
        m = match(text, at)
        if m is None:
            at = _skip_blanks(text, at)
            if at >= size:
                break
            at = _unreadable(out, text, at)
            fresh = True
            continue
        which, at = m.lastindex, m.end()
        if which == 4:
            if fresh:
                firsts.append(len(kinds))
                fresh = False
            add_kind(WORD)
            add_value(m[4])
            add_end(at)
            continue
        if which == 1:
            fresh = True
            continue
        value = m[which]
        begin = at - len(value)
        if which == 8 or which == 9:
            kind = value
            if value not in _PLAIN_MARKS:
                if value in ("/", "/="):
                    r = _REGEX.match(text, begin) if js and not _divides(kinds, values, out) else None
                    if r:
                        kind, at, value = STRING, r.end(), r.group()
                elif value == "<":
                    if jsx and js and not _divides(kinds, values, out):
                        tail = _jsx_end(text, begin)
                        if tail > 0:
                            kind, at, value = STRING, tail, text[begin:tail]
                elif value in "{([":
                    stack.append((value, len(kinds)))
                elif value in "})]":
                    if not stack:
                        out.blame(begin, "closer without opener")
                    elif stack[-1][0] == "`" and value == "}":
                        # The text of a template goes on after its expression.
                        at = _template_end(out, text, begin, at, stack, len(kinds), True)
                        if at < 0:
                            out.blame(begin, "unterminated template")
                            break
                        kind, value = STRING, text[begin:at]
                    elif CLOSER.get(stack[-1][0]) != value:
                        out.blame(begin, "closer of another kind")
                        stack.pop()
                    else:
                        _, opened = stack.pop()
                        out.partner[opened] = len(kinds)
                        out.partner[len(kinds)] = opened
        elif which == 2:
            out.comments.append((begin, at))
            continue
        elif which == 3:
            if rust:
                at = _rust_comment_end(text, begin)
                if at < 0:
                    out.blame(begin, "unterminated comment")
                    break
            if "\n" in text[begin:at]:
                fresh = True
            out.comments.append((begin, at))
            continue
        elif which == 5:
            kind = NUMBER
            if at < size and (text[at].isalnum() or text[at] == "_"):
                out.blame(begin, "malformed number")
        elif which == 7:
            kind, at = STRING, _template_end(out, text, begin, at, stack, len(kinds))
            if at < 0:
                out.blame(begin, "unterminated template")
                break
            value = text[begin:at]
        else:
            # A quote that does not come again is a lifetime.
            kind = LIFETIME if rust and value[0] == "'" and value[-1] != "'" else STRING
        if fresh:
            firsts.append(len(kinds))
            fresh = False
        add_kind(kind)
        add_value(value)
        add_end(at)
    return _finish(out, firsts, ends, stack)


def _finish(out: Source, firsts: list[int], ends: list[int], stack: list[tuple[str, int]]) -> Source:
    out.starts = starts = [e - len(v) for e, v in zip(ends, out.values)]
    if stack:
        out.blame(starts[stack[-1][1]] if stack[-1][1] < len(starts) else len(out.text), "premature end")
    begins = out.begins = bytearray(len(out.kinds))
    for i in firsts:
        if i < len(begins):
            begins[i] = 1
    out.firsts = firsts
    return out


def _skip_blanks(text: str, at: int) -> int:
    while at < len(text) and text[at].isspace():
        at += 1
    return at


def _unreadable(out: Source, text: str, at: int) -> int:
    """Blames what no token starts with; returns where to go on."""
    c = text[at]
    if c in "\"'":
        out.blame(at, "unterminated string")
        end = text.find("\n", at)
        return len(text) if end < 0 else end
    if c == "`" or text.startswith("/*", at):
        out.blame(at, "unterminated literal")
        return len(text)
    out.blame(at, "unexpected character")
    return at + 1


def _rust_comment_end(text: str, at: int) -> int:
    """Block comments nest in Rust."""
    depth = 0
    for m in _RUST_COMMENT.finditer(text, at):
        depth += 1 if m.group() == "/*" else -1
        if depth == 0:
            return m.end()
    return -1


def _template_end(out: Source, text: str, begin: int, after: int, stack: list, index: int, resumed: bool = False) -> int:
    """The end of the next part of a template: behind its last mark, or behind ``${``, which is put on the stack."""
    m = _TEMPLATE.match(text, after)
    if m is None:
        return -1
    if m.group(1) == "`":
        if resumed:
            stack.pop()
    elif not resumed:
        stack.append(("`", index))
    return m.end()


def _divides(kinds: list[str], values: list[str], out: Source) -> bool:
    """Whether a slash (or a less-than sign) after the tokens so far stands between values."""
    if not kinds:
        return False
    kind, value = kinds[-1], values[-1]
    if kind == WORD:
        return value not in _BEFORE_REGEX
    if kind == STRING and value.endswith("${"):
        return False
    if kind in _AFTER_VALUE or kind == "]" or kind == "++" or kind == "--":
        return True
    if kind == ")":
        opened = out.partner.get(len(kinds) - 1)
        return not (opened and values[opened - 1] in ("if", "while", "for", "with"))
    return False


def _jsx_end(text: str, at: int) -> int:
    """The end of a JSX element that starts at ``at``, or -1."""
    depth, i, size = 0, at, len(text)
    tag = re.compile(r"<(/?)([A-Za-z_$][\w$.:-]*)?")
    while i < size:
        if text[i] == "<":
            m = tag.match(text, i)
            i = m.end()
            if m.group(1):
                end = text.find(">", i)
                if end < 0:
                    return -1
                i, depth = end + 1, depth - 1
            else:
                while i < size and text[i] != ">":
                    if text[i] in "\"'":
                        i = text.find(text[i], i + 1)
                        if i < 0:
                            return -1
                        i += 1
                    elif text[i] == "{":
                        i = _braces_end(text, i)
                        if i < 0:
                            return -1
                    elif text[i] in "<();":
                        return -1
                    else:
                        i += 1
                if i >= size:
                    return -1
                closed = text[i - 1] == "/"
                i += 1
                depth += 0 if closed else 1
            if depth == 0:
                return i
        elif text[i] == "{":
            i = _braces_end(text, i)
            if i < 0:
                return -1
        else:
            i += 1
    return -1


def _braces_end(text: str, at: int) -> int:
    depth = 0
    for m in re.compile(r"[{}]|" + _QUOTED + r"|`(?:[^`\\]|\\[\s\S])*`").finditer(text, at):
        if m.group() == "{":
            depth += 1
        elif m.group() == "}":
            depth -= 1
            if depth == 0:
                return m.end()
    return -1


def _scan_python(text: str) -> Source:
    out = Source(text, "python")
    kinds, values = out.kinds, out.values
    ends: list[int] = []
    add_kind, add_value, add_end = kinds.append, values.append, ends.append
    firsts: list[int] = []
    match, at, size, fresh = _PY.match, 0, len(text), True
    stack: list[tuple[str, int]] = []
    while at < size:
        m = match(text, at)
        if m is None:
            at = _skip_blanks(text, at)
            if at >= size:
                break
            at = _unreadable(out, text, at)
            continue
        which, at = m.lastindex, m.end()
        if which == 1:
            fresh = True
            continue
        value = m[which]
        begin = at - len(value)
        outer = not stack
        if which == 6:
            kind = WORD
        elif which == 7:
            kind = value
            if value in CLOSER:
                if fresh and not stack:
                    firsts.append(len(kinds))
                fresh = False
                stack.append((value, len(kinds)))
            elif value in (")", "]", "}"):
                if not stack:
                    out.blame(begin, "closer without opener")
                elif CLOSER[stack[-1][0]] != value:
                    out.blame(begin, "closer of another kind")
                    stack.pop()
                else:
                    _, opened = stack.pop()
                    out.partner[opened] = len(kinds)
                    out.partner[len(kinds)] = opened
        elif which == 2:
            out.comments.append((begin, at))
            continue
        elif which == 3:
            continue
        elif which == 5:
            kind = NUMBER
            if at < size and (text[at].isalnum() or text[at] == "_"):
                # Words may follow a number directly only as operators, as in "1if x else 2".
                if not re.match(r"(?:if|else|and|or|in|is|not|for)\b", text[at : at + 8]):
                    out.blame(begin, "malformed number")
        else:
            kind = STRING
            if len(value) == 2 and text.startswith(value[0] * 3, begin):
                out.blame(begin, "unterminated string")
                break
        if fresh:
            if outer:
                firsts.append(len(kinds))
            fresh = False
        add_kind(kind)
        add_value(value)
        add_end(at)
    return _finish(out, firsts, ends, stack)
