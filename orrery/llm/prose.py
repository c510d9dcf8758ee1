"""Whether documentation says something about its function in prose (problem 1)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

# Words of tags, directives and remarks, as they stand in source files.
#: Directives of tools.
DIRECTIVES = (
    r"eslint|tslint|jshint|jslint|biome-ignore|prettier-ignore|noqa|nosec|pylint|flake8|mypy|pyright|ruff|isort|fmt:|yapf|type:\s*ignore|ts-ignore|ts-nocheck|ts-expect-error|@ts-"
    r"|nolint|lint:|go:|\+build|rustfmt|clippy|istanbul|c8 ignore|v8 ignore|coverage|pragma|webpack|sourcemapping|@flow|@jsx|@license|@preserve|spdx|stylelint|cspell|codespell|spell-?checker|sonar|nosonar|region|endregion|vim:|-\*-"
)
#: Remarks that documentation is missing or to come.
MISSING = (
    r"todo|fixme|xxx|hack|tbd|tbc|wip|undocumented|not documented|no (?:docs?|documentation|description|comment)s?\b|missing (?:docs?|documentation|description)|(?:docs?|documentation|description|comment)s? (?:is |are )?(?:missing|goes here|to come|to follow|pending|needed|wanted|later|will follow|coming)"
    r"|(?:add|write|insert|put|fill in|needs?) (?:a |some |the |more )?(?:docs?|documentation|description|comment)|to be (?:documented|described|written|done|completed)|auto-?generated (?:method|function|constructor|stub|documentation|comment)|(?:method|function) stub|describe (?:me|this|here)|your description|placeholder|lorem ipsum|n/?a\b|please document"
)
#: Pointers to another place.
POINTERS = r"see\b|cf\b|refer to|same as|as above|as before|as in\b|ditto|like above|idem|siehe|voir|vid\.|see also|documented (?:in|at|elsewhere|above)|described (?:in|at|elsewhere|above)|(?:docs?|documentation) (?:in|at|lives?|is in|see)|check the|look at"
#: Headings of sections, without content of their own.
HEADINGS = r"(?:args|arguments|parameters?|params|returns?|yields?|raises|throws|errors?|panics|safety|examples?|notes?|see also|attributes|usage|description|summary|remarks|warnings?|type parameters|keyword arguments)"
#: Words that only say what a declaration is, or bind others.
PLAIN = frozenset(
    "a an the this that it is are be to of in on at by for and or with from as its needs need takes take returns return gives get set function method func def fn procedure routine"
    " helper class constructor callback handler arrow async static public private param params parameter parameters arg args argument arguments value values void none null nothing result results".split()
)

_FENCE = re.compile(r"^(?:```|~~~).*?^(?:```|~~~)[^\n]*$", re.M | re.S)
_TAG = re.compile(r"^[@\\](\w+)\s*(?:\{[^}]*\}+)?\s*(.*)$", re.S)
_FIELD = re.compile(r"^:(\w+)(?:\s+[^:]*)?:\s*(.*)$", re.S)
_NAMED_TAGS = frozenset("param arg argument property prop template typeparam tparam throws exception raises".split())
_HEADING = re.compile(rf"^(?:#+\s*)?{HEADINGS}\s*:?\s*$", re.I)
_MISSING = re.compile(rf"^\W*(?:{MISSING})", re.I)
_MISSING_ANYWHERE = re.compile(r"(?i)\b(?:undocumented|not documented|(?:docs?|documentation|description) (?:is |are )?(?:missing|goes here|to come|to follow|pending)|write (?:the )?docs|no docs yet)\b")
_POINTER = re.compile(rf"^\W*(?:{POINTERS})", re.I)
_DIRECTIVE = re.compile(rf"^\W*(?:{DIRECTIVES})", re.I)
_CODE = re.compile(r"[;{}]\s*$|^[\w.$\[\]]+\s*(?::=|[-+*/|&]?=)(?!=)\s*\S|^[\w.$]+\([^)]*\)\s*$|^(?:>>>|\$ )|^(?:return|import|from|const|let|var|if|for|while)\b.*[(={:;]\s*\S*$|^[\w.$]+\(.*\)\s*[.;,]?$|=>")
_WORD = re.compile(r"[^\W\d_]+")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_PART = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[^\W\d_A-Za-z]+")


@lru_cache(maxsize=100_000)
def parts_of(name: str) -> frozenset[str]:
    """The words a name is made of, in lower case."""
    return frozenset([name.lower(), *(x.lower() for x in _PART.findall(name))])


def telling_lines(doc: str) -> Iterator[str]:
    """The lines of a documentation that may say something: without code, rulers, bare tags, directives and remarks."""
    for line in (_FENCE.sub("", doc) if "```" in doc or "~~~" in doc else doc).splitlines():
        line = line.strip().strip("=-*~_#/ ").strip() if not line.strip().startswith(("@", ":", "-*-", "#", "*", "`")) else line.strip()
        line = re.sub(r"^(?:[*+-]|\d+[.)])\s+", "", line)
        if not re.search(r"[^\W\d_]", line):
            continue
        for _ in range(3):
            tag = _TAG.match(line)
            field = None if tag else _FIELD.match(line)
            if tag:
                if _DIRECTIVE.match(line):
                    line = ""
                    break
                line = tag.group(2).strip()
                if tag.group(1).lower() in _NAMED_TAGS:
                    line = re.sub(r"^\[?[\w.$]+\]?(?:=\S+)?\s*[-:–]*\s*", "", line)
            elif field:
                line = field.group(2).strip()
            else:
                break
        line = re.sub(r"^`[^`]*`\s*[-:–]?\s*", "", line) if re.match(r"^`[^`]*`\s*(?:[-:–].*)?$", line) else line
        line = line.lstrip("# ").strip()
        if not line or _HEADING.match(line) or _DIRECTIVE.match(line) or _MISSING.match(line) or _MISSING_ANYWHERE.search(line):
            continue
        if _CODE.search(line) and not re.search(r"[.!?。]$", line.rstrip(";{} ")):
            continue
        if _POINTER.match(line) and len(line.split()) <= 7:
            continue
        yield line


def says_something(doc: str | None, name: str, parameters: tuple[str, ...] = (), least: int = 3) -> bool:
    """Whether the documentation has at least ``least`` words of prose (or six letters of a script without blanks)
    besides the words of the name and the parameters and words that bind others."""
    if not doc:
        return False
    known = PLAIN.union(parts_of(name), *map(parts_of, parameters))
    left, wide = 0, 0
    for line in telling_lines(doc):
        wide += len(_WIDE.findall(line))
        # Identifiers are names, not prose.
        line = re.sub(r"`[^`]*`|\b\w*(?:_\w|[a-z][A-Z])\w*\b|<[^>]*>|https?://\S+", " ", line)
        left += sum(1 for w in _WORD.findall(line) if len(w) > 1 and w.lower() not in known)
        if left >= least or wide >= 6:
            return True
    return False
