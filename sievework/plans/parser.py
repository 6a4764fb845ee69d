"""The text form of the filter language: a token pattern and a parser by precedence."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from ..errors import ParseError
from .ast import COMPARISONS, And, Expr, Not, Or, Term, TermMany

#: Words that are no field names, in any case.
WORDS = {"and", "or", "not", "in", "like", "true", "false", "fuzzy", "sounds", "between"}
_TOKENS = re.compile(
    r"""(?P<space>[ \t\r\n]+)
    |(?P<word>[A-Za-z_][A-Za-z0-9_]*)
    |(?P<string>"(?:\\.|[^"\\])*(?:"|\\?\Z)|'(?:\\.|[^'\\])*(?:'|\\?\Z))
    |(?P<number>-?[0-9]+(?P<point>\.[0-9]*)?)
    |(?P<sign>!=|<=|>=|[=<>!(),])""",
    re.X | re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_LITERALS = {"STRING", "INT", "FLOAT", "BOOL"}


class Point(float):
    """A number with its digits as written, which decimal columns need."""

    def __new__(cls, digits: str) -> Point:
        made = super().__new__(cls, digits)
        made.digits = digits
        return made


@dataclass(frozen=True)
class Token:
    """kind: IDENT, a literal's kind, EOF, or the word or sign itself in upper case."""

    kind: str
    text: str
    start: int
    end: int

    @property
    def value(self) -> Any:
        if self.kind == "STRING":
            closed = len(self.text) > 1 and self.text[-1] == self.text[0]
            body = self.text[1:-1] if closed else self.text[1:]
            return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), body, flags=re.S)
        if self.kind == "INT":
            return int(self.text)
        if self.kind == "FLOAT":
            return Point(self.text)
        return self.text.lower() == "true"


def tokens(text: str, compat: bool = False) -> list[Token]:
    """All tokens and a last EOF. An unknown character is an error; with compat it ends the text."""
    found, at = [], 0
    while at < len(text):
        m = _TOKENS.match(text, at)
        if m is None:
            if not compat:
                raise ParseError(text, at, repr(text[at]), "a token")
            break
        kind, piece = m.lastgroup, m[0]
        if kind in ("number", "point"):
            kind = "FLOAT" if m["point"] is not None else "INT"
        elif kind == "word":
            word = piece.lower()
            kind = "BOOL" if word in ("true", "false") else word.upper() if word in WORDS else "IDENT"
        elif kind == "sign":
            kind = "NOT" if piece == "!" else piece
        elif kind == "string":
            kind = "STRING"
        if kind != "space":
            found.append(Token(kind, piece, at, m.end()))
        at = m.end()
    found.append(Token("EOF", "", at, at))
    return found


class _Parser:
    def __init__(self, text: str, compat: bool):
        self.text, self.rest = text, iter(tokens(text, compat))
        self.now = next(self.rest)

    def take(self, *kinds: str) -> Token:
        """The token at hand, which must be of one of the kinds, if any are named."""
        token = self.now
        if kinds and token.kind not in kinds:
            raise self.wrong(" or ".join(kinds))
        self.now = next(self.rest, token)
        return token

    def wrong(self, expected: str) -> ParseError:
        return ParseError(self.text, self.now.start, self.now.kind, expected)

    def chain(self, level: int) -> Expr:
        """Left-associative chains: OR binds loosest, then AND."""
        if level == 2:
            return self.unit()
        word, node = (("OR", Or), ("AND", And))[level]
        left = self.chain(level + 1)
        while self.now.kind == word:
            self.take()
            left = node(left, self.chain(level + 1))
        return left

    def unit(self) -> Expr:
        if self.now.kind == "NOT":
            self.take()
            return Not(self.unit())
        if self.now.kind == "(":
            self.take()
            inner = self.chain(0)
            self.take(")")
            return inner
        return self.predicate()

    def predicate(self) -> Expr:
        field, op = self.take("IDENT").text, self.now
        if op.kind in COMPARISONS:
            self.take()
            return Term(field, op.kind, self.literal())
        if op.kind in ("LIKE", "SOUNDS"):
            self.take()
            return Term(field, op.kind, self.take("STRING").value)
        if op.kind == "FUZZY":
            self.take()
            return self.fuzzy(field)
        if op.kind in ("IN", "BETWEEN"):
            self.take()
            return TermMany(field, op.kind, self.literals())
        if op.kind == "IDENT":
            self.take()
            if self.now.kind == "(":
                return TermMany(field, op.text, self.literals(), True)
            return Term(field, op.text, self.literal(), True)
        raise self.wrong("a relation like =, <, in")

    def fuzzy(self, field: str) -> Expr:
        if self.now.kind == "STRING":
            return Term(field, "FUZZY", self.take().value)
        self.take("(")
        value = self.take("STRING").value
        if self.now.kind == ")":
            self.take()
            return Term(field, "FUZZY", value)
        self.take(",")
        distance = self.take("INT").value
        self.take(")")
        return TermMany(field, "FUZZY", (value, distance))

    def literal(self) -> Any:
        return self.take(*sorted(_LITERALS)).value

    def literals(self) -> tuple:
        """A list in parentheses; all of one kind."""
        self.take("(")
        kind = self.now.kind if self.now.kind in _LITERALS else None
        values = [self.literal()]
        while self.now.kind == ",":
            self.take()
            values.append(self.take(kind).value)
        self.take(")")
        return tuple(values)


def parse(text: str, compat: bool = False) -> Expr:
    """The expression of a query text; ParseError if it is none."""
    parser = _Parser(text, compat)
    try:
        found = parser.chain(0)
    except RecursionError:
        raise ParseError(text, parser.now.start, parser.now.kind, "an expression that is nested less deeply") from None
    parser.take("EOF")
    return found
