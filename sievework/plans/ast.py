"""Expressions of the filter language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

COMPARISONS = ("=", "!=", "<", "<=", ">", ">=")
RELATIONS = (*COMPARISONS, "LIKE", "SOUNDS", "FUZZY", "IN", "BETWEEN")
#: The key's reserved field name.
KEY = "id"


def shown(value: Any) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        return str(int(value))
    return "<nil>" if value is None else str(value)


class Expr:
    def children(self) -> tuple[Expr, ...]:
        return ()

    def walk(self) -> Iterator[Expr]:
        """This node and all below it, parents first."""
        wait: list[Expr] = [self]
        while wait:
            now = wait.pop()
            yield now
            wait.extend(reversed(now.children()))

    def __and__(self, other: Expr) -> Expr:
        return And(self, other)

    def __or__(self, other: Expr) -> Expr:
        return Or(self, other)

    def __invert__(self) -> Expr:
        return Not(self)


@dataclass(frozen=True)
class TrueE(Expr):
    def __str__(self) -> str:
        return "TRUE"


@dataclass(frozen=True)
class FalseE(Expr):
    def __str__(self) -> str:
        return "FALSE"


@dataclass(frozen=True)
class Term(Expr):
    """A field, an operator and one value. user: the operator is one that the field defines."""

    field: str
    op: str
    value: Any
    user: bool = False

    def __str__(self) -> str:
        return f"{self.field} {self.op} {shown(self.value)}"


@dataclass(frozen=True)
class TermMany(Expr):
    field: str
    op: str
    values: tuple
    user: bool = False

    def __str__(self) -> str:
        return f"{self.field} {self.op} [{' '.join(map(shown, self.values))}]"


@dataclass(frozen=True)
class _Pair(Expr):
    left: Expr
    right: Expr

    def children(self) -> tuple[Expr, ...]:
        return self.left, self.right

    def __str__(self) -> str:
        parts: list[str] = []
        e: Expr = self
        while isinstance(e, _Pair):  # long chains grow to the left
            parts += [str(e.right), e.word]
            e = e.left
        return " ".join([str(e), *reversed(parts)])


@dataclass(frozen=True)
class And(_Pair):
    word = "AND"
    __str__ = _Pair.__str__


@dataclass(frozen=True)
class Or(_Pair):
    word = "OR"
    __str__ = _Pair.__str__


@dataclass(frozen=True)
class AndNot(_Pair):
    word = "ANDNOT"
    __str__ = _Pair.__str__


@dataclass(frozen=True)
class Not(Expr):
    child: Expr

    def children(self) -> tuple[Expr, ...]:
        return (self.child,)

    def __str__(self) -> str:
        return f" NOT({self.child}) "
