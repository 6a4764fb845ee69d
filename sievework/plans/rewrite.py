"""Rewrites of expressions that Catalyst doesn't make, or that show in traces.

Semantics are kept: a strict bound stays strict. With compat=True two bounds of a field become a
BETWEEN even where one of them is strict. Fields with many values keep their bounds apart, as each may
hold for another element; nullable fields keep their negations, as a row without a value is in them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from .ast import And, AndNot, Expr, FalseE, Not, Or, Term, TermMany, TrueE

_INVERSE = {">": "<=", "<": ">=", ">=": "<", "<=": ">", "!=": "="}
_LOWER, _UPPER = (">", ">="), ("<", "<=")


def _same_kind(a, b) -> bool:
    number = lambda v: isinstance(v, int | float) and not isinstance(v, bool)
    return number(a) and number(b) or type(a) is type(b) and isinstance(a, str)


class Rewriter:
    def __init__(self, multi: Callable[[str], bool] = lambda _: False, nullable: Callable[[str], bool] = lambda _: False, compat: bool = False):
        self.multi, self.nullable, self.compat = multi, nullable, compat

    def __call__(self, e: Expr) -> Expr:
        chain: list[Expr] = []
        while isinstance(e, Or | And | AndNot):  # long chains grow to the left
            chain.append(e)
            e = e.left
        found = self._not(self(e.child)) if isinstance(e, Not) else e
        for node in reversed(chain):
            join = self._or if isinstance(node, Or) else self._and if isinstance(node, And) else self._and_not
            found = join(found, self(node.right))
        return found

    def _or(self, a: Expr, b: Expr) -> Expr:
        if TrueE() in (a, b):
            return TrueE()
        if isinstance(a, FalseE) or isinstance(b, FalseE):
            return b if isinstance(a, FalseE) else a
        return Or(a, b)

    def _and(self, a: Expr, b: Expr) -> Expr:
        if FalseE() in (a, b):
            return FalseE()
        if isinstance(a, TrueE) or isinstance(b, TrueE):
            return b if isinstance(a, TrueE) else a
        if isinstance(b, Not):
            return AndNot(a, b.child)
        if isinstance(a, Not):
            return AndNot(b, a.child)
        return self._range(a, b) or And(a, b)

    def _and_not(self, a: Expr, b: Expr) -> Expr:
        if isinstance(a, FalseE) or isinstance(b, TrueE):
            return FalseE()
        return a if isinstance(b, FalseE) else AndNot(a, b)

    def _not(self, child: Expr) -> Expr:
        match child:
            case TrueE():
                return FalseE()
            case FalseE():
                return TrueE()
            case Not(inner):
                return inner
            case And() | Or():
                kind, other = (And, Or) if isinstance(child, And) else (Or, And)
                parts: list[Expr] = []
                while isinstance(child, kind):
                    parts.append(Not(child.right))
                    child = child.left
                return self(reduce(other, reversed(parts), Not(child)))
            case Term(field, op, value, False) if op in _INVERSE and not self.multi(field) and (op == "!=" or not self.nullable(field)):
                return Term(field, _INVERSE[op], value)
            case Term(field, "!=", value, False):
                return Term(field, "=", value)
        return Not(child)

    def _range(self, a: Expr, b: Expr) -> Expr | None:
        """Two bounds of one field: FALSE if nothing lies between, BETWEEN if both are inclusive."""
        if not (isinstance(a, Term) and isinstance(b, Term)) or a.user or b.user or a.field != b.field or self.multi(a.field):
            return None
        low, high = (a, b) if a.op in _LOWER else (b, a)
        if low.op not in _LOWER or high.op not in _UPPER or not _same_kind(low.value, high.value):
            return None
        strict = low.op == ">" or high.op == "<"
        if low.value > high.value or low.value == high.value and strict:
            return FalseE()
        return None if strict and not self.compat else TermMany(a.field, "BETWEEN", (low.value, high.value))


def optimize(e: Expr, registry=None, compat: bool = False) -> Expr:
    """e rewritten; the registry says which fields have many values or may have none."""
    if registry is None:
        return Rewriter(compat=compat)(e)
    return Rewriter(registry.is_multi, registry.is_nullable, compat)(e)
