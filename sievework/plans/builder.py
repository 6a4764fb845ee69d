"""Expressions without a text: eq("name", "Opel") & lt("age", 10)."""

from __future__ import annotations

from typing import Any

from .ast import KEY, And, AndNot, Expr, FalseE, Not, Or, Term, TermMany, TrueE


def _term(op: str):
    def build(field: str, value: Any) -> Term:
        return Term(field, op, value)

    return build


eq, not_eq, lt, le, gt, ge = map(_term, ("=", "!=", "<", "<=", ">", ">="))
like, sounds, fuzzy = map(_term, ("LIKE", "SOUNDS", "FUZZY"))


def id_(value: Any) -> Term:
    return Term(KEY, "=", value)


def fuzzy_dist(field: str, value: str, distance: int) -> TermMany:
    return TermMany(field, "FUZZY", (value, distance))


def in_(field: str, *values: Any) -> TermMany:
    return TermMany(field, "IN", values)


def between(field: str, *values: Any) -> TermMany:
    return TermMany(field, "BETWEEN", values)


def user_op(field: str, op: str, *values: Any) -> Expr:
    return Term(field, op, values[0], True) if len(values) == 1 else TermMany(field, op, values, True)


def all_() -> TrueE:
    return TrueE()


def none_() -> FalseE:
    return FalseE()


def is_null(field: str) -> Term:
    """Rows without a value; there is no text for it."""
    return Term(field, "IS NULL", None)


def and_(left: Expr, right: Expr) -> And:
    return And(left, right)


def or_(left: Expr, right: Expr) -> Or:
    return Or(left, right)


def not_(child: Expr) -> Not:
    return Not(child)


def and_not(left: Expr, right: Expr) -> AndNot:
    return AndNot(left, right)
