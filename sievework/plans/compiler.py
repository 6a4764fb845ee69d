"""Expressions to Columns. Names, operators and literals are all checked here, before a job runs.

Logic has two values: a row without a value is not in a predicate, so it is in its negation. Where
nothing is negated the raw predicate is used, which Parquet scans can take; below a negation it is
made two-valued first.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidArgsLen, InvalidOperation, InvalidValueType
from ..functions import strings
from ..functions.literals import literal
from ..sources.fields import Field, Registry
from .ast import And, AndNot, Expr, FalseE, Not, Or, Term, TermMany, TrueE

_COMPARE = {"=": Column.__eq__, "<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}


def two_valued(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def compile_expr(e: Expr, registry: Registry) -> Column:
    """The boolean Column of an expression."""
    match e:
        case TrueE():
            return F.lit(True)
        case FalseE():
            return F.lit(False)
        case And() | Or() | AndNot():
            return _chain(e, registry)
        case Not(Term(name, "=", value, False)):
            return _leaf(registry, name, "!=", (value,), False)
        case Not(child):
            return ~two_valued(compile_expr(child, registry))
        case Term(name, op, value, user):
            return _leaf(registry, name, op, (value,), user)
        case TermMany(name, op, values, user):
            return _leaf(registry, name, op, values, user)
    raise TypeError(f"{e!r} is no expression")


def _chain(e: Expr, registry: Registry) -> Column:
    """Chains, which grow to the left, as balanced trees of one connective each."""
    nodes: list[Expr] = []
    while isinstance(e, And | Or | AndNot):
        nodes.append(e)
        e = e.left
    parts: list[Expr | Column] = [e]
    either = isinstance(nodes[-1], Or)
    for node in reversed(nodes):
        if isinstance(node, Or) is not either:
            parts, either = [_joined(parts, either, registry)], not either
        parts.append(Not(node.right) if isinstance(node, AndNot) else node.right)
    return _joined(parts, either, registry)


def _joined(parts: list[Expr | Column], either: bool, registry: Registry) -> Column:
    """The parts of a chain; equal comparisons of one field that are joined by OR are one IN."""
    same: dict[str, list] = {}
    for x in parts if either else ():
        if isinstance(x, Term) and x.op == "=" and not x.user and x.value is not None and _plain(registry[x.field]):
            same.setdefault(x.field, []).append(x.value)
    same = {name: values for name, values in same.items() if len(values) > 1}
    rest = [x for x in parts if not (isinstance(x, Term) and x.op == "=" and not x.user and x.field in same and x.value is not None)]
    found = [x if isinstance(x, Column) else compile_expr(x, registry) for x in rest]
    return _balanced(found + [_leaf(registry, name, "IN", tuple(values), False) for name, values in same.items()], either)


def _plain(f: Field) -> bool:
    return {"=", "IN"} <= f.ops and not (f.multi or f.routes or f.user)


def _balanced(parts: list[Column], either: bool) -> Column:
    while len(parts) > 1:
        pairs = [parts[i : i + 2] for i in range(0, len(parts), 2)]
        parts = [reduce(Column.__or__ if either else Column.__and__, pair) for pair in pairs]
    return parts[0]


def _leaf(registry: Registry, name: str, op: str, values: tuple, user: bool) -> Column:
    f = registry[name]
    if op == "IS NULL":
        return f.expr().isNull()
    if op == "!=":
        same = _leaf(registry, name, "=", values, user)
        g = f.routes.get("=", f)
        if g.multi or g.parse is not None or "=" in g.user or values[0] is None:
            return ~two_valued(same)
        # the same, in a form that scans take
        return ~g.expr().eqNullSafe(literal(values[0], registry.type_of(g), g.domain))
    f = f.routes.get(op, f)
    own = f.user.get(op)
    if own is None and (user or op not in f.ops and not (op == "=" and "!=" in f.ops)):
        raise InvalidOperation(name, op)
    if f.parse is not None:
        values = tuple(_parsed(f, v) if i == 0 or op != "FUZZY" else v for i, v in enumerate(values))
    if own is not None:
        return own(f.expr(), *values)
    if f.multi:
        return _any(registry, f, op, values)
    return _one(registry, f, f.expr(), op, values)


def _parsed(f: Field, value: Any) -> Any:
    if not isinstance(value, str):
        raise InvalidValueType(value, "string")
    return f.parse(value)


def _one(registry: Registry, f: Field, c: Column, op: str, values: tuple) -> Column:
    """A predicate of one value of a field."""
    dtype = registry.type_of(f)
    typed = lambda v: literal(v, dtype, f.domain)
    if op in ("LIKE", "SOUNDS", "FUZZY"):
        if op == "FUZZY" and len(values) not in (1, 2):
            raise InvalidArgsLen("1 or 2", len(values))
        if not isinstance(values[0], str):
            raise InvalidValueType(values[0], "string")
        if op == "FUZZY":
            return strings.within(c, values[0], values[1] if len(values) > 1 else strings.FUZZY_DISTANCE)
        return (strings.like if op == "LIKE" else strings.sounds)(c, values[0])
    if op == "IN":
        return c.isin(*[typed(v) for v in values]) if values else F.lit(False)
    if op == "BETWEEN":
        if len(values) != 2:
            raise InvalidArgsLen("2", len(values))
        return c.between(typed(values[0]), typed(values[1]))
    if values[0] is None:
        return c.isNull() if op == "=" else F.lit(False)
    return _COMPARE[op](c, typed(values[0]))


def _any(registry: Registry, f: Field, op: str, values: tuple) -> Column:
    """A predicate that any element of an array may fulfil."""
    c, dtype = f.expr(), registry.type_of(f)
    if op == "=" and values[0] is not None:
        return F.array_contains(c, literal(values[0], dtype, f.domain))
    if op == "IN" and values:
        return F.arrays_overlap(c, F.array(*[literal(v, dtype, f.domain) for v in values]))
    return F.exists(c, lambda x: _one(registry, f, x, op, values))


def conjunction(parts: list[Column]) -> Column:
    return reduce(Column.__and__, parts, F.lit(True))
