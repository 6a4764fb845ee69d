"""Fields: what a query may name, the column behind each name, and which operators it takes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import FacetError, InvalidName
from ..plans.ast import KEY

EQUAL = frozenset({"=", "!="})
RANGES = frozenset({"<", "<=", ">", ">="})


@dataclass(frozen=True)
class Field:
    """column: a name or any expression of the row. ops: operators it takes. multi: an array, of which
    any element may match. parse: turns text literals into values. domain: least and greatest integer
    that a literal may be. routes: other fields that serve some operators. user: operators of its own,
    (column, *values) -> Column."""

    column: str | Column
    ops: frozenset[str]
    multi: bool = False
    parse: Callable[[str], Any] | None = None
    domain: tuple[int, int] | None = None
    routes: dict[str, Field] = field(default_factory=dict)
    user: dict[str, Callable[..., Column]] = field(default_factory=dict)
    nullable: bool = True

    def expr(self) -> Column:
        return F.col(self.column) if isinstance(self.column, str) else self.column

    def with_op(self, name: str, build: Callable[..., Column]) -> Field:
        """Adds an operator of the user's, or overrides a built-in one by its name."""
        return replace(self, user={**self.user, name: build})

    def route(self, other: Field, *ops: str) -> Field:
        """Serves some operators by another field."""
        return replace(self, routes={**self.routes, **dict.fromkeys(ops or other.ops, other)})


def hashed(column: str | Column, multi: bool = False) -> Field:
    """Equality and membership."""
    return Field(column, EQUAL | {"IN"}, multi)


def ordered(column: str | Column, multi: bool = False) -> Field:
    """Equality, membership and ranges."""
    return Field(column, EQUAL | RANGES | {"IN", "BETWEEN"}, multi)


def byte_range(column: str | Column, multi: bool = False) -> Field:
    """Like ordered, for integers of 0 to 255."""
    return Field(column, EQUAL | RANGES | {"IN", "BETWEEN"}, multi, domain=(0, 255))


def range_encoded(column: str | Column) -> Field:
    """Ranges alone, for integers of 0 to 255."""
    return Field(column, RANGES | {"BETWEEN"}, domain=(0, 255))


def fenwick(column: str | Column) -> Field:
    """Ranges alone, for integers. A literal outside the domain of the rows compares as it is."""
    return Field(column, RANGES | {"BETWEEN"})


def trigram(column: str | Column) -> Field:
    return Field(column, frozenset({"LIKE"}))


def phonetic(column: str | Column, multi: bool = False) -> Field:
    return Field(column, frozenset({"SOUNDS"}), multi)


def fuzzy(column: str | Column) -> Field:
    return Field(column, frozenset({"FUZZY"}))


def text(column: str | Column, ranges: bool = True, *more: str) -> Field:
    """A string field with LIKE, SOUNDS and FUZZY as named in more."""
    main = ordered(column) if ranges else hashed(column)
    return replace(main, ops=main.ops | set(more))


def composite(main: Field, *others: Field) -> Field:
    for other in others:
        main = main.route(other)
    return main


def parsed(inner: Field, parse: Callable[[str], Any]) -> Field:
    """Literals are texts that parse turns into the field's values."""
    return replace(inner, parse=parse, routes={op: replace(f, parse=parse) for op, f in inner.routes.items()})


class Registry:
    """Names and fields over one schema."""

    def __init__(self, frame: DataFrame, fields: dict[str, Field] | None = None, key: str | None = None):
        self.frame, self.key = frame, key
        self.fields: dict[str, Field] = {}
        self._types: dict[str, tuple[T.DataType, bool]] = {}
        for name, f in (fields or {}).items():
            self.add(name, f)

    def add(self, name: str, f: Field) -> None:
        if not name or name.lower() == KEY:
            raise FacetError(f"{name!r} is no name for a field")
        if name in self.fields:
            raise FacetError(f"there is a field {name!r} already")
        self.fields[name] = f
        self.type_of(f)  # an unknown column fails here

    def remove(self, name: str) -> None:
        if name.lower() == KEY:
            self.key = None
        self.fields.pop(name, None)

    def copy(self, frame: DataFrame) -> Registry:
        made = Registry(frame, key=self.key)
        made.fields = dict(self.fields)
        return made

    def __getitem__(self, name: str) -> Field:
        if name == KEY and self.key is not None:
            return Field(self.key, EQUAL)
        if name not in self.fields:
            raise InvalidName(name)
        return self.fields[name]

    def type_of(self, f: Field) -> T.DataType:
        """The type of the field's values; of its elements if it has many."""
        return self._shape(f)[0]

    def _shape(self, f: Field) -> tuple[T.DataType, bool]:
        at = str(f.column)
        if at not in self._types:
            shape = self.frame.select(f.expr().alias("v")).schema[0]
            self._types[at] = shape.dataType, shape.nullable
        dtype, nullable = self._types[at]
        return (dtype.elementType, nullable) if f.multi and isinstance(dtype, T.ArrayType) else (dtype, nullable)

    def is_multi(self, name: str) -> bool:
        return self[name].multi

    def is_nullable(self, name: str) -> bool:
        f = self[name]
        return f.nullable and self._shape(f)[1]
