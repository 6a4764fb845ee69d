"""What can go wrong with a query, before any job runs where possible."""

from __future__ import annotations


class FacetError(Exception):
    """Base of all errors of the facet engine."""


class InvalidName(FacetError):
    def __init__(self, name: str):
        super().__init__(f"no field is registered under the name {name!r}")
        self.name = name


class InvalidValueType(FacetError):
    def __init__(self, value, expected: str):
        super().__init__(f"{value!r} is a {type(value).__name__}; the field takes {expected}")
        self.value, self.expected = value, expected


class InvalidOperation(FacetError):
    def __init__(self, field: str, op: str):
        super().__init__(f"field {field!r} doesn't support {op}")
        self.field, self.op = field, op


class ValueNotFound(FacetError):
    def __init__(self, value):
        super().__init__(f"no row has the key {value!r}")
        self.value = value


class NoKey(FacetError):
    def __init__(self):
        super().__init__("the collection has no key")


class InvalidArgsLen(FacetError):
    def __init__(self, expected: str, got: int):
        super().__init__(f"{expected} values are needed, {got} given")
        self.expected, self.got = expected, got


class OutOfRange(FacetError):
    def __init__(self, value, kind: str):
        super().__init__(f"{value!r} is out of the range of {kind}")
        self.value, self.kind = value, kind


class ParseError(FacetError):
    """A query text that isn't one, with a pointer to where it fails."""

    def __init__(self, text: str, at: int, found: str, expected: str):
        super().__init__(f"{expected} expected, {found} found\n  {text}\n  {' ' * at}^")
        self.text, self.at, self.found, self.expected = text, at, found, expected
