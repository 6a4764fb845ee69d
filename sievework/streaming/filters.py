"""The same filters over streams: a compiled predicate has no state, so it runs on any stream."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.ast import Expr
from ..plans.compiler import compile_expr
from ..plans.parser import parse
from ..plans.rewrite import optimize
from ..sources.fields import Field, Registry


def filter_stream(stream: DataFrame, query: str | Expr, fields: dict[str, Field]) -> DataFrame:
    """The rows of a stream (or a table) that match."""
    registry = Registry(stream, fields)
    expr = parse(query) if isinstance(query, str) else query
    compile_expr(expr, registry)
    return stream.where(compile_expr(optimize(expr, registry), registry))
