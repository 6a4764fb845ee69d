"""A query's lazy result: count, rows in order, pages, plan and trace."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..plans.ast import Expr
from ..plans.compiler import compile_expr, two_valued
from .places import FEW, id_at


@dataclass(frozen=True)
class PageInfo:
    """offset and limit as asked for (a limit of 0 is the total), the rows of the page, and of the result."""

    offset: int
    limit: int
    count: int
    total: int


@dataclass
class Trace:
    """A node of a traced query: its text, how many rows it matches on its own, and seconds at the root."""

    text: str = ""
    matches: int = 0
    seconds: float | None = None
    children: tuple[Trace, ...] = ()

    def pretty(self) -> str:
        lines: list[str] = []

        def put(node: Trace, indent: str, last: bool) -> None:
            took = "-" if node.seconds is None else f"{node.seconds:.3f}s"
            lines.append(f"{indent}{'└── ' if last else '├── '}{node.text}  [{took}] ({node.matches} matches)")
            for i, child in enumerate(node.children):
                put(child, indent + ("    " if last else "│   "), i + 1 == len(node.children))

        put(self, "", True)
        return "\n".join(lines) + "\n"


class QueryResult:
    """Nothing runs until an action; each action runs anew. A parse error shows at the first one."""

    def __init__(self, collection, expr: Expr | None, error: Exception | None = None):
        self.collection, self.expr, self.error = collection, expr, error

    def condition(self) -> Column:
        if self.error is not None:
            raise self.error
        return compile_expr(self.expr, self.collection.registry)

    def to_df(self) -> DataFrame:
        """The matching rows, with the row id."""
        return self.collection.frame.where(self.condition())

    def rows(self) -> DataFrame:
        """The matching rows in order."""
        return self.to_df().orderBy(self.collection.rid).select(*self.collection.columns)

    def count(self) -> int:
        return self.to_df().count()

    def count_df(self) -> DataFrame:
        return self.to_df().agg(F.count("*").alias("n"))

    def values(self) -> list[Row]:
        return self.rows().collect()

    def page(self, offset: int, limit: int = 0) -> DataFrame:
        """The first FEW rows are looked for by a sort. Other pages take the rows from the id at the offset on, and if they are
        long up to the id behind their last, so no task has the rows in front of a page."""
        if min(offset, limit) < 0 or 0 < limit <= FEW - offset:
            return self.rows().offset(offset).limit(limit)
        rid, found = self.collection.rid, self.to_df()
        ids = found.select(rid)
        if offset:
            start = id_at(ids, offset).select(F.col(rid).alias("_start"))
            found = found.join(F.broadcast(start), F.col(rid) >= F.col("_start"))
        if limit > FEW:
            end = id_at(ids, offset + limit).agg(F.min(rid).alias("_end"))
            found = found.join(F.broadcast(end), F.col("_end").isNull() | (F.col(rid) < F.col("_end")))
        found = found.orderBy(rid).select(*self.collection.columns)
        return found.limit(limit) if 0 < limit <= FEW else found

    def paginate(self, offset: int, limit: int = 0) -> tuple[list[Row], PageInfo]:
        total = self.count()
        rows = self.page(offset, limit).collect() if offset < total else []
        return rows, PageInfo(offset, limit or total, len(rows), total)

    def page_info_df(self, offset: int, limit: int = 0) -> DataFrame:
        """PageInfo as one row, in one aggregate."""
        total = F.count("*")
        left = F.greatest(total - offset, F.lit(0))
        return self.to_df().agg(
            F.lit(offset).cast("bigint").alias("offset"), (F.lit(limit).cast("bigint") if limit else total).alias("limit"),
            (F.least(F.lit(limit).cast("bigint"), left) if limit else left).alias("count"), total.alias("total"),
        )

    def explain(self, mode: str = "formatted") -> None:
        self.to_df().explain(mode)

    def trace_df(self) -> DataFrame:
        """(node, text, matches), parents first: one pass counts all nodes."""
        nodes = list(self.expr.walk())
        registry = self.collection.registry
        counts = [F.count_if(two_valued(compile_expr(n, registry))).alias(f"n{i}") for i, n in enumerate(nodes)]
        pairs = F.array(*[F.struct(F.lit(i).alias("node"), F.lit(str(n)).alias("text"), F.col(f"n{i}").alias("matches")) for i, n in enumerate(nodes)])
        return self.collection.frame.agg(*counts).select(F.explode(pairs).alias("x")).select("x.*")

    def trace(self) -> Trace:
        if self.error is not None:
            raise self.error
        began = time.perf_counter()
        found = iter(sorted(self.trace_df().collect()))

        def build(e: Expr) -> Trace:
            row = next(found)
            return Trace(row["text"], row["matches"], None, tuple(build(c) for c in e.children()))

        root = build(self.expr)
        root.seconds = time.perf_counter() - began
        return root
