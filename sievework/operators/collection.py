"""A collection: rows with stable ids, fields to query them by, and an optional key.

Collections are snapshots. A change gives a new one, as a DataFrame plan over the old; write it out
(`sources.files`) when the plan has grown long.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from ..errors import FacetError, NoKey, ParseError, ValueNotFound
from ..functions.literals import literal
from ..plans.ast import Expr
from ..plans.compiler import compile_expr
from ..plans.parser import parse
from ..plans.rewrite import optimize
from ..sources.fields import Field, Registry
from .result import QueryResult

RID = "_rid"


def with_row_ids(df: DataFrame, first: int = 0) -> DataFrame:
    """df with dense ids in the order of its partitions and rows. Counts of partitions are all that is
    gathered; df must read the same twice, as a file scan does."""
    place = F.monotonically_increasing_id()
    marked = df.withColumns({"_part": F.shiftright(place, 33), "_at": place.bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = marked.groupBy("_part").agg(F.count("*").alias("_n"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    return marked.join(F.broadcast(sizes), "_part").withColumn(RID, F.col("_at") + F.col("_ahead") + first).drop("_part", "_at", "_ahead")


class Collection:
    """order_by: a column of unique integers that gives rows their ids and order; without it ids follow
    the order in which df is read. id: the key column."""

    def __init__(self, df: DataFrame, id: str | None = None, order_by: str | None = None, fields: dict[str, Field] | None = None):
        if RID not in df.columns:
            df = df.withColumn(RID, F.col(order_by).cast("bigint")) if order_by else with_row_ids(df)
        self.frame, self.rid = df, RID
        self.columns = [c for c in df.columns if c != RID]
        self.registry = Registry(df, fields, id)

    def _like(self, frame: DataFrame) -> Collection:
        made = object.__new__(Collection)
        made.frame, made.rid, made.columns = frame, self.rid, self.columns
        made.registry = self.registry.copy(frame)
        return made

    # fields

    def create_index(self, name: str, field: Field) -> Collection:
        self.registry.add(name, field)
        return self

    def remove_index(self, name: str) -> Collection:
        self.registry.remove(name)
        return self

    # queries

    def query(self, expr: Expr, optimizer: bool = True, compat: bool = False) -> QueryResult:
        try:
            if optimizer:
                compile_expr(expr, self.registry)  # names and literals are checked also where a rewrite drops them
                expr = optimize(expr, self.registry, compat)
        except RecursionError:
            raise FacetError("the expression is nested too deeply") from None
        return QueryResult(self, expr)

    def query_str(self, text: str, optimizer: bool = True, compat: bool = False) -> QueryResult:
        try:
            expr = parse(text, compat)
        except ParseError as error:
            return QueryResult(self, None, error)
        return self.query(expr, optimizer, compat)

    def filter(self, condition) -> DataFrame:
        """A scan with any Column or SQL predicate."""
        return self.frame.where(condition)

    # rows

    def count(self) -> int:
        return self.frame.count()

    def scan(self) -> DataFrame:
        return self.frame.orderBy(RID)

    def _key(self) -> str:
        if self.registry.key is None:
            raise NoKey
        return self.registry.key

    def lookup(self, value) -> DataFrame:
        """The last row with the key, if any."""
        key = self._key()
        dtype = self.frame.schema[key].dataType
        return self.frame.where(F.col(key) == literal(value, dtype)).orderBy(F.desc(RID)).limit(1).select(*self.columns)

    def get(self, value) -> Row:
        found = self.lookup(value).head(1)
        if not found:
            raise ValueNotFound(value)
        return found[0]

    def contains(self, value) -> bool:
        return self.registry.key is not None and bool(self.lookup(value).head(1))

    # changes

    def bulk_insert(self, rows: DataFrame) -> Collection:
        """Fills an empty collection."""
        if not self.frame.isEmpty():
            raise ValueError("a bulk insert needs an empty collection")
        return self.insert(rows)

    def insert(self, rows: DataFrame | Iterable) -> Collection:
        """Adds rows behind the others; keys are not checked."""
        if not isinstance(rows, DataFrame):
            schema = self.frame.select(*self.columns).schema
            rows = self.frame.sparkSession.createDataFrame(list(rows), schema)
        last = self.frame.agg(F.coalesce(F.max(RID), F.lit(-1))).first()[0]
        return self._like(self.frame.unionByName(with_row_ids(rows.select(*self.columns), last + 1)))

    def _last_of_keys(self, keys: DataFrame) -> DataFrame:
        """(key, _rid of its last row) for the keys that are here."""
        key = self._key()
        return self.frame.join(keys.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.max(RID).alias(RID))

    def update(self, rows: DataFrame, strict: bool = True) -> Collection:
        """Replaces the last row of each key; a missing key is an error, or with strict=False ignored. Of several new rows
        with one key the last counts."""
        key = self._key()
        whole = F.struct(*self.columns)
        rows = rows.select(whole.alias("_new"), F.col(key).alias("_key"), F.monotonically_increasing_id().alias("_at"))
        rows = rows.groupBy("_key").agg(F.max_by("_new", "_at").alias("_new")).select("_new.*")
        old = self._last_of_keys(rows)
        if strict:
            missing = rows.join(old, key, "left_anti").head(1)
            if missing:
                raise ValueNotFound(missing[0][key])
        new = rows.join(old, key).select(*self.columns, RID)
        return self._like(self.frame.join(old.select(RID), RID, "left_anti").unionByName(new))

    def remove(self, *values, strict: bool = True) -> Collection:
        """Drops the last row of each key."""
        key = self._key()
        dtype = self.frame.schema[key].dataType
        at = self.frame.where(F.col(key).isin(*[literal(v, dtype) for v in values])).groupBy(key).agg(F.max(RID).alias(RID))
        if strict:
            there = {r[0] for r in at.select(key).collect()}
            for v in values:
                if v not in there:
                    raise ValueNotFound(v)
        return self._like(self.frame.join(at.select(RID), RID, "left_anti"))

    def remove_where(self, expr: Expr) -> Collection:
        return self._like(self.query(~expr).to_df())

    def compact(self) -> tuple[Collection, DataFrame]:
        """Ids without gaps, in the old order, and the (old, new) pairs of rows whose id changed.

        The order is dealt by ranges and numbered within them, so no task has all rows."""
        dealt = self.frame.repartitionByRange(RID).sortWithinPartitions(RID)
        dealt = dealt.withColumnRenamed(RID, "_old").checkpoint() if _can_checkpoint(self.frame) else dealt.withColumnRenamed(RID, "_old")
        moved = with_row_ids(dealt)
        pairs = moved.where(F.col("_old") != F.col(RID)).select(F.col("_old").alias("old"), F.col(RID).alias("new"))
        return self._like(moved.select(*self.columns, RID)), pairs


def _can_checkpoint(df: DataFrame) -> bool:
    return df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined()
