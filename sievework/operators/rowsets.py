"""Set algebra over row ids, as DataFrames of distinct `_rid`."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .places import id_at

RID = "_rid"


class RowSet:
    """Immutable: every operator gives a new set. The constructor drops repeated ids and nulls."""

    def __init__(self, ids: DataFrame):
        self.ids = ids.select(F.col(ids.columns[0]).cast("bigint").alias(RID)).where(F.col(RID).isNotNull()).distinct()

    @classmethod
    def _known(cls, ids: DataFrame) -> RowSet:
        """Of ids that are distinct already."""
        made = object.__new__(cls)
        made.ids = ids.select(RID)
        return made

    @classmethod
    def of(cls, spark: SparkSession, values: Iterable[int] = ()) -> RowSet:
        return cls._known(spark.createDataFrame([(int(v),) for v in set(values)], f"{RID} bigint"))

    @classmethod
    def where(cls, df: DataFrame, condition: Column, rid: str = RID) -> RowSet:
        return cls(df.where(condition).select(rid))

    def __and__(self, other: RowSet) -> RowSet:
        return RowSet._known(self.ids.join(other.ids, RID, "left_semi"))

    def __or__(self, other: RowSet) -> RowSet:
        return RowSet._known(self.ids.unionByName(other.ids).distinct())

    def __xor__(self, other: RowSet) -> RowSet:
        """Ids in exactly one of both: one aggregate over the union."""
        both = self.ids.unionByName(other.ids).groupBy(RID).agg(F.count("*").alias("n"))
        return RowSet._known(both.where("n = 1"))

    def __sub__(self, other: RowSet) -> RowSet:
        return RowSet._known(self.ids.join(other.ids, RID, "left_anti"))

    def add(self, *values: int) -> RowSet:
        return self | RowSet.of(self.ids.sparkSession, values)

    def discard(self, *values: int) -> RowSet:
        return RowSet._known(self.ids.where(~F.col(RID).isin(*values)))

    def without(self, condition: Column) -> RowSet:
        """Drops the ids for which the condition on `_rid` holds."""
        return RowSet._known(self.ids.where(~F.coalesce(condition, F.lit(False))))

    def __contains__(self, value: int) -> bool:
        return not self.ids.where(F.col(RID) == value).isEmpty()

    def __len__(self) -> int:
        return self.ids.count()

    def is_empty(self) -> bool:
        return self.ids.isEmpty()

    def bounds_df(self) -> DataFrame:
        """One row with min and max; -1 for the empty set."""
        return self.ids.agg(F.coalesce(F.min(RID), F.lit(-1)).alias("min"), F.coalesce(F.max(RID), F.lit(-1)).alias("max"))

    def min(self) -> int:
        return self.bounds_df().first()["min"]

    def max(self) -> int:
        return self.bounds_df().first()["max"]

    def kth_df(self, k: int) -> DataFrame:
        return id_at(self.ids, k)

    def kth(self, k: int) -> int | None:
        found = self.kth_df(k).head(1)
        return found[0][0] if found else None

    def range(self, low: int, high: int) -> RowSet:
        return RowSet._known(self.ids.where(F.col(RID).between(low, high)))

    def values(self) -> list[int]:
        return [r[0] for r in self.ids.orderBy(RID).collect()]

    def batches(self, size: int = 256) -> Iterator[list[int]]:
        """The ids in order, `size` at a time, without holding all of them."""
        batch: list[int] = []
        for row in self.ids.orderBy(RID).toLocalIterator():
            batch.append(row[0])
            if len(batch) == size:
                yield batch
                batch = []
        if batch:
            yield batch

    def bitmaps(self) -> DataFrame:
        """(bucket, bitmap): the set in bits, for storage."""
        grouped = self.ids.groupBy(F.expr(f"bitmap_bucket_number({RID})").alias("bucket"))
        return grouped.agg(F.expr(f"bitmap_construct_agg(bitmap_bit_position({RID}))").alias("bitmap"))
