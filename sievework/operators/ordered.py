"""An ordered map over a DataFrame of keys and values."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


class OrderedMap:
    """One row a key. Range reads sort their own rows only."""

    def __init__(self, df: DataFrame, key: str, value: str):
        self.df, self.key, self.value = df.select(key, value), key, value

    def _where(self, condition: Column) -> DataFrame:
        return self.df.where(condition).orderBy(self.key)

    def get(self, key):
        found = self.df.where(F.col(self.key) == key).head(1)
        return found[0][self.value] if found else None

    def put(self, key, value) -> tuple[OrderedMap, bool]:
        """The changed map, and whether the key is new."""
        new = key is not None and self.get(key) is None
        row = self.df.sparkSession.createDataFrame([(key, value)], self.df.schema)
        return OrderedMap(self.df.where(F.col(self.key) != key).unionByName(row), self.key, self.value), new

    def delete(self, key) -> OrderedMap:
        return OrderedMap(self.df.where(F.col(self.key) != key), self.key, self.value)

    def __len__(self) -> int:
        return self.df.count()

    def traverse(self) -> Iterator[Row]:
        yield from self.df.orderBy(self.key).toLocalIterator()

    def range(self, low, high) -> DataFrame:
        return self._where(F.col(self.key).between(low, high))

    def less(self, key) -> DataFrame:
        return self._where(F.col(self.key) < key)

    def less_equal(self, key) -> DataFrame:
        return self._where(F.col(self.key) <= key)

    def greater(self, key) -> DataFrame:
        return self._where(F.col(self.key) > key)

    def greater_equal(self, key) -> DataFrame:
        return self._where(F.col(self.key) >= key)

    def multi_get(self, *keys) -> DataFrame:
        """The rows of some keys, in any order given."""
        return self._where(F.col(self.key).isin(*keys))

    def ends(self) -> DataFrame:
        """One row: least and greatest key, and their values."""
        k, v = F.col(self.key), F.col(self.value)
        return self.df.agg(F.min(k).alias("min_key"), F.max(k).alias("max_key"), F.min_by(v, k).alias("first_value"), F.max_by(v, k).alias("last_value"))
