"""Handles with generations: a slot's handle goes stale when its row is removed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Arena:
    """slots: _rid, _gen, live and the row's columns. A handle is (rid, generation)."""

    def __init__(self, slots: DataFrame):
        self.slots = slots

    @classmethod
    def of(cls, df: DataFrame, rid: str) -> Arena:
        return cls(df.withColumns({"_rid": F.col(rid).cast("bigint"), "_gen": F.lit(0).cast("bigint"), "live": F.lit(True)}))

    def get(self, rid: int, generation: int) -> DataFrame:
        return self.rows().where((F.col("_rid") == rid) & (F.col("_gen") == generation))

    def remove(self, rid: int, generation: int) -> Arena:
        hit = F.col("live") & (F.col("_rid") == rid) & (F.col("_gen") == generation)
        return Arena(self.slots.withColumns({"_gen": F.col("_gen") + hit.cast("bigint"), "live": F.col("live") & ~hit}))

    def fill(self, rid: int, **values) -> Arena:
        """Puts a row into a free slot, under the slot's present generation."""
        free = ~F.col("live") & (F.col("_rid") == rid)
        new = {name: F.when(free, F.lit(v).cast(self.slots.schema[name].dataType)).otherwise(F.col(name)) for name, v in values.items()}
        return Arena(self.slots.withColumns({**new, "live": F.col("live") | free}))

    def rows(self) -> DataFrame:
        return self.slots.where("live").drop("live")

    def __len__(self) -> int:
        return self.rows().count()
