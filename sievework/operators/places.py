"""The id at a place in the order of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FEW = 1000  # so many first rows are looked for by a sort: each task gives that many at most, and one task merges them


def id_at(ids: DataFrame, place: int) -> DataFrame:
    """One row, the id at the place (from 0) of a DataFrame of distinct bigints; none behind the last.

    Ids at places behind FEW are found 16 bits at a time, the highest first: a pass counts the ids that begin with the bits
    found so far by their next ones. A task that sums counts up reads 65,536 of them at most, whatever the place."""
    name = ids.columns[0]
    if place < FEW:
        return ids.orderBy(name).offset(place).limit(1)
    found = None
    for shift in (48, 32, 16, 0):
        near, before = (ids, F.lit(0)) if found is None else (ids.join(F.broadcast(found), F.shiftright(name, shift + 16) == F.col("_above")), F.col("_before"))
        counts = near.groupBy(before.cast("bigint").alias("_before"), F.shiftright(name, shift).alias("_above")).agg(F.count("*").alias("_n"))
        upto = F.col("_before") + F.sum("_n").over(Window.orderBy("_above"))
        counts = counts.select("_above", upto.alias("_upto"), (upto - F.col("_n")).alias("_before"))
        found = counts.where((F.col("_before") <= place) & (F.col("_upto") > place)).select("_above", "_before")
    return found.select(F.col("_above").alias(name))
