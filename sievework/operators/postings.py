"""Access paths that can be built and stored: gram postings for LIKE, and value bitmaps.

A scan with a pushed-down filter is the default; these pay where one column is searched often.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import strings


def gram_postings(df: DataFrame, rid: str, column: str, n: int = 3) -> DataFrame:
    """(gram, rid), one row for each distinct gram of a text."""
    return df.select(F.col(rid).alias("_rid"), F.explode(strings.grams(F.col(column), n)).alias("gram"))


def like_by_grams(df: DataFrame, postings: DataFrame, rid: str, column: str, pattern: str, n: int = 3) -> DataFrame:
    """df's rows that match the pattern: rows with all its grams are candidates, then verified."""
    need = sorted({p[i : i + n] for p in pattern.split("%") for i in range(len(p) - n + 1)})
    if need:
        found = postings.where(F.col("gram").isin(*need)).groupBy("_rid").agg(F.count("*").alias("n")).where(F.col("n") == len(need))
        df = df.join(found.select(F.col("_rid").alias(rid)), rid, "left_semi")
    return df.where(strings.like(F.col(column), pattern))


def value_bitmaps(df: DataFrame, rid: str, column: str) -> DataFrame:
    """(value, bucket, bitmap) of the rows that hold each value."""
    keys = F.col(column).alias("value"), F.expr(f"bitmap_bucket_number({rid})").alias("bucket")
    return df.groupBy(*keys).agg(F.expr(f"bitmap_construct_agg(bitmap_bit_position({rid}))").alias("bitmap"))


def count_values(bitmaps: DataFrame, *values) -> DataFrame:
    """n: the rows that hold any of the values, from bitmaps alone."""
    united = bitmaps.where(F.col("value").isin(*values)).groupBy("bucket").agg(F.expr("bitmap_or_agg(bitmap)").alias("bitmap"))
    return united.agg(F.coalesce(F.sum(F.expr("bitmap_count(bitmap)")), F.lit(0)).alias("n"))
