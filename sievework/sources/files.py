"""Reading tables into collections, and writing their rows."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.collection import RID, Collection
from .fields import Field


def read(spark: SparkSession, path: str, format: str = "parquet", id: str | None = None, order_by: str | None = None, fields: dict[str, Field] | None = None, **options) -> Collection:
    """A collection over files of any format that Spark reads."""
    return Collection(spark.read.format(format).options(**options).load(path), id, order_by, fields)


def write(collection: Collection, path: str, format: str = "parquet", mode: str = "errorifexists", with_ids: bool = True) -> None:
    """The rows, with their ids unless told otherwise; reading them again keeps the ids."""
    columns = [*collection.columns, RID] if with_ids else collection.columns
    collection.frame.select(*columns).write.format(format).mode(mode).save(path)
