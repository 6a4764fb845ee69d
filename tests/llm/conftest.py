import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Rows of (doc_id, text, source) as a frame of documents with an odd extra column or two."""

    def make(rows, **extra):
        from pyspark.sql import functions as F

        rows = [(r[0], r[1], r[2] if len(r) > 2 else "s") for r in rows]
        df = spark.createDataFrame(rows, "doc_id long, text string, source string")
        return df.withColumns({name: F.lit(value) for name, value in extra.items()})

    return make


#: Names that operators use inside.
CLASHING = dict.fromkeys(("k", "h", "n", "maybe", "_k", "_row", "words", "c", "band", "places", "occ", "doc", "_extra2", "uid", "size2"), 7)


@pytest.fixture(scope="session")
def clashing():
    return CLASHING
