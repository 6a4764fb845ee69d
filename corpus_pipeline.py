"""A corpus pipeline of five of the operators: STAGES, each on all that its predecessor kept.

1. quality rules: documents that a rule rejects go
2. near duplicates: one document of each class stays
3. substring dedup: words of passages that stand elsewhere too leave the texts
4. benchmark decontamination: documents with a benchmark item in them go
5. source mixing: how many words of each document the mix takes

Null, empty and repeated rows are handled as the operators' docstrings say; an empty table passes
through all stages. Extra columns of documents are carried to the last stage but one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import decontam, mixing, near_dup, quality, substring
from sievework.llm._text import materialise


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.passing(docs)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the repeated passages and n_chars follows; no document goes."""
    cut = substring.dedup_substrings(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("doc"), "text"))
    given = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("bigint")}
    return cut.select(*[given.get(c, F.col("doc").getField(c) if c != "text" else None).alias(c) for c in docs.columns])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken", "first_slot")


STAGES = [
    ("quality rules", quality_stage),
    ("near duplicates", near_dup_stage),
    ("substring dedup", substring_stage),
    ("benchmark decontamination", decontamination_stage),
    ("source mixing", mixing_stage),
]

#: Near duplicates are beyond SQL on whole tables; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each stage's result is written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, name.replace(" ", "-"))
    return docs
