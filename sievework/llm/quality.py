"""Operator 4, quality rules: a threshold table compiled into one Spark projection.

Native throughout: no user functions. All measures of a text are expressions over one array of its
words, evaluated row by row, so there is no shuffle and a long or frequent text costs only itself.

Defined results: a null text counts as empty (no words: it fails the base rules); ties and repeated
rows are judged alike, as the verdict depends on the text alone; extra columns pass through untouched
unless they carry the name of a measure, which replaces them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import keeps

#: Fixed values of the word definition and of the symbols that count.
SPACES = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"
#: Frequent words of the four languages of the corpus.
STOP_WORDS = ("a", "and", "as", "be", "by", "for", "in", "is", "it", "of", "on", "that", "the", "this", "to", "was", "with",
              "de", "del", "el", "en", "la", "las", "los", "no", "para", "por", "que", "su", "un", "una", "y",
              "au", "avec", "dans", "des", "du", "est", "et", "le", "les", "ou", "par", "pas", "pour", "qui", "sur", "une",
              "auf", "das", "der", "die", "ein", "ist", "mit", "nicht", "sich", "und", "von", "zu")


@dataclass(frozen=True)
class Rule:
    """A measure must lie within [least, most]; None is no bound."""

    measure: str
    least: float | None = None
    most: float | None = None


#: The production table. Measures are those of `measures()`. Labelled texts of junk symbols have more than 0.3 a
#: word, and good texts have none.
RULES = (
    Rule("mean_word_length", 2.0, 14.0),
    Rule("symbols_per_word", None, 0.1),
    Rule("stop_word_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.5),
    Rule("mean_line_words", 2.0, None),
)


def words_of(text: Column) -> Column:
    """The words of a text: runs of characters outside space and tab to carriage return."""
    flat = F.trim(F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES)))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " +"))


def _repeat_words(words: Column) -> Column:
    """Words covered by windows of three words that occur twice or more, by sorting window hashes."""
    n = F.size(words)
    windows = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
    )
    return F.when(n < 4, F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(F.sort_array(windows))


def _covered(order: Column) -> Column:
    """Size of the union of [i, i + 3) over the sorted windows whose hash a neighbour shares."""
    n = F.size(order)
    hits = F.filter(order, lambda x, i: (F.get(order, i - 1)["h"] == x["h"]) | (F.get(order, i + 1)["h"] == x["h"]))
    at = F.sort_array(F.transform(hits, lambda x: x["i"]))
    union = F.aggregate(
        at,
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).alias("last")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(3), i - s["last"])).alias("n"), i.alias("last")),
        lambda s: s["n"],
    )
    return F.when(n == 0, F.lit(0).cast("bigint")).otherwise(union)


def measures(text: Column) -> list[dict[str, Column]]:
    """Layers of named expressions; each layer may use the names of those before."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.translate(x, SPACES, "") != "")
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return [
        {"_words": words_of(text), "_lines": lines},
        {"_order": _repeat_words(F.col("_words"))},
        {
            "_row": F.monotonically_increasing_id(),
            "n_words": F.size("_words").cast("bigint"),
            "word_chars": F.length(F.translate(F.coalesce(text, F.lit("")), SPACES, "")).cast("bigint"),
            "n_symbols": (F.length(F.coalesce(text, F.lit(""))) - F.length(F.translate(F.coalesce(text, F.lit("")), SYMBOLS, ""))).cast("bigint"),
            "n_lines": F.size("_lines").cast("bigint"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
            "n_repeat_words": _covered(F.col("_order")),
            "n_stop_words": F.size(F.filter("_words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("bigint"),
        },
        {
            "mean_word_length": ratio("word_chars", "n_words"),
            "symbols_per_word": ratio("n_symbols", "n_words"),
            "stop_word_ratio": ratio("n_stop_words", "n_words"),
            "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
            "mean_line_words": ratio("n_words", "n_lines"),
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        },
    ]


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """The table as one boolean expression."""
    verdict = F.lit(True)
    for r in rules:
        if r.least is not None:
            verdict = verdict & (F.col(r.measure) >= r.least)
        if r.most is not None:
            verdict = verdict & (F.col(r.measure) <= r.most)
    return verdict


ADDS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "mean_word_length",
        "symbols_per_word", "stop_word_ratio", "dup_line_ratio", "mean_line_words", "base_failed", "kept")


def _measured(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    for layer in measures(F.col("text")):
        docs = docs.withColumns(layer)
    return docs.withColumn("kept", ~F.col("base_failed") & compile_rules(rules))


@keeps(("text",), ADDS)
def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with all measures, base_failed and kept."""
    return _measured(docs, rules)


def passing(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that are kept, columns as they were."""
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text")
    # a filter on the verdict alone would be pushed below the measures and spell each of them out
    # in full many times over; one that needs the row mark stays above them
    kept = _measured(named, rules).where(F.col("kept") & (F.col("_row") >= 0))
    return kept.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def quality_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_LIST = ", ".join(f"'{w}'" for w in STOP_WORDS)
#: DuckDB has no look-around here either: the same measures from lists of words and windows.
QUALITY_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
t AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS c FROM g),
u AS (SELECT r, count(DISTINCT i + k) AS n FROM t, (SELECT unnest([0, 1, 2]) AS k) WHERE c >= 2 GROUP BY r),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(u.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
        len(list_filter(ws, lambda x: lower(x) IN ({_LIST}))) AS n_stop FROM w LEFT JOIN u USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars >= 2 * n_words AND word_chars <= 14 * n_words AND n_symbols <= 0.1 * n_words
    AND n_stop >= 0.02 * n_words AND n_dup_lines <= 0.5 * n_lines AND n_words >= 2 * n_lines AS kept
FROM b
"""
