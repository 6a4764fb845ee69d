"""Operator 9, benchmark decontamination: pigeonhole edit matching over words.

A test item of m words may be off by k = floor(ERROR * m) word edits. Cut into k + 1 pieces, at least
one piece stands unharmed in any passage within k edits. Pieces are looked up by the hash of a run of
words; each hit fixes where the item would lie, and Myers' bit-parallel algorithm gives the smallest
edit distance of the item to any passage there. Words compare without ASCII case.

Scale: one pass over the documents, without a shuffle, for each block of the benchmark; a block is
held to BLOCK_BYTES of text, so what is broadcast has a bound and a large benchmark takes more passes.

Defined results: null and empty texts match nothing; null items and items of fewer than LEAST_WORDS words, which
stand in clean texts too, are no items (`short_items` lists them);
repeated items count once an item_id; a document row has each item at most once, with its smallest
distance, leftmost of equals; repeated rows match alike. Extra columns pass through, but `leaks` is
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import U64, Words, buffers, extended, keeps, slices, spans, tidy
from .mixing import _size

ERROR, LEAST_WORDS = 0.2, 3
BLOCK_BYTES = 8 << 20
LEAK = "array<struct<item_id: bigint, distance: int, last_word: int>>"
_BITS = 20


def cut(m: int, k: int) -> list[tuple[int, int]]:
    """(first, end) of k + 1 pieces of m words, as even as they can be."""
    edges = [m * i // (k + 1) for i in range(k + 2)]
    return list(zip(edges, edges[1:], strict=False))


def myers(pattern: list[bytes], text: list[bytes]) -> tuple[int, int]:
    """(distance, last) of the passage of text that is nearest to the pattern; -1 stands for the empty one in front."""
    where: dict[bytes, int] = {}
    for i, w in enumerate(pattern):
        where[w] = where.get(w, 0) | 1 << i
    m = len(pattern)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = mask, 0, m, (m, -1)
    for j, w in enumerate(text):
        eq = where.get(w, 0)
        vertical = eq | minus
        diagonal = ((eq & plus) + plus ^ plus) | eq
        up, down = minus | ~(diagonal | plus) & mask, plus & diagonal
        score += bool(up & top) - bool(down & top)
        up, down = up << 1 & mask, down << 1 & mask
        plus, minus = (down | ~(vertical | up)) & mask, up & vertical
        if score < best[0]:
            best = score, j
    return best


class Items:
    """A block of the benchmark, ready for lookups."""

    def __init__(self, rows: list[tuple[int, str]], error: float = ERROR, least: int = LEAST_WORDS):
        self.ids, self.words, self.budget = [], [], []
        where: dict[int, list[tuple[np.ndarray, int, int]]] = {}
        for item, text in rows:
            raw = np.frombuffer(text.encode(), np.uint8)
            words = Words(raw, np.array([0, len(raw)]))
            m = len(words.start)
            if m < max(1, least):
                continue
            k = int(error * m)
            h = words.hashes(lower=True)
            at = len(self.ids)
            self.ids.append(item)
            self.words.append(text.encode().lower().split())
            self.budget.append(k)
            for a, b in cut(m, k):
                where.setdefault(b - a, []).append((spans(h, "word", np.array([a]), np.array([b]))[0], at, a))
        #: for each length of piece: a bitmap in front, sorted hashes, and the item and offset of each
        self.pieces = []
        for length, found in sorted(where.items()):
            h = np.array([x[0] for x in found], np.uint64)
            order = np.argsort(h, kind="stable")
            bitmap = np.zeros(1 << _BITS, bool)
            bitmap[h >> U64(64 - _BITS)] = True
            self.pieces.append((length, bitmap, h[order], np.array([x[1] for x in found])[order], np.array([x[2] for x in found])[order]))

    def hits(self, words: Words) -> list[tuple[int, int, int]]:
        """Distinct (row, item, word where the item would begin, within its row)."""
        h, rows, found = words.hashes(lower=True), words.rows(), []
        for length, bitmap, sorted_h, item, offset in self.pieces:
            at, g = words.windows(h, length)
            some = np.flatnonzero(bitmap[g >> U64(64 - _BITS)])
            at, g = at[some], g[some]
            lo, hi = np.searchsorted(sorted_h, g, "left"), np.searchsorted(sorted_h, g, "right")
            n = hi - lo
            at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
            if len(at):
                each = np.repeat(np.arange(len(at)), n)
                p = lo[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                row = rows[at[each]]
                found.append(np.stack([row, item[p], at[each] - words.first[row] - offset[p]]))
        if not found:
            return []
        return sorted(set(map(tuple, np.concatenate(found, axis=1).T.tolist())))

    def leaks(self, raw: np.ndarray, offsets: np.ndarray) -> dict[int, list[dict]]:
        """row -> the items in it."""
        words = Words(raw, offsets)
        found: dict[int, dict[int, tuple[int, int]]] = {}
        row_words: tuple[int, list[bytes]] = (-1, [])
        checked: tuple[int, int, int] = (-1, -1, 0)  # row, item, words up to here are settled
        for row, item, begin in self.hits(words):
            m, k = len(self.words[item]), self.budget[item]
            if row_words[0] != row:
                row_words = row, raw[offsets[row] : offsets[row + 1]].tobytes().lower().split()
            lo, hi = max(0, begin - k), begin + m + k
            if checked[:2] == (row, item) and hi <= checked[2]:
                continue
            checked = row, item, hi
            distance, last = myers(self.words[item], row_words[1][lo:hi])
            if distance <= k:
                own = found.setdefault(row, {})
                own[item] = min(own.get(item, (distance, lo + last)), (distance, lo + last))
        return {row: [{"item_id": self.ids[i], "distance": d, "last_word": at} for i, (d, at) in sorted(own.items())] for row, own in found.items()}


@keeps(("text",), ("leaks",))
def find_leaks(docs: DataFrame, benchmark: DataFrame, error: float = ERROR, least: int = LEAST_WORDS) -> DataFrame:
    """docs with `leaks`: the items of the benchmark that stand in the text, [] if none. least: words of an item."""
    spark = docs.sparkSession
    items = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("bigint").alias("item_id"), "text").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = total // BLOCK_BYTES + 1
    out = docs.withColumn("leaks", F.array().cast(LEAK))
    schema = extended(docs, leaks=LEAK)
    for block in range(blocks):
        rows = [(r[0], r[1]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()]
        out = out.mapInArrow(tidy(_finder(spark.sparkContext.broadcast(rows), error, least)), schema)
    return out


def _finder(rows, error: float, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(rows.value, error, least)
        for batch in batches:
            leaks = batch.column("leaks").to_pylist()
            raw, offs = buffers(batch.column("text"))
            for i, j in slices(offs):
                for row, found in items.leaks(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]).items():
                    leaks[i + row] = leaks[i + row] + found
            at = batch.schema.get_field_index("leaks")
            yield batch.set_column(at, "leaks", pa.array(leaks, batch.schema.field(at).type))

    return run


def short_items(benchmark: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """The rows of the benchmark that are too short to be items."""
    return benchmark.where(~F.coalesce(_size(F.col("text")) >= least, F.lit(False)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, error: float = ERROR, least: int = LEAST_WORDS) -> DataFrame:
    """The documents without a leak, columns as they were."""
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text")
    return find_leaks(named, benchmark, error, least).where(F.size("leaks") == 0).select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def decontam_query(spark, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item in it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", F.explode("leaks").alias("x"))
    return found.select("doc_id", "x.item_id", "x.distance", "x.last_word")
