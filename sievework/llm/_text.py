"""Vectorised word splitting and hashing over Arrow string columns, and the shared work folder.

Everything here works on whole Arrow buffers: there is no Python loop over words. Words are the
maximal runs of bytes outside 0x20 and 0x09-0x0D, so UTF-8 text needs no decoding.
"""

from __future__ import annotations

import contextlib
import ctypes
import sys
import tempfile
import uuid
from collections.abc import Iterator
from functools import wraps
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

U64 = np.uint64
#: Bytes of text handled at once inside an Arrow batch; a longer single text is handled alone.
SLICE_BYTES = 900_000
#: Bytes of an Arrow batch; a single longer row is a batch of its own.
BATCH_BYTES = 8 << 20

#: Bits of the filter in front of text joins: 16 for each key, within 4 MB and 32 MB. With more keys it lets more texts
#: through, which the joins settle.
BLOOM_LEAST, BLOOM_MOST = 1 << 25, 1 << 28

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE_CODE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_LOWER_CODE = _BYTE_CODE[LOWER]
#: Multipliers are 5 modulo 8, so that powers differ in all but their last few bits.
_BASES = {"byte": 0x9E3779B97F4A7C15 & ~7 | 5, "word": 0xC2B2AE3D27D4EB4F & ~7 | 5}
_POWERS: dict[str, tuple[np.ndarray, np.ndarray]] = {}
#: Hashes of bytes have a second part modulo this prime: modulo 2**64 alone some long words (Thue-Morse) collide for every base.
_PRIME, _PRIME_BASE = U64((1 << 31) - 1), 1_352_087_411


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. Only a local master, where all is one machine, may
    go without: it gets a temporary folder."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    at = spark.sparkContext._jsc.sc().getCheckpointDir()
    if at.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sievework-"))
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
    return at.get().rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df once into the shared folder and reads it again."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Holds the Arrow batches that go to Python workers to BATCH_BYTES: rows of texts vary too much for a
    bound on rows alone. The setting is read when a plan runs, so it stays set for the session."""
    # workers that don't start in the repository find the package where the driver has it
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or not str(now).isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def extended(df: DataFrame, **columns: str) -> T.StructType:
    """The schema of df with more columns behind it."""
    small_batches(df.sparkSession)
    more = T.StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in columns.items()))
    return T.StructType([*df.schema.fields, *more.fields])


def keeps(used: tuple[str, ...], adds: tuple[str, ...]):
    """Decorates an operator on a DataFrame so that columns it doesn't use can have any name: they
    travel inside one struct. The result has the frame's columns, but those named in adds, then adds."""

    def wrap(operator):
        @wraps(operator)
        def run(df: DataFrame, *args, **options) -> DataFrame:
            extra = [c for c in df.columns if c not in used and c not in adds]
            inner = df.select(*used, *([F.struct(*[F.col(f"`{c}`") for c in extra]).alias("_extra")] if extra else []))
            out = operator(inner, *args, **options)
            back = [F.col(c) if c in used else F.col("_extra").getField(c).alias(c) for c in df.columns if c not in adds]
            return out.select(*back, *[c for c in adds if c in out.columns])

        return run

    return wrap


def text_key(text: str = "text"):
    """A 64-bit name of a text. Decisions that depend on the text alone travel under it, so null,
    repeated or clashing ids never mix up documents."""
    return F.xxhash64(F.lit(71), F.coalesce(F.col(text), F.lit("")))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64, for 0..n."""
    if kind not in _POWERS or len(_POWERS[kind][0]) <= n:
        b = _BASES[kind]
        size = max(1 << 16, 1 << int(n + 1).bit_length())
        both = []
        for x in (b, pow(b, -1, 1 << 64)):
            a = np.full(size, x, np.uint64)
            a[0] = 1
            both.append(np.cumprod(a, dtype=np.uint64))
        _POWERS[kind] = (both[0], both[1])
    return _POWERS[kind]


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo _PRIME, for x below 2**62."""
    for _ in range(2):
        x = (x & _PRIME) + (x >> U64(31))
    return np.where(x == _PRIME, U64(0), x)


def _prime_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo _PRIME, for 0..n."""
    if "prime" not in _POWERS or len(_POWERS["prime"][0]) <= n:
        size = max(1 << 16, 1 << int(n + 1).bit_length())
        both = []
        for x in (_PRIME_BASE, pow(_PRIME_BASE, -1, int(_PRIME))):
            a = np.ones(1, np.uint64)
            while len(a) < size:
                a = np.concatenate([a, _reduced(a * U64(pow(x, len(a), int(_PRIME))))])
            both.append(a)
        _POWERS["prime"] = (both[0], both[1])
    return _POWERS["prime"]


def _prime_spans(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end] modulo _PRIME, from the values' upper bits."""
    up, down = _prime_powers(len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    terms = (values >> U64(33)) * up[: len(values)]
    # one fold holds a term below 2**32, so sums don't overflow
    np.cumsum((terms & _PRIME) + (terms >> U64(31)), dtype=np.uint64, out=sums[1:])
    return _reduced(_reduced(sums[end] - sums[start]) * down[start])


def spans(values: np.ndarray, kind: str, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end] for many spans at once, by prefix sums of a polynomial."""
    up, down = _powers(kind, len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], dtype=np.uint64, out=sums[1:])
    h = (sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)
    return mix(h ^ mix(_prime_spans(values, start, end) + U64(1))) if kind == "byte" else mix(h)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES, rows: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """Ranges of at most so many rows with about `most` bytes each; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, n, i + rows)
        yield i, j
        i = j


def tidy(run):
    """Decorates what a worker runs over a partition: when it ends, freed memory goes back to the system,
    as idle workers stay alive beside those of the next stage."""

    @wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if sys.platform.startswith("linux"):
                with contextlib.suppress(OSError, AttributeError):
                    ctypes.CDLL("libc.so.6").malloc_trim(0)

    return tidied


class Words:
    """The words of some rows: byte spans, the first word of each row, and hashes on request."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw = raw
        solid = ~_SPACE[raw]
        head, tail = solid.copy(), solid.copy()
        head[1:] &= ~solid[:-1]
        tail[:-1] &= ~solid[1:]
        at = offsets[:-1][offsets[:-1] < len(raw)]
        head[at] = solid[at]
        at = offsets[1:][offsets[1:] > 0] - 1
        tail[at] = solid[at]
        self.start, self.end = np.flatnonzero(head), np.flatnonzero(tail) + 1
        #: first[i]:first[i + 1] are the words of row i
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)

    def hashes(self, lower: bool = False) -> np.ndarray:
        return spans((_LOWER_CODE if lower else _BYTE_CODE)[self.raw], "byte", self.start, self.end)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def windows(self, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of each run of `size` words within a row."""
        room = np.repeat(self.first[1:], self.counts) - np.arange(len(h))
        at = np.flatnonzero(room >= size)
        return at, spans(h, "word", at, at + size)


def signed(h: np.ndarray) -> np.ndarray:
    """Unsigned hashes as Spark's long."""
    return h.view(np.int64)


def _bloom(keys: DataFrame, size: int) -> np.ndarray:
    """A Bloom filter of the keys, two bits each, as bytes; gathered in at most size / 32768 rows."""
    bit = lambda seed: F.pmod(F.xxhash64(F.lit(seed), F.col("k")), F.lit(size)).alias("b")
    bits = keys.select(F.explode(F.array(bit(1), bit(2))).alias("b"))
    bits = bits.groupBy(F.expr("bitmap_bucket_number(b)").alias("at")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(b))").alias("bits"))
    found = np.zeros(size // 8 + 4096, np.uint8)
    for at, part in bits.collect():
        found[(at - 1) * 4096 : at * 4096] = np.frombuffer(part, np.uint8)
    return found


def with_filter(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """docs with a column `maybe`: false where the key is surely not among keys."""
    spark = docs.sparkSession
    size = min(max(BLOOM_LEAST, 1 << (16 * keys.count()).bit_length()), BLOOM_MOST)
    bits = spark.sparkContext.broadcast(_bloom(keys, size).tobytes())
    schema = extended(docs, maybe="boolean")
    docs = docs.withColumns({"_b1": F.pmod(F.xxhash64(F.lit(1), F.col("k")), F.lit(size)), "_b2": F.pmod(F.xxhash64(F.lit(2), F.col("k")), F.lit(size))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            hit = np.ones(batch.num_rows, bool)
            for name in ("_b1", "_b2"):
                # Spark's bit position b is stored in bucket b // 32768, byte (b % 32768) // 8
                b = batch.column(name).to_numpy() - 1
                hit &= (table[b // 8] >> (b % 8).astype(np.uint8) & 1).astype(bool)
            yield batch.drop_columns(["_b1", "_b2"]).append_column("maybe", pa.array(hit))

    return docs.mapInArrow(tidy(run), schema)
