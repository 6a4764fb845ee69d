"""Operator 5, substring dedup by difference-cover anchors.

A window is `size` consecutive words. Anchors are shorter windows, hashed only at positions whose
remainder modulo PERIOD lies in a difference cover: for any two positions some common shift below
PERIOD brings both onto the cover, so two equal windows always share an anchor inside them. Anchors
that occur once are dropped; around the others the windows that hold them are hashed in full (the
extension), counted over the corpus, and the words of windows that occur twice or more are removed.
Anchors only choose candidates, by a fast hash of 64 bits; windows are told apart by a cryptographic
digest of DIGEST bytes of their words.

Scale: a batch sends each distinct anchor once, with its count and place, so a passage in a third of
all rows is as many records as there are batches. Records cross shuffles in one row for each bucket of
hashes, and a worker sorts a bucket at a time; the number of buckets follows the bytes of the texts. Texts are shuffled only where they hold a shared
anchor (a Bloom filter of bounded size sorts out most others; what it lets through is
settled by joins). Decisions travel under a key of the text, since they depend on the text alone.

Defined results: null and empty texts, and texts shorter than a window, lose nothing; a repeated row's
windows all start elsewhere, so all its words go; extra columns pass through, but `n_words`,
`n_removed` and `kept_text` are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import U64, Words, buffers, extended, keeps, materialise, mix, slices, text_key, tidy, with_filter

#: A perfect difference set modulo 21 (every remainder is a difference of two members).
PERIOD = 21
COVER = (3, 6, 7, 12, 14)
SIZE = 35
SPREAD = 64
DIGEST = 16
#: Hashes that a worker gathers before it sends them on.
GATHER = 1 << 19
#: Records that share a bucket, about, and the bytes that a word is taken to have in texts.
BUCKET, WORD_BYTES = 1 << 16, 6
LEAST_BUCKETS = 64
_OCC = np.dtype([("k", "<i8"), ("p", "<i4")])
#: A hash (windows: in two halves), the place where it stands (none: p = -1) and whether it is known once (n = 1) or more often (n = 2).
_ANCHOR = np.dtype([("h", "<u8"), ("k", "<i8"), ("p", "<i4"), ("n", "<i4")])
_WINDOW = np.dtype([("h", "<u8"), ("g", "<u8"), ("k", "<i8"), ("p", "<i4"), ("n", "<i4")])
_PACKED = "b int, records binary"


def _packed(key: np.ndarray, records: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """One row for each bucket that has any of the records, which are sorted by key; of very many records
    (a long text's) one for each 2 * GATHER of them."""
    for i in range(0, len(records), 2 * GATHER):
        part = records[i : i + 2 * GATHER]
        b = ((key[i : i + 2 * GATHER] >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int32)
        start = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        ends = (np.append(start, len(b)) * records.itemsize).astype(np.int32)
        blobs = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(part)])
        yield pa.record_batch([pa.array(b[start]), blobs], ["b", "records"])


def _grouped(h: np.ndarray, g: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal hashes stand together, and where each of them begins in it."""
    differs = lambda x: x[1:] != x[:-1]
    order = np.argsort(h)
    new = differs(h[order])
    if g is not None and (differs(g[order]) & ~new).any():  # first halves alone don't tell these apart
        order = np.lexsort((g, h))
        new = differs(h[order]) | differs(g[order])
    return order, np.flatnonzero(np.concatenate([[True], new]))


def _unpacked(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> Iterator[np.ndarray]:
    """The records of one bucket after the other, from rows sorted by bucket."""
    last, parts = None, []
    for batch in batches:
        b, blobs = batch.column("b").to_numpy(), batch.column("records").cast(pa.large_binary())
        if not len(b):
            continue
        _, offs, data = blobs.buffers()
        offs = np.frombuffer(offs, np.int64, len(b) + 1, blobs.offset * 8)
        start = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        for i, j in zip(start.tolist(), [*start[1:].tolist(), len(b)], strict=True):
            if parts and b[i] != last:
                yield np.concatenate(parts)
                parts = []
            last = b[i]
            parts.append(np.frombuffer(data, kind, (offs[j] - offs[i]) // kind.itemsize, offs[i]))
    if parts:
        yield np.concatenate(parts)


def _gather(buckets: int, h: np.ndarray, key: np.ndarray, at: np.ndarray, times: np.ndarray, g: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """One record for each distinct hash (h, with g as its second half if there is one), packed into a row for each bucket. A hash that
    stands in several places here is shared already: its places go in records of their own, under
    other hashes for each SPREAD places, so that they don't meet in one task."""
    order, start = _grouped(h, g)
    h, key, at = h[order], key[order], at[order]
    count = np.diff(np.append(start, len(h)))
    moved = np.flatnonzero(np.repeat(count > 1, count))
    first = moved[::SPREAD]
    own = h[first] ^ mix(at[first].astype(np.uint64) + key[first].view(np.uint64) + U64(1))
    records = np.empty(len(start) + len(moved), _ANCHOR if g is None else _WINDOW)
    rows = np.concatenate([start, moved])
    records["h"] = np.concatenate([h[start], np.repeat(own, SPREAD)[: len(moved)]])
    records["k"], records["p"], records["n"] = key[rows], at[rows], 2
    records["p"][: len(start)][count > 1] = -1
    records["n"][: len(start)] = np.minimum(np.add.reduceat(times[order], start), 2)
    if g is not None:
        records["g"] = g[order[rows]]
    if len(moved):
        records = records[np.argsort(records["h"])]
    return _packed(records["h"], records, buckets)


def digests(raw: np.ndarray, offsets: np.ndarray, words: Words, at: np.ndarray, size: int) -> np.ndarray:
    """Digests, in two halves, of the windows that begin at the words `at` (in order): of their words joined by one space."""
    length = words.end - words.start + 1
    upto = np.concatenate([[0], np.cumsum(length)])
    found, row = [], words.rows()[at]
    rows, first = np.unique(row, return_index=True)
    for r, mine in zip(rows.tolist(), np.split(at, first[1:]), strict=True):
        plain = memoryview(b" ".join(raw[offsets[r] : offsets[r + 1]].tobytes().split()))
        base = upto[words.first[r]]
        found += [hashlib.blake2b(plain[a:b], digest_size=DIGEST).digest() for a, b in zip((upto[mine] - base).tolist(), (upto[mine + size] - base - 1).tolist(), strict=True)]
    return np.frombuffer(b"".join(found), np.uint64).reshape(-1, 2)


def _distinct(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
    """The batch with each text key once, and how often it was there."""
    _, first, n = np.unique(batch.column("k").to_numpy(zero_copy_only=False), return_index=True, return_counts=True)
    return batch.take(pa.array(first)), n


def _anchors(size: int, buckets: int):
    length = size - PERIOD + 1
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch, times = _distinct(batch)
            keys, (raw, offs) = batch.column("k").to_numpy(), buffers(batch.column("text"))
            parts = []
            for i, j in slices(offs):
                words = Words(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                at, h = words.windows(words.hashes(), length)
                row = words.rows()[at]
                place = at - words.first[row]
                # windows need the whole size around them, so shorter texts have no anchor
                use = cover[place % PERIOD] & (words.counts[row] >= size)
                if use.any():
                    parts.append((h[use], keys[i:j][row[use]], place[use], times[i:j][row[use]]))
                if sum(len(x[0]) for x in parts) > GATHER:
                    yield from _gather(buckets, *map(np.concatenate, zip(*parts, strict=True)))
                    parts = []
            if parts:
                yield from _gather(buckets, *map(np.concatenate, zip(*parts, strict=True)))

    return run


def _windows(size: int, buckets: int):
    """Full windows that hold a shared anchor, gathered like the anchors."""
    length = size - PERIOD + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            times = batch.column("copies").to_numpy()
            keys, (raw, offs) = batch.column("k").to_numpy(), buffers(batch.column("text"))
            places = batch.column("places")
            parts = []
            for i, j in slices(offs):
                words = Words(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                near = np.zeros(len(words.start) + 1, np.int64)
                for r in range(i, j):
                    # an anchor at p lies in the windows that start at p - (size - length) .. p
                    p = np.asarray(places[r].values.to_numpy(zero_copy_only=False), np.int64)
                    base, end = words.first[r - i], words.first[r - i + 1]
                    np.add.at(near, base + np.maximum(p - (size - length), 0), 1)
                    np.add.at(near, np.minimum(base + p + 1, end), -1)
                near = np.cumsum(near[:-1]) > 0
                room = np.repeat(words.first[1:], words.counts) - np.arange(len(words.start))
                at = np.flatnonzero(near & (room >= size))
                if not len(at):
                    continue
                h, row = digests(words.raw, offs[i : j + 1] - offs[i], words, at, size), words.rows()[at]
                parts.append((h[:, 0], keys[i:j][row], at - words.first[row], times[i:j][row], h[:, 1]))
                if sum(len(x[0]) for x in parts) > GATHER:
                    yield from _gather(buckets, *map(np.concatenate, zip(*parts, strict=True)))
                    parts = []
            if parts:
                yield from _gather(buckets, *map(np.concatenate, zip(*parts, strict=True)))

    return run


def _once(k: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The places (k, p) in order, each once."""
    order = np.lexsort((p, k.view(np.uint64)))
    found = np.empty(len(order), _OCC)
    found["k"], found["p"] = k[order], p[order]
    return found[np.concatenate([[True], (found["k"][1:] != found["k"][:-1]) | (found["p"][1:] != found["p"][:-1])])]


def _repeated(kind: np.dtype, buckets: int):
    """The places of hashes that occur twice or more, packed by their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []

        def gathered() -> Iterator[pa.RecordBatch]:
            found = _once(*map(np.concatenate, zip(*parts, strict=True)))
            parts.clear()
            return _packed(found["k"].astype(np.int64).view(np.uint64), found, buckets)

        for records in _unpacked(batches, kind):
            order, start = _grouped(records["h"], records["g"] if "g" in kind.names else None)
            records = records[order]
            shared = np.repeat(np.add.reduceat(records["n"], start) > 1, np.diff(np.append(start, len(records))))
            records = records[shared & (records["p"] >= 0)]
            if len(records):
                parts.append((records["k"].copy(), records["p"].copy()))
            if sum(len(x[0]) for x in parts) > GATHER:
                yield from gathered()
        if parts:
            yield from gathered()

    return run


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for found in _unpacked(batches, _OCC):
        found = _once(found["k"].copy(), found["p"].copy())
        start = np.flatnonzero(np.concatenate([[True], found["k"][1:] != found["k"][:-1]]))
        places = pa.ListArray.from_arrays(pa.array(np.append(start, len(found)).astype(np.int32)), pa.array(found["p"].copy()))
        yield pa.record_batch([pa.array(found["k"][start]), places], ["k", "places"])


def _shared(rows: DataFrame, kind: np.dtype, buckets: int) -> DataFrame:
    """(k, places): where hashes stand that occur twice or more, by text key."""
    together = lambda df: df.repartition("b").sortWithinPartitions("b")
    return together(together(rows).mapInArrow(tidy(_repeated(kind, buckets)), _PACKED)).mapInArrow(tidy(_places), "k bigint, places array<int>")


def _removal(size: int, columns: list[str], keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, sha, kept = [], [], [], []
            for text, places in zip(batch.column("text"), batch.column("places"), strict=True):
                raw = (text.as_py() or "").encode()
                words = raw.split()
                n.append(len(words))
                if places.is_valid and len(places):
                    cut = np.zeros(len(words) + 1, np.int64)
                    p = np.asarray(places.values.to_numpy(zero_copy_only=False), np.int64)
                    np.add.at(cut, p, 1)
                    np.add.at(cut, np.minimum(p + size, len(words)), -1)
                    keep = np.cumsum(cut[:-1]) == 0
                    gone.append(int(len(words) - keep.sum()))
                    if keep_text:
                        kept.append(_cut_text(raw, keep).decode())
                    words = compress(words, keep.tolist())
                else:
                    gone.append(0)
                    if keep_text:
                        kept.append(raw.decode())
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            out = [batch.column(c) for c in columns] + [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())]
            if keep_text:
                out.append(pa.array(kept, pa.string()))
            yield pa.record_batch(out, [*columns, "n_words", "n_removed", "kept_sha256", *["kept_text"] * keep_text])

    return run


def _cut_text(raw: bytes, keep: np.ndarray) -> bytes:
    """The text without the words that go, the white space between kept words as it was."""
    view = np.frombuffer(raw, np.uint8)
    words = Words(view, np.array([0, len(raw)]))
    gone = np.flatnonzero(~keep)
    cut = np.zeros(len(raw) + 1, np.int64)
    # a word goes with the white space behind it
    until = np.append(words.start[1:], len(raw))
    np.add.at(cut, words.start[gone], 1)
    np.add.at(cut, until[gone], -1)
    return view[np.cumsum(cut[:-1]) == 0].tobytes().rstrip()


@keeps(("text",), ("n_words", "n_removed", "kept_sha256", "kept_text"))
def dedup_substrings(docs: DataFrame, size: int = SIZE, keep_text: bool = True) -> DataFrame:
    """docs with n_words, n_removed, kept_sha256 and, if asked for, kept_text."""
    if size < PERIOD:
        raise ValueError(f"a window needs {PERIOD} words or more")
    columns = docs.columns
    texts = docs.select(text_key().alias("k"), "text")
    words = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / WORD_BYTES
    buckets, more = (min(max(int(n / BUCKET), LEAST_BUCKETS), 1 << 30) for n in (words * len(COVER) / PERIOD, words))
    anchors = _shared(texts.mapInArrow(tidy(_anchors(size, buckets)), _PACKED), _ANCHOR, buckets)
    anchors = materialise(anchors, "anchors")
    some = with_filter(texts, anchors.select("k")).where("maybe").groupBy("k").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    held = some.join(anchors, "k").select("k", "text", "copies", "places")
    windows = materialise(_shared(held.mapInArrow(tidy(_windows(size, more)), _PACKED), _WINDOW, more), "windows")
    tagged = with_filter(docs.withColumn("k", text_key()), windows.select("k"))
    hit = tagged.where("maybe").join(windows, "k", "left")
    rest = tagged.where("NOT maybe").withColumn("places", F.lit(None).cast("array<int>"))
    schema = extended(docs, n_words="bigint", n_removed="bigint", kept_sha256="string", **{"kept_text": "string"} if keep_text else {})
    need = [*columns, "places"]
    return hit.select(*need).unionByName(rest.select(*need)).mapInArrow(tidy(_removal(size, columns, keep_text)), schema)


def substring_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_substrings(docs, keep_text=False).drop("text")


#: DuckDB on whole tables: every window as a list of words, counted.
SUBSTRING_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, unnest(range(1, len(ws) - 33)) AS i, ws FROM d WHERE len(ws) >= 35),
h AS (SELECT r, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM w),
c AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM h) WHERE n > 1),
g AS (SELECT DISTINCT r, i + k AS p FROM c, (SELECT unnest(range(35)) AS k)),
x AS (SELECT r, list(p) AS ps FROM g GROUP BY r),
k AS (SELECT d.r, d.doc_id, d.ws, x.ps FROM d LEFT JOIN x USING (r)),
e AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS t FROM (SELECT r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d) q
      WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.r = q.r AND g.p = q.i) GROUP BY r)
SELECT k.doc_id, len(k.ws)::BIGINT AS n_words, coalesce(len(k.ps), 0)::BIGINT AS n_removed, sha256(coalesce(e.t, '')) AS kept_sha256
FROM k LEFT JOIN e USING (r)
"""
