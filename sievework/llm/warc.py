"""Operator 7, WARC: a deterministic sharded writer, and the reader of what it wrote.

Records are range-partitioned in the order of page_id, url and a hash of the payload, into shards of about
SHARD_BYTES. The bounds are quantiles, by bytes, of a sample that the keys' own hashes choose (some DRAWN keys a
shard), so they depend on the rows alone; every row is written. Within a shard records are sorted and
written one gzip member each; a file is rolled when its compressed size reaches `roll_bytes`. Headers and
digests are made anew and hold nothing that changes between runs, so equal tables give equal bytes. A
file is written under a temporary name and renamed when whole; the manifest, a Parquet table with each
file's size and digest, is written last, and readers read only what it lists, in tasks of about READ_BYTES.
A task that runs again finds the files that its forerunner finished, of equal bytes, and leaves them.

Of records with equal payloads of LEAST_BYTES bytes or more, the one with the smallest page_id (of its rows
the first by url) is a response and the others are revisits of it.

Scale: shards and readers grow with the bytes, without a cap. A page_id (or none) that many rows have is
split over shards by its urls and payloads; only rows equal in all three stay together.

Defined results: a null html is the empty payload; a null url becomes the page's urn; of repeated rows
the first in the order is the response; rows without a page_id come first, and are revisits if another
row of their group has an id, else responses; ids may be integers or strings; extra columns are not archived.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import io
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._text import extended, materialise, shared_dir, with_filter

LEAST_BYTES, DRAWN = 100, 16
SHARD_BYTES, ROLL_BYTES, READ_BYTES, LEAST_SHARDS = 256 << 20, 64 << 20, 64 << 20, 64
DATE = "1970-01-01T00:00:00Z"
_URN = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def classified(pages: DataFrame) -> DataFrame:
    """page_id, url, h, payload, payload_bytes, payload_digest, and refers (page_id and url of the response) in groups of equal payloads."""
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"h": _payload_hash(F.col("payload")), "payload_bytes": F.octet_length("payload").cast("bigint"), "payload_digest": F.sha2("payload", 256)})
    named = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    groups = rows.where(F.col("payload_bytes") >= LEAST_BYTES).groupBy("payload_digest").agg(F.min(named).alias("refers"), F.count("*").alias("_n"))
    groups = materialise(groups.where("_n > 1").select("payload_digest", "refers"), "payload-groups")
    # payloads without an equal need no join, and so no shuffle
    key = F.xxhash64("payload_digest").alias("k")
    tagged = with_filter(rows.withColumn("k", key), groups.select(key)).drop("k")
    columns = [*rows.columns, "refers"]
    alone = tagged.where("NOT maybe").withColumn("refers", F.lit(None).cast(groups.schema["refers"].dataType))
    return tagged.where("maybe").join(groups, "payload_digest", "left").select(*columns).unionByName(alone.select(*columns))


def _payload_hash(payload: Column) -> Column:
    return F.xxhash64(F.lit(7), payload)


def bounds(pages: DataFrame, rows: int, shards: int) -> list[tuple]:
    """At most shards - 1 keys (page_id, url, h) that part the rows into ranges of about equal bytes."""
    every = 1
    while rows / every > DRAWN * shards:
        every *= 2
    keys = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), _payload_hash(F.coalesce("html", F.lit("")).cast("binary")).alias("h"), (F.coalesce(F.octet_length("html"), F.lit(0)) + 300).cast("bigint").alias("size"))
    # equal rows are one key, so rows / every keys or fewer are expected
    keys = keys.where(F.pmod(F.xxhash64("page_id", "url", "h"), F.lit(every)) == 0).groupBy("page_id", "url", "h").agg(F.sum("size").alias("size"))
    order = Window.orderBy(F.col("page_id").asc_nulls_first(), "url", "h")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.sum("size").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    keys = keys.withColumn("_b", F.floor(before * F.lit(shards) / whole))
    found = keys.withColumn("_l", F.lag("_b").over(order)).where("_b > _l").select("page_id", "url", "h").toArrow()
    return sorted(map(_key, *(found[c].to_pylist() for c in ("page_id", "url", "h"))))


def _key(page_id, url: str, h: int) -> tuple:
    """The order of records: as Spark sorts them, nulls first and strings by code point."""
    return (page_id is not None, page_id if page_id is not None else 0, url, h)


def _header(fields: list[tuple[str, str]]) -> bytes:
    clean = lambda s: "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in s)
    return ("WARC/1.1\r\n" + "".join(f"{k}: {clean(v)}\r\n" for k, v in fields) + "\r\n").encode()


def _member(header: bytes, *block: bytes) -> bytes:
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return b"".join([packer.compress(header), *map(packer.compress, block), packer.compress(b"\r\n\r\n"), packer.flush()])


def record(page_id, nth: int, url: str, payload: bytes, digest: str, refers: dict | None, revisit: bool) -> bytes:
    """One record as a gzip member. nth: how many records of this page_id, url and digest came before it."""
    name = lambda i, u, k: f"<urn:uuid:{uuid.uuid5(_URN, f'{i}/{digest}/{k}/{u}')}>"
    shown = lambda i: urllib.parse.quote(str(i), safe="")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = (http,) if revisit else (http, payload)
    whole = hashlib.sha256()
    for part in block:
        whole.update(part)
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name(page_id, url, nth)), ("WARC-Date", DATE), ("WARC-Target-URI", url or f"urn:page:{page_id}")]
    if page_id is not None:
        fields.append(("Page-Id", shown(page_id)))
    if revisit:
        fields += [("WARC-Refers-To", name(refers["page_id"], refers["url"], 0)), ("Refers-To-Page-Id", shown(refers["page_id"])), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{whole.hexdigest()}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(sum(map(len, block))))]
    return _member(_header(fields), *block)


class _Roller:
    """The files of one shard."""

    def __init__(self, folder: str, shard: int, most: int):
        self.fs, self.root = arrow_fs.FileSystem.from_uri(folder)
        self.shard, self.most, self.number, self.out = shard, most, -1, None

    def write(self, member: bytes) -> Iterator[tuple]:
        if self.out is not None and self.size + len(member) > self.most and self.records:
            yield self.close()
        if self.out is None:
            self.number += 1
            self.name = f"shard-{self.shard:06d}-{self.number:04d}.warc.gz"
            self.temp = f"{self.root}/_temporary/{uuid.uuid4().hex}-{self.name}"
            self.fs.create_dir(f"{self.root}/_temporary")
            self.out, self.sha, self.size, self.records = self.fs.open_output_stream(self.temp, compression=None), hashlib.sha256(), 0, 0
            info = f"format: WARC File Format 1.1\r\nfile: {self.name}\r\n".encode()
            self._put(_member(_header([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_URN, self.name)}>"), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(info)))]), info))
        self._put(member)
        self.records += 1

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)

    def close(self) -> tuple:
        self.out.close()
        self.out = None
        final = f"{self.root}/{self.name}"
        if self.fs.get_file_info(final).type == arrow_fs.FileType.NotFound:
            self.fs.move(self.temp, final)
        else:  # an earlier attempt's, whole and of equal bytes
            self.fs.delete_file(self.temp)
        return self.name, self.shard, self.records, self.size, self.sha.hexdigest()


MANIFEST = "file string, shard int, records bigint, bytes bigint, sha256 string"


def _writer(folder: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, last, nth = None, None, 0
        names = ["file", "shard", "records", "bytes", "sha256"]
        types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
        rows = lambda found: pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names)
        for batch in batches:
            columns = [batch.column(c) for c in ("shard", "page_id", "url", "payload", "payload_digest", "refers")]
            done = []
            for i in range(batch.num_rows):
                shard, page_id, url, payload, digest, refers = (c[i].as_py() for c in columns)
                if roller is None or roller.shard != shard:
                    if roller is not None:
                        done.append(roller.close())
                    roller = _Roller(folder, shard, most)
                nth = nth + 1 if last == (page_id, url, digest) else 0
                last = page_id, url, digest
                revisit = refers is not None and not (refers == {"page_id": page_id, "url": url} and nth == 0)
                done += roller.write(record(page_id, nth, url, payload, digest, refers, revisit))
            if done:
                yield rows(done)
        if roller is not None:
            yield rows([roller.close()])

    return run


def write_warc(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes the archive of pages (page_id, url, html) into a folder; returns the committed manifest."""
    spark = pages.sparkSession
    total, n = pages.agg(F.coalesce(F.sum(F.octet_length("html")), F.lit(0)), F.count("*")).first()
    shards = int(max(LEAST_SHARDS, total // shard_bytes))
    edges = spark.sparkContext.broadcast(bounds(pages, n, shards))
    rows = classified(pages)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "h")), strict=True)
            yield batch.append_column("shard", pa.array([bisect.bisect_right(edges.value, _key(*x)) for x in keys], pa.int32()))

    # one partition a shard
    dealt = rows.mapInArrow(deal, extended(rows, shard="int")).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "url", "h", "payload_digest")
    dealt.mapInArrow(_writer(folder, roll_bytes), MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed WARC stream."""
    while True:
        line = stream.readline()
        while line == b"\r\n":
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if len(block) != int(headers["content-length"]):
            raise ValueError("a record is cut off")
        yield headers, block


READ = "page_id string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, payload binary"


def read_warc(manifest: DataFrame, folder: str, payloads: bool = True, id_type: str = "bigint") -> DataFrame:
    """The records of the files that the manifest lists; digests are verified. A revisit has no payload. id_type: the type of page ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())])
        fs, root = arrow_fs.FileSystem.from_uri(folder)
        rows, held = [], 0
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with fs.open_input_stream(f"{root}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=io.BufferedReader(raw, 1 << 16)) as stream:
                    for headers, block in records(stream):
                        if headers["warc-type"] not in ("response", "revisit"):
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length"))
                        revisit = headers["warc-type"] == "revisit"
                        digest = headers["warc-payload-digest"].removeprefix("sha256:")
                        if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{name}: a payload is not what its digest says")
                        named = lambda k: urllib.parse.unquote(headers[k]) if k in headers else None  # noqa: E731, B023
                        rows.append((named("page-id"), headers["warc-target-uri"], size, digest, headers["warc-type"], named("refers-to-page-id"), payload if payloads and not revisit else None))
                        held += len(rows[-1][-1] or b"") + 200
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    files, total = manifest.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    parts = max(1, min(files, max(LEAST_SHARDS, -(-total // READ_BYTES))))
    found = manifest.select("file").repartition(parts).mapInArrow(run, READ)
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def warc_query(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    manifest = write_warc(pages, folder)
    return read_warc(manifest, folder, payloads=False, id_type=pages.schema["page_id"].dataType.simpleString()).drop("payload", "url")


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM r
"""
