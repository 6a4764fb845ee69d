"""Operator 2, MinHash near-dedup by ProbMinHash.

A text is the multiset of its runs of five words; weights are counts. Each shingle is a Poisson
process whose rate is its weight and whose arrivals fall on random registers of the signature; a
register keeps the shingle that arrives first. Two texts agree in a register with the probability
Jaccard similarity of their weights (the plain one where no shingle repeats). Processes stop early, at
the time by which all registers are almost surely filled; texts with a register left run on.

Registers are banded; texts that share a band are candidates. Candidates are verified exactly: links
are pairs with similarity 0.8 or more. Within a bucket pairs with one member, the one that shares
buckets with the most texts, are tested first. What is left are pairs of members of different
components (no other pair can change a class). A bucket in which these are at most CROSS for each
member is settled at once: its members outside its largest component (2 * CROSS at most) meet all
others. They are compared by sketches of FINE registers of four bits inside the join, and verified
unless these are far apart; with exact=True all are verified. The members of larger buckets are banded
anew, with the next of LEVELS: longer bands part texts that only resemble one another, and more of
them find a pair at 0.8 as surely as before. What the last level leaves large is compared in full, in
parts of PART members. Components come from alternating star contractions of the links.

Scale: exact copies meet in one node (the text's key), so their number costs a row each at the first
and the last step only. Buckets are reduced by aggregates and equi-joins, never collected; signatures
stay on the executors. Rows compared grow with members times CROSS, not with the square of a bucket.
A pair at 0.8 is missed once in 300,000 by the bands of a level, and once in 3 million by the sketches.

Defined results: null texts and texts without a word have no shingle and are a class of their own
row; texts of one to four words are one shingle; copies, repeated rows and ties share the class of
the smallest doc_id; the class of rows without any doc_id is null. Of rows with equal doc_id and text
keep_one keeps that whose other columns come first as JSON. Extra columns pass through, but `class_id`
and `class_size` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import U64, Words, buffers, keeps, materialise, mix, signed, slices, spans, text_key, tidy, with_filter

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS = 32, 5
#: (bands, rows) of the levels: (1 - 0.8 ** rows) ** bands is 3e-6 for all.
LEVELS = ((BANDS, ROWS), (184, 12), (1100, 20))
#: Pairs across components that a bucket may have for each of its members, and members that one task compares.
CROSS, PART = 256, 4096
#: Registers of the fine sketch, four bits each, and in how many those of a pair to verify may differ:
#: at a similarity of LEAST one differs with a chance of 0.2 * 15 / 16; the bound is 5 deviations above.
FINE = 1024
_DIFFER = (1 - LEAST) * 15 / 16
FINE_APART = int(FINE * _DIFFER + 5 * (FINE * _DIFFER * (1 - _DIFFER)) ** 0.5)
FINE_SCHEMA = "k bigint, " + ", ".join(f"f{i} bigint" for i in range(FINE // 16))
_ID = U64((1 << 44) - 1)


def shingles(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each shingle; a row of fewer words is one shingle."""
    h = words.hashes()
    at, g = words.windows(h, size)
    row = words.rows()[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(short):
        row = np.concatenate([row, short])
        g = np.concatenate([g, spans(h, "word", words.first[short], words.first[short + 1])])
    return row, g


def _arrivals(row: np.ndarray, e: np.ndarray, w: np.ndarray, until: np.ndarray, m: int) -> tuple[np.ndarray, ...]:
    """All arrivals (row, register, time, element) of the elements' processes up to until[row]."""
    found, t, j, block = [], np.zeros(len(e)), np.zeros(len(e), np.uint64), 1
    while len(e):
        x = mix(e[:, None] * U64(0x9E3779B97F4A7C15) + (j[:, None] + np.arange(block, dtype=np.uint64)) * U64(0xD1342543DE82EF95) + U64(1))
        step = -np.log(((x >> U64(11)).astype(np.float64) + 1.0) * 2.0**-53) / w[:, None]
        time = t[:, None] + np.cumsum(step, axis=1)
        i, c = np.nonzero(time <= until[row][:, None])
        found.append((row[i], (mix(x[i, c]) % U64(m)).astype(np.int64), time[i, c], e[i]))
        on = time[:, -1] <= until[row]
        row, e, w, t, j = row[on], e[on], w[on], time[on, -1], j[on] + U64(block)
        block = min(32, 2 * block)
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def signatures(row: np.ndarray, h: np.ndarray, rows: int, m: int = BANDS * ROWS) -> np.ndarray:
    """(rows, m) registers with the elements that arrive first; rows without shingles are all zero."""
    out = np.zeros((rows, m), np.uint64)
    # one key sorts by row and element; 44 bits name an element well enough for candidates
    base = row.min() if len(row) else 0
    if rows * m >= 1 << 24:
        raise ValueError("too many rows at once")
    key, n = np.unique((row - base).astype(np.uint64) << U64(44) | h & _ID, return_counts=True)
    row, e, w = (key >> U64(44)).astype(np.int64) + base, key & _ID, n.astype(np.float64)
    total = np.bincount(row, w, rows)
    with np.errstate(divide="ignore"):
        until = np.where(total > 0, m * (np.log(m) + 4.0) / total, 0.0)
    left = total > 0
    while left.any():
        use = left[row]
        r, k, t, x = _arrivals(row[use], e[use], w[use], until, m)
        # one key sorts by register, then by time in 2**40 steps up to the time until which it runs
        cell = r * m + k
        order = np.argsort(cell.astype(np.uint64) << U64(40) | (t / until[r] * (2.0**40 - 1)).astype(np.uint64))
        cell, x = cell[order], x[order]
        head = np.concatenate([[True], cell[1:] != cell[:-1]])
        cell, x = cell[head], x[head]
        filled = np.bincount(cell // m, minlength=rows)
        whole = filled == m
        use = whole[cell // m]
        out.reshape(-1)[cell[use]] = x[use] | U64(1) << U64(44)
        left &= ~whole
        until = until * 2
    return out


def _at_once(m: int) -> int:
    """Rows whose arrivals at m registers are about 400,000 in all."""
    return max(1, int(400_000 / (m * (np.log(m) + 4))))


def _sketch(bands: int, rows: int):
    """For each distinct text of a batch: its key and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, first = np.unique(batch.column("k").to_numpy(), return_index=True)
            batch = batch.take(pa.array(first))
            keys, (raw, offs) = batch.column("k").to_numpy(), buffers(batch.column("text"))
            for i, j in slices(offs, rows=_at_once(bands * rows)):
                words = Words(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                row, h = shingles(words)
                some = np.flatnonzero(words.counts > 0)
                if not len(some):
                    continue
                sig = signatures(row, h, j - i, bands * rows)[some]
                found = np.zeros((len(some), bands), np.uint64)
                for r in range(rows):
                    found = mix(found * U64(0x9E3779B97F4A7C15) + sig[:, r::rows])
                found = mix(found + np.arange(1, bands + 1, dtype=np.uint64) * U64(0xC2B2AE3D27D4EB4F))
                flat = pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(signed(found)).reshape(-1), pa.int64()), bands)
                yield pa.record_batch([pa.array(keys[i:j][some]), flat.cast(pa.list_(pa.int64()))], ["k", "bands"])

    return run


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard of two multisets given as sorted (elements, weights)."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    x, y = a[1][i].astype(np.float64), b[1][j].astype(np.float64)
    only_a, only_b = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    order = np.argsort(y / x, kind="stable")
    x, y = x[order], y[order]
    ratio = y / x
    # elements up to the same ratio count with their weight in a, those above with that in b
    last = np.searchsorted(ratio, ratio, "right")
    sum_x, sum_y = np.concatenate([[0.0], np.cumsum(x)]), np.concatenate([[0.0], np.cumsum(y)])
    return float((1.0 / ((sum_x[last] + only_a) / x + (sum_y[-1] - sum_y[last] + only_b) / y)).sum())


def multiset(text: str) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(text.encode(), np.uint8)
    return np.unique(shingles(Words(raw, np.array([0, len(raw)])))[1], return_counts=True)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[int, tuple] = {}
    for batch in batches:
        keep = []
        for a, b, text_a, text_b in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")), strict=True):
            if a not in known:
                if len(known) > 64:
                    known.clear()
                known[a] = multiset(text_a)
            keep.append(similarity(known[a], multiset(text_b)) >= LEAST)
        mask = pa.array(keep, pa.bool_())
        yield batch.select(["a", "b"]).filter(mask)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of text keys whose texts are similar. texts: k, text, one row a key."""
    left = texts.select(F.col("k").alias("b"), F.col("text").alias("text_b"))
    right = texts.select(F.col("k").alias("a"), F.col("text").alias("text_a"))
    return pairs.join(left, "b").join(right, "a").select("a", "b", "text_a", "text_b").mapInArrow(tidy(_verify), "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(k, c): the smallest node of its component for each node of the edges (a, b) but that one.

    Alternating large and small stars, each an aggregate and a join; the edges are written between
    rounds, until a round changes nothing."""
    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    state = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    seen = state(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = small.unionByName(least.withColumnRenamed("m", "b")).distinct()
        edges = materialise(new, "edges")
        now = state(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("k"), F.col("b").alias("c"))


def _labels(docs: DataFrame, exact: bool = False, stats: list | None = None) -> DataFrame:
    """(k, c) for the text keys that are linked to another text. stats takes (level, pairs with pivots, pairs of sketches)."""
    texts = docs.select(text_key().alias("k"), "text")
    held = labels = fine = done = None
    for level, (bands, width) in enumerate(LEVELS):
        sketch = materialise(texts.mapInArrow(tidy(_sketch(bands, width)), "k bigint, bands array<bigint>"), "sketches")
        rows = sketch.select("k", F.explode("bands").alias("band"))
        buckets = rows.groupBy("band").agg(F.min("k").alias("a"), F.max("k").alias("z"), F.count("*").alias("n")).where("a <> z").select("band", "n")
        shared = materialise(rows.join(buckets, "band").distinct(), "buckets")
        # a text that shares its buckets with many is near the middle of its group
        middle = shared.groupBy("k").agg(F.sum("n").alias("near"))
        members = materialise(shared.join(middle, "k").select("band", "k", "near"), "members")
        pivots = members.groupBy("band").agg(F.max(F.struct("near", F.col("k").alias("a"))).alias("m")).select("band", "m.a")
        stars = members.join(pivots, "band").where("a <> k").select(F.least("a", "k").alias("a"), F.greatest("a", "k").alias("b")).distinct()
        if labels is not None:
            # pairs within a component or compared before say nothing new
            stars = _apart_in(stars, labels).select("a", "b").join(done, ["a", "b"], "left_anti")
            stars = stars if exact else _near(stars, fine)
        stars = materialise(stars, "stars")
        if held is None:
            near = members.select("k").distinct()
            held = with_filter(texts, near).where("maybe").groupBy("k").agg(F.first("text").alias("text"))
            held = materialise(held.join(near, "k", "left_semi"), "texts")
        links = materialise(verified(stars, held), "links")
        labels = components(links) if labels is None else _merged(labels, links)
        done = stars if done is None else done.unionByName(stars)
        # what is left: pairs of members in different components
        open_ = materialise(_open(members, labels), "open")
        last = level == len(LEVELS) - 1
        now = open_ if last else open_.where("NOT large")
        if stats is not None:
            stats.append((level, stars.count(), int(now.dropDuplicates(["band"]).agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0])))
        if fine is None and not open_.isEmpty():
            fine = held.join(open_.select("k").distinct(), "k", "left_semi")
            fine = fine.select("k") if exact else materialise(fine.mapInArrow(tidy(_fine_sketch), FINE_SCHEMA), "fine")
        if not now.isEmpty():
            cross = materialise(_cross(now, fine, exact).join(done, ["a", "b"], "left_anti"), "cross")
            labels = _merged(labels, materialise(verified(cross, held), "more-links"))
            done = done.unionByName(cross)
        rest = open_.where("large").select("k").distinct()
        left = 0 if last else rest.count()
        if not left:
            break
        # long signatures take time, not room: enough parts for all cores
        cores = docs.sparkSession.sparkContext.defaultParallelism
        texts = held.join(rest, "k", "left_semi").repartition(max(4 * cores, left // PART), "k")
    return labels


def _apart_in(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) whose members are in different components."""
    named = pairs
    for t in ("a", "b"):
        named = named.join(labels.select(F.col("k").alias(t), F.col("c").alias(f"c{t}")), t, "left").withColumn(f"c{t}", F.coalesce(f"c{t}", t))
    return named.where("ca <> cb").select("a", "b", "ca", "cb")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels with more links: only those between components count, as links of the components' smallest nodes."""
    new = materialise(_apart_in(links, labels).select(F.col("ca").alias("a"), F.col("cb").alias("b")), "merges")
    if new.isEmpty():
        return labels
    roots = components(new)
    moved = labels.join(roots.select(F.col("k").alias("c"), F.col("c").alias("c2")), "c", "left").select("k", F.coalesce("c2", "c").alias("c"))
    return materialise(moved.unionByName(roots), "labels")


def _near(pairs: DataFrame, fine: DataFrame) -> DataFrame:
    """The pairs (a, b) whose fine sketches are not far apart."""
    for t in ("a", "b"):
        pairs = pairs.join(fine.select(F.col("k").alias(t), *[F.col(f"f{i}").alias(f"{t}{i}") for i in range(FINE // 16)]), t)
    return pairs.where(_apart() <= FINE_APART).select("a", "b")


def _cross(open_: DataFrame, fine: DataFrame, exact: bool) -> DataFrame:
    """(a, b): pairs of members of open buckets in different components whose fine sketches are not far apart. Those outside a
    bucket's largest component stand in each of its parts, all members in one of them."""
    longs = [] if exact else [f"f{i}" for i in range(FINE // 16)]
    # a pair counts in the first of its buckets
    fine = fine.join(open_.groupBy("k").agg(F.sort_array(F.collect_set("band")).alias("bands")), "k")
    side = lambda rows, t: rows.join(fine, "k").select(F.col("bands").alias(f"bands{t}"), F.col("band").alias(f"band{t}"), F.col("part").alias(f"part{t}"), F.col("k").alias(t), F.col("c").alias(f"c{t}"), "big", *[F.col(x).alias(f"{t}{x[1:]}") for x in longs])
    few = side(open_.where("NOT big").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))), "a").drop("big")
    all_ = side(open_.withColumn("part", F.pmod(F.xxhash64("k"), F.col("parts"))), "b")
    meet = (F.col("banda") == F.col("bandb")) & (F.col("parta") == F.col("partb")) & (F.col("ca") != F.col("cb")) & (F.col("big") | (F.col("a") < F.col("b")))
    first = F.element_at(F.array_intersect("bandsa", "bandsb"), 1) == F.col("banda")
    pairs = few.join(all_, meet & first if exact else meet & (_apart() <= FINE_APART) & first)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _apart() -> Column:
    """In how many registers two fine sketches differ: four bits a register, sixteen registers a long."""
    total = F.lit(0)
    for i in range(FINE // 16):
        x = F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        total = total + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return total


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(band, k, c, big, pairs, parts, large): the members of buckets that hold several components; big: whether a member is in
    the bucket's largest one; pairs: those across components; large: whether they are more than CROSS for each member."""
    label = members.join(labels, "k", "left").select("band", "k", F.coalesce("c", "k").alias("c"))
    sizes = label.groupBy("band", "c").agg(F.count("*").alias("n"))
    n, square = F.sum("n"), F.sum(F.col("n").cast("double") * F.col("n"))
    mixed = sizes.groupBy("band").agg(n.alias("n"), ((n.cast("double") * n - square) / 2).alias("pairs"), F.max(F.struct("n", "c"))["c"].alias("most"), F.count("*").alias("m")).where("m > 1")
    mixed = mixed.select("band", "most", "pairs", F.expr(f"(n - 1) div {PART} + 1").alias("parts"), (F.col("pairs") > F.col("n") * CROSS).alias("large"))
    return label.join(mixed, "band").select("band", "k", "c", (F.col("c") == F.col("most")).alias("big"), "pairs", "parts", "large")


def _fine_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each text four bits of each of FINE registers, in FINE / 16 longs."""
    places = np.arange(0, 64, 4, dtype=np.uint64)
    for batch in batches:
        keys, (raw, offs) = batch.column("k").to_numpy(), buffers(batch.column("text"))
        for i, j in slices(offs, rows=_at_once(FINE)):
            words = Words(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            bits = mix(signatures(*shingles(words), j - i, FINE)) & U64(15)
            longs = (bits.reshape(j - i, FINE // 16, 16) << places).sum(axis=2, dtype=np.uint64).view(np.int64)
            yield pa.record_batch([pa.array(keys[i:j]), *(pa.array(np.ascontiguousarray(c)) for c in longs.T)], ["k", *(f"f{n}" for n in range(FINE // 16))])


def _blank() -> Column:
    return F.coalesce(F.translate("text", "\t\n\x0b\x0c\r ", ""), F.lit("")) == ""


def _classes(rows: DataFrame, exact: bool = False, stats: list | None = None) -> DataFrame:
    """(_k, class_id, class_size, best_id, best_k) of the text keys in classes of several rows. rows: doc_id, text, _k."""
    labels = _labels(rows, exact, stats)
    light = rows.where(~_blank()).select("doc_id", "_k")
    light = light.join(labels.withColumnRenamed("k", "_k"), "_k", "left").withColumn("c", F.coalesce("c", "_k"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id"), F.col("_k"))).alias("best")
    classes = light.groupBy("c").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"), best)
    classes = classes.where("class_size > 1").select("c", "class_id", "class_size", F.col("best.doc_id").alias("best_id"), F.col("best._k").alias("best_k"))
    return materialise(light.select("_k", "c").distinct().join(classes, "c"), "classes")


def _tagged(docs: DataFrame, exact: bool = False, stats: list | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows that may be in a class of several, with its columns or nulls; the other rows)."""
    rows = docs.withColumn("_k", text_key())
    several = _classes(rows, exact, stats)
    # only texts of classes with several rows need to look their class up
    tagged = with_filter(rows.withColumn("k", F.col("_k")), several.select(F.col("_k").alias("k"))).drop("k")
    return tagged.where("maybe").join(several, "_k", "left"), tagged.where("NOT maybe")


@keeps(("doc_id", "text"), ("class_id", "class_size"))
def near_duplicates(docs: DataFrame, exact: bool = False, stats: list | None = None) -> DataFrame:
    """docs with class_id (smallest doc_id of the class) and class_size (its rows). exact: verify all candidates, without
    sketches in front; stats: takes what each level compared."""
    hit, rest = _tagged(docs, exact, stats)
    own = F.col("class_size").isNull()
    hit = hit.withColumn("class_id", F.when(own, F.col("doc_id")).otherwise(F.col("class_id"))).withColumn("class_size", F.coalesce("class_size", F.lit(1).cast("bigint")))
    rest = rest.withColumns({"class_id": F.col("doc_id"), "class_size": F.lit(1).cast("bigint")})
    columns = [*docs.columns, "class_id", "class_size"]
    return hit.select(*columns).unionByName(rest.select(*columns))


@keeps(("doc_id", "text"), ())
def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class: that with the smallest doc_id, of equals the smallest text key, then by the other columns."""
    hit, rest = _tagged(docs)
    alone = hit.where("class_size IS NULL")
    best = hit.where((F.col("best_k") == F.col("_k")) & F.col("best_id").eqNullSafe(F.col("doc_id")))
    whole, others = F.struct(*docs.columns), [c for c in docs.columns if c not in ("doc_id", "text")]
    best = best.groupBy("c").agg(F.min_by(whole, F.to_json(F.struct(*others)) if others else F.lit(0)).alias("one")).select("one.*")
    return alone.select(*docs.columns).unionByName(best).unionByName(rest.select(*docs.columns))


def near_dup_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).drop("text")
