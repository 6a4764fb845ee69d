"""Operator 10, mixing sources to target weights: a low-discrepancy source schedule.

Each source's documents are put in a shuffled but fixed order, and the stream of their words, begun
anew when it is at its end, is cut into blocks of equally many words. Points of the golden-ratio
sequence, mapped through the cumulative weights of the sources (their targets in blocks), say which
source fills a slot; a slot's rank among its source's slots is the block that it takes. A source gives
what its slots take and nothing is added or cut, but for the bound of `most` times its size. The
sequence's discrepancy keeps a source within a few blocks of its target.

A block has the words of the whole mix over MANY, at most BLOCK_WORDS. Sources whose target is below FEW such
blocks have smaller ones, FEW of them (equal to within a word), so a few blocks are always little of a target.

Native throughout. Ranks and running sums are taken in two steps (within cells, then over the cells'
totals), so a source with a third of all rows is spread over its cells; repeated rows are one row with
a count until the words are dealt, and many of them are dealt in parts. Only windows over the table of
sources, one row a source, run in one task.

Defined results: a null text has size 0; sources order by code point, null last, and null is a source
of its own; documents of size 0 and sources of size 0 take nothing; repeated rows are documents of
their own behind one another in the order; an empty table mixes to an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._text import materialise
from .quality import SPACES

#: Fractional part of the golden ratio, and the weights that repeat over the sources.
GOLDEN = 0.6180339887498949
WEIGHTS = (5, 2, 1)
BLOCK_WORDS, MANY, FEW = 1 << 16, 1 << 16, 1 << 10
#: Hex digits of the order's hash that name a cell: 4,096 cells a source.
CELL_DIGITS = 3
#: Copies of a row that one task deals at once; slots whose ranks are counted together; arcs of the circle of points.
COPIES, STRETCH, ARCS = 1 << 12, 1 << 12, 1 << 10


def _size(text: Column) -> Column:
    """Number of words, from the ends of words alone: no array is built."""
    flat = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.size(F.filter(F.split(flat, " +"), lambda w: w != "")).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes: source, source_size, one row each. Adds weight and target.

    Targets fill like water: with the sources in order of cap over weight, those below the level stop
    at their cap and the others share the rest by weight. That is where resharing the excess ends."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    after = level.rowsBetween(0, Window.unboundedFollowing)
    t = t.withColumns({
        "_capped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "_weights": F.sum("weight").over(after),
        "_all": F.sum(F.col("source_size").cast("double")).over(level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * F.lit(float(share)),
    })
    t = t.withColumn("_level", (F.col("_all") - F.col("_capped")) / F.col("_weights"))
    # the first source whose cap is over the level that its weight gives sets the level for all behind it
    over = F.when(F.col("cap") >= F.col("_level") * F.col("weight"), F.col("_level"))
    set_by = F.first(over, ignorenulls=True).over(level.rowsBetween(Window.unboundedPreceding, 0))
    t = t.withColumn("target", F.when(set_by.isNull(), F.col("cap")).otherwise(F.least(set_by * F.col("weight"), F.col("cap"))))
    return t.select("source", "source_size", "weight", "target")


def plan_of(sizes: DataFrame, block_words: int | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The targets with each source's arc of the circle: source, source_size, target, bound (words that it may give),
    num / den (words of a block), slots (its target in blocks), lo, hi, and all_slots."""
    t = targets(sizes, weights, share, most)
    t = t.withColumns({"bound": F.floor(F.col("source_size") * F.lit(float(most))), "_t": F.round("target").cast("bigint")}).withColumn("_t", F.least("_t", "bound"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    block = F.lit(block_words).cast("bigint") if block_words else F.least(F.greatest(F.expr(f"sum(_t) OVER () div {MANY}"), F.lit(1)), F.lit(BLOCK_WORDS)).cast("bigint")
    t = t.withColumn("_b", block).withColumn("_few", F.col("_t") < F.col("_b") * FEW)
    t = t.withColumns({
        "num": F.when(F.col("_few"), F.col("_t")).otherwise(F.col("_b")),
        "den": F.when(F.col("_few"), FEW).otherwise(1).cast("bigint"),
        "slots": F.when(F.col("_t") == 0, 0).when(F.col("_few"), FEW).otherwise(F.expr("(_t + _b div 2) div _b")).cast("bigint"),
    })
    line = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumns({"all_slots": F.sum("slots").over(every), "_upto": F.sum("slots").over(line)})
    arc = lambda upto: F.coalesce(upto / F.nullif(F.col("all_slots"), F.lit(0)), F.lit(0.0))
    t = t.withColumns({"lo": arc(F.col("_upto") - F.col("slots")), "hi": arc(F.col("_upto"))})
    return t.select("source", "source_size", "target", "bound", "num", "den", "slots", "lo", "hi", "all_slots")


def schedule(plan: DataFrame) -> DataFrame:
    """The slots of the mix, in order: slot, source, and rank, the place among the source's slots."""
    first = plan.select("all_slots").first()
    points = (F.col("id") + 1) * F.lit(float(GOLDEN))
    slots = plan.sparkSession.range(int(first[0] or 0) if first else 0).select(F.col("id").alias("slot"), (points - F.floor(points)).alias("u"))
    arcs = plan.where("slots > 0").select("source", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * ARCS), F.floor(F.col("hi") * ARCS))).alias("arc"))
    hit = slots.withColumn("arc", F.floor(F.col("u") * ARCS)).join(arcs, "arc").where("u >= lo AND u < hi")
    hit = hit.select("source", "slot", F.floor(F.col("slot") / STRETCH).alias("stretch"))
    sums = hit.groupBy("source", "stretch").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("_s"), F.col("stretch").alias("_c"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    own = F.row_number().over(Window.partitionBy("source", "stretch").orderBy("slot")) - 1
    hit = hit.withColumn("_own", own).join(sums, hit["source"].eqNullSafe(sums["_s"]) & (hit["stretch"] == sums["_c"]))
    return hit.select("slot", "source", (F.col("_own") + F.col("_ahead")).alias("rank"))


def place(docs: DataFrame) -> DataFrame:
    """docs: doc_id, source, size, h. One row a row with start: the words of its source before it, in the order of h."""
    rows = docs.withColumn("cell", F.substring("h", 1, CELL_DIGITS)).groupBy("source", "cell", "h", "doc_id", "size").agg(F.count("*").alias("copies"))
    words = F.col("size") * F.col("copies")
    sums = rows.groupBy("source", "cell").agg(F.sum(words).alias("_in"))
    ahead = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("_s"), F.col("cell").alias("_c"), F.coalesce(F.sum("_in").over(ahead), F.lit(0)).alias("_ahead"))
    within = Window.partitionBy("source", "cell").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.coalesce(F.sum(words).over(within), F.lit(0)))
    rows = rows.join(sums, rows["source"].eqNullSafe(sums["_s"]) & (rows["cell"] == sums["_c"]))
    rows = rows.select("doc_id", "source", "size", "copies", (F.col("_before") + F.col("_ahead")).alias("start"))
    few = rows.where(F.col("copies") <= COPIES).withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
    many = rows.where(F.col("copies") > COPIES).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(copies - 1) div {COPIES}"))))
    many = many.repartition("_part", "start").withColumn("k", F.explode(F.sequence(F.col("_part") * COPIES, F.least((F.col("_part") + 1) * COPIES, F.col("copies")) - 1)))
    both = few.unionByName(many.drop("_part"))
    return both.select("doc_id", "source", "size", "k", (F.col("start") + F.col("k") * F.col("size")).alias("start"))


def _spans(docs: DataFrame, block_words: int | None, weights: tuple[int, ...], share: float, most: float) -> tuple[DataFrame, DataFrame]:
    """(documents with words, with the plan of their source, a row for each of their parts in a block, with the slot that
    takes it or null; documents without words)."""
    name = F.md5(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")))))
    base = materialise(docs.select("doc_id", "source", _size(F.col("text")).alias("size"), name.alias("h")), "sizes")
    plan = materialise(plan_of(base.groupBy("source").agg(F.sum("size").alias("source_size")), block_words, weights, share, most), "plan")
    slots = schedule(plan).select(F.col("source").alias("_s"), F.col("rank").alias("_b"), "slot")
    known = plan.select(F.col("source").alias("_p"), "source_size", "target", "bound", "num", "den")
    rows = place(base.where("size > 0"))
    rows = rows.join(known, rows["source"].eqNullSafe(known["_p"])).drop("_p")
    passes = F.expr("greatest((bound - 1) div source_size, 0)")
    rows = rows.withColumn("_pass", F.explode(F.sequence(F.lit(0).cast("bigint"), passes)))
    rows = rows.withColumn("_lo", F.col("_pass") * F.col("source_size") + F.col("start")).withColumn("_hi", F.least(F.col("_lo") + F.col("size"), "bound"))
    rows = rows.where("_lo < _hi OR _pass = 0")
    # block b has the words from floor(b * num / den) on
    block = lambda x: F.expr(f"(({x} + 1) * den - 1) div num")
    blocks = F.sequence(block("_lo"), F.greatest(block("_lo"), block("(_hi - 1)")))
    rows = rows.withColumn("block", F.explode(F.when(F.col("num") > 0, blocks).otherwise(F.array(F.lit(-1).cast("bigint")))))
    rows = rows.withColumns({"_lo": F.greatest("_lo", F.expr("block * num div den")), "_hi": F.least("_hi", F.expr("(block + 1) * num div den"))})
    rows = rows.join(slots, rows["source"].eqNullSafe(slots["_s"]) & (rows["block"] == slots["_b"]), "left").drop("_s", "_b")
    words = F.when(F.col("slot").isNotNull(), F.greatest(F.col("_hi") - F.col("_lo"), F.lit(0))).otherwise(0).cast("bigint")
    first = F.col("_lo") - F.col("_pass") * F.col("source_size") - F.col("start")
    parts = rows.select("doc_id", "source", "size", "source_size", "target", "start", "slot", "block", first.alias("first"), words.alias("words"))
    none = base.where("size = 0").join(known, base["source"].eqNullSafe(known["_p"])).select("doc_id", "source", "size", "source_size", "target")
    return parts, none


def mixture(docs: DataFrame, block_words: int | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mix itself: slot, source, block, doc_id, first (word of the document, from 0) and words, one row for each part
    of a document that a slot takes. In the order of slot and block position it is the mixed stream."""
    parts, _ = _spans(docs, block_words, weights, share, most)
    return parts.where("words > 0").select("slot", "source", "block", "doc_id", "first", "words")


def mix(docs: DataFrame, block_words: int | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, taken (words of its parts in the mix), and
    first_slot, the first slot that takes one (null: none). Other columns are not carried along."""
    parts, none = _spans(docs, block_words, weights, share, most)
    first = F.min(F.when(F.col("words") > 0, F.col("slot"))).alias("first_slot")
    got = parts.groupBy("doc_id", "source", "size", "source_size", "target", "start").agg(F.sum("words").alias("taken"), first).drop("start")
    return got.unionByName(none.withColumns({"taken": F.lit(0).cast("bigint"), "first_slot": F.lit(None).cast("bigint")}))


def mix_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


#: The same mix in SQL: water-filled targets, the slots of the golden-ratio sequence, and what each source's slots take.
MIX_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        md5(coalesce(doc_id::VARCHAR, '') || '/' || md5(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source),
c AS (SELECT *, source_size * 2.0::DOUBLE AS cap FROM s),
a AS (SELECT sum(source_size) * 1.5::DOUBLE AS total FROM s),
-- hand out by weight, stop the sources that would be above their cap, and again
f AS (SELECT 0 AS k, []::VARCHAR[] AS stopped, (SELECT total / sum(w) FROM a, c GROUP BY total) AS level
      UNION ALL
      SELECT k + 1, n.stopped, ((SELECT total FROM a) - (SELECT coalesce(sum(cap), 0) FROM c WHERE list_contains(n.stopped, coalesce('s' || source, 'n'))))
          / (SELECT sum(w) FROM c WHERE NOT list_contains(n.stopped, coalesce('s' || source, 'n')))
      FROM (SELECT f.k, f.stopped AS old, (SELECT list(coalesce('s' || source, 'n') ORDER BY source) FROM c WHERE cap < f.level * w OR list_contains(f.stopped, coalesce('s' || source, 'n'))) AS stopped FROM f) n
      WHERE n.stopped IS NOT NULL AND len(n.stopped) > len(n.old)),
z AS (SELECT level FROM f ORDER BY k DESC LIMIT 1),
p AS (SELECT source, source_size, least(cap, level * w) AS target,
        least(round(least(cap, level * w)), source_size * 2)::BIGINT AS t FROM c, z),
-- the slots of each source: its target in blocks; small targets are 1,024 blocks
b AS (SELECT least(greatest(sum(t)::BIGINT // 65536, 1), 65536)::BIGINT AS b FROM p),
q AS (SELECT p.*, CASE WHEN t < b * 1024 THEN t ELSE b END AS num, CASE WHEN t < b * 1024 THEN 1024 ELSE 1 END::BIGINT AS den,
        CASE WHEN t = 0 THEN 0 WHEN t < b * 1024 THEN 1024 ELSE (t + b // 2) // b END::BIGINT AS slots FROM p, b),
r AS (SELECT *, sum(slots) OVER ()::BIGINT AS every, sum(slots) OVER (ORDER BY source NULLS LAST ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM q),
l AS (SELECT *, (upto - slots)::DOUBLE / every AS lo, upto::DOUBLE / every AS hi FROM r WHERE slots > 0),
-- points of the golden-ratio sequence, the source whose arc each falls in, and its rank there
u AS (SELECT i, (i + 1) * 0.6180339887498949::DOUBLE - floor((i + 1) * 0.6180339887498949::DOUBLE) AS u FROM (SELECT unnest(range((SELECT max(every) FROM r))) AS i)),
m AS (SELECT l.source, i AS slot, row_number() OVER (PARTITION BY l.source ORDER BY i) - 1 AS rank FROM u JOIN l ON u.u >= l.lo AND u.u < l.hi),
n AS (SELECT source, count(*) AS n FROM m GROUP BY source),
k AS (SELECT r.*, least(coalesce(n.n, 0) * num // den, source_size * 2)::BIGINT AS take FROM r LEFT JOIN n ON r.source IS NOT DISTINCT FROM n.source),
o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d),
e AS (SELECT o.*, k.source_size, k.target, CASE WHEN o.size = 0 THEN 0 ELSE (k.take // k.source_size) * o.size
    + greatest(0, least(o.size, k.take % k.source_size - o.start)) END::BIGINT AS taken,
    CASE WHEN o.size > 0 AND o.start < k.take THEN ((o.start + 1) * k.den - 1) // k.num END AS block
  FROM o JOIN k ON o.source IS NOT DISTINCT FROM k.source)
SELECT e.doc_id, e.size, e.source_size, e.target, e.taken, m.slot AS first_slot
FROM e LEFT JOIN m ON e.source IS NOT DISTINCT FROM m.source AND e.block = m.rank
"""
