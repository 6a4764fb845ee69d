"""Operator 6, chat formatting by cumulative-snapshot collapse.

Logs hold a conversation once for each of its snapshots. The hash of a prefix is the exclusive or of
hashes of (position, role, text), so prefix hashes roll by one aggregate and need no order of work;
two of them make 128 bits. A conversation whose whole hash is the hash of a proper prefix of another
is a snapshot of it; an anti-join keeps those that are not, and of equal conversations the one with
the smallest id. What is kept is rendered with a template.

Scale: positions and prefix hashes are taken in two steps, within blocks of BLOCK turns and over the
blocks of a conversation, so a conversation with a third of all rows is spread over its blocks, and
is rendered in parts of PART turns (different rows under one turn number stay in one block; only a
log that gives a great many of them one number makes that block large). Common first turns and common conversations are aggregated before
the join.

Defined results: exact repeats of a row are one turn; turns stand in the order of (turn, role, text),
nulls first; a null role is "unknown", a null text is empty; rows of a null conv_id are one
conversation; the template's markers inside a role or text are written with a sign between (`<|im_` as
`<|_im_`), so no text can end its turn; an empty table renders nothing. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._text import materialise

BLOCK, PART = 64, 256
#: Fixed values of the template.
OPEN, CLOSE, MARK, PLAIN = "<|im_start|>", "<|im_end|>", "<|im_", "<|_im_"


def positions(turns: DataFrame) -> DataFrame:
    """conv_id, i (0-based position), n (turns of the conversation), role, text, and prefix hashes p1, p2."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    rows = rows.withColumn("b", F.floor(F.coalesce("turn", F.lit(-(1 << 62))) / BLOCK))
    block = Window.partitionBy("conv_id", "b")
    rows = rows.withColumn("_own", F.row_number().over(block.orderBy(F.col("turn").asc_nulls_first(), "role", "text")) - 1)
    sizes = rows.groupBy("conv_id", "b").agg(F.count("*").alias("_n"))
    conv = Window.partitionBy("conv_id")
    ahead = conv.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("conv_id").alias("_c"), F.col("b").alias("_b"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"), F.sum("_n").over(conv).alias("n"))
    rows = rows.join(sizes, rows["conv_id"].eqNullSafe(sizes["_c"]) & (rows["b"] == sizes["_b"])).withColumn("i", F.col("_own") + F.col("_ahead")).drop("_c", "_b", "_own", "_ahead")
    rows = materialise(rows, "turns")
    term = lambda seed: F.xxhash64(F.lit(seed), "i", "role", "text")
    rows = rows.withColumns({"_h1": term(1), "_h2": term(2)})
    sums = rows.groupBy("conv_id", "b").agg(F.bit_xor("_h1").alias("_x1"), F.bit_xor("_h2").alias("_x2"))
    sums = sums.select(F.col("conv_id").alias("_c"), F.col("b").alias("_b"), *[F.coalesce(F.bit_xor(f"_x{k}").over(ahead), F.lit(0)).alias(f"_a{k}") for k in (1, 2)])
    within = block.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_p{k}": F.bit_xor(f"_h{k}").over(within) for k in (1, 2)})
    rows = rows.join(sums, rows["conv_id"].eqNullSafe(sums["_c"]) & (rows["b"] == sums["_b"]))
    return rows.select("conv_id", "i", "n", "role", "text", *[F.col(f"_p{k}").bitwiseXOR(F.col(f"_a{k}")).alias(f"p{k}") for k in (1, 2)])


def maximal(rows: DataFrame) -> DataFrame:
    """Of positions(): the conversations that prefix no other, conv_id and n, one row each."""
    whole = rows.where(F.col("i") == F.col("n") - 1).groupBy("n", "p1", "p2").agg(F.min(F.struct(F.col("conv_id").isNull().alias("z"), "conv_id"))["conv_id"].alias("conv_id"))
    inner = rows.where(F.col("i") < F.col("n") - 1).select((F.col("i") + 1).alias("n"), "p1", "p2").distinct()
    return whole.join(inner, ["n", "p1", "p2"], "left_anti").select("conv_id", "n")


def render(role: Column, text: Column) -> Column:
    plain = lambda c: F.replace(c, F.lit(MARK), F.lit(PLAIN))
    return F.concat(F.lit(OPEN), plain(role), F.lit("\n"), plain(text), F.lit(CLOSE + "\n"))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, part, n_turns, rendered: the maximal conversations, in parts of PART turns."""
    rows = positions(turns)
    kept = maximal(rows).select(F.col("conv_id").alias("_k"), F.col("n").alias("n_turns"))
    rows = rows.select("conv_id", "i", render(F.col("role"), F.col("text")).alias("line"))
    rows = rows.join(kept, rows["conv_id"].eqNullSafe(kept["_k"])).withColumn("part", F.floor(F.col("i") / PART))
    parts = rows.groupBy("conv_id", "part", "n_turns").agg(F.sort_array(F.collect_list(F.struct("i", "line"))).alias("x"))
    return parts.select("conv_id", "part", "n_turns", F.array_join(F.transform("x", lambda t: t["line"]), "").alias("rendered"))


def chat_query(spark, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


CHAT_SQL = r"""
WITH r AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM r),
h AS (SELECT *, md5(string_agg(role || chr(0) || text || chr(1), '') OVER (PARTITION BY conv_id ORDER BY i)) AS h FROM p),
w AS (SELECT h, min(conv_id) AS conv_id FROM h WHERE i = n - 1 GROUP BY h),
k AS (SELECT conv_id FROM w WHERE h NOT IN (SELECT h FROM h WHERE i < n - 1))
SELECT p.conv_id, p.i // 256 AS part, p.n AS n_turns,
  string_agg('<|im_start|>' || replace(role, '<|im_', '<|_im_') || chr(10) || replace(text, '<|im_', '<|_im_') || '<|im_end|>' || chr(10), '' ORDER BY i) AS rendered
FROM p JOIN k ON p.conv_id IS NOT DISTINCT FROM k.conv_id GROUP BY 1, 2, 3
"""
