"""The engine's named queries over the driver's tables, each with its SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FacetError
from ..functions import strings
from ..operators import postings
from ..operators.arena import Arena
from ..operators.collection import Collection
from ..operators.ordered import OrderedMap
from ..operators.rowsets import RowSet
from ..sources import fields as f
from ..streaming.filters import filter_stream
from . import builder as b

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

FLAGSHIP = '(p_brand = "Brand#2" or p_brand = "Brand#17") and p_size >= 20'
TYPE_RANK = {"ECONOMY": 1, "STANDARD": 2, "MEDIUM": 3, "LARGE": 4, "PROMO": 5, "SMALL": 6}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_fields() -> dict[str, f.Field]:
    ranks = F.create_map(*[F.lit(x) for kv in TYPE_RANK.items() for x in kv])
    return {
        "p_partkey": f.ordered("p_partkey"), "p_brand": f.hashed("p_brand"), "p_type": f.hashed("p_type"), "p_size": f.byte_range("p_size"),
        "size_encoded": f.range_encoded("p_size"), "size_fenwick": f.fenwick("p_size"), "p_retailprice": f.ordered("p_retailprice"),
        "p_name": f.text("p_name", True, "LIKE", "SOUNDS", "FUZZY"), "tag": f.ordered(F.split("p_name", " "), True),
        "name_routed": f.composite(f.hashed("p_name"), f.trigram("p_name"), f.phonetic("p_name"), f.fuzzy("p_name")).route(f.ordered("p_name"), "BETWEEN"),
        "type_rank": f.parsed(f.ordered(F.element_at(ranks, F.col("p_type"))), lambda s: TYPE_RANK[s]),
    }


def part(spark: SparkSession, sf_dir: str) -> Collection:
    return Collection(_table(spark, sf_dir, "part"), "p_partkey", "p_partkey", part_fields())


def orders(spark: SparkSession, sf_dir: str) -> Collection:
    return Collection(_table(spark, sf_dir, "orders"), "o_orderkey", "o_orderkey", {
        "status": f.hashed("o_orderstatus"), "price": f.ordered("o_totalprice"), "priority": f.text("o_orderpriority", True, "LIKE"),
        "day": f.parsed(f.ordered("o_orderdate"), lambda s: dt.datetime.fromisoformat(s)),
    })


def _add(name: str, run: Query, sql: str | None) -> None:
    _QUERIES[name] = run
    if sql is not None:
        _SQL[name] = sql


def _rows(found) -> DataFrame:
    return found.to_df().drop("_rid")


def _part(name: str, query, where: str) -> None:
    """A query on part, as text or expression, and its WHERE clause."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = part(spark, sf_dir)
        return _rows(c.query_str(query) if isinstance(query, str) else c.query(query))

    _add(name, run, f"SELECT * FROM part WHERE {where}")


def _on(name: str, table: str, fields: dict[str, f.Field] | Callable[[], dict[str, f.Field]], query, where: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return filter_stream(_table(spark, sf_dir, table), query, fields() if callable(fields) else fields)

    _add(name, run, f"SELECT * FROM {table} WHERE {where}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(part(spark, sf_dir).query_str(FLAGSHIP))


_add("flagship", flagship, "SELECT * FROM part WHERE (p_brand = 'Brand#2' OR p_brand = 'Brand#17') AND p_size >= 20")

# leaf predicates and index kinds
_part("eq_map", 'p_brand = "Brand#2"', "p_brand = 'Brand#2'")
_add("eq_id", lambda s, d: _rows(orders(s, d).query_str("id = 42")), "SELECT * FROM orders WHERE o_orderkey = 42")
_add("get_by_key", lambda s, d: orders(s, d).lookup(42), "SELECT * FROM orders WHERE o_orderkey = 42")
_part("neq", 'p_type != "PROMO"', "p_type <> 'PROMO'")
for _name, _op in (("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    _part(f"{_name}_sorted", f"p_retailprice {_op} 1200.0", f"p_retailprice {_op} 1200.0")
    _on(f"{_name}_lineitem", "lineitem", {"quantity": f.ordered("l_quantity")}, f"quantity {_op} 25", f"l_quantity {_op} 25")
_part("range_uint8_lt", "p_size < 10", "p_size < 10")
_part("range_uint8_between", "p_size between(10, 20)", "p_size BETWEEN 10 AND 20")
_part("range_encoded_ge", "size_encoded >= 40", "p_size >= 40")
_part("fenwick_between", "size_fenwick between(-5, 12)", "p_size BETWEEN -5 AND 12")
_SEGMENT = {"segment": f.hashed("c_mktsegment"), "nation": f.ordered("c_nationkey"), "balance": f.ordered("c_acctbal")}
_on("in_map", "customer", _SEGMENT, 'segment in("BUILDING", "MACHINERY")', "c_mktsegment IN ('BUILDING', 'MACHINERY')")
_on("in_sorted", "customer", _SEGMENT, "nation in(1, 5, 7)", "c_nationkey IN (1, 5, 7)")
_on("in_empty", "customer", _SEGMENT, b.in_("segment"), "false")
_part("between_int", "p_size between(5, 15)", "p_size BETWEEN 5 AND 15")
_part("between_string", 'p_name between("b", "d")', "p_name BETWEEN 'b' AND 'd'")
_part("between_reversed", "p_size between(15, 5)", "false")
for _name, _pattern in (("prefix", "blue%"), ("suffix", "%ring"), ("contains", "%d w%"), ("both", "b%g"), ("multi", "%l%r%"), ("exact", "hot rod")):
    _part(f"like_{_name}", f'p_name like "{_pattern}"', f"p_name LIKE '{_pattern}'")
_part("like_all", 'p_name like "%"', "true")
_part("like_empty", 'p_name like ""', "false")
_part("like_underscore", 'p_name like "%_%"', r"p_name LIKE '%\_%' ESCAPE '\'")
_on("like_documents", "documents", {"body": f.trigram("text")}, 'body like "%tion%the%"', "text LIKE '%tion%the%'")
_on("like_pages", "pages", {"html": f.trigram("html")}, 'html like "%</article>%"', "html LIKE '%</article>%'")

SOUNDEX_MACRO = """
WITH l AS (SELECT v, upper(regexp_replace(v, '[^A-Za-z]', '', 'g')) AS s FROM {source}),
d AS (SELECT *, translate(s, 'AEIOUYBFPVCGJKQSXZDTLMNR', '000000111122222222334556') AS t FROM l),
e AS (SELECT *, translate(left(t, 1), 'HW', '00') || regexp_replace(substr(t, 2), '[HW]', '', 'g') AS u FROM d),
c AS (SELECT *, {collapse} AS w FROM e),
x AS (SELECT v, CASE WHEN s = '' THEN '' ELSE left(s, 1) || left(replace(substr(w, 2), '0', '') || '000', 3) END AS code FROM c)
"""
_collapse = "u"
for _k in range(7):
    _collapse = f"regexp_replace({_collapse}, '{_k}+', '{_k}', 'g')"


def _soundex_sql(source: str) -> str:
    return SOUNDEX_MACRO.format(source=source, collapse=_collapse)


_part("sounds", 'p_name sounds "bleu bold"', "true")
_SQL["sounds"] = _soundex_sql("(SELECT DISTINCT p_name AS v FROM part UNION SELECT 'bleu bold')") + "SELECT p.* FROM part p JOIN x ON p.p_name = x.v WHERE x.code = (SELECT any_value(code) FROM x WHERE v = 'bleu bold')"
_part("fuzzy_default", 'p_name fuzzy "old bolt"', "levenshtein(p_name, 'old bolt') <= 2")
for _k in (0, 1, 3):
    _part(f"fuzzy_d{_k}", f'p_name fuzzy("old bolt", {_k})', f"levenshtein(p_name, 'old bolt') <= {_k}")
_part("all_rows", b.all_(), "true")
_part("no_rows", b.none_(), "false")
_part("is_null", b.is_null("p_name"), "p_name IS NULL")

# connectives and rewrites
_part("and", 'p_brand = "Brand#2" and p_size > 20', "p_brand = 'Brand#2' AND p_size > 20")
_part("or", 'p_brand = "Brand#2" or p_size > 45', "p_brand = 'Brand#2' OR p_size > 45")
_part("not", 'not p_brand = "Brand#2"', "NOT p_brand = 'Brand#2'")
_part("and_not", b.and_not(b.gt("p_size", 20), b.eq("p_type", "PROMO")), "p_size > 20 AND NOT p_type = 'PROMO'")
_part("nested", 'p_size > 10 and (p_type = "PROMO" or not (p_brand = "Brand#2" or p_size >= 40))', "p_size > 10 AND (p_type = 'PROMO' OR NOT (p_brand = 'Brand#2' OR p_size >= 40))")
_part("de_morgan", 'not (p_size > 10 and p_type = "PROMO")', "NOT (p_size > 10 AND p_type = 'PROMO')")
_part("bang", '!(p_type = "PROMO") and !p_size <= 30', "NOT p_type = 'PROMO' AND NOT p_size <= 30")
_part("precedence", 'p_type = "PROMO" or p_size > 40 and p_brand = "Brand#2"', "p_type = 'PROMO' OR (p_size > 40 AND p_brand = 'Brand#2')")
_part("strict_range", "p_size > 10 and p_size < 20", "p_size > 10 AND p_size < 20")
_part("impossible_range", "p_size > 10 and p_size < 5", "false")
_part("not_impossible", "not (p_size > 10 and p_size < 5)", "true")

# fields of many values
_TAGS = "string_split(p_name, ' ')"
_part("multi_eq", 'tag = "blue"', f"list_contains({_TAGS}, 'blue')")
_part("multi_in", 'tag in("blue", "rod")', f"list_has_any({_TAGS}, ['blue', 'rod'])")
_part("multi_gt", 'tag > "r"', f"len(list_filter({_TAGS}, lambda x: x > 'r')) > 0")
_part("multi_neq", 'tag != "blue"', f"NOT list_contains({_TAGS}, 'blue')")
_part("multi_not_gt", 'not tag > "r"', f"len(list_filter({_TAGS}, lambda x: x > 'r')) = 0")
_part("multi_two_bounds", 'tag > "b" and tag < "c"', f"len(list_filter({_TAGS}, lambda x: x > 'b')) > 0 AND len(list_filter({_TAGS}, lambda x: x < 'c')) > 0")
_part("multi_between", 'tag between("b", "c")', f"len(list_filter({_TAGS}, lambda x: x BETWEEN 'b' AND 'c')) > 0")

# parsed literals, own operators, routes
_RANK = "CASE p_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in TYPE_RANK.items()) + " END"
_part("parser_ext_enum", 'type_rank >= "MEDIUM"', f"{_RANK} >= 3")
_add("parser_ext_date", lambda s, d: _rows(orders(s, d).query_str('day >= "1996-01-01"')), "SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'")
_EVENT = {"value": f.ordered("value").with_op("near", lambda c, at, by=1.0: F.abs(c - at) <= by), "kind": f.hashed("event_type")}
_on("user_op", "events", _EVENT, "value near 100.0", "abs(value - 100.0) <= 1.0")
_on("user_op_many", "events", _EVENT, "value near(100.0, 5.0)", "abs(value - 100.0) <= 5.0")
_part("composite_route", 'name_routed like "%bolt" and (name_routed between("a", "m") or name_routed = "old bolt" or name_routed fuzzy "red bolt")',
      "p_name LIKE '%bolt' AND (p_name BETWEEN 'a' AND 'm' OR p_name = 'old bolt' OR levenshtein(p_name, 'red bolt') <= 2)")

# count, pages, trace
_add("count", lambda s, d: part(s, d).query_str(FLAGSHIP).count_df(), "SELECT count(*) AS n FROM part WHERE (p_brand = 'Brand#2' OR p_brand = 'Brand#17') AND p_size >= 20")
for _name, _offset, _limit in (("first", 0, 10), ("middle", 50, 25), ("past_end", 10_000_000, 5), ("unlimited", 100, 0)):
    _add(f"page_{_name}", lambda s, d, o=_offset, n=_limit: orders(s, d).query_str("price >= 1000.0").page(o, n),
         f"SELECT * FROM orders WHERE o_totalprice >= 1000.0 ORDER BY o_orderkey {f'LIMIT {_limit}' if _limit else ''} OFFSET {_offset}")
_add("page_info", lambda s, d: orders(s, d).query_str("price >= 1000.0").page_info_df(50, 25),
     "SELECT 50::BIGINT AS \"offset\", 25::BIGINT AS \"limit\", least(25, greatest(count(*) - 50, 0))::BIGINT AS count, count(*) AS total FROM orders WHERE o_totalprice >= 1000.0")
_W = ("p_brand = 'Brand#2'", "p_brand = 'Brand#17'", "p_size >= 20")
_TRACED = [(f"({_W[0]} OR {_W[1]}) AND {_W[2]}", "p_brand = Brand#2 OR p_brand = Brand#17 AND p_size >= 20"), (f"{_W[0]} OR {_W[1]}", "p_brand = Brand#2 OR p_brand = Brand#17"), *zip(_W, ("p_brand = Brand#2", "p_brand = Brand#17", "p_size >= 20"), strict=True)]
_add("trace_counts", lambda s, d: part(s, d).query_str(FLAGSHIP).trace_df(),
     " UNION ALL ".join(f"SELECT {i} AS node, '{text}' AS text, count(*) AS matches FROM part WHERE {where}" for i, (where, text) in enumerate(_TRACED)))


# changes
def _nation(spark: SparkSession, sf_dir: str) -> Collection:
    return Collection(_table(spark, sf_dir, "nation"), "n_nationkey", "n_nationkey", {"name": f.text("n_name", True, "LIKE")})


def _some_nations(spark: SparkSession, sf_dir: str, shift: int) -> DataFrame:
    some = _table(spark, sf_dir, "nation").where("n_nationkey < 3")
    return some.withColumns({"n_nationkey": (F.col("n_nationkey") + shift).cast("int"), "n_name": F.concat(F.lit("NEW "), F.col("n_name"))})


_NEW = "SELECT (n_nationkey + {0})::INT AS n_nationkey, 'NEW ' || n_name AS n_name, n_regionkey FROM nation WHERE n_nationkey < 3"
_OLD = "SELECT n_nationkey, n_name, n_regionkey FROM nation"
_add("crud_insert", lambda s, d: _rows(_nation(s, d).insert(_some_nations(s, d, 100)).query(b.all_())), f"{_OLD} UNION ALL {_NEW.format(100)}")
_add("crud_update", lambda s, d: _rows(_nation(s, d).update(_some_nations(s, d, 0)).query(b.all_())), f"{_OLD} WHERE n_nationkey >= 3 UNION ALL {_NEW.format(0)}")
_add("crud_remove", lambda s, d: _rows(_nation(s, d).remove(3, 7).query(b.all_())), f"{_OLD} WHERE n_nationkey NOT IN (3, 7)")
_add("crud_bulk", lambda s, d: _rows(_nation(s, d).remove_where(b.all_()).bulk_insert(_some_nations(s, d, 0)).query(b.all_())), _NEW.format(0))
_add("compact_remap", lambda s, d: part(s, d)._like(part(s, d).query_str("p_size > 10").to_df()).compact()[1],
     "SELECT * FROM (SELECT p_partkey AS old, row_number() OVER (ORDER BY p_partkey) - 1 AS new FROM part WHERE p_size > 10) WHERE old <> new")
_add("arena_stale", lambda s, d: Arena.of(_table(s, d, "nation"), "n_nationkey").remove(3, 0).fill(3, n_name="AGAIN").get(3, 1).select("n_nationkey", "n_name", F.col("_gen").alias("generation")),
     "SELECT 3::INT AS n_nationkey, 'AGAIN' AS n_name, 1::BIGINT AS generation")


def _twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two new rows for each of three keys, in order."""
    some = _some_nations(spark, sf_dir, 0)
    return some.withColumn("n_name", F.lit("FIRST")).unionByName(some)


_add("crud_update_repeated", lambda s, d: _rows(_nation(s, d).update(_twice(s, d)).query(b.all_())), f"{_OLD} WHERE n_nationkey >= 3 UNION ALL {_NEW.format(0)}")


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = part(spark, sf_dir)
    return spark.createDataFrame([(c.contains(7), c.contains(-1), c.count(), len(c.query_str(FLAGSHIP).values()))], "has boolean, lacks boolean, n bigint, found bigint")


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = part(spark, sf_dir).create_index("width", f.ordered("p_size"))
    c.remove_index("p_size")
    return _rows(c.query_str("width > 30"))


_add("list_facts", _facts, "SELECT count(*) FILTER (p_partkey = 7) > 0 AS has, count(*) FILTER (p_partkey = -1) > 0 AS lacks, count(*) AS n, count(*) FILTER ((p_brand = 'Brand#2' OR p_brand = 'Brand#17') AND p_size >= 20) AS found FROM part")
_add("index_added", _indexed, "SELECT * FROM part WHERE p_size > 30")
_add("list_without_key", lambda s, d: _rows(Collection(_table(s, d, "part"), fields=part_fields()).query_str("p_size > 30")), "SELECT * FROM part WHERE p_size > 30")
_add("scan_in_order", lambda s, d: part(s, d).scan().limit(50).select("p_partkey", "p_name"), "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 50")
_add("scan_filter", lambda s, d: part(s, d).filter("p_size % 7 = 3").drop("_rid"), "SELECT * FROM part WHERE p_size % 7 = 3")
_add("projection", lambda s, d: part(s, d).query_str(FLAGSHIP).to_df().select("p_name", "p_size"), "SELECT p_name, p_size FROM part WHERE (p_brand = 'Brand#2' OR p_brand = 'Brand#17') AND p_size >= 20")
_add("without_optimizer", lambda s, d: _rows(part(s, d).query_str("not (p_size > 10 and p_size < 5) and p_size < 9", optimizer=False)), "SELECT * FROM part WHERE p_size < 9")
_add("literal_escapes", lambda s, d: _rows(part(s, d).query_str('p_brand = "Bran\\d#2"')), "SELECT * FROM part WHERE p_brand = 'Brand#2'")
_on("literal_bool", "part", lambda: {"large": f.hashed(F.col("p_size") > 20)}, "large = true", "p_size > 20")
_on("literal_decimal", "part", lambda: {"price": f.ordered(F.col("p_retailprice").cast("decimal(12,2)"))}, "price >= 1200.5 and price != 1201.005", "p_retailprice::DECIMAL(12, 2) >= 1200.5")
_on("many_terms", "part", {"key": f.ordered("p_partkey")}, " or ".join(f"key = {3 * i}" for i in range(1200)), "p_partkey % 3 = 0 AND p_partkey < 3600")
_WRONG = {"nothing = 1": "InvalidName", 'p_size = "x"': "InvalidValueType", "p_size = 256": "OutOfRange", "p_brand < 3": "InvalidOperation", "p_size = ": "ParseError", "p_size = 1 )": "ParseError"}


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of error of each wrong query; all come before a job runs."""
    found, c = [], part(spark, sf_dir)
    for text in _WRONG:
        try:
            c.query_str(text).to_df()
        except FacetError as error:
            found.append((text, type(error).__name__))
    return spark.createDataFrame(found, "query string, error string")


_add("errors", _errors, "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _WRONG.items()) + ") t(query, error)")


# sets and ordered maps
def _sets(spark: SparkSession, sf_dir: str) -> tuple[RowSet, RowSet]:
    df = _table(spark, sf_dir, "part")
    return RowSet.where(df, F.col("p_size") > 20, "p_partkey"), RowSet.where(df, F.col("p_type") == "PROMO", "p_partkey")


_A, _B = "SELECT p_partkey AS _rid FROM part WHERE p_size > 20", "SELECT p_partkey AS _rid FROM part WHERE p_type = 'PROMO'"
for _name, _set, _sql in (("and", lambda x, y: x & y, f"{_A} INTERSECT {_B}"), ("or", lambda x, y: x | y, f"{_A} UNION {_B}"),
                          ("xor", lambda x, y: x ^ y, f"({_A} EXCEPT {_B}) UNION ({_B} EXCEPT {_A})"), ("andnot", lambda x, y: x - y, f"{_A} EXCEPT {_B}")):
    _add(f"set_{_name}", lambda s, d, g=_set: g(*_sets(s, d)).ids, _sql)
_add("set_bounds", lambda s, d: _sets(s, d)[0].bounds_df(), f"SELECT coalesce(min(_rid), -1) AS min, coalesce(max(_rid), -1) AS max FROM ({_A})")
_add("set_kth", lambda s, d: _sets(s, d)[0].kth_df(7), f"{_A} ORDER BY 1 LIMIT 1 OFFSET 7")
_add("set_range", lambda s, d: _sets(s, d)[0].range(100, 300).ids, f"SELECT * FROM ({_A}) WHERE _rid BETWEEN 100 AND 300")
_add("set_without", lambda s, d: _sets(s, d)[0].without(F.col("_rid") % 2 == 0).ids, f"SELECT * FROM ({_A}) WHERE _rid % 2 <> 0")


_add("set_insert_delete", lambda s, d: _sets(s, d)[0].add(5, 999_999_999).discard(7, 8).ids, f"({_A} AND p_partkey NOT IN (7, 8)) UNION SELECT 5 UNION SELECT 999999999")
_add("set_of_repeats", lambda s, d: s.createDataFrame([(len(x := RowSet(_table(s, d, "part").select("p_size"))), x.is_empty(), 3 in x)], "n bigint, empty boolean, three boolean"),
     "SELECT count(DISTINCT p_size) AS n, count(*) = 0 AS empty, count(*) FILTER (p_size = 3) > 0 AS three FROM part")
_add("set_batches", lambda s, d: s.createDataFrame([(i, x[0], x[-1], len(x)) for i, x in enumerate(_sets(s, d)[0].batches(64))], "batch bigint, first bigint, last bigint, n bigint"),
     f"SELECT i // 64 AS batch, min(_rid)::BIGINT AS first, max(_rid)::BIGINT AS last, count(*) AS n FROM (SELECT _rid, row_number() OVER (ORDER BY _rid) - 1 AS i FROM ({_A})) GROUP BY 1")
_add("set_convert", lambda s, d: RowSet.of(s, _sets(s, d)[0].values()).bitmaps().select(F.sum(F.expr("bitmap_count(bitmap)")).alias("n")), f"SELECT count(*) AS n FROM ({_A})")


def _map(spark: SparkSession, sf_dir: str) -> OrderedMap:
    return OrderedMap(_table(spark, sf_dir, "part"), "p_partkey", "p_name")


_MAP = "SELECT p_partkey, p_name FROM part"
_add("ordered_ends", lambda s, d: _map(s, d).ends(), "SELECT min(p_partkey) AS min_key, max(p_partkey) AS max_key, arg_min(p_name, p_partkey) AS first_value, arg_max(p_name, p_partkey) AS last_value FROM part")
_add("ordered_range", lambda s, d: _map(s, d).range(10, 40), f"{_MAP} WHERE p_partkey BETWEEN 10 AND 40")
_add("ordered_less", lambda s, d: _map(s, d).less(10), f"{_MAP} WHERE p_partkey < 10")
_add("ordered_less_equal", lambda s, d: _map(s, d).less_equal(10), f"{_MAP} WHERE p_partkey <= 10")
_add("ordered_greater", lambda s, d: _map(s, d).greater(150), f"{_MAP} WHERE p_partkey > 150")
_add("ordered_greater_equal", lambda s, d: _map(s, d).greater_equal(150), f"{_MAP} WHERE p_partkey >= 150")
_add("ordered_multi_get", lambda s, d: _map(s, d).multi_get(3, 999_999_999, 1, 7), f"{_MAP} WHERE p_partkey IN (1, 3, 7)")
_add("ordered_put_delete", lambda s, d: _map(s, d).delete(1).put(2, "changed")[0].less(5), f"SELECT p_partkey, CASE p_partkey WHEN 2 THEN 'changed' ELSE p_name END AS p_name FROM part WHERE p_partkey < 5 AND p_partkey <> 1")


_add("ordered_traverse", lambda s, d: s.createDataFrame([(i, *r) for i, r in enumerate(islice(_map(s, d).traverse(), 40))], "place bigint, p_partkey bigint, p_name string"),
     f"SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS place, p_partkey::BIGINT AS p_partkey, p_name FROM ({_MAP} ORDER BY p_partkey LIMIT 40)")


# functions and stored access paths
def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_name").distinct()


_add("soundex_codes", lambda s, d: _names(s, d).select("p_name", strings.soundex(F.col("p_name")).alias("code")),
     _soundex_sql("(SELECT DISTINCT p_name AS v FROM part)") + "SELECT v AS p_name, code FROM x")
_add("levenshtein_scores", lambda s, d: _names(s, d).select("p_name", strings.levenshtein(F.col("p_name"), F.lit("öld bolt")).alias("d")),
     "SELECT DISTINCT p_name, levenshtein(p_name, 'öld bolt')::INT AS d FROM part")
_once = "raw"
for _k in range(9):
    _once = f"regexp_replace({_once}, '{_k}+', '{_k}', 'g')"
COLOGNE_SQL = f"""
WITH l AS (SELECT p_name, regexp_replace(translate(replace(p_name, 'ß', 'SS'), 'abcdefghijklmnopqrstuvwxyzäöüÄÖÜ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZAOUAOU'), '[^A-Z]', '', 'g') AS s
           FROM (SELECT DISTINCT p_name FROM part)),
i AS (SELECT p_name, s, unnest(range(1, len(s) + 1)) AS i FROM l),
n AS (SELECT p_name, i, substr(s, i, 1) AS c, CASE WHEN i > 1 THEN substr(s, i - 1, 1) ELSE '' END AS b, substr(s, i + 1, 1) AS a FROM i),
d AS (SELECT p_name, i, CASE WHEN c IN ('A', 'E', 'I', 'J', 'O', 'U', 'Y') THEN '0' WHEN c = 'H' THEN '' WHEN c = 'B' OR c = 'P' AND a <> 'H' THEN '1'
        WHEN c IN ('D', 'T') THEN CASE WHEN a IN ('C', 'S', 'Z') THEN '8' ELSE '2' END WHEN c IN ('F', 'V', 'W', 'P') THEN '3' WHEN c IN ('G', 'K', 'Q') THEN '4'
        WHEN c = 'C' THEN CASE WHEN i = 1 AND a IN ('A', 'H', 'K', 'L', 'O', 'Q', 'R', 'U', 'X') OR i > 1 AND a IN ('A', 'H', 'K', 'O', 'Q', 'U', 'X') AND b NOT IN ('S', 'Z') THEN '4' ELSE '8' END
        WHEN c = 'X' THEN CASE WHEN b IN ('C', 'K', 'Q') THEN '8' ELSE '48' END WHEN c = 'L' THEN '5' WHEN c IN ('M', 'N') THEN '6' WHEN c = 'R' THEN '7' ELSE '8' END AS x FROM n),
r AS (SELECT l.p_name, coalesce(string_agg(x, '' ORDER BY i), '') AS raw FROM l LEFT JOIN d USING (p_name) GROUP BY 1),
o AS (SELECT p_name, {_once} AS o FROM r),
z AS (SELECT p_name, left(left(o, 1) || replace(substr(o, 2), '0', ''), 7) AS z FROM o)
SELECT p_name, CASE WHEN z = '' THEN 0 ELSE (16 ** len(z) + list_sum(list_transform(range(1, len(z) + 1), lambda k: substr(z, k, 1)::DOUBLE * 16 ** (len(z) - k)))) END::BIGINT AS code FROM z
"""
_add("cologne_codes", lambda s, d: _names(s, d).select("p_name", strings.cologne(F.col("p_name")).alias("code")), COLOGNE_SQL)
_add("substring_get", lambda s, d: _table(s, d, "part").where(strings.contains(F.col("p_name"), "ol")), "SELECT * FROM part WHERE contains(p_name, 'ol')")
_add("gram_postings_like", lambda s, d: postings.like_by_grams(t := _table(s, d, "part"), postings.gram_postings(t, "p_partkey", "p_name"), "p_partkey", "p_name", "%old%olt"), "SELECT * FROM part WHERE p_name LIKE '%old%olt'")
_add("bitmap_counts", lambda s, d: postings.count_values(postings.value_bitmaps(_table(s, d, "part"), "p_partkey", "p_brand"), "Brand#2", "Brand#17"),
     "SELECT count(*)::BIGINT AS n FROM part WHERE p_brand IN ('Brand#2', 'Brand#17')")


def bench_ranges(spark: SparkSession, sf_dir: str = "", rows: int = 3_000_000) -> DataFrame:
    """Range counts over generated values, all in one pass."""
    df = spark.range(rows).select((F.col("id") % 100).cast("smallint").alias("v"))
    v = F.col("v")
    return df.agg(F.count_if(v < 40).alias("lt40"), F.count_if(v > 60).alias("gt60"), F.count_if(v.between(40, 60)).alias("between"))


def bench_sets(spark: SparkSession, sf_dir: str = "") -> DataFrame:
    ids = spark.range(1, 3_000_001)
    a, c = RowSet(ids.where("id % 3 = 0")), RowSet(ids.where("id % 6 = 0"))
    n = lambda s, name: s.ids.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
    return n(a & c, "and").unionByName(n(a | c, "or")).unionByName(n(a ^ c, "xor"))


_add("bench_ranges", bench_ranges, 'SELECT count(*) FILTER (v < 40) AS lt40, count(*) FILTER (v > 60) AS gt60, count(*) FILTER (v BETWEEN 40 AND 60) AS "between" FROM (SELECT range % 100 AS v FROM range(3000000))')
_add("bench_sets", bench_sets, "SELECT * FROM (VALUES ('and', 500000::BIGINT), ('or', 1000000), ('xor', 500000)) t(op, n)")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
