"""Queries, collections, sets and functions against golden results and a naive evaluator."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.errors import FacetError, InvalidArgsLen, InvalidName, InvalidOperation, InvalidValueType, NoKey, OutOfRange, ParseError, ValueNotFound
from sievework.functions import strings
from sievework.functions.literals import coerce
from sievework.operators import postings
from sievework.operators.arena import Arena
from sievework.operators.collection import Collection, with_row_ids
from sievework.operators.ordered import OrderedMap
from sievework.operators.result import PageInfo
from sievework.operators.rowsets import RowSet
from sievework.plans import builder as b
from sievework.plans.ast import And, AndNot, FalseE, Not, Or, Term, TermMany, TrueE
from sievework.plans.parser import parse
from sievework.sources import fields as f
from sievework.sources import files
from sievework.streaming.filters import filter_stream


@pytest.fixture(scope="module")
def users(spark):
    df = spark.createDataFrame([(0, 40, "Paul's", "developer", True, 3.0), (1, 42, "Alice", "admin", False, 1.2)], "_rid long, key long, name string, role string, ok boolean, price double")
    return Collection(df, id="key", fields={"name": f.text("name", True, "LIKE", "SOUNDS", "FUZZY"), "role": f.hashed("role"), "ok": f.hashed("ok"), "price": f.ordered("price")})


#: Query texts over the two users and the ids they find.
QUERIES = [
    ("id = 42", {1}), ('role="admin"', {1}), ("price = 1.2", {1}), ("price = 4.2", set()), ("ok = false", {1}), ("ok = true", {0}), ("NOT(ok = true)", {1}),
    ("price < 3.0", {1}), ("price <= 3.0", {0, 1}), ("price > 1.2", {0}), ("price >= 1.2", {0, 1}), ('!(role = "admin")', {0}), ('!role = "admin"', {0}),
    ('NOT(NOT(role = "admin"))', {1}), ('NOT(role != "admin")', {1}), ("Not(price > 1.2)", {1}), ("Not(price < 3.0)", {0}),
    ("Not(price = 1.2 AND price = 3.0)", {0, 1}), ("Not(price = 1.2 OR price = 3.0)", set()), ('id = 42 and role = "admin"', {1}), ("ok = true or price = 0.0", {0}),
    ('role = "admin" AND price = 9.9', set()), ("not (ok = true or price = 0.0)", {1}), ('role = "admin" OR ok = tRue AND price = 1.2', {1}),
    ("price between(1.2, 3.0)", {0, 1}), ("price between(3.0, 1.2)", set()), ('name like "%lic%"', {1}), ('name like "%Alice%"', {1}), (r'name like "%l\'s%"', {0}),
    ('name like "%nix%"', set()), ('name like "Al%"', {1}), ('name like "al%"', set()), ('name sounds "Alice"', {1}), ('name fuzzy  "Alice"', {1}),
    ('name fuzzy("Alice", 1)', {1}), ('name fuzzy("Alice", -1)', None), ("price in(1.2, 3.0)", {0, 1}), ('role in("developer", "admin")', {0, 1}), ('role in("nix")', set()),
    ("price > 10 and price < 5", set()), ("NOT(price > 10 and price < 5)", {0, 1}), ("price = 3", {0}), ("id != 7", {0, 1}), ("id = 7", set()),
]


def ids(result):
    return {r["_rid"] for r in result.to_df().collect()}


@pytest.mark.parametrize(("text", "want"), QUERIES)
def test_text_queries(users, text, want):
    for optimizer in (True, False):
        assert ids(users.query_str(text, optimizer=optimizer)) == (want or set())


def test_errors_come_before_jobs(users):
    with pytest.raises(InvalidName):
        users.query_str("nix = 1")
    with pytest.raises(InvalidName):
        users.query_str('role = "a" and ID = 1')
    with pytest.raises(InvalidOperation):
        users.query_str('role < "a"')
    with pytest.raises(InvalidOperation):
        users.query_str("price near 1.0")
    with pytest.raises(InvalidValueType):
        users.query_str('price = "1"')
    with pytest.raises(InvalidValueType):
        users.query_str("ok = 1")
    with pytest.raises(InvalidArgsLen):
        users.query(b.between("price", 1.0)).to_df()
    with pytest.raises(ParseError):
        users.query_str("role = ").count()
    # also where a rewrite would drop the wrong half
    with pytest.raises(InvalidName):
        users.query_str("(price > 2 and price < 1) and nix = 1")


def test_coercion():
    assert coerce(5, T.ShortType(), (0, 255)) == 5
    assert coerce(2, T.DoubleType()) == 2.0
    for value, kind in ((256, T.ByteType()), (1 << 31, T.IntegerType()), (1e39, T.FloatType())):
        with pytest.raises(OutOfRange):
            coerce(value, kind)
    for value, kind in ((1.0, T.LongType()), (True, T.LongType()), (1, T.StringType()), ("a", T.BooleanType()), (True, T.DoubleType())):
        with pytest.raises(InvalidValueType):
            coerce(value, kind)
    assert coerce(dt.date(2020, 1, 1), T.DateType()) == dt.date(2020, 1, 1)


def test_float_literals_narrow(spark):
    c = Collection(spark.sql("SELECT 1L AS _rid, cast(-3.2 AS float) AS f32, cast(-8 AS tinyint) AS i8"), fields={"f32": f.ordered("f32"), "i8": f.ordered("i8")})
    assert c.query_str("f32 = -3.2 and i8 = -8").count() == 1
    with pytest.raises(OutOfRange):
        c.query_str("i8 < 128")


def test_bytes_ranges(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (255, 255)], "_rid long, v short")
    for make in (f.byte_range, f.ordered, f.range_encoded, f.fenwick):
        c = Collection(df, fields={"v": make("v")})
        assert ids(c.query_str("v < 3")) == {1, 2}
        assert ids(c.query_str("v >= 3")) == {3, 255}
        assert ids(c.query_str("v between(1, 3)")) == {1, 2, 3}
        assert ids(c.query_str("v between(2, 1)")) == set()
        if make in (f.byte_range, f.range_encoded):
            with pytest.raises(OutOfRange):
                c.query_str("v < 256")
        if make in (f.range_encoded, f.fenwick):
            with pytest.raises(InvalidOperation):
                c.query_str("v = 1")
            with pytest.raises(InvalidOperation):
                c.query_str("v != 1")


def test_many_values(spark):
    c = Collection(spark.createDataFrame([(0, [0, 3]), (1, [2, 3, 4]), (2, [2, 5]), (3, []), (4, None)], "_rid long, v array<short>"), fields={"v": f.byte_range("v", True)})
    for text, want in (("v = 3", {0, 1}), ("v = 100", set()), ("v in(3, 4)", {0, 1}), ("v >= 2", {0, 1, 2}), ("v between(5, 9)", {2}), ("v != 3", {2, 3, 4}),
                       ("not v > 3", {0, 3, 4}), ("v > 2 and v < 1", {0}), ("v > 4 and v < 3", {2})):
        assert ids(c.query_str(text)) == want, text
    assert ids(c.query(b.in_("v"))) == set()


def test_nulls_are_in_complements(spark):
    c = Collection(spark.createDataFrame([(0, 1), (1, 9), (2, None)], "_rid long, v int"), fields={"v": f.ordered("v")})
    for text, want in (("v > 5", {1}), ("not v > 5", {0, 2}), ("v != 9", {0, 2}), ("not (v > 5 or v < 3)", {2}), ("not not v > 5", {1})):
        assert ids(c.query_str(text)) == want
    assert ids(c.query(b.eq("v", None))) == ids(c.query(b.is_null("v"))) == {2}
    assert ids(c.query(b.and_not(b.all_(), b.gt("v", 5)))) == {0, 2}


LIKE7 = ["apple", "application", "apply", "banana", "bandana", "ban", ""]
#: Patterns and the rows of LIKE7 they match.
PATTERNS = [("appl%", {0, 1, 2}), ("%tion", {1}), ("%ppl%", {0, 1, 2}), ("app%y", {2}), ("ban%ana", {3, 4}), ("ba%n%ana", {3, 4}), ("ban", {5}), ("%", set(range(7))), ("%%", set(range(7))),
            ("", set()), ("xyz%", set()), ("ban%%ana", {3, 4}), ("apple%", {0}), ("%ana%ban%", set()), ("a%p%p%l%", {0, 1, 2}), ("a%p%p%l%i%c%a%t%i%o%n", {1}), ("b_n", set()), ("%\\%", set())]


def test_like(spark):
    df = spark.createDataFrame(list(enumerate(LIKE7)), "_rid long, s string")
    grams = postings.gram_postings(df, "_rid", "s")
    for pattern, want in PATTERNS:
        assert {r[0] for r in df.where(strings.like(F.col("s"), pattern)).collect()} == want, pattern
        assert {r[0] for r in postings.like_by_grams(df, grams, "_rid", "s", pattern).collect()} == want, pattern
    assert {r[0] for r in df.where(strings.contains(F.col("s"), "ana")).collect()} == {3, 4}
    assert df.where(strings.contains(F.col("s"), "")).count() == 0


#: Names and their codes.
SOUNDEX = {"Robert": "R163", "Rupert": "R163", "Rubin": "R150", "Ashcraft": "A261", "Tymczak": "T522", "Pfister": "P236", "Smith": "S530", "Johnson": "J525", "": "", "123": "",
           "123 abc": "A120", "A": "A000", "John-Doe": "J530", "Hugh": "H200", "Lloyd": "L300", "_Jones": "J520", "Hw": "H000", "R2D2": "R300", "!@#A123B": "A100"}
COLOGNE = {"Müller": "657", "Wikipedia": "3412", "Breschnew": "17863", "Schmidt": "862", "Schneider": "8627", "Fischer": "387", "Wagner": "3467", "Hoffmann": "0366", "Koch": "44",
           "Richter": "7427", "Schröder": "8727", "Zimmermann": "86766", "Ärger": "0747", "Öl": "05", "Übung": "0164", "Strauß": "8278", "MÜLLER": "657", "Philipp": "351", "Phönix": "3648",
           "Deutsch": "28", "Fritz": "378", "Carl": "475", "Cäsar": "487", "Szene": "86", "Xaver": "4837", "Hexe": "048", "": "", "123": "", "H": "", "A": "0", "Anna": "06", "hans": "068"}


def test_codes(spark):
    s = spark.createDataFrame([(k,) for k in SOUNDEX], "s string").select("s", strings.soundex(F.col("s")))
    assert dict(map(tuple, s.collect())) == SOUNDEX
    c = spark.createDataFrame([(k,) for k in COLOGNE], "s string").select("s", strings.cologne_digits(F.col("s")), strings.cologne(F.col("s")))
    for name, digits, packed in c.collect():
        assert digits == COLOGNE[name], name
        assert packed == (int("1" + digits, 16) if digits else 0)


def test_distances(spark):
    pairs = [("", "", 0), ("abc", "", 3), ("kitten", "sitting", 3), ("saturday", "sunday", 3), ("microsoft", "mikrosft", 2), ("Müller", "Muller", 2)]
    df = spark.createDataFrame(pairs, "a string, b string, d int")
    assert df.where(strings.levenshtein(F.col("a"), F.col("b")) != F.col("d")).count() == 0
    for a, word, d in pairs:
        one = spark.createDataFrame([(a,)], "a string")
        for k in range(-1, 5):
            assert one.where(strings.within(F.col("a"), word, k)).count() == int(d <= k)


def test_parsed_routed_and_own_operators(spark):
    df = spark.createDataFrame([(0, "Opel", 2), (1, "Mercedes", 1), (2, "Dacia", 1), (3, "Opel", 3)], "_rid long, name string, type int")
    kinds = {"van": 0, "suv": 1, "electric": 2, "coupe": 3}
    name = f.composite(f.hashed("name"), f.trigram("name"), f.phonetic("name")).route(f.ordered("name"), "<").with_op("starts", lambda c, *v: c.substr(1, 1).isin(*v))
    c = Collection(df, fields={"type": f.parsed(f.hashed("type"), kinds.__getitem__), "name": name})
    assert ids(c.query_str('type = "electric" or type = "coupe"')) == {0, 3}
    assert ids(c.query_str('type in("van", "suv")')) == {1, 2}
    with pytest.raises(InvalidValueType):
        c.query_str("type = 1")
    assert ids(c.query_str('name like "%e%" and name sounds "Opl" and name < "P"')) == {0, 3}
    with pytest.raises(InvalidOperation):
        c.query_str('name > "P"')
    assert ids(c.query_str('name starts "D"')) == {2}
    assert ids(c.query_str('not name starts("D", "O")')) == {1}
    with pytest.raises(InvalidOperation):
        c.query_str('name Starts "D"')


def test_pages_and_trace(spark):
    df = spark.createDataFrame([(0, "Opel", 22), (1, "Mercedes", 5), (2, "Dacia", 22)], "_rid long, name string, age int")
    c = Collection(df, id="name", fields={"age": f.ordered("age")})
    everything = c.query(b.all_())
    for offset, limit, info, names in ((0, 1, (0, 1, 1, 3), ["Opel"]), (1, 5, (1, 5, 2, 3), ["Mercedes", "Dacia"]), (5, 1, (5, 1, 0, 3), []), (1, 0, (1, 3, 2, 3), ["Mercedes", "Dacia"])):
        rows, page = everything.paginate(offset, limit)
        assert page == PageInfo(*info) and [r["name"] for r in rows] == names
        assert tuple(everything.page_info_df(offset, limit).first()) == info
    trace = c.query_str("age > 10 and not age > 30", optimizer=False).trace()
    assert trace.matches == 2 and [t.matches for t in trace.children] == [2, 3] and trace.seconds > 0
    assert trace.pretty().splitlines()[1].startswith("    ├── age > 10  [-] (2 matches)")
    assert c.query_str("age > 10").count() == 2 and [r["name"] for r in c.query_str("age > 10").values()] == ["Opel", "Dacia"]


def test_changes(spark, tmp_path):
    df = spark.createDataFrame([(1, "Dacia", 2), (2, "Opel", 12), (3, "Mercedes", 5), (4, "Dacia", 22)], "id long, name string, age int")
    c = Collection(df, id="id", order_by="id", fields={"name": f.hashed("name")})
    assert c.get(3)["name"] == "Mercedes" and c.contains(4) and not c.contains(9)
    with pytest.raises(ValueNotFound):
        c.get(9)
    c2 = c.remove(4)
    assert c2.count() == 3 and c.count() == 4
    with pytest.raises(ValueNotFound):
        c2.remove(4)
    c3 = c2.insert([(3, "Second", 1)])
    assert c3.get(3)["name"] == "Second" and c3.count() == 4
    assert c3.remove(3).get(3)["name"] == "Mercedes"
    c4 = c3.update(spark.createDataFrame([(1, "New", 9)], "id long, name string, age int"))
    assert c4.get(1)["name"] == "New" and [r["id"] for r in c4.query(b.all_()).values()] == [1, 2, 3, 3]
    with pytest.raises(ValueNotFound):
        c3.update(spark.createDataFrame([(9, "New", 9)], "id long, name string, age int"))
    with pytest.raises(NoKey):
        Collection(df, order_by="id").get(1)
    with pytest.raises(ValueError, match="empty"):
        c.bulk_insert(df)
    assert c.remove_where(b.all_()).bulk_insert(df).count() == 4
    moved, pairs = c.remove(2).compact()
    assert sorted(map(tuple, pairs.collect())) == [(1, 0), (3, 1), (4, 2)] and moved.count() == 3
    files.write(c, str(tmp_path / "cars"))
    assert files.read(spark, str(tmp_path / "cars"), id="id").get(2)["name"] == "Opel"
    assert c.create_index("age", f.ordered("age")).query_str("age > 10").count() == 2
    c.remove_index("age").remove_index("nix")
    with pytest.raises(InvalidName):
        c.query_str("age > 10")
    for name in ("", "ID", "name"):
        with pytest.raises(Exception, match="field"):
            c.create_index(name, f.ordered("age"))
    c.remove_index("Id")
    with pytest.raises(NoKey):
        c.get(1)
    assert c.filter("age > 10").count() == 2


def test_row_ids(spark):
    df = with_row_ids(spark.range(0, 1000, 1, 7), 5)
    assert df.where("_rid <> id + 5").count() == 0


def test_sets(spark):
    x, y, none = RowSet.of(spark, [1, 3, 42]), RowSet.of(spark, [0, 2, 3]), RowSet.of(spark)
    assert [(x & y).values(), (x | y).values(), (x ^ y).values(), (x - y).values(), (y - x).values()] == [[3], [0, 1, 2, 3, 42], [0, 1, 2, 42], [1, 42], [0, 2]]
    assert [(x & none).values(), (x | none).values(), (x ^ none).values(), (none ^ x).values(), (x - none).values()] == [[], x.values(), x.values(), x.values(), x.values()]
    assert (none.min(), none.max(), len(none), none.is_empty()) == (-1, -1, 0, True)
    k = RowSet.of(spark, [1, 2, 8, 42, 1028])
    assert (k.kth(0), k.kth(2), k.kth(4), k.kth(1000)) == (1, 8, 1028, None)
    assert k.range(2, 8).values() == [2, 8] and k.range(10, 5).values() == []
    assert 8 in k and 9 not in k and k.add(9).discard(1).values() == [2, 8, 9, 42, 1028]
    assert k.without(F.col("_rid") % 2 == 0).values() == [1]
    assert list(k.batches(2)) == [[1, 2], [8, 42], [1028]] and k.bitmaps().count() == 1


def test_ordered_map_and_arena(spark):
    m = OrderedMap(spark.createDataFrame([(k, str(k)) for k in (5, 1, 3, 2)], "k int, v string"), "k", "v")
    keys = lambda df: [r[0] for r in df.collect()]
    assert [keys(m.less(3)), keys(m.less_equal(3)), keys(m.greater(3)), keys(m.greater_equal(3)), keys(m.range(2, 42)), keys(m.range(4, 2))] == [[1, 2], [1, 2, 3], [5], [3, 5], [2, 3, 5], []]
    assert tuple(m.ends().first()) == (1, 5, "1", "5") and keys(m.multi_get(5, 9, 1)) == [1, 5]
    m2, new = m.put(3, "x")
    assert not new and m2.get(3) == "x" and len(m2) == 4 and len(m2.delete(1)) == 3 and m.put(9, "y")[1]
    assert [r[0] for r in m.traverse()] == [1, 2, 3, 5]
    a = Arena.of(spark.createDataFrame([(0, "a"), (1, "b")], "i int, s string"), "i")
    gone = a.remove(1, 0)
    assert len(gone) == 1 and gone.get(1, 0).count() == 0 and len(gone.remove(0, 7)) == 1
    assert gone.fill(1, s="c").get(1, 1).first()["s"] == "c" and gone.fill(1, s="c").get(1, 0).count() == 0


def test_streams_filter_too(spark, tmp_path):
    spark.range(100).withColumn("v", F.col("id") % 10).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, v long").parquet(str(tmp_path / "in"))
    q = filter_stream(stream, "v >= 8 and not v = 9", {"v": f.ordered("v")}).writeStream.format("memory").queryName("filtered").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("filtered").count() == 10


def _naive(e, row):
    match e:
        case TrueE():
            return True
        case FalseE():
            return False
        case And(x, y):
            return _naive(x, row) and _naive(y, row)
        case Or(x, y):
            return _naive(x, row) or _naive(y, row)
        case AndNot(x, y):
            return _naive(x, row) and not _naive(y, row)
        case Not(x):
            return not _naive(x, row)
        case Term(name, "!=", v):
            return not _naive(Term(name, "=", v), row)
    value = row[e.field]
    own = value or [] if isinstance(value, list) or e.field == "m" else [value]
    tests = {"=": lambda x, v: x == v, "<": lambda x, v: x < v, "<=": lambda x, v: x <= v, ">": lambda x, v: x > v, ">=": lambda x, v: x >= v,
             "IN": lambda x, *v: x in v, "BETWEEN": lambda x, lo, hi: lo <= x <= hi}
    return any(x is not None and tests[e.op](x, *(e.values if isinstance(e, TermMany) else (e.value,))) for x in own)


def test_random_expressions_match_a_naive_evaluator(spark):
    r = random.Random(5)
    value = lambda: r.choice([None, *range(6)])
    rows = [{"_rid": i, "a": value(), "s": r.choice([None, "", "x", "é", "z"]), "m": r.choice([None, [], [1], [0, 5], [2, 3, 3]])} for i in range(40)]
    df = spark.createDataFrame([tuple(x.values()) for x in rows], "_rid long, a int, s string, m array<int>").cache()
    c = Collection(df, fields={"a": f.ordered("a"), "s": f.ordered("s"), "m": f.ordered("m", True)})

    def make(depth):
        if depth and r.random() < 0.8:
            kind = r.choice([And, Or, Not, AndNot])
            return kind(make(depth - 1)) if kind is Not else kind(make(depth - 1), make(depth - 1))
        name = r.choice("asm")
        v = lambda: r.choice(["", "x", "z"]) if name == "s" else r.randint(0, 5)
        op = r.choice(["=", "!=", "<", "<=", ">", ">=", "IN", "BETWEEN"])
        return TermMany(name, op, (v(), v())) if op in ("IN", "BETWEEN") else Term(name, op, v())

    exprs = [make(3) for _ in range(60)]
    found = [c.query(e, optimizer=o).condition() for e in exprs for o in (True, False)]
    got = df.select("_rid", *[F.coalesce(x, F.lit(False)).alias(f"c{i}") for i, x in enumerate(found)]).orderBy("_rid").collect()
    for i, e in enumerate(exprs):
        want = [_naive(e, row) for row in rows]
        assert [x[f"c{2 * i}"] for x in got] == want, str(e)
        assert [x[f"c{2 * i + 1}"] for x in got] == want, str(e)


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(10).withColumn("s", F.lit("abc")).write.parquet(str(tmp_path / "t"))
    c = Collection(spark.read.parquet(str(tmp_path / "t")), order_by="id", fields={"n": f.ordered("id"), "s": f.trigram("s")})
    plan = c.query(parse('n >= 3 and s like "ab%"')).to_df()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,3)" in plan and "StringStartsWith(s,ab)" in plan
    assert c.query_str("n > 5 and n < 3").to_df()._jdf.queryExecution().optimizedPlan().toString().startswith("LocalRelation <empty>")


def test_sets_of_repeated_ids(spark):
    ids = lambda *v: RowSet(spark.createDataFrame([(x,) for x in v], "x int"))
    assert (ids(1, 1, 2) ^ ids(2)).values() == [1] and len(ids(1, 1, 2, None)) == 2


def test_decimals(spark):
    import decimal

    df = spark.createDataFrame([(i, decimal.Decimal(x)) for i, x in enumerate(("10.50", "10.49", "-3.00", "9999999999.99"))], "k int, p decimal(12,2)")
    c = Collection(df, "k", "k", {"p": f.ordered("p")})
    found = lambda text: [r.k for r in c.query_str(text).values()]
    assert found("p >= 10.5") == [0, 3] and found("p > 10.495") == [0, 3] and found("p = 10.49") == [1] and found("p < 0") == [2] and found("p in(10.50, -3.0)") == [0, 2]
    for text in ("p = 10000000000", "p < 123456789012.5"):
        with pytest.raises(OutOfRange):
            c.query_str(text).count()


def test_long_expressions(spark):
    df = spark.range(100).withColumn("v", F.col("id") % 10)
    c = Collection(df, "id", "id", {"v": f.ordered("v")})
    terms = " or ".join(f"v = {i}" for i in range(7, 5007))
    assert c.query_str(terms).count() == 30
    both = c.query_str("not (" + " or ".join(f"v = {i}" for i in range(4)) + ") and " + " and ".join(["v < 9"] * 2000))
    assert "IN" in c.query_str(terms).to_df()._jdf.queryExecution().optimizedPlan().toString()
    assert both.count() == 50 and str(both.expr).count("AND") >= 1999 and sum(1 for _ in both.expr.walk()) > 3999
    with pytest.raises(FacetError):
        c.query_str("(" * 5000 + "v = 1" + ")" * 5000).count()


def test_pages_without_a_limit(spark):
    c = Collection(spark.range(1000).repartition(7), "id", "id", {})
    rest = c.query(b.all_()).page(990)
    assert [r.id for r in rest.collect()] == list(range(990, 1000)) and c.query(b.all_()).page(1000).count() == 0
    assert "CollectLimit -1" not in rest._jdf.queryExecution().toString()


def test_pages_far_behind_the_first(spark):
    rng = random.Random(7)
    ids = sorted({rng.choice((1, -1)) * rng.getrandbits(rng.choice((8, 20, 40, 63))) for _ in range(5000)} | {-(2**63), -1, 0, 2**63 - 1})
    c = Collection(spark.createDataFrame([(i, i) for i in rng.sample(ids, len(ids))], "_rid long, v long").repartition(5))
    everything, n = c.query(b.all_()), len(ids)
    for offset, limit in ((995, 5), (996, 5), (3000, 7), (3000, 1200), (n - 3, 7), (n - 3, 2000), (n, 5), (n - 1, 0), (0, 2000), (10**10, 5)):
        page = everything.page(offset, limit)
        assert [r.v for r in page.collect()] == ids[offset : offset + limit if limit else None]
        assert all(int(k) <= 1000 for k in re.findall(r"(?:[Ll]imit|offset)[ =](\d+)", page._jdf.queryExecution().executedPlan().toString()))  # what one task may be sent
    rows = RowSet(c.frame)
    assert [rows.kth(k) for k in (0, 999, 1000, n - 1, n)] == [ids[0], ids[999], ids[1000], ids[-1], None]
    assert not re.search(r"[Ll]imit[ =]\d{4}", rows.kth_df(1500)._jdf.queryExecution().executedPlan().toString())
