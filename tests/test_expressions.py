"""Python's operators against Python itself."""

from __future__ import annotations

import operator

import pytest
from pyspark.sql import functions as F

from seston.functions import expressions as X
from seston.functions.text import ParseWarning, compile_parse, format_text, parse_text


def one(spark, df, column):
    return [r[0] for r in df.select(column).collect()]


NUMBERS = [-9, -7, -1, 0, 1, 2, 7, 9]


@pytest.mark.parametrize("name", ["add", "sub", "mul", "floordiv", "mod", "lt", "le", "gt", "ge", "eq", "ne", "and", "or", "xor"])
def test_integers(spark, name):
    f = {"and": operator.and_, "or": operator.or_}.get(name) or getattr(operator, name)
    pairs = [(a, b) for a in NUMBERS for b in NUMBERS if b or name not in ("floordiv", "mod")]
    df = spark.createDataFrame(pairs, "a long, b long")
    assert one(spark, df, X.apply(df, name, F.col("a"), F.col("b"))) == [f(a, b) for a, b in pairs]


@pytest.mark.parametrize("name", ["floordiv", "mod", "truediv"])
def test_floats(spark, name):
    pairs = [(a, b) for a in (-7.5, -2.0, 0.0, 3.25, 9.0) for b in (-2.0, 0.5, 4.0)]
    df = spark.createDataFrame(pairs, "a double, b double")
    assert one(spark, df, X.apply(df, name, F.col("a"), F.col("b"))) == pytest.approx([getattr(operator, name)(a, b) for a, b in pairs])


def test_powers_and_shifts(spark):
    df = spark.createDataFrame([(3, 39), (-2, 63), (-1, 10**9 + 1), (0, 0), (7, 0)], "a long, b long")
    assert one(spark, df, X.apply(df, "pow", F.col("a"), F.col("b"))) == [3**39, (-2) ** 63, -1, 1, 1]
    df = spark.createDataFrame([(1, 33), (-5, 2), (0, 99)], "a long, b long")
    assert one(spark, df, X.apply(df, "lshift", F.col("a"), F.col("b"))) == [1 << 33, -5 << 2, 0]
    assert one(spark, df, X.apply(df, "rshift", F.col("a"), F.col("b"))) == [0, -5 >> 2, 0]
    for op, a, b in (("lshift", 3, 63), ("pow", 10, 30), ("pow", 2, -1), ("rshift", 1, -1)):
        with pytest.raises(Exception):
            one(spark, df, X.apply(df, op, F.lit(a), F.lit(b)))


def test_truth_and_identity(spark):
    df = spark.createDataFrame([(0, 0.0, "", []), (None, None, None, None), (2, float("nan"), "x", [0])], "i int, d double, s string, a array<int>")
    for c in "idsa":
        assert one(spark, df, X.apply(df, "truth", F.col(c))) == [False, False, True]
        assert one(spark, df, X.apply(df, "not", F.col(c))) == [True, True, False]
        assert one(spark, df, X.apply(df, "is", F.col(c), None)) == [False, True, False]
    assert one(spark, df, X.apply(df, "eq", F.col("d"), F.col("d"))) == [True, True, False]
    with pytest.raises(X.ExpressionError):
        X.apply(df, "is", F.col("i"), F.col("i"))


def test_items(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5], "abcde", {"k": 1})], "a array<int>, s string, m map<string,int>")
    a, s, m = (X.typed(df, F.col(c)) for c in "asm")
    lit = lambda v: X.typed(df, v)
    for i in (0, 3, -1, -5):
        assert one(spark, df, X.getitem(a, lit(i)).col) == [[1, 2, 3, 4, 5][i]] and one(spark, df, X.getitem(s, lit(i)).col) == ["abcde"[i]]
    for part in (slice(1, 3), slice(None, -1), slice(-3, None), slice(4, 2), slice(None, None, -1), slice(0, 99, 2), slice(3, None, -2), slice(-99, 2)):
        assert one(spark, df, X.getslice(a, part.start, part.stop, part.step).col) == [[1, 2, 3, 4, 5][part]], part
        assert one(spark, df, X.getslice(s, part.start, part.stop, part.step).col) == ["abcde"[part]], part
    assert one(spark, df, X.setitem(a, lit(-1), lit(9)).col) == [[1, 2, 3, 4, 9]] and one(spark, df, X.delitem(a, lit(1)).col) == [[1, 3, 4, 5]]
    assert one(spark, df, X.setitem(m, lit("k"), lit(7)).col) == [{"k": 7}] and one(spark, df, X.delitem(m, lit("k")).col) == [{}]
    assert one(spark, df, X.contains(m, lit("k")).col) == [True] and one(spark, df, X.in_(lit(6), a).col) == [False]
    assert [one(spark, df, p.col) for p in X.unpack(a, 5)] == [[1], [2], [3], [4], [5]]
    for bad in (X.getitem(a, lit(5)), X.getitem(s, lit(-6)), X.getitem(m, lit("z")), X.delitem(m, lit("z")), *X.unpack(a, 4)):
        with pytest.raises(Exception):
            one(spark, df, bad.col)
    assert one(spark, df, X.mul(s, lit(2)).col) == ["abcdeabcde"] and one(spark, df, X.mul(lit(0), a).col) == [[]]


def test_structs_and_merge(spark):
    df = spark.createDataFrame([((1, "x"),)], "t struct<a:int,b:string>")
    t = X.typed(df, F.col("t"))
    assert one(spark, df, X.attribute(t, "b").col) == ["x"] and one(spark, df, X.getitem(t, 0).col) == [1]
    both = X.merge(t, X.typed(df, F.struct(F.lit(5).alias("a"), F.lit(6).alias("c"))))
    assert one(spark, df, both.col)[0].asDict() == {"a": 5, "b": "x", "c": 6}
    assert one(spark, df, X.merge(X.typed(df, {"a": 1, "b": 2}), X.typed(df, {"a": 3})).col) == [{"a": 3, "b": 2}]


def test_matmul(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]], [5.0, 6.0])], "m array<array<double>>, v array<double>")
    m, v = X.typed(df, F.col("m")), X.typed(df, F.col("v"))
    assert one(spark, df, X.matmul(m, v).col) == [[17.0, 39.0]] and one(spark, df, X.matmul(v, m).col) == [[23.0, 34.0]]
    assert one(spark, df, X.matmul(m, m).col) == [[[7.0, 10.0], [15.0, 22.0]]] and one(spark, df, X.matmul(v, v).col) == [61.0]


def test_format(spark):
    rows = [(1, "a", 1e-05, True), (-42, "bc", 2.675, False), (123456, "", 0.125, None)]
    df = spark.createDataFrame(rows, "i long, s string, d double, b boolean")
    for fmt, names in (("{}-{:05d}", "ii"), ("{:4}|{:>6}|{:<5}|", "iss"), ("{:.2f} {} {}", "ddb"), ("{0}{1}{0}", "si"), ("{{x}} {!r}", "s")):
        want = [fmt.format(*(dict(zip("isdb", r))[n] for n in names)) if "{!r}" not in fmt or r[1] is not None else None for r in rows]
        assert one(spark, df, format_text(df, fmt, *(F.col(n) for n in names))) == want
    made = format_text(df, "{a} {b} {c}", _args=[], _kwargs={"a": 1, "b": F.col("i")}, b=F.col("s"), c="z")
    assert one(spark, df, made) == ["1 a z", "1 bc z", "1  z"]


def test_parse(spark):
    df = spark.createDataFrame([("This is a TEST 12 and 1.5",), ("this IS a Long text -3 and 0.25",), (None,)], "t string")
    got = [r[0] for r in df.select(parse_text(df, "This is a {named} {n:d} and {x:f}", F.col("t"))).collect()]
    assert [g and tuple(g) for g in got] == [("TEST", 12, 1.5), ("Long text", -3, 0.25), None]
    for kwargs in ({"case_sensitive": True}, {}):
        with pytest.raises(Exception):
            df.select(parse_text(df, "This is {n:d}", F.col("t"), **kwargs)).collect()
    with pytest.warns(ParseWarning):
        parse_text(df, "{}", F.col("t"))
    assert compile_parse("{a:greedy}x")[1] == [("a", 1, "string")]
    patterns = spark.createDataFrame([("a{n:d}", "a5"), ("b-{n:d}", "b-7")], "f string, t string")
    assert [r[0].n for r in patterns.select(parse_text(patterns, F.col("f"), F.col("t"), names={"n": "bigint"})).collect()] == [5, 7]
