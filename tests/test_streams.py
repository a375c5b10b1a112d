"""Ordered operators against plain Python on short streams, over several partitions and blocks."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seston.diagnostics import Profile, StreamEstimator, progress
from seston.operators import joins, order, recursive, stream, windows


def table(spark, values, kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, v {kind}").repartition(3)


def column(df, name="response", by="i"):
    return [r[name] for r in df.orderBy(by).collect()]


def test_index_slice_remaining(spark):
    df = table(spark, range(31), "long")
    assert column(order.enumerate_rows(df, "i", 5), "index") == list(range(5, 36))
    assert column(order.remaining_hint(df, "i"), "remaining") == list(range(31, 0, -1))
    for args in ((7,), (3, 9), (2, None, 5), (0, 20, 3), (40, None), (5, 2)):
        assert column(order.slice_rows(df, "i", *args), "v") == list(itertools.islice(range(31), *args)), args
    with pytest.raises(ValueError):
        order.slice_rows(df, "i", -1)
    assert order.enumerate_rows(df.limit(0), "i").count() == 0


def test_runs_and_batches(spark):
    values = list("AABBBACCCCCCA") + [None, None, "A"]
    df = table(spark, values, "string")
    got = order.runs(df, ["v"], "i", "run", "place").orderBy("i").collect()
    want = [(k, p) for k, (_, g) in enumerate(itertools.groupby(values)) for p, _ in enumerate(g)]
    assert [(r.run, r.place) for r in got] == want
    batches = stream.batch_rows(df.withColumn("w", F.col("i") * 2), 2, "i", ["v"]).collect()
    assert sorted(tuple(b.i) for b in batches) == [(0, 1), (2, 3), (4,), (5,), (6, 7), (8, 9), (10, 11), (12,), (13, 14), (15,)]
    assert all(b.w == [2 * x for x in b.i] for b in batches)


@pytest.mark.parametrize("n", [0, 5, 10, 111])
def test_batched_roundtrip(spark, n):
    df = table(spark, range(n), "long")
    out = stream.batched(df, 10, "i", lambda b: b.withColumn("c", F.transform("v", lambda x: x + 1)))
    assert column(out, "c") == [x + 1 for x in range(n)] and column(out, "v") == list(range(n))


def test_pack_unpack_filter(spark):
    df = table(spark, range(10), "long")
    packed = stream.pack_rows(df, 4, ["v"], "i").orderBy("i").collect()
    assert [(r.i, r.v) for r in packed] == [(0, [0, 1, 2, 3]), (4, [4, 5, 6, 7]), (8, [8, 9])]
    texts = spark.createDataFrame([(0, "AB"), (1, ""), (2, None)], "i int, s string")
    assert [(r.i, r.value) for r in stream.unpack_rows(texts, "s").collect()] == [(0, "A"), (0, "B")]
    assert stream.unpack_rows(df, []).count() == 0 and stream.unpack_rows(df, range(3)).count() == 30
    assert stream.filter_rows(df, lambda d: F.col("v") % 2).count() == 5
    with pytest.raises(KeyError):
        stream.drop_columns(df, "nothing")


def test_keep_first_and_map(spark):
    df = spark.createDataFrame([("a", 2, 1, "x"), ("a", 1, 1, "y"), ("a", 3, 2, "z"), ("b", 4, None, "q"), (None, 5, 1, "r")], "k string, o int, rank int, v string")
    assert sorted((r.k or "", r.v) for r in stream.keep_first(df, ["k"], "o").collect()) == [("", "r"), ("a", "y"), ("b", "q")]
    assert [(r.k, r.o, r.vs) for r in stream.first_with_map(df, "k", "rank", "v", "o").collect()] == [("a", 1, {1: "y", 2: "z"})]


def test_lookup(spark):
    left = spark.createDataFrame([(1, "old"), (2, "old")], "k int, v string")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    assert sorted(map(tuple, joins.lookup_join(left, right, "k").collect())) == [(1, "a"), (2, "b")]
    for l, r in ((left.unionByName(spark.createDataFrame([(9, "x")], "k int, v string")), right), (left, right.unionByName(right)), (left.withColumn("k", F.lit(None).cast("int")), right)):
        with pytest.raises(Exception):
            joins.lookup_join(l, r, "k").collect()
    assert joins.lookup_join(left.withColumn("k", F.lit(7)), right, "k", missing="null").collect()[0].v is None


def frames(values, size, centered):
    h = size // 2
    for i in range(len(values)):
        yield [v for v in (values[max(0, i - h) : i + h + 1] if centered else values[max(0, i - size + 1) : i + 1]) if v is not None]


NAMES = {windows.max_filter: np.max, windows.min_filter: np.min, windows.median_filter: np.median, windows.mean_filter: np.mean}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.one_of(st.none(), st.floats(-100, 100), st.just(float("nan"))), max_size=23), size=st.sampled_from([1, 3, 5]), centered=st.booleans())
def test_filters(spark, values, size, centered):
    df = table(spark, values)
    for f, g in NAMES.items():
        got = column(f(df, "v", size, centered, order="i", block=7))
        want = [float(g(w)) if w else None for w in frames(values, size, centered)]
        assert [x if x is None else pytest.approx(x, nan_ok=True, abs=1e-9) for x in want] == got


def test_filters_of_arrays_and_symmetry(spark):
    values = [[float(i), float(-i)] for i in range(20)]
    df = table(spark, values, "array<double>")
    for f, g in NAMES.items():
        want = [g(np.array(w), axis=0).tolist() for w in frames(values, 5, True)]
        assert [pytest.approx(w) for w in want] == column(f(df, "v", 5, order="i", block=6))
        back = table(spark, values[::-1], "array<double>")
        assert column(f(back, "v", 5, order="i"))[::-1] == [pytest.approx(x) for x in column(f(df, "v", 5, order="i"))]
    assert column(windows.binomial_filter(df, "v", 3, order="i"))[1] == pytest.approx([1.0, -1.0])
    for size, centered in ((0, True), (4, True)):
        with pytest.raises(ValueError):
            windows.max_filter(df, "v", size, centered, order="i")
    with pytest.raises(ValueError):
        windows.binomial_filter(df, "v", 3, False, order="i")


def test_smoothing_over_blocks_and_keys(spark):
    rng = np.random.default_rng(0)
    x, k = rng.normal(size=60), rng.integers(0, 3, 60)
    rows = [(i, int(k[i]), None if i % 11 == 3 else float(x[i])) for i in range(60)]
    df = spark.createDataFrame(rows, "i long, k int, v double").repartition(3)
    want, state = {}, {}
    for i, key, v in rows:
        if v is not None:
            state[key] = v if key not in state else 0.3 * v + 0.7 * state[key]
        want[i] = None if v is None else state[key]
    got = column(recursive.exponential_smoothing(df, "v", 0.3, order="i", keys=["k"], block=7))
    assert [x if x is None else pytest.approx(x) for x in want.values()] == got
    single = column(recursive.exponential_smoothing(df, "v", 1.0, order="i"))
    assert single == [v for _, _, v in rows]


def test_running_median(spark):
    values = [5.0, 1.0, 3.0, 9.0, 3.4, 0.0, None, 3.0]
    m, want = 3.0, [3.0] * 3
    for v in values[3:]:
        m += v is not None and v > m
        m -= v is not None and v < m
        want.append(float(m))
    assert column(recursive.running_median(table(spark, values), "v", 3, order="i")) == want
    two = spark.createDataFrame([(0, "a", 1.0), (1, "b", 10.0), (2, "a", 5.0), (3, None, 2.0)], "i int, k string, v double")
    assert column(recursive.running_median(two, "v", 10, order="i", keys=["k"])) == [3.0, 10.0, 3.0, 2.0]


def test_stream_twins(spark, tmp_path):
    from seston.streaming.stateful import enumerate_stream, pack_stream, running_median_stream

    spark.createDataFrame([(i, i % 2, float(i)) for i in range(10)], "i long, k int, v double").coalesce(1).write.parquet(f"{tmp_path}/in")
    live = spark.readStream.schema("i long, k int, v double").parquet(f"{tmp_path}/in")
    for n, (out, check) in enumerate(
        [
            (pack_stream(live, 2, "v", keys=["k"], order="i"), lambda r: sorted(tuple(x["values"]) for x in r) == [(0, 2), (1, 3), (4, 6), (5, 7)]),
            (enumerate_stream(live, keys=["k"], order="i"), lambda r: sorted((x.i, x["index"]) for x in r) == [(i, i // 2) for i in range(10)]),
            (running_median_stream(live, "v", start=3.0, keys=["k"], order="i"), lambda r: [x.response for x in sorted(r, key=lambda x: x.i) if x.k == 0] == [2.0, 2.0, 3.0, 4.0, 5.0]),
        ]
    ):
        q = out.writeStream.format("memory").queryName(f"out{n}").option("checkpointLocation", f"{tmp_path}/c{n}").trigger(availableNow=True).start()
        q.awaitTermination()
        assert check(spark.table(f"out{n}").collect())


def test_estimator_and_profile(spark):
    est, got = StreamEstimator(), []
    for i in range(10):
        with est.consume(10 - i) as item:
            got += [item.emit() for _ in range(5)]
    assert got == [None] * 5 + [50 - i for i in range(5, 50)]
    est, got = StreamEstimator(), []
    for i in range(10):
        with est.consume(10 - i, est_n_emit=5) as item:
            got += [item.emit() for _ in range(5)]
    assert got == [50 - i for i in range(50)]
    with StreamEstimator().consume(None) as item:
        assert item.emit() is None
    p = Profile("work")
    p.run(spark.range(100), lambda d: d.filter("id >= 50"))
    assert p.rows == 50 and p.average > 0 and "50 rows" in str(p)
    df, seen = progress(spark.range(7), "p7")
    assert len(df.collect()) == 7 and seen.get["rows"] == 7
