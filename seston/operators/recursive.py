"""Recursive filters: what a row gives depends on all rows before it in its series.

Exponential smoothing is a chain of affine maps, which compose: blocks of consecutive rows are smoothed from zero at the same time, a scan over
one summary row a block and series gives each block what it starts from, and a last pass adds it. The running median does not compose;
a series goes through one task in order, in batches, with only its state kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seston.operators.order import BLOCK, INDEX, _columns, dense_index
from seston.runtime import join_sized, settle


def scan_series(df: DataFrame, step: Callable[[Any, dict[str, np.ndarray]], tuple[Any, np.ndarray]], inputs: list[str], *, order: str | Column | list, keys: list[str], name: str, kind: str = "double") -> DataFrame:
    """A column made by a state that goes along each series.

    ``step(state, columns)`` gets None or the state that it returned last and the next rows' ``inputs`` as arrays, and returns the state and an
    array of results. Rows come in order, in batches: a series of any length needs only its state and one batch in memory.
    """
    src = df.repartition(*keys) if keys else df.coalesce(1)
    src = src.sortWithinPartitions(*map(F.col, keys), *_columns(order))
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType() if kind == "double" else T.LongType())])
    at = [df.columns.index(c) for c in inputs]
    of_key = [df.columns.index(c) for c in keys]
    arrow = {"double": pa.float64(), "bigint": pa.int64()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in at]
            keyed = [batch.column(i).to_pylist() for i in of_key]
            rows = list(zip(*keyed)) if keyed else [()] * n
            cuts = [0, *(i for i in range(1, n) if rows[i] != rows[i - 1]), n]
            made = []
            for a, b in zip(cuts, cuts[1:]):
                if rows[a] != last:
                    last, state = rows[a], None
                state, out = step(state, {c: v[a:b] for c, v in zip(inputs, columns)})
                made.append(pa.array(np.asarray(out, float) if kind == "double" else out, arrow, from_pandas=True))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.concat_arrays(made)], names=schema.names)

    return src.mapInArrow(run, schema)


def smoothed_from_zero(values: np.ndarray, alpha: float, start: float = 0.0) -> np.ndarray:
    """y_i = alpha x_i + (1 - alpha) y_(i-1), y_(-1) = start, in one pass of compiled code."""
    return pd.Series(np.r_[start, values]).ewm(alpha=alpha, adjust=False).mean().to_numpy()[1:]


def exponential_smoothing(df: DataFrame, value: str, alpha: float, *, order: str | Column | list, keys: list[str] | None = None, name: str = "response", block: int = BLOCK) -> DataFrame:
    """y_0 = x_0, then y = alpha x + (1 - alpha) y. A null value gives null and leaves the state as it is."""
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be above 0 and at most 1")
    keys = keys or []
    indexed = dense_index(df, [*map(F.col, keys), *_columns(order)]).withColumn("__block", F.floor(F.col(INDEX) / block))
    own = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    indexed = indexed.withColumn("__key", F.xxhash64(own)).withColumn("__x", F.col(value).cast("double"))
    names = indexed.columns
    schema = T.StructType([*indexed.schema.fields, T.StructField("__z", T.DoubleType()), T.StructField("__n", T.LongType())])
    at = {c: names.index(c) for c in ("__block", "__x", *keys)}

    def run(batches):
        last, z, n = None, 0.0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = list(zip(*(batch.column(at[c]).to_pylist() for c in ("__block", *keys))))
            x = batch.column(at["__x"]).to_numpy(zero_copy_only=False).astype(float)
            null = np.asarray(batch.column(at["__x"]).is_null())
            cuts = [0, *(i for i in range(1, len(rows)) if rows[i] != rows[i - 1]), len(rows)]
            zs, ns = np.empty(len(rows)), np.empty(len(rows), np.int64)
            for a, b in zip(cuts, cuts[1:]):
                if rows[a] != last:
                    last, z, n = rows[a], 0.0, 0
                there = ~null[a:b]
                made = np.full(b - a, np.nan)
                made[there] = smoothed_from_zero(x[a:b][there], alpha, z)
                zs[a:b], ns[a:b] = made, n + np.cumsum(there)
                if there.any():
                    z, n = float(made[there][-1]), int(ns[b - 1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(zs, mask=null), pa.array(ns)], names=schema.names)

    local = settle(indexed.repartition("__block").sortWithinPartitions("__block", INDEX).mapInArrow(run, schema), "smoothed")
    same = ["__block", *keys]
    there = F.col("__x").isNotNull()
    ends = local.groupBy(*same).agg(F.max("__n").alias("n"), F.max_by("__z", F.when(there, F.col(INDEX))).alias("z"), F.min_by("__x", F.when(there, F.col(INDEX))).alias("first")).filter("n > 0")

    def carry(state, c):
        out = np.empty(len(c["n"]))
        for i, (n, z, first) in enumerate(zip(c["n"], c["z"], c["first"])):
            start = float(first) if state is None else state
            out[i] = start
            state = float(z) + (1 - alpha) ** int(n) * start
        return state, out

    starts = scan_series(ends, carry, ["n", "z", "first"], order="__block", keys=keys, name="__start").select(*same, "__start")
    starts = settle(starts, "starts")
    on = [local["__block"] == starts["__block"], *(local[k].eqNullSafe(starts[k]) for k in keys)]
    joined = join_sized(local, starts, on, "left")
    y = local["__z"] + F.pow(F.lit(1 - alpha), local["__n"]) * starts["__start"]
    return joined.select(*(local[c] for c in df.columns), F.when(local["__x"].isNotNull(), y).alias(name))


def running_median(df: DataFrame, value: str, n_init: int = 10, *, order: str | Column | list, keys: list[str] | None = None, name: str = "response") -> DataFrame:
    """The median of the first ``n_init`` values for these rows; from then on it goes up by 1 if the value is above it, then down by 1 if
    the value is below what it is then. Null values leave it as it is."""
    keys = keys or []
    if n_init < 1:
        raise ValueError("n_init must be positive")

    def step(state, c):
        x = c["__x"].astype(float)
        first, seen = state if state is not None else ([], 0)
        out = np.empty(len(x))
        m = first if isinstance(first, float) else float(c["__m0"][0]) if len(x) else 0.0
        for i, v in enumerate(x):
            seen += 1
            if seen > n_init:
                if v > m:
                    m += 1.0
                if v < m:
                    m -= 1.0
            out[i] = m
        return (m, seen), out

    by = _columns(order)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*by)) if keys else None
    head = df.withColumn("__rn", rank).filter(F.col("__rn") <= n_init) if keys else df.orderBy(*by).limit(n_init)
    starts = settle(head.groupBy(*keys).agg(F.percentile(F.col(value).cast("double"), F.lit(0.5)).alias("__m0")), "medians")
    left = df.withColumn("__x", F.col(value).cast("double"))
    if keys:
        on = [left[k].eqNullSafe(starts[k]) for k in keys]
        left = join_sized(left, starts, on, "left").select(*(left[c] for c in left.columns), starts["__m0"])
    else:
        left = left.crossJoin(F.broadcast(starts))  # one row
    out = scan_series(left, step, ["__x", "__m0"], order=order, keys=keys, name="__made")
    return out.select(*df.columns, F.col("__made").alias(name))
