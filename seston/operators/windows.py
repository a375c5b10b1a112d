"""Sliding filters over ordered rows.

A centered filter of ``size`` sees ``size // 2`` rows on either side of each row, one that is not sees the ``size - 1`` rows before it; both are
cut at the ends. With ``keys`` every key is a series of its own. Work goes in blocks of consecutive rows with a halo, so a long series
(or a single one) is spread over many tasks. Nulls aren't counted, NaN spreads. Arrays are filtered element by element.
"""

from __future__ import annotations

from collections.abc import Callable
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seston.operators.order import BLOCK, INDEX, _columns, dense_index, haloed


def _check(size: int, centered: bool) -> tuple[int, int]:
    if size < 1:
        raise ValueError("size must be positive")
    if centered and size % 2 == 0:
        raise ValueError("size of a centered filter must be odd")
    return (size // 2, size // 2) if centered else (size - 1, 0)


def sliding(df: DataFrame, make: Callable[[Column, Window], Column], value: str, size: int, centered: bool, order: str | Column | list, keys: list[str] | None, name: str, block: int) -> DataFrame:
    before, after = _check(size, centered)
    keys = keys or []
    near = haloed(dense_index(df, [*map(F.col, keys), *_columns(order)]), before, after, block=block)
    window = Window.partitionBy("__block", *keys).orderBy(INDEX)
    out = near.withColumn(name, make(F.col(value), window))
    return out.filter(F.col("__block") == F.col("__home")).drop("__block", "__home", INDEX)


def window_filter(df: DataFrame, agg: Callable[[Column], Column], value: str, size: int = 5, centered: bool = True, *, order: str | Column | list, keys: list[str] | None = None, name: str = "response", block: int = BLOCK) -> DataFrame:
    """A filter by any aggregate function over the frame, built-in or a pandas one."""
    before, after = _check(size, centered)
    return sliding(df, lambda c, w: agg(c).over(w.rowsBetween(-before, after)), value, size, centered, order, keys, name, block)


def _is_array(df: DataFrame, value: str) -> bool:
    return df.schema[value].dataType.typeName() == "array"


def _elementwise(reduce: Callable[[Column], Column], frame_size: tuple[int, int]) -> Callable[[Column, Window], Column]:
    """Arrays of a frame (a bounded number) are gathered, and the values at each place reduced."""

    def make(c: Column, w: Window) -> Column:
        rows = F.collect_list(c).over(w.rowsBetween(-frame_size[0], frame_size[1]))
        places = F.sequence(F.lit(0), F.size(c) - 1)
        return F.when(F.size(c) > 0, F.transform(places, lambda i: reduce(F.transform(rows, lambda r: F.get(r, i).cast("double"))))).otherwise(F.array().cast("array<double>"))

    return make


def _has_nan(values: Column) -> Column:
    return F.exists(values, lambda v: F.isnan(v))


def _middle(values: Column) -> Column:
    s = F.array_sort(values)
    n = F.size(s)
    return F.when(_has_nan(values), F.lit(float("nan"))).otherwise((F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / F.size(values)


def _filter(scalar: Callable[[Column], Column], reduce: Callable[[Column], Column], df: DataFrame, value: str, size: int, centered: bool, order, keys, name: str, block: int) -> DataFrame:
    frame = _check(size, centered)
    if _is_array(df, value):
        return sliding(df, _elementwise(reduce, frame), value, size, centered, order, keys, name, block)
    return sliding(df, lambda c, w: scalar(c.cast("double"), w.rowsBetween(-frame[0], frame[1])), value, size, centered, order, keys, name, block)


def _nan_spreads(f: Callable[[Column], Column]) -> Callable[[Column, Window], Column]:
    return lambda c, w: F.when(F.max(F.isnan(c)).over(w), F.lit(float("nan"))).otherwise(f(c).over(w))


def max_filter(df: DataFrame, value: str, size: int = 5, centered: bool = True, *, order, keys: list[str] | None = None, name: str = "response", block: int = BLOCK) -> DataFrame:
    return _filter(_nan_spreads(F.max), lambda v: F.array_max(v), df, value, size, centered, order, keys, name, block)


def min_filter(df: DataFrame, value: str, size: int = 5, centered: bool = True, *, order, keys: list[str] | None = None, name: str = "response", block: int = BLOCK) -> DataFrame:
    return _filter(_nan_spreads(F.min), lambda v: F.when(_has_nan(v), F.lit(float("nan"))).otherwise(F.array_min(v)), df, value, size, centered, order, keys, name, block)


def median_filter(df: DataFrame, value: str, size: int = 5, centered: bool = True, *, order, keys: list[str] | None = None, name: str = "response", block: int = BLOCK) -> DataFrame:
    return _filter(_nan_spreads(lambda c: F.percentile(c, F.lit(0.5))), _middle, df, value, size, centered, order, keys, name, block)


def mean_filter(df: DataFrame, value: str, size: int = 5, centered: bool = True, *, order, keys: list[str] | None = None, name: str = "response", block: int = BLOCK) -> DataFrame:
    return _filter(_nan_spreads(F.avg), _mean, df, value, size, centered, order, keys, name, block)


def binomial_filter(df: DataFrame, value: str, size: int = 5, centered: bool = True, *, order, keys: list[str] | None = None, name: str = "response", block: int = BLOCK) -> DataFrame:
    """Weights are the binomial coefficients, shared out anew among the rows that are there. Only centered."""
    if not centered:
        raise ValueError("a binomial filter is always centered")
    half, _ = _check(size, True)

    def make(c: Column, w: Window) -> Column:
        rows = [(comb(size - 1, k), F.lag(c, half - k).over(w) if k <= half else F.lead(c, k - half).over(w)) for k in range(size)]
        weight = sum((F.when(r.isNotNull(), F.lit(float(b))).otherwise(0.0) for b, r in rows), F.lit(0.0))
        if _is_array(df, value):
            terms = F.array(*(F.struct(F.lit(float(b)).alias("b"), r.alias("r")) for b, r in rows))
            there = F.filter(terms, lambda t: t["r"].isNotNull())
            return F.transform(F.sequence(F.lit(0), F.size(c) - 1), lambda i: F.aggregate(there, F.lit(0.0), lambda s, t: s + t["b"] * F.get(t["r"], i)) / weight)
        return sum((F.coalesce(r.cast("double"), F.lit(0.0)) * float(b) for b, r in rows), F.lit(0.0)) / weight

    return sliding(df, make, value, size, True, order, keys, name, block)
