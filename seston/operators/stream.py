"""Row operators: filter, select, multiply, pack and batch rows of an ordered table."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seston.functions.expressions import truth, typed
from seston.operators.order import INDEX, _columns, dense_index, runs


def filter_rows(df: DataFrame, predicate: Column | str | Callable[[DataFrame], Column]) -> DataFrame:
    """Rows whose predicate is true as Python counts it: null, zero, false and what is empty drop the row, NaN keeps it."""
    if callable(predicate) and not isinstance(predicate, Column):
        predicate = predicate(df)
    predicate = F.col(predicate) if isinstance(predicate, str) else predicate
    return df.filter(truth(typed(df, predicate)).col)


def keep_columns(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*names)


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    """Without these columns, which must exist."""
    if missing := set(names) - set(df.columns):
        raise KeyError(f"no such column: {sorted(missing)}")
    return df.drop(*names)


def unpack_rows(df: DataFrame, collection: Column | str | Iterable[Any], name: str = "value", place: str | None = None) -> DataFrame:
    """A row for each element of the row's collection, or of a literal one: a nested loop, outer rows first.

    A text gives its characters, a map its keys. A row with an empty or null collection disappears. ``place`` gets the element's place,
    by which the order of the inner loop is kept.
    """
    if isinstance(collection, (str, Column)):
        column = F.col(collection) if isinstance(collection, str) else collection
    else:
        items = list(collection)
        if not items:
            return df.withColumn(name, F.lit(None)).limit(0)
        column = typed(df, items).col
    kind = df.select(column.alias("c")).schema["c"].dataType.typeName()
    if kind == "string":
        column = F.filter(F.split(column, ""), lambda c: c != "")
    elif kind == "map":
        column = F.map_keys(column)
    rest = [F.col(f"`{c}`") for c in df.columns if c not in (name, place)]
    if place is None:
        return df.select(*rest, F.explode(column).alias(name))
    return df.select(*rest, F.posexplode(column).alias(place, name))


def pack_rows(df: DataFrame, size: int, names: list[str], order: str | Column | list) -> DataFrame:
    """``size`` consecutive rows in one: ``names`` become arrays, the other columns are those of the first row. The last may be shorter."""
    if size < 1:
        raise ValueError("size must be positive")
    indexed = dense_index(df, order)
    return _collect(indexed, [F.floor(F.col(INDEX) / size).alias("__group")], names, [c for c in df.columns if c not in names], df.columns)


def _collect(indexed: DataFrame, keys: list[Column], names: list[str], rest: list[str], columns: list[str]) -> DataFrame:
    packed = F.array_sort(F.collect_list(F.struct(INDEX, *names)))
    grouped = indexed.groupBy(*keys).agg(packed.alias("__rows"), F.min_by(F.struct(*rest) if rest else F.lit(0), INDEX).alias("__rest"))
    parts = {n: F.col("__rows").getField(n).alias(n) for n in names} | {c: F.col("__rest").getField(c).alias(c) for c in rest}
    return grouped.select(*(parts[c] for c in columns))


def batch_rows(df: DataFrame, size: int, order: str | Column | list, by: list[str] | None = None) -> DataFrame:
    """Rows gathered into batches of at most ``size`` consecutive rows: every column becomes an array, but for those of ``by``.

    With ``by``, a batch doesn't reach over a change of these columns, and they stay single values.
    """
    by = by or []
    names = [c for c in df.columns if c not in by]
    if not by:
        return pack_rows(df, size, names, order)
    placed = runs(df.withColumn("__order", F.struct(*_columns(order))), by, order, "__run", "__place")
    placed = placed.withColumnRenamed("__order", INDEX)
    return _collect(placed, [F.col("__run"), F.floor(F.col("__place") / size).alias("__group")], names, by, df.columns)


def unbatch_rows(df: DataFrame, names: list[str], place: str | None = None) -> DataFrame:
    """The reverse of ``batch_rows``: a row for each place of the arrays ``names``; other columns are repeated."""
    zipped = F.posexplode(F.arrays_zip(*names)).alias("__at", "__row")
    out = df.select(*(c for c in df.columns if c not in names), zipped)
    columns = [F.col("__row").getField(c).alias(c) if c in names else F.col(c) for c in df.columns]
    return out.select(*columns, *([F.col("__at").alias(place)] if place else []))


def batched(df: DataFrame, size: int, order: str | Column | list, work: Callable[[DataFrame], DataFrame], by: list[str] | None = None) -> DataFrame:
    """``work`` on batches, and its result as single rows again: arrays it adds with a batch's length are taken apart too."""
    before = batch_rows(df, size, order, by)
    arrays = [c for c in df.columns if c not in (by or [])]
    after = work(before)
    added = [f.name for f in after.schema.fields if f.name not in df.columns and f.dataType.typeName() == "array"]
    return unbatch_rows(after, [c for c in arrays if c in after.columns] + added)


def keep_first(df: DataFrame, keys: list[str], order: str | Column | list) -> DataFrame:
    """Of rows with the same ``keys`` the first in the order; combined before the shuffle, so a frequent key does no harm."""
    return df.groupBy(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys))).agg(F.min_by(F.struct(*df.columns), F.struct(*_columns(order))).alias("__row")).select("__row.*")


def first_with_map(df: DataFrame, key: str, entry_key: str, entry_value: str, order: str | Column | list) -> DataFrame:
    """Per key: the other columns of its first row, and a map of ``entry_key`` to ``entry_value`` over its rows (first one wins). Null keys are left out."""
    rest = [c for c in df.columns if c not in (key, entry_key, entry_value)]
    by = F.struct(*_columns(order))
    src = df.filter(F.col(key).isNotNull() & F.col(entry_key).isNotNull())
    single = src.groupBy(key, entry_key).agg(F.min_by(F.col(entry_value), by).alias("__v"), F.min_by(F.struct(F.lit(0).alias("__one"), *rest), by).alias("__first"), F.min(by).alias("__by"))
    grouped = single.groupBy(key).agg(F.min_by("__first", "__by").alias("__first"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(entry_key, "__v")))).alias(f"{entry_value}s"))
    return grouped.select(key, *(F.col("__first").getField(c).alias(c) for c in rest), f"{entry_value}s")
