"""Joins with the checks that a lookup needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seston.runtime import BROADCAST_LIMIT, settle, table_bytes


def lookup_join(left: DataFrame, right: DataFrame, on: str, fields: list[str] | None = None, *, missing: str = "error") -> DataFrame:
    """Each row with the fields of the one row of ``right`` that has its key; of columns in both the right ones hold.

    A key that stands on several rows of ``right`` is an error. A key without a row (a null one too) is an error as well, or gives nulls with
    ``missing="null"``. The lookup side is broadcast if its measured size allows it; else both are shuffled, and adaptive
    execution splits frequent keys.
    """
    fields = [c for c in right.columns if c != on] if fields is None else [c for c in fields if c != on]
    one = right.select(F.col(on).alias("__on"), F.struct(F.lit(True).alias("__there"), *fields).alias("__f")).filter("__on IS NOT NULL")
    one = settle(one.groupBy("__on").agg(F.count("*").alias("__n"), F.first("__f").alias("__f")), "lookup")
    single = F.when(F.col("__n") == 1, F.col("__f")).otherwise(F.raise_error(F.concat(F.lit(f"{on} is not unique: "), F.col("__on").cast("string"))).cast(one.schema["__f"].dataType))
    side = one.select("__on", single.alias("__f"))
    if table_bytes(one) * 4 <= BROADCAST_LIMIT:
        side = F.broadcast(side)
    out = left.join(side, F.col(on) == F.col("__on"), "left")
    found = F.col("__f")
    if missing == "error":
        fail = F.raise_error(F.concat(F.lit(f"no row for {on}: "), F.coalesce(F.col(on).cast("string"), F.lit("null"))))
        found = F.when(F.col("__f").isNotNull(), F.col("__f")).otherwise(fail.cast(one.schema["__f"].dataType))
    keep = [c for c in left.columns if c not in fields]
    return out.select(*(F.col(c) for c in keep), *(found.getField(c).alias(c) for c in fields))


def cross_literal(df: DataFrame, values: list, name: str = "value") -> DataFrame:
    """Each row with each value of a short literal list: an explode, no join."""
    return df.withColumn(name, F.explode(F.array(*map(F.lit, values))))


def run_join(left: DataFrame, right: DataFrame, on: str | Column) -> DataFrame:
    """Rows with the one shared object they point to (a file's content, say): a join by key, so each object is read once however the rows are ordered.

    Sides are broadcast by size; for large objects repartition both by the key before.
    """
    return left.join(right, on)
