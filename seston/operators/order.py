"""A dense index over a total order, and what follows from it: numbering, cutting, counting down, runs.

Rows of a DataFrame have no order of their own; every operator here takes the columns that give it. They should be unique together,
else rows that tie come in an order of Spark's choice. No step gathers all rows in one task: rows are range-partitioned and sorted, the
counts of the partitions (one row each) give every partition its offset, and what a row needs from across a border comes as a
halo of copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seston.runtime import settle

INDEX, PART = "__idx", "__part"
#: Rows of a block of windowed work.
BLOCK = 65536


def _columns(order: str | Column | list) -> list[Column]:
    order = order if isinstance(order, list) else [order]
    return [F.col(c) if isinstance(c, str) else c for c in order]


def dense_index(df: DataFrame, order: str | Column | list, *, index: str = INDEX, keep_part: bool = False, partitions: int | None = None) -> DataFrame:
    """``df`` with the rows' place in the order (0, 1, ...) as ``index``.

    One range shuffle and a table in the shared folder; then only the counts per partition are moved.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = _columns(order)
    placed = df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    placed = placed.withColumn(PART, F.shiftright("__at", 33)).withColumn("__at", F.col("__at").bitwiseAND(F.lit(2**33 - 1)))
    rows = settle(placed, "ordered")
    counts = rows.groupBy(PART).agg(F.count("*").alias("__n"))
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = counts.select(PART, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    out = rows.join(F.broadcast(offsets), PART).withColumn(index, F.col("__offset") + F.col("__at"))
    return out.drop("__offset", "__at") if keep_part else out.drop("__offset", "__at", PART)


def enumerate_rows(df: DataFrame, order: str | Column | list, start: int = 0, name: str = "index") -> DataFrame:
    """The running number of each row, from ``start``."""
    return dense_index(df, order, index=INDEX).withColumn(name, F.col(INDEX) + start).drop(INDEX)


def slice_rows(df: DataFrame, order: str | Column | list, *args: int | None) -> DataFrame:
    """``(stop)`` or ``(start, stop[, step])`` as in ``itertools.islice``; None is open. Without a step the rows up to ``stop`` are found as a top-k."""
    start, stop, step = (None, args[0], None) if len(args) == 1 else (*args, None, None)[:3]
    if any(x is not None and x < 0 for x in (start, stop)) or step is not None and step < 1:
        raise ValueError("start and stop must not be negative, step must be positive")
    start, step = start or 0, step or 1
    by = _columns(order)
    if step == 1 and stop is not None and stop <= BLOCK:
        return df.orderBy(*by).offset(start).limit(max(stop - start, 0)) if start else df.orderBy(*by).limit(stop)
    indexed = dense_index(df, order)
    keep = F.col(INDEX) >= start
    if stop is not None:
        keep = keep & (F.col(INDEX) < stop)
    return indexed.filter(keep & ((F.col(INDEX) - start) % step == 0)).drop(INDEX)


def remaining_hint(df: DataFrame, order: str | Column | list, name: str = "remaining") -> DataFrame:
    """The number of rows from each one to the end, itself included."""
    indexed = dense_index(df, order)
    return indexed.crossJoin(F.broadcast(indexed.agg(F.count("*").alias("__n")))).withColumn(name, F.col("__n") - F.col(INDEX)).drop("__n", INDEX)  # one row


def haloed(indexed: DataFrame, before: int, after: int, *, block: int = BLOCK) -> DataFrame:
    """Rows with ``__home``, their block, and ``__block``, the block they are needed in: those near a border come in both."""
    block = max(block, before, after)
    home, at = F.col("__home"), F.col(INDEX) % block
    blocks = F.array_compact(F.array(home, F.when((at < after) & (home > 0), home - 1), F.when(at >= block - before, home + 1)))
    return indexed.withColumn("__home", F.floor(F.col(INDEX) / block)).withColumn("__block", F.explode(blocks))


def runs(df: DataFrame, by: list[str], order: str | Column | list, name: str = "run", place: str | None = None) -> DataFrame:
    """The number (from 0) of the run of equal ``by`` each row lies in, and with ``place`` its place within the run.

    A run ends where one of the columns changes; null equals null. A run may be of any length: within a partition the changes are counted by
    a window, across partitions only their first and last rows and counts are looked at.
    """
    indexed = dense_index(df, order, keep_part=True)
    key = F.struct(*by)
    inside = Window.partitionBy(PART).orderBy(INDEX)
    lagged = indexed.withColumn("__key", key).withColumn("__prev", F.lag("__key").over(inside)).withColumn("__first", F.row_number().over(inside) == 1)
    lagged = settle(lagged, "runs")
    ends = lagged.groupBy(PART).agg(F.max_by("__key", INDEX).alias("__last"))
    borders = ends.select(PART, F.lag("__last").over(Window.orderBy(PART)).alias("__border"))  # a row per partition
    seen = lagged.join(F.broadcast(borders), PART)
    change = F.when(F.col("__first"), ~F.col("__key").eqNullSafe(F.col("__border"))).otherwise(~F.col("__key").eqNullSafe(F.col("__prev")))
    seen = seen.withColumn("__change", change | (F.col(INDEX) == 0))
    counts = seen.groupBy(PART).agg(F.sum(F.col("__change").cast("long")).alias("__n"), F.max(F.when(F.col("__change"), F.col(INDEX))).alias("__start"))
    earlier = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = counts.select(PART, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__runs"), F.max("__start").over(earlier).alias("__open"))
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = seen.join(F.broadcast(carried), PART)
    out = out.withColumn(name, F.col("__runs") + F.sum(F.col("__change").cast("long")).over(upto) - 1)
    if place:
        out = out.withColumn(place, F.col(INDEX) - F.coalesce(F.max(F.when(F.col("__change"), F.col(INDEX))).over(upto), F.col("__open")))
    return out.drop("__key", "__prev", "__first", "__border", "__change", "__runs", "__open", PART, INDEX)
