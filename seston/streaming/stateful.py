"""Streaming twins of the recursive and counting operators, on Structured Streaming's keyed state.

Rows of a key are taken in the order of ``order`` within a micro-batch, and micro-batches in turn; state (a few numbers a key) is kept by the state store and
survives a restart from the query's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout


def _stateful(df: DataFrame, keys: list[str], order: str, out: T.StructType, state: str, start: tuple, step) -> DataFrame:
    def run(key: tuple, pdfs: Iterator[pd.DataFrame], group) -> Iterator[pd.DataFrame]:
        held = group.get if group.exists else start
        pdf = pd.concat(list(pdfs)).sort_values(order, kind="stable")
        held, made = step(held, pdf)
        group.update(held)
        yield made[out.names]

    return df.groupBy(*keys).applyInPandasWithState(run, out, state, "append", GroupStateTimeout.NoTimeout)


def exponential_smoothing_stream(df: DataFrame, value: str, alpha: float, *, keys: list[str], order: str, name: str = "response") -> DataFrame:
    """As ``exponential_smoothing``; null values give null."""
    from seston.operators.recursive import smoothed_from_zero

    out = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])

    def step(held, pdf):
        y = held[0]
        x = pdf[value].to_numpy(float)
        there = ~np.isnan(x)
        made = np.full(len(x), np.nan)
        if there.any():
            made[there] = smoothed_from_zero(x[there], alpha, x[there][0] if y is None else y)
            y = float(made[there][-1])
        return (y,), pdf.assign(**{name: pd.Series(made, pdf.index).where(there, None)})

    return _stateful(df, keys, order, out, "y double", (None,), step)


def running_median_stream(df: DataFrame, value: str, *, start: float = 0.0, keys: list[str], order: str, name: str = "response") -> DataFrame:
    """The running median from a given ``start``, as a stream can't look ahead to its first values."""
    out = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])

    def step(held, pdf):
        m, made = held[0], []
        for v in pdf[value].to_numpy(float):
            if v > m:
                m += 1.0
            if v < m:
                m -= 1.0
            made.append(m)
        return (m,), pdf.assign(**{name: made})

    return _stateful(df, keys, order, out, "m double", (start,), step)


def enumerate_stream(df: DataFrame, *, keys: list[str], order: str, start: int = 0, name: str = "index") -> DataFrame:
    """The running number of a key's rows as they arrive."""
    out = T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])

    def step(held, pdf):
        n = held[0]
        return (n + len(pdf),), pdf.assign(**{name: np.arange(n, n + len(pdf))})

    return _stateful(df, keys, order, out, "n long", (start,), step)


def pack_stream(df: DataFrame, size: int, value: str, *, keys: list[str], order: str, name: str = "values") -> DataFrame:
    """A row whenever ``size`` values of a key are there: the tumbling count window. What is left at the end waits for more."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    out = T.StructType([*(T.StructField(k, kinds[k]) for k in keys), T.StructField(name, T.ArrayType(T.DoubleType()))])

    def step(held, pdf):
        whole = [*held[0], *map(float, pdf[value])]
        full = len(whole) // size
        rows = [whole[i * size : (i + 1) * size] for i in range(full)]
        first = {k: [pdf[k].iloc[0]] * full for k in keys}
        return (whole[full * size :],), pd.DataFrame({**first, name: rows}, columns=out.names)

    return _stateful(df, keys, order, out, "held array<double>", ([],), step)


def latest_per_second(df: DataFrame, time: str, max_fps: int, watermark: str = "10 seconds") -> DataFrame:
    """At most ``max_fps`` rows for each second of event time (the first of each slot), rows later than the watermark left out."""
    src = df.withWatermark(time, watermark)
    slot = F.floor(F.unix_micros(F.col(time)) * max_fps / 1_000_000)
    return src.withColumn("__slot", slot).dropDuplicatesWithinWatermark(["__slot"]).drop("__slot")
