"""Samples that cover the variety of a set, however large its groups of like records are.

The density around a record is estimated by repeated locality-sensitive hashing: grids shifted at random cut the space into buckets, and the mean
number of records in a record's buckets is its density. A fixed number of records is then drawn without replacement, with chances inverse to
density, so a group of a thousand like records weighs no more than a single one. Records are counted on a fine grid first, so a
record that stands a million times is one row with a count. Where groups are asked for, the draw is what they are linked by, and is made
larger until it is proved that the other records change nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seston.runtime import join_sized, norm_key, settle

#: Hash tables, width of their buckets, width of a cell of the fine grid, seed of the shifts and draws.
TABLES, WIDTH, FINE, SEED = 16, 0.5, 0.02, 11
#: Draws for each group, to begin with.
DRAWN = 8


def with_density(cells: DataFrame, xs: list[str], keys: list[str], *, tables: int = TABLES, width: float = WIDTH, seed: int = SEED) -> DataFrame:
    """``cells`` (keys, coordinates, ``n``) with ``density``: the mean of the counts of their buckets, over the tables, within each of ``keys``."""
    shift = np.random.default_rng(seed).random((tables, len(xs))) * width
    bucket = [F.struct(F.lit(t).alias("t"), *(F.floor((F.col(x) + float(u)) / width).alias(f"b{i}") for i, (x, u) in enumerate(zip(xs, row)))) for t, row in enumerate(shift)]
    spread = cells.select("*", F.explode(F.array(*bucket)).alias("__b"))
    inside = Window.partitionBy(*keys, "__b")  # cells of a bucket: at most (width / FINE) ** axes, whatever the number of records
    counted = spread.withColumn("__n", F.sum("n").over(inside))
    return counted.groupBy(*cells.columns).agg(F.avg("__n").alias("density"))


def _cells(rows: DataFrame, xs: list[str], keys: list[str]) -> DataFrame:
    grid = [F.floor(F.col(x) / FINE).alias(f"c{i}") for i, x in enumerate(xs)]
    cells = rows.groupBy(*keys, *grid).agg(F.min("id").alias("id"), F.count("*").alias("n"), *(F.avg(x).alias(x) for x in xs))
    return cells.drop(*(f"c{i}" for i in range(len(xs))))


def _chance(id_col: str, seed: int) -> Column:
    """A number above 0 and below 1 that an id always has."""
    return (F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(2**40)).cast("double") + 0.5) / 2**40


def inverse_density_sample(objects: DataFrame, size: int, axes: list[Column], *, id_col: str = "roi_id", seed: int = SEED) -> DataFrame:
    """``size`` ids drawn without replacement, with chances inverse to density; fewer if there are fewer ids. The same seed gives the same sample.

    The draw is that of the ``size`` smallest values of -log(u) / weight, u a fixed random number of each id, so it is one pass and a top-k.
    Rows with a null id or coordinate are left out; repeated ids count once; an empty table gives none.
    """
    xs = [f"x{i}" for i in range(len(axes))]
    rows = objects.select(F.col(id_col).alias("id"), *(a.cast("double").alias(x) for a, x in zip(axes, xs))).dropna()
    rows = settle(rows.groupBy("id").agg(F.min(F.struct(*xs)).alias("x")).select("id", "x.*"), "rows")
    grid = [F.floor(F.col(x) / FINE).alias(f"c{i}") for i, x in enumerate(xs)]
    cs = [f"c{i}" for i in range(len(xs))]
    cells = rows.select("*", *grid).groupBy(*cs).agg(F.count("*").alias("n"), *(F.avg(x).alias(x) for x in xs))
    density = settle(with_density(cells, xs, [], seed=seed).select(*cs, "density"), "density")
    weighed = join_sized(rows.select("id", *grid), density, cs).select("id", (-F.log(_chance("id", seed)) * F.col("density")).alias("key"))
    return weighed.orderBy("key", "id").limit(size).select(F.col("id").alias(id_col))


def least_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The least spanning tree: the points as they join it, for each the point that it joins (-1 for the first) and the squared length of that edge."""
    size = len(points)
    dist, source, inside = np.full(size, np.inf), np.zeros(size, int), np.zeros(size, bool)
    order, came, length = [0], np.full(size, -1), np.zeros(size)
    at, inside[0] = 0, True
    for _ in range(size - 1):
        d = ((points - points[at]) ** 2).sum(1)
        closer = ~inside & (d < dist)
        dist[closer], source[closer] = d[closer], at
        at = int(np.where(inside, np.inf, dist).argmin())
        came[at], length[at], inside[at] = source[at], dist[at], True
        order.append(at)
    return np.array(order), came, length


def _linked(points: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """``linkage_groups``, and the length of the longest edge that is left."""
    size = len(points)
    if size <= n:
        return np.arange(size), 0.0
    order, came, length = least_tree(points)
    edges = np.argsort(-length[order[1:]], kind="stable") + 1
    cut = set(edges[: n - 1])
    group, count = np.zeros(size, int), 0
    for i, p in enumerate(order[1:], 1):
        count += i in cut
        group[p] = count if i in cut else group[came[p]]
    return group, float(np.sqrt(length[order[edges[n - 1]]]))


def linkage_groups(points: np.ndarray, n: int) -> np.ndarray:
    """Groups (0 .. n - 1) that are left when the n - 1 longest edges of the least spanning tree are cut."""
    return _linked(points, n)[0]


def draw(ids: np.ndarray, weight: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Places in the order in which they are drawn without replacement by weight: a draw of any size is a beginning of it."""
    return np.lexsort((ids, -np.log(chance) / weight))


def drawn_groups(points: np.ndarray, drawn: np.ndarray, n: int, *, first: int = DRAWN) -> tuple[np.ndarray, int]:
    """(``linkage_groups`` of all points, the size of the draw that they were found by); ``drawn`` are the places in the order of ``draw``.

    Only the first ``first * n`` draws are linked, and every other point joins the draw nearest to it. That these are the groups of all points is proved:
    within a group no link is longer than ``within`` and ``reach``, the longest ways between its draws and from a point to them; between two groups every
    way is at least ``apart``, the shortest from a point to the draws of another group, less ``reach``. Where that isn't longer, so that a group may be
    missed, four times as many are drawn, in the end all.
    """
    size, m = len(points), max(first * n, n + 1)
    while m < size:
        seen = drawn[:m]
        label, within = _linked(points[seen], n)
        group, apart, reach = np.empty(size, int), np.inf, 0.0
        step = max(1, 2_000_000 // m)
        for i in range(0, size, step):
            d = np.sqrt(sum((points[i : i + step, None, k] - points[None, seen, k]) ** 2 for k in range(points.shape[1])))
            group[i : i + step] = own = label[d.argmin(1)]
            reach = max(reach, d.min(1).max())
            apart = min(apart, d[label[None, :] != own[:, None]].min(initial=np.inf))
        if max(within, reach) < (apart - reach) * (1 - 1e-9):
            return group, m
        m *= 4
    return linkage_groups(points, n), size


def varied_sample(objects: DataFrame, plan: DataFrame, axes: list[Column], *, key: str = "sample_id", n_pick: str = "n_pick", id_col: str = "roi_id", seed: int = SEED) -> DataFrame:
    """Ids of ``n_pick`` objects of every planned key: of each of its groups of like objects the smallest id.

    The objects of a key fall into ``n_pick`` groups, which the longest edges of the least spanning tree set apart. They are found by a draw without
    replacement, with chances inverse to density, which hits the small groups as well as the large ones: see ``drawn_groups``. A draw that misses a group
    is found out and made larger, so the draw decides how much is linked and never what comes out. Keys are compared without case and surrounding white
    space; a key twice in the plan takes the greater number; a null key, a number below 1 and a key without objects give nothing; a key with fewer
    distinct places than picks gives one id a place. Repeated rows and ties (the smaller id) change nothing; null ids and coordinates
    are left out. What a task holds of a key are cells of the fine grid, whose number depends on the range of the axes only.
    """
    xs = [f"x{i}" for i in range(len(axes))]
    wanted = plan.select(norm_key(key).alias("k"), F.col(n_pick).alias("pick")).filter("k IS NOT NULL AND pick > 0")
    wanted = settle(wanted.groupBy("k").agg(F.max("pick").alias("pick")), "plan")
    rows = objects.select(norm_key(key).alias("k"), F.col(id_col).cast("long").alias("id"), *(a.cast("double").alias(x) for a, x in zip(axes, xs))).dropna()
    cells = settle(_cells(join_sized(rows, wanted, "k"), xs, ["k", "pick"]), "cells")
    dense = with_density(cells, xs, ["k"], seed=seed).withColumn("chance", _chance("id", seed))

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        n = int(pdf["pick"].iloc[0])
        drawn = draw(pdf.id.to_numpy(), (pdf.n / pdf.density).to_numpy(float), pdf.chance.to_numpy(float))
        group, _ = drawn_groups(pdf[xs].to_numpy(float), drawn, n)
        return pd.DataFrame({"id": pdf.groupby(group).id.min().to_numpy()})

    return dense.groupBy("k").applyInPandas(pick, "id long").select(F.col("id").alias(id_col))
