"""Groups of like objects by density, each with its size and typical members.

Objects are counted on a fine grid; its cells, with counts and mean places, are the reduced vectors. Space is cut into blocks, and a cell
also comes into every block that it is within a margin of. Block by block the mass around each cell is counted, cells with enough of it (cores) are
linked to those near them, and other cells join the nearest core. Cores in several blocks' margins tell which local clusters are one: the
clusters' graph is merged by label propagation on the executors. What a task holds is the cells of a block or group, whose number depends on the space and
not on the number of objects; nothing but counts comes to the driver.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seston.runtime import join_sized, settle

#: Radius of density, least share of all objects within it, least number, width of a cell, reach of a group's border, width of a block.
EPS, SHARE, LEAST, CELL, REACH, SIDE = 0.12, 0.001, 5, 0.04, 0.1, 1.44
#: Sums of distances that differ by less, as a share of the group's weight times its extent, are equal.
EQUAL = 1e-12
#: Pairs of a block that are all compared, and links of a block that are kept in memory; beyond that a grid is used, and links are found anew each round.
FEW, KEPT = 20_000_000, 20_000_000


def around(points: np.ndarray, others: np.ndarray, radius: float):
    """(indices of points, indices of others near them, their squared distances) for all others within ``radius`` and some beyond: of few points all, of
    many those that a grid of that width finds."""
    if not len(points) or not len(others):
        return

    def squared(at: np.ndarray, near: np.ndarray) -> np.ndarray:
        return sum((points[at, None, k] - others[None, near, k]) ** 2 for k in range(points.shape[1]))

    if len(points) * len(others) <= FEW:
        near = np.arange(len(others))
        for i in range(0, len(points), 256):
            at = np.arange(i, min(i + 256, len(points)))
            yield at, near, squared(at, near)
        return
    cells = np.floor(others / radius).astype(np.int64)
    order = np.lexsort(cells.T[::-1])
    cells = cells[order]
    cut = np.flatnonzero(np.r_[True, (cells[1:] != cells[:-1]).any(1)])
    grid = {tuple(cells[a]): order[a:b] for a, b in zip(cut, np.r_[cut[1:], len(order)])}
    own: dict[tuple, list[int]] = {}
    for i, c in enumerate(map(tuple, np.floor(points / radius).astype(np.int64))):
        own.setdefault(c, []).append(i)
    steps = list(itertools.product((-1, 0, 1), repeat=points.shape[1]))
    for c, mine in own.items():
        near = [grid[k] for s in steps if (k := tuple(a + b for a, b in zip(c, s))) in grid]
        if near:
            near = np.concatenate(near)
            for i in range(0, len(mine), 256):
                at = np.array(mine[i : i + 256])
                yield at, near, squared(at, near)


def mass_within(points: np.ndarray, others: np.ndarray, weight: np.ndarray, eps: float = EPS) -> np.ndarray:
    """The weight of ``others`` within ``eps`` of each point."""
    mass = np.zeros(len(points))
    for at, near, d in around(points, others, eps):
        mass[at] = (d <= eps**2) @ weight[near]
    return mass


def linked(points: np.ndarray, eps: float = EPS) -> np.ndarray:
    """For each point the least index of the set, linked within ``eps``, that it lies in."""

    def links():
        for at, near, d in around(points, points, eps):
            i, j = np.nonzero(d <= eps**2)
            yield at[i], near[j]

    kept: list | None = []
    size = 0
    for pair in links():
        kept.append(pair)
        size += len(pair[0])
        if size > KEPT:
            kept = None
            break
    label = np.arange(len(points))
    while True:
        new = label.copy()
        for i, j in kept if kept is not None else links():
            np.minimum.at(new, i, new[j])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def nearest_label(points: np.ndarray, cores: np.ndarray, label: np.ndarray, reach: float = REACH) -> np.ndarray:
    """The label of the nearest core within ``reach`` of each point, else -1; of equally near ones the least label."""
    out = np.full(len(points), -1, np.int64)
    for at, near, d in around(points, cores, reach):
        best = d.min(1)
        among = np.where(d <= best[:, None], label[near][None, :], np.iinfo(np.int64).max).min(1)
        out[at] = np.where(best <= reach**2, among, out[at])
    return out


def medoid(points: np.ndarray, weight: np.ndarray) -> tuple[int, int]:
    """(the least index of those with the least sum of weighted distances to all points, how many sums were counted to tell).

    The sum is a convex function of the place, so the plane that touches it at one point lies below it everywhere, and a point at distance d has at
    least the whole weight times d less that point's sum. Sums are counted, the least bound first, until every other bound is above the least sum.
    """
    whole = weight.sum()
    slack = EQUAL * whole * np.sqrt(((points.max(0) - points.min(0)) ** 2).sum())
    bound, total = np.zeros(len(points)), np.full(len(points), np.inf)
    i = int(((points - weight @ points / whole) ** 2).sum(1).argmin())
    while bound[i] <= total.min() + slack:
        off = points - points[i]
        d = np.sqrt((off**2).sum(1))
        total[i] = d @ weight
        slope = np.divide(weight, d, out=np.zeros(len(d)), where=d > 0) @ off  # the sum falls by it towards the other points
        bound = np.maximum(bound, np.maximum(total[i] - off @ slope, whole * d - total[i]))
        bound[i] = np.inf
        i = int(bound.argmin())
    return int(np.flatnonzero(total <= total.min() + slack)[0]), int(np.isfinite(total).sum())


def in_blocks(rows: DataFrame, xs: list[str], margin: float, side: float = SIDE) -> DataFrame:
    """``rows`` with ``block``, once for each block that they are within ``margin`` of, and ``home``, whether they lie in it."""
    out = rows.withColumn("home", F.lit(True)).withColumn("block", F.lit(17).cast("long"))
    for x in xs:
        at = F.floor(F.col(x) / side)
        near = F.array_compact(F.array(at, F.when(F.col(x) - at * side <= margin, at - 1), F.when((at + 1) * side - F.col(x) <= margin, at + 1)))
        out = out.withColumn("__b", F.explode(near)).withColumn("home", F.col("home") & (F.col("__b") == at)).withColumn("block", F.xxhash64("block", "__b"))
    return out.drop("__b")


def merged(pairs: DataFrame) -> DataFrame:
    """(v, label) for the ``v`` of (a, b): the least ``v`` of each connected set. Labels go to neighbours and to the labels' own labels until nothing changes."""
    both = settle(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    now = settle(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("label")), "labels")
    while True:
        new = now.withColumn("old", F.col("label"))
        for _ in range(2):
            got = both.join(new.select(F.col("v").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
            near = new.join(got, new["v"] == got["a"]).select("v", "old", F.least("label", "m").alias("near"))
            far = new.select(F.col("v").alias("near"), F.col("label").alias("far"))
            new = near.join(far, "near", "left").select("v", "old", F.least("near", "far").alias("label"))
        new = settle(new, "labels")
        now = new.select("v", "label")
        if not new.filter("old <> label").limit(1).count():
            return now


def density_cells(cells: DataFrame, xs: list[str], exemplars: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """((cell, grp) of the cells in a group, (e, grp) of the exemplars in one). ``cells`` has cell (its id), n and coordinates."""
    def masses(pdf: pd.DataFrame) -> pd.DataFrame:
        points, home = pdf[xs].to_numpy(float), pdf.home.to_numpy()
        mass = mass_within(points[home], points, pdf.n.to_numpy(float))
        return pdf[home].assign(core=mass >= least)[["cell", *xs, "n", "core"]]

    doubles = ", ".join(f"{x} double" for x in xs)
    seen = settle(in_blocks(cells, xs, EPS).groupBy("block").applyInPandas(masses, f"cell long, {doubles}, n long, core boolean"), "cores")

    def clusters(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell", ignore_index=True)
        root = linked(pdf[xs].to_numpy(float))
        first = pdf.cell.to_numpy()[root]  # a cluster is named by its block and least cell
        return pd.DataFrame({"cell": pdf.cell, "block": key[0], "first": first, "home": pdf.home})

    cores = seen.filter("core").select("cell", *xs)
    local = in_blocks(cores, xs, EPS).groupBy("block").applyInPandas(clusters, "cell long, block long, first long, home boolean")
    local = settle(local.select("cell", "home", F.xxhash64("block", "first").alias("cluster")), "clusters")
    # a core in several blocks says that its clusters there are one
    shared = local.withColumn("b", F.min("cluster").over(Window.partitionBy("cell"))).select(F.col("cluster").alias("a"), "b").distinct()  # a cell is in few blocks
    label = settle(merged(shared), "merged")
    of_core = join_sized(local.filter("home"), label.withColumnRenamed("v", "cluster"), "cluster").select("cell", F.col("label").alias("grp"))
    of_core = settle(of_core, "labelled")
    placed = cores.join(of_core, "cell").select("cell", *xs, "grp", F.lit(0).alias("kind"))
    rest = seen.filter("NOT core").select("cell", *xs, F.lit(0).cast("long").alias("grp"), F.lit(1).alias("kind"))
    asked = exemplars.select(F.col("e").cast("long").alias("cell"), *xs, F.lit(0).cast("long").alias("grp"), F.lit(2).alias("kind"))

    def borders(pdf: pd.DataFrame) -> pd.DataFrame:
        kind = pdf.kind.to_numpy()
        ask = (kind > 0) & pdf.home.to_numpy()
        core = pdf[kind == 0]
        found = nearest_label(pdf.loc[ask, xs].to_numpy(float), core[xs].to_numpy(float), core.grp.to_numpy())
        return pdf.loc[ask, ["cell", "kind"]].assign(hit=found != -1, grp=found)

    around_cores = in_blocks(placed.unionByName(rest).unionByName(asked), xs, REACH).groupBy("block").applyInPandas(borders, "cell long, kind int, hit boolean, grp long")
    border = settle(around_cores.filter("hit").select("cell", "kind", "grp"), "borders")
    return of_core.unionByName(border.filter("kind = 1").select("cell", "grp")), border.filter("kind = 2").select(F.col("cell").alias("e"), "grp")


def object_groups(objects: DataFrame, exemplars: DataFrame, axes: list[Column], *, id_col: str = "roi_id", exemplar_id: str = "exemplar_id") -> DataFrame:
    """id, ``grp``, exemplar_id and the coordinates of the objects that lie in a group.

    ``axes`` are the coordinates, for both tables. An object lies in a group if around it, or around the nearest such place within REACH, at least
    SHARE of all objects (and LEAST) are within EPS. The exemplar is the smallest of those that lie in the group, null if none does.
    Rows with a null id or coordinate are left out, in both tables; repeated rows count as often as they stand; equal objects share a cell; an empty
    table gives none; columns beyond the axes are ignored.
    """
    xs, cs = [f"x{i}" for i in range(len(axes))], [f"c{i}" for i in range(len(axes))]
    rows = objects.select(F.col(id_col).alias("id"), *(a.cast("double").alias(x) for a, x in zip(axes, xs))).dropna()
    rows = settle(rows.select("*", *(F.floor(F.col(x) / CELL).cast("int").alias(c) for x, c in zip(xs, cs))), "rows")
    cells = settle(rows.groupBy(cs).agg(F.count("*").alias("n"), *(F.avg(x).alias(x) for x in xs)).withColumn("cell", F.xxhash64(*cs)), "cells")
    total = cells.agg(F.sum("n")).first()[0] or 0
    least = max(LEAST, SHARE * total)
    # a cell with too little in the wide cells around it can't lie in a group: it stays where it is
    ws = [f"w{i}" for i in range(len(axes))]
    placed = cells.select("*", *(F.floor(F.col(x) / (EPS + REACH)).cast("int").alias(w) for x, w in zip(xs, ws)))
    counts = placed.groupBy(ws).agg(F.sum("n").alias("wn"))
    step = F.array(*(F.struct(*(F.lit(s).alias(w) for s, w in zip(o, ws))) for o in itertools.product((-1, 0, 1), repeat=len(ws))))
    spread = counts.select("wn", F.explode(step).alias("s"), *ws).select("wn", *((F.col(w) + F.col(f"s.{w}")).alias(w) for w in ws))
    busy = settle(spread.groupBy(ws).agg(F.sum("wn").alias("wn")).filter(F.col("wn") >= least).select(ws), "busy")
    near = settle(join_sized(placed, busy, ws, "left_semi").select("cell", "n", *xs), "near")
    ex = exemplars.select(F.col(exemplar_id).alias("e"), *(a.cast("double").alias(x) for a, x in zip(axes, xs))).dropna()
    inside, asked = density_cells(near, xs, ex, least)
    first = asked.groupBy("grp").agg(F.min("e").cast(exemplars.schema[exemplar_id].dataType).alias(exemplar_id))
    label = settle(inside.join(first, "grp", "left"), "labels")
    return join_sized(rows.withColumn("cell", F.xxhash64(*cs)), label, "cell").select(F.col("id").alias(id_col), "grp", exemplar_id, "cell", *xs)


def describe_groups(found: DataFrame, n_axes: int, *, id_col: str = "roi_id", exemplar_id: str = "exemplar_id", typical: int = 5) -> DataFrame:
    """grp, exemplar_id, n_objects, ``medoid`` and ``typical`` of each group of ``object_groups``.

    The medoid is the smallest id in the cell with the least sum of distances to all objects of the group, whichever cell that is (of equal sums the
    smallest id); ``typical`` are the ids of the ``typical`` objects nearest to the medoid's cell, nearest first. A task holds the cells of a group,
    whose number depends on the space that it takes and not on the number of objects.
    """
    xs = [f"x{i}" for i in range(n_axes)]
    cells = settle(found.groupBy("grp", exemplar_id, "cell").agg(F.count("*").alias("n"), F.min(id_col).alias("cid"), *(F.avg(x).alias(x) for x in xs)), "group-cells")

    def middle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cid", "cell"], ignore_index=True)
        at, _ = medoid(pdf[xs].to_numpy(float), pdf.n.to_numpy(float))
        return pdf.loc[[at], ["grp", "cid", *xs]].set_axis(["grp", "cid", *(f"c{x}" for x in xs)], axis=1)

    kind = found.schema[id_col].dataType.simpleString()
    found_at = cells.drop(exemplar_id).groupBy("grp").applyInPandas(middle, f"grp long, cid {kind}, " + ", ".join(f"c{x} double" for x in xs))
    sizes = cells.groupBy("grp", exemplar_id).agg(F.sum("n").alias("n_objects"))
    medoids = settle(sizes.join(found_at, "grp"), "medoids")
    away = F.sqrt(sum(((F.col(x) - F.col(f"c{x}")) ** 2 for x in xs), F.lit(0.0)))
    dist = join_sized(found.drop(exemplar_id), medoids.select("grp", *(f"c{x}" for x in xs)), "grp").select("grp", id_col, away.alias("d"))
    best = dist.withColumn("r", F.row_number().over(Window.partitionBy("grp").orderBy("d", id_col))).filter(F.col("r") <= typical)
    listed = best.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", id_col))), lambda t: t[id_col]).alias("typical"))
    return medoids.join(listed, "grp").select("grp", exemplar_id, "n_objects", F.col("cid").alias("medoid"), "typical")
