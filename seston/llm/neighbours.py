"""Nearest neighbours of every point by random-projection trees.

A sample of bounded size gives an upper tree, whose leaves are buckets of about BUCKET points; each bucket is one task's work and is searched
by a forest (``forest``). A point whose k-th neighbour so far is farther away than the bucket's border then visits the buckets beyond, those
that its ball reaches: the queue of the upper tree, taken to its end. So no neighbour is lost at borders, and what is lost within a bucket is what
the forest's rounds leave out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seston.llm.forest import Search
from seston.runtime import settle

#: Rows aimed at in a bucket, levels of the upper tree at most, sample rows for each of its leaves.
BUCKET, LEVELS, SAMPLE = 16384, 16, 64
#: Equal points are told apart by a further coordinate, this share of the spread of the data.
APART = 1e-7


class UpperTree:
    """Directions and thresholds of each level's nodes, from a sample."""

    def __init__(self, points: np.ndarray, levels: int, rng: np.random.Generator):
        node = np.zeros(len(points), np.int64)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        for level in range(levels):
            w = rng.normal(size=(2**level, points.shape[1]))
            w /= np.linalg.norm(w, axis=1, keepdims=True)
            value = (points * w[node]).sum(1)
            order = np.lexsort((value, node))
            ends = np.searchsorted(node[order], np.arange(2**level + 1))
            n = np.diff(ends)
            a, b = np.clip(ends[:-1] + (n - 1) // 2, 0, max(len(points) - 1, 0)), np.clip(ends[:-1] + n // 2, 0, max(len(points) - 1, 0))
            cut = np.where(n > 0, (value[order][a] + value[order][b]) / 2, 0.0) if len(points) else np.zeros(2**level)
            self.levels.append((w, cut))
            node = 2 * node + (value > cut[node])

    def bucket(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for w, cut in self.levels:
            node = 2 * node + ((points * w[node]).sum(1) > cut[node])
        return node

    def reached(self, points: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, bucket) of all buckets but its own that lie within ``reach`` of a point."""
        who, node, home, bound = np.arange(len(points)), np.zeros(len(points), np.int64), np.ones(len(points), bool), np.zeros(len(points))
        for w, cut in self.levels:
            off = (points[who] * w[node]).sum(1) - cut[node]
            right = off > 0
            far = np.maximum(bound, np.abs(off))
            also = far < reach[who]
            node, other = 2 * node + right, 2 * node + ~right
            who, node = np.r_[who, who[also]], np.r_[node, other[also]]
            home, bound = np.r_[home, np.zeros(also.sum(), bool)], np.r_[bound, far[also]]
        return who[~home], node[~home]


def neighbours(objects: DataFrame, fields: list[str], *, id_col: str = "roi_id", k: int = 5, seed: int = 7, bucket: int = BUCKET) -> DataFrame:
    """id and ``near``: up to k structs (d, b) of squared distance and id, nearest first, by Euclidean distance over ``fields``.

    Ids must be unique. Rows with a null id or field are left out. Of equally far points any may come out; equal points are neighbours at
    distance 0, however many there are. A single point has an empty ``near``, an empty table gives an empty result; columns beyond those named are
    ignored.
    """
    spark = objects.sparkSession
    xs = [f"x{i}" for i in range(len(fields))]
    rows = settle(objects.select(F.col(id_col).cast("long").alias("id"), *(F.col(c).cast("double").alias(x) for c, x in zip(fields, xs))).dropna(), "points")
    n = rows.count()
    levels = 0 if n <= bucket else min(LEVELS, int(np.ceil(np.log2(n / bucket))))
    want = SAMPLE * 2**levels
    part = rows.filter(F.pmod(F.xxhash64("id"), F.lit(10**9)) <= int(10**9 * want / max(n, 1))).limit(4 * want)
    sample = part.toPandas().sort_values("id")
    scale = float(sample[xs].std().max()) * APART if len(sample) > 1 else 0.0
    scale = scale if np.isfinite(scale) and scale > 0 else 1e-12

    def spread(ids: np.ndarray, points: np.ndarray) -> np.ndarray:
        """With a further coordinate, tiny and random, by which equal points can be split."""
        h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        return np.c_[points, (h >> np.uint64(11)).astype(float) / 2**53 * scale]

    rng = np.random.default_rng(seed)
    upper = spark.sparkContext.broadcast(UpperTree(spread(sample.id.to_numpy(), sample[xs].to_numpy(float)), levels, rng))  # at most 2 ** LEVELS nodes
    doubles = ", ".join(f"{x} double" for x in xs)

    def place(batches):
        for pdf in batches:
            yield pdf.assign(bucket=upper.value.bucket(spread(pdf.id.to_numpy(), pdf[xs].to_numpy(float))))

    placed = rows.mapInPandas(place, f"id long, {doubles}, bucket long")

    def result(pdf: pd.DataFrame, dist: np.ndarray, near: np.ndarray) -> pd.DataFrame:
        there = near >= 0
        return pd.DataFrame({"d": [d[t] for d, t in zip(dist, there)], "b": [b[t] for b, t in zip(near, there)]}, index=pdf.index)

    def within(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        ids, plain = pdf.id.to_numpy(), pdf[xs].to_numpy(float)
        points = spread(ids, plain)
        found = Search(points, points, np.arange(len(ids)), k, real=len(xs), slack=2 * scale, seed=seed + int(key[0]))
        return pd.concat([pdf, result(pdf, found.dist, np.where(found.near >= 0, ids[found.near], -1))], axis=1)

    schema = f"id long, {doubles}, bucket long, d array<double>, b array<long>"
    first = settle(placed.groupBy("bucket").applyInPandas(within, schema), "within")
    if levels:

        def visit(batches):
            for pdf in batches:
                reach = np.array([np.sqrt(d[-1]) if len(d) == k else np.inf for d in pdf.d]) + 2 * scale
                who, bucket = upper.value.reached(spread(pdf.id.to_numpy(), pdf[xs].to_numpy(float)), reach)
                at = pdf.iloc[who]
                yield pd.DataFrame({"id": at.id.to_numpy(), **{x: at[x].to_numpy() for x in xs}, "bucket": bucket, "reach": (reach[who] - 2 * scale) ** 2})

        visits = first.mapInPandas(visit, f"id long, {doubles}, bucket long, reach double")

        def beyond(key: tuple, owners: pd.DataFrame, guests: pd.DataFrame) -> pd.DataFrame:
            if not len(owners) or not len(guests):
                return pd.DataFrame({"id": [], "d": [], "b": []})
            owners, guests = owners.sort_values("id", ignore_index=True), guests.sort_values("id", ignore_index=True)
            ids = owners.id.to_numpy()
            points, asked = spread(ids, owners[xs].to_numpy(float)), spread(guests.id.to_numpy(), guests[xs].to_numpy(float))
            found = Search(points, asked, np.full(len(guests), -1), k, real=len(xs), slack=2 * scale, within=guests.reach.to_numpy(), seed=seed + int(key[0]))
            near = np.where((found.near >= 0) & (found.dist < guests.reach.to_numpy()[:, None]), ids[found.near], -1)
            out = pd.concat([guests[["id"]], result(guests, found.dist, near)], axis=1)
            return out[(near >= 0).any(1)]

        owners = first.select("id", *xs, "bucket").groupBy("bucket")
        more = owners.cogroup(visits.groupBy("bucket")).applyInPandas(beyond, "id long, d array<double>, b array<long>")
        first = first.select("id", "d", "b").unionByName(more)
    pairs = first.select("id", F.arrays_zip("d", "b").alias("p"))
    return pairs.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("p"))), 1, k).alias("near"))


def neighbour_pairs(near: DataFrame) -> DataFrame:
    """roi_id_a < roi_id_b of which at least one is among the nearest of the other."""
    pair = near.select("id", F.explode("near").alias("p")).select("id", "p.b")
    return pair.select(F.least("id", "b").alias("roi_id_a"), F.greatest("id", "b").alias("roi_id_b")).distinct()


#: Queries of a block of the exact search.
QUERIES = 4096


def exact_neighbours(objects: DataFrame, queries: DataFrame, fields: list[str], *, id_col: str = "roi_id", k: int = 5) -> DataFrame:
    """id and the squared distances ``d`` of the k nearest, by comparing all rows with the queries in blocks: what an index is measured against."""
    spark = objects.sparkSession
    columns = [F.col(id_col).cast("long").alias("id"), *(F.col(c).cast("double").alias(c) for c in fields)]
    rows, asked = objects.select(*columns).dropna(), queries.select(*columns).dropna()
    out = None
    block: list = []

    def search(shared):
        def run(batches):
            ids, points = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                own = batch.column(0).to_numpy()
                there = np.stack([batch.column(i + 1).to_numpy() for i in range(len(fields))], 1)
                for i in range(0, len(ids), 256):
                    d = sum((points[i : i + 256, None, c] - there[None, :, c]) ** 2 for c in range(len(fields)))
                    d[ids[i : i + 256, None] == own[None, :]] = np.inf
                    m = min(k, d.shape[1])
                    near = np.partition(d, m - 1, 1)[:, :m]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 256]), pa.array([[float(v) for v in r if np.isfinite(v)] for r in near], pa.list_(pa.float64()))], names=["id", "d"])

        return run

    def flush():
        nonlocal out
        ids, points = np.array([r[0] for r in block], np.int64), np.array([r[1:] for r in block], float)
        part = rows.mapInArrow(search(spark.sparkContext.broadcast((ids, points))), "id long, d array<double>")
        out = part if out is None else out.unionByName(part)
        block.clear()

    for r in asked.toLocalIterator():
        block.append(tuple(r))
        if len(block) == QUERIES:
            flush()
    if block:
        flush()
    if out is None:
        return spark.createDataFrame([], "id long, d array<double>")
    return out.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("d"))), 1, k).alias("d"))


def recall(near: DataFrame, exact: DataFrame) -> DataFrame:
    """n_queries, n_true and ``recall``: of the true neighbours the share whose distance the index found as well (so ties may differ in id)."""
    both = exact.join(near.select("id", F.transform("near", lambda p: p["d"]).alias("found")), "id", "left")
    hit = F.size(F.filter(F.transform("d", lambda v, i: F.coalesce(F.get("found", i), F.lit(float("inf"))) <= v * (1 + 1e-9) + 1e-30), lambda b: b))
    return both.agg(F.count("*").alias("n_queries"), F.coalesce(F.sum(F.size("d")), F.lit(0)).alias("n_true"), F.coalesce(F.sum(hit) / F.sum(F.size("d")), F.lit(1.0)).alias("recall"))
