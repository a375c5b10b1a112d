"""Consolidating tiny files into few well-sized ones, each record once.

The plan: every file's content is hashed once into a narrow table; of files with the same key and content the one
with the smallest id is kept. Kept files are assigned to output groups longest first, each to the group that
has least so far (a heap). What goes through the heap on the driver is bounded: files of at least
``1 / SPLIT`` of the target size go by themselves (at most SPLIT per group), smaller ones in bundles of one size class and
about that size. Each group is streamed by one task through pyarrow into a hidden file and renamed in place, under a
name of this run; the manifest, which alone says what is published, is replaced by a rename after the written files have been read again and
their row counts and checksums agree with the plan. A run that fails leaves what was published before.
"""

from __future__ import annotations

import heapq
import json
import os
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seston.runtime import BROADCAST_LIMIT, local_path, norm_key, scratch, settle

SPLIT = 16
TARGET_BYTES = 256 * 1024 * 1024


def longest_first(sizes: list[tuple[int, int]], groups: int) -> dict[int, int]:
    """Item -> group for (item, bytes): longest first, each to the least loaded group; ties by the lower number."""
    heap = [(0, g) for g in range(groups)]
    out = {}
    for item, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, g = heapq.heappop(heap)
        out[item] = g
        heapq.heappush(heap, (load + size, g))
    return out


@dataclass
class Compaction:
    path: str
    manifest: dict
    kept: DataFrame
    dropped: DataFrame

    def read(self) -> DataFrame:
        """The consolidated records, as the manifest lists them."""
        if not self.manifest["files"]:
            return self.kept.sparkSession.createDataFrame([], self.manifest["schema"])
        return self.kept.sparkSession.read.parquet(*(f"file://{self.path}/{f['name']}" for f in self.manifest["files"]))


def published(out: str) -> list[str]:
    """The names of the parts that the manifest lists, none without one."""
    try:
        with open(f"{out}/manifest.json") as f:
            return [x["name"] for x in json.load(f)["files"]]
    except FileNotFoundError:
        return []


def survey(files: DataFrame, id_col: str, key: str, data: str) -> DataFrame:
    """id, normalised key, content hash and length of each file, written as a table."""
    k = norm_key(key)
    own = files.select(
        F.col(id_col).alias("id"),
        F.when(F.length(k) > 0, k).alias("k"),
        F.sha2(data, 256).alias("sha"),
        F.length(data).cast("long").alias("n"),
    )
    return settle(own, "survey")


def compact(files: DataFrame, out_dir: str | None = None, *, id_col: str = "file_id", key: str = "object_id", data: str = "image_data", target_bytes: int = TARGET_BYTES) -> Compaction:
    """Write each record (key, content) of ``files`` once, into files of about ``target_bytes``.

    A file adds no record if its content is null or empty or if a file with a smaller id has the same key
    (case and surrounding white space aside) and content; a null or blank key equals no other. ``dropped`` holds the ids
    of those files, ``kept`` the ids and groups of the others. Rows repeated as a whole count once. Columns beyond the three
    named aren't written. An empty table gives a manifest without files. ``out_dir`` must be mounted by all
    executors; by default it lies in the shared folder.
    """
    spark = files.sparkSession
    out = local_path(out_dir or scratch(spark, "compact"))
    os.makedirs(out, exist_ok=True)
    run = uuid.uuid4().hex[:12]  # parts of one run; the manifest alone says which run's parts hold
    seen = survey(files, id_col, key, data)
    whole = seen.filter("n > 0")
    unique = F.coalesce(F.concat(F.lit("k"), "k"), F.concat(F.lit("i"), F.col("id").cast("string")))
    kept = whole.groupBy(unique.alias("u"), "sha").agg(F.min("id").alias("id"), F.first("n").alias("n"))
    kept = settle(kept.select("id", "n", F.xxhash64("id", "sha").alias("sum")), "kept")
    dropped = settle(seen.select("id").distinct().join(kept, "id", "left_anti").select(F.col("id").alias(id_col)), "dropped")
    total = kept.agg(F.sum("n"), F.count("*")).first()
    groups = max(1, -(-(total[0] or 0) // target_bytes))
    # files of a size class (a power of two) are bundled so that a bundle has about 1 / SPLIT of the target; large files are bundles of one
    share = max(1, target_bytes // SPLIT)
    level = F.when(F.col("n") > 0, F.floor(F.log2(F.col("n").cast("double")))).otherwise(0).cast("int")
    leveled = kept.withColumn("level", level)
    counts = leveled.groupBy("level").agg(F.greatest(F.ceil(F.sum("n") / share), F.lit(1)).cast("long").alias("bundles"))  # at most 64 rows
    part = F.struct("level", F.when(F.col("n") >= share, F.col("id")).otherwise(F.pmod(F.xxhash64("id"), F.col("bundles"))).alias("part"))
    sized = leveled.join(F.broadcast(counts), "level").withColumn("bundle", F.xxhash64(part)).drop("level", "bundles")
    sizes = [(r[0], r[1]) for r in sized.groupBy("bundle").agg(F.sum("n")).collect()]  # about SPLIT * groups rows, and one a size class
    to_group = longest_first(sizes, groups)
    mapping = spark.createDataFrame([(b, g) for b, g in to_group.items()], "bundle long, g int")
    plan = settle(sized.join(F.broadcast(mapping) if len(sizes) * 16 <= BROADCAST_LIMIT else mapping, "bundle").select("id", "n", "sum", "g"), "plan")
    want = {r["g"]: r for r in plan.groupBy("g").agg(F.count("*").alias("rows"), F.sum("n").alias("bytes"), F.expr("bit_xor(sum)").alias("sum")).collect()}
    content = files.select(F.col(id_col).alias("id"), F.col(key).alias(key), F.col(data).alias(data))
    small = plan.select("id", "g")
    if total[1] * 16 <= BROADCAST_LIMIT:
        small = F.broadcast(small)
    rows = content.dropDuplicates(["id"]) if _repeats(seen) else content
    placed = rows.join(small, "id").repartitionById(groups, "g").sortWithinPartitions("g", "id")
    schema = pa.schema([(id_col, pa.int64()), (key, pa.string()), (data, pa.binary())])

    def write(batches):
        writer, at, count, made = None, None, 0, ""
        for batch in batches:
            g = batch.column("g").to_numpy()
            start = 0
            while start < len(g):
                if at != g[start]:
                    if writer is not None:
                        writer.close()
                        os.replace(made, f"{out}/part-{run}-{at:06d}.parquet")
                        yield pa.RecordBatch.from_pydict({"g": pa.array([at], pa.int32()), "rows": pa.array([count], pa.int64())})
                    at, count = int(g[start]), 0
                    made = f"{out}/.part-{at:06d}-{uuid.uuid4().hex}"
                    writer = pq.ParquetWriter(made, schema, compression="zstd")
                stop = start + int((g[start:] == at).sum())
                part = batch.slice(start, stop - start)
                writer.write_batch(pa.RecordBatch.from_arrays([part.column("id"), part.column(key), part.column(data)], schema=schema))
                count += stop - start
                start = stop
        if writer is not None:
            writer.close()
            os.replace(made, f"{out}/part-{run}-{at:06d}.parquet")
            yield pa.RecordBatch.from_pydict({"g": pa.array([at], pa.int32()), "rows": pa.array([count], pa.int64())})

    written = {r["g"]: r["rows"] for r in placed.mapInArrow(write, "g int, rows long").collect()}
    names = {g: f"part-{run}-{g:06d}.parquet" for g in written}
    found = {}
    if names:
        again = spark.read.parquet(*(f"file://{out}/{n}" for n in names.values()))
        again = again.select(F.regexp_extract(F.col("_metadata.file_name"), r"part-[0-9a-f]+-(\d+)", 1).cast("int").alias("g"), F.xxhash64(F.col(id_col), F.sha2(data, 256)).alias("sum"))
        found = {r["g"]: (r["rows"], r["sum"]) for r in again.groupBy("g").agg(F.count("*").alias("rows"), F.expr("bit_xor(sum)").alias("sum")).collect()}
    if found != {g: (r["rows"], r["sum"]) for g, r in want.items()}:
        raise RuntimeError("the files written don't hold what was planned; no manifest was published")
    manifest = {
        "schema": f"{id_col} long, {key} string, {data} binary",
        "files": [{"name": names[g], "rows": want[g]["rows"], "content_bytes": want[g]["bytes"], "checksum": want[g]["sum"], "file_bytes": os.path.getsize(f"{out}/{names[g]}")} for g in sorted(names)],
    }
    with open(f"{out}/.manifest-{uuid.uuid4().hex}", "w") as f:
        json.dump(manifest, f, indent=1)
        f.flush()
        os.fsync(f.fileno())
    before = published(out)
    os.replace(f.name, f"{out}/manifest.json")
    for part in before:  # those of the manifest that is no more
        if part not in {x["name"] for x in manifest["files"]} and os.path.exists(f"{out}/{part}"):
            os.remove(f"{out}/{part}")
    return Compaction(out, manifest, plan.select(F.col("id").alias(id_col), F.col("g").alias("part")), dropped)


def _repeats(seen: DataFrame) -> bool:
    """Whether any id stands on more than one row."""
    return bool(seen.groupBy("id").count().filter("count > 1").limit(1).count())
