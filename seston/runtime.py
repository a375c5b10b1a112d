"""Session helpers: the shared folder, lineage cuts, size-checked joins and normalised keys."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()

#: A join side is broadcast only if its measured bytes are at most this.
BROADCAST_LIMIT = 32 * 1024 * 1024


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) is a temporary folder set; on a cluster that is an error.
    """
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    named = sc.getConf().get("spark.checkpoint.dir")
    if named is None and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if named is None:
        named = tempfile.mkdtemp(prefix="seston-")
        atexit.register(shutil.rmtree, named, True)
        named = "file://" + named
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once a session, where their path doesn't have it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sc = spark.sparkContext
    on_path = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if root in map(os.path.abspath, filter(None, on_path)) or sc.applicationId in _SHIPPED:
        return
    folder = tempfile.mkdtemp(prefix="seston-ship-")  # the driver's own; Spark's file server takes it to the workers
    atexit.register(shutil.rmtree, folder, True)
    sc.addPyFile(shutil.make_archive(f"{folder}/seston", "zip", root, "seston"))
    _SHIPPED.add(sc.applicationId)


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def local_path(uri: str) -> str:
    """The mounted path of a ``file:`` URI; other URIs are refused by those who need a mount."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if "://" in uri:
        raise ValueError(f"{uri} is not on a mounted folder")
    return uri


def settle(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df`` by a table written in the shared folder.

    A lost executor then costs a re-read of files, not a re-run of what came before. The files stay
    until the driver ends.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    if path.startswith("file:"):
        atexit.register(shutil.rmtree, local_path(path), True)
    return spark.read.schema(df.schema).parquet(path)


def table_bytes(df: DataFrame) -> int:
    """Estimated bytes of a settled table: the optimizer's statistics of its file scan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def join_sized(left: DataFrame, right: DataFrame, on, how: str = "inner", limit: int = BROADCAST_LIMIT, factor: float = 4.0) -> DataFrame:
    """Join a settled ``right``: broadcast if its measured size allows it, else shuffled.

    The shuffled join leaves skewed keys to adaptive execution, which splits the partitions of ``left``.
    ``factor`` is how much larger rows are in memory than in the files.
    """
    if table_bytes(right) * factor <= limit:
        right = F.broadcast(right)
    return left.join(right, on, how)


#: What Unicode counts as white space.
WHITE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def norm_key(col: Column | str) -> Column:
    """Spellings that differ only in case or surrounding white space are one key."""
    col = F.col(col) if isinstance(col, str) else col
    return F.lower(F.trim(col, F.lit(WHITE)))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))
