"""Finding files and reading or writing one per row. Paths must be on a folder that all executors mount."""

from __future__ import annotations

import glob as globs
import os
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seston.runtime import local_path


def walk(root: str, extensions: set[str] | None, in_order: bool = False):
    """Files under ``root`` whose extension is one of ``extensions`` (case counts); with ``in_order`` by name, those of a folder before its subfolders'."""
    for folder, subfolders, names in os.walk(root):
        if in_order:
            subfolders.sort()
            names.sort()
        for n in names:
            if extensions is None or os.path.splitext(n)[1] in extensions:
                yield os.path.join(folder, n)


def find_files(root: Column, extensions: list[str], in_order: bool = False) -> Column:
    """The paths under each row's root as an array."""
    wanted = set(extensions)

    @F.pandas_udf("array<string>")
    def run(roots: pd.Series) -> pd.Series:
        return pd.Series([[] if r is None else list(walk(local_path(r), wanted, in_order)) for r in roots], dtype=object)

    return run(root)


def glob_files(pattern: Column, recursive: bool = False) -> Column:
    """The paths that each row's pattern matches, as an array."""

    @F.pandas_udf("array<string>")
    def run(patterns: pd.Series) -> pd.Series:
        return pd.Series([[] if p is None else globs.glob(local_path(p), recursive=recursive) for p in patterns], dtype=object)

    return run(pattern)


def list_files(spark: SparkSession, root: str, pattern: str = "*", content: bool = False) -> DataFrame:
    """path, modificationTime, length (and content) of files under ``root`` on any file system, listed by Spark."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files if content else files.drop("content")


def read_images(spark: SparkSession, root: str, pattern: str = "*.png") -> DataFrame:
    """path and image (a raster) of the PNG files under ``root``; what can't be decoded has a null image."""
    from seston.operators.images import decode_png

    return list_files(spark, root, pattern, content=True).select("path", decode_png(F.col("content")).alias("image"))


def read_bytes(path: Column) -> Column:
    """The content of each row's file."""

    @F.pandas_udf("binary")
    def run(paths: pd.Series) -> pd.Series:
        out = []
        for p in paths:
            if p is None:
                out.append(None)
                continue
            with open(local_path(p), "rb") as f:
                out.append(f.read())
        return pd.Series(out, dtype=object)

    return run(path)


def write_atomically(path: str, data: bytes) -> int:
    """By a hidden file and a rename, so that a repeated task changes nothing."""
    folder, name = os.path.split(path)
    if folder:
        os.makedirs(folder, exist_ok=True)
    made = os.path.join(folder, f".{name}-{uuid.uuid4().hex}")
    with open(made, "wb") as f:
        f.write(data)
    os.replace(made, path)
    return len(data)


def write_bytes(path: Column, data: Column) -> Column:
    """Writes each row's content to its path and gives the number of bytes, -1 of null content."""

    def run(paths: pd.Series, parts: pd.Series) -> pd.Series:
        return pd.Series([-1 if p is None or d is None else write_atomically(local_path(p), bytes(d)) for p, d in zip(paths, parts)])

    return F.pandas_udf(run, "long").asNondeterministic()(path, data)


def write_images(df: DataFrame, path: str, image: str) -> int:
    """Writes each row's raster as a PNG to its path; the number of files."""
    from seston.operators.images import encode_png

    written = df.select(write_bytes(F.col(path), encode_png(F.col(image))).alias("n"))
    return written.filter("n >= 0").count()
