"""Tables in delimited text and growing array tables."""

from __future__ import annotations

import csv
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seston.operators.stream import keep_first
from seston.runtime import local_path

SAMPLE = 1024


def read_table(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """A file with a header line; the delimiter is found from its beginning unless given. Types are inferred."""
    if delimiter is None:
        text = spark.read.text(path, wholetext=False).limit(20).collect()
        sample = "\n".join(r[0] for r in text)[:SAMPLE]
        try:
            delimiter = csv.Sniffer().sniff(sample, ",;\t|").delimiter
        except csv.Error:
            delimiter = ","
    return spark.read.option("header", True).option("inferSchema", True).option("sep", delimiter).csv(path)


def write_csv(df: DataFrame, path: str, order: str | Column | list, drop_duplicates: list[str] | None = None, parts: bool = False) -> None:
    """The columns but for the order's own, with a header and without an index, in order; of rows with the same ``drop_duplicates`` the first stays.

    One file at ``path``, as a reader of single files expects; with ``parts`` a folder of files in order, for what is large.
    """
    if drop_duplicates:
        df = keep_first(df, drop_duplicates, order)
    by = order if isinstance(order, list) else [order]
    out = df.orderBy(*by)
    names = [c for c in df.columns if c not in [b for b in by if isinstance(b, str) and b.startswith("__")]]
    out = out.select(*names)
    if parts:
        out.write.option("header", True).mode("overwrite").csv(path)
        return
    out.coalesce(1).write.option("header", True).mode("overwrite").csv(path + ".parts")
    folder = local_path(path + ".parts")
    made = [n for n in os.listdir(folder) if n.endswith(".csv")]
    if made:
        os.replace(f"{folder}/{made[0]}", local_path(path))
    else:
        with open(local_path(path), "w") as f:
            csv.writer(f).writerow(names)
    for n in os.listdir(folder):
        os.remove(f"{folder}/{n}")
    os.rmdir(folder)


def append_values(df: DataFrame, path: str, compression: str = "zstd") -> None:
    """Each row's value (a number or array) as one more row of the table at ``path``."""
    df.write.mode("append").option("compression", compression).parquet(path)


def extend_values(df: DataFrame, path: str, names: list[str], compression: str = "zstd") -> None:
    """The elements of the arrays ``names``, which go together, as further rows of the table at ``path``."""
    zipped = df.select(F.explode(F.arrays_zip(*names)).alias("r"))
    zipped.select(*(F.col("r").getField(n).alias(n) for n in names)).write.mode("append").option("compression", compression).parquet(path)
