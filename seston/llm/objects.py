"""The objects of a feature table: the row that counts of each, with usable measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(name: str) -> Column:
    """A measurement counts if it is not null, finite and above 0."""
    return F.col(name).isNotNull() & ~F.isnan(name) & (F.col(name) > 0) & (F.col(name) < float("inf"))


def current_objects(features: DataFrame, measures: list[str], *keep: str, id_col: str = "roi_id", at: str = "processed_at") -> DataFrame:
    """(id, keep, measures) of the row with the latest ``at`` of each id, if all its measures are usable.

    Of rows with the same time and other values, the greatest counts. Rows without id are left out.
    """
    row = F.max(F.struct(at, *measures, *keep)).alias("r")
    last = features.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(row).select(id_col, *(f"r.{c}" for c in (*keep, *measures)))
    for c in measures:
        last = last.filter(usable(c))
    return last
