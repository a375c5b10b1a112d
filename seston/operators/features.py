"""The feature table of regions: the names under which an image-analysis tool writes them, as expressions over the measures of ``find_regions``."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    """Null where the divisor is 0: a single pixel or a straight line has no minor axis and no perimeter."""
    return F.when(b != 0, a / F.when(b != 0, b))


def region_features(label: Column, box: Column, measures: Column) -> dict[str, Column]:
    """The features by name. Their names, with dots and signs, are fixed values."""
    m = {k: measures[k] for k in ("area", "filled_area", "bbox_area", "convex_area", "centroid_row", "centroid_col", "local_centroid_row", "local_centroid_col", "major", "minor", "eccentricity", "orientation", "perimeter", "euler_number", "equivalent_diameter", "extent", "solidity", "min", "max", "mean")}
    square = m["perimeter"] * m["perimeter"]
    return {
        "label": label,
        "width": box["c1"] - box["c0"],
        "height": box["r1"] - box["r0"],
        "bx": box["c0"],
        "by": box["r0"],
        "circ.": _ratio(4 * math.pi * m["filled_area"], square),
        "area_exc": m["area"],
        "area": m["filled_area"],
        "%area": 1 - _ratio(m["area"], m["filled_area"]),
        "major": m["major"],
        "minor": m["minor"],
        "y": m["centroid_row"],
        "x": m["centroid_col"],
        "convex_area": m["convex_area"],
        "min": m["min"],
        "max": m["max"],
        "mean": m["mean"],
        "intden": m["filled_area"] * m["mean"],
        "perim.": m["perimeter"],
        "elongation": _ratio(m["major"], m["minor"]),
        "range": m["max"] - m["min"],
        "perimareaexc": _ratio(m["perimeter"], m["area"]),
        "perimmajor": _ratio(m["perimeter"], m["major"]),
        "circex": _ratio(4 * math.pi * m["area"], square),
        "angle": m["orientation"] / math.pi * 180 + 90,
        "bounding_box_area": m["bbox_area"],
        "eccentricity": m["eccentricity"],
        "equivalent_diameter": m["equivalent_diameter"],
        "euler_number": m["euler_number"],
        "extent": m["extent"],
        "local_centroid_col": m["local_centroid_col"],
        "local_centroid_row": m["local_centroid_row"],
        "solidity": m["solidity"],
    }


def calculate_features(regions: DataFrame, meta: str | None = None, prefix: str = "", name: str = "features") -> DataFrame:
    """A map of feature name (with ``prefix``) to value, merged over the map ``meta`` if one is named: of a name in both the feature holds."""
    made = region_features(F.col("label"), F.col("box"), F.col("measures"))
    features = F.create_map(*(x for k, v in made.items() for x in (F.lit(prefix + k), v.cast("double"))))
    if meta is not None:
        values = F.transform_values(features, lambda _, v: v.cast("string"))
        keep = F.map_filter(F.coalesce(F.col(meta), F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(features, k))
        features = F.map_concat(keep, values)
    return regions.withColumn(name, features)


def feature_columns(regions: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and every feature as a column of its own."""
    made = region_features(F.col("label"), F.col("box"), F.col("measures"))
    return regions.select(*keep, *(v.alias(k) for k, v in made.items() if k not in keep))
