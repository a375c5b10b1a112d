"""Camera listings (``.lst``) with their collages: each record's crop of a shared image.

Line 1 is the version, line 2 ``num-fields|N``, then N lines ``name|type``, then the records. ``read_listing_lines`` gives the lines of files as
``split_records`` takes them; a listing of another version is an error there.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seston.operators.bad_records import split_records
from seston.operators.images import extract_roi
from seston.runtime import table_bytes, BROADCAST_LIMIT

#: The version of the format, and the ending of a collage's binary mask. Fixed values.
VERSION, MASK_SUFFIX = "017", "_bin"


def read_listing_lines(spark: SparkSession, path: str, *, check_version: bool = True) -> DataFrame:
    """lst_name (the path), line_no from 1 and line_text of every line of the files; each file is one task's work."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("lst_name"), F.regexp_replace("value", "\r\n?", "\n").alias("t"))
    if check_version:
        wrong = F.raise_error(F.concat(F.lit(f"not version {VERSION}: "), F.col("lst_name")))
        ok = F.trim(F.substring_index("t", "\n", 1)) == VERSION
        files = files.select("lst_name", F.when(ok, F.col("t")).otherwise(wrong.cast("string")).alias("t"))
    lines = files.select("lst_name", F.posexplode(F.split(F.regexp_replace("t", "\n$", ""), "\n")).alias("at", "line_text"))
    return lines.select("lst_name", (F.col("at") + 1).cast("int").alias("line_no"), "line_text")


def mask_name(collage: Column) -> Column:
    """``<base>_bin<ending>`` of a collage's name."""
    return F.regexp_replace(collage, r"^(.*?)(\.[^./]*)?$", f"$1{MASK_SUFFIX}$2")


def crop_box(fields: Column) -> Column:
    """The place of a record within its collage."""
    x, y, w, h = (F.try_element_at(fields, F.lit(f"{n}|int32")).cast("int") for n in ("image_x", "image_y", "image_w", "image_h"))
    return F.struct(y.alias("r0"), x.alias("c0"), (y + h).alias("r1"), (x + w).alias("c1"))


def field(fields: Column, name: str) -> Column:
    """A field of a record by name, as text; one that the header doesn't have is an error."""
    found = F.map_values(F.map_filter(fields, lambda k, _: F.substring_index(k, "|", 1) == name))
    return F.when(F.size(found) > 0, F.get(found, F.lit(0))).otherwise(F.raise_error(F.lit(f"no field {name}")).cast("string"))


def read_listing_objects(lines: DataFrame, collages: DataFrame) -> DataFrame:
    """The valid records with ``image`` and ``mask``, their crops of the collage and of its mask.

    ``collages`` has lst_name, name and image (a raster). A collage belongs to its listing, is decoded once, and joined by name; small
    sets are broadcast, others shuffled. A record whose collage is missing has null images.
    """
    parsed = split_records(lines).filter("reason IS NULL")
    box = crop_box(F.col("fields"))
    out = parsed.withColumn("box", box).withColumn("__mask", mask_name(F.col("collage_file")))
    own = collages.select(F.col("lst_name").alias("__l"), F.col("name").alias("__n"), F.col("image").alias("__i"))

    def joined(df: DataFrame, by: str, name: str) -> DataFrame:
        side = F.broadcast(own) if table_bytes(own) * 16 <= BROADCAST_LIMIT else own
        on = (F.col("lst_name") == F.col("__l")) & (F.lower(by) == F.lower("__n"))
        return df.join(side, on, "left").withColumn(name, extract_roi(F.col("__i"), F.col("box"))).drop("__l", "__n", "__i")

    return joined(joined(out, "collage_file", "image"), "__mask", "mask").drop("__mask")


def box_slices(box: dict) -> tuple[slice, slice]:
    """A box as slices of an array."""
    return np.s_[box["r0"] : box["r1"], box["c0"] : box["c1"]]
