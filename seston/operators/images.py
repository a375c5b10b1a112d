"""Operators on images in columns.

A raster is ``struct<height: int, width: int, channels: int, data: array<number>>``, its values row by row, channels innermost. What works pixel
by pixel is a built-in expression on ``data``; segmentation, drawing and correction are NumPy kernels that get Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seston.functions import raster as R

#: Luminance of red, green and blue. Fixed values.
LUMINANCE = (0.2125, 0.7154, 0.0721)
#: Range of the integer types that images come in. Fixed values.
RANGES = {"uint8": (0.0, 255.0), "int8": (-128.0, 127.0), "uint16": (0.0, 65535.0), "int16": (-32768.0, 32767.0), "float": (0.0, 1.0), "double": (0.0, 1.0), "bool": (0.0, 1.0)}
#: Spark types that hold the values of image types.
HOLDS = {"uint8": "short", "int8": "tinyint", "uint16": "int", "int16": "short", "float": "float", "double": "double", "bool": "boolean"}


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


def raster_type(element: str = "double") -> T.StructType:
    kinds = {"double": T.DoubleType(), "float": T.FloatType(), "int": T.IntegerType(), "short": T.ShortType(), "boolean": T.BooleanType()}
    return _struct(height=T.IntegerType(), width=T.IntegerType(), channels=T.IntegerType(), data=T.ArrayType(kinds[element]))


def as_raster(data: Column | str, width: int, channels: int = 1) -> Column:
    """A flat array as a raster of this width."""
    data = F.col(data) if isinstance(data, str) else data
    height = F.floor(F.size(data) / (width * channels)).cast("int")
    return F.struct(height.alias("height"), F.lit(width).alias("width"), F.lit(channels).alias("channels"), data.alias("data"))


def _with(image: Column, data: Column, channels: Column | None = None, height: Column | None = None, width: Column | None = None) -> Column:
    """``image`` with other data; a null image stays null."""
    made = F.struct((image["height"] if height is None else height).cast("int").alias("height"), (image["width"] if width is None else width).cast("int").alias("width"), (image["channels"] if channels is None else channels).cast("int").alias("channels"), data.alias("data"))
    return F.when(image.isNotNull(), made)


def _require(image: Column, channels: int | None, what: str) -> Column:
    wrong = image["channels"] != 1 if channels is None else image["channels"] != channels
    kind = f"{what} of an image with other channels"
    return F.when(wrong, F.raise_error(F.lit(kind)).cast("boolean")).otherwise(F.lit(True))


def threshold(image: Column, value: Any) -> Column:
    """The mask of values below ``value`` (a number or column); only of one channel."""
    limit = value if isinstance(value, Column) else F.lit(value)
    return F.when(_require(image, None, "threshold"), _with(image, F.transform(image["data"], lambda x: x < limit)))


def rescale_intensity(image: Column, in_range: tuple[float, float] | str = "image", dtype: str = "double") -> Column:
    """``in_range`` (the image's least and greatest value, those of a type by name, or two numbers) mapped linearly to the range of ``dtype``; values beyond are cut.

    An image of one value gives the low end of the range if the value is there, as 0 / 0 has no better.
    """
    low, high = RANGES[dtype]
    if in_range == "image":
        ends = F.struct(F.array_min(image["data"]).cast("double").alias("a"), F.array_max(image["data"]).cast("double").alias("b"))
    else:
        a, b = map(float, RANGES[in_range] if isinstance(in_range, str) else in_range)
        ends = F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"))

    def scaled(x: Column, r: Column) -> Column:
        span = r["b"] - r["a"]
        part = F.when(span == 0, F.lit(0.0)).otherwise((F.least(F.greatest(x.cast("double"), r["a"]), r["b"]) - r["a"]) / F.when(span == 0, F.lit(1.0)).otherwise(span))
        return (part * (high - low) + low).cast(HOLDS[dtype])

    # the range is bound once, as an element of a list of one, not found anew for each pixel
    data = F.get(F.transform(F.array(ends), lambda r: F.transform(image["data"], lambda x: scaled(x, r))), F.lit(0))
    return _with(image, data)


def gray_to_rgb(image: Column) -> Column:
    """The one channel three times."""
    return F.when(_require(image, None, "gray_to_rgb"), _with(image, F.flatten(F.transform(image["data"], lambda x: F.array_repeat(x, 3))), channels=F.lit(3)))


def rgb_to_gray(image: Column, dtype: str | None = None) -> Column:
    """Luminance as double, or with ``dtype`` of that type again (cut off below the point)."""
    n = image["height"] * image["width"]
    at = F.sequence(F.lit(0), n - 1)
    data = image["data"]

    def luminance(i: Column) -> Column:
        out = sum((F.get(data, i * 3 + k).cast("double") * w for k, w in enumerate(LUMINANCE)), F.lit(0.0))
        return out.cast(HOLDS[dtype]) if dtype else out

    made = F.when(n > 0, F.transform(at, luminance)).otherwise(F.array().cast(f"array<{HOLDS[dtype] if dtype else 'double'}>"))
    return F.when(_require(image, 3, "rgb_to_gray"), _with(image, made, channels=F.lit(1)))


def extract_roi(image: Column, box: Column, mask: Column | None = None, alpha: float = 0.0, background: float = 0.0) -> Column:
    """The part of ``image`` within ``box`` (struct r0, c0, r1, c1, ends beyond the border are cut); with ``alpha``, pixels outside the box's ``mask`` are blended with ``background``."""
    c = image["channels"]
    r0, c0 = F.greatest(box["r0"], F.lit(0)), F.greatest(box["c0"], F.lit(0))
    height, width = F.greatest(F.least(box["r1"], image["height"]) - r0, F.lit(0)), F.greatest(F.least(box["c1"], image["width"]) - c0, F.lit(0))
    rows = F.when(height > 0, F.sequence(r0, r0 + height - 1)).otherwise(F.array().cast("array<int>"))
    data = F.flatten(F.transform(rows, lambda r: F.slice(image["data"], ((r * image["width"] + c0) * c + 1).cast("int"), (width * c).cast("int"))))
    if alpha:
        if mask is None:
            raise ValueError("blending needs the mask of the region")
        data = F.transform(data, lambda x, i: F.when(F.get(mask["data"], F.floor(i / c).cast("int")), x.cast("double")).otherwise(F.lit(alpha * background) + F.lit(1 - alpha) * x))
    return _with(image, data, height=height, width=width)


def image_stats(df: DataFrame, image: str = "image") -> DataFrame:
    """One row: least and greatest value of all images, and the means of the images' least and greatest values. Images without pixels don't count."""
    part = df.select(F.array_min(F.col(image)["data"]).cast("double").alias("a"), F.array_max(F.col(image)["data"]).cast("double").alias("b"))
    return part.agg(F.min("a").alias("min"), F.max("b").alias("max"), F.avg("a").alias("mean_min"), F.avg("b").alias("mean_max"))


# ---- kernels


def to_array(image: dict | None) -> np.ndarray | None:
    """A raster's values as an array (height, width) or (height, width, channels)."""
    if image is None:
        return None
    h, w, c = image["height"], image["width"], image["channels"]
    values = np.asarray(image["data"])
    return values.reshape((h, w) if c == 1 else (h, w, c))


def from_array(a: np.ndarray) -> dict:
    return {"height": a.shape[0], "width": a.shape[1], "channels": 1 if a.ndim == 2 else a.shape[2], "data": a.reshape(-1)}


def _rasters(column: pa.Array) -> Iterator[np.ndarray | None]:
    """The images of a column as views of one buffer."""
    h, w, c = (column.field(k).to_numpy(zero_copy_only=False) for k in ("height", "width", "channels"))
    lists = column.field("data")
    ends, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    null = np.asarray(column.is_null())
    for i in range(len(column)):
        if null[i]:
            yield None
        else:
            a = values[ends[i] : ends[i + 1]]
            yield a.reshape((int(h[i]), int(w[i])) if c[i] == 1 else (int(h[i]), int(w[i]), int(c[i])))


def _pack(images: list[np.ndarray | None], element: pa.DataType) -> pa.Array:
    there = [a is not None for a in images]
    flat = [np.zeros(0) if a is None else np.asarray(a).reshape(-1) for a in images]
    ends = np.r_[0, np.cumsum([len(f) for f in flat])].astype(np.int32)
    values = pa.array(np.concatenate(flat) if flat else np.zeros(0)).cast(element, safe=False)
    shape = [(0, 0, 0) if a is None else (a.shape[0], a.shape[1], 1 if a.ndim == 2 else a.shape[2]) for a in images]
    fields = [pa.array([s[k] for s in shape], pa.int32()) for k in range(3)]
    data = pa.ListArray.from_arrays(pa.array(ends), values)
    kind = pa.struct([("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("data", pa.list_(element))])
    return pa.StructArray.from_arrays([*fields, data], fields=list(kind), mask=pa.array([not t for t in there], pa.bool_()))


def map_images(df: DataFrame, kernel: Callable[..., np.ndarray], inputs: list[str], name: str, element: str = "double") -> DataFrame:
    """A column of images that ``kernel`` makes of the row's ``inputs`` (images as arrays, other values as they are); null if an input is."""
    schema = T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, raster_type(element))])
    arrow = {"double": pa.float64(), "float": pa.float32(), "short": pa.int16(), "int": pa.int32(), "boolean": pa.bool_()}[element]
    keep = [c for c in df.columns if c != name]

    def run(batches):
        for batch in batches:
            columns = []
            for c in inputs:
                column = batch.column(c)
                columns.append(list(_rasters(column)) if pa.types.is_struct(column.type) and column.type.get_field_index("data") >= 0 else column.to_pylist())
            made = [None if any(x is None for x in row) else np.asarray(kernel(*row)) for row in zip(*columns)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), _pack(made, arrow)], names=schema.names)

    return df.mapInArrow(run, schema)


def draw_contours(df: DataFrame, image: str, mask: str, color: tuple[float, ...] = (255, 0, 0), dilate_rel: float = 0.0, dilate_abs: float = 0.0, name: str = "drawn") -> DataFrame:
    """The image in colour with the outline of the mask, grown by a disk of ``dilate_rel * sqrt(area) + dilate_abs``, painted over."""

    def kernel(a: np.ndarray, m: np.ndarray) -> np.ndarray:
        m = np.asarray(m, bool)
        return _painted(a, R.outline(_grown(m, dilate_rel, dilate_abs)), color)

    return map_images(df, kernel, [image, mask], name)


def _grown(mask: np.ndarray, rel: float, absolute: float) -> np.ndarray:
    radius = rel * np.sqrt(mask.sum()) + absolute
    return R.dilate(mask, radius) if radius >= 1 else mask


def _painted(image: np.ndarray, where: np.ndarray, color: tuple[float, ...]) -> np.ndarray:
    out = np.array(np.repeat(image[:, :, None], 3, 2) if image.ndim == 2 else image[:, :, :3], float)
    out[where] = color[:3]
    return out


def draw_contours_on_parent(parents: DataFrame, children: DataFrame, on: str, image: str = "image", color: tuple[float, ...] = (255, 0, 0), dilate_rel: float = 0.0, dilate_abs: float = 0.0, name: str = "drawn") -> DataFrame:
    """Each parent image with the outlines of all its children (``box`` and ``mask`` of ``find_regions``) painted over; a parent without any is only coloured.

    Children's masks are gathered per image: as many pixels at most as the image has, times how often regions overlap.
    """
    grouped = children.groupBy(F.col(on).alias("__on")).agg(F.collect_list(F.struct("box", "mask")).alias("__children"))
    joined = parents.join(grouped, F.col(on) == F.col("__on"), "left").drop("__on").withColumn("__children", F.coalesce("__children", F.array().cast(grouped.schema["__children"].dataType)))

    def kernel(a: np.ndarray, kids: list[dict]) -> np.ndarray:
        where = np.zeros(a.shape[:2], bool)
        for kid in kids:
            m, box = to_array(kid["mask"]), kid["box"]
            whole = np.zeros(a.shape[:2], bool)
            whole[box["r0"] : box["r0"] + m.shape[0], box["c0"] : box["c0"] + m.shape[1]] = m
            where |= R.outline(_grown(whole, dilate_rel, dilate_abs))
        return _painted(a, where, color)

    return map_images(joined, kernel, [image, "__children"], name).drop("__children")


def flat_image(image: np.ndarray) -> np.ndarray:
    """The illumination of an image with bright background: dark objects are cut out, the background is carried on over them and smoothed."""
    smooth = R.gaussian(np.asarray(image, float), 3)
    valid = R.erode(smooth > R.otsu(smooth), 16)
    grown = R.grey_dilate(smooth, 16)
    if not valid.any():
        return R.gaussian(grown, 64)
    h, w = grown.shape
    filled = grown.copy()
    known = np.where(valid, grown, np.nan)
    x = np.arange(w)
    across = np.full((h, w), np.nan)
    for y in range(h):
        at = np.flatnonzero(valid[y])
        if len(at):
            across[y] = np.interp(x, at, known[y, at])
    rows = np.flatnonzero(~np.isnan(across).all(1))
    for c in range(w):
        across[:, c] = np.interp(np.arange(h), rows, across[rows, c])
    filled[~valid] = across[~valid]
    return R.gaussian(filled, 64)


def correct_vignetting(df: DataFrame, image: str, name: str = "corrected") -> DataFrame:
    """The image divided by its illumination; of a colour image by that of its first channel."""

    def kernel(a: np.ndarray) -> np.ndarray:
        flat = flat_image(a if a.ndim == 2 else a[:, :, 0])
        flat = np.where(flat == 0, 1.0, flat)
        return a / (flat if a.ndim == 2 else flat[:, :, None])

    return map_images(df, kernel, [image], name)


#: Height of the canvas of a scale bar. Fixed value.
SCALEBAR_HEIGHT = 32


def scalebar(length: float, px_per_unit: float, margin: int = 10, fg: float = 255.0, bg: float = 0.0, height: int = SCALEBAR_HEIGHT) -> np.ndarray:
    """A bar of ``length`` units with a tick at each end, on a ground of ``height`` pixels. No lettering: the unit goes with the column's name."""
    n = int(round(length * px_per_unit))
    out = np.full((height, n + 2 * margin), float(bg))
    y = height - height // 4
    out[y - 1 : y + 1, margin : margin + n] = fg
    for x in (margin, margin + n - 1):
        out[y - height // 8 : y + height // 8, max(x, 0) : x + 1] = fg
    return out


def draw_scalebar(df: DataFrame, image: str, length: float, px_per_unit: float, margin: int = 10, fg: float = 255.0, bg: float = 0.0, name: str = "drawn") -> DataFrame:
    """The image in the middle of a canvas, with the bar below it at the left."""
    bar = scalebar(length, px_per_unit, margin, fg, bg)

    def kernel(a: np.ndarray) -> np.ndarray:
        h, w = a.shape[:2]
        width = max(w, bar.shape[1])
        out = np.full((h + bar.shape[0], width, *a.shape[2:]), float(bg))
        x = (width - w) // 2
        out[:h, x : x + w] = a
        out[h:, : bar.shape[1]] = bar if a.ndim == 2 else bar[:, :, None]
        return out

    return map_images(df, kernel, [image], name)


REGION = _struct(
    label=T.IntegerType(), box=_struct(r0=T.IntegerType(), c0=T.IntegerType(), r1=T.IntegerType(), c1=T.IntegerType()), area=T.DoubleType(), mask=raster_type("boolean"), intensity=raster_type(),
    measures=T.MapType(T.StringType(), T.DoubleType()),
)


def find_regions(df: DataFrame, mask: str, image: str | None = None, *, min_area: float | None = None, max_area: float | None = None, padding: int = 0, pixels: bool = True, features: bool = True, warn_empty: str | None = None) -> DataFrame:
    """A row for each connected region (corners connect) of the row's mask: label, box, area, measures, and with ``pixels`` its cut-out mask and intensity.

    An image without regions gives no row; with ``warn_empty`` (a column that names the image, or "" for none) it is warned of in the
    worker's log.
    """
    from seston.functions.raster import measures, regions

    keep = [c for c in df.columns if c not in REGION.names]
    schema = T.StructType([df.schema[c] for c in keep] + list(REGION.fields))

    def run(batches):
        import warnings

        for batch in batches:
            masks = list(_rasters(batch.column(mask)))
            images = list(_rasters(batch.column(image))) if image else [None] * len(masks)
            names = batch.column(warn_empty).to_pylist() if warn_empty else [None] * len(masks)
            source, labels, boxes, areas, cut, lit, kinds = [], [], [], [], [], [], []
            for i, (m, a) in enumerate(zip(masks, images)):
                before = len(source)
                for k, box, inside, light in regions(m, a, min_area, max_area, padding) if m is not None else ():
                    source.append(i)
                    labels.append(k)
                    boxes.append(dict(zip(("r0", "c0", "r1", "c1"), box)))
                    areas.append(float(inside.sum()))
                    cut.append(inside if pixels else None)
                    lit.append(light if pixels else None)
                    kinds.append([(n, v) for n, v in measures(inside, light, box[0], box[1]).items()] if features else [])
                if before == len(source) and warn_empty is not None:
                    warnings.warn(f"{names[i] or 'Image'} did not contain any objects.", stacklevel=1)
            rest = [batch.column(c).take(pa.array(source, pa.int64())) for c in keep]
            box = pa.array(boxes, pa.struct([(n, pa.int32()) for n in ("r0", "c0", "r1", "c1")]))
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(labels, pa.int32()), box, pa.array(areas, pa.float64()), _pack(cut, pa.bool_()), _pack(lit, pa.float64()), pa.array(kinds, pa.map_(pa.string(), pa.float64()))],
                names=schema.names,
            )

    return df.mapInArrow(run, schema)


def image_properties(df: DataFrame, mask: str, image: str | None = None) -> DataFrame:
    """The measures of all true pixels of the mask as one region, with the whole frame as its box; an empty mask gives null."""
    from seston.functions.raster import measures

    schema = T.StructType([f for f in df.schema.fields if f.name != "measures"] + [T.StructField("measures", T.MapType(T.StringType(), T.DoubleType()))])

    def run(batches):
        for batch in batches:
            masks = list(_rasters(batch.column(mask)))
            images = list(_rasters(batch.column(image))) if image else [None] * len(masks)
            made = [None if m is None or not m.any() else list(measures(m, a).items()) for m, a in zip(masks, images)]
            keep = [batch.column(c) for c in batch.schema.names if c != "measures"]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(made, pa.map_(pa.string(), pa.float64()))], names=schema.names)

    return df.mapInArrow(run, schema)


def decode_png(data: Column) -> Column:
    """The raster of an encoded image; null of null, of no bytes and of what isn't a PNG."""
    from seston.functions import png

    @F.pandas_udf(raster_type("int"))
    def run(parts: pd.Series) -> pd.DataFrame:
        rows = []
        for p in parts:
            try:
                a = png.decode(bytes(p)) if p is not None and len(p) else None
            except Exception:  # broken data of any kind
                a = None
            rows.append((None, None, None, None) if a is None else (a.shape[0], a.shape[1], 1 if a.ndim == 2 else a.shape[2], a.reshape(-1).astype(np.int32)))
        return pd.DataFrame(rows, columns=["height", "width", "channels", "data"])

    made = run(data)
    return F.when(made["height"].isNotNull(), made)


def encode_png(image: Column) -> Column:
    """The raster as a PNG of 8 bits; values are cut to 0 .. 255."""
    from seston.functions import png

    @F.pandas_udf("binary")
    def run(rows: pd.DataFrame) -> pd.Series:
        out = []
        for r in rows.itertuples(index=False):
            out.append(None if r.data is None else png.encode(np.clip(np.asarray(r.data, float), 0, 255).astype(np.uint8).reshape(int(r.height), int(r.width), int(r.channels))))
        return pd.Series(out, dtype=object)

    return run(image)
