"""The operators as steps of a pipeline. Each takes Variables or plain values and returns Variables."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seston.functions import expressions as X
from seston.functions import text as texts
from seston.operators import features, images, joins, models, recursive, windows
from seston.operators import order as O
from seston.operators import stream as S
from seston.plans.pipeline import ORDER, Call, Variable, _there, resolve, step

#: Columns that are no Variables.
_KEPT = (ORDER, "__ords")


def Unpack(collection: Any) -> Variable:
    """A row for each element, within the row at hand."""

    def run(df: DataFrame, out: str) -> DataFrame:
        src = resolve(df, collection) if isinstance(collection, Variable) else collection if isinstance(collection, str) is False else list(collection)
        made = S.unpack_rows(df, src, out, "__place")
        return made.withColumn(ORDER, F.concat(ORDER, F.array(F.col("__place").cast("long")))).drop("__place")

    return step("Unpack", run, ["value"], [collection])


def Filter(predicate: Variable | Callable[[DataFrame], Column]) -> None:
    step("Filter", lambda df: S.filter_rows(df, resolve(df, predicate) if isinstance(predicate, Variable) else predicate), [], [predicate])


def FilterVariables(*keep: Variable) -> None:
    step("FilterVariables", lambda df: S.keep_columns(df, *(c for c in _KEPT if c in df.columns), *(_there(df, v) for v in keep)), [], list(keep))


def Slice(*args: int | None) -> None:
    step("Slice", lambda df: O.slice_rows(df, ORDER, *args))


def Enumerate(start: int = 0) -> Variable:
    return step("Enumerate", lambda df, out: O.enumerate_rows(df, ORDER, start, out), ["index"])


def RemainingHint() -> Variable:
    return step("RemainingHint", lambda df, out: O.remaining_hint(df, ORDER, out), ["remaining"])


def Pack(size: int, *values: Variable) -> Any:
    """``size`` consecutive rows in one; the packed Variables become new array Variables."""

    def run(df: DataFrame, *outs: str) -> DataFrame:
        src = df.select("*", *(F.col(f"`{_there(df, v)}`").alias(o) for v, o in zip(values, outs)))
        return S.pack_rows(src, size, list(outs), ORDER)

    return step("Pack", run, [v.name for v in values], list(values))


def StreamBuffer(maxsize: int) -> None:
    """Spark reads ahead by itself: the plan stays as it is."""
    step("StreamBuffer", lambda df: df)


def Format(fmt: Any, *args: Any, _args: Any = (), _kwargs: dict | None = None, **kwargs: Any) -> Variable:
    def run(df: DataFrame, out: str) -> DataFrame:
        made = texts.format_text(df, resolve(df, fmt), *resolve(df, list(args)), _args=resolve(df, list(_args)), _kwargs=resolve(df, _kwargs or {}), **resolve(df, kwargs))
        return df.withColumn(out, made)

    return step("Format", run, ["text"], [fmt, *args, *_args, *(_kwargs or {}).values(), *kwargs.values()])


def Parse(fmt: Any, string: Variable, case_sensitive: bool = False, names: dict[str, str] | None = None) -> Variable:
    return step("Parse", lambda df, out: df.withColumn(out, texts.parse_text(df, resolve(df, fmt), X.typed(df, resolve(df, string)).col, case_sensitive, names=names)), ["fields"], [fmt, string])


def _sliding(label: str, fn: Callable) -> Callable:
    def make(value: Variable, size: int = 5, centered: bool = True) -> Variable:
        windows._check(size, centered)
        return step(label, lambda df, out: fn(df, _there(df, value), size, centered, order=ORDER, name=out), ["response"], [value])

    make.__name__ = label
    return make


MaxFilter, MinFilter = _sliding("MaxFilter", windows.max_filter), _sliding("MinFilter", windows.min_filter)
MedianFilter, MeanFilter = _sliding("MedianFilter", windows.median_filter), _sliding("MeanFilter", windows.mean_filter)
BinomialFilter = _sliding("BinomialFilter", windows.binomial_filter)


def WindowFilter(agg: Callable[[Column], Column], value: Variable, size: int = 5, centered: bool = True) -> Variable:
    return step("WindowFilter", lambda df, out: windows.window_filter(df, agg, _there(df, value), size, centered, order=ORDER, name=out), ["response"], [value])


def ExponentialSmoothingFilter(value: Variable, alpha: float) -> Variable:
    return step("ExponentialSmoothingFilter", lambda df, out: recursive.exponential_smoothing(df, _there(df, value), alpha, order=ORDER, name=out), ["response"], [value])


ExponentialSmoothing = ExponentialSmoothingFilter


def RunningMedian(value: Variable, n_init: int = 10) -> Variable:
    return step("RunningMedian", lambda df, out: recursive.running_median(df, _there(df, value), n_init, order=ORDER, name=out), ["response"], [value])


def JoinMetadata(table: DataFrame | str, on: Variable, key: str, fields: list[str]) -> Any:
    """The fields of the row of ``table`` (a DataFrame or the path of a file with a header) whose ``key`` equals ``on``."""

    def run(df: DataFrame, *outs: str) -> DataFrame:
        from seston.sources.tables import read_table

        right = read_table(df.sparkSession, table) if isinstance(table, str) else table
        side = right.select(F.col(key).alias(on.column), *(F.col(f).alias(o) for f, o in zip(fields, outs)))
        return joins.lookup_join(df, side, _there(df, on))

    return step("JoinMetadata", run, list(fields), [on])


def _image(label: str, fn: Callable[..., Column]) -> Callable:
    def make(image: Variable, *args: Any, **kwargs: Any) -> Variable:
        return step(label, lambda df, out: df.withColumn(out, fn(resolve(df, image), *resolve(df, list(args)), **resolve(df, kwargs))), ["image"], [image, *args, *kwargs.values()])

    make.__name__ = label
    return make


ThresholdConst, RescaleIntensity = _image("ThresholdConst", images.threshold), _image("RescaleIntensity", images.rescale_intensity)
Gray2RGB, RGB2Gray = _image("Gray2RGB", images.gray_to_rgb), _image("RGB2Gray", images.rgb_to_gray)
ExtractROI = _image("ExtractROI", lambda image, region, alpha=0.0, bg_color=0.0: images.extract_roi(image, region["box"], region["mask"], alpha, bg_color))


def ImageReader(path: Variable) -> Variable:
    """The decoded image of each row's file, read where the row is."""
    from seston.sources.files import read_bytes

    return step("ImageReader", lambda df, out: df.withColumn(out, images.decode_png(read_bytes(resolve(df, path)))), ["image"], [path])


def ImageWriter(path: Variable, image: Variable) -> None:
    """Encode and write each row's image. The files are written when the plan runs."""
    from seston.sources.files import write_bytes

    step("ImageWriter", lambda df: df.withColumn("__written", write_bytes(resolve(df, path), images.encode_png(resolve(df, image)))).filter("__written >= 0").drop("__written"), [], [path, image])


def FindRegions(mask: Variable, image: Variable | None = None, min_area: float | None = None, max_area: float | None = None, padding: int = 0, warn_empty: Any = False) -> Variable:
    def run(df: DataFrame, out: str) -> DataFrame:
        name = None if warn_empty is False else "__name"
        src = df.withColumn("__name", X.typed(df, resolve(df, warn_empty)).col.cast("string")) if name else df
        made = images.find_regions(src, _there(df, mask), None if image is None else _there(df, image), min_area=min_area, max_area=max_area, padding=padding, warn_empty=name)
        region = F.struct(*images.REGION.names)
        return made.withColumn(out, region).withColumn(ORDER, F.concat(ORDER, F.array(F.col("label").cast("long")))).drop(*images.REGION.names, "__name")

    return step("FindRegions", run, ["region"], [mask, image])


def ImageProperties(mask: Variable, image: Variable | None = None) -> Variable:
    return step("ImageProperties", lambda df, out: images.image_properties(df, _there(df, mask), None if image is None else _there(df, image)).withColumnRenamed("measures", out), ["measures"], [mask, image])


def CalculateFeatures(region: Variable, meta: Variable | None = None, prefix: str = "") -> Variable:
    def run(df: DataFrame, out: str) -> DataFrame:
        src = df.select("*", *(F.col(_there(df, region)).getField(c).alias(c) for c in ("label", "box", "measures")))
        return features.calculate_features(src, None if meta is None else _there(df, meta), prefix, out).drop("label", "box", "measures")

    return step("CalculateFeatures", run, ["features"], [region, meta])


def _kernel(label: str, fn: Callable[..., DataFrame], n: int) -> Callable:
    def make(*args: Any, **kwargs: Any) -> Variable:
        return step(label, lambda df, out: fn(df, *(_there(df, a) for a in args[:n]), *args[n:], **kwargs, name=out), ["image"], list(args[:n]))

    make.__name__ = label
    return make


DrawContours = _kernel("DrawContours", images.draw_contours, 2)
VignettingCorrector = _kernel("VignettingCorrector", images.correct_vignetting, 1)
DrawScalebar = _kernel("DrawScalebar", images.draw_scalebar, 1)


def Predict(make: Callable, value: Variable, **kwargs: Any) -> Variable:
    """A model on each row's value, in batches."""
    return step("Predict", lambda df, out: models.predict(df, make, _there(df, value), name=out, **kwargs), ["prediction"], [value])


def Find(root: Any, extensions: list[str], sort: bool = False) -> Variable:
    from seston.sources.files import find_files

    def run(df: DataFrame, out: str) -> DataFrame:
        made = S.unpack_rows(df, find_files(X.typed(df, resolve(df, root)).col, extensions, sort), out, "__place")
        return made.withColumn(ORDER, F.concat(ORDER, F.array(F.col("__place").cast("long")))).drop("__place")

    return step("Find", run, ["path"], [root])


def Glob(pattern: Any, recursive: bool = False) -> Variable:
    from seston.sources.files import glob_files

    def run(df: DataFrame, out: str) -> DataFrame:
        made = S.unpack_rows(df, glob_files(X.typed(df, resolve(df, pattern)).col, recursive), out, "__place")
        return made.withColumn(ORDER, F.concat(ORDER, F.array(F.col("__place").cast("long")))).drop("__place")

    return step("Glob", run, ["path"], [pattern])


def TableWriter(path: str, values: dict[str, Variable], drop_duplicates: list[str] | None = None) -> None:
    """The named Variables as a CSV file with a header, written when the plan is applied."""
    from seston.sources.tables import write_csv

    def run(df: DataFrame) -> DataFrame:
        write_csv(df.select(ORDER, *(F.col(_there(df, v)).alias(n) for n, v in values.items())), path, ORDER, drop_duplicates)
        return df

    step("TableWriter", run, [], list(values.values()))


def PrintObjects(*values: Variable) -> None:
    step("PrintObjects", lambda df: (df.select(*(_there(df, v) for v in values)).show(truncate=False), df)[1], [], list(values))


__all__ = ["Call", *(n for n in dir() if n[0].isupper() and n not in ("Any", "Callable", "Column", "DataFrame", "F", "O", "ORDER", "S", "Variable", "X"))]
