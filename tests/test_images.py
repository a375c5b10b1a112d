"""Image kernels on shapes whose measures are known, and the operators that use them."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seston.functions import png
from seston.functions import raster as R
from seston.operators import features, images, models


def flood(mask):
    labels, n = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask)):
        if not labels[y, x]:
            n += 1
            todo = [(y, x)]
            while todo:
                a, b = todo.pop()
                if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not labels[a, b]:
                    labels[a, b] = n
                    todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return labels, n


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.integers(0, 2**32 - 1), st.floats(0.1, 0.9))
def test_label(h, w, seed, share):
    mask = np.random.default_rng(seed).random((h, w)) < share
    a, n = R.label(mask)
    b, m = flood(mask)
    assert n == m and (a == b).all()


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 12), st.integers(1, 12), st.integers(0, 2**32 - 1), st.floats(0, 5))
def test_dilate(h, w, seed, radius):
    mask = np.random.default_rng(seed).random((h, w)) < 0.2
    want = np.zeros_like(mask)
    for y, x in zip(*np.nonzero(mask)):
        for dy, dx in R.disk(radius):
            if 0 <= y + dy < h and 0 <= x + dx < w:
                want[y + dy, x + dx] = True
    assert (R.dilate(mask, radius) == want).all()


def test_measures_of_known_shapes():
    square = R.measures(np.ones((10, 10), bool), np.arange(100.0).reshape(10, 10), 3, 4)
    assert square["area"] == square["convex_area"] == square["filled_area"] == 100 and square["perimeter"] == 36 and square["solidity"] == square["extent"] == 1
    assert square["centroid_row"] == 7.5 and square["centroid_col"] == 8.5 and square["eccentricity"] == 0 and square["mean"] == 49.5
    assert square["major"] == pytest.approx(4 * np.sqrt(99 / 12)) and square["equivalent_diameter"] == pytest.approx(np.sqrt(400 / np.pi))
    ring = np.ones((5, 5), bool)
    ring[2, 2] = False
    made = R.measures(ring)
    assert made["area"] == 24 and made["filled_area"] == 25 and made["euler_number"] == 0
    y, x = np.mgrid[:41, :41]
    disk = R.measures((y - 20) ** 2 + (x - 20) ** 2 <= 400)
    assert disk["solidity"] > 0.95 and disk["eccentricity"] < 0.05 and disk["perimeter"] == pytest.approx(2 * np.pi * 20, rel=0.06)
    line = R.measures(np.ones((1, 7), bool))
    assert line["minor"] == 0 and line["eccentricity"] == 1 and line["major"] == pytest.approx(8.0)
    diagonal = R.measures(np.eye(9, dtype=bool))
    assert diagonal["area"] == 9 and diagonal["euler_number"] == 1 and abs(diagonal["orientation"]) == pytest.approx(np.pi / 4)
    assert R.measures(np.ones((1, 1), bool))["perimeter"] == 0


@pytest.mark.parametrize("shape", [(5, 7), (5, 7, 2), (5, 7, 3), (5, 7, 4), (1, 1)])
@pytest.mark.parametrize("kind", [np.uint8, np.uint16])
def test_png_roundtrip(shape, kind):
    a = np.random.default_rng(1).integers(0, np.iinfo(kind).max, shape).astype(kind)
    assert (png.decode(png.encode(a)) == a).all()
    with pytest.raises(ValueError):
        png.decode(b"no image")


def raster(a):
    a = np.asarray(a, float)
    return (a.shape[0], a.shape[1], 1 if a.ndim == 2 else a.shape[2], a.reshape(-1).tolist())


SCHEMA = "id int, image struct<height:int,width:int,channels:int,data:array<double>>"


def arrays(df, name):
    return [images.to_array(r[name].asDict() if r[name] else None) for r in df.orderBy("id").select(name).collect()]


def test_pixel_operators(spark):
    a = np.arange(12.0).reshape(3, 4)
    rgb = np.random.default_rng(0).random((3, 4, 3))
    df = spark.createDataFrame([(0, raster(a)), (1, raster(np.zeros((2, 2)))), (2, None)], SCHEMA)
    i = F.col("image")
    got = arrays(df.select("id", images.rescale_intensity(i, "image", "uint8").alias("r")), "r")
    assert (got[0] == (a / 11 * 255).astype(int)).all() and (got[1] == 0).all() and got[2] is None
    assert (arrays(df.select("id", images.rescale_intensity(i, (2, 6)).alias("r")), "r")[0] == (a.clip(2, 6) - 2) / 4).all()
    assert (arrays(df.select("id", images.threshold(i, 5).alias("r")), "r")[0] == (a < 5)).all()
    assert (arrays(df.select("id", images.gray_to_rgb(i).alias("r")), "r")[0] == a[:, :, None]).all()
    color = spark.createDataFrame([(0, raster(rgb))], SCHEMA)
    assert arrays(color.select("id", images.rgb_to_gray(i).alias("r")), "r")[0] == pytest.approx(rgb @ [0.2125, 0.7154, 0.0721])
    for bad in (images.threshold(i, 1), images.gray_to_rgb(i)):
        with pytest.raises(Exception):
            color.select(bad).collect()
    box = F.struct(F.lit(1).alias("r0"), F.lit(1).alias("c0"), F.lit(9).alias("r1"), F.lit(3).alias("c1"))
    roi = arrays(df.select("id", images.extract_roi(i, box).alias("r")), "r")
    assert (roi[0] == a[1:, 1:3]).all() and roi[1].shape == (1, 1) and roi[2] is None
    stats = images.image_stats(df).first()
    assert tuple(stats) == (0, 11, 0, 5.5)


def test_regions_padding_and_sizes(spark, capfd):
    m = np.zeros((8, 8))
    m[0, 0] = m[3:6, 3:6] = m[7, 7] = 1
    df = spark.createDataFrame([(0, raster(m)), (1, raster(np.zeros((4, 4)))), (2, None)], SCHEMA)
    df = df.withColumn("mask", images.threshold(images._with(F.col("image"), F.transform(F.col("image")["data"], lambda x: -x)), 0))
    found = images.find_regions(df, "mask", "image", min_area=2, padding=2).collect()
    assert [(r.label, r.area, tuple(r.box)) for r in found] == [(2, 9.0, (1, 1, 8, 8))]
    cut = images.to_array(found[0].mask.asDict())
    assert cut.shape == (7, 7) and cut.sum() == 9
    assert [r.label for r in images.find_regions(df, "mask", max_area=1).collect()] == [1, 3]
    whole = images.image_properties(df, "mask", "image").orderBy("id").collect()
    assert whole[0].measures["area"] == 11 and whole[1].measures is None
    table = features.calculate_features(images.find_regions(df, "mask", "image", min_area=2).withColumn("meta", F.create_map(F.lit("object_area"), F.lit("?"), F.lit("k"), F.lit("v"))), "meta", "object_").first().features
    assert len(table) == 34 and table["k"] == "v" and table["object_area"] == "9.0" and table["object_width"] == "3.0"
    single = features.feature_columns(images.find_regions(df, "mask", "image", max_area=1)).first().asDict()
    assert len(single) == 33 and single["elongation"] is None and single["circ."] is None and single["%area"] == 0


def test_drawing(spark):
    a, m = np.zeros((7, 7)), np.zeros((7, 7))
    m[3, 3] = 1
    df = spark.createDataFrame([(0, raster(a), raster(m))], SCHEMA + ", m struct<height:int,width:int,channels:int,data:array<double>>")
    for absolute, n in ((0, 8), (1, 16)):
        out = arrays(images.draw_contours(df, "image", "m", (9, 0, 0), dilate_abs=absolute), "drawn")[0]
        assert out.shape == (7, 7, 3) and (out[:, :, 0] == 9).sum() == n
    bar = arrays(images.draw_scalebar(df, "image", 2, 10, margin=3), "drawn")[0]
    assert bar.shape == (39, 26) and (bar[7:] == 255).any()
    y, x = np.mgrid[:90, :90]
    light = 200 - 0.01 * ((y - 45) ** 2 + (x - 45) ** 2)
    dark = light.copy()
    dark[40:44, 40:44] = 10
    fixed = arrays(images.correct_vignetting(spark.createDataFrame([(0, raster(dark))], SCHEMA), "image"), "corrected")[0]
    assert abs(fixed[60:80, 60:80].mean() - 1) < 0.15 and fixed[41, 41] < 0.1
    with pytest.raises(Exception):
        images.extract_roi(F.col("image"), F.col("box"), alpha=0.5)


def test_encode_and_predict(spark):
    a = np.arange(12.0).reshape(3, 4)
    df = spark.createDataFrame([(0, raster(a)), (1, None)], SCHEMA)
    back = df.select("id", images.decode_png(images.encode_png(F.col("image"))).alias("r"))
    got = arrays(back, "r")
    assert (got[0] == a).all() and got[1] is None
    out = models.predict(df.filter("id = 0").select(F.col("image")["data"].alias("x")), lambda: lambda b: {"y": b * 2}, "x", shape=[12], output_key="y", pre=lambda b: b + 1)
    assert out.first().prediction == ((a.reshape(-1) + 1) * 2).tolist()
