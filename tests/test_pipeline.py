"""Recorded plans."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from seston.plans import nodes as N
from seston.plans.pipeline import BatchedPipeline, Call, EmptyPipelineStackError, Node, Output, ParallelPipeline, Pipeline, ReturnOutputs, StreamObjectKeyError, predecessors


def test_operators_record_and_apply(spark):
    with Pipeline() as p:
        a = N.Unpack(range(5))
        b = (a * 2 + 1) // 3
        c = 10 - a
        N.Filter(a != 3)
        i = N.Enumerate()
        left = N.RemainingHint()
        t = N.Format("{:03d}/{}", a, b)
        parsed = N.Parse("{x:d}/{y:d}", t)
        x = parsed["x"]
        same = parsed.x
        both = (a > 1) & (a < 4)
        xs = Call(lambda v: [v, v + 1], a, type="array<bigint>")
        first, last = xs.unpack(2)
    got = p.collect(spark, a=a, b=b, c=c, i=i, left=left, t=t, x=x, same=same, both=both, last=last, first=first)
    want = [v for v in range(5) if v != 3]
    assert [g["a"] for g in got] == want and [g["b"] for g in got] == [(v * 2 + 1) // 3 for v in want] and [g["c"] for g in got] == [10 - v for v in want]
    assert [g["i"] for g in got] == [0, 1, 2, 3] and [g["left"] for g in got] == [4, 3, 2, 1]
    assert [g["t"] for g in got] == [f"{v:03d}/{(v * 2 + 1) // 3}" for v in want] and all(g["x"] == g["same"] == g["a"] for g in got)
    assert [g["both"] for g in got] == [1 < v < 4 for v in want] and [g["last"] for g in got] == [v + 1 for v in want]
    dot = p.to_dot()
    assert dot.startswith("strict digraph") and "Unpack" in dot and "->" in dot and len(p.locals()) == len([v for n in p.nodes() for v in n.outputs])
    assert predecessors({"k": [b]}) == [b.node]


def test_nesting_batches_and_order(spark):
    with Pipeline() as p:
        outer = N.Unpack(["x", "y"])
        inner = N.Unpack([3, 1, 2])
        with ParallelPipeline(3):
            n = Call(lambda o, v: f"{o}{v}", outer, inner)
        with BatchedPipeline(4, groupby=outer):
            size = Call(lambda v: [len(v)] * len(v), inner, type="array<int>")
        packed = N.Pack(4, n)
    got = p.collect(spark, packed=packed, size=size)
    assert [g["packed"] for g in got] == [["x3", "x1", "x2", "y3"], ["y1", "y2"]] and [g["size"] for g in got] == [3, 3]
    with Pipeline():
        with pytest.raises(ValueError):
            BatchedPipeline(3, groupby="x")


def test_own_nodes(spark):
    @ReturnOutputs
    @Output("double", "bigint")
    @Output("text", "string")
    class Both(Node):
        def __init__(self, value, sign="!"):
            super().__init__()
            self.value, self.sign = value, sign

        def transform_row(self, value):
            return value * 2, f"{value}{self.sign}"

    with pytest.raises(EmptyPipelineStackError):
        Both(1)
    with Pipeline() as p:
        v = N.Unpack([1, 2])
        d, t = Both(v)
        N.FilterVariables(d, t)
    assert p.collect(spark, d=d, t=t) == [{"d": 2, "t": "1!"}, {"d": 4, "t": "2!"}]
    with pytest.raises(StreamObjectKeyError):
        p.collect(spark, v=v)
    with pytest.raises(ValueError):
        p.collect(spark)
    with pytest.raises(TypeError):
        bool(v)
    with Pipeline() as q:
        w = N.Unpack([{"a": 1}])
        w["a"] = 5
        w["b"] = 6
        del w["a"]
        w.copy().delete()
    assert q.collect(spark, w=w) == [{"w": {"b": 6}}]


def test_filters_join_and_writer(spark, tmp_path):
    meta = spark.createDataFrame([(k, f"n{k}") for k in range(4)], "key int, name string")
    with Pipeline() as p:
        v = N.Unpack([5, 1, 4, 2])
        k = N.Unpack([0])
        m = N.MaxFilter(v, 3)
        e = N.ExponentialSmoothingFilter(v, 0.5)
        r = N.RunningMedian(v, 2)
        idx = N.Enumerate()
        name = N.JoinMetadata(meta, idx, "key", ["name"])
        N.StreamBuffer(4)
        N.Slice(1, None)
        N.TableWriter(f"{tmp_path}/out.csv", {"name": name, "m": m})
    got = p.collect(spark, m=m, e=e, r=r, name=name, k=k)
    assert [g["m"] for g in got] == [5, 4, 4] and [g["e"] for g in got] == [3.0, 3.5, 2.75] and [g["r"] for g in got] == [3.0, 4.0, 3.0] and [g["name"] for g in got] == ["n1", "n2", "n3"]
    assert open(f"{tmp_path}/out.csv").read().splitlines() == ["name,m", "n1,5.0", "n2,4.0", "n3,4.0"]


def test_images_end_to_end(spark, tmp_path):
    from seston.functions import png

    a = np.full((8, 8), 200, np.uint8)
    a[1:3, 1:4] = 10
    a[5, 5] = 20
    for n in "ab":
        (tmp_path / f"{n}.png").write_bytes(png.encode(a))
    with Pipeline() as p:
        root = N.Unpack([str(tmp_path)])
        path = N.Find(root, [".png"], sort=True)
        image = N.ImageReader(path)
        mask = N.ThresholdConst(image, 128)
        region = N.FindRegions(mask, image, min_area=2)
        label = region.label
        features = N.CalculateFeatures(region, prefix="object_")
        roi = N.ExtractROI(image, region)
        N.ImageWriter(N.Format("{}_{}.out", path, label), roi)
    got = p.collect(spark, path=path, label=label, f=features)
    assert [(g["path"][-5], g["label"], g["f"]["object_area"]) for g in got] == [("a", 1, 6.0), ("b", 1, 6.0)]
    assert (png.decode((tmp_path / "a.png_1.out").read_bytes()) == 10).all()


def test_transform_of_a_table(spark):
    from seston.plans.pipeline import Variable

    with Pipeline() as p:
        v = Variable("v", None)
        w = v + 1
    df = spark.createDataFrame([(3, 1), (1, 2)], f"o int, {v.column} int")
    out = p.transform(df, order=["o"])
    assert [r[0] for r in out.orderBy("__ord").select(F.col(w.column)).collect()] == [3, 2]
    with pytest.raises(ValueError):
        p.transform(df)
