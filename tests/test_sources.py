"""Files, archives, listings and tables, written and read again."""

from __future__ import annotations

import os
import tarfile
import urllib.request
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from seston.functions import png
from seston.operators.images import encode_png, to_array
from seston.sources import archives, files, frames, listings, tables


@pytest.mark.parametrize("ext", [".tar", ".zip", ".tar.gz"])
@pytest.mark.parametrize("with_images", [True, False])
def test_archive(spark, tmp_path, ext, with_images):
    path = f"{tmp_path}/objects{ext}"
    image = F.struct(F.lit(2).alias("height"), F.lit(2).alias("width"), F.lit(1).alias("channels"), F.array(*(F.col("id").cast("double") for _ in range(4))).alias("data"))
    src = spark.range(10).withColumn("png", encode_png(image))
    meta = {"object_id": F.format_string("foo%d", F.col("id")), "i": F.col("id"), "foo": F.lit("Sömé\tUTF-8 \"ſtríng\"\n…")}
    pictures = [(F.format_string("image_%d.png", F.col("id")), F.col("png"))] if with_images else []
    done = archives.write_objects(src, path, meta, order=["id"], images=pictures, object_meta={"foo": 0}, acq_meta={"foo": 1}, process_meta={"foo": 2}, sample_meta={"foo": 3})
    assert [tuple(r) for r in done.collect()] == [(path, 10)]
    assert zipfile.is_zipfile(path) if ext == ".zip" else tarfile.is_tarfile(path)
    got = archives.read_objects(spark, path).orderBy("row_no").collect()
    assert [r.object_id for r in got] == [f"foo{i}" for i in range(10)] and got[0].meta["foo"] == "Sömé\tUTF-8 \"ſtríng\"\n…"
    assert [float(r.meta["i"]) for r in got] == list(map(float, range(10)))
    for n, prefix in enumerate(("object_", "acq_", "process_", "sample_")):
        assert all(float(r.meta[prefix + "foo"]) == n for r in got)
    assert all(set(r.images) == ({1} if with_images else set()) for r in got)
    if with_images:
        assert (png.decode(bytes(got[7].images[1])) == 7).all()
    some = archives.read_objects(spark, path, query="double(meta['i']) > 6", columns="i", images=False)
    assert sorted(r.object_id for r in some.collect()) == ["foo7", "foo8", "foo9"] and "foo" not in some.first().meta


def test_archive_failures(spark, tmp_path):
    (tmp_path / "a.zip").write_text("no archive")
    with pytest.raises(Exception):
        archives.read_objects(spark, f"{tmp_path}/a.zip").collect()
    assert archives.read_objects(spark, f"{tmp_path}/a.zip", keep_going=True).count() == 0
    with zipfile.ZipFile(f"{tmp_path}/b.zip", "w") as z:
        z.writestr("ecotaxa_x.tsv", "object_id\timg_file_name\tn\n[t]\t[t]\t[f]\no1\tmissing.png\tx\n\t\t\n")
    with pytest.raises(Exception):
        archives.read_objects(spark, f"{tmp_path}/b.zip").collect()
    got = archives.read_objects(spark, f"{tmp_path}/b.zip", keep_going=True).collect()
    assert [(r.object_id, r.meta["n"], r.images) for r in got] == [("o1", None, {})]
    with zipfile.ZipFile(f"{tmp_path}/c.zip", "w") as z:
        z.writestr("ecotaxa_x.tsv", "id\n1\n")
    with pytest.raises(Exception):
        archives.read_objects(spark, f"{tmp_path}/c.zip").collect()
    with pytest.raises(archives.UnknownArchiveError):
        archives.Archive(f"{tmp_path}/d.rar", "w")


def test_listing(spark, tmp_path):
    head = ["017", "num-fields|5", "id|int32", "image_x|int32", "image_y|int32", "image_w|int32", "image_h|int32"]
    lines = [*head[:1], "num-fields|6", *head[2:], "collage_file|string", "1|0|0|2|1|c.tif", "2|1|1|1|2|c.tif", "3|1|1|1", "4|0|0|1|1|other.tif"]
    (tmp_path / "a.lst").write_text("\r\n".join(lines) + "\r\n")
    raw = listings.read_listing_lines(spark, f"{tmp_path}/a.lst")
    assert raw.count() == len(lines)
    name = raw.first().lst_name
    collage = [(name, "c.tif", (3, 3, 1, list(map(float, range(9))))), (name, "C_BIN.tif", (3, 3, 1, [0.0, 1.0] * 4 + [0.0]))]
    collages = spark.createDataFrame(collage, "lst_name string, name string, image struct<height:int,width:int,channels:int,data:array<double>>")
    got = {r.line_no: r for r in listings.read_listing_objects(raw, collages).collect()}
    assert sorted(got) == [9, 10, 12] and got[12].image is None
    assert to_array(got[9].image.asDict()).tolist() == [[0.0, 1.0]] and to_array(got[10].image.asDict()).tolist() == [[4.0], [7.0]]
    assert to_array(got[9]["mask"].asDict()).tolist() == [[0.0, 1.0]]
    assert listings.read_listing_objects(raw, collages).select(listings.field(F.col("fields"), "id").alias("i")).orderBy("i").first().i == "1"
    (tmp_path / "b.lst").write_text("016\nnum-fields|0\n")
    with pytest.raises(Exception):
        listings.read_listing_lines(spark, f"{tmp_path}/b.lst").collect()


def test_files(spark, tmp_path):
    for p in ("b.png", "a.png", "sub/c.png", "sub/d.PNG", "e.txt"):
        os.makedirs(os.path.dirname(f"{tmp_path}/{p}"), exist_ok=True)
        with open(f"{tmp_path}/{p}", "wb") as f:
            f.write(png.encode(np.full((2, 3), 7, np.uint8)))
    df = spark.createDataFrame([(str(tmp_path),), (None,)], "root string")
    found = [r[0] for r in df.select(files.find_files(F.col("root"), [".png"], True)).collect()]
    assert [os.path.relpath(p, tmp_path) for p in found[0]] == ["a.png", "b.png", "sub/c.png"] and found[1] == []
    globbed = df.filter("root IS NOT NULL").select(files.glob_files(F.concat("root", F.lit("/**/*.png")), True)).first()[0]
    assert len(globbed) == 3
    read = files.read_images(spark, str(tmp_path)).collect()
    assert len(read) == 3 and all(r.image.height == 2 and set(r.image.data) == {7} for r in read)
    n = files.write_images(files.read_images(spark, str(tmp_path)).withColumn("out", F.concat(F.lit(f"{tmp_path}/out/"), F.monotonically_increasing_id().cast("string"), F.lit(".png"))), "out", "image")
    assert n == 3 and len(os.listdir(f"{tmp_path}/out")) == 3


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", None), (1, "a", 1.5), (3, "b", 2.5)], "o int, k string, v double")
    tables.write_csv(df, f"{tmp_path}/t.csv", "o", ["k"])
    assert open(f"{tmp_path}/t.csv").read().splitlines() == ["o,k,v", "1,a,1.5", "2,b,"]
    (tmp_path / "s.txt").write_text("k;n\na;1\nb;2\n")
    assert sorted(map(tuple, tables.read_table(spark, f"{tmp_path}/s.txt").collect())) == [("a", 1), ("b", 2)]
    tables.write_csv(df.limit(0), f"{tmp_path}/e.csv", "o")
    assert open(f"{tmp_path}/e.csv").read().splitlines() == ["o,k,v"]
    rows = spark.createDataFrame([([1, 2, 3], ["a", "b", "c"])], "v array<int>, n array<string>")
    for _ in range(2):
        tables.extend_values(rows, f"{tmp_path}/ext", ["v", "n"])
        tables.append_values(rows, f"{tmp_path}/app")
    assert spark.read.parquet(f"{tmp_path}/ext").count() == 6 and spark.read.parquet(f"{tmp_path}/app").count() == 2


def test_frames(spark):
    with pytest.raises(frames.UnavailableObjectError):
        frames.check_available(frames.optional("a_module_that_is_not_there", "x"))
    with pytest.raises(frames.UnavailableObjectError):
        frames.read_frames(spark, ["x.avi"])
    assert frames.optional("math", "pi") > 3 and frames.is_raspberrypi() is False
    read = frames.read_frames(spark, ["a", "b"], lambda p: ((s, n, np.full((1, 2), n), {"p": p}) for s in (0, 1) for n in range(2)), series=[1])
    assert sorted((r.path, r.series, r.frame_no, r.image.data[0], r.metadata["p"]) for r in read.collect()) == [(p, 1, n, float(n), p) for p in "ab" for n in range(2)]
    assert frames.unpack_message(frames.pack_message("cam", b"x\ny")) == ("cam", b"x\ny")
    with pytest.raises(ValueError):
        frames.pack_message("a\nb", b"")
    publisher = frames.Publisher()
    publish = frames.stream_frames(read, publisher, name="cam")
    with frames.FrameServer(publisher) as server:
        publish(read, 0)
        with urllib.request.urlopen(f"http://127.0.0.1:{server.address[1]}/cam", timeout=10) as r:
            head = r.read(400)
        assert b"--frame" in head and png.SIGNATURE in head
        with pytest.raises(Exception):
            urllib.request.urlopen(f"http://127.0.0.1:{server.address[1]}/none", timeout=10)
