"""The general curation operators on hard cases: nulls, ties, repeats, empty tables, clashing names, runs that fail."""

from __future__ import annotations

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from seston.operators import bad_records, orphans, schema_drift, small_files

T = lambda s: dt.datetime.fromisoformat(s)


# ---- records


def lst(spark, files, extra=False):
    rows = [(f, i, t) for f, lines in files.items() for i, t in enumerate(lines, 1)]
    df = spark.createDataFrame(rows, "lst_name string, line_no int, line_text string").repartition(3)
    return df.withColumn("n_fields", F.lit("clash")).withColumn("reason", F.lit(1)) if extra else df


HEAD = ["017", "num-fields|4", "image_x|int32", "image_w|int32", "collage_file|string", "area|double"]


def test_records(spark):
    cases = {
        "1|2|a.tif|1.5": None, ' +1 |2|"a|""b.TIF"|x': None, "1|2|a.tif": "too_few_columns", "1|2|a.tif|1|": "too_many_columns", '1|2|"a.tif|1': "open_quote", "x|2|a.tif|1": "image_x_not_int32",
        "-1|2|a.tif|1": "image_x_range", "1|0|a.tif|1": "image_w_range", "1|2147483648|a.tif|1": "image_w_not_int32", "1|2|a.png|1": "collage_file_suffix", '1|2|a".tif|': None, "": "no record", None: "no record",
        "١|2|a.tif|1": "image_x_not_int32", "1|2|" + "ü" * 5000 + ".tif|1": None,
    }
    got = bad_records.split_records(lst(spark, {"f": [*HEAD, *cases], "h": ["017", "junk", "1|2|3|4"]}, extra=True))
    rows = {r.line_no: r for r in got.filter("lst_name = 'f'").collect()}
    for n, (text, want) in enumerate(cases.items(), 7):
        assert (n not in rows) if want == "no record" else rows[n].reason == want, text
    assert rows[8].collage_file == 'a|"b.TIF' and rows[8].image_x == 1 and rows[8].fields["area|double"] == "x"
    assert [r.reason for r in got.filter("lst_name = 'h'").collect()] == ["no_header"]
    typed = {r.line_no: r for r in bad_records.typed_records(got.filter("lst_name = 'f'"), {"area": "double", "image_x": "int32", "nothing": "string"}).collect()}
    assert typed[7].area == 1.5 and typed[7].failed == [] and typed[8].area is None and typed[8].failed == ["area"] and typed[7].nothing is None
    assert bad_records.split_records(lst(spark, {"f": HEAD}).limit(0)).count() == 0


def test_headers_that_cannot_be_read(spark):
    head = ["017", "num-fields|4", "image_x|int32", 'im"age|int32', "collage_file|string", "image_w|int32"]
    got = bad_records.split_records(lst(spark, {"f": [*head, "1|2|a.tif|3"], "g": ["017", "num-fields|4", "image_x|int32", "image_w|int32", "collage_file|string", "image_w|int32", "1|2|a.tif|4"]})).collect()
    by = {r.lst_name: r.fields for r in got}
    assert by["f"] == {"image_x|int32": "1", "field_2|string": "2", "collage_file|string": "a.tif", "image_w|int32": "3"}
    assert by["g"] == {"image_x|int32": "1", "image_w|int32": "2", "collage_file|string": "a.tif", "image_w_4|int32": "4"}


@pytest.mark.parametrize("chunk", [1, 3, 7, 512])
def test_machine_by_chunks(chunk):
    import numpy as np

    classes = np.random.default_rng(0).integers(0, 4, 2000).astype(np.uint8)
    state, want = 0, []
    for c in classes:
        want.append(state)
        state = bad_records.STEP[c, state]
    assert bad_records.machine_states(classes, chunk).tolist() == want


# ---- small files


def files(spark, rows):
    return spark.createDataFrame(rows, "file_id long, object_id string, image_data binary").withColumn("k", F.lit("clash")).repartition(2)


def test_each_record_once(spark, tmp_path):
    rows = [(1, "A", b"x"), (2, " a ", b"x"), (3, "a", b"y"), (4, None, b"x"), (5, None, b"x"), (6, "b", None), (7, "b", b""), (8, " ", b"x"), (9, "c", b"z" * 5000), (1, "A", b"x")]
    made = small_files.compact(files(spark, rows), str(tmp_path))
    assert sorted(r[0] for r in made.dropped.collect()) == [2, 6, 7]
    assert sorted(r.file_id for r in made.read().collect()) == [1, 3, 4, 5, 8, 9]
    assert small_files.compact(files(spark, rows).limit(0), f"{tmp_path}/empty").read().count() == 0


def test_many_groups_and_a_run_that_fails(spark, tmp_path, monkeypatch):
    rows = [(i, f"o{i}", os.urandom(50 + 40 * (i % 7 == 0) * i % 900)) for i in range(300)]
    first = small_files.compact(files(spark, rows), str(tmp_path), target_bytes=4000)
    sizes = [f["content_bytes"] for f in first.manifest["files"]]
    assert len(sizes) > 4 and max(sizes) < 1.5 * min(sizes)
    before = {f["name"] for f in first.manifest["files"]}
    monkeypatch.setattr(small_files.json, "dump", lambda *a, **k: (_ for _ in ()).throw(OSError("disk full")))
    with pytest.raises(OSError):
        small_files.compact(files(spark, rows[:100]), str(tmp_path), target_bytes=4000)
    monkeypatch.undo()
    assert set(small_files.published(str(tmp_path))) == before and first.read().count() == 300
    second = small_files.compact(files(spark, rows[:100]), str(tmp_path), target_bytes=4000)
    assert second.read().count() == 100 and not before & set(os.listdir(tmp_path))


def test_longest_first():
    got = small_files.longest_first([(0, 7), (1, 5), (2, 4), (3, 4)], 2)
    assert sorted(sum(s for i, s in enumerate((7, 5, 4, 4)) if got[i] == g) for g in (0, 1)) == [9, 11]


# ---- drifting schemas


def drift(spark, archives, **k):
    rows = [(a, 1, T(f"2020-01-{a:02d}"), o, m if isinstance(m, str) or m is None else json.dumps(m)) for a, objects in archives.items() for o, m in objects]
    df = spark.createDataFrame(rows, "archive int, project int, at timestamp, o string, meta string").withColumn("file", F.lit("clash"))
    return schema_drift.Drift(df, file="archive", source="project", at="at", object="o", meta="meta", **k)


def changes(d):
    return sorted(tuple(r)[1:] for r in d.changes.collect())


def test_changes(spark):
    old = [(f"o{i}", {"a": i, "b": f"t{i}", "gone": 1, "n": i, "deep": {"x": f"v{i}", "y": i}}) for i in range(6)]
    new = [(f" O{i}", {"a2": float(i), "b": i, "came": True, "n": i, "deep": {"z": f"v{i}"}, "y": i}) for i in range(6)]
    d = drift(spark, {1: old, 2: new})
    got = changes(d)
    assert ("renamed", "deep/x", "deep/z") in got and ("moved", "deep/y", "y") in got or ("moved", "deep/y", "a2") in got or ("moved", "a", "y") in got
    assert ("added", "", "came") in got and ("removed", "gone", "") in got and ("retyped", "b", "b") in got and len(got) == 6
    assert d.table().count() == 12


def test_value_beside_children_broken_and_missing(spark):
    d = drift(spark, {1: [("p", {"x": 1, "": {"a": 1}}), ("q", {"x": {"z": 1}, "a": 2}), ("r", "{broken"), ("s", None), ("t", "[1]"), ("u", {"x": None})], 2: [("p", {"a": 2}), ("q", {})]})
    assert changes(d) == [("removed", "/a", ""), ("removed", "x", ""), ("removed", "x/z", "")]
    assert {r.reason: r.n for r in d.skipped().collect()} == {"broken": 2, "no file or source": 0}
    table = d.columns()
    assert table.count() == 8 and set(table.columns[4:]) == {"/a", "a", "x", "x/z"}
    assert drift(spark, {1: [("p", {})]}).changes.count() == 0


def test_typed_columns_follow_renames(spark):
    one = [(f"o{i}", {"old": i, "t": "s"}) for i in range(5)]
    two = [(f"o{i}", {"new": i if i else "stray", "t": 5}) for i in range(5)]
    three = [(f"o{i}", {"new": i, "t": 5}) for i in range(5)]
    d = drift(spark, {1: one, 2: two, 3: three})
    assert d.lasting() == {"new": "number", "t": "number"}
    rows = d.columns().orderBy("file", "object").collect()
    assert [r.new for r in rows] == [0.0, 1.0, 2.0, 3.0, 4.0, None, 1.0, 2.0, 3.0, 4.0, 0.0, 1.0, 2.0, 3.0, 4.0] and rows[0].t is None and rows[5].t == 5.0


# ---- orphans


def refs(spark, rows):
    df = spark.createDataFrame([(k, t and T(t)) for k, t in rows], "k string, t timestamp_ntz")
    return orphans.reference_rows(df, "tab", "k", "t")


def parents(spark, rows):
    df = spark.createDataFrame([(k, r and T(r), d and T(d)) for k, r, d in rows], "k string, r timestamp_ntz, d timestamp_ntz")
    return orphans.parent_rows(df, "k", "r", "d")


def pending(tracker):
    return sorted((r.key, str(r.t)[:10], r.n) for r in tracker.pending.collect())


def test_open_and_ended_rows_side_by_side(spark):
    t = orphans.OrphanTracker(spark).advance(refs(spark, [("a", "2020-06-01")]), parents(spark, [("A ", "2020-01-01", None), ("a", "2020-01-01", "2020-02-01")]))
    assert pending(t) == []


def test_resolve_reopen_and_resume(spark, tmp_path):
    folder = f"file://{tmp_path}/state"
    t = orphans.OrphanTracker(spark, folder)
    t.advance(refs(spark, [("a", "2020-03-01"), (" A", "2020-03-01"), ("a", "2020-01-10"), ("b", "2020-03-01"), (None, "2020-03-01"), ("a", None)]))
    assert pending(t) == [("a", "2020-01-10", 1), ("a", "2020-03-01", 2), ("b", "2020-03-01", 1)]
    rows = parents(spark, [("a", "2020-02-01", None)])
    t.advance(parents=rows)
    assert pending(t) == [("a", "2020-01-10", 1), ("b", "2020-03-01", 1)]
    again = orphans.OrphanTracker(spark, folder)
    assert pending(again) == pending(t)
    again.advance(deletions=rows.withColumn("until", F.lit(T("2020-02-15")).cast("timestamp_ntz")))
    assert pending(again) == [("a", "2020-01-10", 1), ("a", "2020-03-01", 2), ("b", "2020-03-01", 1)]
    again.advance(refs(spark, [("a", "2020-02-14"), ("a", "2020-02-15"), ("a", "2020-01-25")]))
    assert ("a", "2020-02-15", 1) in pending(again) and ("a", "2020-02-14", 1) not in pending(again) and ("a", "2020-01-25", 1) not in pending(again)
    again.advance()
    assert [(r.step, r.n) for r in again.snapshots().groupBy("step").agg(F.sum("n").alias("n")).orderBy("step").collect()] == [(1, 4), (2, 2), (3, 4), (4, 5)]
    assert orphans.OrphanTracker(spark).snapshots().count() == 0
