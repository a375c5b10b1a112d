"""Reading JSON records whose schema drifts, as one consistent table with a report of every change.

The schema of a file is a tree of field names. Between consecutive files of a source, a constrained tree edit
distance over the two trees (children of matched parents are matched, at least cost, by an assignment problem; a
left-over leaf may move to another parent) yields the cheapest script of add, delete, rename, move and retype. What a
rename of two leaves costs is taken from the data: the share of the records present in both files whose
values differ. The scripts are then chained over each source, giving every (file, field) its lasting name, and
applied as a projection to all rows.
"""

from __future__ import annotations

import json
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seston.runtime import BROADCAST_LIMIT, norm_key, settle, table_bytes

#: A rename needs this share of equal values among the records that both files hold.
LEAST_EQUAL = 0.8
#: Under this name, which no field can have, a node holds its own value.
LEAF = "~leaf"
#: Cost of deleting or adding a leaf; a rename costs its share of unequal values times RENAME.
EDIT, RENAME = 1.0, 2.0


def leaves(value, path: str | None = None):
    """(path, type, text) of each scalar of a parsed JSON object; lists and empty objects are leaves of their own."""
    for name, v in value.items():
        at = _escape(name) if path is None else f"{path}/{_escape(name)}"
        if isinstance(v, dict) and v:
            yield from leaves(v, at)
        elif v is None:
            continue
        elif isinstance(v, bool):
            yield at, "boolean", "true" if v else "false"
        elif isinstance(v, (int, float)):
            yield at, "number", repr(v if isinstance(v, int) and abs(v) >= 2**53 else float(v))
        elif isinstance(v, str):
            yield at, "string", v
        else:
            yield at, "list" if isinstance(v, list) else "object", json.dumps(v, sort_keys=True)


def _escape(name: str) -> str:
    """As in a JSON Pointer: ``/`` separates, ``~1`` is a slash and ``~0`` a tilde within a name."""
    return name.replace("~", "~0").replace("/", "~1")


def _split(path: str) -> tuple[str, ...]:
    return tuple(path.split("/"))


def plain(path: Column) -> Column:
    """The path with its names as they stand in the data."""
    return F.replace(F.replace(path, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))


def flatten(rows: DataFrame, meta: str, keep: dict[str, str]) -> DataFrame:
    """``keep`` (name: expression), ``leaves``: array of (field, type, text), and ``broken``: whether the text is neither blank nor a JSON object."""
    src = rows.select(*(F.expr(e).alias(n) for n, e in keep.items()), F.col(meta).alias("__meta"))
    kind = pa.list_(pa.struct([("field", pa.string()), ("type", pa.string()), ("text", pa.string())]))

    def parse(batches):
        for batch in batches:
            field, type_, text, ends, broken = [], [], [], [0], []
            for s in batch.column("__meta").to_pylist():
                blank = s is None or not s.strip()
                try:
                    value = None if blank else json.loads(s)
                except (ValueError, RecursionError):
                    value = None
                broken.append(not blank and not isinstance(value, dict))
                if isinstance(value, dict):
                    for f, t, x in leaves(value):
                        field.append(f)
                        type_.append(t)
                        text.append(x)
                ends.append(len(field))
            inner = pa.StructArray.from_arrays([pa.array(field, pa.string()), pa.array(type_, pa.string()), pa.array(text, pa.string())], fields=list(kind.value_type))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner), pa.array(broken, pa.bool_())], names=[*keep, "leaves", "broken"])

    schema = ", ".join(f"`{n}` {src.schema[n].dataType.simpleString()}" for n in keep)
    return src.mapInArrow(parse, schema + ", leaves array<struct<field:string,type:string,text:string>>, broken boolean")


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of a least-cost assignment of all rows; rows <= columns (shortest augmenting paths)."""
    n, m = cost.shape
    u, v, match, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while match[j0]:
            used[j0] = True
            reduced = cost[match[j0] - 1] - u[match[j0]] - v[1:]
            better = ~used[1:] & (reduced < least[1:])
            least[1:][better], way[1:][better] = reduced[better], j0
            j1 = int(np.argmin(np.where(used, np.inf, least)))
            step = least[j1]
            u[match[used]] += step
            v[used] -= step
            least[~used] -= step
            j0 = j1
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    return sorted((match[j] - 1, j - 1) for j in range(1, m + 1) if match[j])


def edit_script(old: dict[str, str], new: dict[str, str], equal: dict[tuple[str, str], float], least_equal: float = LEAST_EQUAL) -> list[tuple[str, str, str]]:
    """Cheapest (kind, old path, new path) that turn the tree of ``old`` (path: type) into that of ``new``.

    ``equal`` gives the share of equal values for pairs of a path gone and a path come; a pair that isn't in it or is
    under ``least_equal`` can't be a rename or move. Kinds: added, removed, renamed (same parent), moved, retyped.
    """
    gone, come = sorted(set(old) - set(new)), sorted(set(new) - set(old))

    def tree(paths):
        root: dict = {}
        for p in paths:
            node = root
            for part in _split(p)[:-1]:
                node = node.setdefault(part, {})
            node.setdefault(_split(p)[-1], {})[LEAF] = p  # a node may hold a value of its own beside children
        return root

    def size(node):
        return sum(map(size, node.values())) if isinstance(node, dict) else 1

    memo: dict = {}

    def match(a, b):
        """(cost, pairs of paths) of turning subtree a into b."""
        key = (id(a), id(b))
        if key not in memo:
            if isinstance(a, str) and isinstance(b, str):
                share = 1.0 if a == b else equal.get((a, b), 0.0)
                memo[key] = ((1 - share) * RENAME, [(a, b)]) if share >= least_equal else (2 * EDIT, [])
            elif isinstance(a, str) or isinstance(b, str):
                memo[key] = ((size(a) + size(b)) * EDIT, [])
            else:
                same = sorted(set(a) & set(b))
                parts = [match(a[k], b[k]) for k in same]
                ra, rb = [a[k] for k in sorted(set(a) - set(b))], [b[k] for k in sorted(set(b) - set(a))]
                cost, pairs = sum(c for c, _ in parts), [p for _, ps in parts for p in ps]
                if ra and rb:
                    grid = np.array([[match(x, y)[0] for y in rb] + [size(x) * EDIT if i == j else 1e6 for j in range(len(ra))] for i, x in enumerate(ra)])
                    # a column not taken is an addition: its cost is saved by taking it
                    grid[:, : len(rb)] -= [[size(y) * EDIT for y in rb]] * len(ra)
                    cost += sum(size(y) for y in rb) * EDIT
                    for i, j in assign(grid):
                        cost += grid[i, j]
                        if j < len(rb):
                            pairs += match(ra[i], rb[j])[1]
                else:
                    cost += EDIT * (sum(map(size, ra)) + sum(map(size, rb)))
                memo[key] = (cost, pairs)
        return memo[key]

    roots = tree(gone), tree(come)
    pairs = match(*roots)[1]
    left_old, left_new = sorted(set(gone) - {a for a, _ in pairs}), sorted(set(come) - {b for _, b in pairs})
    if left_old and left_new:  # what is left may have moved to another parent
        grid = np.array([[(1 - equal.get((a, b), 0)) * RENAME if equal.get((a, b), 0) >= least_equal else 1e6 for b in left_new] + [2 * EDIT if i == j else 1e6 for j in range(len(left_old))] for i, a in enumerate(left_old)])
        pairs += [(left_old[i], left_new[j]) for i, j in assign(grid) if j < len(left_new) and grid[i, j] < 1e6]
    out = [("moved" if _split(a)[:-1] != _split(b)[:-1] else "renamed", a, b) for a, b in pairs]
    out += [("removed", a, "") for a in gone if a not in {x for x, _ in pairs}]
    out += [("added", "", b) for b in come if b not in {y for _, y in pairs}]
    out += [("retyped", f, f) for f in sorted(set(old) & set(new)) if old[f] != new[f]]
    return sorted(out)


class Drift:
    """The rows (``flat``: file, source, at, object, leaves), the fields of each file and the changes between files."""

    def __init__(self, rows: DataFrame, *, file: str, source: str, at: str, object: str, meta: str, least_equal: float = LEAST_EQUAL):
        """Files of a ``source`` follow each other by ``at``, then ``file``; rows without file or source are left out.

        A null, blank or broken ``meta`` has no fields; repeated rows and rows in any order change nothing; extra
        columns are ignored; an empty table gives empty results.
        """
        placed = F.col(file).isNotNull() & F.col(source).isNotNull()
        self._lost = rows.filter(~placed)
        flat = flatten(rows.filter(placed), meta, {"file": file, "source": source, "at": at, "object": object})
        flat = flat.withColumn("object", norm_key("object"))
        self.flat = settle(flat, "flat")
        leaf = self.flat.select("file", "source", F.explode("leaves").alias("l")).select("file", "source", "l.field", "l.type")
        counted = leaf.groupBy("file", "source", "field", "type").agg(F.count("*").alias("n"))
        # most rows decide; on a tie number before boolean before string
        self.fields = settle(counted.groupBy("file", "source", "field").agg(F.max_by("type", F.struct("n", F.expr("array_position(array('object', 'list', 'string', 'boolean', 'number'), type)"))).alias("type"), F.sum("n").alias("n")), "fields")
        files = self.flat.groupBy("source", "file").agg(F.min("at").alias("at"))
        follow = Window.partitionBy("source").orderBy(F.col("at").asc_nulls_first(), "file")  # a row per file
        self.steps = settle(files.select("source", "file", F.row_number().over(follow).alias("turn"), F.lag("file").over(follow).alias("before")), "steps")
        self.changes = settle(self._changes(least_equal), "changes")

    def _changes(self, least_equal: float) -> DataFrame:
        pairs = self.steps.filter("before IS NOT NULL").select(F.col("file").alias("new"), F.col("before").alias("old"))
        old = self.fields.select(F.col("file").alias("old"), "field", F.col("type").alias("type_old"))
        new = self.fields.select(F.col("file").alias("new"), "field", F.col("type").alias("type_new"))
        both = pairs.join(old, "old").join(pairs.join(new, "new").drop("old"), ["new", "field"], "full")
        differ = settle(both.filter("type_old IS NULL OR type_new IS NULL OR type_old <> type_new").select("new", "field", "type_old", "type_new"), "differ")
        two_sided = differ.groupBy("new").agg(F.count_if(F.col("type_new").isNull()).alias("g"), F.count_if(F.col("type_old").isNull()).alias("c")).filter("g > 0 AND c > 0").select("new")
        ask = differ.join(two_sided, "new", "left_semi").filter("type_old IS NULL OR type_new IS NULL").join(pairs, "new")
        # the texts of the fields in question, stray types aside, of the objects in both files
        gone = ask.filter("type_new IS NULL").select(F.col("old").alias("file"), "new", "field", F.col("type_old").alias("type"), F.lit("gone").alias("side"))
        come = ask.filter("type_old IS NULL").select(F.col("new").alias("file"), "new", "field", F.col("type_new").alias("type"), F.lit("come").alias("side"))
        wanted = settle(gone.unionByName(come), "wanted")
        leaf = self.flat.filter("object IS NOT NULL").select("file", "object", F.explode("leaves").alias("l")).select("file", "object", "l.field", "l.type", "l.text")
        near = F.broadcast(wanted) if table_bytes(wanted) * 8 <= BROADCAST_LIMIT else wanted
        values = leaf.join(near, ["file", "field", "type"])
        # an object may stand on several rows of a file: its values are a set
        per = values.groupBy("new", "object", "side", "field").agg(F.collect_set(F.xxhash64("type", "text")).alias("v"))
        per = settle(per, "values")
        one, two = (per.filter(F.col("side") == s).select("new", "object", F.col("field").alias(f), F.col("v").alias(v)) for s, f, v in (("gone", "fo", "vo"), ("come", "fn", "vn")))
        shares = one.join(two, ["new", "object"]).groupBy("new", "fo", "fn").agg(F.avg(F.arrays_overlap("vo", "vn").cast("double")).alias("share"))
        shares = shares.filter(F.col("share") >= least_equal)
        work = differ.select("new", F.col("field").alias("a"), F.lit(None).cast("string").alias("b"), "type_old", "type_new", F.lit(None).cast("double").alias("share"))
        work = work.unionByName(shares.select("new", F.col("fo").alias("a"), F.col("fn").alias("b"), F.lit(None).cast("string").alias("type_old"), F.lit(None).cast("string").alias("type_new"), "share"))

        def script(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            field = pdf[pdf.b.isna()]
            old = {f: t for f, t in zip(field.a, field.type_old) if t is not None}
            new = {f: t for f, t in zip(field.a, field.type_new) if t is not None}
            rest = pdf[pdf.b.notna()]
            steps = edit_script(old, new, {(a, b): s for a, b, s in zip(rest.a, rest.b, rest.share)}, least_equal)
            return pd.DataFrame([(key[0], *s) for s in steps], columns=["file", "kind", "old_field", "new_field"])

        kind = self.fields.schema["file"].dataType.simpleString()
        # a stated number of partitions, as adaptive execution would put all files into one task: their rows are few, their scripts are not
        n = int(self.flat.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return work.repartition(n, "new").groupBy("new").applyInPandas(script, f"file {kind}, kind string, old_field string, new_field string")

    def names(self) -> DataFrame:
        """(file, field, lasting): the name that each field of each file has in the source's last file that holds it.

        A field that another one of its file was later renamed to gets ``~1`` behind its name.
        The renames of a source are chained from its last file back; a group has the renames of one source, no rows.
        """
        renames = self.changes.filter("kind IN ('renamed', 'moved')").join(self.steps, "file").select("source", "turn", "old_field", "new_field")
        kind = self.fields.schema["source"].dataType.simpleString()

        def chain(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            lasting: dict[str, str] = {}
            out = []
            for turn, part in sorted(pdf.groupby("turn"), reverse=True):
                now = {a: lasting.get(b, b) for a, b in zip(part.old_field, part.new_field)}
                for b in part.new_field:
                    lasting.pop(b, None)
                lasting |= now
                out += [(key[0], int(turn), f, t) for f, t in lasting.items()]
            return pd.DataFrame(out, columns=["source", "upto", "field", "lasting"])

        chained = renames.groupBy("source").applyInPandas(chain, f"source {kind}, upto int, field string, lasting string")
        spans = self.steps.join(chained, "source").filter("turn < upto")
        first = spans.groupBy("source", "file", "field").agg(F.min_by("lasting", "upto").alias("lasting"))
        named = self.fields.select("file", "source", "field").join(first.drop("source"), ["file", "field"], "left")
        same = Window.partitionBy("file", F.coalesce("lasting", "field")).orderBy(F.col("lasting").isNull(), "field")  # fields of a file
        turn = F.row_number().over(same)
        return named.withColumn("turn", turn).select("file", "field", F.concat(F.coalesce("lasting", "field"), F.when(F.col("turn") > 1, F.concat(F.lit("~"), F.col("turn") - 1)).otherwise("")).alias("lasting"))

    def table(self) -> DataFrame:
        """file, source, at, object and ``meta``: a map of lasting name to (type, text), the same names in all files."""
        scripts = settle(self.names().filter("field <> lasting").groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("field", "lasting"))).alias("lasting")), "scripts")
        if table_bytes(scripts) * 8 <= BROADCAST_LIMIT:
            scripts = F.broadcast(scripts)
        named = self.flat.join(scripts, "file", "left")
        entry = F.expr("map_from_entries(transform(leaves, l -> struct(coalesce(element_at(lasting, l.field), l.field) AS k, struct(l.type, l.text) AS v)))")
        return named.select("file", "source", "at", "object", entry.alias("meta"))

    def skipped(self) -> DataFrame:
        """(reason, n): rows without file or source, and rows whose meta is neither blank nor a JSON object."""
        lost = self._lost.agg(F.count("*").alias("n")).select(F.lit("no file or source").alias("reason"), "n")
        return lost.unionByName(self.flat.agg(F.count_if("broken").alias("n")).select(F.lit("broken").alias("reason"), "n"))

    def lasting(self) -> dict[str, str]:
        """The fields of the one table by their lasting names, with the type of most values, in order. As many rows as there are names come to the driver."""
        counted = self.names().join(self.fields, ["file", "field"]).groupBy("lasting", "type").agg(F.sum("n").alias("n"))
        rank = F.struct("n", F.expr("array_position(array('object', 'list', 'string', 'boolean', 'number'), type)"))
        return {r["lasting"]: r["type"] for r in counted.groupBy("lasting").agg(F.max_by("type", rank).alias("type")).orderBy("lasting").collect()}

    def columns(self, fields: dict[str, str] | None = None) -> DataFrame:
        """One row for each row read: file, source, at, object, and the fields (by default all) as columns of number (double), boolean or string.

        A value of another type is null, or in a column of strings its text; rows without fields are there with nulls. The columns are those of all sources
        together.
        """
        sql = {"number": "double", "boolean": "boolean"}
        fields = self.lasting() if fields is None else fields
        value = [F.try_element_at("meta", F.lit(f)) for f in fields]
        made = [(F.when(v["type"] == t, v["text"].try_cast(sql[t])) if t in sql else v["text"]).alias(f.replace("~1", "/").replace("~0", "~")) for (f, t), v in zip(fields.items(), value)]
        return self.table().select("file", "source", "at", "object", *made)
