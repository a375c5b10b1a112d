"""Archives of objects: a ZIP or TAR file with tables (tab-separated, a header line and a line of types) and the images they name.

The reader is a Spark data source (``spark.read.format("object_archive").load(path or pattern)``) with a partition for each archive; the
writer makes each archive in one task, streaming its rows in order.
"""

from __future__ import annotations

import csv
import fnmatch
import glob as globs
import io
import os
import posixpath
import tarfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from seston.runtime import local_path

#: Pattern of the tables' names, columns with a meaning, prefixes of the groups of columns, and marks of the types. Fixed values.
INDEX_PATTERN = "*ecotaxa_*"
OBJECT_ID, FILE_NAME, RANK = "object_id", "img_file_name", "img_rank"
PREFIXES = {"object_meta": "object_", "acq_meta": "acq_", "process_meta": "process_", "sample_meta": "sample_"}
NUMBER, TEXT = "[f]", "[t]"
DEFAULT_INDEX = "ecotaxa_export.tsv"
UNIDENTIFIED = "<unidentified object>"


class MemberNotFoundError(KeyError):
    """The archive has no member of this name."""


class UnknownArchiveError(ValueError):
    """The file is neither a ZIP nor a TAR archive."""


class Archive:
    """A file of named members; which kind is found by content to read and by name to write."""

    def __new__(cls, path: str, mode: str = "r"):
        if cls is not Archive:
            return object.__new__(cls)
        for kind in (ZipArchive, TarArchive):
            if mode == "r" and kind.holds(path) or mode != "r" and path.lower().endswith(kind.ENDINGS):
                return object.__new__(kind)
        raise UnknownArchiveError(path)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()

    def find(self, pattern: str) -> list[str]:
        return sorted(n for n in self.members() if fnmatch.fnmatch(n, pattern))

    def close(self) -> None:
        self.file.close()


class ZipArchive(Archive):
    ENDINGS = (".zip",)

    @staticmethod
    def holds(path: str) -> bool:
        return zipfile.is_zipfile(path)

    def __init__(self, path: str, mode: str = "r"):
        self.file = zipfile.ZipFile(path, mode)

    def members(self) -> list[str]:
        return [n for n in self.file.namelist() if not n.endswith("/")]

    def read_member(self, name: str) -> bytes:
        try:
            return self.file.read(name)
        except KeyError:
            raise MemberNotFoundError(name) from None

    def write_member(self, name: str, data: bytes, compress: bool = True) -> None:
        """Images are stored as they are, being compressed already."""
        self.file.writestr(name, data, zipfile.ZIP_DEFLATED if compress else zipfile.ZIP_STORED)


class TarArchive(Archive):
    ENDINGS = (".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tar.xz")

    @staticmethod
    def holds(path: str) -> bool:
        return os.path.isfile(path) and tarfile.is_tarfile(path)

    def __init__(self, path: str, mode: str = "r"):
        packed = next((k for e, k in ((".gz", "gz"), (".tgz", "gz"), (".bz2", "bz2"), (".xz", "xz")) if path.endswith(e)), "")
        self.file = tarfile.open(path, mode if mode == "r" else f"{mode}:{packed}")

    def members(self) -> list[str]:
        return [m.name for m in self.file.getmembers() if m.isfile()]

    def read_member(self, name: str) -> bytes:
        try:
            return self.file.extractfile(name).read()
        except KeyError:
            raise MemberNotFoundError(name) from None

    def write_member(self, name: str, data: bytes, compress: bool = True) -> None:
        info = tarfile.TarInfo(name)
        info.size = len(data)
        self.file.addfile(info, io.BytesIO(data))


def type_mark(kind: T.DataType) -> str:
    """The mark of a column's type: numbers are numbers, all else (booleans and times too) is text."""
    return NUMBER if isinstance(kind, T.NumericType) else TEXT


def split_path(path: Column) -> tuple[Column, Column]:
    """Folder and name of a path with slashes."""
    name = F.substring_index(path, "/", -1)
    return F.substring(path, 1, F.greatest(F.length(path) - F.length(name) - 1, F.lit(0))), name


def read_index(text: str, columns: list[str] | None = None) -> tuple[list[dict[str, str | float | None]], dict[str, str]]:
    """(rows, type marks) of a table. A first row that has nothing but type marks gives the types and is no object; what then isn't a number in a number column is null.

    ``columns`` are patterns of the names to keep; the id, file name and rank are always kept.
    """
    lines = list(csv.reader(io.StringIO(text), delimiter="\t"))
    if not lines:
        return [], {}
    names, rows = lines[0], lines[1:]
    marks = dict(zip(names, rows[0])) if rows and rows[0] and all(c in (NUMBER, TEXT) for c in rows[0]) else {}
    if marks:
        rows = rows[1:]
    kept = [i for i, n in enumerate(names) if columns is None or n in (OBJECT_ID, FILE_NAME, RANK) or any(fnmatch.fnmatch(n, c) for c in columns)]

    def value(name: str, text: str):
        if text == "":
            return None
        if marks.get(name) == NUMBER:
            try:
                return float(text)
            except ValueError:
                return None
        return text

    return [{names[i]: value(names[i], r[i]) if i < len(r) else None for i in kept} for r in rows if r], marks


OBJECTS = T.StructType(
    [
        *(T.StructField(n, T.StringType()) for n in ("archive_fn", "index_fn", "object_id")),
        T.StructField("row_no", T.LongType()),
        T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
        T.StructField("images", T.MapType(T.IntegerType(), T.BinaryType())),
    ]
)


def read_archive(path: str, *, index_pattern: str = INDEX_PATTERN, columns: list[str] | None = None, keep_going: bool = False, images: bool = True, encoding: str = "utf-8", prepare: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> Iterator[tuple]:
    """The objects of an archive, by id in each table: values of the first row, and images by rank.

    Rows without id are left out, a table without the id column is an error. With ``keep_going`` a file that is no archive and an image that
    is missing are passed over.
    """
    try:
        archive = Archive(path)
    except UnknownArchiveError:
        if keep_going:
            return
        raise
    with archive:
        number = 0
        for index in archive.find(index_pattern):
            rows, _ = read_index(archive.read_member(index).decode(encoding), columns)
            if prepare is not None:
                rows = prepare(pd.DataFrame(rows)).to_dict("records")
            objects: dict[str, list[dict]] = {}
            for r in rows:
                if OBJECT_ID not in r:
                    raise ValueError(f"{path}, {index}: no column {OBJECT_ID}")
                if r[OBJECT_ID] is not None:
                    objects.setdefault(str(r[OBJECT_ID]), []).append(r)
            for key in sorted(objects):
                found: dict[int, bytes] = {}
                for r in objects[key] if images else ():
                    if r.get(FILE_NAME) is None:
                        continue
                    rank = r.get(RANK)
                    try:
                        data = archive.read_member(posixpath.join(posixpath.dirname(index), r[FILE_NAME]))
                    except MemberNotFoundError:
                        if not keep_going:
                            raise
                        continue
                    found.setdefault(1 if rank is None or rank != rank else int(float(rank)), data)
                meta = {k: None if v is None or v != v else f"{v:.17g}" if isinstance(v, float) else str(v) for k, v in objects[key][0].items()}
                yield path, index, key, number, meta, found
                number += 1


class _Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        paths = options.get("path", "")
        self.paths = sorted(p for pattern in paths.split(",") for p in (globs.glob(local_path(pattern)) or [local_path(pattern)]))
        self.settings = {
            "index_pattern": options.get("index_pattern", INDEX_PATTERN),
            "columns": options["columns"].split(",") if "columns" in options else None,
            "keep_going": options.get("keep_going", "false").lower() == "true",
            "images": options.get("images", "true").lower() == "true",
            "encoding": options.get("encoding", "utf-8"),
        }

    def partitions(self) -> list[InputPartition]:
        return [_Part(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from read_archive(partition.path, **self.settings)


class ObjectArchiveSource(DataSource):
    """Options: ``index_pattern``, ``columns`` (patterns, by commas), ``keep_going``, ``images`` (false leaves their content unread), ``encoding``."""

    @classmethod
    def name(cls) -> str:
        return "object_archive"

    def schema(self) -> T.StructType:
        return OBJECTS

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader({k: v for k, v in self.options.items()})


def read_objects(spark: SparkSession, path: str, *, query: str | Column | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None, **options: str | bool) -> DataFrame:
    """The objects of the archives at ``path``. ``query`` is a condition on the columns (``meta['area'] > 100``), ``prepare`` a hook on the whole table."""
    spark.dataSource.register(ObjectArchiveSource)
    out = spark.read.format("object_archive").options(**{k: str(v) for k, v in options.items()}).load(path)
    out = prepare(out) if prepare else out
    return out if query is None else out.filter(query)


def object_image(images: Column, rank: int | None = None) -> Column:
    """The encoded image of a rank (an unknown one is an error), or of the lowest."""
    if rank is None:
        return images[F.array_min(F.map_keys(images))]
    return F.when(F.map_contains_key(images, F.lit(rank)), images[F.lit(rank)]).otherwise(F.raise_error(F.lit(f"no image of rank {rank}")).cast("binary"))


def object_name(meta: Column) -> Column:
    return F.coalesce(meta[OBJECT_ID], F.lit(UNIDENTIFIED))


def write_objects(df: DataFrame, archive: str | Column, meta: dict[str, Column], *, order: list[str], images: list[tuple[Column, Column]] = (), object_meta: dict | None = None, acq_meta: dict | None = None, process_meta: dict | None = None, sample_meta: dict | None = None, index: str | Column = DEFAULT_INDEX, store_types: bool = True) -> DataFrame:
    """Writes archives with a line for each image of each row (or one line for a row without images); returns path and number of objects of each.

    ``archive`` and ``index`` may be columns; rows of one archive are written together in ``order`` wherever they came from. ``images`` are pairs of
    file name and encoded image, ranked from 1. Columns stand in the order given, those of the four further tables behind with their
    prefixes; with ``store_types`` a line of type marks follows the header. Files appear when they are complete.
    """
    columns = dict(meta)
    for name, prefix in PREFIXES.items():
        for k, v in (locals()[name] or {}).items():
            columns[k if k.startswith(prefix) else prefix + k] = v if isinstance(v, Column) else F.lit(v)
    archive = F.lit(archive) if isinstance(archive, str) else archive
    index = F.lit(index) if isinstance(index, str) else index
    names = list(columns)
    pictures = F.array(*(F.struct(n.alias("name"), i.alias("data")) for n, i in images)) if images else F.array().cast("array<struct<name:string,data:binary>>")
    src = df.select(archive.alias("a"), index.alias("x"), *(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), *(v.alias(f"m{i}") for i, v in enumerate(columns.values())), pictures.alias("p"))
    marks = [type_mark(src.schema[f"m{i}"].dataType) for i in range(len(names))]
    src = src.repartition("a").sortWithinPartitions("a", "x", *(f"o{i}" for i in range(len(order))))
    with_images = bool(images)

    def text(v) -> str:
        return "" if v is None else str(v)

    def run(rows):
        path, made, out, table, at, count = None, None, None, None, None, 0

        def close_table():
            out.write_member(at, table.getvalue().encode("utf-8"))

        def close():
            close_table()
            out.close()
            os.replace(made, path)
            return path, count

        for pdf in rows:
            for r in pdf.to_dict("records"):
                if r["a"] != path:
                    if path is not None:
                        yield pd.DataFrame([close()], columns=["archive", "n_objects"])
                    path, at, count = r["a"], None, 0
                    folder, base = os.path.split(path)
                    os.makedirs(folder or ".", exist_ok=True)
                    made = os.path.join(folder, f".{uuid.uuid4().hex}-{base}")
                    out = Archive(made, "w")
                if r["x"] != at:
                    if at is not None:
                        close_table()
                    at, table = r["x"], io.StringIO()
                    writer = csv.writer(table, delimiter="\t", lineterminator="\n")
                    header = [*names, *([FILE_NAME, RANK] if with_images else [])]
                    writer.writerow(header)
                    if store_types:
                        writer.writerow([*marks, *([TEXT, NUMBER] if with_images else [])])
                values = [text(None if x != x else x) for x in (r[f"m{i}"] for i in range(len(names)))]
                pictures = r["p"] if r["p"] is not None else []
                for rank, p in enumerate(pictures, 1):
                    out.write_member(p["name"], bytes(p["data"]), compress=False)
                    writer.writerow([*values, p["name"], rank])
                if not len(pictures):
                    writer.writerow([*values, *(["", ""] if with_images else [])])
                count += 1
        if path is not None:
            yield pd.DataFrame([close()], columns=["archive", "n_objects"])

    return src.mapInPandas(run, "archive string, n_objects long")
