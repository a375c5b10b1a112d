"""Loading delimited records while setting apart those that do not parse.

``scan_records`` runs a finite-state machine over the raw bytes of a batch of lines. The bytes are cut into
chunks of equal length that know nothing of each other: for every chunk the composed transition function (what
the chunk does to each of the four states) is found by a table-driven product over all chunks at once; a prefix
composition over the chunks then gives the state in which each chunk really starts, and a second pass writes
the state before every byte. A line break resets the machine, so each line is parsed by itself.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seston.runtime import join_sized, settle

#: States: at the start of a field, within a plain field, within quotes, after a quote within quotes.
START, PLAIN, QUOTED, CLOSING = range(4)
#: Classes of bytes: any other, the separator, the quote, the line break.
OTHER, SEP, QUOTE, BREAK = range(4)
#: The next state by class and state. A quote opens only at the start of a field; doubled within quotes it is a character.
STEP = np.array(
    [
        [PLAIN, PLAIN, QUOTED, PLAIN],
        [START, START, QUOTED, START],
        [QUOTED, PLAIN, CLOSING, QUOTED],
        [START, START, START, START],
    ],
    np.uint8,
)
CHUNK = 512


@lru_cache(1)
def _composition() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Functions on four states are packed in a byte, two bits a state: (function of each class, f then g, value)."""
    value = (np.arange(256)[:, None] >> (2 * np.arange(4))) & 3
    then = np.take_along_axis(np.broadcast_to(value[None], (256, 256, 4)), np.broadcast_to(value[:, None], (256, 256, 4)), 2)
    pack = (then << (2 * np.arange(4))).sum(2).astype(np.uint8)
    of_class = (STEP.astype(int) << (2 * np.arange(4))).sum(1).astype(np.uint8)
    return of_class, pack.reshape(-1), value.astype(np.uint8)


def machine_states(classes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """The state before each byte, the machine beginning in START."""
    n = len(classes)
    if n == 0:
        return np.zeros(0, np.uint8)
    of_class, then, value = _composition()
    rows = -(-n // chunk)
    grid = np.full(rows * chunk, BREAK, np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(rows, chunk).T)
    whole = np.full(rows, 0b11100100, np.uint8)  # the identity
    for k in range(chunk):
        whole = then[(whole.astype(np.uint16) << 8) | of_class[grid[k]]]
    span = 1  # prefix composition by doubling
    while span < rows:
        whole[span:] = then[(whole[:-span].astype(np.uint16) << 8) | whole[span:]]
        span *= 2
    state = np.zeros(rows, np.uint8)
    state[1:] = value[whole[:-1], START]
    out, table = np.empty((chunk, rows), np.uint8), STEP.reshape(-1)
    for k in range(chunk):
        out[k] = state
        state = table[(grid[k] << 2) | state]
    return np.ascontiguousarray(out.T).reshape(-1)[:n]


class Scan:
    """Field boundaries of a batch of lines."""

    def __init__(self, lines: pa.Array, sep: str = "|", quote: str = '"'):
        lines = pc.fill_null(lines.cast(pa.large_string()), "")
        raw = np.frombuffer(lines.buffers()[2] or b"", np.uint8)
        ends = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + len(lines) + 1]
        first = int(ends[0])
        size = np.diff(ends)
        # every line gets a break after it, so that it is parsed by itself; breaks within a line are characters
        self.begin = ends[:-1] - first + np.arange(len(lines))
        self.end = self.begin + size
        lookup = np.zeros(256, np.uint8)
        lookup[ord(sep)], lookup[ord(quote)] = SEP, QUOTE
        total = int(size.sum())
        at = np.arange(total) + np.repeat(np.arange(len(lines)), size)
        self.bytes = np.full(total + len(lines), 10, np.uint8)
        self.bytes[at] = raw[first : first + total]
        self.classes = np.full(total + len(lines), BREAK, np.uint8)
        self.classes[at] = lookup[raw[first : first + total]]
        self.states = machine_states(self.classes)
        self.final = self.states[self.end] if len(lines) else np.zeros(0, np.uint8)
        self.cuts = np.flatnonzero((self.classes == SEP) & (self.states != QUOTED))
        self.line_of_cut = np.searchsorted(self.begin, self.cuts, "right") - 1
        self.n_cuts = np.bincount(self.line_of_cut, minlength=len(lines))
        self.first_cut = np.r_[0, np.cumsum(self.n_cuts)[:-1]] if len(lines) else np.zeros(0, int)
        self.n = self.n_cuts + 1
        self.quote = ord(quote)

    def bounds(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of field ``k`` of each line (of which it must have one)."""
        cuts = np.r_[self.cuts, 0]
        a = np.where(k == 0, self.begin, cuts[np.clip(self.first_cut + k - 1, 0, len(cuts) - 1)] + 1)
        b = np.where(k == self.n - 1, self.end, cuts[np.clip(self.first_cut + k, 0, len(cuts) - 1)])
        return a, b

    def opening(self) -> np.ndarray:
        """Offset within the line of the quote left open, if any."""
        last, _ = self.bounds(self.n - 1)
        return last - self.begin

    def texts(self, a: np.ndarray, b: np.ndarray) -> pa.Array:
        """The byte ranges as strings, without the quotes around them and with doubled quotes single."""
        size = b - a
        ends = np.r_[0, np.cumsum(size)]
        at = np.repeat(a - ends[:-1], size) + np.arange(ends[-1])
        keep = np.ones(len(at), bool)
        is_quote = self.bytes[at] == self.quote
        if is_quote.any():
            # an opening quote stands before START, a closing or escaping one before QUOTED, the escaped one before CLOSING
            keep = ~(is_quote & np.isin(self.states[at], (START, QUOTED)))
            kept = np.r_[0, np.cumsum(keep)]
            ends = kept[ends]
        data = self.bytes[at][keep]
        return pa.Array.from_buffers(pa.large_string(), len(a), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])

    def rows(self) -> pa.Array:
        """All fields of each line as a list of strings."""
        a = np.sort(np.concatenate([self.begin, self.cuts + 1]))
        b = np.sort(np.concatenate([self.end, self.cuts]))
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(self.n)], pa.int32()), self.texts(a, b).cast(pa.string()))


INTEGER = r"^[ \t]*[+-]?0*[0-9]{1,10}[ \t]*$"


def to_int32(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(valid, value): digits 0-9 with an optional sign and surrounding blanks, within 32 bits."""
    plain = pc.match_substring_regex(texts, INTEGER)
    number = pc.utf8_trim(pc.if_else(plain, texts, "0"), " \t")
    number = pc.replace_substring_regex(number, r"^([+-]?)0*([0-9])", r"\1\2")
    number = pc.cast(pc.utf8_ltrim(number, "+"), pa.int64())
    value = number.to_numpy(zero_copy_only=False)
    ok = plain.to_numpy(zero_copy_only=False) & (value >= -(2**31)) & (value < 2**31)
    return ok, np.where(ok, value, 0)


def lst_headers(lines: DataFrame, file: str = "lst_name", number: str = "line_no", text: str = "line_text") -> DataFrame:
    """One row per file: n_fields and ``header``, the list of (name, type) in order, from its header lines.

    Lines may come in any order and repeatedly. A file without a readable line 2 has no row.
    """
    src = lines.select(F.col(file).alias("f"), F.col(number).alias("n"), F.col(text).alias("t"))
    count = src.filter("n = 2").select("f", F.regexp_extract("t", r"^\s*num-fields\s*\|\s*(\d{1,6})\s*$", 1).alias("c")).filter("c <> ''").groupBy("f").agg(F.max(F.col("c").cast("int")).alias("n_fields"))
    field = src.filter("n >= 3").select("f", "n", F.regexp_extract("t", r"^([^|\"]+)\|([A-Za-z][A-Za-z0-9]*)$", 1).alias("name"), F.regexp_extract("t", r"^([^|\"]+)\|([A-Za-z][A-Za-z0-9]*)$", 2).alias("type")).filter("name <> ''")
    named = field.join(count, "f").filter("n <= n_fields + 2").groupBy("f", "n_fields").agg(F.array_sort(F.collect_set(F.struct("n", "name", "type"))).alias("h"))
    full = count.join(named.select("f", "h"), "f", "left")
    return full.select(F.col("f").alias(file), "n_fields", F.coalesce("h", F.array().cast("array<struct<n:int,name:string,type:string>>")).alias("header"))


def split_records(lines: DataFrame, *, file: str = "lst_name", number: str = "line_no", text: str = "line_text", text_field: str = "collage_file", suffix: str = ".tif", int_fields: dict[str, int | None] | None = None, typed: bool = True) -> DataFrame:
    """Parse the records of ``|``-separated files with a header of their own.

    Returns one row per record line: file, number, ``reason`` (null if it parses), ``offset`` (byte of the line
    at which the reason lies), the checked fields as typed columns and, with ``typed``, ``fields``: a map of the
    file's own ``name|type`` to text, in the header's order (a header line that can't be read gives ``field_<place>|string``, a name that stands
    twice its place behind it). The operator parses each line by itself; header lines (the first n_fields + 2) and
    empty lines are no records. ``int_fields`` gives the least value allowed, None for any.

    Defined cases: a null text is an empty line; a file without header fails every line after the second with ``no_header``;
    a record of a file whose header lacks a checked field fails with ``<field>_missing``; repeated rows are
    parsed each; an empty table gives an empty result. Columns beyond the three named are ignored.
    """
    int_fields = {"image_x": 0, "image_w": 1} if int_fields is None else int_fields
    checked = [text_field, *int_fields]
    header = lst_headers(lines, file, number, text)
    place = [F.coalesce(F.expr(f"element_at(filter(header, h -> h.name = '{c}'), 1).n - 3"), F.lit(-1)).cast("int").alias(f"__at_{i}") for i, c in enumerate(checked)]
    # a header line that can't be read leaves a gap, which is named by its place
    by_place = F.map_from_entries(F.transform("header", lambda h: F.struct(h["n"], F.concat(h["name"], F.lit("|"), h["type"]))))
    gap = F.transform(F.sequence(F.lit(3), F.col("n_fields") + 2), lambda n: F.coalesce(F.try_element_at(by_place, n), F.concat(F.lit("field_"), (n - 2).cast("string"), F.lit("|string"))))
    names = [F.when(F.col("n_fields") > 0, gap).otherwise(F.array().cast("array<string>")).alias("__names")] if typed else []
    header = settle(header.select(F.col(file), "n_fields", *place, *names), "headers")
    src = lines.select(file, number, text).filter(F.length(text) > 0)
    src = join_sized(src, header, file, "left", factor=64.0)  # name lists are far larger than their dictionaries
    src = src.filter(F.col("n_fields").isNull() & (F.col(number) > 2) | (F.col(number) > F.col("n_fields") + 2))
    schema = T.StructType([lines.schema[file], lines.schema[number], T.StructField("reason", T.StringType()), T.StructField("offset", T.IntegerType()), T.StructField(text_field, T.StringType()), *(T.StructField(c, T.IntegerType()) for c in int_fields)])
    if typed:
        schema = schema.add("fields", T.MapType(T.StringType(), T.StringType()))
    least = list(int_fields.values())

    def parse(batches):
        for batch in batches:
            n = batch.num_rows
            if n:
                yield parse_batch(batch, n)

    def parse_batch(batch, n):
        scan = Scan(batch.column(text))
        want = pc.fill_null(batch.column("n_fields"), -1).to_numpy(zero_copy_only=False)
        reason, offset = np.full(n, None, object), np.zeros(n, np.int64)

        def fail(where, why, at):
            where = where & np.equal(reason, None)
            reason[where] = why
            offset[where] = np.broadcast_to(at, n)[where]

        last, _ = scan.bounds(np.minimum(np.maximum(want - 1, 0), scan.n - 1))
        fail(want < 0, "no_header", 0)
        fail(scan.final == QUOTED, "open_quote", scan.opening())
        fail(scan.n < want, "too_few_columns", scan.end - scan.begin)
        fail(scan.n > want, "too_many_columns", last - scan.begin)
        values = []
        for i, name in enumerate(checked):
            at = pc.fill_null(batch.column(f"__at_{i}"), -1).to_numpy(zero_copy_only=False)
            fail(at < 0, f"{name}_missing", 0)
            a, b = scan.bounds(np.clip(at, 0, scan.n - 1))
            texts = scan.texts(a, b)
            if i == 0:
                good = pc.ends_with(pc.utf8_lower(texts), suffix)
                fail(~good.to_numpy(zero_copy_only=False), f"{name}_suffix", a - scan.begin)
                values.append(texts.cast(pa.string()))
            else:
                ok, value = to_int32(texts)
                fail(~ok, f"{name}_not_int32", a - scan.begin)
                if least[i - 1] is not None:
                    fail(ok & (value < least[i - 1]), f"{name}_range", a - scan.begin)
                values.append(pa.array(value.astype(np.int32)))
        good = np.equal(reason, None)
        mask = pa.array(good)
        none = [pc.if_else(mask, v, pa.scalar(None, v.type)) for v in values]
        columns = [batch.column(file), batch.column(number), pa.array(reason, pa.string()), pa.array(np.where(good, 0, offset), pa.int32(), mask=good), *none]
        if typed:
            fields = scan.rows()
            names = batch.column("__names")
            fine = np.flatnonzero(good)
            keys, items = names.take(fine), fields.take(fine)
            ends = np.zeros(n + 1, np.int64)
            ends[1:][good] = pc.list_value_length(items).to_numpy(zero_copy_only=False) if len(fine) else 0
            columns.append(pa.MapArray.from_arrays(pa.array(np.cumsum(ends), pa.int32()), _unlike(keys), items.flatten()))
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    return src.mapInArrow(parse, schema)


def _unlike(keys: pa.Array) -> pa.Array:
    """The names of all rows one behind the other; a name that stands twice in a row gets its place behind it."""
    flat = keys.flatten()
    rows = np.repeat(np.arange(len(keys)), pc.list_value_length(keys).to_numpy(zero_copy_only=False).astype(np.int64))
    names = flat.dictionary_encode()
    code = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pair = rows * max(1, len(names.dictionary)) + code
    _, first = np.unique(pair, return_index=True)
    if len(first) == len(pair):
        return flat
    again = np.ones(len(pair), bool)
    again[first] = False
    place = np.arange(len(pair)) - np.searchsorted(rows, rows)
    texts = flat.to_pylist()
    for i in np.flatnonzero(again):
        name, _, kind = texts[i].partition("|")
        texts[i] = f"{name}_{place[i] + 1}|{kind}"
    return pa.array(texts, pa.string())


#: Spark types of the declared types. Fixed values; another type is taken as text.
TYPES = {"int32": "int", "double": "double", "string": "string", "guid": "string", "timestamp": "timestamp_ntz"}


def typed_records(parsed: DataFrame, fields: dict[str, str]) -> DataFrame:
    """The valid rows of ``split_records`` with ``fields`` (name: declared type) as columns, and ``failed``: the names of those whose text doesn't convert.

    Each file's own header counts: a field is taken where its file declares it with the stated type, and is null where it does not, or where the text is
    blank or does not convert.
    """
    keep = [c for c in parsed.columns[:2] if c not in fields]
    out, failed = [], []
    for n, t in fields.items():
        text = F.try_element_at("fields", F.lit(f"{n}|{t}"))
        kind = TYPES.get(t, "string")
        value = text if kind == "string" else F.trim(text).try_cast(kind)
        out.append(value.alias(n))
        failed.append(F.when(value.isNull() & (F.length(F.trim(text)) > 0), F.lit(n)))
    return parsed.filter("reason IS NULL").select(*keep, *out, F.array_compact(F.array(*failed)).alias("failed"))
