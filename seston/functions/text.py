"""Formatting values into texts and parsing texts by the same kind of pattern.

Patterns are those of ``str.format``. What has the same result in Spark's own functions (texts, integers) is compiled to them;
other values and specifications go through one Arrow function that calls ``str.format`` itself.
"""

from __future__ import annotations

import re
import string
import warnings
from collections.abc import Iterable, Mapping
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seston.functions.expressions import Typed, is_int, is_text, typed

_INT_SPEC = re.compile(r"^(0?)(\d*)d?$")
_TEXT_SPEC = re.compile(r"^([<>]?)(\d*)s?$")


def _native(value: Typed, conversion: str | None, spec: str) -> Column | None:
    """The field by built-in functions, None if they can't give what ``str.format`` gives."""
    if conversion:
        return None
    if is_int(value.kind) and (m := _INT_SPEC.match(spec)):
        zero, width = m.groups()
        text = value.col.cast("string")
        if not width:
            return text
        if not zero:
            return F.when(F.length(text) < int(width), F.lpad(text, int(width), " ")).otherwise(text)
        digits = F.when(value.col < 0, F.substring(text, 2, 30)).otherwise(text)
        room = F.lit(int(width)) - F.when(value.col < 0, 1).otherwise(0)
        return F.concat(F.when(value.col < 0, "-").otherwise(""), F.repeat(F.lit("0"), F.greatest(room - F.length(digits), F.lit(0)).cast("int")), digits)
    if is_text(value.kind) and (m := _TEXT_SPEC.match(spec)):
        side, width = m.groups()
        if not width:
            return value.col
        room = F.repeat(F.lit(" "), F.greatest(F.lit(int(width)) - F.length(value.col), F.lit(0)).cast("int"))
        return F.concat(room, value.col) if side == ">" else F.concat(value.col, room)
    return None


def format_text(df: DataFrame, fmt: str | Column, *args: Any, _args: Iterable = (), _kwargs: Mapping | None = None, **kwargs: Any) -> Column:
    """``fmt.format(*args, *_args, **{**_kwargs, **kwargs})`` with columns or literals as arguments; null is ``None``.

    ``fmt`` may be a column as well; each row is then formatted by its own.
    """
    places = [typed(df, a) for a in (*args, *_args)]
    names = {k: typed(df, v) for k, v in {**(_kwargs or {}), **kwargs}.items()}
    if isinstance(fmt, str):
        parts: list[Column] | None = []
        auto = 0
        for literal, field, spec, conversion in string.Formatter().parse(fmt):
            if literal:
                parts.append(F.lit(literal))
            if field is None:
                continue
            if not re.fullmatch(r"\d*|[A-Za-z_]\w*", field) or "{" in spec:
                parts = None
                break
            if not field:
                field, auto = str(auto), auto + 1
            value = places[int(field)] if field.isdigit() else names[field]
            made = _native(value, conversion, spec)
            if made is None:
                parts = None
                break
            parts.append(F.coalesce(made, F.lit("None")) if not spec else made)
        if parts is not None:
            return F.concat(*parts) if parts else F.lit("")
    n = len(places)
    keys = list(names)

    @F.pandas_udf("string")
    def form(pattern: pd.Series, values: pd.DataFrame) -> pd.Series:
        rows = zip(*(values[c].astype(object).where(values[c].notna(), None) for c in values.columns)) if len(values.columns) else (() for _ in pattern)
        return pd.Series([p.format(*r[:n], **dict(zip(keys, r[n : n + len(keys)]))) for p, r in zip(pattern, rows)], dtype=object)

    pattern = F.lit(fmt) if isinstance(fmt, str) else fmt
    whole = [*(p.col.alias(f"p{i}") for i, p in enumerate(places)), *(v.col.alias(f"k{i}") for i, v in enumerate(names.values())), F.lit(0).alias("none")]
    return form(pattern, F.struct(*whole))


class ParseWarning(UserWarning):
    """The pattern names no field, so that parsing gives nothing."""


#: Types of a parsed field: regular expression and Spark type. Fixed values of the parse-pattern syntax.
FIELD_TYPES: dict[str, tuple[str, str]] = {
    "": (r".+?", "string"),
    "s": (r".+?", "string"),
    "d": (r"[-+]?\d+", "bigint"),
    "n": (r"[-+]?\d{1,3}(?:[.,]\d{3})*", "bigint"),
    "f": (r"[-+]?\d*\.\d+", "double"),
    "g": (r"[-+]?(?:\d+(?:\.\d+)?(?:[eE][-+]?\d+)?|nan|NAN|inf|INF)", "double"),
    "e": (r"[-+]?\d*\.\d+[eE][-+]?\d+|nan|NAN|inf|INF", "double"),
    "w": (r"\w+", "string"),
    "W": (r"\W+", "string"),
    "l": (r"[A-Za-z]+", "string"),
    "D": (r"\D+", "string"),
    "S": (r"\S+", "string"),
    "greedy": (r".*", "string"),
}
_WIDE = re.compile(r"^(?:(.)?([<>^]))?(0?)(\d*)(?:\.(\d+))?(greedy|[a-zA-Z]?)$")


def compile_parse(fmt: str, case_sensitive: bool = False) -> tuple[str, list[tuple[str, int, str]], bool]:
    """(anchored regular expression, [(field, group, type)], whether the pattern names a field)."""
    out, fields, group, names = ["^"], [], 0, {}
    for literal, field, spec, _ in string.Formatter().parse(fmt):
        out.append("".join(f"\\{c}" if not (c.isalnum() or c.isspace() or c == "_" or ord(c) > 127) else c for c in literal))
        if field is None:
            continue
        m = _WIDE.match(spec or "")
        if m is None or m[6] not in FIELD_TYPES:
            raise ValueError(f"unknown field type {spec!r}")
        pattern, kind = FIELD_TYPES[m[6]]
        if m[4] and m[6] in ("", "s", "w", "l"):
            pattern = rf".{{{m[4]},}}?" if m[6] in ("", "s") else pattern[:-1] + f"{{{m[4]},}}"
        elif m[4] and m[6] == "d":
            pattern = rf"[-+ ]?[ 0]*\d+" if m[3] or not m[2] else rf" *{pattern} *"
        name = re.sub(r"\W", "_", field)
        if name and not name[0].isdigit() and name in names:
            out.append(f"\\{names[name]}")
            continue
        group += 1
        aligned = {"<": rf"({pattern})\s*", ">": rf"\s*({pattern})", "^": rf"\s*({pattern})\s*"}
        out.append(aligned[m[2]] if m[2] and m[6] != "d" else f"({pattern})")
        if name and not name[0].isdigit():
            names[name] = group
            fields.append((field, group, kind))
    return ("(?s)" if case_sensitive else "(?is)") + "".join(out) + "$", fields, bool(fields)


def parse_text(df: DataFrame, fmt: str | Column, text: Column, case_sensitive: bool = False, *, names: dict[str, str] | None = None) -> Column:
    """The named fields of ``text`` by ``fmt`` as a struct (string, bigint or double), null of a null text.

    The whole text must match, whatever its case unless ``case_sensitive``; a text that does not is an error. Unnamed fields match but
    aren't returned, and a pattern without named fields warns. ``fmt`` may be a column; then ``names`` (field: type) states the result,
    and each distinct pattern is compiled once in a worker.
    """
    if isinstance(fmt, str):
        pattern, fields, named = compile_parse(fmt, case_sensitive)
        if not named:
            warnings.warn(f"{fmt!r} names no field", ParseWarning, stacklevel=2)
        fail = F.raise_error(F.concat(F.lit(f"no match of {fmt!r}: "), text))
        ok = F.when(F.regexp_like(text, F.lit(pattern)), text).when(text.isNotNull(), fail.cast("string"))

        def part(group: int, kind: str) -> Column:
            got = F.regexp_extract(ok, pattern, group)
            if kind == "bigint":
                got = F.regexp_replace(got, "[ .,]", "")
            return got.cast(kind)

        whole = F.struct(*(part(g, k).alias(n) for n, g, k in fields)) if fields else F.struct(F.lit(None).cast("string").alias("_"))
        return F.when(ok.isNotNull(), whole)
    if not names:
        raise ValueError("a pattern in a column needs the names and types of its fields")
    schema = T.StructType([T.StructField(n, {"bigint": T.LongType(), "double": T.DoubleType()}.get(k, T.StringType())) for n, k in names.items()])

    @F.pandas_udf(schema)
    def parse(pattern: pd.Series, values: pd.Series) -> pd.DataFrame:
        compiled: dict = {}
        rows = []
        for p, v in zip(pattern, values):
            if p not in compiled:
                regex, fields, _ = compile_parse(p, case_sensitive)
                compiled[p] = re.compile(regex), fields
            regex, fields = compiled[p]
            found = regex.match(v) if v is not None else None
            if v is not None and found is None:
                raise ValueError(f"no match of {p!r}: {v}")
            got = {n: found[g] for n, g, _ in fields} if found else {}
            rows.append([got.get(n) if k == "string" or got.get(n) is None else int(re.sub("[ .,]", "", got[n])) if k == "bigint" else float(got[n]) for n, k in names.items()])
        return pd.DataFrame(rows, columns=list(names))

    return parse(fmt, text)
