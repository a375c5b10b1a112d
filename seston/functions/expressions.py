"""Python's operators on Columns, with Python's results.

Every function takes and gives ``Typed``: a Column with its Spark type, on which the meaning of an operator depends (``+`` adds numbers
and joins strings and arrays). ``typed`` makes one of a column of a DataFrame or of a literal. All of it stays built-in
expressions, so Catalyst can push down, prune and compile.

Where Spark differs from Python: null stands for None and passes through arithmetic, indexing and ordering as null, while ``eq``
and ``ne`` take two nulls as equal; integers have 64 bits and overflow is an error; an index or key that does not exist is an
error, a slice is cut to what is there.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATS = (T.FloatType, T.DoubleType, T.DecimalType)


class Typed(NamedTuple):
    col: Column
    kind: T.DataType


class ExpressionError(TypeError):
    """The operator has no meaning for operands of these types."""


def typed(df: DataFrame, x: Any) -> Typed:
    """``x``: a Typed (as it is), a Column of ``df``, or a literal; lists, tuples and dicts may hold any of these."""
    if isinstance(x, Typed):
        return x
    if isinstance(x, dict):
        parts = [(F.lit(k), typed(df, v)) for k, v in x.items()]
        x = F.create_map(*(c for k, v in parts for c in (k, v.col))) if parts else F.create_map()
    elif isinstance(x, list):
        x = F.array(*(typed(df, v).col for v in x))
    elif isinstance(x, tuple):
        x = F.struct(*(typed(df, v).col.alias(f"_{i}") for i, v in enumerate(x)))
    elif not isinstance(x, Column):
        x = F.lit(x)
    return Typed(x, df.select(x.alias("x")).schema["x"].dataType)


def is_int(t: T.DataType) -> bool:
    return isinstance(t, INTEGERS)


def is_number(t: T.DataType) -> bool:
    return isinstance(t, INTEGERS + FLOATS)


def is_bool(t: T.DataType) -> bool:
    return isinstance(t, T.BooleanType)


def is_text(t: T.DataType) -> bool:
    return isinstance(t, T.StringType)


def is_array(t: T.DataType) -> bool:
    return isinstance(t, T.ArrayType)


def _number(x: Typed, op: str) -> Typed:
    """Integers as 64 bits, booleans as 0 and 1, as Python counts them."""
    if is_bool(x.kind) or is_int(x.kind):
        return Typed(x.col.cast("long"), T.LongType())
    if isinstance(x.kind, FLOATS):
        return Typed(x.col.cast("double"), T.DoubleType())
    raise ExpressionError(f"{op} of {x.kind.simpleString()}")


def _arith(op: str, ints: Callable[[Column, Column], Column], floats: Callable[[Column, Column], Column]) -> Callable[[Typed, Typed], Typed]:
    def apply(a: Typed, b: Typed) -> Typed:
        a, b = _number(a, op), _number(b, op)
        if is_int(a.kind) and is_int(b.kind):
            return Typed(ints(a.col, b.col), T.LongType())
        return Typed(floats(a.col.cast("double"), b.col.cast("double")), T.DoubleType())

    apply.__name__ = op
    return apply


_plus = _arith("add", lambda a, b: a + b, lambda a, b: a + b)
_times = _arith("mul", lambda a, b: a * b, lambda a, b: a * b)
sub = _arith("sub", lambda a, b: a - b, lambda a, b: a - b)


def add(a: Typed, b: Typed) -> Typed:
    if is_text(a.kind) and is_text(b.kind) or is_array(a.kind) and is_array(b.kind):
        return Typed(F.concat(a.col, b.col), a.kind)
    return _plus(a, b)


def mul(a: Typed, b: Typed) -> Typed:
    if is_text(b.kind) or is_array(b.kind):
        a, b = b, a
    if is_text(a.kind) and is_int(b.kind):
        return Typed(F.repeat(a.col, F.greatest(b.col, F.lit(0)).cast("int")), a.kind)
    if is_array(a.kind) and is_int(b.kind):
        return Typed(F.flatten(F.array_repeat(a.col, F.greatest(b.col, F.lit(0)).cast("int"))), a.kind)
    return _times(a, b)


def truediv(a: Typed, b: Typed) -> Typed:
    """Always a double; division by zero is an error under ANSI mode."""
    return Typed(_number(a, "truediv").col.cast("double") / _number(b, "truediv").col.cast("double"), T.DoubleType())


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


#: Rounds to minus infinity; the remainder has the sign of the divisor.
floordiv = _arith("floordiv", lambda a, b: _div(a, b) - F.when((a % b != 0) & ((a < 0) != (b < 0)), 1).otherwise(0), lambda a, b: F.floor((a - ((a % b + b) % b)) / b + 0.5).cast("double"))
mod = _arith("mod", lambda a, b: F.when((a % b != 0) & ((a < 0) != (b < 0)), a % b + b).otherwise(a % b), lambda a, b: F.when((a % b != 0) & ((a < 0) != (b < 0)), a % b + b).otherwise(a % b))


def _int_pow(a: Column, b: Column) -> Column:
    """Exact, by multiplication; an overflow or a negative exponent is an error. Of the bases that any exponent leaves small no product is built."""
    small = F.when(a == 0, F.when(b == 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))).when(a == 1, F.lit(1).cast("long")).otherwise(F.when(b % 2 == 0, F.lit(1).cast("long")).otherwise(F.lit(-1).cast("long")))
    product = F.aggregate(F.array_repeat(a, F.least(b, F.lit(64)).cast("int")), F.lit(1).cast("long"), lambda acc, x: acc * x)
    return F.when(b < 0, F.raise_error(F.lit("negative exponent of an integer; cast the base to double")).cast("long")).when(a.between(-1, 1), small).when(b.isNotNull() & a.isNotNull(), product)


pow_ = _arith("pow", _int_pow, lambda a, b: F.pow(a, b))


def matmul(a: Typed, b: Typed) -> Typed:
    """Vector by vector gives a number, matrix (array of rows) by vector a vector, matrix by matrix a matrix."""
    if not (is_array(a.kind) and is_array(b.kind)):
        raise ExpressionError("matmul needs arrays")

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.when(F.size(x) == F.size(y), F.aggregate(products, F.lit(0.0), lambda s, v: s + v)).otherwise(F.raise_error(F.lit("matmul of vectors of different lengths")).cast("double"))

    rows, cols = is_array(a.kind.elementType), is_array(b.kind.elementType)
    columns = F.transform(F.sequence(F.lit(0), F.size(F.get(b.col, F.lit(0))) - 1), lambda j: F.transform(b.col, lambda r: F.get(r, j))) if cols else None
    vector, matrix = T.ArrayType(T.DoubleType()), T.ArrayType(T.ArrayType(T.DoubleType()))
    if rows and cols:
        return Typed(F.transform(a.col, lambda r: F.transform(columns, lambda c: dot(r, c))), matrix)
    if rows:
        return Typed(F.transform(a.col, lambda r: dot(r, b.col)), vector)
    if cols:
        return Typed(F.transform(columns, lambda c: dot(a.col, c)), vector)
    return Typed(dot(a.col, b.col), T.DoubleType())


def _ints(op: str, f: Callable[[Column, Column], Column], bools: Callable[[Column, Column], Column] | None = None) -> Callable[[Typed, Typed], Typed]:
    def apply(a: Typed, b: Typed) -> Typed:
        if bools is not None and is_bool(a.kind) and is_bool(b.kind):
            return Typed(bools(a.col, b.col), T.BooleanType())
        a, b = _number(a, op), _number(b, op)
        if not (is_int(a.kind) and is_int(b.kind)):
            raise ExpressionError(f"{op} needs integers")
        return Typed(f(a.col, b.col), T.LongType())

    apply.__name__ = op
    return apply


def _shift_by(b: Column) -> Column:
    return F.when(b < 0, F.raise_error(F.lit("negative shift count")).cast("int")).otherwise(F.least(b, F.lit(63)).cast("int"))


def _left(a: Column, b: Column) -> Column:
    shifted = F.call_function("shiftleft", a, _shift_by(b))
    fits = (F.call_function("shiftright", shifted, _shift_by(b)) == a) & (b < 64)
    return F.when(a == 0, a).when(fits, shifted).when(a.isNotNull() & b.isNotNull(), F.raise_error(F.lit("shift beyond 64 bits")).cast("long"))


lshift = _ints("lshift", _left)
rshift = _ints("rshift", lambda a, b: F.call_function("shiftright", a, _shift_by(b)))
and_ = _ints("and", lambda a, b: a.bitwiseAND(b), lambda a, b: a & b)
or_ = _ints("or", lambda a, b: a.bitwiseOR(b), lambda a, b: a | b)
xor = _ints("xor", lambda a, b: a.bitwiseXOR(b), lambda a, b: a != b)


def neg(a: Typed) -> Typed:
    a = _number(a, "neg")
    return Typed(-a.col, a.kind)


def pos(a: Typed) -> Typed:
    return _number(a, "pos")


def abs_(a: Typed) -> Typed:
    a = _number(a, "abs")
    return Typed(F.abs(a.col), a.kind)


def invert(a: Typed) -> Typed:
    """Of an integer its complement; of a boolean its opposite, as for masks."""
    if is_bool(a.kind):
        return Typed(~a.col, a.kind)
    a = _number(a, "invert")
    if not is_int(a.kind):
        raise ExpressionError("invert needs an integer or boolean")
    return Typed(F.bitwise_not(a.col), a.kind)


def _compare(op: str, f: Callable[[Column, Column], Column]) -> Callable[[Typed, Typed], Typed]:
    def apply(a: Typed, b: Typed) -> Typed:
        if is_text(a.kind) != is_text(b.kind) and not {type(a.kind), type(b.kind)} & {T.NullType}:
            raise ExpressionError(f"{op} of {a.kind.simpleString()} and {b.kind.simpleString()}")
        out = f(a.col, b.col)
        for x in (a, b):
            if isinstance(x.kind, (T.FloatType, T.DoubleType)):  # nothing is ordered before or after NaN
                out = out & ~F.isnan(x.col)
        return Typed(out, T.BooleanType())

    apply.__name__ = op
    return apply


lt, le = _compare("lt", lambda a, b: a < b), _compare("le", lambda a, b: a <= b)
gt, ge = _compare("gt", lambda a, b: a > b), _compare("ge", lambda a, b: a >= b)


def eq(a: Typed, b: Typed) -> Typed:
    """Two nulls are equal, NaN equals nothing, and a text never equals a number."""
    if is_text(a.kind) != is_text(b.kind) and not {type(a.kind), type(b.kind)} & {T.NullType}:
        return Typed(a.col.isNull() & b.col.isNull(), T.BooleanType())
    out = a.col.eqNullSafe(b.col)
    for x in (a, b):
        if isinstance(x.kind, (T.FloatType, T.DoubleType)):
            out = out & F.coalesce(~F.isnan(x.col), F.lit(True))
    return Typed(out, T.BooleanType())


def ne(a: Typed, b: Typed) -> Typed:
    return Typed(~eq(a, b).col, T.BooleanType())


def truth(a: Typed) -> Typed:
    """What ``bool`` gives: false for null, false, zero and what is empty; NaN is true."""
    if isinstance(a.kind, T.NullType):
        return Typed(F.lit(False), T.BooleanType())
    if is_bool(a.kind):
        out = a.col
    elif is_number(a.kind):
        out = a.col != 0
    elif is_text(a.kind) or isinstance(a.kind, T.BinaryType):
        out = F.length(a.col) > 0
    elif isinstance(a.kind, (T.ArrayType, T.MapType)):
        out = F.size(a.col) > 0
    else:
        out = a.col.isNotNull()
    return Typed(F.coalesce(out, F.lit(False)), T.BooleanType())


def not_(a: Typed) -> Typed:
    return Typed(~truth(a).col, T.BooleanType())


def is_(a: Typed, b: Typed) -> Typed:
    """Identity has a meaning for None alone."""
    for x, y in ((a, b), (b, a)):
        if isinstance(y.kind, T.NullType):
            return Typed(x.col.isNull() if not isinstance(x.kind, T.NullType) else F.lit(True), T.BooleanType())
    raise ExpressionError("identity of values: only None has one")


def is_not(a: Typed, b: Typed) -> Typed:
    return Typed(~is_(a, b).col, T.BooleanType())


def contains(a: Typed, b: Typed) -> Typed:
    """Whether ``a`` holds ``b``: an array an element (null included), a map a key, a text a part of it."""
    if is_array(a.kind):
        out = F.exists(a.col, lambda x: x.eqNullSafe(b.col))
    elif isinstance(a.kind, T.MapType):
        out = F.map_contains_key(a.col, b.col)
    elif is_text(a.kind):
        out = F.contains(a.col, b.col)
    elif isinstance(a.kind, T.StructType):
        out = F.array_contains(F.array(*(a.col[f.name].cast("string") for f in a.kind.fields)), b.col.cast("string"))
    else:
        raise ExpressionError(f"membership in {a.kind.simpleString()}")
    return Typed(out, T.BooleanType())


def in_(a: Typed, b: Typed) -> Typed:
    return contains(b, a)


def _from_start(k: Column, n: Column) -> Column:
    """A 0-based index of which negative ones count from the end, checked."""
    at = F.when(k < 0, k + n).otherwise(k).cast("int")
    return F.when((at >= 0) & (at < n), at).when(k.isNotNull() & n.isNotNull(), F.raise_error(F.lit("index out of range")).cast("int"))


def getitem(a: Typed, k: Any) -> Typed:
    """``a[k]``; ``k`` is a Typed, or of a struct a field name or place. Slices are taken by ``getslice``."""
    if isinstance(a.kind, T.StructType):
        name = a.kind.fields[k].name if isinstance(k, int) else k
        if not isinstance(name, str):
            raise ExpressionError("a field is taken by a literal name or place")
        return Typed(a.col.getField(name), a.kind[name].dataType)
    if is_array(a.kind):
        return Typed(F.get(a.col, _from_start(k.col, F.size(a.col))), a.kind.elementType)
    if is_text(a.kind):
        return Typed(F.substring(a.col, _from_start(k.col, F.length(a.col)) + 1, F.lit(1)), a.kind)
    if isinstance(a.kind, T.MapType):
        missing = F.raise_error(F.concat(F.lit("key not found: "), k.col.cast("string"))).cast(a.kind.valueType)
        return Typed(F.when(F.map_contains_key(a.col, k.col), a.col[k.col]).when(a.col.isNotNull(), missing), a.kind.valueType)
    raise ExpressionError(f"{a.kind.simpleString()} has no items")


def getslice(a: Typed, start: int | None = None, stop: int | None = None, step: int | None = None) -> Typed:
    """``a[start:stop:step]`` of an array or text, cut to what is there."""
    step = 1 if step is None else step
    if step == 0:
        raise ValueError("slice step cannot be zero")
    if is_text(a.kind) and step != 1:
        parts = Typed(F.filter(F.split(a.col, ""), lambda c: c != ""), T.ArrayType(T.StringType()))
        return Typed(F.array_join(getslice(parts, start, stop, step).col, ""), a.kind)
    if not (is_text(a.kind) or is_array(a.kind)):
        raise ExpressionError(f"{a.kind.simpleString()} has no slices")
    n = F.length(a.col) if is_text(a.kind) else F.size(a.col)

    def bound(x: int | None, default: Column, low: int, high: Column) -> Column:
        at = default if x is None else F.lit(x) if x >= 0 else n + x
        return F.greatest(F.lit(low), F.least(at, high))

    if step > 0:
        i, j = bound(start, F.lit(0), 0, n), bound(stop, n, 0, n)
    else:
        i, j = bound(start, n - 1, -1, n - 1), bound(stop, F.lit(-1), -1, n - 1)
    if is_text(a.kind):
        return Typed(F.substring(a.col, i + 1, F.greatest(j - i, F.lit(0))), a.kind)
    if step == 1:
        return Typed(F.when(j > i, F.slice(a.col, i + 1, F.greatest(j - i, F.lit(0)))).when(a.col.isNotNull(), F.slice(a.col, F.lit(1), F.lit(0))), a.kind)
    places = F.sequence(i, j - (1 if step > 0 else -1), F.lit(step))
    none = (j <= i) if step > 0 else (j >= i)
    return Typed(F.when(none, F.slice(a.col, F.lit(1), F.lit(0))).otherwise(F.transform(places, lambda p: F.get(a.col, p))), a.kind)


def setitem(a: Typed, k: Any, v: Typed) -> Typed:
    """A copy of ``a`` in which ``k`` is ``v``; nothing is changed in place. A text is not changed."""
    if isinstance(a.kind, T.StructType):
        fields = [T.StructField(f.name, v.kind) if f.name == k else f for f in a.kind.fields]
        return Typed(a.col.withField(k, v.col), T.StructType(fields if k in a.kind.names else [*fields, T.StructField(k, v.kind)]))
    if is_array(a.kind):
        at = _from_start(k.col, F.size(a.col))
        return Typed(F.transform(a.col, lambda x, i: F.when(i == at, v.col.cast(a.kind.elementType)).otherwise(x)), a.kind)
    if isinstance(a.kind, T.MapType):
        rest = F.map_filter(a.col, lambda key, _: key != k.col)
        return Typed(F.map_concat(rest, F.create_map(k.col.cast(a.kind.keyType), v.col.cast(a.kind.valueType))), a.kind)
    raise ExpressionError(f"{a.kind.simpleString()} has no items to set")


def delitem(a: Typed, k: Any) -> Typed:
    """A copy of ``a`` without ``k``."""
    if isinstance(a.kind, T.StructType):
        if k not in a.kind.names:
            raise KeyError(k)
        return Typed(a.col.dropFields(k), T.StructType([f for f in a.kind.fields if f.name != k]))
    if is_array(a.kind):
        at = _from_start(k.col, F.size(a.col))
        return Typed(F.filter(a.col, lambda _, i: i != at), a.kind)
    if isinstance(a.kind, T.MapType):
        there = F.when(F.map_contains_key(a.col, k.col), a.col).when(a.col.isNotNull(), F.raise_error(F.lit("key not found")).cast(a.kind))
        return Typed(F.map_filter(there, lambda key, _: key != k.col), a.kind)
    raise ExpressionError(f"{a.kind.simpleString()} has no items to delete")


def attribute(a: Typed, name: str) -> Typed:
    """A field of a struct; of a map the value of a key."""
    if isinstance(a.kind, T.MapType):
        return getitem(a, Typed(F.lit(name), T.StringType()))
    return getitem(a, name)


def unpack(a: Typed, size: int) -> list[Typed]:
    """The ``size`` parts of an array or struct as columns; another length is an error."""
    if isinstance(a.kind, T.StructType):
        if len(a.kind.fields) != size:
            raise ValueError(f"{len(a.kind.fields)} values to unpack, {size} expected")
        return [getitem(a, i) for i in range(size)]
    whole = F.when(F.size(a.col) == size, a.col).when(a.col.isNotNull(), F.raise_error(F.lit(f"not {size} values to unpack")).cast(a.kind))
    return [Typed(F.get(whole, F.lit(i)), a.kind.elementType) for i in range(size)]


def merge(a: Typed, b: Typed) -> Typed:
    """Two maps or structs as one; of a key in both the right one's value holds."""
    if isinstance(a.kind, T.MapType):
        return Typed(F.map_concat(F.map_filter(a.col, lambda k, _: ~F.coalesce(F.map_contains_key(b.col, k), F.lit(False))), F.coalesce(b.col, F.create_map().cast(a.kind))), a.kind)
    fields = {f.name: (x, f) for x in (a, b) for f in x.kind.fields}
    return Typed(F.struct(*(x.col.getField(n).alias(n) for n, (x, _) in fields.items())), T.StructType([f for _, f in fields.values()]))


#: Operators by name, for plans that are put together from names.
BINARY = {f.__name__.rstrip("_"): f for f in (add, sub, mul, matmul, truediv, floordiv, mod, pow_, lshift, rshift, and_, or_, xor, lt, le, gt, ge, eq, ne, is_, is_not, contains, in_)} | {"pow": pow_}
UNARY = {f.__name__.rstrip("_"): f for f in (neg, pos, abs_, invert, truth, not_)}


def apply(df: DataFrame, op: str, *args: Any) -> Column:
    """The operator of this name on columns of ``df`` and literals."""
    return (BINARY.get(op) or UNARY[op])(*(typed(df, a) for a in args)).col
