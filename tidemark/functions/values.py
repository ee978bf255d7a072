"""Typed columns: what compiled expressions are made of, and how kinds compare and convert.

A Value is a Column with a kind (null, bool, int, double, string, datetime, timespan, binary, any,
array, map, struct, variant, regex, type). ``any`` is the tagged value of telemetry attributes: a
struct of a type tag and one active field; the other fields are null, so structs compare as values.
Timespans are longs in microseconds. Two-valued logic throughout: a comparison is never null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.syntax import QueryError

# Tags of attribute values.
EMPTY, STR, INT, DOUBLE, BOOL, MAP, SLICE, BYTES = range(8)

ANY_VALUE = T.StructType(
    [
        T.StructField("type", T.ByteType()),
        T.StructField("str", T.StringType()),
        T.StructField("int", T.LongType()),
        T.StructField("double", T.DoubleType()),
        T.StructField("bool", T.BooleanType()),
        T.StructField("bytes", T.BinaryType()),
        T.StructField("ser", T.BinaryType()),
    ]
)
ATTRIBUTES = T.MapType(T.StringType(), ANY_VALUE)


@dataclass(frozen=True)
class Value:
    col: Column
    kind: str
    dtype: T.DataType | None = None
    constant: object = None  # of literals

    @property
    def is_number(self) -> bool:
        return self.kind in ("int", "double")


def is_any(dtype: T.DataType) -> bool:
    """Whether a type is the tagged value's, whatever its fields' nullability."""
    return isinstance(dtype, T.StructType) and dtype.fieldNames() == ANY_VALUE.fieldNames()


def kind_of(dtype: T.DataType) -> str:
    if is_any(dtype):
        return "any"
    by_type = (
        (T.BooleanType, "bool"), (T.StringType, "string"), (T.BinaryType, "binary"), (T.TimestampType, "datetime"), (T.TimestampNTZType, "datetime"),
        (T.DateType, "datetime"), (T.ArrayType, "array"), (T.MapType, "map"), (T.StructType, "struct"), (T.VariantType, "variant"), (T.NullType, "null"),
        (T.DoubleType, "double"), (T.FloatType, "double"), (T.DecimalType, "double"), (T.IntegralType, "int"),
    )
    return next((kind for t, kind in by_type if isinstance(dtype, t)), "unknown")


def typed(col: Column, dtype: T.DataType) -> Value:
    """A column of a frame; numbers are widened to long or double."""
    kind = kind_of(dtype)
    if kind == "int" and not isinstance(dtype, T.LongType):
        col = col.cast("long")
    elif kind == "double" and not isinstance(dtype, T.DoubleType):
        col = col.cast("double")
    elif kind == "datetime" and not isinstance(dtype, T.TimestampType):
        col = col.cast("timestamp")
    return Value(col, kind, dtype)


def literal(value: object, kind: str) -> Value:
    if kind == "datetime":
        return Value(F.lit(value).cast("timestamp"), "datetime", constant=value)
    if kind == "timespan":
        return Value(F.lit(value).cast("long"), "timespan", constant=value)
    if kind in ("regex", "type"):
        return Value(F.lit(value), kind, constant=value)
    cast = {"int": "long", "double": "double", "string": "string", "bool": "boolean"}.get(kind)
    if value is None:
        return Value(F.lit(None).cast(cast) if cast else F.lit(None), kind if cast else "null")
    return Value(F.lit(value).cast(cast), kind, constant=value)



def null() -> Value:
    return Value(F.lit(None), "null")


# the tagged value


def wrap(v: Value) -> Column:
    """A value as a tagged value; null stays null."""
    if v.kind == "any":
        return v.col
    fields = {"string": (STR, "str"), "int": (INT, "int"), "double": (DOUBLE, "double"), "bool": (BOOL, "bool"), "binary": (BYTES, "bytes"), "timespan": (INT, "int")}
    col = v.col
    if v.kind == "datetime":
        tag, name, col = STR, "str", v.col.cast("string")
    elif v.kind == "null":
        return F.lit(None).cast(ANY_VALUE)
    elif v.kind in fields:
        tag, name = fields[v.kind]
    else:
        raise QueryError(f"a {v.kind} can't be an attribute's value")
    parts = [F.lit(tag).cast("byte").alias("type")]
    parts += [(col if f.name == name else F.lit(None)).cast(f.dataType).alias(f.name) for f in ANY_VALUE.fields[1:]]
    return F.when(col.isNotNull(), F.struct(*parts))


def tag(v: Value) -> Column:
    """The tag of a tagged value; null, empty and without its active field are all EMPTY."""
    active = F.coalesce(v.col["str"].isNotNull(), F.lit(False))
    for name in ("int", "double", "bool", "bytes", "ser"):
        active = active | v.col[name].isNotNull()
    return F.when(v.col.isNotNull() & active, v.col["type"].cast("int")).otherwise(F.lit(EMPTY))


def is_null(v: Value) -> Column:
    return tag(v) == EMPTY if v.kind == "any" else F.lit(True) if v.kind == "null" else v.col.isNull()


def unwrap(v: Value, kind: str) -> Column:
    """The tagged value's content of a kind; null where it is of another."""
    c = v.col
    if kind == "double":
        return F.coalesce(c["double"], c["int"].cast("double"))
    names = {"string": "str", "int": "int", "bool": "bool", "binary": "bytes"}
    if kind not in names:
        raise QueryError(f"an attribute has no {kind} form")
    return c[names[kind]]


def to_string(v: Value) -> Column:
    """The value's text; null stays null."""
    if v.kind == "any":
        c = v.col
        return F.coalesce(c["str"], c["int"].cast("string"), c["double"].cast("string"), c["bool"].cast("string"), F.base64(c["bytes"]))
    if v.kind == "variant":
        return F.coalesce(F.try_variant_get(v.col, "$", "string"), F.to_json(v.col))
    if v.kind in ("array", "map", "struct"):
        return F.to_json(v.col)
    if v.kind == "binary":
        return F.decode(v.col, F.lit("UTF-8"))
    return v.col.cast("string")


def to_int(v: Value) -> Column:
    if v.kind == "any":
        return F.coalesce(v.col["int"], v.col["double"].try_cast("long"), v.col["str"].try_cast("long"), v.col["bool"].cast("long"))
    if v.kind == "datetime":
        return F.unix_micros(v.col) * 10
    return v.col.try_cast("long")


def to_double(v: Value) -> Column:
    if v.kind == "any":
        return F.coalesce(v.col["double"], v.col["int"].cast("double"), v.col["str"].try_cast("double"))
    return v.col.cast("double") if v.is_number else to_string(v).try_cast("double")


def to_bool(v: Value) -> Column:
    if v.kind == "any":
        return F.coalesce(v.col["bool"], v.col["str"].try_cast("boolean"), v.col["int"].cast("boolean"))
    return v.col.try_cast("boolean") if v.kind != "bool" else v.col


DATE_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]", "yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy-MM-dd", "M/d/yyyy H:mm:ss", "M/d/yyyy")


def to_datetime(v: Value) -> Column:
    if v.kind == "datetime":
        return v.col
    text = to_string(v)
    return F.coalesce(F.try_to_timestamp(text), *(F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS))


def to_timespan(v: Value) -> Column:
    """Microseconds of a number of ticks or of [-][d.]hh:mm:ss[.fraction]."""
    if v.kind == "timespan":
        return v.col
    if v.is_number:
        return (v.col.cast("double") / 10).cast("long")
    text = to_string(v)
    part = lambda g: F.regexp_extract(text, r"^(-?)(?:(\d+)\.)?(\d+):(\d+):(\d+(?:\.\d+)?)$", g)
    n = lambda g: F.coalesce(part(g).try_cast("double"), F.lit(0.0))
    span = ((n(2) * 86400 + n(3) * 3600 + n(4) * 60 + n(5)) * 1_000_000).cast("long")
    return F.when(text.rlike(r"^-?(?:\d+\.)?\d+:\d+:\d+(?:\.\d+)?$"), F.when(part(1) == "-", -span).otherwise(span))


# comparison


def _common(a: Value, b: Value) -> tuple[Column, Column] | None:
    """Both sides in one comparable form; None if the kinds never match."""
    if a.kind == b.kind and a.kind not in ("any", "map", "variant"):
        return a.col, b.col
    if a.is_number and b.is_number:
        return a.col.cast("double"), b.col.cast("double")
    if a.kind == b.kind == "any":
        return a.col, b.col
    if a.kind in ("map", "variant") or b.kind in ("map", "variant"):
        return to_string(a), to_string(b)
    for x, y, swap in ((a, b, False), (b, a, True)):
        pair = None
        if x.kind == "any":
            kind = "double" if y.is_number else "int" if y.kind == "timespan" else "string" if y.kind == "datetime" else y.kind
            pair = unwrap(x, kind), y.col.cast("double") if y.is_number else to_string(y) if y.kind == "datetime" else y.col
        elif x.kind == "string" and y.is_number:
            pair = x.col.try_cast("double"), y.col.cast("double")
        elif x.kind == "string" and y.kind == "datetime":
            pair = to_datetime(x), y.col
        elif x.kind == "string" and y.kind == "bool":
            pair = x.col.try_cast("boolean"), y.col
        elif x.kind == "timespan" and y.is_number:
            pair = x.col.cast("double"), y.col.cast("double")
        if pair is not None:
            return pair[::-1] if swap else pair
    return None


def equal(a: Value, b: Value) -> Column:
    """null == null is true; null against a value, and kinds that never match, are false."""
    if a.kind == "null" or b.kind == "null":
        return is_null(b if a.kind == "null" else a)
    pair = _common(a, b)
    return F.lit(False) if pair is None else pair[0].eqNullSafe(pair[1])


def equal_ignoring_case(a: Value, b: Value) -> Column:
    return F.lower(to_string(a)).eqNullSafe(F.lower(to_string(b)))


def ordered(op: str, a: Value, b: Value) -> Column:
    """<, <=, >, >=: false where either side is null or the kinds never match."""
    pair = None if "null" in (a.kind, b.kind) else _common(a, b)
    if pair is None:
        return F.lit(False)
    x, y = pair
    out = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
    return F.coalesce(out, F.lit(False))


def truth(v: Value) -> Column:
    """A predicate's value; null is false."""
    if v.kind == "null":
        return F.lit(False)
    return F.coalesce(to_bool(v), F.lit(False))


# arithmetic


def _number(v: Value) -> Value:
    if v.is_number:
        return v
    if v.kind == "bool":
        return Value(v.col.cast("long"), "int")
    return Value(to_double(v), "double")


def arithmetic(op: str, a: Value, b: Value) -> Value:
    """int with int stays int (division truncates); any double makes a double; datetimes move by
    timespans or days; what can't be computed is null."""
    if "null" in (a.kind, b.kind):
        return null()
    if op in ("+", "-") and a.kind == "datetime":
        if b.kind == "datetime" and op == "-":
            return Value(F.unix_micros(a.col) - F.unix_micros(b.col), "timespan")
        step = b.col if b.kind == "timespan" else (to_double(b) * 86_400_000_000).cast("long")
        return Value(F.timestamp_micros(F.unix_micros(a.col) + (step if op == "+" else -step)), "datetime")
    if op == "+" and b.kind == "datetime":
        return arithmetic(op, b, a)
    if "timespan" in (a.kind, b.kind):
        if op in ("+", "-") and a.kind == b.kind:
            return Value(a.col + b.col if op == "+" else a.col - b.col, "timespan")
        if op == "/" and a.kind == b.kind:
            return Value(F.try_divide(a.col.cast("double"), b.col.cast("double")), "double")
        if op in ("*", "/") and (b.is_number or a.is_number and op == "*"):
            x, y = to_double(Value(a.col, "double")), to_double(Value(b.col, "double"))
            return Value((x * y if op == "*" else F.try_divide(x, y)).cast("long"), "timespan")
    if "any" in (a.kind, b.kind):
        # by the kinds at run time: whole numbers if both are, else doubles
        whole = arithmetic(op, *(Value(unwrap(x, "int") if x.kind == "any" else x.col if x.kind == "int" else F.lit(None).cast("long"), "int") for x in (a, b)))
        real = arithmetic(op, *(Value(to_double(x), "double") for x in (a, b)))
        return Value(F.coalesce(wrap(whole), wrap(real)), "any")
    a, b = _number(a), _number(b)
    if a.kind == b.kind == "int":
        nonzero = F.when(b.col != 0, b.col)
        out = {"+": lambda: F.try_add(a.col, b.col), "-": lambda: F.try_subtract(a.col, b.col), "*": lambda: F.try_multiply(a.col, b.col), "/": lambda: ((a.col - a.col % nonzero) / nonzero).cast("long"), "%": lambda: a.col % nonzero}[op]()
        return Value(out, "int")
    x, y = a.col.cast("double"), b.col.cast("double")
    out = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.try_divide(x, y), "%": lambda: x % F.when(y != 0, y)}[op]()
    return Value(out, "double")


def bin_down(v: Value, size: Value) -> Value:
    """Down to a multiple of the size; null if either can't be."""
    if v.kind == "datetime":
        step = size.col if size.kind == "timespan" else (to_double(size) * 86_400_000_000).cast("long")
        step = F.when(step > 0, step)
        micros = F.unix_micros(v.col)
        return Value(F.timestamp_micros(micros - F.pmod(micros, step)), "datetime")
    if v.kind in ("int", "timespan") and size.kind in ("int", "timespan"):
        step = F.when(size.col > 0, size.col)
        return Value(v.col - F.pmod(v.col, step), v.kind)
    x, step = to_double(v), to_double(size)
    return Value(F.floor(x / F.when(step > 0, step)) * step, "double")
