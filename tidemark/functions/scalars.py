"""The scalar libraries of the query languages: names to builders of typed columns."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import hashing
from tidemark.functions import values as V
from tidemark.functions.values import Value
from tidemark.plans.syntax import QueryError

Builder = Callable[[list[Value]], Value]


def arity(name: str, args: list[Value], least: int, most: int | None = None) -> None:
    if len(args) < least or most is not None and len(args) > most:
        wanted = str(least) if most == least else f"{least} or more" if most is None else f"{least} to {most}"
        raise QueryError(f"{name} takes {wanted} arguments, got {len(args)}")


def constant(name: str, v: Value, what: str = "a literal"):
    if v.constant is None:
        raise QueryError(f"{name} needs {what}")
    return v.constant


def pattern_of(name: str, v: Value) -> str:
    """A regular expression, checked when the query is compiled; look-around isn't part of the language."""
    text = str(constant(name, v, "a literal pattern"))
    if re.search(r"\(\?(?:[=!]|<[=!])", text):
        raise QueryError(f"look-around isn't supported: {text!r}")
    return text


def string(col: Column) -> Value:
    return Value(col, "string")


def _string_only(name: str, v: Value) -> Column:
    if v.kind not in ("string", "any", "null"):
        raise QueryError(f"{name} takes a string, got {v.kind}")
    return V.unwrap(v, "string") if v.kind == "any" else v.col.cast("string")


def _substring(args: list[Value]) -> Value:
    """Characters from a 0-based start on; what reaches beyond the end is cut off."""
    arity("substring", args, 2, 3)
    text, start = V.to_string(args[0]), V.to_int(args[1]).cast("int")
    length = V.to_int(args[2]).cast("int") if len(args) == 3 else F.length(text)
    return string(F.when(start >= 0, F.substring(text, start + 1, F.greatest(length, F.lit(0)))))


def _captured(text: Column, pattern: str, group: int, nth: int = 1) -> Column:
    """A group of the nth match, null without one. (regexp_extract gives '' where nothing matches.)"""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(nth))


def _group_number(pattern: str, name: str) -> int:
    opened = [m for m in re.finditer(r"\\.|\[(?:\\.|[^\]])*\]|\((?!\?)|\(\?P?<(?![=!])(\w+)>", pattern) if m[0][0] == "("]
    for i, m in enumerate(opened):
        if m[1] == name:
            return i + 1
    raise QueryError(f"no group {name!r} in {pattern!r}")


def _regexp_substr(args: list[Value]) -> Value:
    """(text, pattern[, start 1-based[, occurrence[, flags[, group number or name]]]])."""
    arity("regexp_substr", args, 2, 6)
    pattern = pattern_of("regexp_substr", args[1])
    rest = [constant("regexp_substr", a) for a in args[2:]]
    start, nth, flags, group = (*rest, *(1, 1, "c", 0)[len(rest) :])
    if start < 1 or nth < 1 or isinstance(group, int) and group < 0:
        return string(F.lit(None).cast("string"))
    if set(flags) - set("imsc"):
        raise QueryError(f"unknown flags {flags!r}")
    number = _group_number(pattern, group) if isinstance(group, str) else group
    pattern = pattern.replace("(?P<", "(?<")
    options = "".join(f for f in "ims" if f in flags)
    if number > re.compile(pattern.replace("(?<", "(?P<")).groups:
        return string(F.lit(None).cast("string"))
    text = F.substring(_string_only("regexp_substr", args[0]), F.lit(start), F.lit(1 << 30))
    return string(_captured(text, f"(?{options}){pattern}" if options else pattern, number, nth))


# strftime directives and their forms in date_format patterns; fixed values
STRFTIME = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "e": "d", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS",
    "p": "a", "A": "EEEE", "a": "EEE", "B": "MMMM", "b": "MMM", "j": "DDD", "z": "xx", "Z": "zzz",
    "F": "yyyy-MM-dd", "T": "HH:mm:ss", "D": "MM/dd/yy", "R": "HH:mm",
}


def java_pattern(strftime: str) -> str:
    out, i, text = [], 0, ""

    def flush() -> None:
        nonlocal text
        if text:
            out.append("'" + text.replace("'", "''") + "'" if re.search("[A-Za-z']", text) else text)
            text = ""

    while i < len(strftime):
        c = strftime[i]
        if c == "%" and i + 1 < len(strftime):
            i += 1
            if strftime[i] == "%":
                text += "%"
            elif strftime[i] in STRFTIME:
                flush()
                out.append(STRFTIME[strftime[i]])
            else:
                raise QueryError(f"unknown directive %{strftime[i]}")
        else:
            text += c
        i += 1
    flush()
    return "".join(out)


def _hash_input(name: str, v: Value) -> Column:
    if v.kind == "any":
        return F.coalesce(V.unwrap(v, "string").cast("binary"), V.unwrap(v, "binary"))
    if v.kind not in ("string", "binary", "null"):
        raise QueryError(f"{name} takes a string or bytes, got {v.kind}")
    return v.col.cast("binary")


def _hash(name: str, build: Callable[[Column], Column], kind: str) -> Builder:
    def run(args: list[Value]) -> Value:
        arity(name, args, 1, 1)
        return Value(build(_hash_input(name, args[0])), kind)

    return run


def _encode(args: list[Value]) -> Value:
    arity("encode", args, 2, 2)
    data, form = args[0].col.cast("binary"), constant("encode", args[1])
    if form == "hex":
        return string(F.lower(F.hex(data)))
    if form == "base64":
        return string(F.base64(data))
    raise QueryError(f"unknown encoding {form!r}")


def _coalesce(args: list[Value]) -> Value:
    arity("coalesce", args, 2)
    return first_of(args)


def first_of(args: list[Value]) -> Value:
    """The first non-null argument, in a kind that holds all."""
    kind = common_kind(args)
    if kind == "null":
        return V.null()
    return Value(F.coalesce(*(convert(a, kind) for a in args)), kind)


def common_kind(args: list[Value]) -> str:
    kinds = {a.kind for a in args} - {"null"}
    if len(kinds) <= 1:
        return next(iter(kinds), "null")
    if kinds == {"int", "double"}:
        return "double"
    return "any" if "any" in kinds else "string"


def convert(v: Value, kind: str) -> Column:
    if v.kind == kind:
        return v.col
    if kind == "any":
        return V.wrap(v)
    if v.kind == "null":
        types = {"int": "long", "double": "double", "string": "string", "bool": "boolean", "datetime": "timestamp", "timespan": "long", "binary": "binary"}
        return v.col.cast(types[kind]) if kind in types else v.col
    by = {"int": V.to_int, "double": V.to_double, "string": V.to_string, "bool": V.to_bool, "datetime": V.to_datetime, "timespan": V.to_timespan}
    return by[kind](v) if kind in by else v.col


def choose(conditions: list[Column], results: list[Value], otherwise: Value) -> Value:
    kind = common_kind([*results, otherwise])
    if kind == "null":
        return V.null()
    out = F.when(conditions[0], convert(results[0], kind))
    for c, r in zip(conditions[1:], results[1:], strict=True):
        out = out.when(c, convert(r, kind))
    return Value(out.otherwise(convert(otherwise, kind)), kind)


def _conversion(name: str, build: Callable[[Value], Column], kind: str) -> Builder:
    def run(args: list[Value]) -> Value:
        arity(name, args, 1, 1)
        return Value(build(args[0]), kind) if args[0].kind != "null" else Value(convert(args[0], kind), kind)

    return run


def _tostring(args: list[Value]) -> Value:
    arity("tostring", args, 1, 1)
    return string(F.coalesce(V.to_string(args[0]), F.lit("")))


def _strcat(args: list[Value]) -> Value:
    arity("strcat", args, 1)
    return string(F.concat(*(F.coalesce(V.to_string(a), F.lit("")) for a in args)))


def _strcat_delim(args: list[Value]) -> Value:
    arity("strcat_delim", args, 2)
    parts = F.array(*(F.coalesce(V.to_string(a), F.lit("")) for a in args[1:]))
    return string(F.array_join(parts, constant("strcat_delim", args[0])))


def _extract(args: list[Value]) -> Value:
    arity("extract", args, 3, 3)
    group = constant("extract", args[1])
    pattern = pattern_of("extract", args[0])
    number = _group_number(pattern, group) if isinstance(group, str) else group
    return string(_captured(V.to_string(args[2]), pattern.replace("(?P<", "(?<"), number))


def _extract_json(args: list[Value]) -> Value:
    arity("extract_json", args, 2, 3)
    text = string(F.get_json_object(V.to_string(args[1]), constant("extract_json", args[0])))
    if len(args) == 2:
        return text
    kind = constant("extract_json", args[2])
    return text if kind in ("string", "any") else Value(convert(text, kind), kind)


def _array_concat(args: list[Value]) -> Value:
    arity("array_concat", args, 1)
    if any(a.kind != "array" for a in args):
        raise QueryError("array_concat takes arrays")
    return Value(F.concat(*(a.col for a in args)), "array", args[0].dtype)


GETTYPE = {"array": "array", "bool": "bool", "binary": "bytes", "datetime": "datetime", "double": "real", "int": "long", "map": "dictionary", "struct": "dictionary", "null": "null", "regex": "regex", "string": "string", "timespan": "timespan"}
ANY_NAMES = ("null", "string", "long", "real", "bool", "dictionary", "array", "bytes")


def _gettype(args: list[Value]) -> Value:
    arity("gettype", args, 1, 1)
    v = args[0]
    if v.kind == "any":
        return string(F.element_at(F.array(*map(F.lit, ANY_NAMES)), V.tag(v) + 1))
    return string(F.when(V.is_null(v), F.lit("null")).otherwise(F.lit(GETTYPE.get(v.kind, "dictionary"))))


def _now(args: list[Value]) -> Value:
    arity("now", args, 0, 1)
    now = Value(F.current_timestamp(), "datetime")
    return V.arithmetic("+", now, args[0]) if args else now


def _cast(args: list[Value]) -> Value:
    kinds = {"String": "string", "Integer": "int", "Double": "double", "Boolean": "bool"}
    name = constant("as", args[1])
    if name not in kinds:
        raise QueryError(f"can't cast to {name!r}")
    return Value(convert(args[0], kinds[name]), kinds[name])


def _json(args: list[Value]) -> Value:
    arity("parse_json", args, 1, 1)
    return Value(F.try_parse_json(_string_only("parse_json", args[0])), "variant", T.VariantType())


KQL: dict[str, Builder] = {
    "strlen": lambda a: (arity("strlen", a, 1, 1), Value(F.length(_string_only("strlen", a[0])).cast("long"), "int"))[1],
    "replace_string": lambda a: (arity("replace_string", a, 3, 3), string(F.replace(*(_string_only("replace_string", x) for x in a))))[1],
    "substring": _substring,
    "strcat": _strcat,
    "strcat_delim": _strcat_delim,
    "extract": _extract,
    "extract_json": _extract_json,
    "parse_json": _json,
    "parse_regex": lambda a: Value(F.lit(pattern_of("parse_regex", a[0])), "regex", constant=(f"(?{a[1].constant})" if len(a) > 1 else "") + pattern_of("parse_regex", a[0])),
    "array_concat": _array_concat,
    "coalesce": _coalesce,
    "tostring": _tostring,
    "toint": _conversion("toint", V.to_int, "int"),
    "tolong": _conversion("tolong", V.to_int, "int"),
    "tobool": _conversion("tobool", V.to_bool, "bool"),
    "tofloat": _conversion("tofloat", V.to_double, "double"),
    "toreal": _conversion("toreal", V.to_double, "double"),
    "todouble": _conversion("todouble", V.to_double, "double"),
    "todatetime": _conversion("todatetime", V.to_datetime, "datetime"),
    "totimespan": _conversion("totimespan", V.to_timespan, "timespan"),
    "bin": lambda a: (arity("bin", a, 2, 2), V.bin_down(*a))[1],
    "gettype": _gettype,
    "now": _now,
    "ceiling": lambda a: Value(F.ceil(V.to_double(a[0])).cast("double"), "double"),
    "floor": lambda a: Value(F.floor(V.to_double(a[0])).cast("double"), "double"),
}

OPL: dict[str, Builder] = {
    "lower_case": lambda a: (arity("lower_case", a, 1, 1), string(F.lower(_string_only("lower_case", a[0]))))[1],
    "upper_case": lambda a: (arity("upper_case", a, 1, 1), string(F.upper(_string_only("upper_case", a[0]))))[1],
    "concat": lambda a: (arity("concat", a, 2), string(F.concat(*(F.coalesce(V.to_string(x), F.lit("")) for x in a))))[1],
    "concat_ws": lambda a: (arity("concat_ws", a, 2), string(F.concat_ws(constant("concat_ws", a[0]), *(V.to_string(x) for x in a[1:]))))[1],
    "join": lambda a: (arity("join", a, 2), string(F.concat_ws(constant("join", a[0]), *(V.to_string(x) for x in a[1:]))))[1],
    "substring": _substring,
    "replace": lambda a: (arity("replace", a, 3, 3), string(F.replace(*(_string_only("replace", x) for x in a))))[1],
    "ltrim": lambda a: (arity("ltrim", a, 1, 2), string(F.ltrim(_string_only("ltrim", a[0]), *(x.col for x in a[1:]))))[1],
    "rtrim": lambda a: (arity("rtrim", a, 1, 2), string(F.rtrim(_string_only("rtrim", a[0]), *(x.col for x in a[1:]))))[1],
    "contains": lambda a: (arity("contains", a, 2, 2), Value(F.contains(V.to_string(a[0]), V.to_string(a[1])), "bool"))[1],
    "starts_with": lambda a: (arity("starts_with", a, 2, 2), Value(F.startswith(V.to_string(a[0]), V.to_string(a[1])), "bool"))[1],
    "ends_with": lambda a: (arity("ends_with", a, 2, 2), Value(F.endswith(V.to_string(a[0]), V.to_string(a[1])), "bool"))[1],
    "matches": lambda a: (arity("matches", a, 2, 2), Value(V.to_string(a[0]).rlike(pattern_of("matches", a[1])), "bool"))[1],
    "regexp_capture": lambda a: (arity("regexp_capture", a, 3, 3), string(_captured(_string_only("regexp_capture", a[0]), pattern_of("regexp_capture", a[1]), constant("regexp_capture", a[2]))))[1],
    "regexp_substr": _regexp_substr,
    "sha256": _hash("sha256", lambda c: F.unhex(F.sha2(c, 256)), "binary"),
    "sha512": _hash("sha512", lambda c: F.unhex(F.sha2(c, 512)), "binary"),
    "sha1": _hash("sha1", lambda c: F.unhex(F.sha1(c)), "binary"),
    "md5": _hash("md5", F.md5, "string"),
    "fnv": _hash("fnv", hashing.fnv, "int"),
    "murmur3": _hash("murmur3", hashing.murmur3, "int"),
    "xxh3": _hash("xxh3", hashing.xxh3, "int"),
    "xxh128": _hash("xxh128", hashing.xxh128, "binary"),
    "encode": _encode,
    "uuid": lambda a: (arity("uuid", a, 0, 0), string(F.uuid()))[1],
    "uuidv7": lambda a: (arity("uuidv7", a, 0, 0), string(hashing.uuidv7()))[1],
    "log10": lambda a: (arity("log10", a, 1, 1), Value(F.log10(V.to_double(a[0])), "double"))[1],
    "now": lambda a: (arity("now", a, 0, 0), _now(a))[1],
    "format_datetime": lambda a: (arity("format_datetime", a, 2, 2), string(F.date_format(V.to_datetime(a[0]), java_pattern(constant("format_datetime", a[1])))))[1],
    "coalesce": _coalesce,
    "cast": _cast,
}
