"""Layouts: nested wide frames, the normalised star of narrow tables, and transport-encoded ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import values as V
from tidemark.plans.syntax import QueryError

# Schemas of the star's tables; every optional column is present and nullable.
ATTRIBUTE_ROWS = T.StructType([T.StructField("_part_id", T.StringType()), T.StructField("parent_id", T.LongType()), T.StructField("key", T.StringType()), *V.ANY_VALUE.fields])

LOGS = T.StructType(
    [
        T.StructField("time_unix_nano", T.LongType()),
        T.StructField("observed_time_unix_nano", T.LongType()),
        T.StructField("severity_number", T.IntegerType()),
        T.StructField("severity_text", T.StringType()),
        T.StructField("event_name", T.StringType()),
        T.StructField("body", V.ANY_VALUE),
        T.StructField("attributes", V.ATTRIBUTES),
        T.StructField("dropped_attributes_count", T.LongType()),
        T.StructField("flags", T.LongType()),
        T.StructField("trace_id", T.BinaryType()),
        T.StructField("span_id", T.BinaryType()),
        T.StructField("resource", T.StructType([T.StructField("schema_url", T.StringType()), T.StructField("attributes", V.ATTRIBUTES)])),
        T.StructField("instrumentation_scope", T.StructType([T.StructField("name", T.StringType()), T.StructField("version", T.StringType()), T.StructField("attributes", V.ATTRIBUTES)])),
    ]
)


def attribute_map(**values: V.Value) -> Column:
    """A map of tagged values, keys in the order given; a key's dots are written as double underscores."""
    parts: list[Column] = []
    for key, v in values.items():
        parts += [F.lit(key.replace("__", ".")), V.wrap(v)]
    return F.create_map(*parts) if parts else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(T.ArrayType(V.ANY_VALUE)))


def to_star(df: DataFrame, id_cols: list[str], attributes_col: str = "attributes") -> tuple[DataFrame, DataFrame]:
    """(root rows without the map, attribute rows keyed by id_cols): the wide layout taken apart.
    Null maps and empty maps have no rows."""
    root = df.drop(attributes_col)
    rows = df.select(*id_cols, F.explode(attributes_col).alias("key", "_v"))
    return root, rows.select(*id_cols, "key", *(F.col("_v")[f.name].alias(f.name) for f in V.ANY_VALUE.fields))


def to_wide(root: DataFrame, attributes: DataFrame, id_cols: list[str], attributes_col: str = "attributes") -> DataFrame:
    """The star joined again: one row per root row, its attributes as a map (null without any).
    Rows of one key are kept once, the one whose value sorts last."""
    value = F.struct(*(F.col(f.name) for f in V.ANY_VALUE.fields))
    one = attributes.groupBy(*id_cols, "key").agg(F.max(value).alias("_v"))
    maps = one.groupBy(*id_cols).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "_v")))).alias(attributes_col))
    maps = maps.select(*(F.col(c).alias(f"_{c}") for c in id_cols), attributes_col)
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in id_cols]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return root.join(maps, on, "left").drop(*(f"_{c}" for c in id_cols))


def prune_orphans(root: DataFrame, child: DataFrame, id_cols: list[str], parent_cols: list[str]) -> DataFrame:
    """Child rows whose parent is still there."""
    parents = root.select(*(F.col(i).alias(f"_{i}") for i in id_cols)).distinct()
    on = F.lit(True)
    for p, i in zip(parent_cols, id_cols, strict=True):
        on = on & (F.col(p) == F.col(f"_{i}"))
    return child.join(parents, on, "left_semi")


def where_attribute(root: DataFrame, attributes: DataFrame, id_cols: list[str], key: str, field: str, wanted: object) -> DataFrame:
    """Root rows with an attribute of a value: a filter that reaches the narrow table's scan, then
    a semi join."""
    hits = attributes.where((F.col("key") == key) & (F.col(field) == wanted)).select(*id_cols).distinct()
    return root.join(hits, id_cols, "left_semi")


def where_attributes(root: DataFrame, attributes: DataFrame, id_cols: list[str], tests: dict[str, Column], combine: Column) -> DataFrame:
    """Root rows for which ``combine`` holds, any expression of the tests' names; a test, of the
    columns of the attribute table, holds for a root row if it does for one of its attributes.

    All tests are answered by one aggregate over the rows that one of them wants, so or, and and not
    cost one shuffle together."""
    wanted = None
    for t in tests.values():
        wanted = t if wanted is None else wanted | t
    flags = attributes.where(wanted).groupBy(*(F.col(c).alias(f"_{c}") for c in id_cols)).agg(*(F.bool_or(F.coalesce(t, F.lit(False))).alias(f"_is_{n}") for n, t in tests.items()))
    on = F.lit(True)
    for c in id_cols:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    joined = root.join(flags, on, "left").withColumns({n: F.coalesce(F.col(f"_is_{n}"), F.lit(False)) for n in tests})
    return joined.where(combine).select(root.columns)


# the star of a whole signal

#: Array columns that are tables of their own in the star, by column.
CHILDREN = {"events": "events", "links": "links", "data_points": "points"}
CHILD_ID = "child_id"


def to_tables(df: DataFrame, name: str, id_cols: list[str]) -> dict[str, DataFrame]:
    """A signal's star by table: ``name`` and its attributes (_attrs), and for each array column its
    elements (child_id: their place, from 0) and their attributes. No id column may have the name
    of an element's field."""
    held = [c for c in CHILDREN if c in df.columns]
    root, attributes = to_star(df.drop(*held), id_cols)
    out = {name: root, f"{name}_attrs": attributes}
    for c in held:
        fields = df.schema[c].dataType.elementType.fieldNames()
        if {*fields} & {*id_cols, CHILD_ID}:
            raise QueryError(f"an id column has the name of a field of {c}")
        rows = df.select(*id_cols, F.posexplode(c).alias(CHILD_ID, "_x")).select(*id_cols, CHILD_ID, *(F.col("_x")[f].alias(f) for f in fields))
        table = f"{name}_{CHILDREN[c]}"
        if "attributes" in fields:
            rows, out[f"{table}_attrs"] = to_star(rows, [*id_cols, CHILD_ID])
        out[table] = rows
    return out


def from_tables(tables: dict[str, DataFrame], name: str, id_cols: list[str]) -> DataFrame:
    """The nested rows of a signal's star. Maps and arrays without entries are null."""
    out = to_wide(tables[name], tables[f"{name}_attrs"], id_cols)
    for c, child in CHILDREN.items():
        table = f"{name}_{child}"
        if table not in tables:
            continue
        rows = tables[table]
        if f"{table}_attrs" in tables:
            rows = to_wide(rows, tables[f"{table}_attrs"], [*id_cols, CHILD_ID])
        fields = [f for f in rows.columns if f not in id_cols and f != CHILD_ID]
        listed = F.array_sort(F.collect_list(F.struct(CHILD_ID, F.struct(*fields).alias("_x"))), lambda a, b: a[CHILD_ID] - b[CHILD_ID])
        lists = rows.groupBy(*(F.col(i).alias(f"_{i}") for i in id_cols)).agg(listed.alias("_l")).withColumn(c, F.transform("_l", lambda e: e["_x"])).drop("_l")
        on = F.lit(True)
        for i in id_cols:
            on = on & F.col(i).eqNullSafe(F.col(f"_{i}"))
        out = out.join(lists, on, "left").drop(*(f"_{i}" for i in id_cols))
    return out


# Names of span kinds and status codes, by number.
SPAN_KINDS = ("Unspecified", "Internal", "Server", "Client", "Producer", "Consumer")
STATUS_CODES = ("Unset", "Ok", "Error")


def _texts(m: Column, dtype: T.MapType) -> Column:
    return F.transform_values(m, lambda k, v: F.coalesce(V.to_string(V.typed(v, dtype.valueType)), F.lit("")))


def _named(number: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, names)), F.coalesce(number.cast("int"), F.lit(0))), F.lit(names[0]))


def _hex(c: Column, dtype: T.DataType) -> Column:
    return F.coalesce(F.lower(F.hex(c)) if isinstance(dtype, T.BinaryType) else c.cast("string"), F.lit(""))


def _shown(field: str, dtype: T.DataType) -> Callable[[Column], Column]:
    """How a field of an event or link is shown."""
    if field == "attributes":
        return lambda e: _texts(e[field], dtype)
    return lambda e: _hex(e[field], dtype) if field in ("trace_id", "span_id") else e[field]


def wide_spans(df: DataFrame) -> DataFrame:
    """Spans as one flat table: ids as lower-case hex, attributes as text maps, the service's name,
    and events and links as parallel arrays. Absent columns count as empty."""
    none = {"string": F.lit(""), "map": F.create_map().cast("map<string,string>")}

    def field(path: str, default: Column) -> Column:
        dtype: T.DataType = df.schema
        for step in path.split("."):
            if not isinstance(dtype, T.StructType) or step not in dtype.fieldNames():
                return default
            dtype = dtype[step].dataType
        if isinstance(dtype, T.MapType):
            return F.coalesce(_texts(F.col(path), dtype), default)
        return F.coalesce(F.col(path), default)

    def ids(path: str) -> Column:
        return _hex(F.col(path), df.schema[path].dataType) if path in df.columns else none["string"]

    resource = field("resource.attributes", none["map"])
    out = {
        "Timestamp": field("start_time_unix_nano", F.lit(None).cast("long")),
        "TraceId": ids("trace_id"), "SpanId": ids("span_id"), "ParentSpanId": ids("parent_span_id"),
        "TraceState": field("trace_state", none["string"]), "SpanName": field("name", none["string"]),
        "SpanKind": _named(field("kind", F.lit(0)), SPAN_KINDS),
        "ServiceName": F.coalesce(F.try_element_at(resource, F.lit("service.name")), F.lit("")),
        "ResourceAttributes": resource,
        "ScopeName": field("instrumentation_scope.name", none["string"]), "ScopeVersion": field("instrumentation_scope.version", none["string"]),
        "SpanAttributes": field("attributes", none["map"]),
        "Duration": field("duration_time_unix_nano", F.lit(None).cast("long")),
        "StatusCode": _named(field("status.code", F.lit(0)), STATUS_CODES), "StatusMessage": field("status.message", none["string"]),
    }
    for column, parts in (("events", {"Timestamp": "time_unix_nano", "Name": "name", "Attributes": "attributes"}), ("links", {"TraceId": "trace_id", "SpanId": "span_id", "TraceState": "trace_state", "Attributes": "attributes"})):
        if column not in df.columns:
            continue
        element = df.schema[column].dataType.elementType
        for title, f in parts.items():
            if f not in element.fieldNames():
                continue
            dtype = element[f].dataType
            if f == "attributes":
                kind = T.MapType(T.StringType(), T.StringType())
            else:
                kind = T.StringType() if f in ("trace_id", "span_id") else dtype
            out[f"{column.title()}.{title}"] = F.coalesce(F.transform(column, _shown(f, dtype)), F.array().cast(T.ArrayType(kind)))
    return df.select(*(c.alias(n) for n, c in out.items()))


def wide_strings(df: DataFrame) -> DataFrame:
    """The flat export form: all attribute maps as text maps, resource and scope as columns, and
    the service's name of its own."""
    text = lambda m: F.transform_values(m, lambda k, v: F.coalesce(V.to_string(V.Value(v, "any")), F.lit("")))
    out = df.withColumn("LogAttributes" if "body" in df.columns else "SpanAttributes", text(F.col("attributes"))).drop("attributes")
    if "resource" in df.columns:
        out = out.withColumn("ResourceAttributes", text(F.col("resource.attributes"))).withColumn("ServiceName", F.coalesce(F.try_element_at("ResourceAttributes", F.lit("service.name")), F.lit("")))
        out = out.withColumn("ResourceSchemaUrl", F.col("resource.schema_url") if "schema_url" in df.schema["resource"].dataType.fieldNames() else F.lit(None).cast("string")).drop("resource")
    if "instrumentation_scope" in df.columns:
        out = out.withColumn("ScopeName", F.col("instrumentation_scope.name")).withColumn("ScopeAttributes", text(F.col("instrumentation_scope.attributes"))).drop("instrumentation_scope")
    if "body" in df.columns and V.kind_of(df.schema["body"].dataType) == "any":
        out = out.withColumn("body", V.to_string(V.Value(F.col("body"), "any")))
    return out


# transport encodings of ids


def decode_delta(df: DataFrame, batch_col: str, order_col: str, delta_col: str, out_col: str) -> DataFrame:
    """Plain ids from deltas: running sums within a batch."""
    w = Window.partitionBy(batch_col).orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out_col, F.sum(delta_col).over(w))


def decode_quasi_delta(df: DataFrame, batch_col: str, order_col: str, id_col: str, group_cols: list[str], out_col: str) -> DataFrame:
    """Plain parent ids where an id is a delta only while the group columns repeat: the sum is
    taken anew from each row on whose group differs from the row before."""
    order = Window.partitionBy(batch_col).orderBy(order_col)
    now, before = F.struct(*group_cols), F.lag(F.struct(*group_cols)).over(order)
    changed = F.when(now.eqNullSafe(before), 0).otherwise(1)
    marked = df.withColumn("_changed", changed).withColumn("_run", F.sum("_changed").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = Window.partitionBy(batch_col, "_run").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn(out_col, F.sum(id_col).over(runs)).drop("_changed", "_run")
