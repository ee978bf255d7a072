"""Processor nodes as DataFrame operators: attribute edits, filters, sampling, routing, partitioning,
condensing, validation and temporal reaggregation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import values as V
from tidemark.plans.compile import OplRun, Scope, _edit_at, _put
from tidemark.plans.opl import OplReader
from tidemark.plans.syntax import QueryError

# attributes


@dataclass(frozen=True)
class Action:
    """delete, insert (if absent), upsert, update (if present), rename or hash of one key."""

    action: str
    key: str
    value: object = None
    new_key: str | None = None
    salt: str = ""


SCOPES = {"signal": ("attributes",), "resource": ("resource", "attributes"), "scope": ("instrumentation_scope", "attributes")}


def edit_attributes(df: DataFrame, actions: list[Action], scope: str = "signal") -> DataFrame:
    """Actions in order on the attributes of a scope; unknown actions are ignored."""
    root, *steps = SCOPES[scope]
    return df.withColumn(root, _edit_at(F.col(root), df.schema[root].dataType, tuple(steps), lambda m, dtype: _acted(m, dtype, actions)))


def _acted(m: Column, dtype: T.MapType, actions: list[Action]) -> Column:
    """All actions in one pass: what becomes of each key they name is one expression, and the map is
    built once from these and the entries they don't name."""
    held: dict[str, tuple[Column, Column] | None] = {}  # by key: whether it is there, and its value
    kinds = {bool: "bool", int: "int", float: "double", str: "string"}
    nothing = F.lit(None).cast(dtype.valueType)
    item = lambda v: V.wrap(v) if V.is_any(dtype.valueType) else v.col.cast(dtype.valueType)

    def at(key: str) -> tuple[Column, Column]:
        if key not in held:
            held[key] = F.coalesce(F.map_contains_key(m, key), F.lit(False)), F.try_element_at(m, F.lit(key))
        return held[key] or (F.lit(False), nothing)

    for a in actions:
        if a.action not in ("delete", "insert", "upsert", "update", "rename", "hash"):
            continue
        there, value = at(a.key)
        if a.action == "delete":
            held[a.key] = None
        elif a.action in ("insert", "upsert", "update"):
            new = item(V.literal(a.value, kinds[type(a.value)]))
            held[a.key] = {"upsert": (F.lit(True), new), "insert": (F.lit(True), F.when(there, value).otherwise(new)), "update": (there, new)}[a.action]
        elif a.action == "hash":
            digest = F.sha2(F.concat(F.lit(a.salt), V.to_string(V.typed(value, dtype.valueType))).cast("binary"), 256)
            held[a.key] = there, item(V.Value(digest, "string"))
        elif a.new_key != a.key:
            before, old = at(a.new_key)
            held[a.new_key], held[a.key] = (there | before, F.when(there, value).otherwise(old)), None
    if not held:
        return m
    left = [F.when(h[0], F.struct(F.lit(k).alias("key"), h[1].alias("value"))) for k, h in held.items() if h is not None]
    rest = F.map_filter(m, lambda k, v: ~k.isin(list(held)))
    if not left:
        return rest
    entries = F.filter(F.array(*left), lambda e: e.isNotNull())
    made = F.map_from_entries(entries)
    return F.when(m.isNull(), F.when(F.size(entries) > 0, made)).otherwise(F.map_concat(rest, made))


# filters


@dataclass(frozen=True)
class Match:
    """Properties of records; lists are alternatives, resource attributes must all match."""

    strict: bool = True
    resource_attributes: dict[str, object] = field(default_factory=dict)
    attributes: dict[str, object] = field(default_factory=dict)
    severity_texts: tuple[str, ...] = ()
    bodies: tuple[str, ...] = ()
    names: tuple[str, ...] = ()
    event_names: tuple[str, ...] = ()
    event_attributes: dict[str, object] = field(default_factory=dict)
    link_attributes: dict[str, object] = field(default_factory=dict)
    severity_min: int | None = None
    match_undefined: bool = False


def _text_is(v: V.Value, wanted: object, strict: bool) -> Column:
    if strict:
        kinds = {bool: "bool", int: "int", float: "double", str: "string"}
        return V.equal(v, V.literal(wanted, kinds[type(wanted)]))
    return F.coalesce(V.to_string(v).rlike(str(wanted)), F.lit(False))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def matches(df: DataFrame, m: Match) -> Column:
    """Whether a record has all properties that are given; with none given every record has."""
    parts: list[Column] = []
    item = lambda col, dtype, key: V.typed(F.try_element_at(col, F.lit(key)), dtype.valueType)
    if m.resource_attributes:
        col, dtype = F.col("resource.attributes"), df.schema["resource"].dataType["attributes"].dataType
        for key, wanted in m.resource_attributes.items():
            parts.append(_text_is(item(col, dtype, key), wanted, m.strict))
    if m.attributes:
        dtype = df.schema["attributes"].dataType
        parts.append(_any([_text_is(item(F.col("attributes"), dtype, k), w, m.strict) for k, w in m.attributes.items()]))
    for column, wanted in (("severity_text", m.severity_texts), ("body", m.bodies), ("name", m.names)):
        if wanted:
            v = V.typed(F.col(column), df.schema[column].dataType)
            parts.append(_any([_text_is(v, w, m.strict) for w in wanted]))
    if m.event_names:
        hit = lambda e: _any([e["name"] == w if m.strict else e["name"].rlike(w) for w in m.event_names])
        parts.append(F.coalesce(F.exists("events", hit), F.lit(False)))
    for column, wanted in (("events", m.event_attributes), ("links", m.link_attributes)):
        if wanted:  # any of them, of any event or link
            dtype = df.schema[column].dataType.elementType["attributes"].dataType
            held = F.exists(column, lambda e: _any([_text_is(item(e["attributes"], dtype, k), w, m.strict) for k, w in wanted.items()]))  # noqa: B023
            parts.append(F.coalesce(held, F.lit(False)))
    if m.severity_min is not None:
        number = F.coalesce(F.col("severity_number"), F.lit(0))
        parts.append((number >= m.severity_min) & (number != 0) | (F.lit(m.match_undefined) & (number == 0)))
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def filter_records(df: DataFrame, include: Match | None = None, exclude: Match | None = None) -> DataFrame:
    """Records that the include matches, less those that the exclude matches."""
    if include is not None:
        df = df.where(matches(df, include))
    if exclude is not None:
        df = df.where(~matches(df, exclude))
    return df


# sampling


def sample_ratio(df: DataFrame, emit: int, out_of: int, order_by: list[str], batch_col: str | None = None) -> DataFrame:
    """``emit`` of each ``out_of`` records in order, the first of each cycle.

    With ``batch_col`` each batch is sampled as it arrives: the position in the cycle is carried
    from batch to batch, and a batch's quota is taken from its front.
    """
    if not 0 <= emit <= out_of or out_of < 1:
        raise QueryError("emit must be between 0 and out_of")
    if batch_col is None:
        ranked = _numbered(df, order_by)
        return ranked.where((F.col("_n") % out_of) < emit).drop("_n")
    # how many of a stream's first x records are emitted
    quota = lambda x: F.floor(x / out_of) * emit + F.least(x % out_of, F.lit(emit))
    sizes = df.groupBy(batch_col).agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy(batch_col).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a batch
    sizes = sizes.withColumn("_before", before)
    sizes = sizes.select(F.col(batch_col).alias("_b"), (quota(F.col("_before") + F.col("_size")) - quota(F.col("_before"))).alias("_quota"))
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(batch_col).orderBy(*order_by)))
    return ranked.join(sizes, F.col(batch_col).eqNullSafe(F.col("_b"))).where(F.col("_n") <= F.col("_quota")).drop("_n", "_b", "_quota")


#: Rows that are drawn by range to place the bounds, and ranges at most.
DRAWN, MOST_RANGES = 32, 4096


def _range_of(df: DataFrame, order_by: list[str]) -> Column:
    """The range of each row's place in the order: how many of some fixed bounds are at or below it.

    The bounds are drawn once and stand in the plan as values, so every branch of a plan and every
    task that is run again puts a row in the same range."""
    ranges = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), MOST_RANGES)
    key = F.struct(*order_by)
    drawn = df.select(key.alias("k")).orderBy(F.rand(0)).limit(DRAWN * ranges)  # a bounded number of rows
    drawn = [r["k"] for r in drawn.orderBy("k").collect()]
    bounds = list(dict.fromkeys(drawn[len(drawn) * i // ranges] for i in range(1, ranges))) if drawn else []
    if not bounds:
        return F.lit(0)
    kinds = [df.schema[n].dataType for n in order_by]
    listed = F.array(*(F.struct(*(F.lit(v).cast(k).alias(n) for v, k, n in zip(b, kinds, order_by, strict=True))) for b in bounds))
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))))
    below = lambda at: (at <= len(bounds)) & F.coalesce(F.get(listed, at - 1) <= key, F.lit(False))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(below(at + step), at + step).otherwise(at))


def _running(df: DataFrame, order_by: list[str], weight: Column, name: str) -> DataFrame:
    """``name``: the weights of all rows before a row in the order, summed without bringing them into
    one task: ranges of the order are summed apart, on top of the sums of the ranges before."""
    ranged = df.withColumn("_part", _range_of(df, order_by)).withColumn("_weight", weight)
    sizes = ranged.groupBy("_part").agg(F.sum("_weight").alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # one row a range
    sizes = sizes.select(F.col("_part").alias("_p"), F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.sum("_weight").over(Window.partitionBy("_part").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1))
    joined = ranged.withColumn("_w", F.coalesce(within, F.lit(0))).join(F.broadcast(sizes), F.col("_part") == F.col("_p"), "left")
    return joined.withColumn(name, F.coalesce("_before", F.lit(0)) + F.col("_w")).drop("_part", "_weight", "_w", "_p", "_before")


def _numbered(df: DataFrame, order_by: list[str]) -> DataFrame:
    """_n: 0-based position in the order of all rows."""
    return _running(df, order_by, F.lit(1).cast("long"), "_n")


def batch_by_items(df: DataFrame, items: int, order_by: list[str], name: str = "_batch") -> DataFrame:
    """A batch number for every ``items`` records in order; all batches but the last are full."""
    if items < 1:
        raise QueryError("a batch holds one record at least")
    return _numbered(df, order_by).withColumn(name, F.floor(F.col("_n") / items)).drop("_n")


def batch_by_bytes(df: DataFrame, size: int, order_by: list[str], bytes_of: Column | None = None, name: str = "_batch") -> DataFrame:
    """A batch number by bytes: a batch ends with the record that fills it to the next multiple of
    ``size``, so batches hold ``size`` bytes give or take a record, and numbers may have gaps where
    a record alone is larger. Without ``bytes_of`` a record has the bytes of its JSON."""
    if size < 1:
        raise QueryError("a batch holds one byte at least")
    weight = F.octet_length(F.to_json(F.struct(*df.columns))) if bytes_of is None else bytes_of
    return _running(df, order_by, F.coalesce(weight.cast("long"), F.lit(0)), "_bytes").withColumn(name, F.floor(F.col("_bytes") / size)).drop("_bytes")


def batch_by_requests(df: DataFrame, requests: int, request_col: str, name: str = "_batch") -> DataFrame:
    """A batch number for every ``requests`` values of the request column in order; a request is
    never split."""
    seen = batch_by_items(df.select(F.col(request_col).alias("_request")).distinct(), requests, ["_request"], name)
    return df.join(seen, df[request_col].eqNullSafe(seen["_request"])).drop("_request")


def sample_zip(df: DataFrame, max_items: int, interval: str, time_col: str, order_by: list[str] | None = None) -> DataFrame:
    """At most ``max_items`` records of each interval, the earliest ones; records without a time
    belong to no interval and go."""
    windowed = df.withColumn("_window", F.window(time_col, interval)["start"])
    order = Window.partitionBy("_window").orderBy(*(order_by or [time_col]))
    return windowed.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max_items).drop("_n", "_window")


# looking at what passes


def debug_report(frames: dict[str, DataFrame], where: dict[str, object] | None = None) -> DataFrame:
    """One row a signal: records, and the attributes, events, links and data_points they hold. With
    ``where`` only records are counted that have one of these attribute values."""
    out = None
    for signal, df in frames.items():
        if where:
            df = df.where(matches(df, Match(attributes=where)))
        held = [(F.sum(F.when(F.col(c).isNotNull(), F.size(c)).otherwise(0)) if c in df.columns else F.lit(0)) for c in ("attributes", "events", "links", "data_points")]
        counts = [F.coalesce(h, F.lit(0)).cast("long").alias(c) for h, c in zip(held, ("attributes", "events", "links", "data_points"), strict=True)]
        row = df.agg(F.count("*").alias("records"), *counts).withColumn("signal", F.lit(signal))
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise QueryError("a report needs a signal")
    return out


def debug_sample(df: DataFrame, initial: int, thereafter: int, interval: str, time_col: str, order_by: list[str] | None = None) -> DataFrame:
    """Of each interval the first ``initial`` records, and of the others every ``thereafter``-th
    (none for 0); records without a time belong to no interval and go."""
    order = Window.partitionBy("_window").orderBy(*(order_by or [time_col]))
    n = F.col("_n") - initial
    kept = n <= 0
    if thereafter > 0:
        kept = kept | (n % thereafter == 0)
    windowed = df.where(F.col(time_col).isNotNull()).withColumn("_window", F.window(time_col, interval)["start"])
    return windowed.withColumn("_n", F.row_number().over(order)).where(kept).drop("_n", "_window")


# partitions and routes


def _compiled(df: DataFrame, expression: str) -> V.Value:
    reader = OplReader(expression)
    tree = reader.expression()
    return Scope("opl", df.schema, {}, {}, None).value(tree)


def partition_by(df: DataFrame, expression: str, name: str = "_partition", tasks: int | None = None) -> DataFrame:
    """The value of an OPL expression as a column; rows of one value share a task's output.

    A value that has most rows is one partition by definition; write with ``maxRecordsPerFile`` to
    bound its files.
    """
    v = _compiled(df, expression)
    if v.kind in ("array", "map", "struct", "variant"):
        raise QueryError(f"can't partition by a {v.kind}")
    keyed = df.withColumn(name, V.to_string(v) if v.kind == "any" else v.col)
    return keyed.repartition(tasks, name) if tasks else keyed.repartition(name)


def route_by_attribute(df: DataFrame, key: str, routes: dict[str, str], default: str | None = None, strict: bool = True) -> dict[str, DataFrame]:
    """Rows by port, after a resource attribute's value. Rows without a route go to the default
    port; without one they are rejected: reading the port "rejected" shows them."""
    v = V.typed(F.try_element_at(F.col("resource.attributes"), F.lit(key)), df.schema["resource"].dataType["attributes"].dataType.valueType)
    text = V.to_string(v)
    text = text if strict else F.lower(text)
    port = None
    for value, name in routes.items():
        hit = text == F.lit(value if strict else value.lower())
        port = F.when(hit, name) if port is None else port.when(hit, name)
    rest = default or "rejected"
    port = port.otherwise(rest) if port is not None else F.lit(rest)
    return {p: df.where(port == p) for p in dict.fromkeys([*routes.values(), rest])}


def route_by_type(frames: dict[str, DataFrame], routes: dict[str, str]) -> dict[str, DataFrame]:
    """Whole signals by port; signals without a route are left out."""
    out: dict[str, DataFrame] = {}
    for signal, df in frames.items():
        if port := routes.get(signal):
            out[port] = out[port].unionByName(df, allowMissingColumns=True) if port in out else df
    return out


def validate_resource(df: DataFrame, key: str, allowed: list[str], case_sensitive: bool = True) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) rows: valid if the resource attribute is present with an allowed value."""
    v = V.typed(F.try_element_at(F.col("resource.attributes"), F.lit(key)), df.schema["resource"].dataType["attributes"].dataType.valueType)
    text = V.to_string(v) if case_sensitive else F.lower(V.to_string(v))
    ok = F.coalesce(text.isin([a if case_sensitive else a.lower() for a in allowed]), F.lit(False))
    return df.where(ok), df.where(~ok)


def condense_attributes(df: DataFrame, destination: str, delimiter: str = ";", source_keys: list[str] | None = None, exclude_keys: list[str] | None = None) -> DataFrame:
    """Many attributes as one text "k=v;k=v" in the order of the keys; the others stay."""
    if source_keys and exclude_keys:
        raise QueryError("give source_keys or exclude_keys, not both")
    if delimiter == "=" or not delimiter:
        raise QueryError("'=' can't be the delimiter")
    dtype = df.schema["attributes"].dataType

    def taken(k: Column) -> Column:
        return k.isin(source_keys) if source_keys else ~k.isin(exclude_keys) if exclude_keys else F.lit(True)

    chosen = F.map_filter("attributes", lambda k, v: taken(k))
    entries = F.array_sort(F.transform(F.map_entries(chosen), lambda e: F.struct(e["key"].alias("k"), F.coalesce(V.to_string(V.typed(e["value"], dtype.valueType)), F.lit("")).alias("v"))))
    text = F.array_join(F.transform(entries, lambda e: F.concat(e["k"], F.lit("="), e["v"])), delimiter)
    rest = F.map_filter("attributes", lambda k, v: ~taken(k))
    new = _put(rest, dtype, destination, V.Value(text, "string"))
    return df.withColumn("attributes", F.when(F.size(chosen) > 0, new).otherwise(F.col("attributes")))


# reaggregation

CUMULATIVE = 2


def stream_id(columns: list[Column]) -> Column:
    """One digest of what identifies a stream; maps count with sorted keys."""
    return F.sha2(F.to_json(F.struct(*(c.alias(f"c{i}") for i, c in enumerate(columns)))).cast("binary"), 256)


def sorted_map(m: Column) -> Column:
    return F.array_sort(F.map_entries(m))


def reaggregate(df: DataFrame, stream: list[Column], time_col: str, period: str, aggregated: Column | None = None) -> DataFrame:
    """The latest point of each stream and period; rows that ``aggregated`` doesn't hold pass. Points
    without a time belong to no period and go. A column of exemplars is emptied in aggregated rows.

    The latest row is kept by an aggregate that is combined before the shuffle, so a stream with
    most of the points sends one row a task and period.
    """
    holds = F.lit(True) if aggregated is None else F.coalesce(aggregated, F.lit(False))
    names = df.columns
    keyed = df.withColumn("_stream", stream_id(stream)).withColumn("_period", F.window(time_col, period)["start"]).withColumn("_row", F.struct(*names))
    latest = keyed.where(holds).groupBy("_stream", "_period").agg(F.max_by("_row", F.struct(time_col, F.xxhash64("_row"))).alias("_row")).select("_row.*")
    if "exemplars" in names:
        latest = latest.withColumn("exemplars", F.lit(None).cast(df.schema["exemplars"].dataType))
    return latest if aggregated is None else latest.unionByName(df.where(~holds))


def is_reaggregated() -> Column:
    """Cumulative monotonic sums, cumulative histograms of both kinds, gauges and summaries."""
    kind, temporality = F.col("metric_type"), F.coalesce(F.col("aggregation_temporality"), F.lit(0))
    cumulative = temporality == CUMULATIVE
    return kind.isin(1, 5) | (kind == 2) & cumulative & F.coalesce(F.col("is_monotonic"), F.lit(False)) | kind.isin(3, 4) & cumulative


def run_pipeline_per_signal(frames: dict[str, DataFrame], stages) -> dict[str, DataFrame]:
    """Already parsed stages over every signal's frame."""
    return {signal: OplRun(signal).stages(df, stages) for signal, df in frames.items()}
