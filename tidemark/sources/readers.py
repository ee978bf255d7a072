"""Sources: syslog and CEF text, OTLP JSON, exported star tables, events as telemetry, database pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import values as V
from tidemark.operators.layout import attribute_map

# syslog. The formats' patterns and severities.
RFC5424 = r"^<(\d{1,3})>(\d{1,2}) (\S+) (\S+) (\S+) (\S+) (\S+) (-|(?:\[(?:[^\]\\\"]|\\.|\"(?:[^\"\\]|\\.)*\")*\])+)(?: (?:﻿)?(.*))?$"
RFC3164 = r"^<(\d{1,3})>([A-Z][a-z]{2} [ \d]\d \d{2}:\d{2}:\d{2}) (\S+) (?:([^:\[\s]+)(?:\[([^\]]*)\])?: ?)?(.*)$"
CEF = r"CEF:(\d+)\|((?:[^|\\]|\\.)*)\|((?:[^|\\]|\\.)*)\|((?:[^|\\]|\\.)*)\|((?:[^|\\]|\\.)*)\|((?:[^|\\]|\\.)*)\|((?:[^|\\]|\\.)*)\|(.*)$"
CEF_FIELDS = ("cef.version", "cef.device_vendor", "cef.device_product", "cef.device_version", "cef.device_event_class_id", "cef.name", "cef.severity")
# syslog severities 0 to 7 as severity numbers and texts
SEVERITY_NUMBERS = (21, 19, 18, 17, 13, 10, 9, 5)
SEVERITY_TEXTS = ("emerg", "alert", "crit", "err", "warning", "notice", "info", "debug")


def parse_syslog(df: DataFrame, column: str = "value") -> DataFrame:
    """One log record per line: format (rfc5424, rfc3164, cef or text), severity, host, app, body
    and attributes (a map of texts). A line in no format is kept whole as the body."""
    line = F.col(column)
    a = lambda g: F.regexp_extract(line, RFC5424, g)
    b = lambda g: F.regexp_extract(line, RFC3164, g)
    is_a, is_b = line.rlike(RFC5424), line.rlike(RFC3164)
    cef = lambda g: F.regexp_extract(line, CEF, g)
    is_cef = line.rlike(CEF)
    priority = F.when(is_a, a(1)).when(is_b, b(1)).try_cast("int")
    severity = F.when(priority <= 191, priority % 8)
    of = lambda table: F.try_element_at(F.array(*map(F.lit, table)), severity + 1)
    unless_dash = lambda c: F.when((c != "-") & (c != ""), c)
    plain = lambda c: F.regexp_replace(c, r"\\(.)", "$1")
    pairs = F.create_map(*(x for name, c in (("syslog.facility", F.floor(priority / 8).cast("string")), ("syslog.app_name", F.when(is_a, unless_dash(a(5))).when(is_b, unless_dash(b(4)))), ("syslog.proc_id", F.when(is_a, unless_dash(a(6))).when(is_b, unless_dash(b(5)))), ("syslog.msg_id", F.when(is_a, unless_dash(a(7)))), ("syslog.structured_data", F.when(is_a, unless_dash(a(8))))) for x in (F.lit(name), c)))
    header = F.create_map(*(x for i, name in enumerate(CEF_FIELDS) for x in (F.lit(name), F.when(is_cef, plain(cef(i + 1))))))
    # extension: key=value pairs, where a value ends before the next key
    keys = F.regexp_extract_all(cef(8), F.lit(r"(?:^|\s)([A-Za-z0-9_.]+)=((?:[^=\\]|\\.)*)(?=\s[A-Za-z0-9_.]+=|$)"), F.lit(1))
    items = F.regexp_extract_all(cef(8), F.lit(r"(?:^|\s)([A-Za-z0-9_.]+)=((?:[^=\\]|\\.)*)(?=\s[A-Za-z0-9_.]+=|$)"), F.lit(2))
    pair = F.transform(F.arrays_zip(keys.alias("k"), items.alias("v")), lambda e: F.struct(F.concat(F.lit("cef.ext."), e["k"]).alias("k"), plain(F.trim(e["v"])).alias("v"), e["k"].alias("name")))
    first = F.filter(pair, lambda e: F.lit(True))
    extension = F.when(is_cef, F.map_from_entries(F.transform(F.array_distinct(F.transform(first, lambda e: e["k"])), lambda k: F.struct(k.alias("key"), F.filter(first, lambda e: e["k"] == k)[0]["v"].alias("value")))))
    empty = F.expr("cast(map() as map<string,string>)")
    attributes = F.map_filter(F.map_concat(pairs, header, F.coalesce(extension, empty)), lambda k, v: v.isNotNull())
    time = F.when(is_a, F.try_to_timestamp(a(3)))
    return df.select(
        F.when(is_cef, "cef").when(is_a, "rfc5424").when(is_b, "rfc3164").otherwise("text").alias("format"),
        time.alias("time"),
        F.when(is_b, b(2)).alias("time_text"),
        of(SEVERITY_NUMBERS).alias("severity_number"),
        of(SEVERITY_TEXTS).alias("severity_text"),
        F.when(is_a, unless_dash(a(4))).when(is_b, b(3)).alias("host"),
        F.when(is_a, a(9)).when(is_b, b(6)).otherwise(line).alias("body"),
        attributes.alias("attributes"),
    )


def read_syslog(spark: SparkSession, path: str) -> DataFrame:
    return parse_syslog(spark.read.text(path))


def events_as_logs(events: DataFrame) -> DataFrame:
    """The events table as log records in the nested layout."""
    as_int = lambda c: V.Value(F.col(c), "int")
    service = V.Value(F.concat(F.lit("svc-"), (F.col("user_id") % 4).cast("string")), "string")
    return events.select(
        "event_id",
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("time_unix_nano"),
        F.col("event_type").alias("severity_text"),
        F.when(F.col("event_type") == "error", 17).otherwise(9).alias("severity_number"),
        F.col("event_type").alias("event_name"),
        F.col("props").alias("body"),
        attribute_map(user_id=as_int("user_id"), value=V.Value(F.col("value"), "double"), props=V.Value(F.col("props"), "string")).alias("attributes"),
        F.struct(attribute_map(service__name=service).alias("attributes")).alias("resource"),
    )


# The JSON form of log exports.
_ANY_JSON = "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>"
_KV_JSON = f"array<struct<key:string,value:{_ANY_JSON}>>"
OTLP_LOGS_JSON = (
    f"resourceLogs array<struct<resource:struct<attributes:{_KV_JSON}>,schemaUrl:string,scopeLogs:array<struct<scope:struct<name:string,version:string,attributes:{_KV_JSON}>,"
    f"logRecords:array<struct<timeUnixNano:string,observedTimeUnixNano:string,severityNumber:int,severityText:string,eventName:string,body:{_ANY_JSON},attributes:{_KV_JSON},traceId:string,spanId:string,flags:bigint>>>>>>"
)


def _json_any(v: Column) -> Column:
    parts = [V.Value(v["stringValue"], "string"), V.Value(v["intValue"].try_cast("long"), "int"), V.Value(v["doubleValue"], "double"), V.Value(v["boolValue"], "bool")]
    return F.coalesce(*(V.wrap(p) for p in parts))


def _json_map(kv: Column) -> Column:
    """Of repeated keys the last counts."""
    keys = F.array_distinct(F.transform(kv, lambda e: e["key"]))
    entry = lambda k: F.struct(k.alias("key"), _json_any(F.element_at(F.filter(kv, lambda e: e["key"] == k), -1)["value"]).alias("value"))
    return F.map_from_entries(F.transform(keys, entry))


def read_otlp_json_logs(spark: SparkSession, path: str) -> DataFrame:
    """Log records of exported JSON lines, in the nested layout."""
    return _otlp_logs(spark.read.schema(OTLP_LOGS_JSON).json(path))


def messages(spark: SparkSession, servers: str, topics: str, starting: str = "latest", **options: str) -> DataFrame:
    """A stream of a message broker's topics, through Spark's own source, whose package must be on
    the class path. Offsets are kept by the checkpoint of the query that reads it."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics).option("startingOffsets", starting)
    return reader.option("includeHeaders", "true").options(**options).load()


def message_logs(received: DataFrame) -> DataFrame:
    """Log records of messages whose value is one exported JSON document; values that aren't have none."""
    return _otlp_logs(received.select(F.from_json(F.col("value").cast("string"), OTLP_LOGS_JSON).alias("v")).select("v.*"))


def _otlp_logs(lines: DataFrame) -> DataFrame:
    r = lines.select(F.explode("resourceLogs").alias("r"))
    s = r.select("r.resource", "r.schemaUrl", F.explode("r.scopeLogs").alias("s"))
    x = s.select("resource", "schemaUrl", "s.scope", F.explode("s.logRecords").alias("x"))
    return x.select(
        F.col("x.timeUnixNano").try_cast("long").alias("time_unix_nano"),
        F.col("x.observedTimeUnixNano").try_cast("long").alias("observed_time_unix_nano"),
        F.col("x.severityNumber").alias("severity_number"),
        F.col("x.severityText").alias("severity_text"),
        F.col("x.eventName").alias("event_name"),
        _json_any(F.col("x.body")).alias("body"),
        _json_map(F.col("x.attributes")).alias("attributes"),
        F.unhex("x.traceId").alias("trace_id"),
        F.unhex("x.spanId").alias("span_id"),
        F.col("x.flags").alias("flags"),
        F.struct(F.col("schemaUrl").alias("schema_url"), _json_map(F.col("resource.attributes")).alias("attributes")).alias("resource"),
        F.struct(F.col("scope.name").alias("name"), F.col("scope.version").alias("version"), _json_map(F.col("scope.attributes")).alias("attributes")).alias("instrumentation_scope"),
    )


_SCOPE_JSON = f"scope:struct<name:string,version:string,attributes:{_KV_JSON}>"
_RESOURCE_JSON = f"resource:struct<attributes:{_KV_JSON}>,schemaUrl:string"
_SPAN_JSON = (
    f"struct<traceId:string,spanId:string,parentSpanId:string,traceState:string,name:string,kind:int,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{_KV_JSON},"
    f"events:array<struct<timeUnixNano:string,name:string,attributes:{_KV_JSON}>>,links:array<struct<traceId:string,spanId:string,traceState:string,attributes:{_KV_JSON}>>,status:struct<code:int,message:string>>"
)
OTLP_TRACES_JSON = f"resourceSpans array<struct<{_RESOURCE_JSON},scopeSpans:array<struct<{_SCOPE_JSON},spans:array<{_SPAN_JSON}>>>>>"
_POINT_JSON = f"struct<startTimeUnixNano:string,timeUnixNano:string,asInt:string,asDouble:double,count:string,sum:double,min:double,max:double,bucketCounts:array<string>,explicitBounds:array<double>,attributes:{_KV_JSON},flags:bigint>"
_POINTS_JSON = f"dataPoints:array<{_POINT_JSON}>,aggregationTemporality:int,isMonotonic:boolean"
_METRIC_JSON = f"struct<name:string,description:string,unit:string,gauge:struct<{_POINTS_JSON}>,sum:struct<{_POINTS_JSON}>,histogram:struct<{_POINTS_JSON}>>"
OTLP_METRICS_JSON = f"resourceMetrics array<struct<{_RESOURCE_JSON},scopeMetrics:array<struct<{_SCOPE_JSON},metrics:array<{_METRIC_JSON}>>>>>"
# The kinds of metrics that are read, and their numbers.
_METRIC_KINDS = (("gauge", 1), ("sum", 2), ("histogram", 3))


def _scoped(lines: DataFrame, resources: str, scopes: str, records: str) -> tuple[DataFrame, list[Column]]:
    """Records (x) exploded out of resources and scopes, and the columns that name both."""
    r = lines.select(F.explode(resources).alias("r"))
    s = r.select("r.resource", "r.schemaUrl", F.explode(f"r.{scopes}").alias("s"))
    x = s.select("resource", "schemaUrl", "s.scope", F.explode(f"s.{records}").alias("x"))
    resource = F.struct(F.col("schemaUrl").alias("schema_url"), _json_map(F.col("resource.attributes")).alias("attributes")).alias("resource")
    scope = F.struct(F.col("scope.name").alias("name"), F.col("scope.version").alias("version"), _json_map(F.col("scope.attributes")).alias("attributes")).alias("instrumentation_scope")
    return x, [resource, scope]


def read_otlp_json_traces(spark: SparkSession, path: str) -> DataFrame:
    """Spans of exported JSON lines, with their events and links, in the nested layout."""
    x, named = _scoped(spark.read.schema(OTLP_TRACES_JSON).json(path), "resourceSpans", "scopeSpans", "spans")
    start, end = F.col("x.startTimeUnixNano").try_cast("long"), F.col("x.endTimeUnixNano").try_cast("long")
    event = lambda e: F.struct(e["timeUnixNano"].try_cast("long").alias("time_unix_nano"), e["name"].alias("name"), _json_map(e["attributes"]).alias("attributes"))
    link = lambda e: F.struct(F.unhex(e["traceId"]).alias("trace_id"), F.unhex(e["spanId"]).alias("span_id"), e["traceState"].alias("trace_state"), _json_map(e["attributes"]).alias("attributes"))
    return x.select(
        F.unhex("x.traceId").alias("trace_id"),
        F.unhex("x.spanId").alias("span_id"),
        F.unhex(F.nullif("x.parentSpanId", F.lit(""))).alias("parent_span_id"),
        F.col("x.traceState").alias("trace_state"),
        F.col("x.name").alias("name"),
        F.col("x.kind").alias("kind"),
        start.alias("start_time_unix_nano"),
        (end - start).alias("duration_time_unix_nano"),
        F.col("x.status").alias("status"),
        _json_map(F.col("x.attributes")).alias("attributes"),
        F.transform("x.events", event).alias("events"),
        F.transform("x.links", link).alias("links"),
        *named,
    )


def read_otlp_json_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Gauges, sums and histograms of exported JSON lines with their data points; metrics of other
    kinds have a null metric_type and no points."""
    x, named = _scoped(spark.read.schema(OTLP_METRICS_JSON).json(path), "resourceMetrics", "scopeMetrics", "metrics")
    kind, data = F.lit(None).cast("int"), F.lit(None)
    for name, number in reversed(_METRIC_KINDS):
        held = F.col(f"x.{name}")
        kind, data = F.when(held.isNotNull(), number).otherwise(kind), F.when(held.isNotNull(), held).otherwise(data)
    whole = lambda c: c.try_cast("long")
    point = lambda p: F.struct(
        whole(p["startTimeUnixNano"]).alias("start_time_unix_nano"), whole(p["timeUnixNano"]).alias("time_unix_nano"),
        whole(p["asInt"]).alias("int_value"), p["asDouble"].alias("double_value"), whole(p["count"]).alias("count"), p["sum"].alias("sum"), p["min"].alias("min"), p["max"].alias("max"),
        F.transform(p["bucketCounts"], whole).alias("bucket_counts"), p["explicitBounds"].alias("explicit_bounds"), _json_map(p["attributes"]).alias("attributes"), p["flags"].alias("flags"),
    )
    x = x.withColumn("data", data)
    return x.select(
        F.col("x.name").alias("name"), F.col("x.description").alias("description"), F.col("x.unit").alias("unit"), kind.alias("metric_type"),
        F.col("data.aggregationTemporality").alias("aggregation_temporality"), F.col("data.isMonotonic").alias("is_monotonic"),
        F.transform("data.dataPoints", point).alias("data_points"), *named,
    )


@dataclass(frozen=True)
class Cursor:
    """Where a poller has come to: a time and a unique tie-breaker."""

    time: object = None
    tie: int | None = None


def poll_page(source: DataFrame, time_col: str, tie_col: str, after: Cursor, rows: int) -> tuple[DataFrame, Cursor]:
    """The next page of a source in ascending (time, tie) order, and the cursor behind it.

    The predicate is one that a JDBC source pushes down. Reading a page again from the old cursor
    gives the same rows, so a page that couldn't be delivered is rewound by keeping the cursor.
    """
    if after.time is not None:
        t, k = F.lit(after.time), F.lit(after.tie)
        source = source.where((F.col(time_col) > t) | (F.col(time_col) == t) & (F.col(tie_col) > k))
    page = source.orderBy(time_col, tie_col).limit(rows)
    last = page.agg(F.max(F.struct(time_col, tie_col)).alias("m")).first()["m"]
    return page, after if last is None else Cursor(last[0], last[1])


def generate_logs(spark: SparkSession, rows: int, body_bytes: int = 1024, unique: int = 512, tasks: int | None = None) -> DataFrame:
    """Synthetic log records with bodies of a fixed size, ``unique`` different ones."""
    base = spark.range(0, rows, 1, tasks) if tasks else spark.range(rows)
    kind = F.col("id") % unique
    body = F.substring(F.repeat(F.concat(F.lit("log message "), kind.cast("string"), F.lit(" ")), body_bytes // 13 + 1), 1, body_bytes)
    severity = F.element_at(F.array(F.lit(5), F.lit(9), F.lit(13), F.lit(17)), (F.col("id") % 4 + 1).cast("int"))
    return base.select(
        (F.col("id") * 1_000_000).alias("time_unix_nano"),
        severity.alias("severity_number"),
        V.wrap(V.Value(body, "string")).alias("body"),
        attribute_map(kind=V.Value(kind, "int"), host=V.Value(F.concat(F.lit("h"), (F.col("id") % 16).cast("string")), "string")).alias("attributes"),
    )
