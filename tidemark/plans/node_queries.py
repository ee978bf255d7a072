"""Registered queries over the star of spans, wide spans, debug and batch nodes, messages and
functions without a row elsewhere, with the same results in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import layout, processors
from tidemark.plans.signal_queries import Query, _kql, _logs, _table, events_as_metrics, turns_as_spans
from tidemark.sources.readers import events_as_logs, message_logs


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = turns_as_spans(_table(spark, sf_dir, "conversations"))
    return spans.withColumn("id", F.concat_ws("-", "trace_id", "span_id"))


def span_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans taken apart into five tables and put together again."""
    tables = layout.to_tables(_spans(spark, sf_dir), "spans", ["id"])
    back = layout.from_tables(tables, "spans", ["id"])
    event = lambda i, key: F.get("events", F.lit(i))["attributes"][key]
    return back.select(
        "trace_id", "span_id", "name", F.col("attributes")["size"]["int"].alias("size"), F.size("events").alias("events"), F.get("events", F.lit(1))["name"].alias("last_event"),
        event(0, "role")["str"].alias("role"), F.get("links", F.lit(0))["span_id"].alias("linked"), F.get("links", F.lit(0))["attributes"]["to"]["int"].alias("linked_to"),
    )


def span_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each of the tables."""
    parts = [df.agg(F.count("*").alias("n")).withColumn("name", F.lit(t)) for t, df in layout.to_tables(_spans(spark, sf_dir), "spans", ["id"]).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def point_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The data points of metrics as rows of their own, with one attribute of each."""
    metrics = events_as_metrics(_table(spark, sf_dir, "events")).select("event_id", "name", "attributes", "data_points")
    tables = layout.to_tables(metrics, "metrics", ["event_id"])
    points, attributes = tables["metrics_points"], tables["metrics_points_attrs"].where("key = 'user'").select("event_id", "child_id", F.col("int").alias("user"))
    return points.join(attributes, ["event_id", "child_id"]).select("event_id", "child_id", "double_value", "user")


def wide_span_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = layout.wide_spans(turns_as_spans(_table(spark, sf_dir, "conversations")))
    return out.select(
        "TraceId", "SpanId", "ParentSpanId", "SpanName", "SpanKind", "ServiceName", "StatusCode", F.col("SpanAttributes")["turn"].alias("turn"),
        F.array_join("`Events.Name`", ",").alias("event_names"), F.get("`Events.Attributes`", F.lit(1))["size"].alias("event_size"),
        F.array_join("`Links.SpanId`", ",").alias("linked"), F.size("`Links.Attributes`").alias("links"),
    )


def attribute_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """And, or and not over attribute rows, by one aggregate."""
    root, attributes = layout.to_star(events_as_logs(_table(spark, sf_dir, "events")), ["event_id"])
    tests = {"high": (F.col("key") == "value") & (F.col("double") > 50), "few": (F.col("key") == "user_id") & (F.col("int") < 100), "fifth": (F.col("key") == "user_id") & (F.col("int") % 5 == 0)}
    return layout.where_attributes(root, attributes, ["event_id"], tests, F.expr("(high OR few) AND NOT fifth")).select("event_id")


def debug_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    return processors.debug_report({"logs": events_as_logs(events), "metrics": events_as_metrics(events), "traces": turns_as_spans(_table(spark, sf_dir, "conversations"))})


def debug_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return processors.debug_report({"logs": events_as_logs(_table(spark, sf_dir, "events"))}, {"user_id": 5})


def debug_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return processors.debug_sample(_table(spark, sf_dir, "events"), 2, 3, "1 day", "ts", ["ts", "event_id"]).select("event_id")


def byte_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return processors.batch_by_bytes(_table(spark, sf_dir, "events"), 4096, ["ts", "event_id"], F.octet_length("props") + 16, "batch").select("event_id", "batch")


def request_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return processors.batch_by_requests(_table(spark, sf_dir, "events"), 3, "user_id", "batch").select("event_id", "batch")


def logs_of_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages of exported JSON, read back as log records."""
    item = lambda key, kind, value: F.struct(F.lit(key).alias("key"), F.struct(value.alias(kind)).alias("value"))
    record = F.struct(
        F.col("event_id").cast("string").alias("timeUnixNano"), F.col("event_type").alias("severityText"),
        F.struct(F.col("props").alias("stringValue")).alias("body"), F.array(item("user", "intValue", F.col("user_id").cast("string"))).alias("attributes"),
    )
    resource = F.struct(F.array(item("service.name", "stringValue", F.concat(F.lit("svc-"), (F.col("user_id") % 4).cast("string")))).alias("attributes"))
    scoped = F.struct(F.struct(F.lit("app").alias("name")).alias("scope"), F.array(record).alias("logRecords"))
    document = F.struct(F.array(F.struct(resource.alias("resource"), F.array(scoped).alias("scopeLogs"))).alias("resourceLogs"))
    out = message_logs(_table(spark, sf_dir, "events").select(F.to_json(document).cast("binary").alias("value")))
    return out.select(
        F.col("time_unix_nano").alias("event_id"), "severity_text", F.col("body")["str"].alias("body"), F.col("attributes")["user"]["int"].alias("user_id"),
        F.col("resource.attributes")["service.name"]["str"].alias("service"), F.col("instrumentation_scope.name").alias("scope"),
    )


def exemplars_of_aggregated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exemplars of aggregated metrics go, those of metrics that pass stay."""
    m = events_as_metrics(_table(spark, sf_dir, "events")).drop("attributes", "data_points").withColumn("exemplars", F.array("value"))
    out = processors.reaggregate(m, [F.col("name"), F.col("user_id")], "ts", "1 day", processors.is_reaggregated())
    return out.groupBy("metric_type").agg(F.count("exemplars").alias("exemplars"))


def ids_made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether made ids have their shape: random and time-ordered ones."""
    made = _logs("uuid()", "uuidv7()")(spark, sf_dir)
    hexes = "^[0-9a-f]{8}-[0-9a-f]{4}-%s[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
    return made.agg(F.min(F.col("a0").rlike(hexes % "4")).alias("random"), F.min(F.col("a1").rlike(hexes % "7")).alias("ordered"), (F.countDistinct("a1") == F.count("*")).alias("distinct"))


_Q = "SELECT conv_id AS trace_id, turn AS span_id, role AS name"
# Public test vectors of the hashes, for the text "hello".
_HELLO = {"fnv": 0xA430D84680AABD0B - (1 << 64), "murmur3": 0x248BFA47}

QUERIES: dict[str, tuple[Query, str]] = {
    "span_star": (span_star, f"{_Q}, length(text) AS size, 2 AS events, 'end' AS last_event, role AS role, CASE WHEN turn > 0 THEN turn - 1 END AS linked, CASE WHEN turn > 0 THEN turn - 1 END AS linked_to FROM conversations"),
    "span_tables": (span_tables, "SELECT 'spans' AS name, count(*) AS n FROM conversations UNION ALL SELECT 'spans_attrs', 2 * count(*) FROM conversations UNION ALL SELECT 'spans_events', 2 * count(*) FROM conversations UNION ALL SELECT 'spans_events_attrs', 4 * count(*) FROM conversations UNION ALL SELECT 'spans_links', count(*) FROM conversations WHERE turn > 0 UNION ALL SELECT 'spans_links_attrs', count(*) FROM conversations WHERE turn > 0"),
    "point_tables": (point_tables, "SELECT event_id, 0 AS child_id, value AS double_value, user_id AS \"user\" FROM events"),
    "wide_span_export": (wide_span_export, "SELECT conv_id::VARCHAR AS \"TraceId\", turn::VARCHAR AS \"SpanId\", CASE WHEN turn > 0 THEN (turn - 1)::VARCHAR ELSE '' END AS \"ParentSpanId\", role AS \"SpanName\", 'Unspecified' AS \"SpanKind\", 'chat-' || conv_id % 3 AS \"ServiceName\", 'Unset' AS \"StatusCode\", turn::VARCHAR AS turn, 'start,end' AS event_names, length(text)::VARCHAR AS event_size, CASE WHEN turn > 0 THEN (turn - 1)::VARCHAR ELSE '' END AS linked, CASE WHEN turn > 0 THEN 1 ELSE 0 END AS links FROM conversations"),
    "attribute_algebra": (attribute_algebra, "SELECT event_id FROM events WHERE (value > 50 OR user_id < 100) AND NOT user_id % 5 = 0"),
    "debug_report": (debug_report, "SELECT 'logs' AS signal, count(*) AS records, 3 * count(*) AS attributes, 0 AS events, 0 AS links, 0 AS data_points FROM events UNION ALL SELECT 'metrics', count(*), count(*), 0, 0, count(*) FROM events UNION ALL SELECT 'traces', count(*), 2 * count(*), 2 * count(*), count(*) FILTER (turn > 0), 0 FROM conversations"),
    "debug_matching": (debug_matching, "SELECT 'logs' AS signal, count(*) AS records, 3 * count(*) AS attributes, 0 AS events, 0 AS links, 0 AS data_points FROM events WHERE user_id = 5"),
    "debug_sampling": (debug_sampling, "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts, event_id) AS n FROM events) WHERE n <= 2 OR (n - 2) % 3 = 0"),
    "byte_batches": (byte_batches, "SELECT event_id, coalesce(sum(strlen(props) + 16) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // 4096 AS batch FROM events"),
    "request_batches": (request_batches, "SELECT event_id, ((dense_rank() OVER (ORDER BY user_id) - 1) // 3)::BIGINT AS batch FROM events"),
    "logs_of_messages": (logs_of_messages, "SELECT event_id, event_type AS severity_text, props AS body, user_id, 'svc-' || user_id % 4 AS service, 'app' AS scope FROM events"),
    "exemplars_of_aggregated": (exemplars_of_aggregated, "WITH m AS (SELECT *, CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'view' THEN 3 WHEN 'error' THEN 4 ELSE 5 END AS k FROM events) SELECT k AS metric_type, count(*) FILTER (NOT (k IN (1, 5) OR (user_id % 2 = 0 AND (k IN (3, 4) OR user_id % 3 = 0)))) AS exemplars FROM m GROUP BY 1"),
    "ids_made": (ids_made, "SELECT true AS random, true AS ordered, true AS \"distinct\""),
    "opl_hash_vectors": (_logs('fnv("hello")', 'murmur3("hello")', 'encode(sha512(severity_text), "hex") == null'), f"SELECT event_id, '{_HELLO['fnv']}' AS a0, '{_HELLO['murmur3']}' AS a1, 'false' AS a2 FROM events"),
    "opl_casts": (_logs("severity_number as String", 'attributes["user_id"] as Double', "log10(1000)"), "SELECT event_id, CASE WHEN event_type = 'error' THEN '17' ELSE '9' END AS a0, user_id::DOUBLE::VARCHAR AS a1, '3.0' AS a2 FROM events"),
    "kql_comments": (_kql("events", "// the errors\nsource // all of them\n| where event_type == 'error' // only\n| project event_id"), "SELECT event_id FROM events WHERE event_type = 'error'"),
    "kql_names": (_kql("events", "source | summarize count(), max(value), avg(value) by event_type"), "SELECT event_type, count(*) AS count, max(value) AS max_value, avg(value) AS avg_value FROM events GROUP BY 1"),
    "kql_long_lists": (_kql("events", "source | where user_id in (" + ", ".join(str(i) for i in range(0, 300, 7)) + ") | project event_id"), "SELECT event_id FROM events WHERE user_id < 300 AND user_id % 7 = 0"),
}
