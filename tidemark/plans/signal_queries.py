"""Registered queries over traces and metrics, and over functions that the log queries leave out,
with the same results in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import values as V
from tidemark.operators import histogram, processors
from tidemark.operators.layout import attribute_map
from tidemark.plans.compile import run_kql, run_opl
from tidemark.sources.readers import events_as_logs, parse_syslog

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns_as_spans(turns: DataFrame) -> DataFrame:
    """The conversations table as spans: one a turn, its words as events, its parent as a link."""
    text = lambda c: V.Value(c, "string")
    number = lambda c: V.Value(c.cast("long"), "int")
    word = lambda n: F.struct(F.lit(n).alias("name"), attribute_map(size=number(F.length("text")), role=text(F.col("role"))).alias("attributes"))
    link = F.struct(F.col("conv_id").alias("trace_id"), (F.col("turn") - 1).alias("span_id"), attribute_map(to=number(F.col("turn") - 1)).alias("attributes"))
    return turns.select(
        F.col("conv_id").alias("trace_id"),
        F.col("turn").alias("span_id"),
        F.when(F.col("turn") > 0, F.col("turn") - 1).alias("parent_span_id"),
        F.col("role").alias("name"),
        attribute_map(size=number(F.length("text")), turn=number(F.col("turn"))).alias("attributes"),
        F.array(word("start"), word("end")).alias("events"),
        F.when(F.col("turn") > 0, F.array(link)).alias("links"),
        F.struct(attribute_map(service__name=text(F.concat(F.lit("chat-"), (F.col("conv_id") % 3).cast("string")))).alias("attributes")).alias("resource"),
    )


def events_as_metrics(events: DataFrame) -> DataFrame:
    """The events table as metrics of one point: the kind of metric follows the kind of event."""
    kind = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "view", 3).when(F.col("event_type") == "error", 4).otherwise(5)
    point = F.struct(F.col("user_id").alias("int_value"), F.col("value").alias("double_value"), attribute_map(user=V.Value(F.col("user_id"), "int")).alias("attributes"))
    return events.select(
        "event_id", F.col("event_type").alias("name"), kind.alias("metric_type"),
        F.when(F.col("user_id") % 2 == 0, 2).otherwise(1).alias("aggregation_temporality"), (F.col("user_id") % 3 == 0).alias("is_monotonic"),
        attribute_map(user=V.Value(F.col("user_id"), "int")).alias("attributes"), F.array(point).alias("data_points"), "user_id", "value", "ts",
    )


def _spans(run: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: run(turns_as_spans(_table(spark, sf_dir, "conversations"))).select("trace_id", "span_id", "name")


def _metrics(text: str) -> Query:
    return lambda spark, sf_dir: run_opl(text, events_as_metrics(_table(spark, sf_dir, "events")))["default"].select("event_id", "name")


def _logs(*values: str, where: str = "") -> Query:
    """OPL expressions set as attributes of logs, read back as columns a0, a1, ..."""
    stages = "".join(f' | set attributes["a{i}"] = {v}' for i, v in enumerate(values))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = run_opl("logs" + where + stages, events_as_logs(_table(spark, sf_dir, "events")))["default"]
        at = [V.to_string(V.Value(F.try_element_at("attributes", F.lit(f"a{i}")), "any")).alias(f"a{i}") for i in range(len(values))]
        return out.select("event_id", *at)

    return run


def _kql(table: str, text: str) -> Query:
    return lambda spark, sf_dir: run_kql(text, _table(spark, sf_dir, table))


def signals_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pipeline over all three signals; each keeps what it can tell."""
    events = _table(spark, sf_dir, "events")
    frames = {"logs": events_as_logs(events), "traces": turns_as_spans(_table(spark, sf_dir, "conversations")), "metrics": events_as_metrics(events)}
    out = run_opl("signals | where is Span or is Metric", frames)
    parts = [out[s].groupBy(F.lit(s).alias("signal")).agg(F.count("*").alias("n")) for s in frames]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def metric_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = run_opl("gauges | apply data_points { where double_value > 50 | set int_value = int_value + 1 }", events_as_metrics(_table(spark, sf_dir, "events")))["default"]
    return out.select("event_id", F.size("data_points").alias("n"), F.get("data_points", F.lit(0))["int_value"].alias("int_value"))


def reaggregated_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest point of a stream and day where the kind of metric allows it; the others pass."""
    m = events_as_metrics(_table(spark, sf_dir, "events"))
    out = processors.reaggregate(m.drop("attributes", "data_points"), [F.col("name"), F.col("user_id")], "ts", "1 day", processors.is_reaggregated())
    return out.select("event_id", "name")


def stream_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = events_as_metrics(_table(spark, sf_dir, "events"))
    named = m.withColumn("stream", processors.stream_id([F.col("name"), processors.sorted_map(F.col("attributes"))]))
    return named.agg(F.countDistinct("stream").alias("streams"))


def content_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ports = processors.route_by_attribute(events_as_logs(_table(spark, sf_dir, "events")), "service.name", {"svc-0": "a", "svc-1": "b", "svc-2": "a"})
    parts = [df.select("event_id", F.lit(port).alias("port")) for port, df in ports.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def type_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    ports = processors.route_by_type({"logs": events_as_logs(events).select("event_id"), "metrics": events_as_metrics(events).select("event_id"), "traces": events.select("event_id")}, {"logs": "x", "metrics": "x"})
    return ports["x"].groupBy("event_id").agg(F.count("*").alias("n"))


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return processors.batch_by_items(_table(spark, sf_dir, "events"), 64, ["ts", "event_id"], "batch").select("event_id", "batch")


def inner_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the histogram's quantiles stay within its error of the exact ones."""
    built = histogram.build(_table(spark, sf_dir, "events"), ["event_type"], "value")
    exact = _table(spark, sf_dir, "events").where("value > 0").groupBy(F.col("event_type").alias("t")).agg(*(F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY value)").alias(f"x{i}") for i, q in enumerate((0.25, 0.5, 0.9))))
    error = 2.5 * histogram.relative_error(F.col("scale"))
    near = [(F.abs(histogram.quantile(q) - F.col(f"x{i}")) <= error * F.col(f"x{i}")).alias(f"near{i}") for i, q in enumerate((0.25, 0.5, 0.9))]
    return built.join(exact, F.col("event_type") == F.col("t")).select("event_type", *near)


def merged_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = histogram.build(_table(spark, sf_dir, "events").withColumn("part", F.col("event_id") % 4), ["event_type", "part"], "value")
    merged = histogram.merge(parts, ["event_type"])
    held = F.aggregate("buckets", F.lit(0).cast("long"), lambda s, b: s + b["n"])
    return merged.select("event_type", "count", "min", "max", (held + F.col("zero_count")).alias("held"))


def syslog_rfc3164(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    line = F.concat(F.lit("<"), (F.col("user_id") % 8 + 8).cast("string"), F.lit(">Oct 11 22:14:15 host"), (F.col("user_id") % 4).cast("string"), F.lit(" su["), F.col("event_id").cast("string"), F.lit("]: "), F.col("event_type"))
    out = parse_syslog(e.select("event_id", line.alias("value")))
    return out.select("format", "time_text", "severity_text", "host", F.col("attributes")["syslog.proc_id"].alias("proc"), "body")


def syslog_cef(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    line = F.concat(F.lit("CEF:0|acme|fire wall|1.0|100|"), F.col("event_type"), F.lit("|"), (F.col("user_id") % 10).cast("string"), F.lit("|src=10.0.0."), (F.col("user_id") % 200).cast("string"), F.lit(" msg=two words act=ok"))
    out = parse_syslog(e.select("event_id", line.alias("value")))
    a = F.col("attributes")
    return out.select("format", a["cef.name"].alias("name"), a["cef.severity"].alias("severity"), a["cef.device_product"].alias("product"), a["cef.ext.src"].alias("src"), a["cef.ext.msg"].alias("msg"), a["cef.ext.act"].alias("act"))


_M = processors.Match
_S = "SELECT conv_id AS trace_id, turn AS span_id, role AS name FROM conversations"
_KIND = "CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'view' THEN 3 WHEN 'error' THEN 4 ELSE 5 END"

QUERIES: dict[str, tuple[Query, str]] = {
    "trace_filter_names": (_spans(lambda s: processors.filter_records(s, _M(names=("user",), resource_attributes={"service.name": "chat-1"}))), f"{_S} WHERE role = 'user' AND conv_id % 3 = 1"),
    "trace_filter_events": (_spans(lambda s: processors.filter_records(s, _M(event_names=("start",)), _M(event_names=("other",)))), _S),
    "trace_filter_event_attributes": (_spans(lambda s: processors.filter_records(s, _M(event_attributes={"role": "user"}), _M(strict=False, event_attributes={"size": "^[0-9]{1,2}$"}))), f"{_S} WHERE role = 'user' AND length(text) > 99"),
    "trace_filter_links": (_spans(lambda s: processors.filter_records(s, _M(link_attributes={"to": 0}))), f"{_S} WHERE turn = 1"),
    "opl_traces": (_spans(lambda s: run_opl('traces | where attributes["turn"] >= 1 and is Span and parent_span_id != null and name != "system"', s)["default"]), f"{_S} WHERE turn >= 1 AND role <> 'system'"),
    "signals_source": (signals_source, "SELECT 'traces' AS signal, count(*) AS n FROM conversations UNION ALL SELECT 'metrics', count(*) FROM events"),
    **{f"opl_{s}": (_metrics(f"{s} | where is {k}"), f"SELECT event_id, event_type AS name FROM events WHERE {_KIND} = {n}") for s, k, n in (("gauges", "Gauge", 1), ("sums", "Sum", 2), ("histograms", "Histogram", 3), ("exponential_histograms", "ExponentialHistogram", 4), ("summaries", "Summary", 5))},
    "opl_metrics_is": (_metrics('metrics | where is Gauge or attributes["user"] == 3 and is Sum'), f"SELECT event_id, event_type AS name FROM events WHERE {_KIND} = 1 OR user_id = 3 AND {_KIND} = 2"),
    "metric_filter": (lambda spark, sf_dir: processors.filter_records(events_as_metrics(_table(spark, sf_dir, "events")), _M(names=("click", "view")), _M(attributes={"user": 4})).select("event_id", "name"), "SELECT event_id, event_type AS name FROM events WHERE event_type IN ('click', 'view') AND user_id <> 4"),
    "metric_points": (metric_points, "SELECT event_id, CASE WHEN value > 50 THEN 1 ELSE 0 END AS n, CASE WHEN value > 50 THEN user_id + 1 END AS int_value FROM events WHERE event_type = 'click'"),
    "reaggregated_metrics": (reaggregated_metrics, f"WITH m AS (SELECT *, {_KIND} AS k, CASE WHEN user_id % 2 = 0 THEN 2 ELSE 1 END AS t FROM events), h AS (SELECT *, k IN (1, 5) OR (k = 2 AND t = 2 AND user_id % 3 = 0) OR (k IN (3, 4) AND t = 2) AS agg FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id, date_trunc('day', ts), agg ORDER BY ts DESC) AS n FROM h) SELECT event_id, event_type AS name FROM r WHERE NOT agg OR n = 1"),
    "stream_identity": (stream_identity, "SELECT count(DISTINCT (event_type, user_id)) AS streams FROM events"),
    "content_routes": (content_routes, "SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'a' ELSE 'rejected' END AS port FROM events"),
    "type_routes": (type_routes, "SELECT event_id, 2::BIGINT AS n FROM events"),
    "batches": (batches, "SELECT event_id, ((row_number() OVER (ORDER BY ts, event_id) - 1) // 64)::BIGINT AS batch FROM events"),
    "inner_quantiles": (inner_quantiles, "SELECT DISTINCT event_type, true AS near0, true AS near1, true AS near2 FROM events"),
    "merged_histograms": (merged_histograms, "SELECT event_type, count(*) AS count, min(value) AS min, max(value) AS max, count(*) AS held FROM events GROUP BY 1"),
    "syslog_rfc3164": (syslog_rfc3164, "SELECT 'rfc3164' AS format, 'Oct 11 22:14:15' AS time_text, (['emerg','alert','crit','err','warning','notice','info','debug'])[user_id % 8 + 1] AS severity_text, 'host' || user_id % 4 AS host, event_id::VARCHAR AS proc, event_type AS body FROM events"),
    "syslog_cef": (syslog_cef, "SELECT 'cef' AS format, event_type AS name, (user_id % 10)::VARCHAR AS severity, 'fire wall' AS product, '10.0.0.' || user_id % 200 AS src, 'two words' AS msg, 'ok' AS act FROM events"),
    "opl_concat_trim": (_logs('concat(severity_text, "-", attributes["user_id"])', 'ltrim(severity_text, "cp")', 'rtrim(severity_text, "pkw")', 'lower_case(upper_case(severity_text))', 'join("/", severity_text, "x")'), "SELECT event_id, event_type || '-' || user_id AS a0, ltrim(event_type, 'cp') AS a1, rtrim(event_type, 'pkw') AS a2, event_type AS a3, event_type || '/x' AS a4 FROM events"),
    "opl_digests": (_logs('encode(sha1(severity_text), "hex")', 'encode(sha256(severity_text), "base64")'), "SELECT event_id, sha1(event_type) AS a0, to_base64(unhex(sha256(event_type))) AS a1 FROM events"),
    "opl_regexps": (_logs('regexp_capture(severity_text, "(.)(.)", 2)', 'regexp_substr(severity_text, "[a-z]", 2, 2)', 'regexp_substr(severity_text, "E", 1, 1, "i")', 'regexp_substr(severity_text, "(?P<first>.)(.)", 1, 1, "c", "first")'), "SELECT event_id, substr(event_type, 2, 1) AS a0, substr(event_type, 3, 1) AS a1, CASE WHEN contains(event_type, 'e') THEN 'e' END AS a2, substr(event_type, 1, 1) AS a3 FROM events"),
    "opl_precedence": (_logs("1 + 2 * 3", "(1 + 2) * 3", "7 % 4 - 1", where=' | where severity_text == "click" or severity_text == "view" and attributes["value"] > 50'), "SELECT event_id, '7' AS a0, '9' AS a1, '2' AS a2 FROM events WHERE event_type = 'click' OR event_type = 'view' AND value > 50"),
    "kql_numbers": (_kql("events", "source | project event_id, up = ceiling(value), down = floor(value), minus = -value, huge = value < real(+inf), mixed = 1 + 2 * 3 - 4"), "SELECT event_id, ceil(value) AS up, floor(value) AS down, -value AS minus, true AS huge, 3::BIGINT AS mixed FROM events"),
    "kql_totimespan": (_kql("events", "source | project event_id, later = ts + totimespan('1.02:03:04')"), "SELECT event_id, ts + INTERVAL 1 DAY + INTERVAL 2 HOUR + INTERVAL 3 MINUTE + INTERVAL 4 SECOND AS later FROM events"),
    "kql_now": (_kql("events", "source | project event_id, past = ts < now(), further = now(1d) > now()"), "SELECT event_id, true AS past, true AS further FROM events"),
    "kql_cs_variants": (_kql("documents", "source | where text contains_cs 'License' and text !contains_cs 'license' and text !has_cs 'zzzz' | project doc_id"), "SELECT doc_id FROM documents WHERE contains(text, 'License') AND NOT contains(text, 'license') AND NOT contains(text, 'zzzz')"),
    "kql_regex_value": (_kql("pages", "source | where url matches regex parse_regex('PAGE=[0-9]+', 'i') | project page_id"), "SELECT page_id FROM pages WHERE regexp_matches(url, '(?i)PAGE=[0-9]+')"),
}
