"""Registered queries over the driver's tables, and the same results in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import histogram, layout, processors
from tidemark.plans import node_queries, signal_queries
from tidemark.plans.compile import run_kql, run_opl, run_ottl
from tidemark.sources.readers import events_as_logs, parse_syslog

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# KQL text over a table, and its SQL
KQL: dict[str, tuple[str, str, str]] = {
    "where_compare": ("events", "source | where event_type == 'error' and value > 50 | project event_id, value", "SELECT event_id, value FROM events WHERE event_type = 'error' AND value > 50"),
    "where_not_equal": ("events", "source | where event_type != 'view' and not(value <= 90.5) | project event_id", "SELECT event_id FROM events WHERE event_type <> 'view' AND value > 90.5"),
    "where_ignoring_case": ("events", "source | where event_type =~ 'ERROR' or event_type !~ 'click' and value < 5 | project event_id", "SELECT event_id FROM events WHERE lower(event_type) = 'error' OR (lower(event_type) <> 'click' AND value < 5)"),
    "where_contains": ("documents", "source | where text contains 'MIT License' or text has_cs 'Apache' | project doc_id", "SELECT doc_id FROM documents WHERE contains(lower(text), 'mit license') OR contains(text, 'Apache')"),
    "where_not_contains": ("documents", "source | where text !contains 'the' and text !has 'und' | project doc_id, lang", "SELECT doc_id, lang FROM documents WHERE NOT contains(lower(text), 'the') AND NOT contains(lower(text), 'und')"),
    "where_in": ("events", "source | where event_type in ('click', 'view') and user_id !in (1, 2, 3) | project event_id", "SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND user_id NOT IN (1, 2, 3)"),
    "where_in_ignoring_case": ("documents", "source | where lang in~ ('EN', 'Fr') and source !in~ ('SRC0') | project doc_id", "SELECT doc_id FROM documents WHERE lower(lang) IN ('en', 'fr') AND lower(source) <> 'src0'"),
    "where_regex": ("pages", "source | where url matches regex 'page=[0-9]+' | project page_id", "SELECT page_id FROM pages WHERE regexp_matches(url, 'page=[0-9]+')"),
    "where_false": ("events", "source | where false", "SELECT * FROM events WHERE false"),
    "extend_arithmetic": ("lineitem", "source | extend net = l_extendedprice * (1 - l_discount), whole = l_linenumber / 2, rest = l_orderkey % 7, twice = l_linenumber + l_linenumber | project l_orderkey, l_linenumber, net, whole, rest, twice", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, (l_linenumber // 2)::BIGINT AS whole, l_orderkey % 7 AS rest, (l_linenumber + l_linenumber)::BIGINT AS twice FROM lineitem"),
    "project_computed": ("orders", "source | project o_orderkey, half = o_totalprice / 2, urgent = o_orderpriority == '1-URGENT'", "SELECT o_orderkey, o_totalprice / 2 AS half, o_orderpriority = '1-URGENT' AS urgent FROM orders"),
    "project_keep": ("orders", "source | project-keep o_order*", "SELECT o_orderkey, o_orderstatus, o_orderdate, o_orderpriority FROM orders"),
    "project_away": ("customer", "source | project-away c_name, *bal", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer"),
    "project_rename": ("nation", "source | project-rename key = n_nationkey, nation = n_name", "SELECT n_nationkey AS key, n_name AS nation, n_regionkey FROM nation"),
    "summarize_by": ("lineitem", "source | summarize n = count(), qty = sum(l_linenumber), top = max(l_quantity), low = min(l_quantity), mean = avg(l_quantity) by l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_linenumber)::BIGINT AS qty, max(l_quantity) AS top, min(l_quantity) AS low, avg(l_quantity) AS mean FROM lineitem GROUP BY ALL"),
    "summarize_all": ("events", "source | summarize n = count(), top = max(value)", "SELECT count(*) AS n, max(value) AS top FROM events"),
    "summarize_empty": ("events", "source | where value < 0 - 1 | summarize n = count()", "SELECT 1::BIGINT AS n WHERE false"),
    "summarize_distinct": ("documents", "source | summarize by lang, source", "SELECT DISTINCT lang, source FROM documents"),
    "summarize_bin": ("events", "source | summarize n = count(), mean = avg(value) by at = bin(ts, 1h), event_type | where n > 1 | extend double_n = n * 2", "SELECT date_trunc('hour', ts) AS at, event_type, count(*) AS n, avg(value) AS mean, count(*) * 2 AS double_n FROM events GROUP BY 1, 2 HAVING count(*) > 1"),
    "bin_numbers": ("events", "source | project event_id, low = bin(value, 10), ten = bin(user_id, 10)", "SELECT event_id, floor(value / 10) * 10 AS low, user_id // 10 * 10 AS ten FROM events"),
    "let_and_function": ("events", "let limit = 40 + 2; let scaled = (x: double, by: double = 2.0) { let y = x * by; y + 1 }; source | where value > limit | project event_id, s = scaled(value), t = scaled(value, by = 10.0)", "SELECT event_id, value * 2.0 + 1 AS s, value * 10.0 + 1 AS t FROM events WHERE value > 42"),
    "string_functions": ("nation", "source | project n_nationkey, len = strlen(n_name), mid = substring(n_name, 1, 3), rest = substring(n_name, 2), cat = strcat(n_name, '-', n_regionkey), delim = strcat_delim('/', n_name, 'x', n_regionkey), rep = replace_string(n_name, 'A', '_')", "SELECT n_nationkey, length(n_name)::BIGINT AS len, substr(n_name, 2, 3) AS mid, substr(n_name, 3) AS rest, n_name || '-' || n_regionkey AS cat, n_name || '/x/' || n_regionkey AS delim, replace(n_name, 'A', '_') AS rep FROM nation"),
    "extract_regex": ("pages", "source | project page_id, page = toint(extract('page=([0-9]+)', 1, url)), none = extract('nothing([0-9])', 1, url)", "SELECT page_id, CASE WHEN regexp_matches(url, 'page=[0-9]+') THEN regexp_extract(url, 'page=([0-9]+)', 1)::BIGINT END AS page, NULL::VARCHAR AS none FROM pages"),
    "json_functions": ("events", "source | project event_id, k = toint(extract_json('$.k', props)), t = extract_json('$.k', props, typeof(long)), missing = extract_json('$.x', props), j = tostring(parse_json(props).k)", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, json_extract_string(props, '$.k')::BIGINT AS t, json_extract_string(props, '$.x') AS missing, json_extract_string(props, '$.k') AS j FROM events"),
    "conversions": ("events", "source | project event_id, a = toint('12'), b = tolong('x'), c = todouble('1.5'), d = tobool('true'), e = tostring(long(null)), f = toreal(event_type), g = todatetime('2024-01-02T03:04:05Z'), h = gettype(value)", "SELECT event_id, 12::BIGINT AS a, NULL::BIGINT AS b, 1.5::DOUBLE AS c, true AS d, '' AS e, NULL::DOUBLE AS f, TIMESTAMP '2024-01-02 03:04:05' AS g, 'real' AS h FROM events"),
    "conditionals": ("events", "source | project event_id, a = iff(value > 50, 'high', 'low'), b = case(value < 10, 1, value < 20, 2, 3), c = coalesce(tolong('invalid'), 18)", "SELECT event_id, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS a, CASE WHEN value < 10 THEN 1 WHEN value < 20 THEN 2 ELSE 3 END::BIGINT AS b, 18::BIGINT AS c FROM events"),
    "time_arithmetic": ("events", "source | project event_id, later = ts + 1h, earlier = ts - timespan(1.00:30:00), big = ts > datetime(2024-01-15)", "SELECT event_id, ts + INTERVAL 1 HOUR AS later, ts - INTERVAL 1 DAY - INTERVAL 30 MINUTE AS earlier, ts > TIMESTAMP '2024-01-15' AS big FROM events"),
    "array_functions": ("nation", "source | project n_nationkey, last = array_concat(dynamic([1, 2]), dynamic([3]))[-1], first = dynamic(['a', 'b'])[0]", "SELECT n_nationkey, 3::BIGINT AS last, 'a' AS first FROM nation"),
}

def _flat(df: DataFrame, *more: str) -> DataFrame:
    """user_id and value of an event as columns again, with further expressions."""
    at = lambda key, f: F.try_element_at("attributes", F.lit(key))[f]
    return df.select("event_id", "severity_text", at("user_id", "int").alias("user_id"), at("value", "double").alias("value"), *(F.expr(m) for m in more))


def _opl(text: str, *more: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _flat(run_opl(text, events_as_logs(_table(spark, sf_dir, "events")))["default"], *more)

    return run


_E = "event_id, event_type AS severity_text, user_id, value"
_TIER = "try_element_at(attributes, 'tier').str AS tier"
_SERVICE = "try_element_at(resource.attributes, 'service.name').str AS service"

OPL: dict[str, tuple[Query, str]] = {
    "opl_where_attribute": (_opl('logs | where attributes["value"] > 50 and attributes["user_id"] != 3'), f"SELECT {_E} FROM events WHERE value > 50 AND user_id <> 3"),
    "opl_where_null": (_opl('logs | where attributes["absent"] == null and not(severity_text == null) and attributes["absent"] != 1'), f"SELECT {_E} FROM events"),
    "opl_where_resource": (_opl('logs | where resource.attributes["service.name"] == "svc-1" or severity_text =~ "ERROR"', _SERVICE), f"SELECT {_E}, 'svc-' || user_id % 4 AS service FROM events WHERE user_id % 4 = 1 OR event_type = 'error'"),
    "opl_is_type": (_opl('logs | where attributes["value"] is Double and attributes["user_id"] is Integer and is Log and not(attributes["props"] is Integer)'), f"SELECT {_E} FROM events"),
    "opl_drop": (_opl("logs | drop"), f"SELECT {_E} FROM events WHERE false"),
    "opl_set": (_opl('logs | set attributes["tier"] = "gold", severity_text = upper_case(severity_text) | extend attributes["value"] = attributes["value"] * 2', _TIER), "SELECT event_id, upper(event_type) AS severity_text, user_id, value * 2 AS value, 'gold' AS tier FROM events"),
    "opl_rename": (_opl('logs | rename attributes "value" as "user_id", "absent" as "x"', "size(attributes) AS n"), "SELECT event_id, event_type AS severity_text, NULL::BIGINT AS user_id, NULL::DOUBLE AS value, 2 AS n FROM events"),
    "opl_remove": (_opl('logs | remove attributes["value"], attributes["absent"], resource.attributes["service.name"]', "size(attributes) AS n", "size(resource.attributes) AS m"), "SELECT event_id, event_type AS severity_text, user_id, NULL::DOUBLE AS value, 2 AS n, 0 AS m FROM events"),
    "opl_if_else": (_opl('logs | if (severity_text == "error") { set attributes["tier"] = "critical" } else if (attributes["value"] > 50) { set attributes["tier"] = "warm" } else { set attributes["tier"] = "info" }', _TIER), f"SELECT {_E}, CASE WHEN event_type = 'error' THEN 'critical' WHEN value > 50 THEN 'warm' ELSE 'info' END AS tier FROM events"),
    "opl_if_where": (_opl('logs | if (severity_text == "error") { where attributes["value"] > 50 } else if (severity_text == "view") { drop }'), f"SELECT {_E} FROM events WHERE CASE event_type WHEN 'error' THEN value > 50 WHEN 'view' THEN false ELSE true END"),
    "opl_fork": (_opl('logs | fork { where severity_text == "error" } { where attributes["value"] > 90 | set attributes["tier"] = "b" }', _TIER), f"SELECT {_E}, NULL AS tier FROM events WHERE event_type = 'error' UNION ALL SELECT {_E}, 'b' FROM events WHERE value > 90"),
    "opl_apply_where": (_opl('logs | apply attributes { where key != "props" | if (value is Integer) { set value = value + 1 } }', "size(attributes) AS n"), "SELECT event_id, event_type AS severity_text, user_id + 1 AS user_id, value, 2 AS n FROM events"),
    "opl_strings": (_opl('logs | set attributes["tier"] = concat_ws("-", substring(severity_text, 0, 3), replace(severity_text, "e", "3"), encode(sha256(severity_text), "hex"), md5(severity_text), regexp_substr(attributes["props"], "[0-9]+"))', _TIER), f"SELECT {_E}, concat_ws('-', substr(event_type, 1, 3), replace(event_type, 'e', '3'), sha256(event_type), md5(event_type), regexp_extract(props, '[0-9]+')) AS tier FROM events"),
    "opl_predicates": (_opl('logs | where starts_with(severity_text, "c") or ends_with(severity_text, "w") or contains(severity_text, "urch") or matches(severity_text, r"^s.g")'), f"SELECT {_E} FROM events WHERE event_type LIKE 'c%' OR event_type LIKE '%w' OR event_type LIKE '%urch%' OR regexp_matches(event_type, '^s.g')"),
}


def opl_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    ports = run_opl('logs | if (severity_text == "error") { route_to "alerts" } else if (severity_text == "view") { route_to "cold" }', events_as_logs(_table(spark, sf_dir, "events")))
    parts = [df.groupBy(F.lit(port).alias("port")).agg(F.count("*").alias("n")) for port, df in ports.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ottl_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(run_ottl('set(attributes["tier"], "x") where attributes["value"] > 50', events_as_logs(_table(spark, sf_dir, "events"))), _TIER)


def filter_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = events_as_logs(_table(spark, sf_dir, "events"))
    include = processors.Match(severity_texts=("error", "click"), resource_attributes={"service.name": "svc-2"})
    exclude = processors.Match(strict=False, attributes={"value": r"^1"})
    return _flat(processors.filter_records(logs, include, exclude))


def attribute_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = processors.Action
    actions = [a("insert", "value", 1.0), a("insert", "env", "prod"), a("update", "absent", "x"), a("delete", "user_id"), a("rename", "env", new_key="tier"), a("upsert", "user_id", 7), a("hash", "props", salt="s")]
    out = processors.edit_attributes(events_as_logs(_table(spark, sf_dir, "events")), actions)
    return _flat(out, _TIER, "try_element_at(attributes, 'props').str AS hashed", "size(attributes) AS n")


def ratio_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return processors.sample_ratio(_table(spark, sf_dir, "events"), 2, 5, ["ts", "event_id"]).select("event_id")


def zip_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return processors.sample_zip(_table(spark, sf_dir, "events"), 3, "1 hour", "ts", ["ts", "event_id"]).select("event_id")


def partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = processors.partition_by(events_as_logs(_table(spark, sf_dir, "events")), 'resource.attributes["service.name"]')
    return keyed.groupBy("_partition").agg(F.count("*").alias("n"))


def condense(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = processors.condense_attributes(events_as_logs(_table(spark, sf_dir, "events")), "all", source_keys=["user_id", "props"])
    return out.select("event_id", F.try_element_at("attributes", F.lit("all"))["str"].alias("condensed"), F.size("attributes").alias("n"))


def resource_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok, bad = processors.validate_resource(events_as_logs(_table(spark, sf_dir, "events")), "service.name", ["svc-0", "svc-3"])
    return ok.select("event_id", F.lit(True).alias("valid")).unionByName(bad.select("event_id", F.lit(False).alias("valid")))


def reaggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    return processors.reaggregate(e, [F.col("user_id"), F.col("event_type")], "ts", "1 day").select("user_id", "event_type", F.date_trunc("day", "ts").alias("day"), "event_id", "value")


def histogram_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = histogram.build(_table(spark, sf_dir, "events"), ["event_type"], "value")
    return built.select("event_type", "count", F.round("sum", 4).alias("sum"), "min", "max", histogram.quantile(0.0).alias("q0"), histogram.quantile(1.0).alias("q100"))


def star_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, attributes = layout.to_star(events_as_logs(_table(spark, sf_dir, "events")), ["event_id"])
    kept = layout.where_attribute(root, attributes, ["event_id"], "user_id", "int", 5)
    left = layout.prune_orphans(kept, attributes, ["event_id"], ["event_id"])
    return _flat(layout.to_wide(kept, left, ["event_id"]))


def attribute_join_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL over the star: attribute values counted by minute, the most frequent first."""
    root, attributes = layout.to_star(events_as_logs(_table(spark, sf_dir, "events")), ["event_id"])
    spark_sql = "SELECT a.int AS user_id, floor(l.time_unix_nano / 86400000000000) AS day, count(*) AS n FROM {l} l JOIN {a} a ON l.event_id = a.event_id WHERE a.key = 'user_id' GROUP BY 1, 2 ORDER BY n DESC, user_id, day LIMIT 20"
    return spark.sql(spark_sql, l=root, a=attributes)


def delta_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").withColumn("delta", F.col("event_id") % 3)
    return layout.decode_delta(e, "user_id", "event_id", "delta", "id").select("event_id", "id")


def quasi_delta_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").withColumn("delta", F.col("event_id") % 3)
    return layout.decode_quasi_delta(e, "user_id", "event_id", "delta", ["event_type"], "id").select("event_id", "id")


def wide_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = layout.wide_strings(events_as_logs(_table(spark, sf_dir, "events")))
    return out.select("event_id", "ServiceName", F.col("LogAttributes")["user_id"].alias("user_id"), "body")


def syslog(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    line = F.concat(F.lit("<"), (F.col("user_id") % 8 + 8).cast("string"), F.lit(">1 2024-01-02T03:04:05Z host"), (F.col("user_id") % 4).cast("string"), F.lit(" app - ID47 - "), F.col("event_type"))
    out = parse_syslog(e.select("event_id", line.alias("value")))
    return out.groupBy("format", "severity_text", "host").agg(F.count("*").alias("n"))


OTHERS: dict[str, tuple[Query, str | None]] = {
    "opl_route": (opl_route, "SELECT CASE event_type WHEN 'error' THEN 'alerts' WHEN 'view' THEN 'cold' ELSE 'default' END AS port, count(*) AS n FROM events GROUP BY 1"),
    "ottl_set": (ottl_set, f"SELECT {_E}, CASE WHEN value > 50 THEN 'x' END AS tier FROM events"),
    "filter_node": (filter_node, f"SELECT {_E} FROM events WHERE event_type IN ('error', 'click') AND user_id % 4 = 2 AND NOT regexp_matches(value::VARCHAR, '^1')"),
    "attribute_actions": (attribute_actions, "SELECT event_id, event_type AS severity_text, 7::BIGINT AS user_id, value, 'prod' AS tier, sha256('s' || props) AS hashed, 4 AS n FROM events"),
    "ratio_sampling": (ratio_sampling, "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS n FROM events) WHERE n % 5 < 2"),
    "zip_sampling": (zip_sampling, "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts, event_id) AS n FROM events) WHERE n <= 3"),
    "partition": (partition, "SELECT 'svc-' || user_id % 4 AS _partition, count(*) AS n FROM events GROUP BY 1"),
    "condense": (condense, "SELECT event_id, 'props=' || props || ';user_id=' || user_id AS condensed, 2 AS n FROM events"),
    "resource_validation": (resource_validation, "SELECT event_id, user_id % 4 IN (0, 3) AS valid FROM events"),
    "reaggregation": (reaggregation, "SELECT user_id, event_type, date_trunc('day', ts)::TIMESTAMP AS day, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, date_trunc('day', ts) ORDER BY ts DESC) AS n FROM events) WHERE n = 1"),
    "histogram_quantiles": (histogram_quantiles, "SELECT event_type, count(*) AS count, round(sum(value), 4) AS sum, min(value) AS min, max(value) AS max, min(value) AS q0, max(value) AS q100 FROM events GROUP BY 1"),
    "star_round_trip": (star_round_trip, f"SELECT {_E} FROM events WHERE user_id = 5"),
    "attribute_join_sql": (attribute_join_sql, "SELECT user_id, floor(epoch_us(ts) / 86400000000)::BIGINT AS day, count(*) AS n FROM events GROUP BY 1, 2 ORDER BY n DESC, user_id, day LIMIT 20"),
    "delta_ids": (delta_ids, "SELECT event_id, (sum(event_id % 3) OVER (PARTITION BY user_id ORDER BY event_id))::BIGINT AS id FROM events"),
    "quasi_delta_ids": (quasi_delta_ids, "WITH a AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS c FROM events), b AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM a) SELECT event_id, (sum(event_id % 3) OVER (PARTITION BY user_id, r ORDER BY event_id))::BIGINT AS id FROM b"),
    "wide_export": (wide_export, "SELECT event_id, 'svc-' || user_id % 4 AS \"ServiceName\", user_id::VARCHAR AS user_id, props AS body FROM events"),
    "syslog": (syslog, "SELECT 'rfc5424' AS format, (['emerg','alert','crit','err','warning','notice','info','debug'])[user_id % 8 + 1] AS severity_text, 'host' || user_id % 4 AS host, count(*) AS n FROM events GROUP BY ALL"),
}


def _kql(table: str, text: str) -> Query:
    return lambda spark, sf_dir: run_kql(text, _table(spark, sf_dir, table))


def queries() -> dict[str, Query]:
    return {f"kql_{n}": _kql(t, q) for n, (t, q, _) in KQL.items()} | {n: q for n, (q, _) in OPL.items()} | {n: q for n, (q, _) in OTHERS.items()} | {n: q for n, (q, _) in (signal_queries.QUERIES | node_queries.QUERIES).items()}


def oracle_sql() -> dict[str, str]:
    return {f"kql_{n}": s for n, (_, _, s) in KQL.items()} | {n: s for n, (_, s) in OPL.items()} | {n: s for n, (_, s) in OTHERS.items() if s} | {n: s for n, (_, s) in (signal_queries.QUERIES | node_queries.QUERIES).items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["kql_summarize_bin"](spark, sf_dir)
