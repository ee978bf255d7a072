"""Processors, layouts, histograms, sources, sinks and hashes against small hand-made frames."""

import datetime as dt
import json
import math
import statistics

import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.functions import hashing
from tidemark.functions import values as V
from tidemark.operators import histogram, layout, processors
from tidemark.sources import readers, sinks


def lit(x):
    return V.literal(x, {str: "string", int: "int", float: "double", bool: "bool"}[type(x)])


def maps(spark, rows):
    """A frame (id, attributes) from dicts."""
    frames = [spark.range(1).select(F.lit(i).alias("id"), (layout.attribute_map(**{k: lit(v) for k, v in r.items()}) if r is not None else F.lit(None).cast(V.ATTRIBUTES)).alias("attributes")) for i, r in rows.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def plain(m):
    pick = lambda v: next((x for x in (v.str, v.int, v.double, v.bool) if x is not None), None)
    return None if m is None else {k: pick(v) for k, v in m.items()}


def test_attribute_actions(spark):
    a = processors.Action
    df = maps(spark, {1: {"x": 1, "y": "b"}, 2: {}, 3: None})
    got = {r.id: plain(r.attributes) for r in processors.edit_attributes(df, [a("insert", "x", 9), a("update", "y", "c"), a("upsert", "z", True), a("rename", "z", new_key="w"), a("unknown", "x")]).collect()}
    assert got == {1: {"x": 1, "y": "c", "w": True}, 2: {"x": 9, "w": True}, 3: {"x": 9, "w": True}}


def test_attribute_actions_in_order(spark):
    a = processors.Action
    df = maps(spark, {1: {"x": 1, "y": "b"}, 2: {"w": 5}, 3: None})
    run = lambda *actions: {r.id: r.attributes and plain(r.attributes) for r in processors.edit_attributes(df, list(actions)).collect()}
    assert run(a("rename", "x", new_key="y"), a("rename", "y", new_key="x")) == {1: {"x": 1}, 2: {"w": 5}, 3: None}
    assert run(a("delete", "x"), a("update", "x", 3), a("rename", "w", new_key="x"), a("insert", "x", 4)) == {1: {"y": "b", "x": 4}, 2: {"x": 5}, 3: {"x": 4}}
    assert run(a("upsert", "y", 1), a("delete", "y"), a("delete", "nothing")) == {1: {"x": 1}, 2: {"w": 5}, 3: None}
    assert run(a("rename", "x", new_key="x"), a("unknown", "q")) == {1: {"x": 1, "y": "b"}, 2: {"w": 5}, 3: None}


def test_ratio_by_batch(spark):
    """Batches of 12, 4, 5 and 4 records at 2 of 5 keep 6, 1, 2 and 1."""
    sizes = {0: 12, 1: 4, 2: 5, 3: 4}
    df = spark.createDataFrame([(b, i) for b, n in sizes.items() for i in range(n)], "batch int, i int")
    got = processors.sample_ratio(df, 2, 5, ["i"], "batch").groupBy("batch").count().collect()
    assert {r["batch"]: r["count"] for r in got} == {0: 6, 1: 1, 2: 2, 3: 1}


def test_zip_and_edges(spark):
    at = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(at + dt.timedelta(minutes=i), i) for i in range(90)], "ts timestamp, i int")
    assert sorted(r.i for r in processors.sample_zip(df, 2, "1 hour", "ts").collect()) == [0, 1, 60, 61]
    assert processors.sample_ratio(df.limit(0), 1, 2, ["i"]).count() == 0
    with pytest.raises(ValueError):
        processors.sample_ratio(df, 3, 2, ["i"])


def test_filter_records(spark):
    df = maps(spark, {1: {"k": "a"}, 2: {"k": "b"}, 3: None}).withColumn("severity_number", F.when(F.col("id") < 3, F.col("id") * 8)).withColumn("severity_text", F.lit("x"))
    ids = lambda **m: sorted(r.id for r in processors.filter_records(df, processors.Match(**m)).collect())
    assert ids(attributes={"k": "a"}) == [1]
    assert ids(attributes={"k": "a|b"}, strict=False) == [1, 2]
    assert ids(severity_min=9) == [2] and ids(severity_min=9, match_undefined=True) == [2, 3]
    assert ids() == [1, 2, 3]


def test_condense(spark):
    df = maps(spark, {1: {"b": 2, "a": "x", "c": 1.5}, 2: {}})
    got = {r.id: plain(r.attributes) for r in processors.condense_attributes(df, "all", exclude_keys=["c"]).collect()}
    assert got == {1: {"c": 1.5, "all": "a=x;b=2"}, 2: {}}
    with pytest.raises(ValueError):
        processors.condense_attributes(df, "all", source_keys=["a"], exclude_keys=["b"])


def test_routes(spark):
    df = maps(spark, {1: {"t": "A"}, 2: {"t": "b"}, 3: {}}).select("id", F.struct("attributes").alias("resource"))
    got = processors.route_by_attribute(df, "t", {"a": "p", "b": "q"}, strict=False)
    assert {k: sorted(r.id for r in v.collect()) for k, v in got.items()} == {"p": [1], "q": [2], "rejected": [3]}
    ok, bad = processors.validate_resource(df, "t", ["A"])
    assert [r.id for r in ok.collect()] == [1] and bad.count() == 2
    assert set(processors.route_by_type({"logs": df, "traces": df}, {"logs": "x"})) == {"x"}


def test_reaggregate(spark):
    rows = [("a", 10, 1.0, 1, 0, None), ("a", 20, 2.0, 1, 0, None), ("a", 70, 3.0, 1, 0, None), ("b", 15, 4.0, 2, 1, True), ("b", 16, 5.0, 2, 1, True)]
    df = spark.createDataFrame(rows, "s string, t long, v double, metric_type int, aggregation_temporality int, is_monotonic boolean").withColumn("ts", F.timestamp_seconds("t"))
    got = processors.reaggregate(df, [F.col("s")], "ts", "60 seconds", processors.is_reaggregated())
    assert sorted(r.v for r in got.collect()) == [2.0, 3.0, 4.0, 5.0]


def test_star(spark):
    df = maps(spark, {1: {"a": 1, "b": "x"}, 2: {}, 3: None}).withColumn("n", F.col("id") * 2)
    root, attributes = layout.to_star(df, ["id"])
    assert attributes.count() == 2
    wide = {r.id: plain(r.attributes) for r in layout.to_wide(root, attributes, ["id"]).collect()}
    assert wide == {1: {"a": 1, "b": "x"}, 2: None, 3: None}
    assert layout.prune_orphans(root.where("id > 1"), attributes, ["id"], ["id"]).count() == 0
    assert [r.id for r in layout.where_attribute(root, attributes, ["id"], "b", "str", "x").collect()] == [1]


def test_delta_ids(spark):
    df = spark.createDataFrame([(0, 0, 1, "x"), (0, 1, 2, "x"), (0, 2, 5, "y"), (0, 3, 1, "y"), (1, 0, 7, "y")], "b int, o int, d int, k string")
    assert [r.id for r in layout.decode_delta(df, "b", "o", "d", "id").orderBy("b", "o").collect()] == [1, 3, 8, 9, 7]
    assert [r.id for r in layout.decode_quasi_delta(df, "b", "o", "d", ["k"], "id").orderBy("b", "o").collect()] == [1, 3, 5, 6, 7]


def test_bucket_index(spark):
    values = [1.0, 2.0, 3.0, 4.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    at = lambda s: [r[0] for r in df.select(histogram.bucket_index(F.col("v"), s)).collect()]
    assert at(1) == [-1, 1, 3, 3] and at(0) == [-1, 0, 1, 1] and at(-1) == [-1, 0, 0, 0]


def test_histogram(spark):
    import random

    rng = random.Random(1)
    values = {"a": [rng.lognormvariate(0, 2) for _ in range(3000)], "b": [1.0] * 5, "c": [0.0, -1.0, float("nan"), None, 3.0]}
    df = spark.createDataFrame([(k, v) for k, x in values.items() for v in x], "k string, v double")
    built = histogram.build(df, ["k"], "v", 80)
    rows = {r.k: r for r in built.select("*", histogram.quantile(0.5).alias("q"), histogram.quantile(0.0).alias("q0"), histogram.relative_error(F.col("scale")).alias("e")).collect()}
    a = rows["a"]
    assert a["count"] == 3000 and len(a.buckets) <= 80 and sum(b.n for b in a.buckets) == 3000
    assert a.buckets[-1]["index"] - a.buckets[0]["index"] < 80
    median = statistics.median(values["a"])
    assert abs(a.q - median) / median < 2.5 * a.e + 0.02
    assert rows["b"].q == 1.0 and rows["c"].zero_count == 1 and rows["c"]["count"] == 2 and rows["c"].q0 == 0.0
    halves = histogram.build(df.withColumn("h", F.col("v") > 1), ["k", "h"], "v", 80)
    merged = {r.k: r for r in histogram.merge(halves.drop("h"), ["k"], 80).collect()}
    assert merged["a"]["count"] == 3000 and merged["a"].scale <= a.scale and sum(b.n for b in merged["a"].buckets) == 3000


HASHES = {b"": (0xCBF29CE484222325, 0), b"a": (0xAF63DC4C8601EC8C, 0x3C2569B2), b"hello": (0xA430D84680AABD0B, 0x248BFA47)}


@pytest.mark.parametrize("data", list(HASHES))
def test_hash_vectors(data):
    fnv, murmur = HASHES[data]
    assert hashing.fnv1a_64(data) & (1 << 64) - 1 == fnv
    assert hashing.murmur3_32(data) == murmur
    assert hashing.xxh3_64(data) & (1 << 64) - 1 == xxhash.xxh3_64_intdigest(data)


def test_hash_columns(spark):
    df = spark.createDataFrame([("hello",), (None,)], "s string")
    r = df.select(hashing.fnv(F.col("s")), hashing.murmur3(F.col("s")), hashing.xxh3(F.col("s")), F.hex(hashing.xxh128(F.col("s"))), hashing.uuidv7()).collect()
    assert r[0][1] == 0x248BFA47 and tuple(r[1])[:4] == (None,) * 4
    assert r[0][4][14] == "7" and r[0][4][19] in "89ab" and r[0][4] != r[1][4]


def test_cbor():
    data = bytes.fromhex("a26161016162820203")
    assert hashing.decode_cbor(data) == {"a": 1, "b": [2, 3]}
    assert hashing.decode_cbor(bytes.fromhex("9f01f5f6ff")) == [1, True, None]
    assert hashing.decode_cbor(bytes.fromhex("fb3ff8000000000000")) == 1.5 and hashing.decode_cbor(bytes.fromhex("f93e00")) == 1.5
    assert hashing.decode_cbor(bytes.fromhex("3863")) == -100 and hashing.decode_cbor(bytes.fromhex("63616263")) == "abc"
    assert hashing.cbor_to_json(b"\xa2\x61") is None and json.loads(hashing.cbor_to_json(data)) == {"a": 1, "b": [2, 3]}


def test_syslog(spark):
    lines = [
        "<34>1 2003-10-11T22:14:15.003Z host.example su 12 ID47 [x@1 k=\"v\"] it failed",
        "<13>Oct 11 22:14:15 mymachine su[42]: 'su root' failed",
        "<13>Oct 11 22:14:15 host CEF:0|Vendor|Pro\\|duct|1.0|100|Name|5|src=1.2.3.4 msg=two words dst=x",
        "just text",
    ]
    got = readers.parse_syslog(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [r.format for r in got] == ["rfc5424", "rfc3164", "cef", "text"]
    assert got[0].severity_text == "crit" and got[0].host == "host.example" and got[0].body == "it failed" and got[0].attributes["syslog.proc_id"] == "12"
    assert got[1].severity_number == 10 and got[1].attributes == {"syslog.facility": "1", "syslog.app_name": "su", "syslog.proc_id": "42"} and got[1].body == "'su root' failed"
    assert got[2].attributes["cef.device_product"] == "Pro|duct" and got[2].attributes["cef.ext.msg"] == "two words" and got[2].attributes["cef.ext.dst"] == "x"
    assert got[3].body == "just text" and got[3].attributes == {}


def test_otlp_json(spark, tmp_path):
    log = {"timeUnixNano": "5", "severityNumber": 9, "body": {"stringValue": "hi"}, "attributes": [{"key": "a", "value": {"intValue": "3"}}, {"key": "a", "value": {"intValue": "4"}}]}
    doc = {"resourceLogs": [{"resource": {"attributes": [{"key": "r", "value": {"boolValue": True}}]}, "scopeLogs": [{"scope": {"name": "s"}, "logRecords": [log]}]}]}
    (tmp_path / "x.json").write_text(json.dumps(doc) + "\n")
    r = readers.read_otlp_json_logs(spark, str(tmp_path)).first()
    assert r.time_unix_nano == 5 and r.body.str == "hi" and r.attributes["a"].int == 4 and r.resource.attributes["r"].bool is True and r.instrumentation_scope.name == "s"


def test_poll_pages(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 9)], "t int, k int")
    cursor, seen = readers.Cursor(), []
    while True:
        page, after = readers.poll_page(df, "t", "k", cursor, 3)
        if after == cursor:
            break
        seen.append([tuple(r) for r in page.collect()])
        cursor = after
    assert seen == [[(1, 1), (1, 2), (2, 1)], [(3, 9)]]


def test_sinks(spark, tmp_path):
    df = maps(spark, {1: {"a": 1}, 2: {"a": 2, "b": "x"}}).drop("id").withColumn("n", F.lit(1))
    for part in ("p1", "p2"):
        sinks.write_star(df, str(tmp_path), part)
    attributes = spark.read.parquet(f"{tmp_path}/logs_attrs")
    logs = spark.read.parquet(f"{tmp_path}/logs")
    assert logs.count() == 4 and attributes.count() == 6
    assert logs.join(attributes, (logs["id"] == attributes["parent_id"]) & (logs["_part_id"] == attributes["_part_id"])).count() == 6
    keyed = sinks.keyed_messages(df, "t", key_columns=["n"]).collect()
    assert len({r.key for r in keyed}) == 1 and {r.topic for r in keyed} == {"t"}
    got = []

    def bad(_):
        raise RuntimeError("down")

    with pytest.raises(RuntimeError):
        sinks.fan_out(df, [bad, got.append])
    assert len(got) == 1
    sinks.fan_out(df, [bad], fallback=got.append)
    assert len(got) == 2
    tries = []

    def flaky(_):
        tries.append(1)
        if len(tries) < 3:
            raise RuntimeError("again")

    sinks.with_retries(flaky, wait_s=0)(df)
    assert len(tries) == 3


def test_quantile_of_nothing(spark):
    df = spark.createDataFrame([(0, 0.0, None, None, 0, 20, [])], "count long, sum double, min double, max double, zero_count long, scale int, buckets array<struct<index:long,n:long>>")
    assert math.isnan(df.select(histogram.quantile(0.5)).first()[0])


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_numbering_over_many_ranges(spark, adaptive):
    """No row is lost or numbered twice, however many ranges and tasks there are."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        n = 1_000_000
        wide = spark.range(0, n, 1, 12).select("id", F.pmod(F.xxhash64("id"), F.lit(5000)).alias("k"), F.when(F.col("id") % 97 > 0, F.lit("x" * 20)).alias("t"))
        kept = processors.sample_ratio(wide, 2, 5, ["k", "id"])
        assert kept.count() == n * 2 // 5 and kept.select("id").distinct().count() == n * 2 // 5
        sizes = processors.batch_by_items(wide, 1000, ["t", "k", "id"]).groupBy("_batch").count()
        assert [tuple(r) for r in sizes.groupBy("count").agg(F.count("*")).collect()] == [(1000, n // 1000)]
        order = processors.batch_by_items(wide, 250_000, ["k", "id"]).groupBy("_batch").agg(F.min("k").alias("a"), F.max("k").alias("b")).orderBy("_batch").collect()
        assert all(x["b"] <= y["a"] for x, y in zip(order, order[1:]))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_numbering_with_nulls_and_one_key(spark):
    df = spark.createDataFrame([(None, i) for i in range(50)] + [(1, i) for i in range(50, 100)], "k int, id long")
    assert processors.batch_by_items(df, 10, ["k"]).groupBy("_batch").count().where("count = 10").count() == 10
    assert processors.sample_ratio(df.limit(0), 1, 2, ["k"]).count() == 0


def test_hashes_of_many_values():
    import random

    import pyarrow as pa

    rng = random.Random(9)
    values = [rng.randbytes(rng.choice((0, 1, 2, 3, 4, 5, 7, 8, 63, 300, 5000))) for _ in range(400)] + [None, b""]
    for column in (pa.array(values, pa.binary()), pa.array([b"x", *values], pa.binary()).slice(1), pa.array([None, None], pa.binary()), pa.array([], pa.binary())):
        for one, several in ((hashing.fnv1a_64, hashing.fnv1a_64_several), (hashing.murmur3_32, hashing.murmur3_32_several)):
            assert hashing._together(column, one, several).to_pylist() == [None if b is None else one(b) for b in column.to_pylist()]
    assert hashing._together(pa.array([b"a"], pa.binary()), hashing.fnv1a_64, hashing.fnv1a_64_several)[0].as_py() == 0xAF63DC4C8601EC8C - (1 << 64)
    assert hashing._together(pa.array([b"hello"], pa.binary()), hashing.murmur3_32, hashing.murmur3_32_several)[0].as_py() == 0x248BFA47


def test_otlp_json_traces_and_metrics(spark, tmp_path):
    kv = lambda k, **v: {"key": k, "value": v}
    of = lambda **more: {"resource": {"attributes": [kv("service.name", stringValue="s")]}, **more}
    span = {"traceId": "0a" * 16, "spanId": "0b" * 8, "parentSpanId": "", "name": "op", "kind": 2, "startTimeUnixNano": "5", "endTimeUnixNano": "12", "attributes": [kv("n", intValue="7")], "events": [{"timeUnixNano": "6", "name": "e", "attributes": [kv("k", boolValue=True)]}], "links": [{"traceId": "0c" * 16, "spanId": "0d" * 8, "attributes": [kv("to", doubleValue=0.5)]}], "status": {"code": 1}}
    path = tmp_path / "traces.json"
    path.write_text(json.dumps({"resourceSpans": [of(scopeSpans=[{"scope": {"name": "lib"}, "spans": [span, {"name": "bare"}]}])]}))
    df = readers.read_otlp_json_traces(spark, str(path))
    got = {r.name: r for r in df.collect()}
    assert got["op"].duration_time_unix_nano == 7 and got["op"].parent_span_id is None and bytes(got["op"].trace_id) == b"\x0a" * 16
    assert got["op"].events[0].attributes["k"]["bool"] is True and got["op"].links[0].attributes["to"]["double"] == 0.5
    assert got["bare"].events is None and got["bare"].resource.attributes["service.name"]["str"] == "s"
    m = processors.Match
    assert [r.name for r in processors.filter_records(df, m(link_attributes={"to": 0.5}, event_attributes={"k": True})).collect()] == ["op"]
    points = [{"timeUnixNano": "9", "asInt": "4", "attributes": [kv("h", stringValue="x")]}]
    metrics = [{"name": "g", "gauge": {"dataPoints": points}}, {"name": "s", "sum": {"dataPoints": [{"asDouble": 1.5}], "aggregationTemporality": 2, "isMonotonic": True}}, {"name": "h", "histogram": {"dataPoints": [{"count": "3", "sum": 6.0, "bucketCounts": ["1", "2"], "explicitBounds": [1.0]}]}}, {"name": "other"}]
    path = tmp_path / "metrics.json"
    path.write_text(json.dumps({"resourceMetrics": [of(scopeMetrics=[{"metrics": metrics}])]}))
    got = {r.name: r for r in readers.read_otlp_json_metrics(spark, str(path)).collect()}
    assert [got[n].metric_type for n in ("g", "s", "h", "other")] == [1, 2, 3, None]
    assert got["g"].data_points[0].int_value == 4 and got["s"].is_monotonic and got["s"].aggregation_temporality == 2
    assert got["h"].data_points[0].bucket_counts == [1, 2] and got["other"].data_points is None
