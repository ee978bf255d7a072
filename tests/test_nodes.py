"""Durable buffers, topics, Arrow IPC, the star of spans as a sink, batches and debug nodes."""

import datetime as dt

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import values as V
from tidemark.operators import layout, processors
from tidemark.plans.signal_queries import turns_as_spans
from tidemark.plans.syntax import QueryError
from tidemark.sources import sinks
from tidemark.sources.arrow_ipc import batches_of, read_arrow_ipc
from tidemark.sources.readers import message_logs
from tidemark.streaming import buffer


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "n long")


def test_buffer_keeps_order_and_failed_segments(spark, tmp_path):
    b = buffer.DurableBuffer(spark, str(tmp_path))
    assert b.pending() == [] and b.forward(lambda df: None) == 0
    assert b.put(numbers(spark, 1, 2), 0) and b.put(numbers(spark, 3), 1) and b.put(numbers(spark), 2)
    assert not b.put(numbers(spark, 9), 1)  # a micro-batch that is run again
    got = []

    def sink(df):
        if got:
            raise RuntimeError("down")
        got.append(sorted(r.n for r in df.collect()))

    with pytest.raises(RuntimeError):
        b.forward(sink)
    assert got == [[1, 2]] and b.pending() == [1, 2]
    later = buffer.DurableBuffer(spark, str(tmp_path))  # what another driver finds
    assert not later.put(numbers(spark, 1, 2), 0)
    assert later.forward(lambda df: got.append([r.n for r in df.collect()])) == 2
    assert got == [[1, 2], [3], []] and later.pending() == []


def test_buffer_limits(spark, tmp_path):
    small = buffer.DurableBuffer(spark, f"{tmp_path}/a")
    small.put(numbers(spark, 1), 0)
    size = small._bytes("segments", "000000000000")
    held = buffer.DurableBuffer(spark, f"{tmp_path}/a", size_cap=size + 10)
    with pytest.raises(buffer.BufferFull):
        held.put(numbers(spark, 2), 1)
    assert held.pending() == [0]
    dropping = buffer.DurableBuffer(spark, f"{tmp_path}/a", size_cap=size + 10, policy="drop_oldest")
    assert dropping.put(numbers(spark, 2), 1) and dropping.pending() == [1]
    assert buffer.DurableBuffer(spark, f"{tmp_path}/a", max_age_s=-60).pending() == []
    with pytest.raises(ValueError):
        buffer.DurableBuffer(spark, f"{tmp_path}/a", policy="other")


def test_stream_through_buffer(spark, tmp_path):
    numbers(spark, 1, 2, 3).write.parquet(f"{tmp_path}/in")
    b = buffer.DurableBuffer(spark, f"{tmp_path}/buffer")
    stream = spark.readStream.schema("n long").parquet(f"{tmp_path}/in")
    query = b.fill(stream, f"{tmp_path}/checkpoint", {"availableNow": True})
    query.awaitTermination()
    got = []
    b.forward(lambda df: got.extend(r.n for r in df.collect()))
    assert sorted(got) == [1, 2, 3]
    metrics = buffer.progress_metrics(spark, query.recentProgress).collect()
    rows = [m for m in metrics if m.name == "stream.numInputRows"]
    assert sum(m.double_value for m in rows) == 3 and rows[0].metric_type == 2 and rows[0].time_unix_nano > 10**18
    assert buffer.progress_metrics(spark, []).count() == 0


def test_topic(spark, tmp_path):
    topic = f"{tmp_path}/topic"
    buffer.publish(numbers(spark, *range(20)), topic)
    buffer.publish(numbers(spark, *range(20, 30)), topic)

    def received(name, **how):
        sink = buffer.subscribe(spark, topic, "n long", **how).writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/c-{name}")
        sink.trigger(availableNow=True).start().awaitTermination()
        return sorted(r.n for r in spark.read.schema("n long").parquet(f"{tmp_path}/{name}").collect())

    assert received("all") == received("all2") == list(range(30))
    parts = [received(f"m{i}", member=i, members=3) for i in range(3)]
    assert sorted(sum(parts, [])) == list(range(30)) and sum(map(bool, parts)) > 1
    with pytest.raises(ValueError):
        buffer.subscribe(spark, topic, "n long", member=2, members=2)


SCHEMA = T.StructType(
    [
        T.StructField("id", T.IntegerType()),
        T.StructField("time_unix_nano", T.LongType()),
        T.StructField("severity_text", T.StringType()),
        T.StructField("trace_id", T.BinaryType()),
        T.StructField("body", T.StructType([T.StructField("str", T.StringType()), T.StructField("int", T.LongType())])),
        T.StructField("counts", T.ArrayType(T.LongType())),
        T.StructField("absent", T.DoubleType()),
    ]
)


def ipc_table():
    return pa.table(
        {
            "severity_text": pa.array(["INFO", None, "WARN"]).dictionary_encode(),
            "id": pa.array([0, 1, 2], pa.uint16()),
            "time_unix_nano": pa.array([5, None, 7], pa.timestamp("ns")),
            "trace_id": pa.array([b"0123456789abcdef", None, b"fedcba9876543210"], pa.binary(16)),
            "body": pa.array([{"type": 1, "str": "x"}, None, {"type": 1, "str": None}], pa.struct([("type", pa.uint8()), ("str", pa.dictionary(pa.uint8(), pa.string()))])),
            "counts": pa.array([[1, 2], None, []], pa.list_(pa.uint64())),
            "beyond": pa.array([1, 2, 3]),
        }
    )


def test_arrow_ipc(spark, tmp_path):
    table = ipc_table()
    with pa.OSFile(f"{tmp_path}/a.arrows", "wb") as f, pa.ipc.new_stream(f, table.schema) as w:
        w.write_table(table.slice(0, 2))
        w.write_table(table.slice(2))
    with pa.OSFile(f"{tmp_path}/b.arrow", "wb") as f, pa.ipc.new_file(f, table.schema) as w:
        w.write_table(table)
    (tmp_path / "c.arrows").write_bytes(b"")
    rows = sorted(read_arrow_ipc(spark, str(tmp_path), SCHEMA).collect(), key=lambda r: r.id)
    assert [r.id for r in rows] == [0, 0, 1, 1, 2, 2] and rows[0] == rows[1] and rows[4] == rows[5]
    assert (rows[0].severity_text, rows[0].time_unix_nano, bytes(rows[0].trace_id), rows[0].body.str, rows[0].body.int, rows[0].counts) == ("INFO", 5, b"0123456789abcdef", "x", None, [1, 2])
    assert tuple(rows[2])[1:] == (None,) * 6
    assert rows[4].body.str is None and rows[4].counts == [] and rows[4].absent is None


def test_arrow_ipc_of_nothing():
    from pyspark.sql.pandas.types import to_arrow_schema

    assert list(batches_of(b"", to_arrow_schema(SCHEMA))) == []


def spans(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a b"), (1, 1, "assistant", None), (2, 0, "user", "")], "conv_id long, turn long, role string, text string")
    return turns_as_spans(turns)


def test_star_of_spans(spark, tmp_path):
    for part in ("p1", "p2"):
        sinks.write_star(spans(spark), str(tmp_path), part, "spans")
    read = lambda t: spark.read.parquet(f"{tmp_path}/{t}")
    assert {t: read(t).count() for t in ("spans", "spans_attrs", "spans_events", "spans_events_attrs", "spans_links", "spans_links_attrs")} == {"spans": 6, "spans_attrs": 12, "spans_events": 12, "spans_events_attrs": 24, "spans_links": 2, "spans_links_attrs": 2}
    assert not list(tmp_path.glob("_numbered*"))
    tables = {t: read(t) if t == "spans" else read(t).withColumnRenamed("parent_id", "id") for t in ("spans", "spans_attrs", "spans_events", "spans_events_attrs", "spans_links", "spans_links_attrs")}
    back = layout.from_tables(tables, "spans", ["_part_id", "id"]).where("_part_id = 'p1'").orderBy("trace_id", "span_id").collect()
    assert [(r.trace_id, r.span_id, [e.name for e in r.events], r.links and r.links[0].span_id) for r in back] == [(1, 0, ["start", "end"], None), (1, 1, ["start", "end"], 0), (2, 0, ["start", "end"], None)]
    assert back[0].events[1].attributes["size"].int == 3 and back[0].attributes["size"].int == 3


def test_ids_named_like_a_field(spark):
    with pytest.raises(QueryError):
        layout.to_tables(spans(spark), "spans", ["trace_id", "span_id"])


def test_wide_spans(spark):
    texts = F.create_map(F.lit("service.name"), V.wrap(V.literal("s", "string")), F.lit("n"), V.wrap(V.literal(1, "int")))
    link = F.struct(F.unhex(F.lit("AB")).alias("trace_id"), F.unhex(F.lit("01")).alias("span_id"), texts.alias("attributes"))
    df = spark.range(2).select(
        F.unhex(F.lit("0F")).alias("trace_id"), F.lit(None).cast("binary").alias("span_id"), F.lit("x").alias("name"), F.lit(2).alias("kind"),
        F.struct(F.lit(2).alias("code"), F.lit("bad").alias("message")).alias("status"), F.struct(texts.alias("attributes")).alias("resource"),
        F.when(F.col("id") == 0, F.array(link)).alias("links"),
    )
    a, b = sorted(layout.wide_spans(df).collect(), key=lambda r: -len(r["Links.TraceId"]))
    assert (a.TraceId, a.SpanId, a.ParentSpanId, a.SpanKind, a.StatusCode, a.StatusMessage, a.ServiceName, a.Duration, a.SpanAttributes) == ("0f", "", "", "Server", "Error", "bad", "s", None, {})
    assert a["Links.TraceId"] == ["ab"] and a["Links.Attributes"] == [{"service.name": "s", "n": "1"}] and b["Links.SpanId"] == []
    assert layout.wide_spans(df.limit(0)).count() == 0


def test_attribute_algebra_keeps_rows_without_attributes(spark):
    root = spark.createDataFrame([(1,), (2,), (None,)], "id long")
    attributes = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", None), (None, "a", 1)], "id long, key string, int long")
    tests = {"a": (F.col("key") == "a") & (F.col("int") == 1), "b": F.col("key") == "b"}
    ids = lambda how: sorted((r.id for r in layout.where_attributes(root, attributes, ["id"], tests, F.expr(how)).collect()), key=str)
    assert ids("a AND b") == [1] and ids("a AND NOT b") == [None] and ids("NOT a") == [2] and ids("a OR NOT a") == [1, 2, None]


def test_batches(spark):
    df = spark.createDataFrame([(i, 10 if i != 3 else 95, i // 2 if i else None) for i in range(8)], "i long, size long, request long")
    got = {r.i: r._batch for r in processors.batch_by_bytes(df, 30, ["i"], F.col("size")).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 4, 5: 4, 6: 4, 7: 5}
    assert processors.batch_by_bytes(df, 10**6, ["i"]).agg(F.max("_batch")).first()[0] == 0
    by_request = {(r.request, r._batch) for r in processors.batch_by_requests(df, 2, "request").collect()}
    assert len(by_request) == 5 and sorted(b for _, b in by_request) == [0, 0, 1, 1, 2]
    assert processors.batch_by_requests(df.limit(0), 2, "request").count() == 0
    with pytest.raises(QueryError):
        processors.batch_by_bytes(df, 0, ["i"])


def test_bytes_over_many_ranges(spark):
    """The running sum has no gap or overlap where one range ends and the next begins."""
    df = spark.range(0, 200_000, 1, 16).select(((F.col("id") * 7919) % 200_000).alias("i")).withColumn("size", F.col("i") % 13)
    got = processors._running(df, ["i"], F.col("size"), "before").collect()
    total = 0
    for r in sorted(got, key=lambda r: r.i):
        assert r.before == total
        total += r.size


def test_debug(spark):
    at = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(at + dt.timedelta(minutes=i), i) for i in range(70)] + [(None, 99)], "ts timestamp, i int")
    ids = lambda *how: sorted(r.i for r in processors.debug_sample(df, *how, "1 hour", "ts").collect())
    assert ids(2, 0) == [0, 1, 60, 61] and ids(1, 20) == [0, 20, 40, 60] and ids(0, 30) == [29, 59]
    empty = processors.debug_report({"logs": df.limit(0), "traces": spans(spark)}).collect()
    assert {(r.signal, r.records, r.attributes, r.events, r.links) for r in empty} == {("logs", 0, 0, 0, 0), ("traces", 3, 6, 6, 1)}
    with pytest.raises(QueryError):
        processors.debug_report({})


def test_messages_that_are_no_json(spark):
    df = spark.createDataFrame([(b"{oops",), (None,), (b'{"resourceLogs":[{"scopeLogs":[{"logRecords":[{"severityText":"x"}]}]}]}',)], "value binary")
    assert [r.severity_text for r in message_logs(df).collect()] == ["x"]
