"""Streams run to the end of their input give what the batch forms give."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import processors
from tidemark.sources.readers import events_as_logs, generate_logs
from tidemark.streaming import ops

EVENTS = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture
def stream(spark, tmp_path):
    """The events as a file stream of two files."""
    path = str(tmp_path / "in")
    events = spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    for low in (0, 500):
        events.where((F.col("event_id") >= low) & (F.col("event_id") < low + 500)).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(df, tmp_path, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return df.sparkSession.table(name)


def test_transform(stream, tmp_path):
    got = drained(ops.transform_stream(stream, "source | where event_type == 'error' | project event_id"), tmp_path, "errors")
    want = stream.sparkSession.read.parquet(EVENTS).where("event_type = 'error'").count()
    assert got.count() == want


def test_routes(spark, stream, tmp_path):
    seen = {"alerts": 0, "default": 0}

    def count(port):
        def sink(df):
            seen[port] += df.count()

        return sink

    query = ops.route_stream(events_as_logs(stream), 'logs | if (severity_text == "error") { route_to "alerts" }', {p: count(p) for p in seen}, str(tmp_path / "routes"), {"availableNow": True})
    query.awaitTermination(120)
    errors = spark.read.parquet(EVENTS).where("event_type = 'error'").count()
    assert seen == {"alerts": errors, "default": 1000 - errors}


def test_windowed_summary(stream, tmp_path):
    out = ops.windowed_summary(stream, "ts", "1 day", {"kind": F.col("event_type")}, {"n": F.count("*")}, "40 days")
    got = drained(out, tmp_path, "summary", "complete").collect()
    assert sum(r.n for r in got) == 1000 and len({r.summary_id for r in got}) == len(got)


def test_ratio(stream, tmp_path):
    got = drained(ops.sample_ratio_stream(stream, "event_type", 2, 5), tmp_path, "ratio").groupBy("event_type").count().collect()
    totals = {r.event_type: r["count"] for r in stream.sparkSession.read.parquet(EVENTS).groupBy("event_type").count().collect()}
    assert {r.event_type: r["count"] for r in got} == {k: n // 5 * 2 + min(n % 5, 2) for k, n in totals.items()}


def test_zip_keeps_a_few(spark, stream, tmp_path):
    got = drained(ops.sample_zip_stream(stream.select("event_type", "ts", "event_id"), "event_type", "ts", 2, 86_400, "1 day"), tmp_path, "zip")
    per_day = got.groupBy("event_type", F.floor(F.unix_timestamp("ts") / 86_400).alias("d")).count()
    assert 0 < got.count() and per_day.agg(F.max("count")).first()[0] <= 2


def test_reaggregate(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [("a", at + dt.timedelta(seconds=s), float(s)) for s in (1, 5, 61, 200)]
    df = spark.createDataFrame(rows, "s string, ts timestamp, v double")
    df.coalesce(1).write.parquet(str(tmp_path / "p"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "p"))
    got = drained(ops.reaggregate_stream(stream, [F.col("s")], "ts", "60 seconds", "0 seconds"), tmp_path, "latest")
    assert sorted(r.v for r in got.collect()) == [5.0, 61.0]  # the last period is still open


def test_reservoir_and_batches(spark):
    events = spark.read.parquet(EVENTS)
    kept = ops.reservoir(events, "ts", "7 days", ["event_type"], 3)
    assert kept.groupBy("window_start", "event_type").count().agg(F.max("count")).first()[0] == 3
    assert kept.select("window_start", "event_type", "total").distinct().agg(F.sum("total")).first()[0] == 1000
    sizes = [r["count"] for r in processors.batch_by_items(events, 300, ["event_id"]).groupBy("_batch").count().orderBy("_batch").collect()]
    assert sizes == [300, 300, 300, 100]


def test_generated_logs(spark):
    r = generate_logs(spark, 100).agg(F.min(F.length("body.str")), F.max(F.length("body.str")), F.count("*")).first()
    assert tuple(r) == (1024, 1024, 100)
