"""Streaming forms: query languages, windowed summaries, reaggregation and sampling over streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

from tidemark.operators.processors import stream_id
from tidemark.plans.compile import run_kql, run_opl


def transform_stream(stream: DataFrame, query: str, language: str = "kql") -> DataFrame:
    """A query over a stream; stateless stages run in append mode."""
    return run_kql(query, stream) if language == "kql" else run_opl(query, stream)["default"]


def route_stream(stream: DataFrame, query: str, sinks: dict[str, Callable[[DataFrame], None]], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """An OPL pipeline by micro-batch, each port to its sink."""

    def each(batch: DataFrame, _: int) -> None:
        batch.persist()  # read once for all ports; on disk where it doesn't fit
        try:
            for port, df in run_opl(query, batch).items():
                if port in sinks:
                    sinks[port](df)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def windowed_summary(stream: DataFrame, time_col: str, window: str, keys: dict[str, Column], aggregates: dict[str, Column], lateness: str) -> DataFrame:
    """Aggregates by event-time window and keys; summary_id names a window's group for good, so
    late updates replace earlier ones."""
    marked = stream.withWatermark(time_col, lateness)
    by = [c.alias(n) for n, c in keys.items()]
    grouped = marked.groupBy(F.window(time_col, window).alias("window"), *by).agg(*(c.alias(n) for n, c in aggregates.items()))
    return grouped.withColumn("summary_id", stream_id([F.col("window.start"), *map(F.col, keys)]))


def reservoir(df: DataFrame, time_col: str, window: str, keys: list[str], samples: int) -> DataFrame:
    """A summary's records: at most ``samples`` of each window and group, chosen by a hash that
    doesn't depend on arrival, with the group's total."""
    marked = df.withColumn("_window", F.window(time_col, window)["start"])
    group = Window.partitionBy("_window", *keys)
    totals = marked.groupBy("_window", *keys).agg(F.count("*").alias("total"))
    chosen = marked.withColumn("_at", F.row_number().over(group.orderBy(F.xxhash64(*df.columns), time_col))).where(F.col("_at") <= samples).drop("_at")
    return chosen.join(totals, ["_window", *keys]).withColumnRenamed("_window", "window_start")


def reaggregate_stream(stream: DataFrame, identity: list[Column], time_col: str, period: str, lateness: str) -> DataFrame:
    """The latest point of each stream and period, once the period's watermark has passed."""
    names = stream.columns
    keyed = stream.withColumn("_stream", stream_id(identity)).withColumn("_row", F.struct(*names))
    latest = keyed.withWatermark(time_col, lateness).groupBy("_stream", F.window(time_col, period).alias("_period")).agg(F.max_by("_row", time_col).alias("_row"))
    return latest.select("_row.*")


def sample_ratio_stream(stream: DataFrame, key: str, emit: int, out_of: int) -> DataFrame:
    """``emit`` of each ``out_of`` records of a key; the position in the cycle is kept as state."""
    schema = stream.schema

    def step(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at = state.get[0] if state.exists else 0
        for frame in frames:
            place = (pd.RangeIndex(at, at + len(frame)) % out_of) < emit
            at += len(frame)
            yield frame[place]
        state.update((at % out_of,))

    return stream.groupBy(key).applyInPandasWithState(step, schema, "at long", "append", GroupStateTimeout.NoTimeout)


def sample_zip_stream(stream: DataFrame, key: str, time_col: str, max_items: int, interval_s: int, lateness: str) -> DataFrame:
    """At most ``max_items`` records of a key and interval of event time, first come first kept. A
    key's state goes once the watermark has passed its interval."""
    schema = stream.schema

    def step(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, n = state.get if state.exists else (-1, 0)
        for frame in frames:
            keep = []
            for t in frame[time_col]:
                window = int(t.timestamp()) // interval_s
                if window > start:
                    start, n = window, 0
                keep.append(window == start and n < max_items)
                n += keep[-1]
            yield frame[keep]
        state.update((start, n))
        state.setTimeoutTimestamp(max((start + 1) * interval_s * 1000, state.getCurrentWatermarkMs() + 1))

    return stream.withWatermark(time_col, lateness).groupBy(key).applyInPandasWithState(step, schema, "start long, n long", "append", GroupStateTimeout.EventTimeTimeout)
