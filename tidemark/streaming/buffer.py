"""Durable buffers and topics: Parquet segments in a shared folder between a stream and its readers."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


class BufferFull(Exception):
    """The size cap is reached and the policy holds writers back; nothing was taken."""


class DurableBuffer:
    """Segments under ``path``, each a Parquet folder named by its number.

    ``put`` writes a segment under a hidden name and renames it, so a reader sees it whole or not at
    all; a number that was put before is not put again, so a micro-batch that is run twice lands
    once. ``forward`` hands pending segments to a sink in order and removes each that the sink took.
    Over ``size_cap`` bytes the policy decides: "backpressure" refuses the new segment, "drop_oldest"
    removes the oldest ones, but never the new one. Segments older than ``max_age_s`` are removed.
    """

    def __init__(self, spark: SparkSession, path: str, size_cap: int | None = None, policy: str = "backpressure", max_age_s: float | None = None):
        if policy not in ("backpressure", "drop_oldest"):
            raise ValueError(f"no such policy: {policy}")
        self.spark, self.path, self.size_cap, self.policy, self.max_age_s = spark, path.rstrip("/"), size_cap, policy, max_age_s
        self._make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self._make(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for folder in ("segments", "seen"):
            self.fs.mkdirs(self._at(folder))

    def _at(self, *parts: str):
        return self._make("/".join([self.path, *parts]))

    def _bytes(self, *parts: str) -> int:
        return self.fs.getContentSummary(self._at(*parts)).getLength()

    def _mark(self, name: str) -> None:
        if not self.fs.exists(self._at("seen", name)):
            self.fs.create(self._at("seen", name)).close()

    def _remove(self, segment: int) -> None:
        self._mark(f"{segment:012d}")  # before it goes: a writer that failed to mark it won't put it again
        self.fs.delete(self._at("segments", f"{segment:012d}"), True)

    def pending(self) -> list[int]:
        """Numbers of the segments that no sink has taken, oldest first."""
        self.expire()
        return sorted(int(s.getPath().getName()) for s in self.fs.listStatus(self._at("segments")))

    def expire(self) -> None:
        if self.max_age_s is not None:
            oldest = (time.time() - self.max_age_s) * 1000
            for s in self.fs.listStatus(self._at("segments")):
                if s.getModificationTime() < oldest:
                    self._remove(int(s.getPath().getName()))

    def put(self, df: DataFrame, segment: int) -> bool:
        """Whether the segment was written; False if its number was put before."""
        name = f"{segment:012d}"
        if self.fs.exists(self._at("seen", name)):
            return False
        if not self.fs.exists(self._at("segments", name)):  # else only the mark is missing
            df.write.mode("overwrite").parquet(f"{self.path}/_writing/{name}")
            if self.size_cap is not None:
                new = self._bytes("_writing", name)
                waiting = {s: self._bytes("segments", f"{s:012d}") for s in self.pending()}
                if sum(waiting.values()) + new > self.size_cap:
                    if self.policy == "backpressure":
                        self.fs.delete(self._at("_writing", name), True)
                        raise BufferFull(f"{self.path} holds {sum(waiting.values())} of {self.size_cap} bytes")
                    for s in sorted(waiting):
                        if sum(waiting.values()) + new <= self.size_cap:
                            break
                        self._remove(s)
                        del waiting[s]
            if not self.fs.rename(self._at("_writing", name), self._at("segments", name)):
                raise OSError(f"can't rename segment {name}")
        self._mark(name)
        return True

    def read(self, segment: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/segments/{segment:012d}")

    def forward(self, sink: Callable[[DataFrame], None]) -> int:
        """Pending segments to the sink, oldest first; how many it took. An error of the sink is
        raised and leaves its segment, and those behind it, pending."""
        taken = 0
        for segment in self.pending():
            sink(self.read(segment))
            self._remove(segment)
            taken += 1
        return taken

    def fill(self, stream: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        """A stream into the buffer, a segment a micro-batch. A full buffer fails the batch; the
        query, started again, takes it up where it stopped."""
        writer = stream.writeStream.foreachBatch(lambda df, epoch: self.put(df, epoch)).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()


def publish(df: DataFrame, path: str) -> None:
    """Records to a topic: a folder whose Parquet files each subscriber reads on its own."""
    df.write.mode("append").parquet(path)


def subscribe(spark: SparkSession, path: str, schema, member: int = 0, members: int = 1, by: list[Column] | None = None) -> DataFrame:
    """A topic as a stream. Alone (``members`` = 1) a subscriber gets every record; of several
    members that share a topic each record goes to one, by a hash of ``by`` or of the whole record."""
    if not 0 <= member < members:
        raise ValueError("a member's number is below the number of members")
    stream = spark.readStream.schema(schema).parquet(path)
    if members == 1:
        return stream
    key = F.xxhash64(*(by or stream.columns))
    return stream.where(F.pmod(key, F.lit(members)) == member)


# What is told of a micro-batch, with its unit; monotonic ones are sums.
_PROGRESS = (("numInputRows", "rows", True), ("inputRowsPerSecond", "rows/s", False), ("processedRowsPerSecond", "rows/s", False), ("batchDuration", "ms", False))


def progress_metrics(spark: SparkSession, progresses: list) -> DataFrame:
    """The engine's own telemetry: micro-batches of streaming queries (as in ``recentProgress``) as
    metrics of one point. Numbers that a batch lacks, or that are not finite, have no row."""
    rows = []
    for p in progresses:
        for name, unit, monotonic in _PROGRESS:
            value = p.get(name)
            if value is not None and abs(float(value)) < float("inf"):
                rows.append((f"stream.{name}", unit, 2 if monotonic else 1, monotonic, p["timestamp"], float(value), {"query.id": str(p["id"]), "query.name": p.get("name") or "", "batch": str(p["batchId"])}))
    out = spark.createDataFrame(rows, "name string, unit string, metric_type int, is_monotonic boolean, at string, double_value double, attributes map<string,string>")
    return out.withColumn("time_unix_nano", F.unix_micros(F.to_timestamp("at")) * 1000).drop("at")
