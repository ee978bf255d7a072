"""Sinks: the star as Parquet, wide tables, routed streams and keyed message rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.layout import to_tables, wide_strings


def write_star(df: DataFrame, path: str, part_id: str, name: str = "logs", target_rows: int = 1_000_000) -> None:
    """A signal's tables under ``path``, partitioned by _part_id: its rows, their attributes, and for
    spans and metrics the events, links and data points with theirs. Ids are unique within a part
    and tie the tables together.

    The numbered rows are written once, under a hidden folder that goes at the end, and all tables
    are read from there: numbering them anew for each table could give a row another id."""
    spark = df.sparkSession
    staged = f"{path}/_numbered_{name}_{part_id}"
    keyed = df.withColumn("id", F.monotonically_increasing_id()).withColumn("_part_id", F.lit(part_id))
    keyed.write.mode("overwrite").parquet(staged)
    keyed = spark.read.schema(keyed.schema).parquet(staged)
    for table, frame in to_tables(keyed, name, ["_part_id", "id"]).items():
        if table != name:
            frame = frame.withColumnRenamed("id", "parent_id")
        frame.write.mode("append").partitionBy("_part_id").option("maxRecordsPerFile", target_rows).parquet(f"{path}/{table}")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def write_wide(df: DataFrame, path: str, target_rows: int = 1_000_000) -> None:
    wide_strings(df).write.mode("append").option("maxRecordsPerFile", target_rows).parquet(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_noop(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def keyed_messages(df: DataFrame, topic: str | None = None, topic_attribute: str | None = None, key_columns: list[str] | None = None) -> DataFrame:
    """Rows as a message sink takes them: topic (an attribute's value or the given one), key (a
    hash of the key columns, so equal keys share a partition) and the record as JSON."""
    names = df.columns
    chosen = F.lit(topic).cast("string")
    if topic_attribute is not None:
        chosen = F.coalesce(F.try_element_at(F.col("attributes"), F.lit(topic_attribute))["str"], chosen)
    key = F.sha2(F.to_json(F.struct(*key_columns)).cast("binary"), 256) if key_columns else F.lit(None).cast("string")
    return df.select(chosen.alias("topic"), key.alias("key"), F.to_json(F.struct(*names)).alias("value"))


def fan_out(df: DataFrame, sinks: list[Callable[[DataFrame], None]], fallback: Callable[[DataFrame], None] | None = None, require_all: bool = True) -> list[Exception | None]:
    """The frame to every sink in turn. A sink that fails is followed by the fallback; without
    one, its error is raised at the end if all must succeed, or if none did."""
    df.persist()  # computed once for all sinks; on disk where it doesn't fit
    try:
        errors: list[Exception | None] = []
        for sink in sinks:
            try:
                sink(df)
                errors.append(None)
            except Exception as e:  # a sink's failure must not keep the others from their copy
                errors.append(e)
        failed = [e for e in errors if e is not None]
        if failed and fallback is not None:
            fallback(df)
        elif failed and (require_all or len(failed) == len(sinks)):
            raise failed[0]
        return errors
    finally:
        df.unpersist()


def with_retries(sink: Callable[[DataFrame], None], attempts: int = 3, wait_s: float = 0.1, growth: float = 2.0, most_s: float = 30.0) -> Callable[[DataFrame], None]:
    """A sink that is tried again with growing waits; the last error is raised."""
    import time

    def run(df: DataFrame) -> None:
        wait = wait_s
        for attempt in range(attempts):
            try:
                return sink(df)
            except Exception:
                if attempt == attempts - 1:
                    raise
                time.sleep(min(wait, most_s))
                wait *= growth

    return run
