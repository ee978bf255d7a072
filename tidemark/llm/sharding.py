"""Sharding by extendible hashing (operator 2), in DataFrame operations only.

A row's key is hashed to 60 bits. The directory starts with one bucket for all rows; a bucket
whose rows are larger than the byte limit is split on one more bit of the hash, every other
bucket stays as it is. A leaf is named by its prefix bits ("" for the root), and is one shard.

The directory is found from a histogram of bytes by hash cell, a table that is as long as the
number of shards times a constant: summed over each cell's prefixes it gives every bucket's size,
and a cell's shard is its shortest prefix that fits. Where single cells are still too large, only
their rows go on to a deeper histogram.

Defined results: texts of any length count with all their bytes; a null text has 0 bytes; a null key is hashed as the empty string. A row that
alone exceeds the limit gets a shard of its own, marked oversized. Rows whose keys are equal
can't be told apart by hash bits: their bucket is continued on overflow pages ("prefix.page"),
each within the limit. An empty table has no shards. Other input columns are ignored, so clashing
names do no harm.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Staging

HASH_BITS = 60
#: Cells of the first histogram by shard that the total would need; each further round adds bits.
CELLS_PER_SHARD_BITS = 5
ROUND_BITS = 8


def key_hash(key: Column) -> Column:
    """60 bits of the key's md5 as a long."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def _prefix(h: Column, depth: int) -> Column:
    return F.shiftright(h, HASH_BITS - depth)


def _bits(prefix: Column, depth: Column) -> Column:
    return F.when(depth == 0, F.lit("")).otherwise(F.lpad(F.bin(prefix), depth, "0"))


def _leaf_depths(cells: DataFrame, top: int, bottom: int, limit: int) -> DataFrame:
    """Of each cell (a prefix of ``bottom`` bits): depth, bytes and rows of its shortest prefix,
    of ``top`` bits at least, that is a leaf; depth is null where the cell itself is too large."""
    levels = cells.select("cell", "bytes", "rows", F.explode(F.sequence(F.lit(top), F.lit(bottom))).alias("depth"))
    levels = levels.withColumn("prefix", F.expr(f"shiftright(cell, {bottom} - depth)"))
    buckets = levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bucket_bytes"), F.sum("rows").alias("bucket_rows"))
    leaves = buckets.where((F.col("bucket_bytes") <= limit) | (F.col("bucket_rows") == 1))
    fits = levels.select("cell", "depth", "prefix").join(leaves, ["depth", "prefix"])
    best = fits.groupBy("cell").agg(F.min(F.struct("depth", "bucket_bytes", "bucket_rows")).alias("leaf"))
    return cells.select("cell").join(best, "cell", "left").select("cell", "leaf.depth", "leaf.bucket_bytes", "leaf.bucket_rows")


def _overflow_pages(rows: DataFrame, limit: int) -> DataFrame:
    """Pages for rows of equal hash. Running sums are taken within the rows that one task read,
    on top of the totals of the tasks before it, so no task sees all rows of a key."""
    weight = F.least(F.col("bytes"), F.lit(limit))
    rows = rows.withColumn("part", F.spark_partition_id()).withColumn("weight", weight)
    totals = rows.groupBy("h", "part").agg(F.sum("weight").alias("part_weight"), F.max("weight").alias("part_most"), F.sum("bytes").alias("part_bytes"), F.count("*").alias("part_rows"))
    by_key = Window.partitionBy("h")
    totals = totals.select(
        "h", "part",
        F.coalesce(F.sum("part_weight").over(by_key.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.max("part_most").over(by_key).alias("most"),
    )
    within = Window.partitionBy("h", "part").orderBy("bytes", "id").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("weight").over(within), F.lit(0))
    placed = rows.join(totals, ["h", "part"]).withColumn("start", start)
    # rows that start in one stretch of limit - most + 1 bytes stay within the limit together
    page = F.floor(F.col("start") / (F.lit(limit + 1) - F.col("most"))).cast("long")
    return placed.select("id", "bytes", F.concat(_bits(F.col("h"), F.lit(HASH_BITS)), F.lit("."), page.cast("string")).alias("shard"), F.lit(HASH_BITS).alias("depth"), (F.col("bytes") > limit).alias("oversized"))


def assign_shards(df: DataFrame, limit_bytes: int, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """The shard of every row: id_col, n_bytes (long), shard (string), depth (int, bits of the
    prefix), oversized (boolean: the row alone exceeds the limit); with ``row_col`` that column too."""
    spark = df.sparkSession
    staging = Staging(spark, "sharding")
    size = F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long")
    rows = staging.keep(df.select(F.struct(F.col(id_col).alias("own"), *([F.col(row_col).alias("row")] if row_col else [])).alias("id"), key_hash(F.col(id_col)).alias("h"), size.alias("bytes")), "rows")
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    top, bottom = 0, min(HASH_BITS, CELLS_PER_SHARD_BITS + max(0, math.ceil(math.log2(max(1.0, total / limit_bytes)))))
    done: list[DataFrame] = []
    while True:
        celled = rows.withColumn("cell", _prefix(F.col("h"), bottom))
        cells = celled.groupBy("cell").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows"))
        depths = staging.keep(_leaf_depths(cells, top, bottom, limit_bytes), "directory")
        fitting = celled.join(depths.where("depth is not null"), "cell")
        done.append(
            fitting.select(
                "id", "bytes",
                _bits(F.expr(f"shiftright(cell, {bottom} - depth)"), F.col("depth")).alias("shard"),
                F.col("depth").cast("int").alias("depth"),
                (F.col("bytes") > limit_bytes).alias("oversized"),
            )
        )
        too_large = depths.where("depth is null").select("cell")
        if too_large.isEmpty():
            break
        rows = staging.keep(celled.join(too_large, "cell", "left_semi").drop("cell"), "rows")
        if bottom == HASH_BITS:
            done.append(_overflow_pages(rows, limit_bytes))
            break
        top, bottom = bottom + 1, min(HASH_BITS, bottom + ROUND_BITS)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(F.col("id.own").alias(id_col), *([F.col("id.row").alias(row_col)] if row_col else []), F.col("bytes").alias("n_bytes"), "shard", "depth", "oversized")


def write_shards(df: DataFrame, path: str, limit_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write whole rows under ``path``/shard=…, one folder a shard; ids may repeat or be null."""
    staging = Staging(df.sparkSession, "write_shards")
    numbered = staging.keep(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
    placed = assign_shards(numbered, limit_bytes, id_col, text_col, "_row").select("_row", "shard")
    joined = numbered.join(placed, "_row").drop("_row")
    joined.repartition("shard").write.partitionBy("shard").parquet(path)
    staging.clear()


def sharding_sql(limit_bytes: int) -> str:
    """The same assignment in DuckDB SQL, for unique keys."""
    return f"""
    WITH h AS (
      SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
             ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, {HASH_BITS // 4}))::BIGINT AS h
      FROM documents),
    buckets AS (
      SELECT depth, h >> ({HASH_BITS} - depth) AS prefix, sum(n_bytes) AS b, count(*) AS n
      FROM h, range(0, {HASH_BITS + 1}) AS d(depth) GROUP BY 1, 2),
    leaf AS (
      SELECT h.h, min(depth) AS depth
      FROM h JOIN buckets ON buckets.prefix = (h.h >> ({HASH_BITS} - depth))
      WHERE b <= {limit_bytes} OR n = 1 GROUP BY 1)
    SELECT doc_id, n_bytes,
           CASE WHEN depth = 0 THEN '' ELSE lpad(bin(h.h >> ({HASH_BITS} - depth)), depth::INTEGER, '0') END AS shard,
           depth::INTEGER AS depth, n_bytes > {limit_bytes} AS oversized
    FROM h JOIN leaf USING (h)
    """
