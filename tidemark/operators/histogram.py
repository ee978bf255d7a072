"""Exponential histograms of positive values: build by group, merge, quantiles.

At scale s a bucket i holds values in (2**(i / 2**s), 2**((i + 1) / 2**s)]. Groups are first
bucketed at a fine scale; the scale that a group needs to fit its number of buckets follows from
its smallest and largest index, since lowering the scale by one halves indexes. Counting buckets is
an aggregate that is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINE_SCALE = 20
MAX_BUCKETS = 160


def bucket_index(value: Column, scale: int) -> Column:
    """The index of a positive value; exact powers of two fall in the bucket below."""
    exact = F.floor(F.log2(value))
    power = F.pow(F.lit(2.0), exact) == value
    if scale <= 0:
        unit = 1 << -scale
        up = F.when(power, exact - 1).otherwise(exact)
        return F.floor(up / F.lit(unit)).cast("long")
    index = (F.ceil(F.log2(value) * F.lit(float(1 << scale))) - 1).cast("long")
    return F.when(power, (exact * F.lit(1 << scale) - 1).cast("long")).otherwise(index)


def build(df: DataFrame, by: list[str], value: str, max_buckets: int = MAX_BUCKETS) -> DataFrame:
    """One histogram per group: by, count, sum, min, max, zero_count, scale, buckets (array of
    index and n, sorted). Zeros are counted apart; null, negative and non-finite values are left
    out; a group of those alone has no row."""
    v = F.col(value).cast("double")
    ok = df.select(*by, v.alias("_v")).where(v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v < float("inf")))
    fine = ok.withColumn("_i", F.when(F.col("_v") > 0, bucket_index(F.col("_v"), FINE_SCALE)))
    counted = fine.groupBy(*by, "_i").agg(F.count("*").alias("_n"), F.sum("_v").alias("_s"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    return _closed(counted, by, F.lit(FINE_SCALE), max_buckets)


def merge(histograms: DataFrame, by: list[str], max_buckets: int = MAX_BUCKETS) -> DataFrame:
    """Histograms of the same group as one, at the lowest of their scales or lower."""
    lowest = histograms.groupBy(*by).agg(F.min("scale").alias("_to"), F.sum("count").alias("count"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum("zero_count").alias("zero_count"))
    named = lowest.select(*(F.col(b).alias(f"_{b}") for b in by), *(c for c in lowest.columns if c not in by))
    on = F.lit(True)
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"_{b}"))
    parts = histograms.select(*by, "scale", F.explode("buckets").alias("_b")).join(named.select(*(f"_{b}" for b in by), "_to"), on).drop(*(f"_{b}" for b in by))
    parts = parts.withColumn("_i", F.expr("shiftright(_b.index, cast(scale - _to as int))")).groupBy(*by, "_to", "_i").agg(F.sum("_b.n").alias("_n"))
    ranged = _rescaled(parts, by, F.col("_to"), max_buckets)
    return named.drop("_to").join(ranged, _same(by), "left").select(*(F.col(f"_{b}").alias(b) for b in by), "count", "sum", "min", "max", "zero_count", F.coalesce("scale", F.lit(FINE_SCALE)).alias("scale"), F.coalesce("buckets", _no_buckets()).alias("buckets"))


def _no_buckets() -> Column:
    return F.expr("cast(array() as array<struct<index:bigint,n:bigint>>)")


def _same(by: list[str]) -> Column:
    on = F.lit(True)
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"_{b}"))
    return on


def _rescaled(parts: DataFrame, by: list[str], scale: Column, max_buckets: int) -> DataFrame:
    """by, scale, buckets from (by, _i, _n) at a scale: halved until they fit."""
    ranges = parts.where("_i is not null").groupBy(*by).agg(F.min("_i").alias("_a"), F.max("_i").alias("_z"), F.first(scale).alias("_from"))
    # the first shift at which the range fits; 64 bits are gone after 63 halvings
    fits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda d: F.call_function("shiftright", F.col("_z"), d) - F.call_function("shiftright", F.col("_a"), d) < max_buckets)
    ranges = ranges.withColumn("_down", F.element_at(fits, 1))
    named = ranges.select(*(F.col(b).alias(f"_{b}") for b in by), "_down", "_from")
    joined = parts.where("_i is not null").join(named, _same(by)).drop(*(f"_{b}" for b in by))
    halved = joined.withColumn("_j", F.call_function("shiftright", F.col("_i"), F.col("_down")))
    summed = halved.groupBy(*by, "_from", "_down", "_j").agg(F.sum("_n").alias("n"))
    buckets = F.sort_array(F.collect_list(F.struct(F.col("_j").alias("index"), "n")))  # max_buckets at most
    return summed.groupBy(*by).agg(F.first(F.col("_from") - F.col("_down")).cast("int").alias("scale"), buckets.alias("buckets"))


def _closed(counted: DataFrame, by: list[str], scale: Column, max_buckets: int) -> DataFrame:
    totals = counted.groupBy(*by).agg(
        F.sum("_n").alias("count"), F.sum("_s").alias("sum"), F.min("_lo").alias("min"), F.max("_hi").alias("max"), F.sum(F.when(F.col("_i").isNull(), F.col("_n")).otherwise(0)).alias("zero_count")
    )
    named = totals.select(*(F.col(b).alias(f"_{b}") for b in by), "count", "sum", "min", "max", "zero_count")
    ranged = _rescaled(counted, by, scale, max_buckets)
    out = named.join(ranged, _same(by), "left")
    return out.select(*(F.col(f"_{b}").alias(b) for b in by), "count", "sum", "min", "max", "zero_count", F.coalesce("scale", F.lit(FINE_SCALE)).alias("scale"), F.coalesce("buckets", _no_buckets()).alias("buckets"))


def quantile(q: float, columns: str = "") -> Column:
    """A quantile of a histogram row: 0 and 1 are the minimum and maximum, an empty histogram's is
    NaN; else the bucket that holds the rank, interpolated along its logarithm and kept within the
    minimum and maximum."""
    c = lambda n: F.col(f"{columns}{n}")
    if q <= 0:
        return F.when(c("count") > 0, c("min")).otherwise(F.lit(float("nan")))
    if q >= 1:
        return F.when(c("count") > 0, c("max")).otherwise(F.lit(float("nan")))
    rank = F.lit(q) * c("count")
    # (seen so far, value once found)
    start = F.struct(c("zero_count").cast("double").alias("seen"), F.when(rank <= c("zero_count"), F.lit(0.0)).alias("value"))
    width = F.pow(F.lit(2.0), -c("scale").cast("double"))

    def step(a: Column, b: Column) -> Column:
        share = (rank - a["seen"]) / b["n"]
        inside = F.pow(F.lit(2.0), (b["index"] + share) * width)
        value = F.when(a["value"].isNotNull(), a["value"]).when(rank <= a["seen"] + b["n"], inside)
        return F.struct((a["seen"] + b["n"]).alias("seen"), value.alias("value"))

    found = F.aggregate(c("buckets"), start, step)["value"]
    return F.when(c("count") > 0, F.greatest(c("min"), F.least(c("max"), F.coalesce(found, c("max"))))).otherwise(F.lit(float("nan")))


def relative_error(scale: Column) -> Column:
    """How far a quantile may be from the true value, relative to it."""
    base = F.pow(F.lit(2.0), F.pow(F.lit(2.0), -scale.cast("double")))
    return (base - 1) / (base + 1)
