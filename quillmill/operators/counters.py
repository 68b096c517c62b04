"""Counters and histograms as a monitoring system reads them: increases that survive resets, and quantiles interpolated from
cumulative buckets.

A series is cut into slots of time. Samples are ordered within a slot of a series only, so a busy series spans many
tasks; what a slot takes over from the one before it is that one's last value, found among one row for each slot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _grown(now: Column, before: Column) -> Column:
    """From one sample to the next; a lower value is a counter that began anew at 0."""
    return F.when(before.isNull(), F.lit(0)).when(now >= before, now - before).otherwise(now)


def increases(samples: DataFrame, series: list[str], seconds: int, at: str = "ts", value: str = "value", tie: str = "id") -> DataFrame:
    """samples (series..., ts, value, id) -> series..., slot_start, n, increase, rate: what the counter grew by from the last
    sample before the slot to the slot's last one. The first sample of a series adds nothing; null values are no samples."""
    kept = samples.where(F.col(value).isNotNull()).withColumn("_slot", F.floor(F.unix_seconds(at) / seconds))
    inside = Window.partitionBy(*series, "_slot").orderBy(at, tie)
    steps = kept.withColumn("_step", F.when(F.lag(value).over(inside).isNotNull(), _grown(F.col(value), F.lag(value).over(inside))))
    ends = lambda f, name: f(value, F.struct(at, tie)).alias(name)
    slots = steps.groupBy(*series, "_slot").agg(F.count("*").alias("n"), F.coalesce(F.sum("_step"), F.lit(0)).alias("_inner"), ends(F.min_by, "_first"), ends(F.max_by, "_last"))
    along = Window.partitionBy(*series).orderBy("_slot")
    grown = F.col("_inner") + _grown(F.col("_first"), F.lag("_last").over(along))
    found = slots.withColumn("increase", grown.cast("double"))
    return found.select(*series, F.timestamp_seconds(F.col("_slot") * seconds).alias("slot_start"), "n", "increase", (F.col("increase") / seconds).alias("rate"))


def buckets(values: DataFrame, by: list[str], bounds: list[float], value: str = "value") -> DataFrame:
    """by..., le_0, le_1, ..., total: how many values lie at or below each bound; null values are none."""
    return values.groupBy(*by).agg(*[F.count_if(F.col(value) <= b).alias(f"le_{k}") for k, b in enumerate(bounds)], F.count(value).alias("total"))


def quantile(q: float, bounds: list[float]) -> Column:
    """Of the columns that `buckets` gives: where the q-th value lies if a bucket's values are spread evenly between its
    bounds. The first bucket begins at 0 (or at its bound if that is not positive); beyond the last bound it is that bound; null
    without values."""
    rank = F.col("total") * q
    found = F.when(F.col("total") == 0, F.lit(None).cast("double"))
    for k, b in enumerate(bounds):
        below, low = (F.col(f"le_{k - 1}"), bounds[k - 1]) if k else (F.lit(0), min(0.0, b))
        share = F.try_divide(rank - below, F.col(f"le_{k}") - below)
        found = found.when(F.col(f"le_{k}") >= rank, F.lit(float(low)) + F.lit(float(b - low)) * F.coalesce(share, F.lit(1.0)))
    return found.otherwise(F.lit(float(bounds[-1])))
