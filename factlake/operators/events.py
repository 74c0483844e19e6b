"""Operational events: reading, summaries by tool, rounded-rank percentiles, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def read_events(events: DataFrame, since=None, kinds: list[str] | None = None, tool: str | None = None, failures_only: bool = False, newest: int | None = None) -> DataFrame:
    """Events (ts, seq, kind, tool, status, duration_ms) that pass; the newest so many, if asked for."""
    out = events
    if since is not None:
        out = out.filter(F.col("ts") >= F.lit(since))
    if kinds:
        out = out.filter(F.col("kind").isin(*kinds))
    if tool:
        out = out.filter(F.col("tool") == tool)
    if failures_only:
        out = out.filter(F.col("status") == "error")
    return out.orderBy(F.desc("ts"), F.desc("seq")).limit(newest) if newest else out


def rank_of(p: float, n: Column) -> Column:
    """The rank of a percentile: half-up rounding of n * p, from 1 to n; no built-in percentile has this."""
    return F.greatest(F.lit(1), F.least(n, F.floor(n * F.lit(p) + 0.5)))


def summarize(events: DataFrame) -> DataFrame:
    """Per tool: calls, ok, failed, mean, p50, p95, max duration, last call and last failure, success rate.

    Percentiles rank each distinct duration by its running count, so equal durations are counted before the shuffle.
    """
    e = events.filter("tool is not null")
    by_value = e.filter("duration_ms is not null").groupBy("tool", "duration_ms").agg(F.count("*").alias("m"))
    upto = Window.partitionBy("tool").orderBy("duration_ms")
    ranked = by_value.withColumn("upto", F.sum("m").over(upto)).withColumn("n", F.sum("m").over(Window.partitionBy("tool")))
    at = lambda p: F.min(F.when(F.col("upto") >= rank_of(p, F.col("n")), F.col("duration_ms")))
    percentiles = ranked.groupBy("tool").agg(at(0.5).alias("median"), at(0.95).alias("p95"))
    failed = F.col("status") == "error"
    calls = e.groupBy("tool").agg(
        F.count("*").alias("calls"), F.sum(F.when(failed, 0).otherwise(1)).cast("long").alias("ok"), F.sum(F.when(failed, 1).otherwise(0)).cast("long").alias("failed"),
        F.avg("duration_ms").alias("mean"), F.max("duration_ms").alias("max"), F.max("ts").alias("last"), F.max(F.when(failed, F.col("ts"))).alias("last_failure"),
    )
    return calls.join(percentiles, "tool", "left").withColumn("success_rate", F.when(F.col("calls") > 0, F.col("ok") / F.col("calls")))


def metrics(events: DataFrame) -> DataFrame:
    """Per tool the counters that a registry holds: calls, failures, latency count, total and maximum."""
    return events.groupBy("tool").agg(
        F.count("*").alias("calls"), F.count_if(F.col("status") == "error").alias("failures"), F.count("duration_ms").alias("latency_count"),
        F.sum("duration_ms").alias("latency_total"), F.max("duration_ms").alias("latency_max"),
    )
