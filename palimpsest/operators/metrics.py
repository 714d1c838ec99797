"""Hourly rollups of scrub events and the answers read from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid_events(events: DataFrame) -> DataFrame:
    """Events (hour or ts, count, by_type map) whose count is a number from 0 on and whose map is there."""
    return events.where("count is not null and count >= 0 and by_type is not null")


def by_hour(events: DataFrame, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """(hour, pii_type, count) with positive counts only, and (hour, runs)."""
    hour = F.date_trunc("hour", ts).alias("hour")
    kinds = events.select(hour, F.explode(F.map_filter("by_type", lambda k, v: v > 0)).alias("pii_type", "n"))
    return kinds.groupBy("hour", "pii_type").agg(F.sum("n").alias("count")), events.groupBy(hour).agg(F.count(F.lit(1)).alias("runs"))


def merge_counts(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The additive upsert: old and new rows summed by key."""
    return old.select(*keys, value).unionByName(new.select(*keys, value)).groupBy(*keys).agg(F.sum(value).alias(value))


def summary(hourly: DataFrame, runs: DataFrame) -> DataFrame:
    """Per type and (pii_type null) in all, with the total of runs on each row: one rollup."""
    totals = hourly.rollup("pii_type").agg(F.sum("count").alias("total"))
    return totals.join(runs.agg(F.coalesce(F.sum("runs"), F.lit(0)).cast("long").alias("total_runs")), how="cross")


def history(hourly: DataFrame, now, hours: int = 24) -> DataFrame:
    """Buckets from `hours` before the current hour on, that one included: up to hours + 1 of them."""
    if hours <= 0:
        raise ValueError("hours must be positive")
    since = F.date_trunc("hour", now) - F.expr(f"INTERVAL {int(hours)} HOURS")
    return hourly.where(F.col("hour") >= since)
