"""Ranges and scopes: containment, innermost scope, merging, quiet gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def in_any_range(points: DataFrame, ranges: DataFrame, key: list[str], point: str, start: str, end: str) -> DataFrame:
    """``points`` with local: whether some range of the same key holds the point, both ends included.

    Overlapping ranges are merged first, so that per key at most one range can hold a point; the candidate is the last one
    that starts at or before it, found by one ordered pass over points and ranges together.
    """
    merged = merge_ranges(ranges, key, start, end)
    rows = points.select(F.struct("*").alias("_row"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col(point).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(merged.schema[end].dataType).alias("_end"))
    marks = merged.select(F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col(start).alias("_at"), F.lit(0).alias("_kind"), F.col(end).alias("_end"))
    w = Window.partitionBy(*[f"_k{i}" for i in range(len(key))]).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(marks).withColumn("_open", F.last("_end", ignorenulls=True).over(w))
    return both.where("_kind = 1").select("_row.*", F.coalesce(F.col("_at") <= F.col("_open"), F.lit(False)).alias("local"))


def innermost_scope(points: DataFrame, scopes: DataFrame, key: list[str], point: str, start: str, end: str, depth: str, scope_id: str) -> DataFrame:
    """``points`` with scope: the deepest scope of the same key that holds the point, null if none or if two are equally deep."""
    own = points.withColumn("_n", F.monotonically_increasing_id())
    p, s = own.alias("p"), scopes.alias("s")
    hit = p.join(s, [F.col(f"p.{k}") == F.col(f"s.{k}") for k in key] + [F.col(f"p.{point}").between(F.col(f"s.{start}"), F.col(f"s.{end}"))], "left")
    w = Window.partitionBy("p._n").orderBy(F.col(f"s.{depth}").desc_nulls_last())
    ranked = hit.select("p.*", F.col(f"s.{scope_id}").alias("scope"), F.rank().over(w).alias("_rank"))
    top = ranked.where("_rank = 1").withColumn("_ties", F.count(F.lit(1)).over(Window.partitionBy("_n")))
    return top.dropDuplicates(["_n"]).withColumn("scope", F.when(F.col("_ties") == 1, F.col("scope"))).drop("_n", "_rank", "_ties")


def merge_ranges(ranges: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """(key, start, end) of the fewest ranges that cover the same points; ranges that overlap or touch become one."""
    w = Window.partitionBy(*key).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.select(*key, start, end).withColumn("_new", F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0))
    islands = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def quiet_gaps(events: DataFrame, key: list[str], ts: str, gap: str) -> DataFrame:
    """(key, first_ts, last_ts, n): bursts of events; a burst ends when no event follows within ``gap``."""
    windowed = events.groupBy(*key, F.session_window(ts, gap).alias("_w"))
    return windowed.agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n")).drop("_w")
