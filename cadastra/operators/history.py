"""Presence and price histories: transitions, market periods, intervals, validity, lifecycle, canonical rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def transitions(events: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """Rows at which a key's state differs from the row before; the first row of a key is one."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(*order))
    return events.withColumn("before", before).filter(~F.col(state).eqNullSafe(F.col("before")))


def merged_intervals(intervals: DataFrame, key: str, open_ends: bool = True) -> DataFrame:
    """key, period, start, end: touching or overlapping intervals (start, end) merged; a null end is open.

    Without `open_ends` a null end is unknown: it reaches no further than the others, and no date stands for open ones.
    Rows of unknown start come last. Both windows share one sort, so equal intervals have one order in both.
    """
    far = F.lit("9999-12-31").cast("timestamp_ntz")
    closed = intervals.withColumn("stop", F.coalesce(F.col("end"), far) if open_ends else F.col("end"))
    order = Window.partitionBy(key).orderBy(F.asc_nulls_last("start"), F.asc_nulls_last("stop"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    new = F.col("reach").isNull() | F.coalesce(F.col("start") > F.col("reach"), F.lit(False))
    opened = closed.withColumn("reach", F.max("stop").over(before)).withColumn("new", new.cast("int"))
    numbered = opened.withColumn("period", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max("stop")
    return numbered.groupBy(key, "period").agg(F.min("start").alias("start"), (F.nullif(last, far) if open_ends else last).alias("end"))


def market_intervals(events: DataFrame, key: str) -> DataFrame:
    """key, start, end of the times on the market: reactivated opens, missing closes (at, type)."""
    order = Window.partitionBy(key).orderBy("at", "event_id")
    changes = transitions(events.filter(F.col("type").isin("missing", "reactivated")), key, ["at", "event_id"], "type")
    return changes.withColumn("end", F.lead("at").over(order)).filter(F.col("type") == "reactivated").select(key, F.col("at").alias("start"), "end")


def validity(changes: DataFrame, key: str, at: str, order: list[str]) -> DataFrame:
    """Adds valid_to: the key's next change; null for the open row."""
    return changes.withColumn("valid_to", F.lead(at).over(Window.partitionBy(key).orderBy(*order)))


def lifecycle(any_active: Column, missing_at: Column, now: Column, grace_hours: int = 24) -> Column:
    """active, uncertain within the grace after the last disappearance, else off_market."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(missing_at.cast("timestamp"))) / 3.6e9
    return F.when(any_active, "active").when(age < grace_hours, "uncertain").otherwise("off_market")


def numbered(rows: DataFrame, key: str, order: str, ranges: int = 256) -> DataFrame:
    """rows with rn, their number (from 1) within their key by a whole-number order.

    A key is no one task's work: its rows are numbered within ranges of the order, and moved by what the key has before.
    """
    cuts = rows.select(F.expr(f"approx_percentile({order}, array({', '.join(str(i / ranges) for i in range(1, ranges))}))")).first()[0] or []
    edges = F.array(*(F.lit(c).cast("long") for c in sorted(set(cuts)))) if cuts else F.array().cast("array<long>")
    dealt = rows.withColumn("__range", F.size(F.filter(edges, lambda e: F.col(order) >= e)))
    before = Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    # at most `ranges` rows a key
    sizes = dealt.groupBy(key, "__range").agg(F.count("*").alias("__count")).withColumn("__before", F.coalesce(F.sum("__count").over(before), F.lit(0))).withColumnsRenamed({key: "__key", "__range": "__of"})
    inside = dealt.withColumn("__n", F.row_number().over(Window.partitionBy(key, "__range").orderBy(order)))
    joined = inside.join(sizes, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__range") == F.col("__of")))
    return joined.withColumn("rn", F.col("__n") + F.col("__before")).select(*rows.columns, "rn")


def canonical(rows: DataFrame, entity: str, active: Column, price: Column, current: Column, quality: list[Column]) -> DataFrame:
    """One row per entity: active before inactive; the cheapest valid price of active rows, the current one on ties; quality."""
    valid = F.when(active & (price > 0) & ~F.isnan(price), price)
    order = [F.desc(active.cast("int")), F.asc_nulls_last(valid), F.desc((active & current).cast("int")), *quality]
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(entity).orderBy(*order))).filter("rn = 1").drop("rn")
