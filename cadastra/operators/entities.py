"""Entities: ids, alias redirects, details."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def entity_id(*listings) -> F.Column:
    """The same id for the same listings, however often it is computed."""
    return F.concat(F.lit("ent_"), F.sha2(F.concat_ws("|", *listings), 256))


def redirect_aliases(history: DataFrame, moved: DataFrame) -> DataFrame:
    """alias, outcome: child if all of an alias's former members (alias, listing) moved, split_ambiguous if some, else kept."""
    marked = history.distinct().join(moved.select("listing").distinct().withColumn("__moved", F.lit(True)), "listing", "left")
    each = marked.groupBy("alias").agg(F.count("*").alias("n"), F.count("__moved").alias("m"))
    return each.select("alias", F.when(F.col("m") == F.col("n"), "child").when(F.col("m") > 0, "split_ambiguous").otherwise("kept").alias("outcome"))


def detail(members: DataFrame, events: DataFrame) -> DataFrame:
    """entity, members (sorted), n_events, last_event: events (entity, at) are counted before they are joined."""
    lists = members.groupBy("entity").agg(F.array_sort(F.collect_list("listing")).alias("members"))
    counted = events.groupBy("entity").agg(F.count("*").alias("n_events"), F.max("at").alias("last_event"))
    return lists.join(counted, "entity", "left").withColumn("n_events", F.coalesce("n_events", F.lit(0).cast("long")))
