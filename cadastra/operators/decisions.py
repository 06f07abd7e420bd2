"""Manual decisions judged, histories of canonical rows, details of entities. `merging` applies decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.operators.graph import resolved
from cadastra.operators.merging import operation_key


def manual(decisions: DataFrame, members: DataFrame, done: DataFrame) -> DataFrame:
    """decisions (a, b, decision, reason, actor, revision) with low, high, key, outcome and status.

    outcome: invalid (unknown decision, no reason or revision, one listing, unknown listings, or a merged pair said to
    differ), repeated (its key is used), else applied. status: that of the pair's candidate after an applied one.
    """
    a, b = F.col("a").cast("string"), F.col("b").cast("string")
    asked = decisions.withColumns({"low": F.least(a, b), "high": F.greatest(a, b)})
    key = operation_key("manual_override", F.col("low"), F.col("high"), F.col("decision"), F.col("revision"))
    of = lambda name: members.select(F.col("listing").cast("string").alias(name), F.col("entity").alias(f"{name}_entity"))
    known = asked.withColumn("key", key).join(of("low"), "low", "left").join(of("high"), "high", "left").join(done.select("key", F.lit(True).alias("used")), "key", "left")
    filled = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    right = F.col("decision").isin("same_entity", "different_entity") & filled("reason") & filled("revision") & (F.col("low") != F.col("high")) & F.col("low_entity").isNotNull() & F.col("high_entity").isNotNull()
    split_first = (F.col("decision") == "different_entity") & (F.col("low_entity") == F.col("high_entity"))
    outcome = F.when(~F.coalesce(right, F.lit(False)) | F.coalesce(split_first, F.lit(False)), "invalid").when(F.col("used"), "repeated").otherwise("applied")
    status = F.when(F.col("outcome") == "applied", F.when(F.col("decision") == "same_entity", "manual_linked").otherwise("manual_not_link"))
    return known.withColumn("outcome", outcome).withColumn("status", status).drop("used", "low_entity", "high_entity")


def canonical_history(history: DataFrame, chosen: DataFrame, now: str, version: str) -> DataFrame:
    """history (entity, listing, valid_from, valid_to, version) after chosen (entity, listing).

    A change closes the open row and opens one, unless the same switch was made in the same version before.
    """
    open_ = history.filter("valid_to is null").select("entity", F.col("listing").alias("before"))
    made = history.filter(F.col("version") == version).select("entity", "listing").distinct()
    switches = chosen.join(open_, "entity", "left").filter(~F.col("before").eqNullSafe(F.col("listing"))).join(made, ["entity", "listing"], "left_anti")
    closing = switches.select("entity", F.lit(True).alias("closing"))
    old = history.join(closing, "entity", "left").withColumn("valid_to", F.when(F.col("closing") & F.col("valid_to").isNull(), F.lit(now)).otherwise(F.col("valid_to"))).select(*history.columns)
    return old.unionByName(switches.select("entity", "listing", F.lit(now).alias("valid_from"), F.lit(None).cast("string").alias("valid_to"), F.lit(version).alias("version")))


def detail(requested: DataFrame, aliases: DataFrame, members: DataFrame, state: DataFrame, source: DataFrame, local: DataFrame, canonical: DataFrame) -> DataFrame:
    """requested, entity, members (structs with state and events), canonical_history, for each requested entity.

    source and local: listing, event_id, observed_at, event_type; a listing's own events are those of the source, if any.
    """
    asked = requested.join(resolved(aliases).select(F.col("old").alias("requested"), "survivor"), "requested", "left").select("requested", F.coalesce("survivor", "requested").alias("entity"))
    shape = ["listing", "observed_at", F.col("event_id").cast("string").alias("event_id"), "event_type"]
    used = source.select(*shape).unionByName(local.select(*shape).join(source.select("listing").distinct(), "listing", "left_anti"))
    events = used.groupBy("listing").agg(F.array_sort(F.collect_list(F.struct("observed_at", "event_id", "event_type"))).alias("events"))
    each = members.join(asked.select("entity").distinct(), "entity").join(state.withColumnRenamed("id", "listing"), "listing").join(events, "listing", "left")
    empty = F.array().cast("array<struct<observed_at:string,event_id:string,event_type:string>>")
    lists = each.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("first_seen_at", "listing", "status", F.coalesce("events", empty).alias("events")))).alias("members"))
    past = canonical.join(asked.select("entity").distinct(), "entity").groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("valid_from", "listing", "valid_to"))).alias("canonical_history"))
    return asked.join(lists, "entity").join(past, "entity", "left")
