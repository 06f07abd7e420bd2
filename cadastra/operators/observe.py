"""Observation of a listing snapshot: state merge, presence and price events, entities and their market periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadastra.functions import scalars as S
from cadastra.operators.entities import entity_id
from cadastra.operators.history import merged_intervals
from cadastra.session import written

STATE = ["id", "status", "first_seen_at", "last_seen_at", "missing_detected_at", "initial_price", "current_price", "content_hash", "photo_set_hash"]


def merge_state(state: DataFrame, rows: DataFrame) -> DataFrame:
    """The new state: rows win, but a known first_seen_at and initial_price stay; listings out of the snapshot stay as they were.

    rows: id, status (null: active), first_seen_at, last_seen_at, missing_detected_at, initial_price, price, content_hash,
    photo_set_hash. state: the STATE columns. One join on id.
    """
    new = rows.select(
        "id", F.coalesce(F.nullif("status", F.lit("")), F.lit("active")).alias("status"), "first_seen_at", "last_seen_at", "missing_detected_at",
        S.price(F.col("initial_price")).alias("initial_price"), S.price(F.col("price")).alias("current_price"), "content_hash", "photo_set_hash", F.lit(True).alias("seen"),
    )
    both = state.alias("o").join(new.alias("n"), "id", "full")
    kept = {"first_seen_at", "initial_price"}
    pick = lambda c: F.coalesce(f"o.{c}", f"n.{c}") if c in kept else F.when(F.col("n.seen"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return both.select("id", *(pick(c).alias(c) for c in STATE[1:]))


#: The fields of a listing that tell which home it is of, and how it was offered.
IDENTITY_SNAPSHOT = [
    "id", "url", "title", "status", "price", "initial_price", "price_drop_count", "rooms", "square_m2", "floor", "floor_total", "street", "house_num", "district", "complex_id",
    "complex_alias", "complex_name", "latitude", "longitude", "seller_type", "owner_name", "first_seen_at", "last_seen_at", "missing_detected_at", "reactivation_count", "photo_urls",
    "photo_count", "photo_set_hash", "baseline_eligible", "baseline_reject_reason",
]


def identity_snapshot(rows: DataFrame) -> DataFrame:
    """id and snapshot: its identity fields as one struct, null where rows have no such column."""
    return rows.select("id", F.struct(*(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in IDENTITY_SNAPSHOT)).alias("snapshot"))


def attach_new(members: DataFrame, rows: DataFrame) -> DataFrame:
    """members (listing, entity) with an entity of its own for each listing that has none."""
    new = rows.select(F.col("id").alias("listing")).distinct().join(members.select("listing"), "listing", "left_anti")
    return members.select("listing", "entity").unionByName(new.withColumn("entity", entity_id(F.col("listing"))))


def presence_events(state: DataFrame, rows: DataFrame, now: str) -> DataFrame:
    """id, event_type, status_after, observed_at, history_complete: bootstrap_state at first sight, else the changes of status."""
    old = state.select("id", F.col("status").alias("before"), F.lit(True).alias("known"))
    status = F.coalesce(F.nullif("status", F.lit("")), F.lit("active"))
    joined = rows.withColumn("status_after", status).join(old, "id", "left").filter(F.col("known").isNull() | ~F.col("before").eqNullSafe(F.col("status_after")))
    kind = F.when(F.col("known").isNull(), "bootstrap_state").when(F.col("status_after") == "active", "reactivated").otherwise("missing")
    at = (
        F.when(kind == "missing", S.first_filled(F.col("missing_detected_at"), F.col("last_seen_at"), F.lit(now)))
        .when(kind == "bootstrap_state", S.first_filled(F.col("first_seen_at"), F.col("last_seen_at"), F.lit(now)))
        .otherwise(S.first_filled(F.col("last_seen_at"), F.lit(now)))
    )
    return joined.select("id", kind.alias("event_type"), "status_after", at.alias("observed_at"), F.col("known").isNotNull().alias("history_complete"))


def price_events(state: DataFrame, rows: DataFrame, now: str) -> DataFrame:
    """id, observation_type, price, observed_at, history_complete: the initial and a differing current price at first sight, later every change."""
    old = state.select("id", S.price(F.col("current_price")).alias("before"), F.lit(True).alias("known"))
    both = rows.join(old, "id", "left").withColumns({"initial": S.price(F.col("initial_price")), "current": S.price(F.col("price"))})
    new, at = F.col("known").isNull(), S.first_filled(F.col("scraped_at"), F.col("last_seen_at"), F.lit(now))
    event = lambda when, kind, value, seen, complete: F.when(when & value.isNotNull(), F.struct(F.lit(kind).alias("observation_type"), value.alias("price"), seen.alias("observed_at"), F.lit(complete).alias("history_complete")))
    initial, current = F.col("initial"), F.col("current")
    found = F.array_compact(F.array(
        event(new, "bootstrap_initial", initial, S.first_filled(F.col("first_seen_at"), F.lit(now)), False),
        event(new & ~current.eqNullSafe(initial), "bootstrap_current", current, at, False),
        event(~new & ~current.eqNullSafe(F.col("before")), "observed_change", current, at, True),
    ))
    return both.select("id", F.explode(found).alias("e")).select("id", "e.*").distinct()


def market_intervals(members: DataFrame, state: DataFrame, local: DataFrame, source: DataFrame) -> DataFrame:
    """entity, start, end (null: open) of each listing's times on the market.

    local and source: listing, event_type, observed_at, event_id. Where any member of an entity has source events, the
    entity's local ones say nothing. A listing opens at first_seen_at, whatever its events' times; `missing` closes,
    `reactivated` opens what is closed; an active listing ends open, another one when it was last known.
    """
    kinds = F.when(F.col("event_type") == "missing_confirmed", "missing").otherwise(F.col("event_type"))
    events = lambda df: df.select("listing", kinds.alias("type"), S.when_at(F.col("observed_at")).alias("at"), F.col("observed_at").alias("order"), "event_id")
    has_source = members.join(source.select("listing").distinct(), "listing").select("entity").distinct()
    by_source = members.join(has_source, "entity", "left_semi").select("listing")
    used = events(source).unionByName(events(local).join(by_source, "listing", "left_anti")).filter(F.col("type").isin("missing", "reactivated") & F.col("at").isNotNull())
    states = state.select(F.col("id").alias("listing"), "status", *(S.when_at(S.first_filled(*map(F.col, c))).alias(n) for n, c in (("first", ["first_seen_at"]), ("last", ["last_seen_at"]), ("gone", ["missing_detected_at", "last_seen_at"]))))
    opened = states.filter("first is not null").select("listing", F.lit("reactivated").alias("type"), F.col("first").alias("at"), F.lit("").alias("order"), F.lit(None).cast("string").alias("event_id"), F.lit(0).alias("rank"))
    every = opened.unionByName(used.withColumns({"rank": F.lit(1), "event_id": F.col("event_id").cast("string")}))
    order = Window.partitionBy("listing").orderBy("rank", "order", "event_id")
    changes = every.withColumn("before", F.lag("type", 1, "missing").over(order)).filter("type <> before")
    spans = changes.withColumns({"next": F.lead("at").over(order), "last_one": F.lead("type").over(order).isNull()}).filter("type = 'reactivated'")
    ended = spans.filter("not last_one and next >= at").select("listing", F.col("at").alias("start"), F.col("next").alias("end"))
    open_ = states.join(spans.filter("last_one").select("listing", "at"), "listing", "left")
    active = open_.filter("status = 'active'").select("listing", F.coalesce("at", "last").alias("start"), F.lit(None).cast("timestamp").alias("end")).filter("start is not null")
    closed = open_.filter("status <> 'active' and gone >= at").select("listing", F.col("at").alias("start"), F.col("gone").alias("end"))
    return ended.unionByName(active).unionByName(closed).join(members, "listing").select("entity", "start", "end")


def recompute_entities(members: DataFrame, state: DataFrame, local: DataFrame, source: DataFrame, now: str, grace_hours: int = 24) -> DataFrame:
    """entity, lifecycle_status, first_seen_at, last_seen_at, relist_count, members, active."""
    of = members.join(state.select(F.col("id").alias("listing"), "status", "first_seen_at", "last_seen_at", "missing_detected_at"), "listing")
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    each = of.groupBy("entity").agg(
        F.count("*").alias("members"), F.count_if(F.col("status") == "active").alias("active"), F.min(text("first_seen_at")).alias("first_seen_at"), F.max(text("last_seen_at")).alias("last_seen_at"),
        F.max(S.when_at(S.first_filled(F.col("missing_detected_at"), F.col("last_seen_at")))).alias("gone"),
    )
    periods = merged_intervals(market_intervals(members, state, local, source).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")}), "entity").groupBy("entity").agg(F.count("*").alias("periods"))
    age = (F.unix_micros(S.when_at(F.lit(now))) - F.unix_micros("gone")) / 3.6e9
    status = F.when(F.col("active") > 0, "active").when(age < grace_hours, "uncertain").otherwise("off_market")
    return each.join(periods, "entity", "left").select(
        "entity", status.alias("lifecycle_status"), "first_seen_at", "last_seen_at", F.greatest(F.lit(0).cast("long"), F.coalesce("periods", F.lit(0).cast("long")) - 1).alias("relist_count"), "members", "active"
    )


def recompute_touched(before: DataFrame, members: DataFrame, state: DataFrame, local: DataFrame, source: DataFrame, touched: DataFrame, now: str, grace_hours: int = 24) -> DataFrame:
    """`recompute_entities` of the entities that touched listings (listing) belong to, in place of their rows in before.

    Equal to recomputing all: late events count, as a touched entity is computed from its whole history; an entity in its
    grace is computed again, since time alone may end it. Entities that have no member any more go.
    """
    due = members.join(touched.select("listing").distinct(), "listing").select("entity").unionByName(before.filter("lifecycle_status = 'uncertain'").select("entity")).distinct()
    own = written(members.join(due, "entity", "left_semi").select("listing", "entity"))
    of = lambda rows, key: rows.join(own.select(F.col("listing").alias(key)), key, "left_semi")
    again = recompute_entities(own, of(state, "id"), of(local, "listing"), of(source, "listing"), now, grace_hours)
    rest = before.join(due, "entity", "left_anti").join(members.select("entity").distinct(), "entity", "left_semi")
    return rest.select(*again.columns).unionByName(again)
