"""Read-only reports and pages over verdicts, candidates, events, runs and labelled cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F

from cadastra.functions import scalars as S

PAGE, MOST = 200, 500


def page(rows: DataFrame, *order, limit: int = PAGE, offset: int = 0) -> DataFrame:
    if not 1 <= limit <= MOST or offset < 0:
        raise ValueError(f"a page has 1 to {MOST} rows")
    return rows.orderBy(*order).offset(offset).limit(limit)


def page_with_total(rows: DataFrame, *order, limit: int = PAGE, offset: int = 0) -> tuple[list[Row], int]:
    """A page and the number of all rows, in one run over them: they are counted on their way into the page."""
    seen = Observation()
    found = page(rows.observe(seen, F.count(F.lit(1)).alias("total")), *order, limit=limit, offset=offset).collect()
    return found, seen.get["total"]


def run_summary(rows: DataFrame, **counts: Column) -> tuple[DataFrame, Observation]:
    """rows that count themselves while they are written: `observation.get` has the counts after the one run."""
    seen = Observation()
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.count_if(c).alias(name) for name, c in counts.items())), seen


def member_counts(entities: DataFrame, members: DataFrame) -> DataFrame:
    """entities with member_count, 0 for those that no listing is in."""
    counted = members.groupBy("entity").agg(F.count("listing").alias("member_count"))
    return entities.join(counted, "entity", "left").withColumn("member_count", F.coalesce("member_count", F.lit(0).cast("long")))


def life_cycles(entities: DataFrame) -> DataFrame:
    """lifecycle_status, entities, members: entities (lifecycle_status, member_count) by life cycle."""
    return entities.groupBy("lifecycle_status").agg(F.count("*").alias("entities"), F.sum("member_count").alias("members"))


def entity_stats(entities: DataFrame, members: DataFrame, state: DataFrame, local: DataFrame, source: DataFrame) -> DataFrame:
    """One row: entities, members, several_active, by_status (map), events and source_history."""
    active = members.join(state.filter("status = 'active'").select(F.col("id").alias("listing")), "listing").groupBy("entity").count()
    by_status = entities.groupBy("lifecycle_status").count()
    parts = [
        by_status.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("entities"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("lifecycle_status", "count")))).alias("by_status")),
        members.agg(F.count("*").alias("members")),
        active.agg(F.count_if(F.col("count") > 1).alias("several_active")),
        event_counts(local, source),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(part)  # single rows
    return out


def verdict_page(verdicts: DataFrame, usable: int | None = None, reason_code: str | None = None, limit: int = PAGE, offset: int = 0) -> DataFrame:
    """Verdicts by processed_at and id, without the stored texts; filters only where they are given."""
    rows = verdicts if usable is None else verdicts.filter(F.col("usable") == usable)
    rows = rows if reason_code is None else rows.filter(F.col("reason_code") == reason_code)
    return page(rows.drop("title", "full_description"), "processed_at", "id", limit=limit, offset=offset)


def review_order(confidence: Column) -> Column:
    return F.when(confidence == "low", 0).when(confidence == "medium", 1).otherwise(2)


def text_snapshot(usable: Column, text: Column, most: int) -> Column:
    """Texts are kept for what is not usable only, cut to so many code points."""
    return F.when(~usable.eqNullSafe(F.lit(1)), F.substring(text, 1, most))


def event_counts(local: DataFrame, source: DataFrame) -> DataFrame:
    """events, source_history: those of the source if it has any, else the local ones."""
    n = source.agg(F.count("*").alias("s")).crossJoin(local.agg(F.count("*").alias("l")))  # two single rows
    return n.select(F.when(F.col("s") > 0, F.col("s")).otherwise(F.col("l")).alias("events"), (F.col("s") > 0).alias("source_history"))


def histogram(rows: DataFrame, value: str) -> DataFrame:
    """value, n; the items of an array count each."""
    items = F.explode(value) if rows.schema[value].dataType.typeName() == "array" else F.col(value)
    return rows.select(items.alias("value")).groupBy("value").agg(F.count("*").alias("n"))


#: The photo queues: fewest active sides, fewest reasons, whether both sides must be eligible, and whether just so many are active.
QUEUES = {
    "all_waiting": (0, 0, False, False),
    "both_active": (2, 0, False, True),
    "both_active_3plus_both_eligible": (2, 3, True, True),
    "both_active_2plus_both_eligible": (2, 2, True, True),
    "active_missing_3plus_both_eligible": (1, 3, True, True),
}


def queue_sizes(pairs: DataFrame, listings: DataFrame, average_bytes: int = 0, waiting: str = "awaiting_photo_analysis") -> DataFrame:
    """queue, pairs, listings, photos, first_five, gib, first_five_gib of the waiting pairs of each queue; a pair may be in several.

    pairs: low, high, status, reasons (array). listings: id, status, baseline_eligible, photo_count. Sizes are of
    different listings, by the average bytes of a photo; null if that is not known.
    """
    side = lambda name: listings.select(F.col("id").alias(name), (F.col("status") == "active").cast("int").alias(f"{name}_active"), F.coalesce(F.col("baseline_eligible").cast("string").isin("1", "true"), F.lit(False)).alias(f"{name}_eligible"))
    both = pairs.filter(F.col("status") == waiting).join(side("low"), "low").join(side("high"), "high")
    active, eligible = F.coalesce("low_active", F.lit(0)) + F.coalesce("high_active", F.lit(0)), F.col("low_eligible") & F.col("high_eligible")
    names = []
    for name, (sides, reasons, both_eligible, just) in QUEUES.items():
        fits = (active == sides if just else active >= sides) & (F.size("reasons") >= reasons)
        names.append(F.when(fits & eligible if both_eligible else fits, F.lit(name)))
    dealt = both.select("low", "high", F.explode(F.array_compact(F.array(*names))).alias("queue"))
    counted = dealt.groupBy("queue").agg(F.count("*").alias("pairs"))
    photos = F.coalesce(S.number(F.col("photo_count")), F.lit(0.0)).cast("long")
    ends = dealt.select("queue", F.explode(F.array("low", "high")).alias("id")).distinct().join(listings.select("id", photos.alias("photos")), "id")
    sized = ends.groupBy("queue").agg(F.count("*").alias("listings"), F.sum("photos").alias("photos"), F.sum(F.least("photos", F.lit(5))).alias("first_five"))
    gib = lambda c: (F.round(F.col(c) * average_bytes / 2**30, 2) if average_bytes else F.lit(None).cast("double"))
    every = pairs.sparkSession.createDataFrame([(q,) for q in QUEUES], "queue string")
    found = every.join(counted, "queue", "left").join(sized, "queue", "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("pairs", "listings", "photos", "first_five")}
    return found.withColumns(zero).withColumns({"gib": gib("photos"), "first_five_gib": gib("first_five")})


def candidate_counters(pairs: DataFrame) -> DataFrame:
    """counter (status or generator), value, n of current candidates (status, generator_version)."""
    each = F.explode(F.array(F.struct(F.lit("status").alias("counter"), F.col("status").alias("value")), F.struct(F.lit("generator").alias("counter"), F.col("generator_version").alias("value")))).alias("c")
    return pairs.select(each).groupBy("c.counter", "c.value").agg(F.count("*").alias("n"))


def profile_coverage(profiles: DataFrame, rows: DataFrame) -> DataFrame:
    """rows, tagged_rows, contradictory_finish, unknown_finish_with_photos of profiles (id, signals) and rows (id, photo_count)."""
    codes = F.transform("signals", lambda s: s["code"])
    has = lambda c: F.array_contains("codes", F.lit(c))
    known = profiles.select("id", codes.alias("codes")).join(rows.select("id", S.number(F.col("photo_count")).alias("photos")), "id")
    bad = (has("finish_rough") & has("finish_fresh")) | (has("finish_needs_repair") & has("finish_fresh"))
    blind = ~F.exists("codes", lambda c: c.startswith("finish_")) & (F.coalesce("photos", F.lit(0.0)) > 0)
    return known.agg(F.count("*").alias("rows"), F.count_if(F.size("codes") > 0).alias("tagged_rows"), F.count_if(bad).alias("contradictory_finish"), F.count_if(blind).alias("unknown_finish_with_photos"))


def status_mix(pairs: DataFrame, state: DataFrame) -> DataFrame:
    """mix, n of pairs (low, high) by both sides' status, in order of their names."""
    side = lambda name: state.select(F.col("id").alias(name), F.col("status").alias(f"{name}_status"))
    both = pairs.join(side("low"), "low").join(side("high"), "high")
    return both.groupBy(F.concat_ws("/", F.least("low_status", "high_status"), F.greatest("low_status", "high_status")).alias("mix")).agg(F.count("*").alias("n"))


def snapshot_counts(rows: DataFrame) -> DataFrame:
    """listings, active, missing, with_drops, with_reactivations."""
    status = F.coalesce(F.col("status"), F.lit("active"))
    more = lambda c: F.count_if(F.coalesce(S.number(F.col(c)), F.lit(0.0)) > 0)
    return rows.agg(F.count("*").alias("listings"), F.count_if(status == "active").alias("active"), F.count_if(status == "missing").alias("missing"), more("price_drop_count").alias("with_drops"), more("reactivation_count").alias("with_reactivations"))


def regression(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """cases, passed, hard, soft (and tokens, if answers have them) of labelled cases (id, expected: codes) against answers (id, reason_code, usable).

    hard: usable where no expected code is ok, or the reverse, or no answer; soft: another code of the same side, and any
    failure of a case that is marked soft. tokens: of all answers.
    """
    both = cases.join(answers, "id", "left")
    right = F.coalesce(F.array_contains("expected", F.col("reason_code")), F.lit(False))
    side = F.coalesce(F.col("usable") == F.array_contains("expected", F.lit("ok")), F.lit(False))
    if "soft" in cases.columns:
        side = side | F.coalesce("soft", F.lit(False))
    tokens = [F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")] if "tokens" in answers.columns else []
    return both.agg(F.count("*").alias("cases"), F.count_if(right).alias("passed"), F.count_if(~right & ~side).alias("hard"), F.count_if(~right & side).alias("soft"), *tokens)


def health(age_seconds: Column, has_success: Column, last_failed: Column, uptime_seconds: Column, stale_after: int) -> Column:
    """starting or broken before the first success, stale after too long, degraded if the last attempt failed, else ok."""
    never = F.when(uptime_seconds > stale_after, "broken").otherwise("starting")
    return F.when(~F.coalesce(has_success, F.lit(False)), never).when(age_seconds > stale_after, "stale").when(F.coalesce(last_failed, F.lit(False)), "degraded").otherwise("ok")


def last_runs(ledger: DataFrame) -> DataFrame:
    """service, last_success_at, last_attempt_at, last_attempt_failed of runs (service, kind, at, failed)."""
    full = ledger.filter("kind = 'full'")
    return full.groupBy("service").agg(F.max(F.when(~F.col("failed"), F.col("at"))).alias("last_success_at"), F.max("at").alias("last_attempt_at"), F.max_by("failed", "at").alias("last_attempt_failed"))


def timeline(events: DataFrame) -> DataFrame:
    """listing, timeline: a listing's events as one text in order of observed_at and event_id."""
    each = events.groupBy("listing").agg(F.array_sort(F.collect_list(F.struct("observed_at", "event_id", "event_type"))).alias("e"))
    return each.select("listing", F.array_join(F.transform("e", lambda x: x["event_type"]), ",").alias("timeline"))


def contradictions(profiles: DataFrame, pairs: list[list[str]]) -> DataFrame:
    """id of profiles whose codes hold all of one of the sets."""
    found = F.lit(False)
    for codes in pairs:
        both = F.lit(True)
        for c in codes:
            both = both & F.array_contains("codes", c)
        found = found | both
    return profiles.filter(found).select("id")
