"""Refresh of candidate pairs over revisions, and the review queue over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.functions import scalars as S
from cadastra.functions.text import normalised
from cadastra.operators import candidates as C

GENERATOR = "cadastra-candidates-1"
#: The fields of a listing's identity.
IDENTITY = ["rooms", "square_m2", "floor", "floor_total", "street", "house_num", "complex_id", "complex_alias", "complex_name", "latitude", "longitude", "owner_name", "photo_set_hash"]


def identity_hash(columns: list[str]) -> Column:
    """Hash of a listing's identity fields; a field that the rows lack counts as null."""
    return S.typed_hash(*(F.col(c) if c in columns else F.lit(None).cast("string") for c in IDENTITY))


def block_keys(columns: list[str]) -> dict[str, Column]:
    """Keys of the four kinds of blocks; all but equal photos need rooms and area, complexes and coordinates a floor."""
    has = lambda c: F.col(c) if c in columns else F.lit(None).cast("string")
    rooms, floor, area = S.whole_text(has("rooms")), S.whole_text(has("floor")), S.number(has("square_m2"))
    built = (rooms != "") & area.isNotNull()
    place = F.concat_ws("|", rooms, F.bround(area, 0).cast("long").cast("string"), floor)
    street, house = normalised(has("street")), normalised(has("house_num"))
    complex_ = normalised(S.first_filled(has("complex_id"), has("complex_alias"), has("complex_name")))
    lat, lon = S.number(has("latitude")), S.number(has("longitude"))
    cell = F.concat_ws("|", F.bround(lat, 3).cast("string"), F.bround(lon, 3).cast("string"))
    photos = F.nullif(has("photo_set_hash"), F.lit(""))
    return {
        "exact_photo_set": F.when(F.size(has("photo_urls")) > 0, photos) if "photo_urls" in columns else photos,
        "address": F.when(built & (street != "") & (house != ""), F.concat_ws("|", street, house, place)),
        "complex": F.when(built & (complex_ != "") & (floor != ""), F.concat_ws("|", complex_, place)),
        "coordinates": F.when(built & lat.isNotNull() & lon.isNotNull() & (floor != ""), F.concat_ws("|", cell, place)),
    }


def hard_conflicts(columns: list[str]) -> Column:
    """Sorted contradictions of sides a and b: rooms, floor, area by over a tenth, complete addresses."""
    side = lambda s, c: F.col(f"{s}.{c}") if c in columns else F.lit(None).cast("string")
    differ = lambda c: S.number(side("a", c)) != S.number(side("b", c))
    x, y = S.number(side("a", "square_m2")), S.number(side("b", "square_m2"))
    apart = (x != 0) & (y != 0) & (F.abs(x - y) / F.greatest(x, y) > 0.10)
    street, house = ([normalised(side(s, c)) for s in "ab"] for c in ("street", "house_num"))
    complete = (street[0] != "") & (street[1] != "") & (house[0] != "") & (house[1] != "")
    moved = complete & ((street[0] != street[1]) | (house[0] != house[1]))
    found = {"address": moved, "area": apart, "floor": differ("floor"), "rooms": differ("rooms")}
    return F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in found.items())))


def positive_signals(columns: list[str], near_m: float = 500) -> Column:
    """Structs signal, distance_m of what sides a and b have in common."""
    side = lambda s, c: F.col(f"{s}.{c}") if c in columns else F.lit(None).cast("string")
    photo = F.nullif(side("a", "photo_set_hash"), F.lit(""))
    far = C.distance_m(*(S.number(side(s, c)) for s in "ab" for c in ("latitude", "longitude")))
    complexes = [normalised(S.first_filled(*(side(s, c) for c in ("complex_id", "complex_alias", "complex_name")))) for s in "ab"]
    street, house = ([normalised(side(s, c)) for s in "ab"] for c in ("street", "house_num"))
    at = (street[0] != "") & (house[0] != "") & (street[0] == street[1]) & (house[0] == house[1])
    signal = lambda good, name, m=None: F.when(good, F.struct(F.lit(name).alias("signal"), (m if m is not None else F.lit(None)).cast("double").alias("distance_m")))
    return F.array_compact(F.array(
        signal(photo == side("b", "photo_set_hash"), "exact_photo_set"), signal(far <= near_m, "near_coordinates", F.bround(far, 1)),
        signal((complexes[0] != "") & (complexes[0] == complexes[1]), "same_complex"), signal(at, "same_address"),
    ))


def judge(rows: DataFrame, max_block: int = C.MAX_BLOCK) -> DataFrame:
    """All pairs that share a block, by what the listings themselves say: low, high, both identity hashes, reasons, conflicts, signals, revision, priority."""
    fields = rows.columns
    listed = rows.withColumn("identity_hash", identity_hash(fields))
    pairs = C.with_sides(C.candidate_pairs(rows, block_keys(fields), max_block), listed)
    both = F.coalesce((F.col("a.status") == "active") & (F.col("b.status") == "active"), F.lit(False))
    judged = pairs.withColumns({"hard_conflicts": hard_conflicts(fields), "positive_signals": positive_signals(fields), "low_hash": F.col("a.identity_hash"), "high_hash": F.col("b.identity_hash"), "both_active": both}).drop("a", "b")
    near = F.exists("positive_signals", lambda s: s["signal"] == "near_coordinates")
    judged = judged.withColumn("priority", C.priority(F.col("reasons"), F.col("both_active"), near)).drop("both_active")
    parts = ["low", "high", "low_hash", "high_hash", "reasons", "hard_conflicts", "positive_signals"]
    return judged.withColumn("revision", S.typed_hash(*map(F.col, parts), F.lit(GENERATOR)))


def decide(judged: DataFrame, overrides: DataFrame, evidence: DataFrame) -> DataFrame:
    """Judged pairs with match_revision and status: by override, evidence on exactly this state, conflicts.

    overrides: low, high, decision. evidence: low, high, low_hash, high_hash, revision, match_revision.
    """
    key = ["low", "high", "low_hash", "high_hash", "revision"]
    fits = evidence.groupBy(*key).agg(F.min("match_revision").alias("match_revision"))
    known = judged.join(overrides.select("low", "high", "decision"), ["low", "high"], "left").join(fits, key, "left")
    return known.withColumn("status", C.status(F.col("decision"), F.col("match_revision").isNotNull(), F.col("hard_conflicts"))).drop("decision")


def refresh(rows: DataFrame, overrides: DataFrame, evidence: DataFrame, max_block: int = C.MAX_BLOCK) -> DataFrame:
    """All current candidates with their status; what is not returned is current no more."""
    return decide(judge(rows, max_block), overrides, evidence)


def renewed(history: DataFrame, current: DataFrame) -> DataFrame:
    """The stored revisions (low, high, revision, ...) with the current ones in place of themselves and is_current anew."""
    old = history.drop("is_current").join(current.select("low", "high", "revision"), ["low", "high", "revision"], "left_anti").withColumn("is_current", F.lit(False))
    return old.unionByName(current.withColumn("is_current", F.lit(True)), allowMissingColumns=True)


def summary(candidates: DataFrame) -> DataFrame:
    names = ["metadata_conflict", "awaiting_photo_analysis", "photo_evidence_ready", "manual_linked", "manual_not_link"]
    return candidates.agg(F.count("*").alias("current_candidates"), *(F.count_if(F.col("status") == n).alias(n) for n in names))


ACTIVITY = ("both_active", "active_missing", "both_missing")
ELIGIBILITY = ("both", "at_least_one", "neither")


def review(candidates: DataFrame, snapshots: DataFrame, edges: DataFrame, *, status=None, min_priority=None, min_reason_count=None, reason_count=None, activity=None, eligibility=None, photo_decision=None, min_score=None, max_score=None) -> DataFrame:
    """Current candidates with both listings, queue facts and evidence (null without), as far as all filters fit.

    snapshots: id, status, baseline_eligible; edges: low, high, match_revision, score, decision, is_current.
    """
    if min_score is not None and max_score is not None and min_score > max_score:
        raise ValueError("min_score is above max_score")
    if min_reason_count is not None and reason_count is not None:
        raise ValueError("give either min_reason_count or reason_count")
    for value, known in ((activity, ACTIVITY), (eligibility, ELIGIBILITY)):
        if value is not None and value not in known:
            raise ValueError(f"unknown filter {value}")
    side = lambda name: snapshots.select(F.col("id").alias(name), F.struct("status", "baseline_eligible").alias(f"listing_{name}"))
    now = edges.filter("is_current").select("low", "high", F.struct("match_revision", "score", "decision").alias("photo_evidence"))
    rows = candidates.join(side("low"), "low", "left").join(side("high"), "high", "left").join(now, ["low", "high"], "left")
    active = [F.when(F.col(f"listing_{s}.status") == "active", 1).otherwise(0) for s in ("low", "high")]
    eligible = [F.when(F.coalesce(F.col(f"listing_{s}.baseline_eligible").cast("int"), F.lit(0)) == 1, 1).otherwise(0) for s in ("low", "high")]
    n, ready = active[0] + active[1], eligible[0] + eligible[1]
    facts = F.struct(F.size("reasons").alias("reason_count"), F.when(n == 2, "both_active").when(n == 1, "active_missing").otherwise("both_missing").alias("activity"), ready.alias("baseline_eligible_count"))
    rows = rows.withColumn("queue_facts", facts)
    wanted = [
        status is not None and (F.col("status") == status), min_priority is not None and (F.col("priority") >= min_priority),
        min_reason_count is not None and (F.col("queue_facts.reason_count") >= min_reason_count), reason_count is not None and (F.col("queue_facts.reason_count") == reason_count),
        activity is not None and (F.col("queue_facts.activity") == activity),
        eligibility is not None and {"both": ready == 2, "at_least_one": ready >= 1, "neither": ready == 0}.get(eligibility),
        photo_decision is not None and (F.col("photo_evidence.decision") == photo_decision),
        min_score is not None and (F.col("photo_evidence.score") >= min_score), max_score is not None and (F.col("photo_evidence.score") <= max_score),
    ]
    asked = [w for w in wanted if w is not False]
    return rows.filter(reduce(lambda x, y: x & y, asked)) if asked else rows


def page(rows: DataFrame, order: str = "priority", limit: int = 50, offset: int = 0) -> DataFrame:
    """A page by priority, or by revision: a fixed order that looks random."""
    if order not in ("priority", "revision"):
        raise ValueError(f"unknown order {order}")
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("a page has 1 to 500 rows")
    by = [F.desc("priority"), "updated_at", "low", "high"] if order == "priority" else ["revision", "low", "high"]
    return rows.orderBy(*(b for b in by if not isinstance(b, str) or b in rows.columns)).offset(offset).limit(limit)


#: Versions that evidence must name.
EVIDENCE_VERSIONS = ["normalization_version", "fingerprint_version", "intra_listing_dedupe_version", "photo_role_model_version", "photo_asset_stats_version", "matcher_version"]
DECISIONS = ["likely_same", "likely_different", "uncertain"]


def judged_evidence(incoming: DataFrame, candidates: DataFrame, state: DataFrame) -> DataFrame:
    """incoming (a, b, revision, decision, score, versions, and of each side identity and photo set) with low, high, outcome, match_revision.

    candidates: low, high, revision, low_hash, high_hash of current pairs; state: id, photo_set_hash. outcome: invalid
    (one listing, an unknown one, a version missing, a wrong decision or score), stale (the pair, its revision, an
    identity or a photo set has changed), else accepted. Sides given in the other order are swapped.
    """
    a, b = F.col("a").cast("string"), F.col("b").cast("string")
    swapped = a > b
    pick = lambda low, high: F.when(swapped, F.col(high)).otherwise(F.col(low))
    rows = incoming.withColumns({"low": F.least(a, b), "high": F.greatest(a, b), "low_identity": pick("identity_a", "identity_b"), "high_identity": pick("identity_b", "identity_a"), "low_photos": pick("photos_a", "photos_b"), "high_photos": pick("photos_b", "photos_a")})
    side = lambda name: state.select(F.col("id").alias(name), F.col("photo_set_hash").alias(f"{name}_set"), F.lit(True).alias(f"{name}_known"))
    now = candidates.select("low", "high", F.col("revision").alias("current"), "low_hash", "high_hash")
    both = rows.join(side("low"), "low", "left").join(side("high"), "high", "left").join(now, ["low", "high"], "left")
    versions = F.lit(True)
    for v in EVIDENCE_VERSIONS:
        versions = versions & (F.coalesce(F.col(v), F.lit("")) != "")
    score = S.number(F.col("score"))
    right = (F.col("low") != F.col("high")) & F.col("low_known") & F.col("high_known") & versions & F.col("decision").isin(DECISIONS) & score.between(0, 1)
    same = lambda x, y: F.nullif(F.col(x), F.lit("")).eqNullSafe(F.nullif(F.col(y), F.lit("")))
    fresh = (F.col("revision") == F.col("current")) & same("low_identity", "low_hash") & same("high_identity", "high_hash") & same("low_photos", "low_set") & same("high_photos", "high_set")
    outcome = F.when(~F.coalesce(right, F.lit(False)), "invalid").when(~F.coalesce(fresh, F.lit(False)), "stale").otherwise("accepted")
    parts = ["low", "high", "revision", "low_hash", "high_hash", "low_photos", "high_photos", *EVIDENCE_VERSIONS]
    hashed = F.when(F.col("outcome") == "accepted", S.typed_hash(*map(F.col, parts)))
    return both.withColumn("outcome", outcome).withColumn("match_revision", hashed).select(*incoming.columns, "low", "high", "outcome", "match_revision")


def edges_after(edges: DataFrame, judged: DataFrame) -> DataFrame:
    """edges (low, high, match_revision, score, decision, is_current) with the accepted evidence; a pair has one current edge, the last of `arrived`."""
    last = judged.filter("outcome = 'accepted'").groupBy("low", "high").agg(F.max_by(F.struct("match_revision", S.number(F.col("score")).alias("score"), "decision"), "arrived").alias("e")).select("low", "high", "e.*", F.lit(True).alias("is_current"))
    pairs = last.select("low", "high", F.col("match_revision").alias("new"))
    old = edges.join(pairs, ["low", "high"], "left").filter("new is null or new <> match_revision").withColumn("is_current", F.col("is_current") & F.col("new").isNull()).drop("new")
    return old.unionByName(last)
