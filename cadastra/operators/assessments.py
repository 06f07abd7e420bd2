"""Model answers and outside assessments: tolerant parsing, reuse of comparisons, checks of recorded evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.functions.text import normalised

#: Reason codes, confidences and decisions of verdicts and evidence.
REASON_CODES = ["ok", "partial_property", "not_apartment", "not_sale", "price_not_full", "legal_restriction", "auction_distress", "non_market_terms", "other_red_flag"]
CONFIDENCES = ["high", "medium", "low"]
DECISIONS = ["likely_same", "likely_different", "uncertain"]

_LINE = "custom_id string, response struct<body: struct<choices: array<struct<message: struct<content: string>>>>>"
_ITEM = "id string, usable boolean, reason_code string, confidence string, reason string"


def valid_verdict(v: Column) -> Column:
    """Known code and confidence; usable exactly with ok; a reason exactly where it is not usable."""
    known = v["usable"].isNotNull() & v["reason_code"].isin(REASON_CODES) & v["confidence"].isin(CONFIDENCES)
    reason = F.coalesce(v["reason"], F.lit("")) != ""
    return F.coalesce(known & (v["usable"] == (v["reason_code"] == "ok")) & (v["usable"] != reason), F.lit(False))


def parse_outputs(lines: DataFrame, groups: DataFrame) -> DataFrame:
    """listing_id, usable, reason_code, confidence, reason, source from answer lines (value) and their groups (custom_id, listing_id).

    One bad item costs only itself; a bad answer or a missing item makes its listings llm_failed, with usable null.
    A line that names no group writes nothing. The last of repeated items counts.
    """
    answers = lines.select(F.from_json("value", _LINE).alias("p")).select("p.custom_id", F.get("p.response.body.choices", F.lit(0))["message"]["content"].alias("content")).filter("custom_id is not null")
    items = answers.select("custom_id", F.posexplode(F.from_json("content", "verdicts array<string>")["verdicts"]).alias("pos", "item"))
    read = items.select("custom_id", "pos", F.from_json("item", _ITEM).alias("v")).filter("v.id <> ''")
    last = read.groupBy("custom_id", F.col("v.id").alias("listing_id")).agg(F.max_by("v", "pos").alias("v"))
    expected = groups.select("custom_id", F.col("listing_id").cast("string").alias("listing_id")).join(answers.select("custom_id").distinct(), "custom_id", "left_semi")
    good = valid_verdict(F.col("v"))
    return expected.join(last, ["custom_id", "listing_id"], "full").select(
        "listing_id",
        F.when(good, F.col("v.usable")).alias("usable"),
        F.when(good, F.col("v.reason_code")).otherwise("llm_failed").alias("reason_code"),
        F.when(good, F.col("v.confidence")).otherwise("low").alias("confidence"),
        F.when(good, F.substring(F.coalesce("v.reason", F.lit("")), 1, 200)).otherwise("no valid verdict").alias("reason"),
        F.when(good, "llm").otherwise("llm_failed").alias("source"),
    )


def reusable(rows: DataFrame, assessments: DataFrame, version: str, context: list[str], max_evidence: int = 180) -> DataFrame:
    """rows with an assessment of the same id, hash and version whose context is equal, nulls alike, and whose evidence the text holds."""
    own = assessments.filter(F.col("version") == version).select("id", "content_hash", *(F.col(c).alias(f"__{c}") for c in context), "evidence", "usable", "reason_code")
    same = F.lit(True)
    for c in context:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    quoted = normalised(F.col("evidence"))
    shown = (F.length("evidence") <= max_evidence) & (quoted != "") & F.contains(normalised(F.col("text")), quoted)
    agreed = (F.col("usable") == (F.col("reason_code") == "ok")) & F.col("reason_code").isin(REASON_CODES)
    return rows.join(own, ["id", "content_hash"]).filter(same & shown & agreed).drop(*(f"__{c}" for c in context))


def judge_evidence(incoming: DataFrame, current: DataFrame, versions: list[str]) -> DataFrame:
    """incoming with state: invalid (decision, score or a version is not right), stale (no current pair of that revision), else accepted."""
    bad = ~F.coalesce(F.col("decision").isin(DECISIONS) & F.col("score").between(0, 1) & ~F.isnan("score"), F.lit(False))
    for v in versions:
        bad = bad | (F.coalesce(F.col(v), F.lit("")) == "")
    now = current.select("low", "high", F.col("revision").alias("__revision"))
    return incoming.join(now, ["low", "high"], "left").withColumn("state", F.when(bad, "invalid").when(F.col("revision").eqNullSafe(F.col("__revision")), "accepted").otherwise("stale")).drop("__revision")


#: Kinds of offers, and states and coverages of photo results.
OFFER_TYPES = ["whole_apartment", "multi_unit_offer", "partial_property", "non_apartment", "not_sale", "unclear"]
UNSEEN, READY, COVERAGES = ["no_photos", "photos_unavailable"], ["ready", "ready_with_download_gaps"], ["sufficient", "partial", "insufficient"]
MOST_BYTES = 16_384


def text_fault(listing_id: Column, content_hash: Column, version: Column, result: Column) -> Column:
    """Why a text assessment cannot be stored; null if it can. result is a JSON object as text."""
    bad_id = ~F.coalesce(F.length(F.trim(listing_id)).between(1, 80), F.lit(False))
    return (
        F.when(bad_id, "listing_id")
        .when(~F.coalesce(content_hash.rlike("^[0-9a-f]{16}$"), F.lit(False)), "content_hash")
        .when(~F.coalesce(version.rlike("^[A-Za-z0-9._:-]{1,100}$"), F.lit(False)), "version")
        .when(F.coalesce(F.octet_length(result), F.lit(MOST_BYTES + 1)) > MOST_BYTES, "size")
        .when(F.try_parse_json(result).isNull() | ~F.trim(result).startswith("{"), "result")
    )


def photo_fault(photo_set_hash: Column, status: Column, coverage: Column, score: Column) -> Column:
    """Why a photo assessment cannot be stored; null if it can. Unseen photos have neither score nor coverage."""
    seen_fault = F.when(coverage == "insufficient", F.when(score.isNotNull(), "score")).when(F.coalesce(coverage.isin(COVERAGES), F.lit(False)), F.when(~F.coalesce(score.between(1, 10), F.lit(False)), "score")).otherwise("coverage")
    return (
        F.when(photo_set_hash.isNotNull() & ~photo_set_hash.rlike("^[0-9a-f]{64}$"), "photo_set_hash")
        .when(~F.coalesce(status.isin(UNSEEN + READY), F.lit(False)), "status")
        .when(status.isin(UNSEEN), F.when(score.isNotNull() | coverage.isNotNull(), "unseen"))
        .otherwise(seen_fault)
    )


def saved(stored: DataFrame, incoming: DataFrame, keys: list[str], order: str = "updated_at") -> DataFrame:
    """stored with the incoming rows in place of those of equal keys; of several, the last."""
    rest = [c for c in stored.columns if c not in keys]
    last = incoming.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(*keys, "r.*")
    return stored.join(last.select(*keys), keys, "left_anti").unionByName(last)


def comparison(price_now: Column, price_then: Column, photos_now: Column, photos_then: Column, furniture_now: Column, furniture_then: Column, v: Column, text: Column, max_evidence: int = 180) -> Column:
    """The decision (usable, reason_code, confidence) that an outside verdict v still gives; null if none.

    v: struct offer_type, photo_scope, data_consistency, usable, reason_code, confidence, evidence. Price, photos and
    furniture must be those that it was made for. An undecided verdict on an offer of several units says unit_ambiguous.
    A rejection must quote the text; an acceptance quotes nothing and is of one whole apartment.
    """
    none_if_empty = lambda c: F.nullif(c, F.lit(""))
    exact = lambda c: c.cast("string").try_cast("decimal(38,10)")
    same = F.coalesce(exact(price_now) == exact(price_then), F.lit(False)) & none_if_empty(photos_now).eqNullSafe(none_if_empty(photos_then)) & none_if_empty(furniture_now).eqNullSafe(none_if_empty(furniture_then))
    known = F.coalesce(v["offer_type"].isin(OFFER_TYPES), F.lit(False))
    several = (v["offer_type"] == "multi_unit_offer") | (F.coalesce(v["photo_scope"], F.lit("")) == "mixed_units") | (F.coalesce(v["data_consistency"], F.lit("")) == "conflicting")
    ambiguous = v["usable"].isNull() & (v["reason_code"] == "unclear") & several
    evidence = F.coalesce(v["evidence"], F.lit(""))
    quoted = normalised(evidence)
    right = v["usable"].isNotNull() & v["reason_code"].isin(REASON_CODES) & v["confidence"].isin(CONFIDENCES) & (v["usable"] == (v["reason_code"] == "ok")) & v["evidence"].isNotNull() & (F.length(evidence) <= max_evidence)
    accepted = (quoted == "") & (v["offer_type"] == "whole_apartment")
    of_kind = F.when(v["reason_code"] == "partial_property", v["offer_type"] == "partial_property").when(v["reason_code"] == "not_apartment", v["offer_type"] == "non_apartment").when(v["reason_code"] == "not_sale", v["offer_type"] == "not_sale").otherwise(F.lit(True))
    rejected = (quoted != "") & F.contains(normalised(text), quoted) & of_kind
    decision = lambda usable, code, confidence: F.struct(usable.alias("usable"), code.alias("reason_code"), confidence.alias("confidence"))
    return F.when(
        same & known,
        F.when(ambiguous, decision(F.lit(False), F.lit("unit_ambiguous"), F.when(v["offer_type"] == "multi_unit_offer", "high").otherwise("medium"))).when(
            right & F.when(v["usable"], accepted).otherwise(rejected), decision(v["usable"], v["reason_code"], v["confidence"])
        ),
    )
