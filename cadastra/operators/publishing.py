"""Publication of clean listings: the gate with outside texts, one canonical row an entity, enrichment, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastra.functions import scalars as S
from cadastra.operators.history import canonical
from cadastra.operators.verdicts import comparable
from cadastra.session import written


def gated(rows: DataFrame, verdicts: DataFrame, outside: DataFrame) -> DataFrame:
    """rows (id, content_hash) with usable, reason_code, rewritten and gate.

    verdicts: id, content_hash, usable (1, 0, null), reason_code. outside: id, content_hash, and the decision usable,
    reason_code (usable null: no decision fits the row). Without a verdict on the current text a row waits. If an outside
    text exists for it, its decision rules: none waits, another than the verdict's rewrites it. Else the verdict rules.
    """
    known = verdicts.select("id", F.col("content_hash").alias("judged_hash"), F.col("usable").alias("own"), F.col("reason_code").alias("own_code"), F.lit(True).alias("judged"))
    out = outside.select("id", "content_hash", F.col("usable").alias("other"), F.col("reason_code").alias("other_code"), F.lit(True).alias("outside"))
    both = rows.join(known, "id", "left").join(out, ["id", "content_hash"], "left")
    current = F.coalesce(F.col("judged") & (F.col("judged_hash") == F.col("content_hash")), F.lit(False))
    by_other = F.coalesce("outside", F.lit(False))
    usable = F.when(by_other, F.col("other")).otherwise(F.col("own"))
    code = F.when(by_other & F.col("other").isNotNull(), F.col("other_code")).otherwise(F.col("own_code"))
    gate = F.when(~current | usable.isNull(), "waiting").when(usable == 1, "publish").otherwise("rejected")
    rewritten = current & by_other & F.col("other").isNotNull() & ~(F.col("other").eqNullSafe(F.col("own")) & F.col("other_code").eqNullSafe(F.col("own_code")))
    return both.withColumns({"usable": usable, "reason_code": code, "rewritten": rewritten, "gate": gate}).drop("judged_hash", "own", "own_code", "judged", "other", "other_code", "outside")


QUALITY = ["title", "full_description", "rooms", "square_m2", "street", "house_num", "complex_id", "complex_name", "floor", "floor_total"]


def quality(columns: list[str]) -> list[Column]:
    """Order of rows of one price: last seen, how complete they are, photos, id."""
    present = [F.col(c) for c in QUALITY if c in columns]
    photos = F.coalesce(S.number(F.col("photo_count")), F.lit(0.0)) if "photo_count" in columns else F.lit(0.0)
    return [F.desc(F.coalesce("last_seen_at", F.lit(""))), F.desc(S.filled(*present) if present else F.lit(0)), F.desc(photos), F.desc("id")]


def canonical_rows(ready: DataFrame, members: DataFrame, entities: DataFrame, current: DataFrame) -> DataFrame:
    """One whole row for each entity of ready (id, status, price, ...), with what is known of the entity.

    members: listing, entity; entities: as `observe.recompute_entities` gives them; current: entity, canonical (the
    listing published so far). Prices of an entity are those of its ready active rows only.
    """
    own = ready.join(members.select(F.col("listing").alias("id"), "entity"), "id").join(current.select("entity", F.col("canonical").alias("__current")), "entity", "left")
    active, price = F.coalesce(F.col("status") == "active", F.lit(False)), S.price(F.col("price"))
    ranges = own.groupBy("entity").agg(F.count_if(active).alias("entity_ready_active_listing_count"), F.min(F.when(active, price)).alias("entity_active_min_price"), F.max(F.when(active, price)).alias("entity_active_max_price"))
    chosen = canonical(own, "entity", active, price, F.coalesce(F.col("id") == F.col("__current"), F.lit(False)), quality(ready.columns))
    known = entities.select("entity", *(F.col(a).alias(f"entity_{b}") for a, b in (("first_seen_at", "first_seen_at"), ("last_seen_at", "last_seen_at"), ("lifecycle_status", "status"), ("relist_count", "relist_count"), ("members", "member_count"), ("active", "active_listing_count"))))
    return chosen.join(known, "entity", "left").join(ranges, "entity").withColumn("source_listing_id", F.col("id")).withColumn("switched", ~F.col("__current").eqNullSafe(F.col("id"))).drop("__current")


def enriched(rows: DataFrame, texts: DataFrame, photos: DataFrame, text_version: str, photo_version: str) -> DataFrame:
    """rows (id, content_hash, photo_set_hash) with assessments of exactly their revision; empty texts where there is none.

    texts: id, content_hash, evaluator_version, result; photos: id, photo_set_hash, evaluator_version, status, score, coverage.
    """
    own = texts.filter(F.col("evaluator_version") == text_version).select("id", "content_hash", F.col("result").alias("main_text_assessment"))
    seen = photos.filter(F.col("evaluator_version") == photo_version).select("id", F.coalesce("photo_set_hash", F.lit("")).alias("__photos"), "status", "score", "coverage")
    seen = seen.select("id", "__photos", F.col("status").alias("interior_status"), F.col("score").cast("string").alias("interior_score"), F.col("coverage").alias("interior_coverage"))
    out = rows.withColumn("__photos", F.coalesce("photo_set_hash", F.lit(""))).join(own, ["id", "content_hash"], "left").join(seen, ["id", "__photos"], "left").drop("__photos")
    empty = {c: F.coalesce(c, F.lit("")) for c in ("main_text_assessment", "interior_status", "interior_score", "interior_coverage")}
    return out.withColumns(empty).withColumn("interior_evaluator_version", F.when(F.col("interior_status") != "", photo_version).otherwise(""))


def sequenced(rows: DataFrame, *order: str) -> DataFrame:
    """rows with seq, from 1 in the order given, which must have no ties.

    No task sees all rows: ranges of the order are stored, numbered within themselves and moved by what is before them.
    """
    dealt = written(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    # one row a range
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("n")).withColumn("__before", F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)))
    numbered = dealt.withColumn("__n", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    return numbered.join(sizes.select("__part", "__before"), "__part").withColumn("seq", F.col("__n") + F.coalesce("__before", F.lit(0))).drop("__part", "__n", "__before")


def publish(rows: DataFrame, verdicts: DataFrame, outside: DataFrame, members: DataFrame, entities: DataFrame, current: DataFrame) -> DataFrame:
    """The whole publication: comparable rows, through the gate, one canonical row an entity."""
    ready = gated(rows.filter(comparable(F.col("baseline_eligible"), F.col("seller_type"))), verdicts, outside).filter("gate = 'publish'")
    return canonical_rows(ready, members, entities, current)


def export_scores(photos: DataFrame, version: str) -> DataFrame:
    """Photo scores that are whole: ready, covered, 1 to 10, of a right hash; others are left out."""
    ok = F.col("status").isin("ready", "ready_with_download_gaps") & F.col("coverage").isin("sufficient", "partial") & F.col("score").between(1, 10) & F.col("photo_set_hash").rlike("^[0-9a-f]{64}$")
    return photos.filter((F.col("evaluator_version") == version) & F.coalesce(ok, F.lit(False))).select("id", "photo_set_hash", F.col("score").alias("interior_score"), F.col("coverage").alias("interior_coverage"))
