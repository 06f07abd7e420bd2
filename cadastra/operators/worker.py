"""A run of photo evidence over selected candidates: a document or an error for each, and what came of the run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.operators import photos as P

#: The most candidates of a run and the most photos of a listing.
MOST, MOST_PHOTOS = 500, P.MAX_PHOTOS
STATS = ["considered", "decoded", "unique", "duplicates", "errors"]


def checked(limit: int, max_photos: int) -> None:
    if not 1 <= limit <= MOST:
        raise ValueError(f"a run takes 1 to {MOST} candidates")
    if not 1 <= max_photos <= MOST_PHOTOS:
        raise ValueError(f"a listing shows 1 to {MOST_PHOTOS} photos")


def run(candidates: DataFrame, frames: DataFrame, failed: DataFrame, versions: dict[str, str], max_photos: int = MOST_PHOTOS, bits: int = 4, rgb: float = 0.08) -> DataFrame:
    """low, high, stratum, revision, document, score, decision, matches, stats (of both sides together), error.

    candidates: low, high, revision, low_hash, high_hash, and stratum if they were sampled. A candidate with a side that
    shows no photo has no document but an error; nothing that is wrong with one candidate costs another.
    """
    checked(1, max_photos)
    wanted = candidates.select(F.explode(F.array("low", "high")).alias("listing")).distinct()
    listed = P.analysed(frames.join(wanted, "listing", "left_semi"), failed.join(wanted, "listing", "left_semi"), bits, rgb, max_photos)
    documents = P.pair_documents(candidates.select("low", "high", "revision", "low_hash", "high_hash"), listed, versions)
    stratum = F.col("stratum") if "stratum" in candidates.columns else F.lit(None).cast("string")
    shown = lambda name: listed.filter("unique > 0").select(F.col("listing").alias(name), F.lit(True).alias(f"{name}_shown"))
    both = candidates.select("low", "high", stratum.alias("stratum"), "revision").join(documents, ["low", "high"], "left").join(shown("low"), "low", "left").join(shown("high"), "high", "left")
    doc = F.col("document")
    side = lambda s, c: doc[s]["stats"][c]
    stats = F.struct(*((side("listing_a", c) + side("listing_b", c)).alias(c) for c in STATS))
    missing = F.array_join(F.array_compact(F.array(F.when(F.col("low_shown").isNull(), F.col("low").cast("string")), F.when(F.col("high_shown").isNull(), F.col("high").cast("string")))), ", ")
    error = F.when(doc.isNull(), F.concat(F.lit("no usable photos of "), missing))
    return both.select("low", "high", "stratum", "revision", "document", doc["score"].alias("score"), doc["decision"].alias("decision"), F.size(doc["matches"]).alias("matches"), F.when(doc.isNotNull(), stats).alias("stats"), error.alias("error"))


def overview(results: DataFrame) -> DataFrame:
    """One row: selected, analyzed, failed, the photo totals, and the scores' count, lowest, middle, highest and classes."""
    s = F.col("score")
    return results.agg(
        F.count("*").alias("selected"), F.count_if(F.col("error").isNull()).alias("analyzed"), F.count_if(F.col("error").isNotNull()).alias("failed"),
        *(F.coalesce(F.sum(F.col("stats")[c]), F.lit(0)).alias(c) for c in STATS),
        F.count(s).alias("scores"), F.min(s).alias("lowest"), F.bround(F.median(s), 6).alias("middle"), F.max(s).alias("highest"),
        F.count_if(s >= 0.9).alias("at_least_90"), F.count_if(s >= 0.98).alias("at_least_98"), F.count_if(s < 0.7).alias("under_70"),
    )


def strata(results: DataFrame) -> DataFrame:
    """stratum, selected, analyzed of a sampled run."""
    return results.groupBy("stratum").agg(F.count("*").alias("selected"), F.count_if(F.col("error").isNull()).alias("analyzed"))
