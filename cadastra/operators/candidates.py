"""Candidate pairs: blocking, conflicts, signals, priority, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastra.session import written

MAX_BLOCK = 100


def blocks(rows: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """id, reason, key: one row per block a row falls into; null keys fall into none."""
    each = F.array_compact(F.array(*(F.when(k.isNotNull(), F.struct(F.lit(r).alias("reason"), k.alias("key"))) for r, k in keys.items())))
    return rows.select("id", F.explode(each).alias("b")).select("id", "b.reason", "b.key")


def candidate_pairs(rows: DataFrame, keys: dict[str, Column], max_block: int = MAX_BLOCK) -> DataFrame:
    """low, high, reasons: pairs that share a block of 2 to max_block rows. Larger blocks say nothing and are left out."""
    found = written(blocks(rows, keys).distinct())
    sizes = found.groupBy("reason", "key").agg(F.count("*").alias("n")).filter(F.col("n").between(2, max_block)).drop("n")
    # at most max_block ids a block, by the join; the groups lie where the join has put them
    listed = found.join(sizes, ["reason", "key"]).groupBy("reason", "key").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    after = lambda i: F.slice("ids", i + 2, F.size("ids"))
    each = F.flatten(F.transform("ids", lambda x, i: F.transform(after(i), lambda y: F.struct(x.alias("low"), y.alias("high")))))
    return listed.select("reason", F.explode(each).alias("p")).groupBy("p.low", "p.high").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def with_sides(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """pairs with all fields of both sides as structs a and b."""
    side = F.struct(*rows.columns)
    return pairs.join(rows.select(F.col("id").alias("low"), side.alias("a")), "low").join(rows.select(F.col("id").alias("high"), side.alias("b")), "high")


def conflicts(area: float = 0.1) -> Column:
    """Sorted hard conflicts of sides a and b: differing rooms or floor, area apart by more than a tenth of the larger."""
    differ = lambda f: F.col(f"a.{f}").isNotNull() & F.col(f"b.{f}").isNotNull() & (F.col(f"a.{f}") != F.col(f"b.{f}"))
    a, b = F.col("a.area"), F.col("b.area")
    apart = (a > 0) & (b > 0) & (F.abs(a - b) > F.greatest(a, b) * area)
    return F.array_sort(F.array_compact(F.array(F.when(apart, F.lit("area")), F.when(differ("floor"), F.lit("floor")), F.when(differ("rooms"), F.lit("rooms")))))


def priority(reasons: Column, both_active: Column, near: Column) -> Column:
    """Exact photos 100, three reasons 80, two 60, one 30; 5 more if both are active, 2 if they are near."""
    n = F.size(reasons)
    base = F.when(F.array_contains(reasons, "exact_photo_set"), 100).when(n >= 3, 80).when(n == 2, 60).otherwise(30)
    return base + F.when(both_active, 5).otherwise(0) + F.when(near, 2).otherwise(0)


def status(override: Column, evidence: Column, conflict: Column) -> Column:
    return (
        F.when(override == "same_entity", "manual_linked")
        .when(override == "different_entity", "manual_not_link")
        .when(evidence, "photo_evidence_ready")
        .when(F.size(conflict) > 0, "metadata_conflict")
        .otherwise("awaiting_photo_analysis")
    )


def distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres on a sphere of 6,371,000 m."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371000.0 * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def stratified(rows: DataFrame, stratum: str, order: str, quotas: dict[str, int]) -> DataFrame:
    """The first rows of each stratum by order, as many as its quota. The largest quota bounds each window before its shuffle."""
    quota = F.coalesce(*(F.when(F.col(stratum) == k, F.lit(n)) for k, n in quotas.items()), F.lit(0))
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(stratum).orderBy(order))).filter(F.col("rn") <= max(quotas.values(), default=0)).filter(F.col("rn") <= quota)


def largest_remainder(total: int, weights: list[int]) -> list[int]:
    """Whole shares of total by weight; what is left goes to the largest remainders, ties to the lower index."""
    whole = sum(weights)
    shares = [total * w // whole for w in weights]
    order = sorted(range(len(weights)), key=lambda i: (-(total * weights[i] % whole), i))
    for i in order[: total - sum(shares)]:
        shares[i] += 1
    return shares
