"""Verdict layers and the publish gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rule_reason(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Reason of the first rule whose pattern matches; null if none does."""
    found = F.lit(None).cast("string")
    for reason, pattern in reversed(rules):
        found = F.when(text.rlike(pattern), F.lit(reason)).otherwise(found)
    return found


def changed(rows: DataFrame, known: DataFrame, key: str, hash_column: str) -> DataFrame:
    """Rows that are new or whose hash differs from the known one; a null is a value."""
    old = known.select(F.col(key).alias("__key"), F.col(hash_column).alias("__hash"), F.lit(True).alias("__seen"))
    joined = rows.join(old, F.col(key) == F.col("__key"), "left")
    return joined.filter(F.col("__seen").isNull() | ~F.col(hash_column).eqNullSafe(F.col("__hash"))).withColumn("is_new", F.col("__seen").isNull()).drop("__key", "__hash", "__seen")


def gate(usable: Column, current: Column) -> Column:
    """waiting without a current verdict, else by usable: 1 publish, 0 rejected, null waiting."""
    return F.when(~F.coalesce(current, F.lit(False)) | usable.isNull(), "waiting").when(usable == 1, "publish").otherwise("rejected")


def latest(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each key, by an order without ties."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), order).alias("r")).select(*keys, "r.*")


def current_revision(pairs: DataFrame) -> DataFrame:
    """One row a pair (low, high): its current revision (is_current), of several the one processed last; none if it has none."""
    return latest(pairs.filter("is_current"), ["low", "high"], F.struct("processed_at", "revision"))


def comparable(eligible: Column, seller: Column) -> Column:
    """Eligible (1, true or their texts) and offered by a professional."""
    return F.coalesce(eligible.cast("string").isin("1", "true") & (F.lower(F.trim(seller)) == "professional"), F.lit(False))


def audit(profiles: DataFrame, key: str, codes: str, examples: int = 3) -> DataFrame:
    """code, n, examples: how often a code occurs, and its smallest keys. Numbered within two levels, so a frequent code is no one task's work."""
    each = profiles.select(key, F.explode(codes).alias("code")).withColumn("part", F.pmod(F.xxhash64(key), F.lit(64)))
    parts = each.withColumn("rn", F.row_number().over(Window.partitionBy("code", "part").orderBy(key))).groupBy("code", "part")
    small = parts.agg(F.count("*").alias("n"), F.collect_list(F.when(F.col("rn") <= examples, F.col(key))).alias("first"))
    whole = small.groupBy("code").agg(F.sum("n").alias("n"), F.flatten(F.collect_list("first")).alias("first"))
    return whole.select("code", "n", F.slice(F.array_sort("first"), 1, examples).alias("examples"))
