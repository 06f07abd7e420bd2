"""Hot zones: how fast listings of a place leave the market, by survival curves that count those still on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days at which shares are stated, and the fewest listings of a group that is shown.
DAYS, FEWEST = (7, 14, 30, 60), 5


def cell(latitude: Column, longitude: Column, size: float = 0.01) -> Column:
    """The grid cell of a place."""
    return F.concat_ws("/", *(F.floor(c / size).cast("string") for c in (latitude, longitude)))


def survival(episodes: DataFrame, key: str) -> DataFrame:
    """key, day, at_risk, gone, surviving: the Kaplan-Meier curve of episodes (key, days, ended).

    An episode that has not ended is at risk until its last known day, and leaves the curve then. Episodes of one day are
    counted first, so a curve's window has a row a day, however many listings a place has. Negative and null days do not count.
    """
    days = F.floor("days").cast("long").alias("day")
    each = episodes.filter("days >= 0").groupBy(key, days).agg(F.count("*").alias("n"), F.count_if("ended").alias("gone"))
    later = Window.partitionBy(key).orderBy(F.desc("day"))
    marked = each.withColumn("at_risk", F.sum("n").over(later))
    # a curve that came to 0 stays there; a product is a sum of logarithms
    stays = F.when(F.col("gone") < F.col("at_risk"), F.log1p(-F.col("gone") / F.col("at_risk"))).otherwise(F.lit(0.0))
    upto = Window.partitionBy(key).orderBy("day")
    ended = F.max((F.col("gone") == F.col("at_risk")).cast("int")).over(upto) == 1
    curve = marked.withColumn("surviving", F.when(ended, 0.0).otherwise(F.exp(F.sum(stays).over(upto))))
    return curve.select(key, "day", "at_risk", "gone", "surviving")


def gone_shares(episodes: DataFrame, key: str, days: tuple[int, ...] = DAYS, fewest: int = FEWEST) -> DataFrame:
    """key, listings, sold, gone_<day>: shares that left by each day; groups of fewer listings are left out.

    A day behind the last known one of a group has no share: null.
    """
    sizes = episodes.filter("days >= 0").groupBy(key).agg(F.count("*").alias("listings"), F.count_if("ended").alias("sold"), F.max(F.floor("days")).alias("last"))
    curve = survival(episodes, key)
    at = curve.groupBy(key).agg(*(F.min(F.when(F.col("day") <= d, F.col("surviving"))).alias(f"s_{d}") for d in days))
    shares = [F.when(F.col("last") >= d, 1 - F.coalesce(f"s_{d}", F.lit(1.0))).alias(f"gone_{d}") for d in days]
    return sizes.filter(F.col("listings") >= fewest).join(at, key).select(key, "listings", "sold", *shares)


def hotness(shares: DataFrame, key: str, day: int = 30) -> DataFrame:
    """shares with heat: the place of its share by a day among all, from 0 (slow) to 1; null where it has none."""
    ranked = shares.filter(F.col(f"gone_{day}").isNotNull()).groupBy(f"gone_{day}").agg(F.count("*").alias("n"))
    # one row a distinct share; cells of one share are one rank
    below = ranked.withColumn("below", F.sum("n").over(Window.orderBy(f"gone_{day}").rowsBetween(Window.unboundedPreceding, -1))).crossJoin(ranked.agg(F.sum("n").alias("all")))
    heat = F.when(F.col("all") > 1, F.coalesce("below", F.lit(0)) / (F.col("all") - 1)).otherwise(0.0)
    return shares.join(below.select(f"gone_{day}", heat.alias("heat")), f"gone_{day}", "left").select(*shares.columns, "heat")
