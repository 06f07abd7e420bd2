"""Labelled cases: a multi-line JSON file of texts with the codes that a model should give them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CASE = "name string, text string, expect string, title string, fields map<string,string>, soft boolean, broken string"
#: The listing that a case's text and fields are put into.
BASE = {"title": "1-комнатная квартира · 40 м² · 5/9 этаж", "rooms": "1", "square_m2": "40.0", "floor": "5", "floor_total": "9", "price": "35000000", "rent_renovation": None, "furniture": None, "priv_dorm": None}


def read(spark: SparkSession, path: str) -> DataFrame:
    """place, name, text, expected (codes), title, fields, soft and fault (null: a good case) of a JSON list of cases.

    expect is one code or a list. Faults: broken (cannot be read), no name, no text, no expected code, repeated name.
    """
    raw = spark.read.schema(_CASE).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").json(path)
    placed = raw.withColumn("place", F.monotonically_increasing_id())
    listed = F.when(F.col("expect").startswith("["), F.from_json("expect", "array<string>")).when(F.coalesce("expect", F.lit("")) != "", F.array("expect"))
    names = placed.groupBy("name").agg(F.count("*").alias("times"))
    both = placed.join(names, "name", "left").withColumn("expected", F.filter(listed, lambda c: F.coalesce(c, F.lit("")) != ""))
    empty = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    fault = (
        F.when(F.col("broken").isNotNull(), "broken").when(empty(F.col("name")), "no name").when(empty(F.col("text")), "no text")
        .when(F.coalesce(F.size("expected"), F.lit(0)) < 1, "no expected code").when(F.col("times") > 1, "repeated name")
    )
    return both.select("place", "name", "text", "expected", "title", "fields", F.coalesce("soft", F.lit(False)).alias("soft"), fault.alias("fault"))


def listings(cases: DataFrame) -> DataFrame:
    """The good cases as listings: id (C and the place), the base's fields with the case's own in their place, full_description."""
    good = cases.filter("fault is null")
    of = {name: F.coalesce(F.try_element_at("fields", F.lit(name)), F.lit(value).cast("string")) for name, value in BASE.items()}
    of["title"] = F.coalesce(F.nullif("title", F.lit("")), of["title"])
    columns = [value.alias(name) for name, value in of.items()]
    return good.select(F.concat(F.lit("C"), F.lpad(F.col("place").cast("string"), 3, "0")).alias("id"), *columns, F.col("text").alias("full_description"), "expected", "soft")
