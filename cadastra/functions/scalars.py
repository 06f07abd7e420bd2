"""Scalar expressions with defined results on odd input: numbers, times, half-even rounding, typed hashes, url policy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(value: Column) -> Column:
    """A finite double, or null."""
    parsed = F.try_cast(F.trim(value.cast("string")), "double") if hasattr(F, "try_cast") else F.trim(value.cast("string")).try_cast("double")
    return F.when(~F.isnan(parsed) & (F.abs(parsed) < float("inf")), parsed)


def price(value: Column) -> Column:
    """A usable asking price: a finite number above 0, or null."""
    parsed = number(value)
    return F.when(parsed > 0, parsed)


def when_at(text: Column) -> Column:
    """The instant of an ISO text; without a zone it is UTC (the session's); null for what is none."""
    return F.try_to_timestamp(text)


def half_even(value: Column, digits: int) -> Column:
    """Rounded to so many digits, ties to the even one."""
    return F.bround(value, digits)


def whole_text(value: Column) -> Column:
    """2 for 2.0, 2.5 for 2.5, empty for what is no number."""
    n = number(value)
    return F.when(n == F.floor(n), n.cast("decimal(38,0)").cast("string")).otherwise(F.coalesce(n.cast("string"), F.lit("")))


def first_filled(*values: Column) -> Column:
    """The first value that is neither null, empty nor 0."""
    return F.coalesce(*(F.when(~v.cast("string").isin("", "0", "0.0", "false"), v.cast("string")) for v in values))


def typed_hash(*fields: Column, digits: int = 64) -> Column:
    """SHA-256 of the fields as a JSON list: nulls, types and borders count."""
    return F.substring(F.sha2(F.to_json(F.struct(*(f.alias(f"f{i:02d}") for i, f in enumerate(fields))), {"ignoreNullFields": "false"}), 256), 1, digits)


def filled(*fields: Column) -> Column:
    """How many of the fields are neither null, empty nor 0."""
    each = [F.when(first_filled(f).isNotNull(), 1).otherwise(0) for f in fields]
    total = each[0]
    for e in each[1:]:
        total = total + e
    return total


def url_allowed(url: Column, hosts: list[str]) -> Column:
    """https on its usual port, without user information, on one of the hosts or a subdomain."""
    part = lambda name: F.try_parse_url(url, F.lit(name))
    host, authority = F.lower(part("HOST")), part("AUTHORITY")
    known = F.lit(False)
    for h in hosts:
        known = known | (host == h) | host.endswith("." + h)
    usual = ~authority.rlike(":[0-9]+$") | authority.endswith(":443")
    return F.coalesce((F.lower(part("PROTOCOL")) == "https") & part("USERINFO").isNull() & usual & known, F.lit(False))


def same_keys(found: Column, keys: list[str]) -> Column:
    """Whether a map has exactly these keys."""
    return F.coalesce(F.array_sort(F.map_keys(found)) == F.array(*map(F.lit, sorted(keys))), F.lit(False))
