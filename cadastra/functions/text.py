"""Text and hash expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalised(text: Column) -> Column:
    """Trimmed, lower-cased, white space collapsed; null becomes empty."""
    return F.regexp_replace(F.trim(F.lower(F.coalesce(text, F.lit("")))), "(?U)\\s+", " ")


def float_text(value: Column) -> Column:
    """A double as JSON writers of other languages have it: 60.0, 1e-05, 1e+16, 12345678.0; NaN and infinities by name."""
    text = F.abs(value).cast("string")
    sign = F.when((value < 0) | value.cast("string").startswith("-"), "-").otherwise("")
    digits = F.regexp_replace(F.concat(F.regexp_extract(text, r"^([0-9])\.[0-9]+E", 1), F.regexp_extract(text, r"^[0-9]\.([0-9]+)E", 1)), "(?<=.)0+$", "")
    power = F.regexp_extract(text, r"E(-?[0-9]+)$", 1).try_cast("int")
    n = F.length(digits)
    whole = F.concat(F.rpad(digits, power + 1, "0"), F.lit(".0"))
    mixed = F.concat(F.substr(digits, F.lit(1), power + 1), F.lit("."), F.substr(digits, power + 2, n))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    mantissa = F.when(n == 1, digits).otherwise(F.concat(F.substr(digits, F.lit(1), F.lit(1)), F.lit("."), F.substr(digits, F.lit(2), n)))
    scientific = F.concat(mantissa, F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), "0"))
    # plain down to 0.001 and below 1e7; Spark writes all others by a power
    by_power = F.when((power >= 16) | (power < -4), scientific).when(power < 0, small).when(n <= power + 1, whole).otherwise(mixed)
    named = F.when(F.isnan(value), "NaN").when(F.abs(value) == float("inf"), F.concat(sign, F.lit("Infinity")))
    return F.coalesce(named, F.concat(sign, F.when(power.isNull(), text).otherwise(by_power)))


def json_text(text: Column) -> Column:
    """A string as JSON: quotes, backslashes and control characters escaped (in lower case), all else as it is."""
    quick = F.to_json(F.struct(text.alias("v")))
    quick = F.substr(quick, F.lit(6), F.length(quick) - 6)
    # Spark writes these few with capitals
    slow = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for code in range(32):
        short = {8: "b", 9: "t", 10: "n", 12: "f", 13: "r"}.get(code)
        slow = F.replace(slow, F.lit(chr(code)), F.lit("\\" + (short or f"u{code:04x}")))
    return F.when(text.rlike("[\\x0b\\x0e\\x0f\\x1a-\\x1f]"), F.concat(F.lit('"'), slow, F.lit('"'))).when(text.isNotNull(), quick)


def json_value(value: Column, kind: str = "string") -> Column:
    """A value of a Spark type by its simple name as JSON; null is null, what has no JSON form is its text."""
    if kind in ("double", "float"):
        text = float_text(value.cast("double"))
    elif kind in ("tinyint", "smallint", "int", "bigint", "boolean"):
        text = value.cast("string")
    else:
        text = json_text(value.cast("string"))
    return F.coalesce(text, F.lit("null"))


def canonical_json(*fields: Column | tuple[Column, str]) -> Column:
    """The fields as a JSON list without blanks: types, nulls and borders count. A field without a type is a string."""
    pairs = [f if isinstance(f, tuple) else (f, "string") for f in fields]
    return F.concat(F.lit("["), F.concat_ws(",", *(json_value(*p) for p in pairs)), F.lit("]"))


def typed(df: DataFrame, *names: str) -> list[tuple[Column, str]]:
    """Columns with their types; null where df has none of that name."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return [(F.col(n), kinds[n]) if n in kinds else (F.lit(None).cast("string"), "string") for n in names]


def content_hash(*fields: Column | tuple[Column, str], digits: int = 16) -> Column:
    """First hex digits of the SHA-256 of the fields' canonical JSON: that of any evaluator that hashes the same list."""
    return F.substring(F.sha2(canonical_json(*fields), 256), 1, digits)


def set_hash(items: Column) -> Column:
    """Order-free SHA-256 of a string array; null if it is empty."""
    return F.when(F.size(items) > 0, F.sha2(F.array_join(F.array_sort(items), "|"), 256))


def head_tail(text: Column, limit: int = 1900, mark: str = " […] ") -> Column:
    """Of longer texts two thirds of the limit from the start and the rest of it from the end, with a mark between."""
    head = limit * 2 // 3
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, head), F.lit(mark), F.right(text, F.lit(limit - head)))).otherwise(text)


def claims(text: Column, patterns: dict[str, str]) -> Column:
    """Sorted codes of the patterns that match."""
    return F.array_sort(F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(code)) for code, p in sorted(patterns.items())))))


def unnegated(text: Column, pattern: str, negation: str, reach: int = 20) -> Column:
    """True if the pattern's first match has no negation right before it, within so many code points. Later matches are not looked at."""
    before = F.right(F.regexp_extract(text, f"(?s)^(.*?)(?:{pattern})", 1), F.lit(reach))
    return F.coalesce(text.rlike(pattern) & ~before.rlike(f"(?:{negation})$"), F.lit(False))


def family_conflict(codes: Column, family: list[str]) -> Column:
    """The codes of a family whose members exclude one another, if there are two or more; else an empty array."""
    found = F.array_sort(F.array_intersect(codes, F.array(*map(F.lit, family))))
    return F.when(F.size(found) > 1, found).otherwise(F.array().cast("array<string>"))
