"""URL filters: rules first, then a path-template tree judged by smoothed purity, by SQL expressions only.

Every url gives a host and a path. Rules (host suffix and path prefix) decide where they fit, the longest first. The
other urls are judged by the tree: per host, a path's segments become a template, in which segments that vary (digits,
long hexadecimal strings, and segments under a prefix that has many children of few urls each) are wildcards. Urls
that the rules decide label the tree's leaves. Sibling branches whose share of allowed urls does not differ from
their parent's pool by a two-sided test are merged into that pool, others stand alone. A leaf's purity is its branch's
share of allowed labels, smoothed towards the same template's share over all hosts, and that towards the share of all.
Templates of a purity below `MIN_PURITY` are blocked.

Only distinct (host, template) rows with their counts are grouped and joined; the urls are read, counted and judged by
one join with the judged templates.

Defined cases: a url that is null or has no `://` has an empty host and path and is judged as such a template. Without
any label all urls are allowed. Rules of equal length go by their text, the later first. A purity of exactly
`MIN_PURITY` is allowed. Repeated rows count each. Paths may have any number of segments. An empty table gives an empty
result. Columns of the input called host, path, rule, verdict, template or purity are replaced by the result's; all
others stay as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.llm.common import materialise

#: The contract's rules: (rule, verdict).
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
MANY_CHILDREN = 20
FEW_URLS = 3
SMOOTHING = 5
MIN_PURITY = 0.5
Z = 2.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct of the longest rule that fits, and its verdict; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        on, _, start = rule.partition("/")
        fits = ((host == on) | host.endswith("." + on)) & path.startswith("/" + start)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def segments_of(path: Column) -> Column:
    """All segments, lexically generalised: digits become #, long hexadecimal strings and what follows *."""
    plain = F.split(F.substring(path, 2, 2**31 - 1), "/")
    return F.transform(plain, lambda s: F.regexp_replace(F.regexp_replace(s, "^[0-9a-fA-F-]{16,}$", "*"), "[0-9]+", "#"))


def _generalise(shapes: DataFrame) -> DataFrame:
    """shapes (host, segments, n, labelled, allowed) with template: segments where variable ones became *.

    Level by level, until no prefix has more than MANY_CHILDREN shapes that go on: below such a prefix nothing can vary.
    """
    open_, closed, depth = shapes.withColumn("template", F.lit("")), [], 0
    while True:
        segment = F.get("segments", F.lit(depth))
        children = open_.withColumn("segment", segment).filter("segment is not null").groupBy("host", "template", "segment").agg(F.sum("n").alias("urls"), F.count("*").alias("shapes"))
        going = children.groupBy("host", "template").agg(F.count("*").alias("children"), F.sum("urls").alias("urls"), F.sum("shapes").alias("shapes")).filter(F.col("shapes") > MANY_CHILDREN)
        going = going.select("host", "template", ((F.col("children") > MANY_CHILDREN) & (F.col("urls") < F.col("children") * FEW_URLS)).alias("varies"))
        goes_on = F.col("varies").isNotNull() & segment.isNotNull()
        rest = F.array_join(F.transform(F.slice("segments", depth + 1, F.greatest(F.size("segments") - depth, F.lit(0))), lambda s: F.concat(F.lit("/"), s)), "")
        following = F.when(goes_on, F.concat("template", F.lit("/"), F.when(F.col("varies"), F.lit("*")).otherwise(segment))).otherwise(F.concat("template", rest))
        step = materialise(open_.join(going, ["host", "template"], "left").withColumns({"goes_on": goes_on, "template": following}).drop("varies"))
        closed.append(step.filter("not goes_on").select(*shapes.columns, "template"))
        open_, depth = step.filter("goes_on").select(*shapes.columns, "template"), depth + 1
        if open_.isEmpty():
            return reduce(DataFrame.union, closed)


def judge(urls: DataFrame, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """Every row of urls (column url) with host, path, rule, verdict, and template and purity of its branch, added."""
    rules = RULES if rules is None else rules
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    named = urls.withColumns({"__url_host": host, "__url_path": path}).withColumns({"__url_rule": rule_of(F.col("__url_host"), F.col("__url_path"), rules), "__url_segments": segments_of(F.col("__url_path"))})
    shapes = named.groupBy(F.col("__url_host").alias("host"), F.col("__url_segments").alias("segments")).agg(
        F.count("*").alias("n"), F.count("__url_rule").alias("labelled"), F.count_if(F.col("__url_rule.verdict") == "allow").alias("allowed")
    )
    shapes = materialise(shapes)
    leaves = _generalise(shapes)
    branch = leaves.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("allowed").alias("allowed"))
    branch = branch.withColumn("parent", F.regexp_replace("template", "/[^/]*$", ""))
    pool = branch.groupBy("host", "parent").agg(F.sum("labelled").alias("pool_n"), F.sum("allowed").alias("pool_a"))
    everywhere = branch.groupBy("template").agg(F.sum("labelled").alias("all_n"), F.sum("allowed").alias("all_a"))
    base = shapes.agg((F.coalesce(F.sum("allowed"), F.lit(0)) + 1) / (F.coalesce(F.sum("labelled"), F.lit(0)) + 1)).first()[0]
    p = (F.col("pool_a") + 1) / (F.col("pool_n") + 2)
    gap = F.col("allowed") - F.col("labelled") * p
    apart = gap * gap > Z * Z * F.col("labelled") * p * (1 - p)
    n, a = F.when(apart, F.col("labelled")).otherwise(F.col("pool_n")), F.when(apart, F.col("allowed")).otherwise(F.col("pool_a"))
    prior = (F.col("all_a") + SMOOTHING * base) / (F.col("all_n") + SMOOTHING)
    judged = (
        branch.join(pool, ["host", "parent"]).join(everywhere, "template")
        .select("host", "template", ((a + SMOOTHING * prior) / (n + SMOOTHING)).alias("purity"))
    )
    # as a table, so that Spark can split the urls of a frequent shape in the last join
    by_shape = materialise(
        leaves.join(judged, ["host", "template"]).select(*(F.col(c).alias(f"__url_{c}") for c in ("host", "segments", "template", "purity")))
    )
    verdict = F.coalesce("__url_rule.verdict", F.when(F.col("__url_purity") < MIN_PURITY, F.lit("block")).otherwise(F.lit("allow")))
    made = {"host": F.col("__url_host"), "path": F.col("__url_path"), "rule": F.col("__url_rule.rule"), "verdict": verdict, "template": F.col("__url_template"), "purity": F.col("__url_purity")}
    kept = [F.col(f"`{c}`") for c in urls.columns if c not in made]
    return named.join(by_shape, ["__url_host", "__url_segments"]).select(*kept, *(column.alias(name) for name, column in made.items()))
