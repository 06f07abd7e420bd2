"""Mixing sources to target weights: hierarchical budgeting over a domain-language-source tree, by SQL only.

The budget is a share of all tokens (words). It flows down the tree: at every node the children's needs are filled in
proportion to their weights, a child never above its capacity (its tokens times `max_epochs`). What a child cannot use
goes to its siblings first; only a wholly exhausted subtree leaves its shortage to its ancestors' other children. All
amounts are whole numbers; rounding leaves at most one token per child unspent.

A leaf's documents are dealt in epochs, each ordered by a seeded hash of epoch and doc_id. A leaf takes as many whole
epochs as its budget holds and, of the next, the longest prefix whose tokens fit. The prefix is found without sorting
a leaf: 4,096 hash buckets are summed per leaf, one bucket holds the cut, and only that bucket's rows are ordered.

Defined cases: a null source or language is a leaf of its own ("?"); so is the domain of a source without a number, or
with one beyond 32 bits. Null text has no tokens; documents without tokens cost nothing. Rows that repeat a doc_id with
equal token counts stand or fall together; ties of the seeded hash go to the smaller doc_id, a null id first. An empty
table gives an empty result. Weights not named count as 1. Columns of the input called leaf, n_tokens or copies are
replaced by the result's; all others stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastra.llm.common import materialise

SEED = "mix-1"
MAX_EPOCHS = 3
#: The share of all tokens that the mixture holds.
BUDGET = (9, 10)
DOMAIN_WEIGHTS = {"web": 4, "books": 3, "news": 2, "wiki": 1}
LANG_WEIGHTS = {"en": 6, "de": 3, "fr": 2, "es": 2}
BUCKET_HEX = 3
#: Plans of at most so many leaves are sent to all executors; larger ones are joined by a shuffle.
BROADCAST_LEAVES = 10_000

DOMAIN_SQL = "CASE TRY_CAST(regexp_extract(source, '([0-9]+)', 1) AS INT) % 4 WHEN 0 THEN 'web' WHEN 1 THEN 'books' WHEN 2 THEN 'news' WHEN 3 THEN 'wiki' END"


def _weights(column: str, weights: dict[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END"


def _fill(name: str, children: str, parents: str, on: str, divide: str) -> str:
    """CTEs that share each parent's budget among its children. children: parent, child, cap, w. parents: parent, budget."""
    return f"""
{name}_ranked AS (
    SELECT c.parent, c.child, c.cap, c.w, p.budget,
        SUM(c.cap) OVER (PARTITION BY c.parent ORDER BY c.cap * CAST(1.0 AS DOUBLE) / c.w, c.child ROWS UNBOUNDED PRECEDING) - c.cap AS before,
        SUM(c.w) OVER (PARTITION BY c.parent ORDER BY c.cap * CAST(1.0 AS DOUBLE) / c.w DESC, c.child DESC ROWS UNBOUNDED PRECEDING) AS rest
    FROM {children} c JOIN {parents} p ON p.{on} = c.parent),
{name}_full AS (SELECT *, CASE WHEN c.cap * c.rest <= c.w * (c.budget - c.before) THEN 1 ELSE 0 END AS sated FROM {name}_ranked c),
{name}_left AS (
    SELECT parent, MAX(budget) - SUM(CASE WHEN sated = 1 THEN cap ELSE 0 END) AS amount, SUM(CASE WHEN sated = 1 THEN 0 ELSE w END) AS weight
    FROM {name}_full GROUP BY parent),
{name} AS (
    SELECT f.child, CAST(CASE WHEN f.sated = 1 THEN f.cap ELSE {divide.format(a="f.w * l.amount", b="CASE WHEN l.weight = 0 THEN 1 ELSE l.weight END")} END AS BIGINT) AS budget
    FROM {name}_full f JOIN {name}_left l ON l.parent = f.parent)"""


_LEAVES_SQL = f"""SELECT domain, lang, source, tokens, tokens * {MAX_EPOCHS} AS cap, {_weights("lang", LANG_WEIGHTS)} AS lang_w, {_weights("domain", DOMAIN_WEIGHTS)} AS domain_w,
    concat(domain, '/', lang) AS branch, concat(domain, '/', lang, '/', source) AS leaf FROM {{leaves}}"""
_ROOT_SQL = "SELECT 'root' AS child, CAST({total} AS BIGINT) AS budget FROM {leaf}"
#: Children of each level, from the root down.
_LEVELS_SQL = [
    "SELECT 'root' AS parent, domain AS child, CAST(SUM(cap) AS BIGINT) AS cap, MAX(domain_w) AS w FROM {leaf} GROUP BY domain",
    "SELECT domain AS parent, branch AS child, CAST(SUM(cap) AS BIGINT) AS cap, MAX(lang_w) AS w FROM {leaf} GROUP BY domain, branch",
    "SELECT branch AS parent, leaf AS child, cap, 1 AS w FROM {leaf}",
]
_EPOCHS_SQL = """SELECT l.leaf, l.tokens, b.budget, CAST(CASE WHEN l.tokens = 0 THEN 0 ELSE {epochs} END AS BIGINT) AS epochs
FROM {leaf} l JOIN {by_source} b ON b.child = l.leaf"""


def plan_sql(leaves: str, divide: str) -> str:
    """Leaf budgets as one query. leaves: domain, lang, source, tokens; divide: whole-number division of {a} by {b}."""
    domains, branches, sources = (level.format(leaf="leaf") for level in _LEVELS_SQL)
    return f"""
WITH leaf AS ({_LEAVES_SQL.format(leaves=leaves)}),
root AS ({_ROOT_SQL.format(leaf="leaf", total=divide.format(a=f"SUM(tokens) * {BUDGET[0]}", b=str(BUDGET[1])))}),
domains AS ({domains}),
branches AS ({branches}),
sources AS ({sources}),
{_fill("by_domain", "domains", "root", "child", divide)},
{_fill("by_branch", "branches", "by_domain", "child", divide)},
{_fill("by_source", "sources", "by_branch", "child", divide)}
{_EPOCHS_SQL.format(leaf="leaf", by_source="by_source", epochs=divide.format(a="b.budget", b="CASE WHEN l.tokens = 0 THEN 1 ELSE l.tokens END"))}"""


def budgets(leaves: DataFrame) -> DataFrame:
    """leaf, tokens, budget, epochs (whole ones) of leaves: domain, lang, source, tokens. Each level of the tree is written once."""
    spark, divide = leaves.sparkSession, "({a}) div ({b})"
    leaf = materialise(spark.sql(_LEAVES_SQL.format(leaves="{leaves}"), leaves=leaves))
    above = spark.sql("SELECT * FROM (" + _ROOT_SQL.format(leaf="{leaf}", total=divide.format(a=f"SUM(tokens) * {BUDGET[0]}", b=str(BUDGET[1]))) + ")", leaf=leaf)
    for children in _LEVELS_SQL:
        level = spark.sql(children.format(leaf="{leaf}"), leaf=leaf)
        above = materialise(spark.sql("WITH " + _fill("filled", "{children}", "{parents}", "child", divide) + " SELECT child, budget FROM filled", children=level, parents=above))
    return spark.sql(_EPOCHS_SQL.format(leaf="{leaf}", by_source="{by_source}", epochs=divide.format(a="b.budget", b="CASE WHEN l.tokens = 0 THEN 1 ELSE l.tokens END")), leaf=leaf, by_source=above)


def _key(epochs: Column, doc_id: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(SEED), epochs.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("?"))), 256)


def mix(docs: DataFrame) -> DataFrame:
    """docs with leaf, n_tokens and copies (how often the mixture holds the row; 0: not at all) added."""
    named = docs.withColumns(
        {
            "__mix_domain": F.coalesce(F.expr(DOMAIN_SQL), F.lit("?")),
            "__mix_lang": F.coalesce("lang", F.lit("?")),
            "__mix_source": F.coalesce("source", F.lit("?")),
            "__mix_n": F.coalesce(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long"),
        }
    ).withColumn("__mix_leaf", F.concat_ws("/", "__mix_domain", "__mix_lang", "__mix_source"))
    counted = materialise(named.select("doc_id", *(F.col(f"__mix_{c}").alias(c) for c in ("domain", "lang", "source", "leaf", "n"))))
    leaves = counted.groupBy("domain", "lang", "source").agg(F.sum("n").alias("tokens"))
    plan = materialise(budgets(leaves).select("leaf", "epochs", (F.col("budget") - F.col("epochs") * F.col("tokens")).alias("spare")))
    few = plan.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES

    def sent(small: DataFrame) -> DataFrame:
        return F.broadcast(small) if few else small

    no_id = F.coalesce("doc_id", F.lit(-(2**63)))
    ordered = counted.select("doc_id", "n", "leaf").join(sent(plan), "leaf").withColumn("key", _key(F.col("epochs"), F.col("doc_id")))
    ordered = ordered.withColumn("bucket", F.substring("key", 1, BUCKET_HEX))
    sums = ordered.groupBy("leaf", "bucket", "spare").agg(F.sum("n").alias("tokens"))
    running = sums.withColumn("upto", F.sum("tokens").over(Window.partitionBy("leaf").orderBy("bucket")))
    at = materialise(running.filter(F.col("upto") > F.col("spare")).groupBy("leaf").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("tokens")).alias("before"))).alias("at")).select("leaf", "at.*"))
    inside = ordered.join(sent(at), ["leaf", "bucket"]).withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("leaf").orderBy("key", no_id, "n")))
    cuts = inside.filter(F.col("upto") <= F.col("spare")).groupBy("leaf").agg(F.max(F.struct("key", no_id.alias("id"), "n")).alias("cut"))
    limits = plan.join(at.select("leaf", F.col("bucket").alias("at_bucket")), "leaf", "left").join(cuts, "leaf", "left")
    limits = materialise(limits.select(F.col("leaf").alias("__mix_leaf"), F.struct("epochs", "at_bucket", "cut").alias("__mix")))
    epochs, at_bucket, cut = (F.col(f"__mix.{c}") for c in ("epochs", "at_bucket", "cut"))
    key = _key(epochs, F.col("doc_id"))
    mine = F.struct(key.alias("key"), no_id.alias("id"), F.col("__mix_n").alias("n"))
    taken = at_bucket.isNull() | (F.substring(key, 1, BUCKET_HEX) < at_bucket) | F.coalesce(mine <= cut, F.lit(False))
    dealt = named.join(sent(limits), "__mix_leaf").withColumn("__mix_copies", epochs + taken.cast("long"))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("leaf", "n_tokens", "copies")]
    return dealt.select(*kept, F.col("__mix_leaf").alias("leaf"), F.col("__mix_n").alias("n_tokens"), F.col("__mix_copies").alias("copies"))


ORACLE_TEMPLATE = f"""
WITH named AS (
    SELECT *, coalesce({DOMAIN_SQL}, '?') AS domain_, coalesce(lang, '?') AS lang_, coalesce(source, '?') AS source_,
        CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens
    FROM {{docs}}),
leaves AS (SELECT domain_ AS domain, lang_ AS lang, source_ AS source, CAST(SUM(n_tokens) AS BIGINT) AS tokens FROM named GROUP BY ALL),
plan AS ({plan_sql("leaves", "({a}) // ({b})")}),
dealt AS (
    SELECT n.*, p.leaf, p.epochs, p.budget - p.epochs * p.tokens AS spare,
        SUM(n.n_tokens) OVER (PARTITION BY p.leaf ORDER BY sha256(concat('{SEED}:', p.epochs, ':', n.doc_id)), n.doc_id, n.n_tokens) AS upto
    FROM named n JOIN plan p ON p.leaf = concat(n.domain_, '/', n.lang_, '/', n.source_))
"""

ORACLE = ORACLE_TEMPLATE.format(docs="documents") + "SELECT doc_id, leaf, n_tokens, CAST(epochs + CASE WHEN upto <= spare THEN 1 ELSE 0 END AS BIGINT) AS copies FROM dealt"
