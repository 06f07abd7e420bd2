"""Registered queries of merges in order, aliases, splits, manual decisions and the run log, over the given tables.

Copies of one text are listings that somebody said to be one home, each with the copy before it, so decisions form chains.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastra.operators import decisions as D
from cadastra.operators import graph
from cadastra.operators import history as H
from cadastra.operators import merging as M
from cadastra.plans.catalogue import _t, query
from cadastra.plans.cycle import made, sql

#: Documents as listings; those of one source, language and length class begin as one entity.
LISTED = "SELECT CAST(doc_id AS STRING) AS listing, concat_ws('-', source, lang, CAST(n_chars % 40 AS STRING)) AS entity, concat('2024-01-', lpad(CAST(1 + n_chars % 28 AS STRING), 2, '0')) AS day FROM {documents}"
HELD = f"SELECT listing, entity, min(day) OVER (PARTITION BY entity) AS created_at FROM ({LISTED}) l"
#: Each copy of a text with the copy before it, the later documents first; lengths decide what was said of them.
COPIES = "SELECT CAST(0 - doc_id AS BIGINT) AS place, CAST(doc_id AS STRING) AS a, CAST(before AS STRING) AS b, concat('r', CAST(n_chars % 3 AS STRING)) AS revision, CASE WHEN n_chars % 5 = 0 THEN 'different_entity' ELSE 'same_entity' END AS decision FROM (SELECT doc_id, n_chars, lag(doc_id) OVER (PARTITION BY text ORDER BY doc_id) AS before FROM {documents}) c WHERE before IS NOT NULL"


def _in_order(decisions: str, prefix: str = "") -> str:
    """One decision after another: of each step, where all entities are after it, and what it did."""
    return f"""held AS ({sql(HELD)}), asked AS (SELECT *, row_number() OVER (ORDER BY place) AS k FROM ({decisions})),
firsts AS (SELECT entity, count(*) AS n, min(created_at) AS since FROM held GROUP BY entity),
walk(k, first, last, n, since, absorbed, survivor, moved) AS (
    SELECT CAST(0 AS BIGINT), entity, entity, n, since, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT) FROM firsts
    UNION ALL
    SELECT w.k + 1, w.first, CASE WHEN w.last = p.absorbed THEN p.survivor ELSE w.last END, w.n, w.since, p.absorbed, p.survivor, p.moved
    FROM walk w JOIN (
        SELECT d.k, CASE WHEN x.last = y.last THEN NULL WHEN x.first_one THEN y.last ELSE x.last END AS absorbed, CASE WHEN x.last = y.last THEN NULL WHEN x.first_one THEN x.last ELSE y.last END AS survivor,
            CASE WHEN x.last = y.last THEN NULL WHEN x.first_one THEN y.total ELSE x.total END AS moved
        FROM (SELECT d.k, d.a, d.b FROM asked d) d
        JOIN (SELECT w.k, h.listing, w.last, t.total, t.born FROM walk w JOIN held h ON h.entity = w.first JOIN (SELECT last, CAST(sum(n) AS BIGINT) AS total, min(CASE WHEN first = last THEN since END) AS born FROM walk GROUP BY last) t ON t.last = w.last) l ON l.listing = d.a AND l.k = d.k - 1
        JOIN (SELECT h.listing, w.last, t.total, t.born FROM walk w JOIN held h ON h.entity = w.first JOIN (SELECT last, CAST(sum(n) AS BIGINT) AS total, min(CASE WHEN first = last THEN since END) AS born FROM walk GROUP BY last) t ON t.last = w.last) y ON y.listing = d.b
        JOIN LATERAL (SELECT l.last AS last, l.total AS total, (l.total > y.total OR (l.total = y.total AND (l.born < y.born OR (l.born = y.born AND l.last < y.last)))) AS first_one) x ON true
    ) p ON p.k = w.k + 1),
steps AS (SELECT DISTINCT d.place, d.k, w.absorbed, w.survivor, coalesce(w.moved, 0) AS moved, concat_ws(':', 'merge', w.survivor, w.absorbed, '{prefix}' || d.revision) AS key FROM walk w JOIN asked d ON d.k = w.k)"""


def _chains(spark, d):
    held = made(spark, d, HELD)
    return held, M.merge_steps(held, made(spark, d, COPIES), spark.createDataFrame([], "key string"))


@query(f"WITH RECURSIVE {_in_order(sql(COPIES))} SELECT place, absorbed, survivor, moved, key FROM steps WHERE absorbed IS NOT NULL")
def merge_chains(spark, d):
    """Chains of decisions: who took in whom, with each decision's own revision in its key."""
    return M.merged(_chains(spark, d)[1])


@query(f"WITH RECURSIVE {_in_order(sql(COPIES))} SELECT h.listing, w.last AS entity FROM held h JOIN walk w ON w.first = h.entity AND w.k = (SELECT max(k) FROM asked)")
def merge_chain_members(spark, d):
    """Where every listing is after the chains: in a living entity, which all aliases lead to."""
    held, steps = _chains(spark, d)
    return M.members_after(held, steps).select("listing", "entity")


@query(f"WITH RECURSIVE {_in_order(sql(COPIES))} SELECT s.absorbed AS old, w.last AS survivor FROM steps s JOIN walk w ON w.first = s.absorbed AND w.k = (SELECT max(k) FROM asked) WHERE s.absorbed IS NOT NULL")
def merge_chain_aliases(spark, d):
    """Every absorbed entity's alias, followed to its end."""
    steps = _chains(spark, d)[1]
    return graph.resolved(M.aliases_after(spark.createDataFrame([], "old string, survivor string"), steps))


@query("WITH RECURSIVE e AS (SELECT l_orderkey AS x, min(l_partkey) AS y FROM lineitem WHERE l_returnflag = 'R' AND l_quantity < 4 GROUP BY 1), b AS (SELECT 'o' || x AS x, 'p' || y AS y FROM e UNION SELECT 'p' || y, 'o' || x FROM e), r(x, y) AS (SELECT x, x FROM b UNION SELECT r.x, b.y FROM r JOIN b ON b.x = r.y) SELECT x AS node, min(y) AS component FROM r GROUP BY x")
def link_components(spark, d):
    """Components of orders and the parts that came back in small numbers."""
    back = _t(spark, d, "lineitem").filter("l_returnflag = 'R' and l_quantity < 4").groupBy("l_orderkey").agg(F.min("l_partkey").alias("p"))
    return graph.components(back.select(F.concat(F.lit("o"), "l_orderkey").alias("x"), F.concat(F.lit("p"), "p").alias("y")))


# --- splits ------------------------------------------------------------------------------------------------------

ORDERED = "SELECT CAST(o_orderkey AS STRING) AS listing, CAST(o_custkey AS STRING) AS entity, o_orderkey AS k, o_custkey AS c, o_orderpriority AS priority, o_orderstatus AS state FROM {orders}"
#: A customer's splits: urgent orders, the same again, then finished ones, asked for by an older name.
_SPLITS = "SELECT c * 10 + 1 AS place, entity, collect_list(listing) AS listings FROM {m} WHERE priority = '1-URGENT' GROUP BY c, entity UNION ALL SELECT c * 10 + 2, entity, collect_list(listing) FROM {m} WHERE priority = '1-URGENT' GROUP BY c, entity UNION ALL SELECT c * 10 + 3, concat('old', entity), collect_list(listing) FROM {m} WHERE state = 'F' GROUP BY c, entity"
_SPLIT_SQL = f"""m AS ({sql(ORDERED)}),
e AS (SELECT c, entity, count(*) AS n, count(*) FILTER (priority = '1-URGENT') AS urgent, count(*) FILTER (state = 'F') AS done, count(*) FILTER (state = 'F' AND priority = '1-URGENT') AS shared,
    to_json(list(listing ORDER BY listing) FILTER (priority = '1-URGENT')) AS urgent_ids, to_json(list(listing ORDER BY listing) FILTER (state = 'F')) AS done_ids FROM m GROUP BY ALL),
s AS (SELECT *, urgent BETWEEN 1 AND n - 1 AS first, done BETWEEN 1 AND n - CASE WHEN urgent < n THEN urgent ELSE 0 END - 1 AND (shared = 0 OR urgent = n OR urgent = 0) AS third, urgent > 0 AND done > 0 AND urgent_ids = done_ids AS alike FROM e)"""


def _splits(spark, d):
    made(spark, d, ORDERED).createOrReplaceTempView("cadastra_split_listings")
    asked = spark.sql(_SPLITS.replace("{m}", "cadastra_split_listings")).withColumn("revision", F.lit("r1"))
    held = made(spark, d, ORDERED)
    aliases = held.select(F.concat(F.lit("old"), "entity").alias("old"), F.col("entity").alias("survivor")).distinct()
    return held, aliases, M.split_steps(held.select("listing", "entity"), aliases, asked, spark.createDataFrame([], "key string, child string"))


@query(f"""WITH {_SPLIT_SQL}
SELECT c * 10 + 1 AS place, entity AS parent, CASE WHEN first THEN 'split' ELSE 'invalid' END AS outcome, sha256(urgent_ids) AS moved_hash FROM s WHERE urgent > 0
UNION ALL SELECT c * 10 + 2, entity, 'repeated', sha256(urgent_ids) FROM s WHERE urgent > 0
UNION ALL SELECT c * 10 + 3, entity, CASE WHEN alike THEN 'repeated' WHEN third THEN 'split' ELSE 'invalid' END, sha256(done_ids) FROM s WHERE done > 0""")
def split_repeated(spark, d):
    """Several splits of one entity in order: each on what the earlier left, a used key changes nothing."""
    return _splits(spark, d)[2].select("place", "parent", "outcome", "moved_hash")


@query(f"""WITH {_SPLIT_SQL}, a AS (SELECT m.c, m.k % 4 AS q, count(*) AS n, count(*) FILTER (s.first AND priority = '1-URGENT') AS u, count(*) FILTER (s.third AND NOT s.alike AND state = 'F') AS f, count(*) FILTER ((s.first AND priority = '1-URGENT') OR (s.third AND NOT s.alike AND state = 'F')) AS moved FROM m JOIN s ON s.c = m.c GROUP BY ALL)
SELECT concat('was', c, '/', q) AS old, CASE WHEN moved > 0 AND NOT (moved = n AND (u = 0 OR f = 0)) THEN 'split_ambiguous' ELSE 'merged' END AS lifecycle, moved = n AND (u = 0 OR f = 0) AS redirected FROM a""")
def split_aliases(spark, d):
    """Names of old, a quarter of a customer's orders each: redirected if all moved to one child, dropped if some moved."""
    held, own, steps = _splits(spark, d)
    old = F.concat(F.lit("was"), "entity", F.lit("/"), (F.col("k") % 4).cast("string"))
    history = held.select("listing", old.alias("entity"))
    aliases = held.select(old.alias("old"), F.col("entity").alias("survivor")).distinct()
    out = M.split_aliases(aliases, history, steps)
    return out.select("old", "lifecycle", F.coalesce(F.col("survivor").startswith("ent_"), F.lit(False)).alias("redirected"))


# --- manual decisions --------------------------------------------------------------------------------------------

_ASKED = "SELECT place, least(a, b) AS low, greatest(a, b) AS high, a, b, revision, decision FROM ({copies}) c"
_SAME = f"SELECT d.place, least(d.a, d.b) AS a, greatest(d.a, d.b) AS b, d.revision FROM ({sql(COPIES)}) d JOIN ({sql(HELD)}) x ON x.listing = d.a JOIN ({sql(HELD)}) y ON y.listing = d.b WHERE d.decision = 'same_entity'"


def _manual(spark, d):
    asked = made(spark, d, COPIES).withColumns({"reason": F.lit("seen"), "actor": F.lit("me")})
    held = made(spark, d, HELD)
    none = spark.createDataFrame([], "key string")
    judged = D.manual(asked, held, none)
    pairs = judged.select("low", "high", F.lit("awaiting_photo_analysis").alias("status"))
    overrides = pairs.filter("low < '5'").select("low", "high", F.lit("different_entity").alias("decision"), F.lit("r0").alias("revision"))
    return judged, M.apply_manual(judged, held, none, overrides, pairs)


@query(f"""WITH RECURSIVE {_in_order(_SAME, 'manual:')}, q AS (SELECT d.*, least(a, b) AS low, greatest(a, b) AS high FROM ({sql(COPIES)}) d),
j AS (SELECT q.*, q.decision = 'same_entity' OR x.entity <> y.entity AS applied FROM q JOIN held x ON x.listing = q.low JOIN held y ON y.listing = q.high)
SELECT j.low, j.high, CASE WHEN NOT applied THEN 'awaiting_photo_analysis' WHEN decision = 'same_entity' THEN 'manual_linked' ELSE 'manual_not_link' END AS status, w.last AS entity
FROM j JOIN held h ON h.listing = j.low JOIN walk w ON w.first = h.entity AND w.k = (SELECT max(k) FROM asked)""")
def manual_applied(spark, d):
    """Pairs after manual decisions: their status, and the entity that the first side is in once all merges were made."""
    out = _manual(spark, d)[1]
    of = out["members"].select(F.col("listing").alias("low"), "entity")
    return out["candidates"].join(of, "low").select("low", "high", "status", "entity")


@query(f"""WITH held AS ({sql(HELD)}), q AS (SELECT d.*, least(a, b) AS low, greatest(a, b) AS high FROM ({sql(COPIES)}) d),
j AS (SELECT q.*, q.decision = 'same_entity' OR x.entity <> y.entity AS applied FROM q JOIN held x ON x.listing = q.low JOIN held y ON y.listing = q.high)
SELECT low, high, CASE WHEN applied THEN decision ELSE 'different_entity' END AS decision, CASE WHEN applied THEN revision ELSE 'r0' END AS revision FROM j WHERE applied OR low < '5'""")
def manual_overrides(spark, d):
    """The last decision of each pair, in place of older ones."""
    return _manual(spark, d)[1]["overrides"]
