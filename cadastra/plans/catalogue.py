"""All registered queries of the library's own operators, with their SQL twins.

The listing concepts are mapped onto the given tables: parts are listings with structure (brand as complex, size as
floor, type as rooms), order lines are a listing's episodes, events are presence and price logs, documents are listing
texts and labels their verdicts, pages hold photo urls, embeddings hold image fingerprints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadastra.functions import text as X
from cadastra.operators import candidates as C
from cadastra.operators import graph
from cadastra.operators import history as H
from cadastra.operators import verdicts as V
from cadastra.streaming import ingest

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(fn):
        if fn.__name__ in QUERIES:
            raise ValueError(f"query {fn.__name__} is registered twice")
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def _json(column: str) -> str:
    """SQL of a text as a JSON string."""
    text = column
    for plain, short in (("chr(92)", "chr(92)"), ("'\"'", "'\"'"), ("chr(10)", "'n'"), ("chr(9)", "'t'"), ("chr(13)", "'r'"), ("chr(12)", "'f'"), ("chr(8)", "'b'")):
        text = f"replace({text}, {plain}, chr(92) || {short})"
    return f"coalesce('\"' || {text} || '\"', 'null')"


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- candidate pairs ---------------------------------------------------------------------------------------------

_LISTING = "SELECT p_partkey AS id, CAST(p_size AS INT) AS floor, split_part(p_type, ' ', 1) AS rooms, p_retailprice AS area, p_retailprice AS price, p_brand, p_type, p_size, p_name, p_partkey % 3 <> 0 AS active FROM part"
_PAIRS = f"""
WITH listing AS ({_LISTING}),
blocks AS (
    SELECT id, 'complex' AS reason, concat(p_brand, '|', p_size) AS k FROM listing
    UNION SELECT id, 'address', concat(p_type, '|', p_size) FROM listing
    UNION SELECT id, 'coordinates', p_type FROM listing),
kept AS (SELECT * FROM blocks WHERE (reason, k) IN (SELECT (reason, k) FROM blocks GROUP BY reason, k HAVING count(*) BETWEEN 2 AND 100)),
pairs AS (SELECT a.id AS low, b.id AS high, string_agg(DISTINCT a.reason, ',' ORDER BY a.reason) AS reasons, count(DISTINCT a.reason) AS n_reasons FROM kept a JOIN kept b ON a.reason = b.reason AND a.k = b.k AND a.id < b.id GROUP BY a.id, b.id),
sides AS (SELECT p.*, a.active AND b.active AS both_active, a.rooms <> b.rooms AS c_rooms, a.floor <> b.floor AS c_floor, abs(a.area - b.area) > greatest(a.area, b.area) * 0.1 AS c_area
    FROM pairs p JOIN listing a ON a.id = p.low JOIN listing b ON b.id = p.high),
judged AS (SELECT *, concat_ws(',', CASE WHEN c_area THEN 'area' END, CASE WHEN c_floor THEN 'floor' END, CASE WHEN c_rooms THEN 'rooms' END) AS conflicts,
    CASE WHEN n_reasons >= 3 THEN 80 WHEN n_reasons = 2 THEN 60 ELSE 30 END + CASE WHEN both_active THEN 5 ELSE 0 END AS priority FROM sides),
states AS (SELECT *, CASE WHEN (low + high) % 97 = 0 THEN 'manual_linked' WHEN (low + high) % 89 = 0 THEN 'manual_not_link' WHEN (low * 7 + high) % 53 = 0 THEN 'photo_evidence_ready' WHEN conflicts <> '' THEN 'metadata_conflict' ELSE 'awaiting_photo_analysis' END AS status FROM judged)
"""


def _listings(spark, d):
    p = _t(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_size").cast("int").alias("floor"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("rooms"), F.col("p_retailprice").alias("area"), "p_brand", "p_type", "p_size", (F.col("p_partkey") % 3 != 0).alias("active")
    )


def _pairs(spark, d):
    rows = _listings(spark, d)
    keys = {"complex": F.concat_ws("|", "p_brand", "p_size"), "address": F.concat_ws("|", "p_type", "p_size"), "coordinates": F.col("p_type")}
    return rows, C.candidate_pairs(rows, keys)


def _states(spark, d):
    rows, pairs = _pairs(spark, d)
    both = F.col("a.active") & F.col("b.active")
    low, high = F.col("low"), F.col("high")
    override = F.when((low + high) % 97 == 0, "same_entity").when((low + high) % 89 == 0, "different_entity")
    judged = C.with_sides(pairs, rows.drop("p_brand", "p_type", "p_size")).withColumns({"conflicts": C.conflicts(), "priority": C.priority(F.col("reasons"), both, F.lit(False))})
    return judged.withColumn("status", C.status(override, (low * 7 + high) % 53 == 0, F.col("conflicts"))).withColumns({"reasons": F.array_join("reasons", ","), "conflicts": F.array_join("conflicts", ",")}).drop("a", "b")


@query(_PAIRS + "SELECT low, high, reasons FROM pairs")
def blocking_pairs(spark, d):
    return _pairs(spark, d)[1].withColumn("reasons", F.array_join("reasons", ","))


@query(_PAIRS + "SELECT low, high, conflicts FROM judged")
def pair_conflicts(spark, d):
    return _states(spark, d).select("low", "high", "conflicts")


@query(_PAIRS + "SELECT low, high, reasons, conflicts, CAST(priority AS INT) AS priority, status FROM states")
def candidate_status(spark, d):
    return _states(spark, d).select("low", "high", "reasons", "conflicts", "priority", "status")


@query(_PAIRS + "SELECT status, count(*) AS pairs, max(priority) AS top_priority FROM states GROUP BY status")
def candidate_summary(spark, d):
    return _states(spark, d).groupBy("status").agg(F.count("*").alias("pairs"), F.max("priority").alias("top_priority"))


@query(_PAIRS + "SELECT low, high, priority, status FROM states WHERE status = 'awaiting_photo_analysis' AND priority >= 35 ORDER BY priority DESC, low, high LIMIT 200")
def review_queue_page(spark, d):
    return _states(spark, d).filter("status = 'awaiting_photo_analysis' and priority >= 35").orderBy(F.desc("priority"), "low", "high").select("low", "high", "priority", "status").limit(200)


@query(_PAIRS + "SELECT low, high, sha256(concat_ws('|', low, high, reasons, conflicts, priority)) AS revision FROM judged")
def pair_revision_hash(spark, d):
    return _states(spark, d).select("low", "high", F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in ("low", "high", "reasons", "conflicts", "priority"))), 256).alias("revision"))


@query(_PAIRS + "SELECT status, low, high FROM (SELECT *, row_number() OVER (PARTITION BY status ORDER BY sha256(concat(low, '|', high)), low, high) AS rn FROM states) WHERE rn <= CASE status WHEN 'awaiting_photo_analysis' THEN 50 WHEN 'metadata_conflict' THEN 30 WHEN 'photo_evidence_ready' THEN 20 ELSE 0 END")
def stratified_sample(spark, d):
    rows = _states(spark, d).withColumn("revision", F.sha2(F.concat_ws("|", F.col("low").cast("string"), F.col("high").cast("string")), 256))
    shares = C.largest_remainder(100, [50, 30, 20])
    return C.stratified(rows, "status", "revision", dict(zip(("awaiting_photo_analysis", "metadata_conflict", "photo_evidence_ready"), shares))).select("status", "low", "high")


@query(_PAIRS + "SELECT count(*) AS nodes, max(n) AS max_degree, count(*) FILTER (n >= 10) AS busy FROM (SELECT id, count(*) AS n FROM (SELECT low AS id FROM pairs UNION ALL SELECT high FROM pairs) GROUP BY id)")
def pair_graph_degree(spark, d):
    pairs = _pairs(spark, d)[1]
    degree = pairs.select(F.col("low").alias("id")).unionAll(pairs.select("high")).groupBy("id").agg(F.count("*").alias("n"))
    return degree.agg(F.count("*").alias("nodes"), F.max("n").alias("max_degree"), F.count_if(F.col("n") >= 10).alias("busy"))


@query("""
WITH p AS (SELECT p_partkey AS id, p_brand, p_size, 50.0 + (p_partkey % 100) * 0.001 AS lat, 70.0 + (p_partkey % 70) * 0.001 AS lon FROM part),
m AS (SELECT a.id AS low, b.id AS high, 2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) AS m
    FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.id < b.id)
SELECT low, high, CAST(floor(m) AS BIGINT) AS metres FROM m WHERE m <= 3000""")
def pair_signals_wide(spark, d):
    """Pairs of one brand and size within 3,000 m."""
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_size", (50.0 + (F.col("p_partkey") % 100) * 0.001).alias("lat"), (70.0 + (F.col("p_partkey") % 70) * 0.001).alias("lon"))
    pairs = C.with_sides(C.candidate_pairs(p, {"complex": F.concat_ws("|", "p_brand", "p_size")}), p)
    m = C.distance_m(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    return pairs.withColumn("m", m).filter("m <= 3000").select("low", "high", F.floor("m").cast("long").alias("metres"))


# --- texts, hashes, verdicts -------------------------------------------------------------------------------------

_RULES = [("license", "(?iU)\\blicen[cs]e"), ("contact", "@"), ("phone", "\\+[0-9]")]
_VERDICTS = """
WITH base AS (
    SELECT d.doc_id, d.text, d.lang, d.source, substr(sha256(concat('[', {text}, ',', {lang}, ',', {source}, ']')), 1, 16) AS content_hash,
        CASE WHEN regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}_])licen[cs]e') THEN 'license' WHEN contains(text, '@') THEN 'contact' WHEN regexp_matches(text, '\\+[0-9]') THEN 'phone' END AS rule
    FROM documents d),
verdicts AS (
    SELECT b.*, CASE WHEN rule IS NOT NULL THEN 0 WHEN l.toxic = 1 THEN 0 WHEN l.quality = 1 THEN 1 WHEN l.quality = 0 AND b.doc_id % 5 = 0 THEN NULL WHEN l.quality = 0 THEN 0 END AS usable,
        CASE WHEN rule IS NOT NULL THEN 'rule' WHEN l.doc_id IS NOT NULL THEN 'llm' END AS verdict_source,
        CASE WHEN rule IS NOT NULL THEN rule WHEN l.toxic = 1 THEN 'other_red_flag' WHEN l.quality = 1 THEN 'ok' WHEN l.doc_id IS NOT NULL THEN 'non_market_terms' END AS reason_code
    FROM base b LEFT JOIN labels l USING (doc_id)),
gated AS (SELECT *, CASE WHEN verdict_source IS NULL OR usable IS NULL THEN 'waiting' WHEN usable = 1 THEN 'publish' ELSE 'rejected' END AS gate FROM verdicts)
""".replace("{text}", _json("text")).replace("{lang}", _json("lang")).replace("{source}", _json("source"))


def _verdicts(spark, d):
    docs = _t(spark, d, "documents").withColumns({"content_hash": X.content_hash(F.col("text"), F.col("lang"), F.col("source")), "rule": V.rule_reason(F.col("text"), _RULES)})
    rows = docs.join(_t(spark, d, "labels").withColumn("known", F.lit(True)), "doc_id", "left")
    ruled = F.col("rule").isNotNull()
    usable = F.when(ruled | (F.col("toxic") == 1), 0).when(F.col("quality") == 1, 1).when((F.col("quality") == 0) & (F.col("doc_id") % 5 == 0), F.lit(None)).when(F.col("quality") == 0, 0)
    source = F.when(ruled, "rule").when(F.col("known"), "llm")
    reason = F.when(ruled, F.col("rule")).when(F.col("toxic") == 1, "other_red_flag").when(F.col("quality") == 1, "ok").when(F.col("known"), "non_market_terms")
    rows = rows.withColumns({"usable": usable, "verdict_source": source, "reason_code": reason})
    return rows.withColumn("gate", V.gate(F.col("usable"), F.col("verdict_source").isNotNull()))


@query(f"SELECT doc_id, substr(sha256(concat('[', {_json('text')}, ',', {_json('lang')}, ',', {_json('source')}, ']')), 1, 16) AS content_hash FROM documents")
def content_hash(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.content_hash(F.col("text"), F.col("lang"), F.col("source")).alias("content_hash"))


@query("SELECT doc_id, doc_id % 11 = 3 AS is_new FROM documents WHERE doc_id % 7 = 0 OR doc_id % 11 = 3")
def hash_diff(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", X.content_hash(F.col("text"), F.col("lang")).alias("h"))
    known = docs.filter("doc_id % 11 <> 3").withColumn("h", F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.col("h")))
    return V.changed(docs, known, "doc_id", "h").select("doc_id", "is_new")


@query(_VERDICTS + "SELECT doc_id, rule FROM base WHERE rule IS NOT NULL")
def rule_verdicts(spark, d):
    return _t(spark, d, "documents").select("doc_id", V.rule_reason(F.col("text"), _RULES).alias("rule")).filter("rule is not null")


@query(_VERDICTS + "SELECT doc_id, CAST(usable AS INT) AS usable, verdict_source, reason_code FROM verdicts")
def verdict_layers(spark, d):
    return _verdicts(spark, d).select("doc_id", "usable", "verdict_source", "reason_code")


@query(_VERDICTS + "SELECT verdict_source, reason_code, CAST(usable AS INT) AS usable, count(*) AS n FROM verdicts GROUP BY ALL")
def verdict_stats(spark, d):
    return _verdicts(spark, d).groupBy("verdict_source", "reason_code", "usable").agg(F.count("*").alias("n"))


@query(_VERDICTS + "SELECT gate, count(*) AS n FROM gated GROUP BY gate")
def publish_gate(spark, d):
    return _verdicts(spark, d).groupBy("gate").agg(F.count("*").alias("n"))


@query(_VERDICTS + "SELECT doc_id, reason_code FROM gated WHERE usable = 0 OR usable IS NULL ORDER BY CASE verdict_source WHEN 'rule' THEN 0 WHEN 'llm' THEN 1 ELSE 2 END, doc_id LIMIT 100")
def verdict_review_page(spark, d):
    rows = _verdicts(spark, d).filter("usable = 0 or usable is null")
    return rows.orderBy(F.when(F.col("verdict_source") == "rule", 0).when(F.col("verdict_source") == "llm", 1).otherwise(2), "doc_id").select("doc_id", "reason_code").limit(100)


@query(_VERDICTS + """SELECT content_hash AS entity, min(doc_id) AS doc_id, count(*) AS members, min(length(text)) AS n_chars FROM gated WHERE gate = 'publish' GROUP BY content_hash""")
def publish_clean(spark, d):
    """The flagship: gated rows, one canonical row for each group of equal listings."""
    ready = _verdicts(spark, d).filter("gate = 'publish'")
    return ready.groupBy(F.col("content_hash").alias("entity")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("members"), F.min(F.length("text")).cast("long").alias("n_chars"))


@query("SELECT doc_id, concat_ws(',', CASE WHEN contains(text, '@') THEN 'contact' END, CASE WHEN regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}_])licen[cs]e') THEN 'license' END, CASE WHEN regexp_matches(text, '\\+[0-9]') THEN 'phone' END) AS claims FROM documents")
def profile_claims(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.array_join(X.claims(F.col("text"), dict(_RULES)), ",").alias("claims"))


@query("SELECT doc_id, CASE WHEN length(text) > 1900 THEN concat(substr(text, 1, 1266), ' […] ', right(text, 634)) ELSE text END AS short FROM documents")
def truncate_head_tail(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.head_tail(F.col("text")).alias("short"))


@query("SELECT doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 20 AS chunk, source FROM documents")
def batch_chunking(spark, d):
    docs = H.numbered(_t(spark, d, "documents").select("doc_id", "source"), "source", "doc_id")
    return docs.select("doc_id", F.floor((F.col("rn") - 1) / 20).alias("chunk"), "source")


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def in_flight_exclusion(spark, d):
    return _t(spark, d, "documents").join(_t(spark, d, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id")


@query("WITH RECURSIVE next AS (SELECT doc_id, max(doc_id) OVER (PARTITION BY text ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS target FROM documents), walk AS (SELECT doc_id, doc_id AS place FROM next UNION ALL SELECT w.doc_id, n.target FROM walk w JOIN next n ON n.doc_id = w.place WHERE n.target IS NOT NULL) SELECT doc_id, min(place) AS survivor FROM walk GROUP BY doc_id")
def alias_resolution(spark, d):
    """Follows alias edges (each copy to the copy before it) to the surviving entity by pointer doubling."""
    docs = H.numbered(_t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h")), "h", "doc_id")
    before = docs.select("h", (F.col("rn") + 1).alias("rn"), F.col("doc_id").alias("survivor"))
    ends = graph.resolved(docs.join(before, ["h", "rn"]).select(F.col("doc_id").alias("old"), "survivor"))
    return docs.select("doc_id").join(ends, F.col("doc_id") == F.col("old"), "left").select("doc_id", F.coalesce("survivor", "doc_id").alias("survivor"))


# --- histories ---------------------------------------------------------------------------------------------------

_PRESENCE = "SELECT event_id, user_id, ts AS t, CASE event_type WHEN 'error' THEN 'missing' WHEN 'signup' THEN 'reactivated' ELSE 'seen' END AS type, value FROM events"


def _presence(spark, d):
    kind = F.when(F.col("event_type") == "error", "missing").when(F.col("event_type") == "signup", "reactivated").otherwise("seen")
    return _t(spark, d, "events").select("event_id", "user_id", F.col("ts").alias("at"), kind.alias("type"), "value")


@query(f"SELECT event_id, type FROM (SELECT *, lag(type) OVER (PARTITION BY user_id ORDER BY t, event_id) AS before FROM ({_PRESENCE}) WHERE type <> 'seen') WHERE before IS NULL OR before <> type")
def presence_transitions(spark, d):
    return H.transitions(_presence(spark, d).filter("type <> 'seen'"), "user_id", ["at", "event_id"], "type").select("event_id", "type")


@query(f"""
WITH p AS ({_PRESENCE}), c AS (SELECT * FROM (SELECT *, lag(type) OVER (PARTITION BY user_id ORDER BY t, event_id) AS before FROM p WHERE type <> 'seen') WHERE before IS NULL OR before <> type),
i AS (SELECT user_id, type, t AS start, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS stop FROM c),
o AS (SELECT user_id, start, coalesce(stop, TIMESTAMP '9999-12-31') AS stop FROM i WHERE type = 'reactivated'),
r AS (SELECT *, max(stop) OVER (PARTITION BY user_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM o)
SELECT user_id, count(*) FILTER (reach IS NULL OR start > reach) AS periods FROM r GROUP BY user_id""")
def market_periods(spark, d):
    return H.merged_intervals(H.market_intervals(_presence(spark, d), "user_id"), "user_id").groupBy("user_id").agg(F.count("*").alias("periods"))


@query("""
WITH i AS (SELECT l_partkey, o_orderdate AS start, greatest(l_shipdate, o_orderdate) AS stop FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
r AS (SELECT *, max(stop) OVER (PARTITION BY l_partkey ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
n AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY l_partkey ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS period FROM r)
SELECT l_partkey, CAST(period AS BIGINT) AS period, CAST(min(start) AS DATE)::VARCHAR AS first_day, CAST(max(stop) AS DATE)::VARCHAR AS last_day FROM n GROUP BY l_partkey, period""")
def interval_merge(spark, d):
    lines = _t(spark, d, "lineitem").join(_t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    spans = lines.select("l_partkey", F.col("o_orderdate").alias("start"), F.greatest("l_shipdate", "o_orderdate").alias("end"))
    return H.merged_intervals(spans, "l_partkey", open_ends=False).select("l_partkey", "period", F.date_format("start", "yyyy-MM-dd").alias("first_day"), F.date_format("end", "yyyy-MM-dd").alias("last_day"))


@query(f"SELECT event_id, user_id, value FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY t, event_id) AS before FROM ({_PRESENCE})) WHERE value > 0 AND (before IS NULL OR before <> value)")
def price_observations(spark, d):
    return H.transitions(_presence(spark, d), "user_id", ["at", "event_id"], "value").filter("value > 0 and not isnan(value)").select("event_id", "user_id", "value")


@query(f"SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY t, event_id) AS closed_by FROM ({_PRESENCE}) WHERE type <> 'seen'")
def membership_validity(spark, d):
    return H.validity(_presence(spark, d).filter("type <> 'seen'"), "user_id", "event_id", ["at", "event_id"]).select("event_id", F.col("valid_to").alias("closed_by"))


@query(f"""
WITH p AS ({_PRESENCE}), n AS (SELECT max(t) AS now FROM p),
u AS (SELECT user_id, max(t) FILTER (type = 'missing') AS missing_at, arg_max(type, t) AS last_type FROM p GROUP BY user_id)
SELECT user_id, CASE WHEN last_type <> 'missing' THEN 'active' WHEN epoch_us(now) - epoch_us(missing_at) < 86400000000 THEN 'uncertain' ELSE 'off_market' END AS lifecycle FROM u, n""")
def lifecycle_status(spark, d):
    rows = _presence(spark, d)
    now = rows.agg(F.max("at")).first()[0]
    users = rows.groupBy("user_id").agg(F.max(F.when(F.col("type") == "missing", F.col("at"))).alias("missing_at"), F.max_by("type", "at").alias("last_type"))
    return users.select("user_id", H.lifecycle(F.col("last_type") != "missing", F.col("missing_at"), F.lit(now).cast("timestamp_ntz")).alias("lifecycle"))


@query("SELECT count(*) AS stored, count(DISTINCT event_id) AS ids FROM events")
def event_ingest_idempotent(spark, d):
    events = ingest.with_hash(_t(spark, d, "events").drop("props"), ["event_id", "user_id", "event_type", "value"])
    first = events.filter("event_id % 2 = 0")
    stored = first.unionByName(ingest.fresh(events.unionByName(first), first))
    return stored.agg(F.count("*").alias("stored"), F.count_distinct("event_id").alias("ids"))


@query("SELECT event_id FROM events WHERE event_id % 13 = 0")
def event_conflicts(spark, d):
    fields = ["event_id", "user_id", "event_type"]
    events = ingest.with_hash(_t(spark, d, "events"), fields)
    again = ingest.with_hash(_t(spark, d, "events").withColumn("event_type", F.when(F.col("event_id") % 13 == 0, "changed").otherwise(F.col("event_type"))), fields)
    return ingest.conflicts(again, events).select("event_id")


@query("SELECT event_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)")
def orphan_events(spark, d):
    from cadastra.sources.snapshot import orphans

    return orphans(_t(spark, d, "events"), _t(spark, d, "customer").filter("c_custkey % 10 <> 0"), "user_id", "c_custkey").select("event_id")


# --- canonical rows ----------------------------------------------------------------------------------------------

_CANONICAL = """SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END DESC,
    CASE WHEN l_linestatus = 'O' AND l_extendedprice > 0 THEN l_extendedprice END ASC NULLS LAST, l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS rn FROM lineitem) WHERE rn = 1"""


@query(_CANONICAL)
def canonical_row(spark, d):
    rows = _t(spark, d, "lineitem")
    return H.canonical(rows, "l_partkey", F.col("l_linestatus") == "O", F.col("l_extendedprice"), F.lit(False), [F.desc("l_shipdate"), F.desc("l_orderkey"), F.desc("l_linenumber")]).select("l_partkey", "l_orderkey", "l_linenumber")


@query("SELECT l_partkey, min(l_extendedprice) FILTER (l_linestatus = 'O' AND l_extendedprice > 0) AS low, max(l_extendedprice) FILTER (l_linestatus = 'O' AND l_extendedprice > 0) AS high, count(*) FILTER (l_linestatus = 'O') AS active FROM lineitem GROUP BY l_partkey")
def entity_price_range(spark, d):
    price = F.when((F.col("l_linestatus") == "O") & (F.col("l_extendedprice") > 0), F.col("l_extendedprice"))
    return _t(spark, d, "lineitem").groupBy("l_partkey").agg(F.min(price).alias("low"), F.max(price).alias("high"), F.count_if(F.col("l_linestatus") == "O").alias("active"))


@query("SELECT count(*) AS entities, count(*) FILTER (n_active > 1) AS several_active, sum(n) AS members FROM (SELECT l_partkey, count(*) AS n, count(*) FILTER (l_linestatus = 'O') AS n_active FROM lineitem GROUP BY l_partkey)")
def entity_stats(spark, d):
    each = _t(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "O").alias("n_active"))
    return each.agg(F.count("*").alias("entities"), F.count_if(F.col("n_active") > 1).alias("several_active"), F.sum("n").alias("members"))


# --- photos ------------------------------------------------------------------------------------------------------

_HOST = "regexp_extract(url, '://([^/?#]*)', 1)"


@query(f"SELECT {_HOST} AS host, count(*) AS n, sha256(string_agg(url, '|' ORDER BY url)) AS set_hash FROM pages GROUP BY 1")
def photo_set_hash(spark, d):
    pages = _t(spark, d, "pages").groupBy(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host")).agg(F.collect_list("url").alias("urls"))
    return pages.select("host", F.size("urls").cast("long").alias("n"), X.set_hash(F.col("urls")).alias("set_hash"))


@query("SELECT page_id, starts_with(url, 'https://') AND NOT contains(url, 'utm_') AS allowed FROM pages")
def url_policy(spark, d):
    return _t(spark, d, "pages").select("page_id", (F.col("url").startswith("https://") & ~F.col("url").contains("utm_")).alias("allowed"))


_BITS = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: CASE WHEN (p[1] > 0) <> (p[2] > 0) THEN 1 ELSE 0 END))"


@query(f"SELECT a.vec_id AS low, b.vec_id AS high, CAST({_BITS} AS INT) AS distance FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {_BITS} <= 24")
def hamming_pairs(spark, d):
    """Pairs of one label whose 64 sign bits differ in at most 24 places."""
    bits = F.conv(F.array_join(F.transform("embedding", lambda x: F.when(x > 0, "1").otherwise("0")), ""), 2, -10).cast("long")
    e = _t(spark, d, "embeddings").select("vec_id", "label", bits.alias("bits"))
    low, high = e.withColumnsRenamed({"vec_id": "low", "bits": "x"}), e.withColumnsRenamed({"vec_id": "high", "bits": "y"})
    near = F.bit_count(F.col("x").bitwiseXOR(F.col("y")))
    return low.join(high, "label").filter(F.col("low") < F.col("high")).select("low", "high", near.alias("distance")).filter("distance <= 24")
