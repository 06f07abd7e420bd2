"""Registered queries of a whole listing cycle: snapshot checks, observation, candidates, gate, publication, decisions,
batches, reports. Their inputs are SQL over the given tables, the same text for Spark and for the SQL twins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadastra.functions import scalars as S
from cadastra.operators import assessments as A
from cadastra.operators import batches as B
from cadastra.operators import decisions as D
from cadastra.operators import merging as M
from cadastra.operators import observe as O
from cadastra.operators import profiles as P
from cadastra.operators import publishing as G
from cadastra.operators import refresh as R
from cadastra.operators import reports as W
from cadastra.plans.catalogue import _t, query
from cadastra.session import written
from cadastra.sources import snapshot

TABLES = ("part", "supplier", "customer", "orders", "lineitem", "events", "documents", "labels", "pages", "embeddings", "conversations")


def made(spark: SparkSession, d: str, text: str) -> DataFrame:
    """The rows of an input's SQL over the tables in d."""
    return spark.sql(text, **{t: _t(spark, d, t) for t in TABLES if f"{{{t}}}" in text})


def sql(text: str) -> str:
    """The input's SQL over the tables by their names."""
    for t in TABLES:
        text = text.replace(f"{{{t}}}", t)
    return text


_DAY = "concat('2024-0{m}-', lpad(CAST(1 + {n} % 28 AS STRING), 2, '0'), ' 0', CAST({n} % 10 AS STRING), ':00:00')"
#: Parts as listings of the new snapshot.
ROWS = f"""SELECT CAST(p_partkey AS STRING) AS id, p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 'missing' WHEN p_partkey % 10 > 0 THEN 'active' END AS status,
    CASE WHEN p_partkey % 17 > 0 THEN {_DAY.format(m=1, n='p_size')} END AS first_seen_at, CASE WHEN p_partkey % 19 > 0 THEN {_DAY.format(m=4, n='p_partkey')} ELSE '' END AS last_seen_at,
    CASE WHEN p_partkey % 6 = 0 THEN {_DAY.format(m=5, n='p_partkey')} END AS missing_detected_at, CAST(NULL AS STRING) AS scraped_at,
    CASE WHEN p_partkey % 4 = 0 THEN CAST(p_retailprice + 10 AS DOUBLE) WHEN p_partkey % 4 < 3 THEN CAST(p_retailprice AS DOUBLE) END AS initial_price,
    CASE WHEN p_partkey % 23 = 0 THEN -1.0 ELSE CAST(p_retailprice AS DOUBLE) END AS price, sha256_text AS content_hash, CAST(NULL AS STRING) AS photo_set_hash, p_name AS title,
    CAST(p_partkey % 5 AS STRING) AS photo_count, p_brand, p_type, CAST(p_size AS INT) AS p_size
FROM (SELECT *, substring(p_name, 1, 16) AS sha256_text FROM {{part}}) p"""
#: What is stored of three listings in four before it.
STATE = f"""SELECT id, CASE WHEN k % 11 = 0 THEN 'missing' ELSE 'active' END AS status, CASE WHEN k % 5 > 0 THEN {_DAY.format(m=2, n='k')} END AS first_seen_at, {_DAY.format(m=3, n='k')} AS last_seen_at,
    CAST(NULL AS STRING) AS missing_detected_at, CASE WHEN k % 2 = 0 THEN CAST(7.5 AS DOUBLE) END AS initial_price, CASE WHEN k % 13 = 0 THEN CAST(1.0 AS DOUBLE) WHEN k % 13 = 1 THEN CAST(NULL AS DOUBLE) ELSE CAST(p_price AS DOUBLE) END AS current_price,
    content_hash, CAST(NULL AS STRING) AS photo_set_hash FROM (SELECT *, price AS p_price FROM ({ROWS}) r) q WHERE k % 4 > 0"""
_STATUS = "CASE WHEN n.status IS NULL THEN 'active' ELSE n.status END"
NOW = "2024-05-10 00:00:00"


@query(f"""SELECT n.id, {_STATUS} AS status, coalesce(o.first_seen_at, n.first_seen_at) AS first_seen_at, n.last_seen_at, n.missing_detected_at,
    coalesce(o.initial_price, CASE WHEN n.initial_price > 0 THEN n.initial_price END) AS initial_price, CASE WHEN n.price > 0 THEN n.price END AS current_price
FROM ({sql(ROWS)}) n LEFT JOIN ({sql(STATE)}) o ON o.id = n.id""")
def observe_listings(spark, d):
    """The state after a snapshot: what was known first stays, the rest is the snapshot's."""
    return O.merge_state(made(spark, d, STATE), made(spark, d, ROWS)).drop("content_hash", "photo_set_hash")


@query(f"""SELECT id, event_type, status_after, CASE WHEN event_type = 'missing' THEN coalesce(missing_detected_at, nullif(last_seen_at, ''), '{NOW}') WHEN event_type = 'bootstrap_state' THEN coalesce(first_seen_at, nullif(last_seen_at, ''), '{NOW}') ELSE coalesce(nullif(last_seen_at, ''), '{NOW}') END AS observed_at, known AS history_complete
FROM (SELECT n.*, {_STATUS} AS status_after, o.id IS NOT NULL AS known, CASE WHEN o.id IS NULL THEN 'bootstrap_state' WHEN o.status = {_STATUS} THEN NULL WHEN {_STATUS} = 'active' THEN 'reactivated' ELSE 'missing' END AS event_type FROM ({sql(ROWS)}) n LEFT JOIN ({sql(STATE)}) o ON o.id = n.id) WHERE event_type IS NOT NULL""")
def presence_bootstrap(spark, d):
    return O.presence_events(made(spark, d, STATE), made(spark, d, ROWS), NOW)


@query(f"""WITH b AS (SELECT n.*, o.id IS NOT NULL AS known, CASE WHEN n.initial_price > 0 THEN n.initial_price END AS i, CASE WHEN n.price > 0 THEN n.price END AS c, CASE WHEN o.current_price > 0 THEN o.current_price END AS before, coalesce(nullif(n.last_seen_at, ''), '{NOW}') AS seen FROM ({sql(ROWS)}) n LEFT JOIN ({sql(STATE)}) o ON o.id = n.id)
SELECT id, 'bootstrap_initial' AS observation_type, i AS price, coalesce(first_seen_at, '{NOW}') AS observed_at, false AS history_complete FROM b WHERE NOT known AND i IS NOT NULL
UNION ALL SELECT id, 'bootstrap_current', c, seen, false FROM b WHERE NOT known AND c IS NOT NULL AND c IS DISTINCT FROM i
UNION ALL SELECT id, 'observed_change', c, seen, true FROM b WHERE known AND c IS NOT NULL AND c IS DISTINCT FROM before""")
def price_bootstrap(spark, d):
    return O.price_events(made(spark, d, STATE), made(spark, d, ROWS), NOW)


#: Users as listings, three to an entity, with their events; every fifth entity has source events too.
LOGGED = """SELECT CAST(user_id AS STRING) AS listing, CAST(user_id / 3 AS BIGINT) AS entity, CASE WHEN event_type = 'error' THEN 'missing' WHEN event_type = 'signup' THEN 'reactivated' ELSE 'seen' END AS event_type,
    CAST(ts AS STRING) AS observed_at, event_id FROM {events} WHERE user_id IS NOT NULL"""
_ENTITY = "CAST((user_id - user_id % 3) / 3 AS BIGINT)"
LOGGED = LOGGED.replace("CAST(user_id / 3 AS BIGINT)", _ENTITY)
USERS = f"""SELECT CAST(user_id AS STRING) AS id, {_ENTITY} AS entity, CASE WHEN user_id % 4 = 0 THEN 'active' ELSE 'missing' END AS status, CASE WHEN user_id % 7 > 0 THEN CAST(min(ts) AS STRING) END AS first_seen_at, CAST(max(ts) AS STRING) AS last_seen_at, CAST(NULL AS STRING) AS missing_detected_at FROM {{events}} WHERE user_id IS NOT NULL GROUP BY user_id"""
_PERIODS = f"""
l AS ({sql(LOGGED)}), u AS ({sql(USERS)}),
used AS (SELECT listing, entity, CASE WHEN event_type = 'missing_confirmed' THEN 'missing' ELSE event_type END AS type, CAST(observed_at AS TIMESTAMP) AS t, CAST(event_id AS STRING) AS event_id, 1 AS rank FROM l WHERE event_type IN ('missing', 'reactivated') AND (entity % 5 > 0 OR event_id % 2 = 0)),
opened AS (SELECT id AS listing, entity, 'reactivated' AS type, CAST(first_seen_at AS TIMESTAMP) AS t, NULL AS event_id, 0 AS rank FROM u WHERE first_seen_at IS NOT NULL),
every AS (SELECT * FROM opened UNION ALL SELECT * FROM used),
changes AS (SELECT * FROM (SELECT *, coalesce(lag(type) OVER (PARTITION BY listing ORDER BY rank, t, event_id), 'missing') AS before FROM every) WHERE type <> before),
spans AS (SELECT * FROM (SELECT *, lead(t) OVER (PARTITION BY listing ORDER BY rank, t, event_id) AS next, lead(type) OVER (PARTITION BY listing ORDER BY rank, t, event_id) IS NULL AS last_one FROM changes) WHERE type = 'reactivated'),
intervals AS (
    SELECT entity, t AS start, next AS stop FROM spans WHERE NOT last_one AND next >= t
    UNION ALL SELECT u.entity, coalesce(s.t, CAST(u.last_seen_at AS TIMESTAMP)), TIMESTAMP '9999-12-31' FROM u LEFT JOIN spans s ON s.listing = u.id AND s.last_one WHERE u.status = 'active'
    UNION ALL SELECT u.entity, s.t, CAST(u.last_seen_at AS TIMESTAMP) FROM u JOIN spans s ON s.listing = u.id AND s.last_one WHERE u.status <> 'active' AND CAST(u.last_seen_at AS TIMESTAMP) >= s.t),
reach AS (SELECT *, max(stop) OVER (PARTITION BY entity ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM intervals),
periods AS (SELECT entity, count(*) FILTER (far IS NULL OR start > far) AS periods FROM reach GROUP BY entity)"""


def _observed(spark, d):
    logged, users = made(spark, d, LOGGED), made(spark, d, USERS)
    events = logged.select("listing", "entity", "event_type", "observed_at", "event_id").withColumn("of_source", (F.col("entity") % 5 == 0) & (F.col("event_id") % 2 == 0))
    members = users.select(F.col("id").alias("listing"), "entity")
    source = events.filter("of_source").withColumn("event_type", F.when(F.col("event_type") == "missing", "missing_confirmed").otherwise(F.col("event_type"))).drop("of_source", "entity")
    # entities with a source event drop their local ones; the twin states which have one by their number
    return members, users, events.filter("not of_source").drop("of_source", "entity"), source


@query(f"""WITH {_PERIODS}, n AS (SELECT max(ts) AS now FROM events),
e AS (SELECT entity, count(*) AS members, count(*) FILTER (status = 'active') AS active, min(first_seen_at) AS first_seen_at, max(last_seen_at) AS last_seen_at, max(CAST(last_seen_at AS TIMESTAMP)) AS gone FROM u GROUP BY entity)
SELECT e.entity, CASE WHEN active > 0 THEN 'active' WHEN epoch_us(now) - epoch_us(gone) < 86400000000 THEN 'uncertain' ELSE 'off_market' END AS lifecycle_status, first_seen_at, last_seen_at, greatest(0, coalesce(periods, 0) - 1) AS relist_count, members, active
FROM e LEFT JOIN periods p ON p.entity = e.entity, n""")
def entity_recompute(spark, d):
    """Life cycle, first and last sight and relists of every entity, by source events where it has any."""
    now = _t(spark, d, "events").agg(F.max("ts").cast("string")).first()[0]
    return O.recompute_entities(*_observed(spark, d), now=now)


@query(f"WITH {_PERIODS} SELECT entity, periods FROM periods WHERE periods > 0")
def market_periods_by_source(spark, d):
    spans = O.market_intervals(*_observed(spark, d)).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})
    from cadastra.operators.history import merged_intervals

    return merged_intervals(spans, "entity").groupBy("entity").agg(F.count("*").alias("periods"))


@query(f"SELECT id AS listing, CASE WHEN k % 3 = 1 THEN concat('old', id) ELSE concat('ent_', sha256(id)) END AS entity FROM ({sql(ROWS)})")
def entity_attach(spark, d):
    rows = made(spark, d, ROWS)
    return O.attach_new(rows.filter("k % 3 = 1").select(F.col("id").alias("listing"), F.concat(F.lit("old"), "id").alias("entity")), rows)


# --- gate and publication ----------------------------------------------------------------------------------------

#: Verdicts of the documents by their labels, half of them on an older text, and outside decisions of every seventh.
DOCS = "SELECT CAST(doc_id AS STRING) AS id, doc_id AS k, substring(text, 1, 40) AS content_hash, CASE WHEN doc_id % 9 = 0 THEN '0' ELSE '1' END AS baseline_eligible, CASE WHEN doc_id % 8 = 0 THEN 'owner' ELSE ' Professional' END AS seller_type, CASE WHEN doc_id % 3 = 0 THEN 'missing' ELSE 'active' END AS status, CAST(n_chars AS DOUBLE) AS price, source AS title, lang AS street, concat('2024-01-', lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0')) AS last_seen_at FROM {documents}"
VERDICTS = "SELECT d.id, CASE WHEN d.k % 6 = 5 THEN 'older' ELSE d.content_hash END AS content_hash, CASE WHEN d.k % 5 = 4 THEN CAST(NULL AS INT) ELSE CAST(CASE WHEN d.k % 10 = 3 THEN 0 ELSE 1 END AS INT) END AS usable, CASE WHEN d.k % 10 = 3 THEN 'not_sale' ELSE 'ok' END AS reason_code FROM (" + DOCS + ") d WHERE d.k % 11 > 0"
OUTSIDE = "SELECT d.id, d.content_hash, CASE WHEN d.k % 4 = 0 THEN CAST(NULL AS INT) ELSE CAST(CASE WHEN d.k % 4 = 1 THEN 0 ELSE 1 END AS INT) END AS usable, CASE WHEN d.k % 4 = 1 THEN 'unit_ambiguous' WHEN d.k % 4 > 1 THEN 'ok' END AS reason_code FROM (" + DOCS + ") d WHERE d.k % 7 = 0"
_GATED = f"""d AS ({sql(DOCS)}), v AS ({sql(VERDICTS)}), o AS ({sql(OUTSIDE)}),
gated AS (SELECT d.*, v.id IS NOT NULL AND v.content_hash = d.content_hash AS current, o.id IS NOT NULL AS outside, CASE WHEN o.id IS NOT NULL THEN o.usable ELSE v.usable END AS usable, CASE WHEN o.id IS NOT NULL AND o.usable IS NOT NULL THEN o.reason_code ELSE v.reason_code END AS code, v.usable AS own, v.reason_code AS own_code, o.usable AS other
    FROM d LEFT JOIN v ON v.id = d.id LEFT JOIN o ON o.id = d.id AND o.content_hash = d.content_hash),
gates AS (SELECT *, CASE WHEN NOT coalesce(current, false) OR usable IS NULL THEN 'waiting' WHEN usable = 1 THEN 'publish' ELSE 'rejected' END AS gate, coalesce(current, false) AND other IS NOT NULL AND (other IS DISTINCT FROM own OR code IS DISTINCT FROM own_code) AS rewritten FROM gated)"""


@query(f"WITH {_GATED} SELECT id, gate, rewritten FROM gates")
def gate_with_outside(spark, d):
    return G.gated(made(spark, d, DOCS), made(spark, d, VERDICTS), made(spark, d, OUTSIDE)).select("id", "gate", "rewritten")


_PUBLISHED = f"""{_GATED}, ready AS (SELECT *, concat(title, '/', street) AS entity FROM gates WHERE gate = 'publish' AND baseline_eligible = '1' AND seller_type = ' Professional'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY CASE WHEN status = 'active' THEN 1 ELSE 0 END DESC, CASE WHEN status = 'active' AND price > 0 THEN price END ASC NULLS LAST, CASE WHEN status = 'active' AND k % 50 = 1 AND k = first_k THEN 1 ELSE 0 END DESC, last_seen_at DESC, id DESC) AS rn
    FROM (SELECT *, min(CASE WHEN k % 50 = 1 THEN k END) OVER (PARTITION BY entity) AS first_k FROM ready)),
ranges AS (SELECT entity, count(*) FILTER (status = 'active') AS n, min(price) FILTER (status = 'active' AND price > 0) AS low, max(price) FILTER (status = 'active' AND price > 0) AS high FROM ready GROUP BY entity),
whole AS (SELECT concat(title, '/', street) AS entity, count(*) AS members, count(*) FILTER (status = 'active') AS active FROM d GROUP BY 1)"""


def _entities(spark, d):
    docs = made(spark, d, DOCS)
    members = docs.select(F.col("id").alias("listing"), F.concat_ws("/", "title", "street").alias("entity"))
    entities = docs.withColumn("entity", F.concat_ws("/", "title", "street")).groupBy("entity").agg(
        F.count("*").alias("members"), F.count_if(F.col("status") == "active").alias("active"), F.min("last_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), F.lit("active").alias("lifecycle_status"), F.lit(0).alias("relist_count")
    )
    return docs, members, entities


@query(f"WITH {_PUBLISHED} SELECT r.entity, r.id, g.n AS ready_active, g.low, g.high, w.members, w.active, r.first_k IS NULL OR r.k <> r.first_k AS switched FROM ranked r JOIN ranges g ON g.entity = r.entity JOIN whole w ON w.entity = r.entity WHERE rn = 1")
def publish_chain(spark, d):
    """The whole publication: comparable rows, the gate with outside texts, one canonical row an entity with its columns."""
    docs, members, entities = _entities(spark, d)
    ready = G.gated(docs, made(spark, d, VERDICTS), made(spark, d, OUTSIDE))
    before = ready.filter("gate = 'publish' and k % 50 = 1 and baseline_eligible = '1' and seller_type = ' Professional'").groupBy(F.concat_ws("/", "title", "street").alias("entity")).agg(F.min("k").cast("string").alias("canonical"))
    out = G.publish(docs, made(spark, d, VERDICTS), made(spark, d, OUTSIDE), members, entities, before)
    return out.select("entity", "id", F.col("entity_ready_active_listing_count").alias("ready_active"), F.col("entity_active_min_price").alias("low"), F.col("entity_active_max_price").alias("high"), F.col("entity_member_count").alias("members"), F.col("entity_active_listing_count").alias("active"), "switched")


@query("SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) AS seq FROM documents")
def publish_sequence(spark, d):
    """Documents numbered by source and id."""
    return G.sequenced(_t(spark, d, "documents").select("source", "doc_id"), "source", "doc_id").select("doc_id", F.col("seq").cast("long").alias("seq"))


#: Photo assessments made of the vectors, on two versions, some of a wrong form.
PHOTOS = "SELECT CAST(vec_id AS STRING) AS id, CASE WHEN vec_id % 9 = 0 THEN 'short' ELSE concat(lpad(CAST(vec_id AS STRING), 24, '0'), '0123456789abcdef0123456789abcdef01234567') END AS photo_set_hash, CASE WHEN vec_id % 4 = 3 THEN 'v2' ELSE 'v1' END AS evaluator_version, CASE WHEN vec_id % 10 = 0 THEN 'no_photos' WHEN vec_id % 10 = 1 THEN 'other' WHEN vec_id % 10 = 2 THEN 'ready_with_download_gaps' ELSE 'ready' END AS status, CASE WHEN vec_id % 7 = 0 THEN 'insufficient' WHEN vec_id % 7 = 1 THEN CAST(NULL AS STRING) WHEN vec_id % 2 = 0 THEN 'partial' ELSE 'sufficient' END AS coverage, CASE WHEN vec_id % 13 = 0 THEN CAST(11.0 AS DOUBLE) WHEN vec_id % 7 > 1 THEN CAST(1 + label % 9 AS DOUBLE) END AS score, label FROM {embeddings}"


@query(f"SELECT id, photo_set_hash, score AS interior_score, coverage AS interior_coverage FROM ({sql(PHOTOS)}) WHERE evaluator_version = 'v1' AND status IN ('ready', 'ready_with_download_gaps') AND coverage IN ('sufficient', 'partial') AND score BETWEEN 1 AND 10 AND photo_set_hash <> 'short'")
def score_export(spark, d):
    return G.export_scores(made(spark, d, PHOTOS), "v1")


@query(f"""SELECT id, CASE WHEN photo_set_hash = 'short' THEN 'photo_set_hash' WHEN status = 'other' THEN 'status' WHEN status = 'no_photos' THEN CASE WHEN score IS NOT NULL OR coverage IS NOT NULL THEN 'unseen' END
    WHEN coverage = 'insufficient' THEN CASE WHEN score IS NOT NULL THEN 'score' END WHEN coverage IS NULL THEN 'coverage' WHEN score IS NULL OR score > 10 THEN 'score' END AS fault FROM ({sql(PHOTOS)})""")
def photo_validation(spark, d):
    return made(spark, d, PHOTOS).select("id", A.photo_fault(F.col("photo_set_hash"), F.col("status"), F.col("coverage"), F.col("score")).alias("fault"))


@query(f"SELECT d.id, coalesce(p.status, '') AS interior_status, coalesce(p.coverage, '') AS interior_coverage, CASE WHEN p.id IS NULL THEN '' ELSE 'v1' END AS interior_evaluator_version FROM ({sql(DOCS)}) d LEFT JOIN ({sql(PHOTOS)}) p ON p.id = d.id AND p.evaluator_version = 'v1' AND d.k % 2 = 0")
def assessment_enrichment(spark, d):
    """Rows with the photo assessment of exactly their photo set and version; odd rows show other photos now."""
    photos = made(spark, d, PHOTOS)
    docs = made(spark, d, DOCS).join(photos.select("id", F.col("photo_set_hash").alias("theirs")), "id", "left")
    rows = docs.withColumn("photo_set_hash", F.when(F.col("k") % 2 == 0, F.col("theirs")).otherwise("other")).drop("theirs", "status")
    texts = rows.limit(0).select("id", "content_hash", F.lit("").alias("evaluator_version"), F.lit("").alias("result"))
    return G.enriched(rows, texts, photos, "t1", "v1").select("id", "interior_status", "interior_coverage", "interior_evaluator_version")


#: Outside verdicts on documents of every kind of fault.
OUTSIDE_VERDICTS = """SELECT CAST(doc_id AS STRING) AS id, doc_id AS k, text, CASE WHEN doc_id % 5 = 0 THEN 'multi_unit_offer' WHEN doc_id % 5 = 1 THEN 'partial_property' WHEN doc_id % 5 = 2 THEN 'elsewhere' ELSE 'whole_apartment' END AS offer_type,
    CASE WHEN doc_id % 3 = 0 THEN CAST(NULL AS BOOLEAN) ELSE doc_id % 3 = 1 END AS usable, CASE WHEN doc_id % 3 = 0 THEN 'unclear' WHEN doc_id % 3 = 1 THEN 'ok' WHEN doc_id % 4 = 0 THEN 'partial_property' ELSE 'other_red_flag' END AS reason_code,
    CASE WHEN doc_id % 3 = 1 THEN '' WHEN doc_id % 8 = 0 THEN 'not in the text 12345' ELSE substring(text, 1, 30) END AS evidence, CASE WHEN doc_id % 16 = 7 THEN '1e3' ELSE CAST(n_chars AS STRING) END AS price_then, CASE WHEN doc_id % 16 = 7 THEN 1000 ELSE n_chars END AS price_now FROM {documents} WHERE doc_id % 2 = 1 OR length(text) > 40"""


@query(f"""SELECT id, CASE WHEN offer_type = 'elsewhere' THEN NULL WHEN usable IS NULL THEN CASE WHEN offer_type = 'multi_unit_offer' THEN 'unit_ambiguous' END WHEN usable THEN CASE WHEN offer_type = 'whole_apartment' THEN 'ok' END
    WHEN k % 8 = 0 OR NOT regexp_matches(substring(text, 1, 30), '[^\\s]') THEN NULL WHEN reason_code = 'partial_property' THEN CASE WHEN offer_type = 'partial_property' THEN reason_code END ELSE reason_code END AS decision FROM ({sql(OUTSIDE_VERDICTS)})""")
def comparison_reuse(spark, d):
    rows = made(spark, d, OUTSIDE_VERDICTS)
    none = F.lit(None).cast("string")
    v = F.struct("offer_type", none.alias("photo_scope"), none.alias("data_consistency"), "usable", "reason_code", F.lit("high").alias("confidence"), "evidence")
    found = A.comparison(F.col("price_now"), F.col("price_then"), none, F.lit(""), none, none, v, F.col("text"))
    return rows.select("id", found["reason_code"].alias("decision"))


#: Text assessments with wrong ids, hashes, versions and results among them.
TEXTS = "SELECT doc_id AS k, CASE WHEN doc_id % 10 = 0 THEN ' ' ELSE CAST(doc_id AS STRING) END AS listing_id, CASE WHEN doc_id % 10 = 1 THEN 'xyz' ELSE lpad(CAST(doc_id AS STRING), 16, '0') END AS content_hash, CASE WHEN doc_id % 10 = 2 THEN 'v 1' ELSE 'v1' END AS version, CASE WHEN doc_id % 10 = 3 THEN concat(chr(123), '\"a\":') WHEN doc_id % 10 = 4 THEN '[1]' ELSE concat(chr(123), '\"a\":', CAST(n_chars AS STRING), chr(125)) END AS result, doc_id % 2 AS updated_at FROM {documents}"


@query(f"SELECT k, CASE WHEN k % 10 = 0 THEN 'listing_id' WHEN k % 10 = 1 THEN 'content_hash' WHEN k % 10 = 2 THEN 'version' WHEN k % 10 IN (3, 4) THEN 'result' END AS fault FROM ({sql(TEXTS)})")
def assessment_validation(spark, d):
    return made(spark, d, TEXTS).select("k", A.text_fault(*map(F.col, ("listing_id", "content_hash", "version", "result"))).alias("fault"))


@query(f"WITH t AS (SELECT *, CAST(k % 97 AS STRING) AS listing FROM ({sql(TEXTS)})) SELECT listing, version, arg_max(result, k) AS result FROM t GROUP BY listing, version UNION ALL SELECT 'kept', 'v1', 'old'")
def assessment_save(spark, d):
    """Upsert by listing and version: of several, the last."""
    incoming = made(spark, d, TEXTS).select((F.col("k") % 97).cast("string").alias("listing"), "version", "result", F.col("k").alias("updated_at"))
    stored = spark.sql("SELECT * FROM VALUES ('kept', 'v1', 'old', 1L), ('5', 'v1', 'old', 1L) AS t(listing, version, result, updated_at)").join(incoming.select("listing").union(spark.sql("SELECT 'kept'")).distinct(), "listing", "left_semi")
    return A.saved(stored, incoming, ["listing", "version"]).drop("updated_at")


# --- candidates --------------------------------------------------------------------------------------------------

#: Parts as listings with an identity.
HOMES = "SELECT CAST(p_partkey AS STRING) AS id, CAST(CAST(p_size % 4 + 1 AS INT) AS STRING) AS rooms, CAST(40 + p_size % 3 AS DOUBLE) AS square_m2, CASE WHEN p_partkey % 5 > 0 THEN CAST(p_size % 6 AS STRING) ELSE '' END AS floor, p_brand AS street, CAST(p_size AS STRING) AS house_num, concat(split_part(p_type, ' ', 1), split_part(p_type, ' ', 3)) AS complex_name, CASE WHEN p_partkey % 3 > 0 THEN 'active' ELSE 'missing' END AS status, CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END AS baseline_eligible, p_partkey AS k FROM {part}"
_REFRESHED = f"""h AS ({sql(HOMES)}),
blocks AS (SELECT id, 'address' AS reason, concat_ws('|', lower(street), house_num, rooms, CAST(CAST(square_m2 AS BIGINT) AS STRING), floor) AS b FROM h
    UNION ALL SELECT id, 'complex', concat_ws('|', lower(complex_name), rooms, CAST(CAST(square_m2 AS BIGINT) AS STRING), floor) FROM h WHERE floor <> ''),
sized AS (SELECT *, count(*) OVER (PARTITION BY reason, b) AS n FROM blocks),
pairs AS (SELECT x.id AS low, y.id AS high, string_agg(DISTINCT x.reason, ',' ORDER BY x.reason) AS reasons, count(DISTINCT x.reason) AS n FROM sized x JOIN sized y ON x.reason = y.reason AND x.b = y.b AND x.id < y.id AND x.n BETWEEN 2 AND 100 GROUP BY 1, 2),
judged AS (SELECT p.*, a.k AS ka, c.k AS kc, concat_ws(',', CASE WHEN lower(a.street) <> lower(c.street) OR a.house_num <> c.house_num THEN 'address' END, CASE WHEN try_cast(a.floor AS DOUBLE) <> try_cast(c.floor AS DOUBLE) THEN 'floor' END) AS conflicts,
    CASE WHEN p.n = 2 THEN 60 ELSE 30 END + CASE WHEN a.status = 'active' AND c.status = 'active' THEN 5 ELSE 0 END AS priority, CASE WHEN a.status = 'active' THEN 1 ELSE 0 END + CASE WHEN c.status = 'active' THEN 1 ELSE 0 END AS n_active, a.baseline_eligible + c.baseline_eligible AS n_eligible
    FROM pairs p JOIN h a ON a.id = p.low JOIN h c ON c.id = p.high),
refreshed AS (SELECT *, CASE WHEN (ka + kc) % 31 = 0 THEN 'manual_linked' WHEN (ka + kc) % 31 = 1 THEN 'manual_not_link' WHEN (ka + kc) % 31 = 2 THEN 'photo_evidence_ready' WHEN conflicts <> '' THEN 'metadata_conflict' ELSE 'awaiting_photo_analysis' END AS status FROM judged)"""


def _refreshed(spark, d):
    homes = made(spark, d, HOMES)
    first = written(R.judge(homes.drop("k", "baseline_eligible")))
    place = (F.col("low").cast("long") + F.col("high").cast("long")) % 31
    overrides = first.filter(place.isin(0, 1)).select("low", "high", F.when(place == 0, "same_entity").otherwise("different_entity").alias("decision"))
    # evidence on the present revision, and on an older one that says nothing
    evidence = first.filter(place.isin(2, 3)).select("low", "high", "low_hash", "high_hash", F.when(place == 2, F.col("revision")).otherwise("older").alias("revision"), F.lit("m1").alias("match_revision"))
    return homes, R.decide(first, overrides, evidence)


@query(f"WITH {_REFRESHED} SELECT low, high, reasons, conflicts, priority, status FROM refreshed")
def candidate_refresh(spark, d):
    """All current pairs by address and complex, with overrides and carried evidence."""
    out = _refreshed(spark, d)[1]
    return out.select("low", "high", F.array_join("reasons", ",").alias("reasons"), F.array_join("hard_conflicts", ",").alias("conflicts"), "priority", "status")


@query(f"WITH {_REFRESHED} SELECT count(*) AS current_candidates, count(*) FILTER (status = 'metadata_conflict') AS metadata_conflict, count(*) FILTER (status = 'awaiting_photo_analysis') AS awaiting_photo_analysis, count(*) FILTER (status = 'photo_evidence_ready') AS photo_evidence_ready, count(*) FILTER (status = 'manual_linked') AS manual_linked, count(*) FILTER (status = 'manual_not_link') AS manual_not_link FROM refreshed")
def refresh_summary(spark, d):
    return R.summary(_refreshed(spark, d)[1])


def _reviewed(spark, d, **filters):
    homes, pairs = _refreshed(spark, d)
    edges = pairs.filter("match_revision is not null").select("low", "high", "match_revision", (F.col("low").cast("long") % 10 / 10).alias("score"), F.lit("uncertain").alias("decision"), F.lit(True).alias("is_current"))
    return R.review(pairs, homes.select("id", "status", "baseline_eligible"), edges, **filters)


@query(f"WITH {_REFRESHED} SELECT low, high, priority, CAST(n AS INT) AS reason_count, CAST(n_eligible AS INT) AS eligible FROM refreshed WHERE n_active = 1 AND n_eligible >= 1 AND priority >= 60 AND status <> 'manual_linked' ORDER BY priority DESC, low, high LIMIT 100")
def match_review(spark, d):
    """A page of the review queue: one side active, one eligible, of some priority."""
    rows = R.page(_reviewed(spark, d, min_priority=60, activity="active_missing", eligibility="at_least_one").filter("status <> 'manual_linked'"), limit=100)
    return rows.select("low", "high", "priority", "queue_facts.reason_count", F.col("queue_facts.baseline_eligible_count").alias("eligible"))


@query(f"WITH {_REFRESHED} SELECT count(*) AS total FROM refreshed WHERE status = 'photo_evidence_ready' AND CAST(low AS BIGINT) % 10 >= 3 AND n = 1")
def match_review_total(spark, d):
    return _reviewed(spark, d, status="photo_evidence_ready", reason_count=1, min_score=0.3, photo_decision="uncertain").agg(F.count("*").alias("total"))


@query(f"WITH {_REFRESHED} SELECT n_active, n_eligible, count(*) AS pairs FROM refreshed GROUP BY 1, 2")
def queue_facts(spark, d):
    facts = F.col("queue_facts")
    n = F.when(facts["activity"] == "both_active", 2).when(facts["activity"] == "active_missing", 1).otherwise(0)
    return _reviewed(spark, d).groupBy(n.alias("n_active"), facts["baseline_eligible_count"].alias("n_eligible")).agg(F.count("*").alias("pairs"))


@query(f"WITH {_REFRESHED} SELECT low, high, (ka * 7 + kc) % 3 > 0 AS is_current FROM refreshed UNION ALL SELECT low, high, false FROM refreshed WHERE (ka * 7 + kc) % 3 = 2")
def candidate_revisions(spark, d):
    """Stored revisions after a refresh that no longer has a third of the pairs, and has new revisions of another third."""
    pairs = _refreshed(spark, d)[1].select("low", "high", "revision")
    third = (F.col("low").cast("long") * 7 + F.col("high").cast("long")) % 3
    stored = pairs.withColumns({"revision": F.when(third == 2, "older").otherwise(F.col("revision")), "is_current": F.lit(True)})
    return R.renewed(stored, pairs.filter(third > 0)).select("low", "high", "is_current")


_INCOMING = f"SELECT low AS x, high AS y, ka, kc, CASE WHEN ka % 7 = 0 THEN 'invalid' WHEN ka % 11 = 0 OR kc % 5 = 0 OR kc % 9 = 0 THEN 'stale' ELSE 'accepted' END AS outcome FROM refreshed"


@query(f"WITH {_REFRESHED} SELECT outcome, count(*) AS n FROM ({_INCOMING}) GROUP BY 1")
def evidence_record(spark, d):
    """Evidence on every pair, sides in the other order for some: some without a version, some on what has changed since."""
    homes, pairs = _refreshed(spark, d)
    state = homes.select("id", F.concat(F.lit("set"), "id").alias("photo_set_hash"))
    ka, kc = F.col("low").cast("long"), F.col("high").cast("long")
    turned = ka % 2 == 1
    side = lambda low, high: F.when(turned, high).otherwise(low)
    sent = pairs.select(
        side(F.col("low"), F.col("high")).alias("a"), side(F.col("high"), F.col("low")).alias("b"), F.when(ka % 11 == 0, "older").otherwise(F.col("revision")).alias("revision"), F.lit("uncertain").alias("decision"), F.lit("0.5").alias("score"),
        *(F.when((ka % 7 == 0) & F.lit(v == "matcher_version"), "").otherwise("v1").alias(v) for v in R.EVIDENCE_VERSIONS),
        side(F.col("low_hash"), F.when(kc % 5 == 0, "older").otherwise(F.col("high_hash"))).alias("identity_a"), side(F.when(kc % 5 == 0, "older").otherwise(F.col("high_hash")), F.col("low_hash")).alias("identity_b"),
        side(F.concat(F.lit("set"), "low"), F.when(kc % 9 == 0, "").otherwise(F.concat(F.lit("set"), "high"))).alias("photos_a"), side(F.when(kc % 9 == 0, "").otherwise(F.concat(F.lit("set"), "high")), F.concat(F.lit("set"), "low")).alias("photos_b"),
    )
    return R.judged_evidence(sent, pairs, state).groupBy("outcome").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, count(*) OVER (PARTITION BY s_nationkey) > 1 AS shared FROM supplier")
def identity_hashes(spark, d):
    """Suppliers of one nation are one home: their identity hashes are equal, and only theirs."""
    homes = _t(spark, d, "supplier").select("s_suppkey", F.lit(2).alias("rooms"), F.col("s_nationkey").alias("floor"), F.lit("x").alias("street"))
    hashed = homes.withColumn("h", R.identity_hash(homes.columns))
    return hashed.select("s_suppkey", (F.count("*").over(Window.partitionBy("h")) > 1).alias("shared"))


# --- merges, splits, decisions -----------------------------------------------------------------------------------

HOLDINGS = "SELECT CAST(o_orderkey AS STRING) AS listing, CAST(o_custkey AS STRING) AS entity, CAST(o_orderdate AS STRING) AS created_at, o_orderkey AS k, o_custkey AS c FROM {orders}"
_ALTERED = f"m AS ({sql(HOLDINGS)}), sizes AS (SELECT c, count(*) AS n, min(created_at) AS since FROM m GROUP BY c), plan AS (SELECT CASE WHEN first THEN y ELSE x END AS absorbed, CASE WHEN first THEN x ELSE y END AS survivor FROM (SELECT a.c AS x, b.c AS y, a.n > b.n OR (a.n = b.n AND (a.since < b.since OR (a.since = b.since AND CAST(a.c AS STRING) < CAST(b.c AS STRING)))) AS first FROM sizes a JOIN sizes b ON a.c % 20 = 1 AND b.c = a.c + 1))"


def _merged(spark, d):
    held = made(spark, d, HOLDINGS)
    one = held.groupBy("c").agg(F.min("listing").alias("listing"))
    decisions = one.filter("c % 20 = 1").select("c", F.col("listing").alias("a")).join(one.select((F.col("c") - 1).alias("c"), F.col("listing").alias("b")), "c")
    done = spark.sql("SELECT '' AS key").limit(0)
    members = held.select("listing", "entity", "created_at")
    return members, M.merge_steps(members, decisions.select(F.col("c").alias("place"), "a", "b", F.lit("r1").alias("revision")), done)


@query(f"WITH {_ALTERED} SELECT listing, entity, CASE WHEN c IN (SELECT absorbed FROM plan) THEN 'now' END AS valid_to FROM m UNION ALL SELECT listing, CAST(survivor AS STRING), NULL FROM m JOIN plan ON absorbed = c")
def merge_history(spark, d):
    """Membership histories after a batch of merges: moved members' rows end, new ones begin."""
    held, steps = _merged(spark, d)
    blank = F.lit(None).cast("string")
    history = held.select("listing", "entity", F.lit("then").alias("valid_from"), blank.alias("valid_to"), F.lit("first").alias("reason"), blank.alias("key"))
    return M.history_after(history, steps, "now", "manual").select("listing", "entity", "valid_to")


@query(f"WITH {_ALTERED}, e AS (SELECT 1 AS seq, 'entities_merged' AS event_type UNION ALL SELECT 2, 'memberships_changed') SELECT concat_ws(':', 'merge', survivor, absorbed, 'r1') AS key, CAST(seq AS INT) AS seq, event_type, count(*) AS moved FROM m JOIN plan ON absorbed = c, e GROUP BY 1, 2, 3")
def merge_events(spark, d):
    held, steps = _merged(spark, d)
    return M.merge_events(held, steps).select("key", "seq", "event_type", F.size("moved").cast("long").alias("moved"))


def _split(spark, d):
    held = made(spark, d, HOLDINGS)
    asked = held.filter("k % 3 = 0").groupBy("entity").agg(F.min("c").alias("place"), F.collect_list("listing").alias("listings")).withColumn("revision", F.lit("r1"))
    members = held.select("listing", "entity")
    return members, M.split_steps(members, spark.createDataFrame([], "old string, survivor string"), asked, spark.createDataFrame([], "key string, child string"))


@query(f"WITH m AS ({sql(HOLDINGS)}), e AS (SELECT c, count(*) AS n, count(*) FILTER (k % 3 = 0) AS moved FROM m GROUP BY c) SELECT m.listing, e.moved BETWEEN 1 AND e.n - 1 AND k % 3 = 0 AS in_child FROM m JOIN e ON e.c = m.c")
def split_apply(spark, d):
    """A split of every third listing: only strict parts of an entity move, to a child of its own."""
    held, steps = _split(spark, d)
    return M.split_members(held, steps).select("listing", F.col("entity").startswith("ent_").alias("in_child"))


@query(f"WITH m AS ({sql(HOLDINGS)}), e AS (SELECT c, count(*) AS n, count(*) FILTER (k % 3 = 0) AS moved FROM m GROUP BY c) SELECT CAST(c AS STRING) AS parent FROM e WHERE moved BETWEEN 1 AND n - 1")
def split_lineage(spark, d):
    return _split(spark, d)[1].filter("outcome = 'split'").select("parent")


DECIDED = "SELECT CAST(o_orderkey AS STRING) AS a, CAST(o_orderkey + CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE 1 END AS STRING) AS b, CASE WHEN o_orderkey % 5 = 0 THEN 'maybe' WHEN o_orderkey % 2 = 0 THEN 'same_entity' ELSE 'different_entity' END AS decision, CASE WHEN o_orderkey % 7 = 0 THEN ' ' ELSE 'seen' END AS reason, 'r1' AS revision, o_orderkey AS k FROM {orders}"


@query(f"""WITH q AS ({sql(DECIDED)}), m AS ({sql(HOLDINGS)}), w AS (SELECT q.*, x.c AS xc, y.c AS yc FROM q LEFT JOIN m x ON x.listing = q.a LEFT JOIN m y ON y.listing = q.b)
SELECT outcome, status, count(*) AS n FROM (SELECT *, CASE WHEN outcome = 'applied' THEN CASE WHEN decision = 'same_entity' THEN 'manual_linked' ELSE 'manual_not_link' END END AS status FROM (SELECT *, CASE WHEN k % 5 = 0 OR k % 7 = 0 OR k % 9 = 0 OR xc IS NULL OR yc IS NULL OR (decision = 'different_entity' AND xc = yc) THEN 'invalid' WHEN k % 11 = 0 THEN 'repeated' ELSE 'applied' END AS outcome FROM w)) GROUP BY 1, 2""")
def manual_decisions(spark, d):
    asked = made(spark, d, DECIDED)
    held = made(spark, d, HOLDINGS).select("listing", "entity")
    low, high = F.least("a", "b"), F.greatest("a", "b")
    done = asked.filter("k % 11 = 0").select(M.operation_key("manual_override", low, high, F.col("decision"), F.col("revision")).alias("key"))
    return D.manual(asked, held, done).groupBy("outcome", "status").agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT l_partkey AS entity, min(l_orderkey) AS before, max(l_orderkey) AS after FROM lineitem GROUP BY 1)
SELECT entity, before AS listing, CASE WHEN before <> after THEN 'v2' END AS valid_to FROM f UNION ALL SELECT entity, after, NULL FROM f WHERE before <> after""")
def canonical_history(spark, d):
    """Histories of canonical rows after a version in which an entity's choice moved from its first to its last order."""
    f = _t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("entity")).agg(F.min("l_orderkey").alias("before"), F.max("l_orderkey").alias("after"))
    history = f.select("entity", F.col("before").alias("listing"), F.lit("v1").alias("valid_from"), F.lit(None).cast("string").alias("valid_to"), F.lit("v1").alias("version"))
    return D.canonical_history(history, f.select("entity", F.col("after").alias("listing")), "v2", "v2").select("entity", "listing", "valid_to")


@query("""WITH u AS (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL), used AS (SELECT user_id, event_id FROM events WHERE user_id % 2 = 1 OR event_id % 2 = 0)
SELECT CAST(u.user_id AS STRING) AS requested, CASE WHEN u.user_id % 10 = 9 THEN CAST(u.user_id - 9 AS STRING) ELSE CAST(u.user_id AS STRING) END AS entity, count(DISTINCT CASE WHEN u.user_id % 10 = 9 THEN u.user_id - 9 ELSE u.user_id END) AS members, count(used.event_id) AS events
FROM u LEFT JOIN used ON used.user_id = CASE WHEN u.user_id % 10 = 9 THEN u.user_id - 9 ELSE u.user_id END WHERE u.user_id % 10 < 9 OR u.user_id - 9 IN (SELECT user_id FROM u) GROUP BY 1, 2""")
def entity_timeline(spark, d):
    """Details of entities by any name: aliases are followed; members have source events (of even ids) if there are any."""
    e = _t(spark, d, "events").filter("user_id is not null").select(F.col("user_id").cast("string").alias("listing"), "event_id", F.col("ts").cast("string").alias("observed_at"), "event_type", "user_id")
    names = e.select("user_id", "listing").distinct()
    aliases = names.filter("user_id % 10 = 9").select(F.col("listing").alias("old"), (F.col("user_id") - 9).cast("string").alias("survivor"))
    members = names.select("listing", F.col("listing").alias("entity"))
    state = names.select(F.col("listing").alias("id"), F.lit("active").alias("status"), F.lit("").alias("first_seen_at"))
    source, local = e.filter("user_id % 2 = 0 and event_id % 2 = 0"), e.filter("user_id % 2 = 1")
    past = names.limit(0).select(F.col("listing").alias("entity"), "listing", F.lit("").alias("valid_from"), F.lit("").alias("valid_to"))
    out = D.detail(names.select(F.col("listing").alias("requested")), aliases, members, state, source, local, past)
    return out.select("requested", "entity", F.size("members").cast("long").alias("members"), F.aggregate("members", F.lit(0).cast("long"), lambda n, m: n + F.size(m["events"])).alias("events"))


# --- batches -----------------------------------------------------------------------------------------------------

#: Batches of twenty documents: a map, an old list, or text that cannot be read.
SENT = "SELECT b AS batch_id, CASE WHEN b % 3 = 0 THEN 'completed' ELSE 'pending' END AS status, CASE WHEN b % 7 = 0 THEN 'broken' WHEN b % 5 = 0 THEN concat('[\"', CAST(min(doc_id) AS STRING), '\"]') ELSE concat(chr(123), '\"', CAST(min(doc_id) AS STRING), '\":\"h\",\"', CAST(max(doc_id) AS STRING), '\":\"h\"', chr(125)) END AS listing_ids, min(doc_id) AS low, max(doc_id) AS high FROM (SELECT doc_id, CAST((doc_id - doc_id % 20) / 20 AS BIGINT) AS b FROM {documents}) x GROUP BY b"


@query(f"WITH s AS ({sql(SENT)}) SELECT CAST(low AS STRING) AS id FROM s WHERE batch_id % 3 > 0 AND batch_id % 7 > 0 UNION SELECT CAST(high AS STRING) FROM s WHERE batch_id % 3 > 0 AND batch_id % 7 > 0 AND batch_id % 5 > 0")
def batch_in_flight(spark, d):
    return B.in_flight(made(spark, d, SENT))


@query(f"SELECT batch_id, CASE WHEN batch_id % 4 = 0 OR (batch_id % 7 = 0 AND batch_id % 4 = 1) OR (batch_id % 11 = 0 AND batch_id % 4 = 1) THEN 'failed' WHEN batch_id % 4 = 1 THEN CASE WHEN batch_id % 13 = 0 THEN 'pending' ELSE 'completed' END WHEN batch_id % 4 = 2 THEN 'expired' ELSE 'pending' END AS outcome FROM ({sql(SENT)}) WHERE batch_id % 3 > 0")
def batch_outcomes(spark, d):
    sent, b = made(spark, d, SENT), F.col("batch_id")
    answers = sent.select("batch_id", F.when(b % 4 < 2, "completed").when(b % 4 == 2, "expired").otherwise("in_progress").alias("state"), F.when(b % 4 == 1, "file").alias("output_file"), F.when(b % 11 == 0, 404).when(b % 13 == 0, 503).otherwise(200).alias("download_code"))
    return B.batch_outcomes(sent, answers)


@query("SELECT doc_id, CAST((rn // 300) AS BIGINT) AS batch, CAST((rn % 300) // 20 AS BIGINT) AS grp, CAST((rn % 300) % 20 AS BIGINT) AS place FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rn FROM documents) WHERE rn < 700")
def batch_plan(spark, d):
    docs = _t(spark, d, "documents").select("doc_id")
    n = B.budget(docs.count(), spent=100, flying=50, pilot=850, size=300, batches=3)
    return B.planned(docs, "doc_id", n, size=300).withColumnRenamed("group", "grp")


@query("SELECT CAST(rn // 20 AS BIGINT) AS grp, concat('grp_', min(doc_id)) AS custom_id, count(*) * 150 + 300 + 4000 AS tokens, sum(CASE WHEN length(text) > 1900 THEN 1905 ELSE length(text) END) + 2 * (count(*) - 1) AS chars FROM (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS rn FROM documents) WHERE rn < 100 GROUP BY rn // 20")
def request_lines(spark, d):
    from cadastra.functions.text import head_tail

    first = B.planned(_t(spark, d, "documents").select(F.col("doc_id"), F.col("doc_id").alias("id"), "text"), "doc_id", 100)
    lines = B.request_lines(first, head_tail(F.col("text")), "o4-model", "prompt")
    read = F.from_json("value", "custom_id string, body struct<max_completion_tokens: bigint, messages: array<struct<role: string, content: string>>>")
    return lines.select(F.col("group").alias("grp"), read.alias("r")).select("grp", "r.custom_id", F.col("r.body.max_completion_tokens").alias("tokens"), F.length(F.col("r.body.messages")[1]["content"]).cast("long").alias("chars"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 4 + 1 >= 3 THEN 'h' ELSE '' END ELSE 'h' END AS content_hash, CAST(CASE WHEN doc_id % 3 = 0 THEN doc_id % 4 + 1 ELSE 0 END AS INT) AS attempts FROM documents")
def attempts_cap(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("id"))
    results = docs.select("id", F.lit("h").alias("saved_hash"), F.lit(1).alias("usable"), F.lit("ok").alias("reason_code"), F.when(F.col("id") % 3 == 0, "llm_failed").otherwise("llm").alias("source"))
    verdicts = docs.filter("id % 4 > 0").select("id", (F.col("id") % 4).cast("int").alias("attempts"))
    return B.ingested(results, verdicts).select("id", "content_hash", "attempts")


KNOWN = "SELECT doc_id AS id, 'h' AS content_hash, CAST(doc_id % 2 AS INT) AS usable, CASE WHEN doc_id % 6 = 0 THEN 'license' WHEN doc_id % 2 = 1 THEN 'ok' ELSE 'not_sale' END AS reason_code, CASE WHEN doc_id % 3 = 0 THEN 'rule' WHEN doc_id % 3 = 1 THEN 'llm' ELSE 'main' END AS source, doc_id AS k FROM {documents}"


@query(f"SELECT id, CASE WHEN source = 'llm' THEN '' ELSE 'h' END AS content_hash, source = 'llm' AND k % 8 > 0 AS queued FROM ({sql(KNOWN)})")
def relabel_generation(spark, d):
    """A new relabelling: model verdicts lose their hash and are queued, gone listings (every eighth) are not."""
    known = made(spark, d, KNOWN)
    verdicts, queue = B.start_relabel(known)
    queue = B.prune_relabel(queue, known.filter("k % 8 > 0").select("id")).withColumn("queued", F.lit(True))
    return verdicts.join(queue, "id", "left").select("id", "content_hash", F.coalesce("queued", F.lit(False)).alias("queued"))


@query(f"SELECT CASE WHEN k % 5 = 0 AND NOT (source = 'rule' AND usable = 0 AND reason_code = 'license') THEN 'overridden' WHEN k % 5 > 0 AND source = 'rule' AND k % 9 < 8 THEN 'reopened' ELSE 'kept' END AS action, count(*) AS n FROM ({sql(KNOWN)}) GROUP BY 1")
def retroactive_rules(spark, d):
    known = made(spark, d, KNOWN)
    ruled = known.filter("k % 9 < 8 or k % 5 = 0").select("id", F.lit("h2").alias("content_hash"), F.when(F.col("k") % 5 == 0, "license").alias("rule"))
    return B.retroactive(known.drop("k"), ruled).groupBy("action").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN contains(text, '@') THEN 'rule' WHEN doc_id % 3 = 0 THEN 'main' ELSE 'llm' END AS layer, count(*) AS n FROM documents GROUP BY 1")
def rules_then_reuse(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.lit("h").alias("content_hash"))
    decided = docs.select("id", F.when(F.col("id") % 3 == 0, "h").otherwise("older").alias("content_hash"))
    return B.judged_without_model(docs, F.when(F.contains("text", F.lit("@")), "contact"), decided).groupBy("layer").agg(F.count("*").alias("n"))


# --- profiles ----------------------------------------------------------------------------------------------------

CARDS = "SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'Продаётся доля в квартире' WHEN doc_id % 4 = 1 THEN ' Продам гараж у дома' WHEN doc_id % 4 = 2 THEN 'Уютная 2-комнатная квартира' END AS title, CASE WHEN doc_id % 3 = 0 THEN concat(substring(source, 1, 5), ' Свежий РЕМОНТ, без мебели.') WHEN doc_id % 3 = 1 THEN 'Нужен  свежий ремонт. Срочная продажа' ELSE 'Ипотека возможна; не без мебели' END AS full_description, CASE WHEN doc_id % 5 = 0 THEN 'Требует ремонта' WHEN doc_id % 5 = 1 THEN 'другое' END AS rent_renovation, CASE WHEN doc_id % 7 = 0 THEN 'Полностью' WHEN doc_id % 7 = 1 THEN 'частично ' END AS furniture FROM {documents}"


@query(f"SELECT id, CASE WHEN id % 4 = 0 THEN 'partial_property' WHEN id % 4 = 1 THEN 'not_apartment' END AS rule FROM ({sql(CARDS)})")
def title_rules(spark, d):
    return made(spark, d, CARDS).select("id", P.title_rule(F.col("title")).alias("rule"))


@query(f"""SELECT id, concat_ws(',', CASE WHEN id % 3 = 0 THEN 'finish_fresh/text' END, CASE WHEN id % 5 = 0 THEN 'finish_needs_repair/rent_renovation' END, CASE WHEN id % 7 = 0 THEN 'furniture_full/furniture' END, CASE WHEN id % 3 = 0 THEN 'furniture_none/text' END, CASE WHEN id % 7 = 1 THEN 'furniture_partial/furniture' END, CASE WHEN id % 3 = 2 THEN 'mortgage_possible_claim/text' END, CASE WHEN id % 3 = 1 THEN 'urgent_claim/text' END) AS claims,
    concat_ws(',', CASE WHEN id % 3 = 0 AND id % 5 = 0 THEN 'finish' END, CASE WHEN id % 3 = 0 AND id % 7 = 0 THEN 'furniture' END) AS conflicts FROM ({sql(CARDS)})""")
def listing_profiles(spark, d):
    """Claims of titles, texts and fields, with their sources, and their conflicts."""
    found = P.profile(made(spark, d, CARDS))
    # a negated first match counts as none, so the finish wanted at id % 3 = 1 and the furniture at id % 3 = 2 do not appear
    return found.select("id", F.array_join(F.transform("signals", lambda s: F.concat_ws("/", s["code"], s["source"])), ",").alias("claims"), F.array_join("conflicts", ",").alias("conflicts"))


@query(f"SELECT count(*) AS profiles, count(*) FILTER (id % 6 = 0 OR id % 11 = 0) AS computed FROM ({sql(CARDS)})")
def profile_incremental(spark, d):
    """Profiles of changed (every sixth) and new (every eleventh) listings only are computed."""
    cards = made(spark, d, CARDS)
    old = P.profile(cards.filter("id % 11 > 0").withColumn("title", F.when(F.col("id") % 6 == 0, "old").otherwise(F.col("title"))), {})
    every, fresh = P.updated(old, cards, {})
    return every.agg(F.count("*").alias("profiles")).crossJoin(fresh.agg(F.count("*").alias("computed")))  # two single rows


@query(f"SELECT id FROM ({sql(CARDS)}) WHERE id % 3 = 0 AND id % 7 = 0")
def profile_contradictions(spark, d):
    found = P.profile(made(spark, d, CARDS)).withColumn("codes", F.transform("signals", lambda s: s["code"]))
    return W.contradictions(found, [["furniture_full", "furniture_none"], ["finish_rough", "finish_lived_in"]])


@query(f"SELECT id, CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN id % 7 < 2 THEN 1 ELSE 0 END AS structured FROM ({sql(CARDS)}) ORDER BY id LIMIT 100 OFFSET 50")
def profiles_page(spark, d):
    found = P.profile(made(spark, d, CARDS), {}).select("id", F.size("signals").alias("structured"))
    return W.page(found, "id", limit=100, offset=50)


# --- reports -----------------------------------------------------------------------------------------------------

JUDGED = "SELECT doc_id AS id, CAST(doc_id - doc_id % 25 AS BIGINT) AS processed_at, CASE WHEN doc_id % 4 = 3 THEN CAST(NULL AS INT) ELSE CAST(doc_id % 2 AS INT) END AS usable, CASE WHEN doc_id % 5 = 0 THEN 'not_sale' ELSE 'ok' END AS reason_code, CASE WHEN doc_id % 3 = 0 THEN 'low' WHEN doc_id % 3 = 1 THEN 'medium' ELSE 'high' END AS confidence, text AS full_description, source AS title FROM {documents}"


@query(f"SELECT id, usable, reason_code FROM ({sql(JUDGED)}) WHERE usable = 0 AND reason_code = 'not_sale' ORDER BY processed_at, id LIMIT 60 OFFSET 5")
def verdict_page(spark, d):
    return W.verdict_page(made(spark, d, JUDGED), 0, "not_sale", 60, 5).select("id", "usable", "reason_code")


@query(f"SELECT id, confidence FROM ({sql(JUDGED)}) WHERE usable = 0 OR usable IS NULL ORDER BY CASE confidence WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, processed_at, id LIMIT 200")
def review_by_confidence(spark, d):
    rows = made(spark, d, JUDGED).filter("usable = 0 or usable is null")
    return W.page(rows, W.review_order(F.col("confidence")), "processed_at", "id").select("id", "confidence")


@query(f"SELECT id, CASE WHEN usable = 1 THEN NULL ELSE substring(full_description, 1, 100) END AS kept FROM ({sql(JUDGED)})")
def rejected_snapshots(spark, d):
    return made(spark, d, JUDGED).select("id", W.text_snapshot(F.col("usable"), F.col("full_description"), 100).alias("kept"))


@query(f"SELECT id, usable, reason_code FROM ({sql(JUDGED)})")
def verdict_states(spark, d):
    return made(spark, d, JUDGED).select("id", "usable", "reason_code")


@query("SELECT event_type, CASE WHEN s > 0 THEN s ELSE l END AS events, s > 0 AS source_history FROM (SELECT event_type, count(*) FILTER (value > 100) AS s, count(*) AS l FROM events GROUP BY 1)")
def event_counts(spark, d):
    """Events of each type: those of high value are the source's; where it has none, all count."""
    n = _t(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 100).alias("s"), F.count("*").alias("l"))
    return n.select("event_type", F.when(F.col("s") > 0, F.col("s")).otherwise(F.col("l")).alias("events"), (F.col("s") > 0).alias("source_history"))


@query(f"WITH {_REFRESHED} SELECT CAST(priority AS STRING) AS value, count(*) AS n FROM refreshed GROUP BY 1 UNION ALL SELECT reason, count(*) FROM (SELECT unnest(string_split(reasons, ',')) AS reason FROM refreshed) GROUP BY 1")
def queue_histogram(spark, d):
    pairs = _refreshed(spark, d)[1]
    return W.histogram(pairs, "priority").withColumn("value", F.col("value").cast("string")).unionByName(W.histogram(pairs, "reasons"))


@query(f"WITH {_REFRESHED} SELECT CASE n_active WHEN 2 THEN 'active/active' WHEN 1 THEN 'active/missing' ELSE 'missing/missing' END AS mix, count(*) AS n FROM refreshed GROUP BY 1")
def pair_status_mix(spark, d):
    homes, pairs = _refreshed(spark, d)
    return W.status_mix(pairs, homes.select("id", "status"))


@query(f"WITH {_REFRESHED} SELECT low, high, priority FROM refreshed ORDER BY priority DESC, low, high LIMIT 20")
def top_pairs(spark, d):
    return _refreshed(spark, d)[1].orderBy(F.desc("priority"), "low", "high").select("low", "high", "priority").limit(20)


@query("SELECT count(*) AS listings, count(*) FILTER (p_partkey % 3 > 0) AS active, count(*) FILTER (p_partkey % 3 = 0) AS missing, count(*) FILTER (p_size % 4 > 0) AS with_drops, count(*) FILTER (p_size % 5 = 0) AS with_reactivations FROM part")
def snapshot_counts(spark, d):
    size = F.col("p_size")
    rows = _t(spark, d, "part").select(F.when(F.col("p_partkey") % 3 == 0, "missing").when(F.col("p_partkey") % 3 == 1, "active").alias("status"), (size % 4).cast("string").alias("price_drop_count"), F.when(size % 5 == 0, "2").when(size % 5 == 1, "x").alias("reactivation_count"))
    return W.snapshot_counts(rows)


@query("SELECT count(*) AS cases, count(*) FILTER (doc_id % 4 = 0) AS passed, count(*) FILTER (doc_id % 4 IN (2, 3)) AS hard, count(*) FILTER (doc_id % 4 = 1) AS soft FROM documents")
def regression_scores(spark, d):
    """Labelled cases against answers: right, of the wrong code, of the wrong side, and unanswered."""
    docs, k = _t(spark, d, "documents").select(F.col("doc_id").alias("id")), F.col("id") % 4
    cases = docs.select("id", F.when(k == 0, F.array(F.lit("ok"))).otherwise(F.array(F.lit("not_sale"), F.lit("price_not_full"))).alias("expected"))
    answers = docs.filter("id % 4 < 3").select("id", F.when(k == 1, "legal_restriction").otherwise("ok").alias("reason_code"), (k != 1).alias("usable"))
    return W.regression(cases, answers)


RUNS = "SELECT o_custkey AS service, CASE WHEN o_orderpriority = '5-LOW' THEN 'tick' ELSE 'full' END AS kind, o_orderdate AS ran, o_orderkey AS k, o_orderstatus = 'P' OR o_custkey % 10 = 0 AS failed FROM {orders}"


@query(f"""WITH r AS (SELECT *, max(ran) OVER () AS now FROM ({sql(RUNS)})), s AS (SELECT service, max(now) AS now, max(ran) FILTER (NOT failed) AS good, max_by(failed, epoch_us(ran) * 1000 + k % 1000) AS bad FROM r WHERE kind = 'full' GROUP BY service)
SELECT CASE WHEN good IS NULL THEN 'broken' WHEN epoch_us(now) - epoch_us(good) > 15552000000000 THEN 'stale' WHEN bad THEN 'degraded' ELSE 'ok' END AS health, count(*) AS services FROM s GROUP BY 1""".replace("max_by(", "arg_max("))
def run_health(spark, d):
    """Health of customers as services, whose orders are runs: half a year without a good run is stale."""
    runs = made(spark, d, RUNS)
    now = runs.agg(F.max("ran")).first()[0]
    last = W.last_runs(runs.select("service", "kind", F.struct("ran", (F.col("k") % 1000).alias("k")).alias("at"), "failed"))
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("last_success_at.ran").cast("timestamp"))) / 1e6
    state = W.health(age, F.col("last_success_at").isNotNull(), F.col("last_attempt_failed"), F.lit(10**9), 15552000)
    return last.groupBy(state.alias("health")).agg(F.count("*").alias("services"))


@query("SELECT CAST(user_id AS STRING) AS listing, string_agg(event_type, ',' ORDER BY ts, event_id) AS timeline FROM events WHERE user_id IS NOT NULL GROUP BY 1")
def event_timelines(spark, d):
    e = _t(spark, d, "events").filter("user_id is not null")
    return W.timeline(e.select(F.col("user_id").cast("string").alias("listing"), F.col("ts").alias("observed_at"), "event_id", "event_type"))


@query(f"WITH {_GATED} SELECT count(*) AS observed, count(*) FILTER (gate = 'publish') AS published, count(*) FILTER (gate = 'rejected') AS rejected, count(*) FILTER (gate = 'waiting') AS waiting, count(*) FILTER (rewritten) AS rewritten FROM gates")
def cycle_summary(spark, d):
    gated = G.gated(made(spark, d, DOCS), made(spark, d, VERDICTS), made(spark, d, OUTSIDE))
    return gated.agg(F.count("*").alias("observed"), *(F.count_if(F.col("gate") == g).alias(n) for n, g in (("published", "publish"), ("rejected", "rejected"), ("waiting", "waiting"))), F.count_if("rewritten").alias("rewritten"))


# --- snapshot checks, scalars ------------------------------------------------------------------------------------

LOG = "SELECT CASE WHEN event_id % 50 = 7 THEN ' ' WHEN event_id % 50 = 8 THEN 'same' ELSE CAST(event_id AS STRING) END AS source_event_id, CAST(user_id AS STRING) AS listing_id, event_id AS k FROM {events} WHERE user_id IS NOT NULL"


@query(f"WITH l AS ({sql(LOG)}) SELECT k, CASE WHEN k % 50 = 7 THEN 'no id' WHEN k % 50 = 8 THEN 'repeated id' ELSE 'unknown listing' END AS fault FROM l WHERE k % 50 IN (7, 8) OR CAST(listing_id AS BIGINT) % 10 = 0")
def event_validation(spark, d):
    rows = _t(spark, d, "events").filter("user_id is not null and user_id % 10 > 0").select(F.col("user_id").cast("string").alias("id")).distinct()
    return snapshot.event_faults(made(spark, d, LOG), rows).select("k", "fault")


@query("SELECT u AS url, substring(sha256(u), 1, 2) AS shard FROM (SELECT DISTINCT split_part(url, '?', 1) AS u FROM pages) WHERE length(u) % 3 > 0")
def asset_cache_misses(spark, d):
    """Photo urls without a fingerprint of the present versions; every third (by length) has one, others an older one."""
    urls = _t(spark, d, "pages").select(F.split_part("url", F.lit("?"), F.lit(1)).alias("url"))
    have = urls.distinct().select(F.sha2("url", 256).alias("url_hash"), F.lit("n1").alias("normalization"), F.when(F.length("url") % 3 == 0, "f2").otherwise("f1").alias("fingerprint"))
    return snapshot.cache_misses(urls, have, "n1", "f2").select("url", "shard")


@query("SELECT vec_id, concat('{\"label\":', label, ',\"n\":', len(embedding), '}') AS cell FROM embeddings")
def csv_cells(spark, d):
    rows = _t(spark, d, "embeddings").select("vec_id", F.struct("label", F.size("embedding").alias("n")).alias("cell"))
    return snapshot.csv_rows(rows)


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 5 = 1 THEN CAST(p_size AS STRING) ELSE concat(p_size, '.5') END AS whole, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 5 = 1 THEN CAST(p_size AS DOUBLE) ELSE CAST(p_size + 0.5 AS DOUBLE) END AS price, CAST(CASE WHEN p_partkey % 5 > 1 THEN CASE WHEN p_size % 2 = 0 THEN p_size ELSE p_size + 1 END END AS DOUBLE) AS even FROM part")
def scalar_formats(spark, d):
    """Numbers in odd writing: not a number, whole, half; ties round to the even number."""
    k = F.col("p_partkey") % 5
    text = F.when(k == 0, F.when(F.col("p_size") % 2 == 0, "nan").otherwise("-3 m")).when(k == 1, F.concat(F.lit(" "), F.col("p_size"), F.lit(".0"))).otherwise(F.concat("p_size", F.lit(".5")))
    return _t(spark, d, "part").select("p_partkey", S.whole_text(text).alias("whole"), S.price(text).alias("price"), F.when(k > 1, S.half_even(S.number(text), 0)).alias("even"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE epoch_us(ts) // 1000000 END AS seconds FROM events")
def tolerant_times(spark, d):
    """Times with a zone, without one, of another zone, and texts that are none."""
    k, ts = F.col("event_id") % 4, F.col("ts")
    plain = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(k == 0, F.concat(plain(ts), F.lit("Z"))).when(k == 1, plain(ts)).when(k == 2, F.concat(plain(ts + F.expr("interval 5 hours")), F.lit("+05:00"))).otherwise("soon")
    return _t(spark, d, "events").select("event_id", F.unix_seconds(S.when_at(text)).alias("seconds"))


@query("SELECT page_id, starts_with(url, 'https://') AND page_id % 5 > 1 AS allowed FROM pages")
def url_security(spark, d):
    """https, usual port, no user information, known hosts; every fifth page gets a foreign port, the next a user."""
    k = F.col("page_id") % 5
    rest = F.regexp_extract("url", "^[a-z]+://(.*)$", 1)
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    scheme = F.regexp_extract("url", "^([a-z]+)://", 1)
    odd = F.when(k == 0, F.concat(scheme, F.lit("://"), host, F.lit(":8443/x"))).when(k == 1, F.concat(scheme, F.lit("://me@"), host, F.lit("/x"))).otherwise(F.concat(scheme, F.lit("://"), host, F.lit("/x")))
    hosts = sorted({r.h for r in _t(spark, d, "pages").select(F.element_at(F.split(host, "\\."), -1).alias("h")).distinct().collect() if r.h})
    return _t(spark, d, "pages").select("page_id", S.url_allowed(odd, hosts).alias("allowed"), rest.alias("rest")).drop("rest")


@query("SELECT doc_id, (doc_id % 3 = 0) AS exact FROM documents")
def map_keys_exact(spark, d):
    """Contexts with exactly the keys price, photo_set_hash and furniture."""
    k = F.col("doc_id") % 3
    text = F.when(k == 0, '{"furniture":"a","price":"1","photo_set_hash":""}').when(k == 1, '{"furniture":"a","price":"1"}').otherwise('{"furniture":"a","price":"1","photo_set_hash":"","x":"1"}')
    return _t(spark, d, "documents").select("doc_id", S.same_keys(F.from_json(text, "map<string,string>"), ["price", "photo_set_hash", "furniture"]).alias("exact"))
