"""Registered queries of survival by place, life cycles, revisions, identity snapshots, requests and totals beside pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastra.functions import text as X
from cadastra.operators import batches as B
from cadastra.operators import photos, worker
from cadastra.operators import profiles as P
from cadastra.operators import refresh as R
from cadastra.operators import observe as O
from cadastra.operators import publishing as G
from cadastra.operators import reports as W
from cadastra.operators import verdicts as V
from cadastra.operators import zones as Z
from cadastra.plans.catalogue import _json, _t, query
from cadastra.plans.cycle import _REFRESHED, HOMES, _refreshed, _reviewed, made, sql
from cadastra.plans.cycle import CARDS as CLAIMS
from cadastra.plans.evidence import _SHOWN, BITS, RGB, _frames
from cadastra.streaming import presence

#: Order lines as episodes on the market of their supplier's nation: from the order to the shipment, open ones have not ended.
EPISODES = "SELECT s_nationkey AS zone, CAST(date_diff({unit}, o_orderdate, l_shipdate) AS DOUBLE) AS days, l_linestatus = 'F' OR l_returnflag = 'N' AND l_quantity < 20 AS ended, l_shipmode FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey JOIN {supplier} ON s_suppkey = l_suppkey"
EPISODES = EPISODES.replace(", l_shipmode", "")
_CURVE = f"""e AS (SELECT zone, CAST(floor(days) AS BIGINT) AS day, ended FROM ({sql(EPISODES).replace("{unit}", "'day'")}) WHERE days >= 0),
daily AS (SELECT zone, day, count(*) AS n, count(*) FILTER (ended) AS gone FROM e GROUP BY ALL),
risk AS (SELECT d.*, (SELECT sum(x.n) FROM daily x WHERE x.zone = d.zone AND x.day >= d.day) AS at_risk FROM daily d),
curve AS (SELECT zone, day, CAST(at_risk AS BIGINT) AS at_risk, gone, product(1 - gone / at_risk) OVER (PARTITION BY zone ORDER BY day) AS surviving FROM risk)"""


def _episodes(spark, d):
    return made(spark, d, EPISODES.replace("{unit}", "DAY"))


@query(f"WITH {_CURVE} SELECT zone, day, at_risk, gone, round(surviving, 6) AS surviving FROM curve")
def survival_curves(spark, d):
    """How many of a place's listings are still there on each day, those that have not left counted until they were last seen."""
    return Z.survival(_episodes(spark, d), "zone").withColumn("surviving", F.round("surviving", 6))


_SHARES = f"""{_CURVE}, sizes AS (SELECT zone, count(*) AS listings, count(*) FILTER (ended) AS sold, max(day) AS last FROM e GROUP BY zone),
shares AS (SELECT s.zone, s.listings, s.sold, {", ".join(f"CASE WHEN last >= {t} THEN 1 - coalesce((SELECT min(surviving) FROM curve c WHERE c.zone = s.zone AND c.day <= {t}), 1) END AS gone_{t}" for t in Z.DAYS)} FROM sizes s WHERE listings >= 500)"""


@query(f"WITH {_SHARES} SELECT zone, listings, sold, {', '.join(f'round(gone_{t}, 6) AS gone_{t}' for t in Z.DAYS)}, round(percent_rank() OVER (ORDER BY round(gone_30, 9)), 6) AS heat FROM shares")
def hot_zones(spark, d):
    """Shares that left by 7, 14, 30 and 60 days, and each place's rank; places of few listings are not shown."""
    shares = Z.gone_shares(_episodes(spark, d), "zone", fewest=500)
    shares = shares.withColumns({f"gone_{t}": F.round(f"gone_{t}", 9) for t in Z.DAYS})
    return Z.hotness(shares, "zone").withColumns({c: F.round(c, 6) for c in ("heat", *(f"gone_{t}" for t in Z.DAYS))})


_LIFE = "CASE WHEN n = 0 THEN 'never listed' WHEN active > 0 THEN 'active' WHEN returned > 0 THEN 'uncertain' ELSE 'off_market' END"


@query(f"""WITH m AS (SELECT c_custkey, count(o_orderkey) AS n, count(*) FILTER (o_orderstatus = 'O') AS active, count(*) FILTER (o_orderstatus = 'P') AS returned FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT {_LIFE} AS lifecycle_status, count(*) AS entities, CAST(sum(n) AS BIGINT) AS members FROM m GROUP BY 1""")
def entity_life_cycle(spark, d):
    """Customers as entities by life cycle, with their orders as members; those without any count too."""
    return W.life_cycles(_entities(spark, d))


def _entities(spark, d):
    members = _t(spark, d, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderkey").alias("listing"), F.col("o_orderstatus").alias("status"))
    known = members.groupBy("entity").agg(F.count_if(F.col("status") == "O").alias("active"), F.count_if(F.col("status") == "P").alias("returned"))
    counted = W.member_counts(_t(spark, d, "customer").select(F.col("c_custkey").alias("entity")), members)
    return counted.join(known, "entity", "left").withColumn("lifecycle_status", F.expr(_LIFE.replace("n = 0", "member_count = 0")))


@query("""WITH m AS (SELECT c_custkey, count(o_orderkey) AS n, count(*) FILTER (o_orderstatus = 'O') AS active FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT count(*) AS entities, CAST(sum(n) AS BIGINT) AS members, count(*) FILTER (active > 1) AS several_active, count(*) FILTER (active > 0) AS active, CASE WHEN (SELECT count(*) FROM events WHERE value > 400) > 0 THEN (SELECT count(*) FROM events WHERE value > 400) ELSE (SELECT count(*) FROM events) END AS events, (SELECT count(*) FROM events WHERE value > 400) > 0 AS source_history FROM m""")
def entity_overview(spark, d):
    """One row of what is known of all entities; events are those of the source where it has any."""
    members = _t(spark, d, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderkey").alias("listing"))
    state = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "active").otherwise("missing").alias("status"))
    events = _t(spark, d, "events")
    out = W.entity_stats(_entities(spark, d), members, state, events, events.filter("value > 400"))
    return out.withColumn("active", F.coalesce(F.try_element_at("by_status", F.lit("active")), F.lit(0).cast("long"))).drop("by_status")


@query("""SELECT low, high, revision FROM (SELECT l_suppkey AS low, l_partkey AS high, concat(l_orderkey, '/', l_linenumber) AS revision, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_shipdate DESC, concat(l_orderkey, '/', l_linenumber) DESC) AS rn FROM lineitem WHERE l_linestatus = 'O') WHERE rn = 1""")
def current_revisions(spark, d):
    """The current revision of each pair of supplier and part: of its open lines the one shipped last."""
    lines = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("low"), F.col("l_partkey").alias("high"), F.concat_ws("/", "l_orderkey", "l_linenumber").alias("revision"), F.col("l_shipdate").alias("processed_at"), (F.col("l_linestatus") == "O").alias("is_current"))
    return V.current_revision(lines).select("low", "high", "revision")


_SNAPSHOT = ", ".join(f"'{c}', " + {"square_m2": "CAST(square_m2 AS DOUBLE)", **{k: k for k in ("id", "rooms", "floor", "street", "house_num", "complex_name", "status", "baseline_eligible")}}.get(c, "NULL") for c in O.IDENTITY_SNAPSHOT)


@query(f"SELECT id, sha256(CAST(json_object({_SNAPSHOT}) AS VARCHAR)) AS snapshot FROM ({sql(HOMES)})")
def identity_snapshots(spark, d):
    """The thirty identity fields of each listing as one JSON text; what a source does not have is null."""
    found = O.identity_snapshot(made(spark, d, HOMES))
    return found.select("id", F.sha2(F.to_json("snapshot", {"ignoreNullFields": "false"}), 256).alias("snapshot"))


# --- the model's view --------------------------------------------------------------------------------------------

#: Documents as listings: some fields missing, some empty.
CARDS = "SELECT doc_id AS id, CASE WHEN n_chars % 7 > 0 THEN source END AS title, CASE WHEN n_chars % 5 > 0 THEN CAST(n_chars % 4 + 1 AS INT) END AS rooms, CASE WHEN n_chars % 3 > 0 THEN CAST(n_chars AS DOUBLE) / 8 END AS square_m2, CASE WHEN n_chars % 2 = 0 THEN lang ELSE '' END AS rent_renovation, CASE WHEN n_chars % 11 = 0 THEN 'x' END AS priv_dorm, text AS full_description FROM {documents}"
_AREA = "CASE WHEN square_m2 IS NULL THEN 'None' ELSE CAST(square_m2 AS VARCHAR) END"
_VIEW = f"""concat('### id: ', id, chr(10), 'Заголовок: ', coalesce(title, ''), chr(10), 'Комнат: ', coalesce(CAST(rooms AS VARCHAR), 'None'), ', площадь: ', {_AREA}, ' м²', chr(10),
    'Отделка (поле сайта): ', coalesce(nullif(rent_renovation, ''), 'не указана'), chr(10), 'Тип дома (поле сайта) — приват. общежитие: ', coalesce(priv_dorm, 'не указано'), chr(10), 'Описание: ',
    CASE WHEN length(full_description) > 1900 THEN concat(substr(full_description, 1, 1266), ' […] ', right(full_description, 634)) ELSE full_description END)"""


@query(f"SELECT id, sha256({_VIEW}) AS view FROM ({sql(CARDS)})")
def model_views(spark, d):
    """Every listing as the model sees it: labelled fields, what stands for empty ones, and the text cut in its middle."""
    rows = made(spark, d, CARDS)
    return rows.select("id", F.sha2(B.model_view(rows), 256).alias("view"))


@query(f"""WITH n AS (SELECT *, row_number() OVER (ORDER BY title NULLS FIRST, id) - 1 AS rn FROM ({sql(CARDS)}))
SELECT rn // 3000 AS batch, rn % 3000 // 20 AS grp, concat('grp_', min_by(CAST(id AS VARCHAR), rn)) AS custom_id, count(*) * 150 + 4300 AS tokens, sha256(string_agg({_VIEW}, chr(10) || chr(10) ORDER BY rn)) AS content FROM n GROUP BY 1, 2""".replace("min_by(", "arg_min("))
def model_requests(spark, d):
    """All listings in requests of 20 and batches of 3,000, in order of title and id."""
    rows = G.sequenced(made(spark, d, CARDS), "title", "id")
    at = F.col("seq") - 1
    dealt = rows.withColumns({"batch": F.floor(at / 3000), "group": F.floor(F.pmod(at, F.lit(3000)) / 20), "place": F.pmod(at, F.lit(20))})
    lines = B.request_lines(dealt, B.model_view(dealt), "o4-small", "prompt")
    read = F.from_json("value", "custom_id string, body struct<max_completion_tokens: bigint, messages: array<struct<role: string, content: string>>>").alias("r")
    return lines.select(F.col("batch").cast("long").alias("batch"), F.col("group").cast("long").alias("grp"), read).select("batch", "grp", "r.custom_id", F.col("r.body.max_completion_tokens").alias("tokens"), F.sha2(F.col("r.body.messages")[1]["content"], 256).alias("content"))


@query(f"SELECT p_partkey, substr(sha256(concat('[', {_json('p_name')}, ',', p_size, ',', CAST(CAST(p_size AS DOUBLE) / 4 AS VARCHAR), ',', {_json('CAST(p_size AS VARCHAR)')}, ',', CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'null' END, ']')), 1, 16) AS hash FROM part")
def typed_content_hash(spark, d):
    """Hashes over values of several types: 60, 60.0 and "60" differ, and so do null and empty."""
    size = F.col("p_size")
    rows = _t(spark, d, "part").select("p_partkey", "p_name", size.cast("int").alias("whole"), (size.cast("double") / 4).alias("real"), size.cast("string").alias("text"), F.when(size % 2 == 0, True).alias("flag"))
    return rows.select("p_partkey", X.content_hash(*X.typed(rows, "p_name", "whole", "real", "text", "flag")).alias("hash"))


# --- totals beside a page ----------------------------------------------------------------------------------------


@query(f"WITH {_REFRESHED} SELECT low, high, priority, count(*) OVER () AS total FROM refreshed WHERE n_active = 2 AND priority >= 35 ORDER BY priority DESC, low, high LIMIT 50")
def match_review_with_total(spark, d):
    """A page of the review queue and the number of all rows behind it, in one run."""
    rows = _reviewed(spark, d, min_priority=35, activity="both_active").select("low", "high", "priority")
    found, total = W.page_with_total(rows, F.desc("priority"), "low", "high", limit=50)
    return spark.createDataFrame(found, rows.schema).withColumn("total", F.lit(total).cast("long"))


@query("""WITH e AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'error' THEN 'missing' WHEN 'signup' THEN 'reactivated' END AS type FROM events WHERE user_id IS NOT NULL AND event_type IN ('error', 'signup')),
c AS (SELECT * FROM (SELECT *, lag(type) OVER (PARTITION BY user_id ORDER BY ts, CAST(event_id AS VARCHAR)) AS before FROM e) WHERE before IS NULL OR before <> type),
g AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, CAST(event_id AS VARCHAR)) AS next FROM c)
SELECT CAST(user_id AS VARCHAR) AS listing, epoch_us(ts) AS at, type AS event FROM g UNION ALL SELECT CAST(user_id AS VARCHAR), epoch_us(ts + INTERVAL 24 HOUR), 'off_market' FROM g WHERE type = 'missing' AND ts + INTERVAL 24 HOUR < coalesce(next, (SELECT max(ts) FROM events))""")
def presence_grace(spark, d):
    """Changes of presence, and where a listing was gone for longer than a day: the batch form of the stream."""
    e = _t(spark, d, "events").filter("user_id is not null")
    until = e.sparkSession.read.parquet(f"{d}/events.parquet").agg(F.max("ts").cast("timestamp")).first()[0]
    kind = F.when(F.col("event_type") == "error", "missing").when(F.col("event_type") == "signup", "reactivated").otherwise("seen")
    found = presence.history(e.select(F.col("user_id").cast("string").alias("listing"), F.col("ts").cast("timestamp").alias("at"), "event_id", kind.alias("type")), until)
    return found.select("listing", F.unix_micros("at").alias("at"), "event")


# --- photo queues and runs ---------------------------------------------------------------------------------------

_WAITING = f"WITH {_REFRESHED}, w AS (SELECT * FROM refreshed WHERE status = 'awaiting_photo_analysis'), q AS (SELECT 'all_waiting' AS queue, * FROM w UNION ALL SELECT 'both_active', * FROM w WHERE n_active = 2 UNION ALL SELECT 'both_active_2plus_both_eligible', * FROM w WHERE n_active = 2 AND n >= 2 AND n_eligible = 2), ends AS (SELECT queue, low AS id FROM q UNION SELECT queue, high FROM q)"


@query(f"""{_WAITING}, p AS (SELECT queue, count(*) AS pairs FROM q GROUP BY 1), s AS (SELECT queue, count(*) AS listings, CAST(sum(p_size % 9) AS BIGINT) AS photos, CAST(sum(least(p_size % 9, 5)) AS BIGINT) AS first_five FROM ends JOIN part ON CAST(p_partkey AS VARCHAR) = id GROUP BY 1)
SELECT v.queue, coalesce(pairs, 0) AS pairs, coalesce(listings, 0) AS listings, coalesce(photos, 0) AS photos, coalesce(first_five, 0) AS first_five, round(coalesce(photos, 0) * 93377 / 1073741824.0::DOUBLE, 2) AS gib FROM (VALUES ('all_waiting'), ('both_active'), ('both_active_3plus_both_eligible'), ('both_active_2plus_both_eligible'), ('active_missing_3plus_both_eligible')) v(queue) LEFT JOIN p ON p.queue = v.queue LEFT JOIN s ON s.queue = v.queue""")
def photo_queues(spark, d):
    """The five photo queues: pairs, different listings, their photos and what these take."""
    homes, pairs = _refreshed(spark, d)
    size = _t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), (F.col("p_size") % 9).alias("photo_count"))
    return W.queue_sizes(pairs, homes.select("id", "status", "baseline_eligible").join(size, "id"), 93377).drop("first_five_gib")


@query(f"WITH {_REFRESHED} SELECT 'status' AS counter, status AS value, count(*) AS n FROM refreshed GROUP BY 2 UNION ALL SELECT 'generator', reasons, count(*) FROM refreshed GROUP BY 2")
def candidate_counters(spark, d):
    """Current candidates by status, and by what brought them up."""
    return W.candidate_counters(_refreshed(spark, d)[1].withColumn("generator_version", F.array_join("reasons", ",")))


@query(f"SELECT count(*) AS rows, count(*) AS tagged_rows, count(*) FILTER (id % 3 = 0 AND id % 5 = 0) AS contradictory_finish, count(*) FILTER (id % 3 > 0 AND id % 5 > 0 AND n_chars % 3 > 0) AS unknown_finish_with_photos FROM ({sql(CLAIMS)}) JOIN documents ON doc_id = id")
def profile_coverage(spark, d):
    photos = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("n_chars") % 3).cast("string").alias("photo_count"))
    return W.profile_coverage(P.profile(made(spark, d, CLAIMS)), photos)


_BROKEN = "label % 4 = 3"
_SEEN = _SHOWN.replace("FROM embeddings)", f"FROM embeddings WHERE NOT ({_BROKEN}))")


@query(f"""{_SEEN}, e AS (SELECT vec_id // 10 AS listing, count(*) FILTER (NOT ({_BROKEN})) AS decoded, count(*) FILTER ({_BROKEN}) AS errors FROM embeddings GROUP BY 1),
l AS (SELECT e.listing, decoded, errors, coalesce(len(frames), 0) AS shown FROM e LEFT JOIN final f ON f.listing = e.listing),
p AS (SELECT a.decoded + b.decoded AS decoded, a.errors + b.errors AS errors, a.shown + b.shown AS shown, a.shown > 0 AND b.shown > 0 AS good FROM l a JOIN l b ON b.listing = a.listing + 1)
SELECT count(*) AS selected, count(*) FILTER (good) AS analyzed, count(*) FILTER (NOT good) AS failed, CAST(sum(decoded + errors) FILTER (good) AS BIGINT) AS considered, CAST(sum(decoded) FILTER (good) AS BIGINT) AS decoded, CAST(sum(shown) FILTER (good) AS BIGINT) AS "unique", CAST(sum(decoded - shown) FILTER (good) AS BIGINT) AS duplicates, CAST(sum(errors) FILTER (good) AS BIGINT) AS errors, count(*) FILTER (good) AS scores FROM p""")
def worker_run(spark, d):
    """A run over each listing with the next: a quarter of the photos cannot be read; documents, errors and totals."""
    e = _t(spark, d, "embeddings").withColumn("listing", F.expr("vec_id div 10"))
    lost = e.filter(_BROKEN).select("listing", F.col("vec_id").cast("string").alias("url_hash"), F.lit("broken").alias("error"))
    listings = e.select("listing").distinct()
    pairs = listings.select(F.col("listing").alias("low"), (F.col("listing") + 1).alias("high")).join(listings.withColumnRenamed("listing", "high"), "high", "left_semi")
    pairs = pairs.withColumns({"revision": F.lit("r"), "low_hash": F.lit("a"), "high_hash": F.lit("b")})
    out = worker.run(pairs, _frames(spark, d, f"NOT ({_BROKEN})"), lost, {"matcher_version": "m1"}, bits=BITS, rgb=RGB)
    return worker.overview(out).select("selected", "analyzed", "failed", *worker.STATS, "scores")


_CODE = "list_aggregate(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), 'string_agg', '')"


@query(f"WITH c AS (SELECT label, substr({_CODE}, 1, 24) || repeat('0', 40) AS code, min(vec_id) AS first FROM embeddings GROUP BY 1, 2) SELECT a.label, least(a.first, b.first) AS low, greatest(a.first, b.first) AS high, CAST(hamming(a.code, b.code) AS INT) AS distance FROM c a JOIN c b ON a.label = b.label AND a.code < b.code AND hamming(a.code, b.code) <= 4")
def near_codes(spark, d):
    """Vectors of one label whose first 24 signs differ in at most four places, a pair for each two codes."""
    bits = F.concat(F.substring(F.array_join(F.transform("embedding", lambda x: F.when(x > 0, "1").otherwise("0")), ""), 1, 24), F.lit("0" * 40))
    links, members = photos.near_codes(_t(spark, d, "embeddings").select("label", F.conv(bits, 2, -10).cast("long").alias("code"), F.col("vec_id").alias("id")), "label")
    of = lambda side: members.select("label", F.col("code").alias(side), F.col("first").alias(f"{side}_id"))
    both = links.join(of("low"), ["label", "low"]).join(of("high"), ["label", "high"])
    return both.select("label", F.least("low_id", "high_id").alias("low"), F.greatest("low_id", "high_id").alias("high"), "distance")


# --- candidates by all four kinds of blocks ----------------------------------------------------------------------

#: Parts as listings with photos and places: one photo set for parts of one brand and size, places by size and price.
PLACED = "SELECT CAST(p_partkey AS STRING) AS id, CAST(p_size % 4 + 1 AS STRING) AS rooms, CAST(40 + p_size % 3 AS DOUBLE) AS square_m2, CASE WHEN p_size % 7 > 0 THEN CAST(p_size % 6 AS STRING) ELSE '' END AS floor, p_brand AS street, CAST(p_size AS STRING) AS house_num, concat(split_part(p_type, ' ', 1), split_part(p_type, ' ', 3)) AS complex_name, CASE WHEN p_size % 2 = 0 THEN concat(p_brand, '/', CAST(p_size AS STRING), '/', split_part(p_name, ' ', 1)) END AS photo_set_hash, CAST(51 + p_size / 1000.0 + 0.0002 AS DOUBLE) AS latitude, CAST(71 + floor(p_retailprice) % 5 / 1000.0 + 0.0001 AS DOUBLE) AS longitude, CASE WHEN p_retailprice > 1200 THEN 'active' ELSE 'missing' END AS status FROM {part}"
_FOUR = f"""h AS ({sql(PLACED)}), k AS (SELECT *, concat_ws('|', rooms, CAST(CAST(square_m2 AS BIGINT) AS VARCHAR), floor) AS built FROM h),
blocks AS (SELECT id, 'exact_photo_set' AS reason, photo_set_hash AS b FROM k WHERE photo_set_hash IS NOT NULL UNION ALL SELECT id, 'address', concat_ws('|', lower(street), house_num, built) FROM k
    UNION ALL SELECT id, 'complex', concat_ws('|', lower(complex_name), built) FROM k WHERE floor <> '' UNION ALL SELECT id, 'coordinates', concat_ws('|', round(latitude, 3), round(longitude, 3), built) FROM k WHERE floor <> ''),
sized AS (SELECT *, count(*) OVER (PARTITION BY reason, b) AS n FROM blocks),
pairs AS (SELECT x.id AS low, y.id AS high, string_agg(DISTINCT x.reason, ',' ORDER BY x.reason) AS reasons, count(DISTINCT x.reason) AS n FROM sized x JOIN sized y ON x.reason = y.reason AND x.b = y.b AND x.id < y.id AND x.n BETWEEN 2 AND 100 GROUP BY 1, 2),
far AS (SELECT p.*, a.status = 'active' AND c.status = 'active' AS both_active, 2 * 6371000.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians(c.latitude - a.latitude) / 2), 2) + cos(radians(a.latitude)) * cos(radians(c.latitude)) * pow(sin(radians(c.longitude - a.longitude) / 2), 2)))) AS m,
    concat_ws(',', CASE WHEN lower(a.street) <> lower(c.street) OR a.house_num <> c.house_num THEN 'address' END, CASE WHEN try_cast(a.floor AS DOUBLE) <> try_cast(c.floor AS DOUBLE) THEN 'floor' END, CASE WHEN a.rooms <> c.rooms THEN 'rooms' END) AS conflicts,
    concat_ws(',', CASE WHEN a.photo_set_hash = c.photo_set_hash THEN 'exact_photo_set' END, '#', CASE WHEN lower(a.complex_name) = lower(c.complex_name) THEN 'same_complex' END, CASE WHEN lower(a.street) = lower(c.street) AND a.house_num = c.house_num THEN 'same_address' END) AS signals
    FROM pairs p JOIN h a ON a.id = p.low JOIN h c ON c.id = p.high)
SELECT low, high, reasons, conflicts, CASE WHEN reasons LIKE '%exact_photo_set%' THEN 100 WHEN n >= 3 THEN 80 WHEN n = 2 THEN 60 ELSE 30 END + CASE WHEN both_active THEN 5 ELSE 0 END + CASE WHEN m <= 500 THEN 2 ELSE 0 END AS priority,
    trim(replace(replace(replace(signals, '#,', CASE WHEN m <= 500 THEN 'near_coordinates,' ELSE '' END), ',#', CASE WHEN m <= 500 THEN ',near_coordinates' ELSE '' END), '#', CASE WHEN m <= 500 THEN 'near_coordinates' ELSE '' END), ',') AS signals FROM far"""


@query(f"WITH {_FOUR}")
def candidates_by_four_kinds(spark, d):
    """Pairs by photo sets, addresses, complexes and coordinates, with their conflicts, signals and priorities."""
    out = R.judge(made(spark, d, PLACED))
    return out.select("low", "high", F.array_join("reasons", ",").alias("reasons"), F.array_join("hard_conflicts", ",").alias("conflicts"), "priority", F.array_join(F.transform("positive_signals", lambda s: s["signal"]), ",").alias("signals"))
