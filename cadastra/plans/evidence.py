"""Registered queries of photo evidence, entities, model answers and assessments, with their SQL twins.

Ten vectors in a row are a listing's photos: their signs are the structure bits, their first components the colours.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastra.functions import text as X
from cadastra.operators import assessments as A
from cadastra.operators import candidates as C
from cadastra.operators import entities as E
from cadastra.operators import history as H
from cadastra.operators import merging as M
from cadastra.operators import photos as P
from cadastra.operators import verdicts as V
from cadastra.plans.catalogue import _PAIRS, _states, _t, query
from cadastra.sources import snapshot

# --- photos ------------------------------------------------------------------------------------------------------

BITS, RGB = 28, 0.5

_FRAMES = """f AS (SELECT vec_id // 10 AS listing, row_number() OVER (PARTITION BY vec_id // 10 ORDER BY vec_id) AS pos, vec_id AS photo, concat(label, '-', vec_id % 3) AS sha,
    list_aggregate(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), 'string_agg', '') AS signs,
    list_transform(embedding[1:12], lambda x: CAST(((CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) % 256) + 256) % 256 AS BIGINT)) AS rgb FROM embeddings)"""
_FAR = "least(1.0::DOUBLE, sqrt(list_sum(list_transform(list_zip({a}.rgb, {b}.rgb), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::DOUBLE / len({b}.rgb)) / 255.0::DOUBLE)"
_LIKE = "(0.75::DOUBLE * (1 - hamming(a.signs, b.signs) / 64.0::DOUBLE) + 0.25::DOUBLE * (1 - " + _FAR.format(a="a", b="b") + "))"
_KEPT = f"""WITH RECURSIVE {_FRAMES},
kept(listing, n, frames) AS (
    SELECT DISTINCT listing, 0::BIGINT, []::STRUCT(photo BIGINT, sha VARCHAR, signs VARCHAR, rgb BIGINT[])[] FROM f
    UNION ALL SELECT s.listing, f.pos, CASE WHEN len(list_filter(s.frames, lambda k: k.sha = f.sha OR (hamming(k.signs, f.signs) <= {BITS} AND {_FAR.format(a="k", b="f")} <= {RGB}))) > 0
        THEN s.frames ELSE list_append(s.frames, {{'photo': f.photo, 'sha': f.sha, 'signs': f.signs, 'rgb': f.rgb}}) END
    FROM kept s JOIN f ON f.listing = s.listing AND f.pos = s.n + 1)"""
_MATCHES = f"""WITH RECURSIVE {_FRAMES},
possible AS (SELECT a.listing AS low, b.listing AS high, a.photo AS l, b.photo AS r, {_LIKE} AS s FROM f a JOIN f b ON b.listing = a.listing + 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY low ORDER BY s DESC, l, r) AS n FROM possible),
chosen(low, n, used, matches) AS (
    SELECT DISTINCT low, 0::BIGINT, []::BIGINT[], []::STRUCT(l BIGINT, r BIGINT, s DOUBLE)[] FROM ranked
    UNION ALL SELECT c.low, k.n, CASE WHEN list_has_any(c.used, [k.l, k.r]) THEN c.used ELSE list_concat(c.used, [k.l, k.r]) END,
        CASE WHEN list_has_any(c.used, [k.l, k.r]) THEN c.matches ELSE list_append(c.matches, {{'l': k.l, 'r': k.r, 's': k.s}}) END
    FROM chosen c JOIN ranked k ON k.low = c.low AND k.n = c.n + 1),
final AS (SELECT low, arg_max(matches, n) AS matches FROM chosen GROUP BY low),
matched AS (SELECT low, unnest(matches) AS m, unnest(range(len(matches))) AS place FROM final),
scores AS (SELECT low, low + 1 AS high, round(avg(round(m.s, 6)), 6) AS score FROM matched WHERE place < 3 GROUP BY low)"""


def _frames(spark, d, only="true"):
    e = _t(spark, d, "embeddings").filter(only).withColumn("listing", F.expr("vec_id div 10"))
    sign = F.array_join(F.transform("embedding", lambda x: F.when(x > 0, "1").otherwise("0")), "")
    colours = F.transform(F.slice("embedding", 1, 12), lambda x: F.pmod(F.floor(1024 * x.cast("double")), F.lit(256)).cast("long"))
    return P.numbered(e, "listing", "vec_id").select(
        "listing", "pos", F.col("vec_id").alias("photo"), F.concat_ws("-", "label", F.col("vec_id") % 3).alias("sha"), F.conv(sign, 2, -10).cast("long").alias("bits"), colours.alias("rgb")
    )


def _matches(spark, d):
    """Matches of each listing with the next."""
    whole = _frames(spark, d).groupBy("listing").agg(F.array_sort(F.collect_list(F.struct("pos", "photo", "bits", "rgb"))).alias("frames"))
    low, high = whole.select(F.col("listing").alias("low"), F.col("frames").alias("left")), whole.select((F.col("listing") - 1).alias("low"), F.col("listing").alias("high"), F.col("frames").alias("right"))
    return P.matched(low.join(high, "low"))


@query(f"{_KEPT} SELECT listing, unnest(list_transform(arg_max(frames, n), lambda k: k.photo)) AS photo FROM kept GROUP BY listing")
def near_duplicate_greedy(spark, d):
    return P.dedupe(_frames(spark, d), BITS, RGB).select("listing", F.explode("frames.photo").alias("photo"))


@query(f"WITH {_FRAMES} SELECT a.photo AS low, b.photo AS high, round({_LIKE}, 6) AS similarity FROM f a JOIN f b ON a.listing = b.listing AND a.pos < b.pos")
def vector_similarity_pairs(spark, d):
    """Similarity of the photos of one listing."""
    a, b = (_frames(spark, d).select("listing", F.struct("pos", "photo", "bits", "rgb").alias(side)) for side in "ab")
    return a.join(b, "listing").filter("a.pos < b.pos").select(F.col("a.photo").alias("low"), F.col("b.photo").alias("high"), F.round(P.similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query(f"{_MATCHES} SELECT low, low + 1 AS high, m.l AS left_photo, m.r AS right_photo, round(m.s, 6) AS similarity FROM matched")
def one_to_one_match(spark, d):
    return _matches(spark, d).drop("place")


@query(f"{_MATCHES} SELECT low, high, score FROM scores")
def top3_mean_score(spark, d):
    return P.top_mean(_matches(spark, d))


@query(f"""{_MATCHES} SELECT count(*) AS pairs, min(score) AS lowest, round(median(score), 6) AS middle, max(score) AS highest,
    count(*) FILTER (score >= 0.9) AS at_least_90, count(*) FILTER (score >= 0.98) AS at_least_98, count(*) FILTER (score < 0.7) AS under_70 FROM scores""")
def score_summary(spark, d):
    return P.summary(P.top_mean(_matches(spark, d)))


# --- entities ----------------------------------------------------------------------------------------------------

_MEMBERS = "SELECT p_partkey AS listing, p_partkey - p_partkey % 10 + least(p_partkey % 10, p_size % 4) AS entity, p_size AS created_at FROM part"
_MOVED = "p_size % 10 < 3 OR (p_size % 10 < 6 AND p_partkey % 2 = 0)"


def _members(spark, d):
    decade = F.col("p_partkey") - F.col("p_partkey") % 10
    return _t(spark, d, "part").select(F.col("p_partkey").alias("listing"), (decade + F.least(F.col("p_partkey") % 10, F.col("p_size") % 4)).alias("entity"), F.col("p_size").alias("created_at"))


@query(f"""WITH m AS ({_MEMBERS}), e AS (SELECT entity, count(*) AS n, min(created_at) AS since FROM m GROUP BY entity),
pairs AS (SELECT a.entity AS x, b.entity AS y FROM m a JOIN m b ON a.listing % 10 = 0 AND b.listing = a.listing + 9 AND a.entity <> b.entity),
sides AS (SELECT x, y, p.n AS xn, q.n AS yn, (p.n > q.n OR (p.n = q.n AND (p.since < q.since OR (p.since = q.since AND x < y)))) AS first FROM pairs JOIN e p ON p.entity = x JOIN e q ON q.entity = y)
SELECT CASE WHEN first THEN y ELSE x END AS absorbed, CASE WHEN first THEN x ELSE y END AS survivor, CASE WHEN first THEN yn ELSE xn END AS moved FROM sides""")
def merge_survivor(spark, d):
    members = _members(spark, d)
    asked = members.filter("listing % 10 = 0").select(F.col("listing").alias("place"), F.col("listing").alias("a"), (F.col("listing") + 9).alias("b"), F.lit("r").alias("revision"))
    # whole numbers as ids and times: ordered as numbers
    padded = lambda c: F.lpad(F.col(c).cast("string"), 20, "0")
    steps = M.merge_steps(members.withColumn("created_at", padded("created_at")), asked, spark.createDataFrame([], "key string"), order=padded("entity"))
    return M.merged(steps).select(*(F.col(c).cast(members.schema["entity"].dataType).alias(c) for c in ("absorbed", "survivor")), "moved")


@query(f"SELECT alias, CASE WHEN m = n THEN 'child' WHEN m > 0 THEN 'split_ambiguous' ELSE 'kept' END AS outcome FROM (SELECT concat(p_brand, '|', p_size % 10) AS alias, count(*) AS n, count(*) FILTER ({_MOVED}) AS m FROM part GROUP BY 1)")
def split_alias_redirect(spark, d):
    part = _t(spark, d, "part")
    history = part.select(F.concat_ws("|", "p_brand", F.col("p_size") % 10).alias("alias"), F.col("p_partkey").alias("listing"))
    return E.redirect_aliases(history, part.filter(_MOVED).select(F.col("p_partkey").alias("listing")))


@query("""WITH m AS (SELECT o_custkey AS entity, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS members FROM orders GROUP BY 1), v AS (SELECT user_id AS entity, count(*) AS n FROM events GROUP BY 1)
SELECT m.entity, members, coalesce(n, 0) AS n_events FROM m LEFT JOIN v ON v.entity = m.entity""")
def entity_detail(spark, d):
    members = _t(spark, d, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderkey").alias("listing"))
    out = E.detail(members, _t(spark, d, "events").select(F.col("user_id").alias("entity"), F.col("ts").alias("at")))
    return out.select("entity", F.array_join("members", ",").alias("members"), "n_events")


_FIRST = "SELECT l_partkey, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice, l_orderkey DESC, l_linenumber DESC) AS rn FROM lineitem WHERE l_extendedprice > 0 AND l_shipdate < TIMESTAMP '{day}') WHERE rn = 1"


@query(f"WITH o AS ({_FIRST.format(day='1996-01-01')}), n AS ({_FIRST.format(day='2100-01-01')}) SELECT n.l_partkey, o.l_orderkey AS before, n.l_orderkey AS after FROM n LEFT JOIN o ON o.l_partkey = n.l_partkey WHERE o.l_orderkey IS DISTINCT FROM n.l_orderkey")
def canonical_switches(spark, d):
    """Entities whose canonical row differs between two versions of the listings."""
    rows = _t(spark, d, "lineitem").filter("l_extendedprice > 0")
    pick = lambda df, name: H.canonical(df, "l_partkey", F.lit(True), F.col("l_extendedprice"), F.lit(False), [F.desc("l_orderkey"), F.desc("l_linenumber")]).select("l_partkey", F.col("l_orderkey").alias(name))
    both = pick(rows, "after").join(pick(rows.filter("l_shipdate < timestamp_ntz'1996-01-01'"), "before"), "l_partkey", "left")
    return both.filter(~F.col("before").eqNullSafe(F.col("after"))).select("l_partkey", "before", "after")


# --- queues and pages --------------------------------------------------------------------------------------------


@query(f"""{_PAIRS}, ends AS (SELECT status, low AS id FROM states UNION SELECT status, high FROM states)
SELECT status, count(*) AS listings, CAST(sum(p_size) AS BIGINT) AS photos, CAST(sum(least(5, p_size)) AS BIGINT) AS first_five FROM ends JOIN part ON p_partkey = id GROUP BY status""")
def queue_sizing(spark, d):
    """Distinct listings and their photos (p_size) in the queue of each status."""
    states = _states(spark, d)
    ends = states.select("status", F.explode(F.array("low", "high")).alias("id")).distinct()
    each = ends.join(_t(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size"), "id")
    return each.groupBy("status").agg(F.count("*").alias("listings"), F.sum("p_size").cast("long").alias("photos"), F.sum(F.least(F.lit(5), "p_size")).cast("long").alias("first_five"))


@query(f"""{_PAIRS}, spot AS (SELECT id, radians(40 + (id % 100) / 1000.0::DOUBLE) AS lat, radians(44 + (id % 37) / 1000.0::DOUBLE) AS lon FROM listing),
far AS (SELECT low, high, 2 * 6371000.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin((b.lat - a.lat) / 2), 2) + cos(a.lat) * cos(b.lat) * pow(sin((b.lon - a.lon) / 2), 2)))) AS m FROM pairs JOIN spot a ON a.id = low JOIN spot b ON b.id = high)
SELECT low, high, round(m, 1) AS distance_m FROM far WHERE m <= 500""")
def pair_signals(spark, d):
    """Candidate pairs that lie within 500 m."""
    spot = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), (40 + F.col("p_partkey") % 100 / 1000.0).alias("lat"), (44 + F.col("p_partkey") % 37 / 1000.0).alias("lon"))
    pairs = C.with_sides(_states(spark, d).select("low", "high"), spot)
    far = C.distance_m(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    return pairs.filter(far <= 500).select("low", "high", F.round(far, 1).alias("distance_m"))


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id > 100 ORDER BY doc_id LIMIT 50")
def seq_page(spark, d):
    """The page of 50 rows after a position."""
    return _t(spark, d, "documents").select("doc_id", "lang", "n_chars").filter("doc_id > 100").orderBy("doc_id").limit(50)


# --- model answers and assessments -------------------------------------------------------------------------------


@query("""SELECT CAST(doc_id AS VARCHAR) AS listing_id, CASE WHEN bad THEN NULL ELSE doc_id % 2 = 0 END AS usable, CASE WHEN bad THEN 'llm_failed' WHEN doc_id % 2 = 0 THEN 'ok' ELSE 'not_sale' END AS reason_code,
    CASE WHEN bad THEN 'llm_failed' ELSE 'llm' END AS source
FROM (SELECT doc_id, doc_id % 11 = 0 OR doc_id % 7 = 0 OR doc_id % 5 = 0 OR (doc_id // 20) % 13 = 0 AS bad FROM documents)""")
def llm_output_parse(spark, d):
    """Answers made from the documents: every 11th item is missing, every 7th contradicts itself, every 5th is null, every 13th answer is broken."""
    docs = _t(spark, d, "documents").select("doc_id", F.expr("doc_id div 20").alias("group"))
    good = F.col("doc_id") % 2 == 0
    code = F.when(F.col("doc_id") % 7 == 0, "partial_property").when(good, "ok").otherwise("not_sale")
    usable = good | (F.col("doc_id") % 7 == 0)
    item = F.to_json(F.struct(F.col("doc_id").alias("id"), usable.alias("usable"), code.alias("reason_code"), F.lit("high").alias("confidence"), F.when(good, "").otherwise("why").alias("reason")))
    items = docs.filter("doc_id % 11 <> 0").withColumn("item", F.when(F.col("doc_id") % 5 == 0, "null").otherwise(item)).groupBy("group").agg(F.collect_list("item").alias("items"))
    content = F.concat(F.lit('{"verdicts":['), F.array_join("items", ","), F.when(F.col("group") % 13 == 0, "").otherwise("]}"))
    message = F.struct(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices")).alias("body"))
    lines = items.select(F.to_json(F.struct(F.col("group").cast("string").alias("custom_id"), message.alias("response"))).alias("value"))
    out = A.parse_outputs(lines, docs.select(F.col("group").cast("string").alias("custom_id"), F.col("doc_id").alias("listing_id")))
    return out.select("listing_id", "usable", "reason_code", "source")


@query("SELECT doc_id AS id FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 5 <> 0 AND doc_id % 3 <> 0 AND regexp_matches(left(text, 40), '\\S')")
def assessment_reuse(spark, d):
    """Assessments made from the documents: every 7th is of another hash, every 5th quotes what is not there, every 3rd has another price."""
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.sha2("text", 256).alias("content_hash"), F.col("n_chars").alias("price"), F.lit(None).cast("string").alias("furniture"))
    i = F.col("id")
    old = docs.withColumns({
        "content_hash": F.when(i % 7 == 0, "other").otherwise(F.col("content_hash")), "evidence": F.when(i % 5 == 0, "☃ not there").otherwise(F.substring("text", 1, 40)),
        "price": F.when(i % 3 == 0, F.col("price") + 1).otherwise(F.col("price")), "version": F.lit("v1"), "usable": F.lit(True), "reason_code": F.lit("ok"),
    }).drop("text")
    return A.reusable(docs, old, "v1", ["price", "furniture"]).select("id")


@query("""SELECT state, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 5 = 0 OR p_partkey % 7 = 0 OR p_partkey % 11 = 0 THEN 'invalid' WHEN p_partkey % 3 = 0 OR p_partkey % 2 = 0 THEN 'stale' ELSE 'accepted' END AS state FROM part) GROUP BY state""")
def evidence_stale_check(spark, d):
    """Evidence on each part: some of no known decision, score or version, some of another revision, some without a current pair."""
    k = F.col("p_partkey")
    part = _t(spark, d, "part").select(k.alias("low"), (k + 1).alias("high"), F.sha2(F.col("p_name"), 256).alias("revision"))
    k = F.col("low")
    incoming = part.withColumns({
        "revision": F.when(k % 3 == 0, "old").otherwise(F.col("revision")), "decision": F.when(k % 5 == 0, "maybe").otherwise("uncertain"),
        "score": F.when(k % 7 == 0, 1.5).otherwise(0.5), "matcher": F.when(k % 11 == 0, "").otherwise("m1"),
    })
    return A.judge_evidence(incoming, part.filter("low % 2 <> 0"), ["matcher"]).groupBy("state").agg(F.count("*").alias("n"))


# --- profiles, comparability, photo urls -------------------------------------------------------------------------

_CODES = {"license": "(?i)licen[cs]e", "phone": "\\+[0-9]", "contact": "@", "number": "[0-9]{3}"}
_CODED = """SELECT doc_id, unnest(list_filter([CASE WHEN contains(text, '@') THEN 'contact' END, CASE WHEN regexp_matches(text, '(?i)licen[cs]e') THEN 'license' END,
    CASE WHEN regexp_matches(text, '[0-9]{3}') THEN 'number' END, CASE WHEN regexp_matches(text, '\\+[0-9]') THEN 'phone' END], lambda c: c IS NOT NULL)) AS code FROM documents"""


@query("""SELECT doc_id, coalesce(m <> '' AND NOT regexp_matches(right(left(text, strpos(text, m) - 1), 20), '(^|[^a-z])(the|a|this|la|de)\\s+$'), false) AS claimed
FROM (SELECT doc_id, text, regexp_extract(text, '[Ll]icen[cs]e') AS m FROM documents)""")
def profile_negation(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.unnegated(F.col("text"), "[Ll]icen[cs]e", "(^|[^a-z])(the|a|this|la|de)\\s+").alias("claimed"))


@query(f"SELECT doc_id, string_agg(code, ',' ORDER BY code) AS conflict FROM ({_CODED}) WHERE code IN ('contact', 'phone', 'number') GROUP BY doc_id HAVING count(*) > 1")
def profile_conflicts(spark, d):
    found = _t(spark, d, "documents").select("doc_id", X.family_conflict(X.claims(F.col("text"), _CODES), ["contact", "phone", "number"]).alias("conflict"))
    return found.filter(F.size("conflict") > 0).withColumn("conflict", F.array_join("conflict", ","))


@query(f"SELECT code, count(*) AS n, array_to_string(list_sort(list(doc_id))[1:3], ',') AS examples FROM ({_CODED}) GROUP BY code")
def profile_audit(spark, d):
    coded = _t(spark, d, "documents").select("doc_id", X.claims(F.col("text"), _CODES).alias("codes"))
    return V.audit(coded, "doc_id", "codes").withColumn("examples", F.array_join("examples", ","))


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey % 4 < 2 AND s_nationkey % 2 = 0")
def comparable_filter(spark, d):
    k = F.col("s_suppkey") % 4
    rows = _t(spark, d, "supplier").withColumns({"eligible": F.when(k == 0, "1").when(k == 1, "true").when(k == 2, "0"), "seller": F.when(F.col("s_nationkey") % 2 == 0, " Professional ").otherwise("owner")})
    return rows.filter(V.comparable(F.col("eligible"), F.col("seller"))).select("s_suppkey")


def _photo_lists(spark, d):
    return _t(spark, d, "pages").groupBy(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host")).agg(F.collect_list("url").alias("urls"))


_HOST = "regexp_extract(url, '://([^/?#]*)', 1)"


@query(f"SELECT {_HOST} AS host, count(DISTINCT url) FILTER (trim(url) <> '' AND NOT contains(lower(url), '/en') AND NOT contains(lower(url), 'utm_')) AS usable FROM pages GROUP BY 1")
def placeholder_filter(spark, d):
    pages = _t(spark, d, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), F.when(P.usable_url(F.col("url"), ["/EN", "utm_"]), F.col("url")).alias("u"))
    return pages.groupBy("host").agg(F.count_distinct("u").alias("usable"))


@query("SELECT CAST(sum(n) AS BIGINT) AS memberships, count(*) AS urls, max(n) AS most FROM (SELECT regexp_extract(url, '://([^?#]*)', 1) AS u, count(*) AS n FROM pages GROUP BY 1)")
def url_prevalence(spark, d):
    return P.prevalence(_t(spark, d, "pages").select(F.regexp_extract("url", "://([^?#]*)", 1).alias("u")), "u")


@query(f"SELECT host FROM (SELECT {_HOST} AS host, count(*) AS n FROM pages GROUP BY 1) WHERE n % 3 = 0 OR n % 5 = 0")
def snapshot_validation(spark, d):
    """Listings whose stated photo count (wrong at multiples of 3) or hash (wrong at multiples of 5) is not that of their photos."""
    n = F.size("urls")
    stated = _photo_lists(spark, d).withColumns({"photo_count": F.when(n % 3 == 0, n + 1).otherwise(n), "photo_set_hash": F.when(n % 5 == 0, "other").otherwise(X.set_hash(F.col("urls")))})
    return stated.filter(snapshot.photo_identity_wrong(F.col("urls"), F.col("photo_count"), F.col("photo_set_hash"))).select("host")


_SHOWN = f"""{_KEPT}, final AS (SELECT listing, arg_max(frames, n) AS frames FROM kept GROUP BY listing)"""
_LOST = "label % 4 = 3"


@query(f"{_SHOWN}, e AS (SELECT vec_id // 10 AS listing, count(*) AS decoded, count(*) FILTER ({_LOST}) AS errors FROM embeddings GROUP BY 1) SELECT e.listing, decoded, errors, decoded + errors AS considered, CAST(len(frames) AS BIGINT) AS kept FROM e JOIN final f ON f.listing = e.listing")
def photo_analysis(spark, d):
    """Listings' photos: decoded, failed (planted by label beside the decoded ones), kept."""
    lost = _t(spark, d, "embeddings").filter(_LOST).select(F.expr("vec_id div 10").alias("listing"), F.lit("x").alias("url_hash"), F.lit("broken").alias("error"))
    return P.analysed(_frames(spark, d), lost, BITS, RGB).select("listing", "decoded", "errors", "considered", F.col("unique").alias("kept"))


@query(f"{_SHOWN}, w AS (SELECT vec_id // 10 AS listing, count(*) AS decoded FROM embeddings GROUP BY 1) SELECT a.listing AS low, b.listing AS high, CAST(len(a.frames) AS BIGINT) AS low_unique, x.decoded - len(a.frames) AS low_duplicates, CAST(least(len(a.frames), len(b.frames)) AS BIGINT) AS matches, 'm1' AS matcher FROM final a JOIN final b ON b.listing = a.listing + 1 JOIN w x ON x.listing = a.listing")
def pair_evidence(spark, d):
    """Evidence documents of each listing with the next."""
    listed = P.analysed(_frames(spark, d), _t(spark, d, "embeddings").limit(0).select(F.col("vec_id").alias("listing"), F.lit("").alias("url_hash"), F.lit("").alias("error")), BITS, RGB)
    pairs = listed.select(F.col("listing").alias("low"), (F.col("listing") + 1).alias("high"), F.lit("r").alias("revision"), F.lit("a").alias("low_hash"), F.lit("b").alias("high_hash"))
    out = P.pair_documents(pairs, listed, {"matcher_version": "m1", "normalization_version": "n1"})
    doc = F.col("document")
    return out.select("low", "high", doc["listing_a"]["stats"]["unique"].alias("low_unique"), doc["listing_a"]["stats"]["duplicates"].alias("low_duplicates"), F.size(doc["matches"]).cast("long").alias("matches"), doc["matcher_version"].alias("matcher"))
