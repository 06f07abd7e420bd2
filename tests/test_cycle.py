"""The listing cycle's operators on cases of their own, by hand and against folds."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cadastra.functions import scalars as S
from cadastra.operators import assessments as A
from cadastra.operators import batches as B
from cadastra.operators import decisions as D
from cadastra.operators import observe as O
from cadastra.operators import profiles as P
from cadastra.operators import publishing as G
from cadastra.operators import refresh as R
from cadastra.operators import reports as W
from cadastra.operators.history import merged_intervals, numbered
from cadastra.sources import snapshot

STATE = "id string, status string, first_seen_at string, last_seen_at string, missing_detected_at string, initial_price double, current_price double, content_hash string, photo_set_hash string"
ROW = "id string, status string, first_seen_at string, last_seen_at string, missing_detected_at string, scraped_at string, initial_price string, price string, content_hash string, photo_set_hash string"


def rows_of(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_observation_keeps_what_was_first_and_writes_each_event(spark):
    state = spark.createDataFrame([("1", "active", "2024-01-01", "2024-01-05", None, 10.0, 12.0, "h", None), ("2", "missing", None, "2024-01-02", None, None, 5.0, "h", None), ("9", "active", "x", "y", None, 1.0, 1.0, "h", None)], STATE)
    rows = spark.createDataFrame([
        ("1", "missing", "2024-02-01", "2024-02-02", "2024-02-03", None, "99", "12", "n", None), ("2", None, "2023-12-01", "2024-02-02", None, None, "7", "5.5", "n", "p"),
        ("3", "active", None, "2024-02-02", None, "2024-02-04", "20", "nan", "n", None), ("4", "missing", "2024-01-01", None, None, None, "-1", "8", "n", None),
    ], ROW)
    after = {r.id: r for r in O.merge_state(state, rows).collect()}
    assert (after["1"].first_seen_at, after["1"].initial_price, after["1"].status, after["1"].current_price) == ("2024-01-01", 10.0, "missing", 12.0)
    assert (after["2"].first_seen_at, after["2"].initial_price, after["2"].status, after["2"].photo_set_hash) == ("2023-12-01", 7.0, "active", "p")
    assert after["3"].current_price is None and after["9"].last_seen_at == "y" and len(after) == 5
    assert rows_of(O.presence_events(state, rows, "now")) == [("1", "missing", "missing", "2024-02-03", True), ("2", "reactivated", "active", "2024-02-02", True), ("3", "bootstrap_state", "active", "2024-02-02", False), ("4", "bootstrap_state", "missing", "2024-01-01", False)]
    assert rows_of(O.price_events(state, rows, "now")) == [("2", "observed_change", 5.5, "2024-02-02", True), ("3", "bootstrap_initial", 20.0, "now", False), ("4", "bootstrap_current", 8.0, "now", False)]
    # the same snapshot again tells nothing new
    assert O.presence_events(O.merge_state(state, rows), rows, "now").isEmpty() and O.price_events(O.merge_state(state, rows), rows, "now").isEmpty()


def fold(states, events):
    """Number of market periods of one entity, by a walk over its listings' events in order."""
    spans = []
    for s in states:
        start = s["first"]
        for kind, at in events.get(s["id"], []):
            if kind == "missing":
                if start is not None and at >= start:
                    spans.append((start, at))
                start = None
            elif kind == "reactivated" and start is None:
                start = at
        if s["status"] == "active":
            start = s["last"] if start is None else start
            if start is not None:
                spans.append((start, datetime.max))
        elif start is not None and s["gone"] is not None and s["gone"] >= start:
            spans.append((start, s["gone"]))
    periods, end = 0, None
    for a, b in sorted(spans):
        if end is None or a > end:
            periods, end = periods + 1, b
        end = max(end, b)
    return periods


def test_market_periods_equal_a_fold(spark):
    rng = random.Random(3)
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    text = lambda t: None if t is None else t.strftime("%Y-%m-%d %H:%M:%S")
    members, state, local, source, want = [], [], [], [], {}
    for e in range(120):
        listed, events, by_source = [], {}, rng.random() < 0.4
        for i in range(rng.randint(1, 3)):
            name = f"{e}-{i}"
            s = {"id": name, "status": rng.choice(["active", "missing"]), "first": day(rng.randint(0, 20)) if rng.random() < 0.8 else None, "last": day(rng.randint(10, 40)), "gone": None}
            missing = day(rng.randint(5, 50)) if rng.random() < 0.5 else None
            s["gone"] = missing or s["last"]
            listed.append(s)
            members.append((name, e))
            state.append((name, s["status"], text(s["first"]), text(s["last"]), text(missing), None, None, None, None))
            own = [(rng.choice(["missing", "reactivated", "seen", "bootstrap_state"]), day(n)) for n in sorted(rng.sample(range(40), rng.randint(0, 5)))]
            for k, (kind, at) in enumerate(own):
                if by_source:
                    source.append((name, "missing_confirmed" if kind == "missing" else kind, text(at), f"{name}:{k}"))
                else:
                    local.append((name, kind, text(at), f"{name}:{k}"))
            if by_source:
                local.append((name, "missing", text(day(3)), "local"))
                local.append((name, "reactivated", text(day(30)), "local2"))
            events[name] = own
        if by_source and not any(events.values()):
            # without a source event the local ones count
            events = {n: [("missing", day(3)), ("reactivated", day(30))] for n in events}
        want[e] = fold(listed, events)
    log = "listing string, event_type string, observed_at string, event_id string"
    spans = O.market_intervals(spark.createDataFrame(members, "listing string, entity int"), spark.createDataFrame(state, STATE), spark.createDataFrame(local, log), spark.createDataFrame(source, log))
    merged = merged_intervals(spans.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")}), "entity").groupBy("entity").count()
    assert {r.entity: r["count"] for r in merged.collect()} == {e: n for e, n in want.items() if n}


def test_entities_grace_and_relists(spark):
    members = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 3)], "listing string, entity int")
    state = spark.createDataFrame([("a", "missing", "2024-01-01", "2024-01-02", "2024-03-01 00:00:00", None, None, None, None), ("b", "missing", "", None, None, None, None, None, None), ("c", "active", "2024-01-05", "2024-02-01", None, None, None, None, None), ("d", "missing", "2024-01-01", "2024-01-03", None, None, None, None, None)], STATE)
    none = spark.createDataFrame([], "listing string, event_type string, observed_at string, event_id string")
    out = {r.entity: r for r in O.recompute_entities(members, state, none, none, "2024-03-01 23:00:00").collect()}
    assert (out[1].lifecycle_status, out[2].lifecycle_status, out[3].lifecycle_status) == ("uncertain", "off_market", "active")
    assert (out[3].first_seen_at, out[3].last_seen_at, out[3].relist_count, out[3].members, out[3].active) == ("2024-01-01", "2024-02-01", 1, 2, 1)
    assert out[2].first_seen_at is None and out[2].relist_count == 0
    later = {r.entity: r.lifecycle_status for r in O.recompute_entities(members, state, none, none, "2024-03-02 00:00:00").collect()}
    assert later[1] == "off_market"


def test_gate_takes_outside_decisions_on_the_present_text_only(spark):
    rows = spark.createDataFrame([(str(i), "h") for i in range(7)], "id string, content_hash string")
    verdicts = spark.createDataFrame([("0", "h", 1, "ok"), ("1", "old", 1, "ok"), ("2", "h", 1, "ok"), ("3", "h", 0, "not_sale"), ("4", "h", None, "llm_failed"), ("5", "h", 1, "ok")], "id string, content_hash string, usable int, reason_code string")
    outside = spark.createDataFrame([("2", "h", 0, "unit_ambiguous"), ("3", "h", 1, "ok"), ("5", "h", None, None), ("0", "older", 0, "not_sale"), ("1", "h", 1, "ok")], "id string, content_hash string, usable int, reason_code string")
    assert rows_of(G.gated(rows, verdicts, outside), "id", "gate", "rewritten") == [("0", "publish", False), ("1", "waiting", False), ("2", "rejected", True), ("3", "publish", True), ("4", "waiting", False), ("5", "waiting", False), ("6", "waiting", False)]


def test_canonical_rows_prefer_cheap_active_rows_and_stay(spark):
    cells = "id string, status string, price string, title string, last_seen_at string, photo_count string"
    ready = spark.createDataFrame([("1", "active", "10", "t", "b", "1"), ("2", "active", "10", None, "b", "9"), ("3", "missing", "1", "t", "z", "1"), ("4", "active", "x", "t", "z", "1"), ("5", "missing", "3", "t", "a", "2"), ("6", "missing", "3", "t", "a", "3"), ("7", "active", "1", "t", "a", "1")], cells)
    members = spark.createDataFrame([(str(i), "A" if i < 5 else "B") for i in range(1, 7)] + [("8", "A")], "listing string, entity string")
    entities = spark.createDataFrame([("A", "active", "f", "l", 2, 5, 3), ("B", "off_market", "f", "l", 0, 2, 0)], "entity string, lifecycle_status string, first_seen_at string, last_seen_at string, relist_count int, members long, active long")
    out = {r.entity: r for r in G.canonical_rows(ready, members, entities, spark.createDataFrame([("A", "2")], "entity string, canonical string")).collect()}
    assert (out["A"].id, out["A"].switched, out["A"].entity_active_min_price, out["A"].entity_ready_active_listing_count, out["A"].entity_member_count) == ("2", False, 10.0, 3, 5)
    assert (out["B"].id, out["B"].switched, out["B"].entity_active_min_price, out["B"].entity_status) == ("6", True, None, "off_market") and len(out) == 2
    new = {r.entity: r.id for r in G.canonical_rows(ready, members, entities, spark.createDataFrame([("A", "3")], "entity string, canonical string")).collect()}
    assert new["A"] == "1"  # of one price and time, the fuller row


def test_numbers_are_whole_and_in_order(spark):
    rows = spark.createDataFrame([(i * 7 % 501, "hot" if i % 3 else None) for i in range(501)], "n long, key string")
    assert [r.n for r in sorted(G.sequenced(rows, "n").collect(), key=lambda r: r.seq)] == list(range(501))
    by_two = sorted(G.sequenced(rows, "key", "n").collect(), key=lambda r: r.seq)
    assert [r.seq for r in by_two] == list(range(1, 502)) and [(r.key, r.n) for r in by_two] == sorted(((r.key, r.n) for r in by_two), key=lambda k: (k[0] or "", k[1]))
    got = [(r.key, r.n, r.rn) for r in numbered(rows, "key", "n", 8).collect()]
    for key in ("hot", None):
        assert [n for n, _ in sorted((rn, n) for k, n, rn in got if k == key)] == list(range(1, 1 + sum(k == key for k, _, _ in got)))
        assert [n for _, n in sorted((rn, n) for k, n, rn in got if k == key)] == sorted(n for k, n, _ in got if k == key)


HOME = "id string, rooms string, square_m2 string, floor string, street string, house_num string, complex_name string, latitude double, longitude double, photo_set_hash string, status string"


def test_refresh_scores_carries_and_overrides(spark):
    rows = spark.createDataFrame([
        ("100", "2", "60.2", "5", "Main St", "1", "Park", 51.1, 71.4, None, "active"), ("200", "2.0", "60.4", "5", " main  st", "1", "park", 51.1, 71.4, "", "active"),
        ("30", "2", "60", "5", "Other", "9", "Park", None, None, "p", "missing"), ("31", "1", "30", "2", None, None, None, None, None, "p", "active"), ("32", "2", "60", "5", "Other", "9", None, None, None, None, "active"),
    ], HOME)
    none = spark.createDataFrame([], "low string, high string, decision string"), spark.createDataFrame([], "low string, high string, low_hash string, high_hash string, revision string, match_revision string")
    out = {(r.low, r.high): r for r in R.refresh(rows, *none).collect()}
    assert (out["100", "200"].reasons, out["100", "200"].priority, out["100", "200"].status) == (["address", "complex", "coordinates"], 87, "awaiting_photo_analysis")
    assert [s.signal for s in out["100", "200"].positive_signals] == ["near_coordinates", "same_complex", "same_address"]
    assert (out["100", "30"].hard_conflicts, out["100", "30"].status, out["100", "30"].priority) == (["address"], "metadata_conflict", 30)
    assert (out["30", "31"].reasons, out["30", "31"].hard_conflicts, out["30", "31"].priority) == (["exact_photo_set"], ["area", "floor", "rooms"], 100)
    assert set(out) == {("100", "200"), ("100", "30"), ("200", "30"), ("30", "31"), ("30", "32")}
    known = out["100", "30"]
    evidence = spark.createDataFrame([("100", "30", known.low_hash, known.high_hash, known.revision, "m"), ("100", "200", "other", known.high_hash, out["100", "200"].revision, "m")], none[1].schema)
    override = spark.createDataFrame([("30", "32", "different_entity")], none[0].schema)
    status = {(r.low, r.high): r.status for r in R.refresh(rows, override, evidence).collect()}
    assert (status["100", "30"], status["100", "200"], status["30", "32"]) == ("photo_evidence_ready", "awaiting_photo_analysis", "manual_not_link")
    # evidence says nothing once a side has changed
    moved = rows.withColumn("square_m2", F.when(F.col("id") == "30", "60.3").otherwise(F.col("square_m2")))
    assert {r.status for r in R.refresh(moved, *none[:1], evidence).filter("low = '100' and high = '30'").collect()} == {"metadata_conflict"}


def test_one_current_edge_for_each_pair(spark):
    edges = spark.createDataFrame([("1", "2", "m0", 0.1, "uncertain", True), ("1", "3", "m0", 0.1, "uncertain", True), ("1", "2", "m1", 0.1, "uncertain", False)], "low string, high string, match_revision string, score double, decision string, is_current boolean")
    judged = spark.createDataFrame([("1", "2", "accepted", "m1", "0.9", "likely_same", 1), ("1", "2", "accepted", "m1", "0.8", "likely_same", 2), ("1", "3", "stale", None, "0.9", "likely_same", 3)], "low string, high string, outcome string, match_revision string, score string, decision string, arrived int")
    assert rows_of(R.edges_after(edges, judged), "low", "high", "match_revision", "score", "is_current") == [("1", "2", "m0", 0.1, False), ("1", "2", "m1", 0.8, True), ("1", "3", "m0", 0.1, True)]


def test_review_filters_and_pages(spark):
    pairs = spark.createDataFrame([("1", "2", ["a", "b"], 65, "awaiting_photo_analysis", "r2"), ("1", "3", ["a"], 30, "photo_evidence_ready", "r1"), ("4", "5", ["a"], 30, "awaiting_photo_analysis", "r0")], "low string, high string, reasons array<string>, priority int, status string, revision string")
    snaps = spark.createDataFrame([("1", "active", "1"), ("2", "active", "0"), ("3", "missing", None)], "id string, status string, baseline_eligible string")
    edges = spark.createDataFrame([("1", "3", "m", 0.8, "likely_same", True), ("1", "2", "m", 0.9, "uncertain", False)], "low string, high string, match_revision string, score double, decision string, is_current boolean")
    review = lambda **f: [(r.low, r.high) for r in R.page(R.review(pairs, snaps, edges, **f)).collect()]
    assert review() == [("1", "2"), ("1", "3"), ("4", "5")]
    assert review(activity="both_active") == [("1", "2")] and review(activity="active_missing") == [("1", "3")] and review(activity="both_missing") == [("4", "5")]
    assert review(eligibility="neither") == [("4", "5")] and review(eligibility="both") == [] and review(eligibility="at_least_one") == [("1", "2"), ("1", "3")]
    assert review(min_score=0.5, max_score=0.8, photo_decision="likely_same") == [("1", "3")] and review(min_reason_count=2) == [("1", "2")] and review(reason_count=1, min_priority=31) == []
    assert [r.revision for r in R.page(pairs, "revision").collect()] == ["r0", "r1", "r2"]
    assert R.review(pairs, snaps, edges).filter("low = '4'").first().photo_evidence is None
    for bad in ({"min_score": 1, "max_score": 0}, {"min_reason_count": 1, "reason_count": 1}, {"activity": "some"}, {"eligibility": "x"}):
        with pytest.raises(ValueError):
            R.review(pairs, snaps, edges, **bad)
    with pytest.raises(ValueError):
        R.page(pairs, "price")


def test_manual_decisions_are_judged_and_canonical_rows_keep_a_history(spark):
    members = spark.createDataFrame([("a", "E1", "2"), ("b", "E1", "1"), ("c", "E2", "0"), ("d", "E3", "0")], "listing string, entity string, created_at string")
    asked = spark.createDataFrame([("c", "a", "same_entity", "x", "me", "1"), ("a", "b", "different_entity", "x", "me", "1"), ("a", "z", "same_entity", "x", "me", "1"), ("a", "d", "same_entity", " ", "me", "1"), ("d", "a", "different_entity", "x", "me", "2"), ("a", "a", "same_entity", "x", "me", "1")], "a string, b string, decision string, reason string, actor string, revision string")
    judged = D.manual(asked, members, spark.createDataFrame([("manual_override:a:d:different_entity:2",)], "key string"))
    assert rows_of(judged, "low", "high", "outcome", F.coalesce("status", F.lit("")).alias("s")) == [("a", "a", "invalid", ""), ("a", "b", "invalid", ""), ("a", "c", "applied", "manual_linked"), ("a", "d", "invalid", ""), ("a", "d", "repeated", ""), ("a", "z", "invalid", "")]
    past = spark.createDataFrame([("E", "1", "t0", "t1", "v1"), ("E", "2", "t1", None, "v2")], "entity string, listing string, valid_from string, valid_to string, version string")
    back = D.canonical_history(past, spark.createDataFrame([("E", "1")], "entity string, listing string"), "t3", "v3")
    assert rows_of(back.filter("valid_to is null"), "listing", "version") == [("1", "v3")]
    assert D.canonical_history(past, spark.createDataFrame([("E", "2")], "entity string, listing string"), "t3", "v2").count() == 2


def test_profiles_of_real_phrases(spark):
    cards = [
        ("1", "Квартира", "Продаётся в черновой отделке, без мебели", None, None), ("2", "Квартира", "Не нужен ремонт; требует ремонта", "свежий ремонт", "Полностью"), ("3", "Квартира", "Нужен свежий ремонт", "Черновая отделка", "без мебели"),
        ("4", "Квартира", "вся мебель остается, мебель не остаётся", None, None), ("5", None, None, None, None), ("6", "Х", "Не в черновой отделке. Чистовая, но в черновой отделке балкон", None, "без мебели"), ("7", "Х", "СРОЧНАЯ ПРОДАЖА", None, None), ("8", "Х", "Свежий ремонт не нужен", None, None),
    ]
    out = {r.id: r for r in P.profile(spark.createDataFrame(cards, "id string, title string, full_description string, rent_renovation string, furniture string")).collect()}
    codes = {i: [(s.code, s.source) for s in r.signals] for i, r in out.items()}
    assert codes["1"] == [("finish_rough", "text"), ("furniture_none", "text")] and codes["5"] == [] and codes["7"] == [("urgent_claim", "text")] and codes["8"] == []
    assert ("finish_fresh", "rent_renovation") in codes["2"] and ("furniture_full", "furniture") in codes["2"]
    assert codes["3"] == [("finish_rough", "rent_renovation"), ("furniture_none", "furniture")]
    assert out["4"].conflicts == ["furniture"] and codes["6"] == [("furniture_none", "furniture")]  # a negated first match hides the second
    titles = [("Доля в квартире", "partial_property"), ("Продам комнату в 3-комнатной квартире", "partial_property"), ("1-комнатная квартира", None), ("Срочно продам гараж", "not_apartment"), ("Квартира и паркинг", None), ("  НЕЖИЛОЕ ПОМЕЩЕНИЕ", "not_apartment"), (None, None)]
    assert [r[0] for r in spark.createDataFrame([(t,) for t, _ in titles], "t string").select(P.title_rule(F.col("t"))).collect()] == [w for _, w in titles]


def test_outside_verdicts_fit_or_fall_through(spark):
    base = {"price_now": "100", "price_then": "100.0", "photos_now": "", "photos_then": None, "offer_type": "whole_apartment", "photo_scope": None, "data_consistency": None, "usable": True, "reason_code": "ok", "confidence": "high", "evidence": "", "text": "Only  a SHARE is sold"}
    cases = [
        ({}, ("ok", "high")), ({"price_then": "101"}, None), ({"price_then": "about 100"}, None), ({"photos_then": "x"}, None), ({"evidence": None}, None), ({"usable": False}, None), ({"offer_type": "unclear"}, None),
        ({"usable": False, "reason_code": "partial_property", "offer_type": "partial_property", "evidence": "a share"}, ("partial_property", "high")), ({"usable": False, "reason_code": "partial_property", "evidence": "a share"}, None),
        ({"usable": False, "reason_code": "other_red_flag", "evidence": "not there"}, None), ({"usable": False, "reason_code": "other_red_flag", "evidence": "x" * 181}, None),
        ({"usable": None, "reason_code": "unclear", "offer_type": "multi_unit_offer"}, ("unit_ambiguous", "high")), ({"usable": None, "reason_code": "unclear", "photo_scope": "mixed_units"}, ("unit_ambiguous", "medium")), ({"usable": None, "reason_code": "unclear"}, None),
    ]
    shape = ", ".join(f"{k} {'boolean' if k == 'usable' else 'string'}" for k in base) + ", n int"
    df = spark.createDataFrame([tuple((base | c).values()) + (i,) for i, (c, _) in enumerate(cases)], shape)
    none = F.lit(None).cast("string")
    v = F.struct("offer_type", "photo_scope", "data_consistency", "usable", "reason_code", "confidence", "evidence")
    found = df.select("n", A.comparison(F.col("price_now"), F.col("price_then"), F.col("photos_now"), F.col("photos_then"), none, none, v, F.col("text")).alias("d")).orderBy("n").collect()
    assert [r.d and (r.d.reason_code, r.d.confidence) for r in found] == [w for _, w in cases]


def test_batches_budgets_and_attempts(spark):
    assert (B.budget(0, 0, 0), B.budget(5, 0, 0, least=9), B.budget(10**6, 0, 0), B.budget(50, 30, 15, pilot=60), B.budget(50, 60, 5, pilot=60)) == (0, 0, 30_000, 15, 0)
    sent = spark.createDataFrame([("1", "pending", '{"a":"h"}'), ("2", "pending", '["b"]'), ("3", "pending", "broken"), ("4", "failed", '{"c":"h"}')], "batch_id string, status string, listing_ids string")
    assert rows_of(B.in_flight(sent)) == [("a",), ("b",)]
    answers = spark.createDataFrame([("1", "completed", None, None), ("2", "completed", "f", 500), ("3", "completed", "f", 200)], "batch_id string, state string, output_file string, download_code int")
    assert rows_of(B.batch_outcomes(sent, answers)) == [("1", "failed"), ("2", "pending"), ("3", "failed")]
    verdicts = spark.createDataFrame([("a", "h", 2, "llm"), ("b", "h", 0, "rule")], "id string, content_hash string, attempts int, source string")
    got = B.ingested(spark.createDataFrame([("a", "h2", None, "llm_failed", "llm_failed"), ("n", "h2", None, "llm_failed", "llm_failed"), ("b", "h2", 1, "ok", "llm")], "id string, saved_hash string, usable int, reason_code string, source string"), verdicts)
    assert rows_of(got, "id", "content_hash", "attempts") == [("a", "h2", 3), ("b", "h2", 0), ("n", "", 1)]
    kept, left = B.upserted(verdicts, got, spark.createDataFrame([("a",), ("n",), ("z",)], "id string"))
    assert kept.count() == 3 and rows_of(left) == [("n",), ("z",)]
    lines = B.request_lines(B.planned(spark.createDataFrame([(i, f"t{i}") for i in range(5)], "id long, text string"), "id", 5, size=4, group=3), F.col("text"), "m", "p").orderBy("batch", "group").collect()
    read = [json.loads(r.value) for r in lines]
    assert [x["custom_id"] for x in read] == ["grp_0", "grp_3", "grp_4"] and read[0]["body"]["messages"][1]["content"] == "t0\n\nt1\n\nt2" and read[0]["body"]["max_tokens"] == 750


def test_health_and_pages(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 10, true, false, 5, 'ok'), (2, 10, true, true, 5, 'degraded'), (3, 101, true, true, 5, 'stale'), (4, null, false, true, 5, 'starting'), (5, null, null, null, 200, 'broken') AS t(n, age, good, bad, up, want)")
    assert df.filter(W.health(F.col("age"), F.col("good"), F.col("bad"), F.col("up"), 100) != F.col("want")).isEmpty()
    with pytest.raises(ValueError):
        W.page(df, "n", limit=501)


def test_scalars(spark):
    n = spark.sql("SELECT * FROM VALUES ('2.5'), (' 7 '), ('nan'), ('inf'), ('x'), (null), ('-3'), ('0') AS t(v)")
    assert [r[0] for r in n.select(S.price(F.col("v"))).collect()] == [2.5, 7.0, None, None, None, None, None, None]
    assert [r[0] for r in n.select(S.whole_text(F.col("v"))).collect()] == ["2.5", "7", "", "", "", "", "-3", "0"]
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(S.half_even(F.lit(x), 0)) for x in (0.5, 1.5, 2.5)] == [0.0, 2.0, 2.0]
    assert one(S.typed_hash(F.lit("a|b"), F.lit("c"))) != one(S.typed_hash(F.lit("a"), F.lit("b|c"))) and one(S.typed_hash(F.lit(60))) != one(S.typed_hash(F.lit("60"))) != one(S.typed_hash(F.lit(60.0)))
    urls = {"https://img.site.kz/a": True, "https://site.kz:443/a": True, "http://site.kz/a": False, "https://site.kz:8443/a": False, "https://me@site.kz/a": False, "https://evilsite.kz/a": False, "nonsense": False}
    assert [one(S.url_allowed(F.lit(u), ["site.kz"])) for u in urls] == list(urls.values())


def listings(spark, n=3, **changes):
    rows = spark.range(n).select(F.col("id").cast("string").alias("id"), F.array(F.concat(F.lit("u"), "id"), F.lit("a")).alias("photo_urls"))
    from cadastra.functions.text import set_hash

    return rows.withColumns({"photo_count": F.lit(2), "photo_set_hash": set_hash(F.col("photo_urls"))} | changes)


def test_snapshot_is_whole_or_refused(spark):
    events = spark.sql("SELECT 'e1' AS source_event_id, '0' AS listing_id UNION ALL SELECT 'e2', '2'")
    totals = {"rows": 3, "prices": 2, "presence": 2, "photos": 6}
    assert snapshot.assemble(listings(spark), events, events, totals)[0].count() == 3
    for name in totals:
        with pytest.raises(snapshot.SnapshotError, match=name):
            snapshot.assemble(listings(spark), events, events, totals | {name: totals[name] + 1})
    for name, wrong in (("photos", listings(spark, photo_set_hash=F.lit("x"))), ("repeat", listings(spark).withColumn("id", F.lit("0")))):
        with pytest.raises(snapshot.SnapshotError, match=name):
            snapshot.assemble(wrong, events, events, totals)
    with pytest.raises(snapshot.SnapshotError, match="events"):
        snapshot.assemble(listings(spark), events, events.withColumn("listing_id", F.lit("7")), totals)
    assert snapshot.effective_version({"version": "5", "scope": "s", "scope_revision": 2}) == "5:s:2" and snapshot.effective_version({"version": "5"}) == "5"


def test_readers_see_one_version_and_old_ones_go(spark, tmp_path):
    root = f"file://{tmp_path}/clean"
    for v in ("1", "2", "3"):
        assert snapshot.publish(spark.range(int(v)).toDF("id"), root, v)
        old = snapshot.read_current(spark, root)
        assert snapshot.current_version(spark, root) == v and old.count() == int(v)
    with pytest.raises(snapshot.SnapshotError, match="exists"):
        snapshot.publish(spark.range(9).toDF("id"), root, "3")
    assert not snapshot.publish(spark.range(0).toDF("id"), root, "4")
    assert sorted(p.name for p in (tmp_path / "clean").glob("version=*")) == ["version=2", "version=3"] and old.count() == 3
    assert [p.name for p in (tmp_path / "clean").glob("*.tmp")] == []
    csv = snapshot.write_csv(spark.sql("SELECT 1 AS a, array(1, 2) AS b"), root, "3", "t")
    assert csv == snapshot.write_csv(spark.sql("SELECT 1 AS a, array(1, 2) AS b"), root, "3", "t")
    assert spark.read.option("header", True).csv(csv).first().b == "[1,2]"
    snapshot.write_report(spark, f"{root}/report.json", {"b": 1, "a": "é"})
    assert json.loads((tmp_path / "clean/report.json").read_text()) == {"a": "é", "b": 1}
