"""Hash parity with JSON, the model's view, totals in one run, survival curves, labelled cases, artifacts that stay or go."""

import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from cadastra.functions import text as X
from cadastra.operators import batches as B
from cadastra.operators import reports as W
from cadastra.operators import verdicts as V
from cadastra.operators import zones as Z
from cadastra.sources import cases as C
from cadastra.sources import snapshot


def test_doubles_read_as_other_json_writers_have_them(spark):
    chance = random.Random(5)
    values = [0.0, -0.0, 1.0, 60.0, 0.1, 1e-4, 0.00012, 9.99e-5, 1e-5, 1.5e-7, 1234567.0, 12345678.0, 1e7, 1.25e7, 123456789.125, 1e15, 1.5e15, 1e16, 1.2345e16, 1e22, 1.7976931348623157e308, 5e-324, math.nan, math.inf, -math.inf, -2.5, -1e-9]
    values += [chance.choice([-1, 1]) * round(chance.random(), chance.randrange(1, 9)) * 10 ** chance.randrange(-12, 20) for _ in range(300)]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(X.float_text(F.col("v"))).collect()]
    # Java before 19 may write more digits than are needed: what is read back must be the same number, in the same form
    for v, g in zip(values, got):
        assert g == json.dumps(v) or (float(g) == v and ("e" in g) == ("e" in json.dumps(v)))
    assert sum(g != json.dumps(v) for v, g in zip(values, got)) <= 3


def test_content_hash_is_that_of_the_json_list(spark):
    odd = 'quote " back \\ slash / tab \t line \n\r feed \f\b unit \x1f vertical \x0b null \x00 é漢🎉 \x7f \\u000B'
    rows = [("a|b", "c", 60, 60.0, True, "60"), ("a", "b|c", None, None, None, None), (odd, "", 0, -1.5, False, "\x0b")]
    df = spark.createDataFrame(rows, "a string, b string, n int, x double, f boolean, t string")
    columns = df.columns
    got = [r[0] for r in df.select(X.content_hash(*X.typed(df, *columns, "absent"))).collect()]
    want = [hashlib.sha256(json.dumps([*r, None], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()[:16] for r in rows]
    assert got == want
    same = df.select(*(X.content_hash((F.col(c), k)) for c, k in (("n", "int"), ("x", "double"), ("t", "string")))).first()
    assert len(set(same)) == 3  # 60, 60.0 and "60"


def test_the_model_sees_labelled_fields(spark):
    long = "a" * 1500 + "b" * 1500
    rows = spark.createDataFrame([("7", "T", 2, 40.0, None, "", long), ("8", None, None, None, "new", "yes", None)], "id string, title string, rooms int, square_m2 double, rent_renovation string, priv_dorm string, full_description string")
    first, second = [r[0] for r in rows.select(B.model_view(rows)).collect()]
    assert first == "### id: 7\nЗаголовок: T\nКомнат: 2, площадь: 40.0 м²\nОтделка (поле сайта): не указана\nТип дома (поле сайта) — приват. общежитие: не указано\nОписание: " + long[:1266] + " […] " + long[-634:]
    assert second.endswith("Комнат: None, площадь: None м²\nОтделка (поле сайта): new\nТип дома (поле сайта) — приват. общежитие: yes\nОписание: ")
    dealt = rows.withColumns({"batch": F.lit(0), "group": F.lit(0), "place": F.col("id").cast("int")})
    lines = lambda model: json.loads(B.request_lines(dealt, B.model_view(dealt), model, "p").first().value)["body"]
    assert lines("o4-mini")["max_completion_tokens"] == 4600 and lines("plain-4")["max_tokens"] == 600
    assert lines("plain-4")["messages"][1]["content"] == f"{first}\n\n{second}"


def test_requests_are_written_by_batch(spark, tmp_path):
    lines = spark.createDataFrame([(0, '{"a":1}'), (0, '{"a":2}'), (1, '{"a":3}')], "batch long, value string")
    B.write_requests(lines, str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out/batch=0")).collect()) == ['{"a":1}', '{"a":2}']


def test_a_page_and_its_total_take_one_run(spark):
    rows = spark.range(1000).withColumn("k", F.col("id") % 7).filter("k > 2")
    before = spark.sparkContext.statusTracker().getJobIdsForGroup("one-run")
    spark.sparkContext.setJobGroup("one-run", "page")
    found, total = W.page_with_total(rows, F.desc("id"), limit=10, offset=5)
    jobs = set(spark.sparkContext.statusTracker().getJobIdsForGroup("one-run")) - set(before)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert total == rows.count() and [r.id for r in found] == [r.id for r in rows.orderBy(F.desc("id")).offset(5).limit(10).collect()] and len(jobs) == 1
    counted, seen = W.run_summary(rows, high=F.col("k") > 5)
    counted.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": total, "high": rows.filter("k > 5").count()}


def test_survival_counts_those_that_have_not_left(spark):
    chance = random.Random(8)
    rows = [(f"z{chance.randrange(3)}", float(chance.randrange(20)) + chance.random() * 0.9, chance.random() < 0.6) for _ in range(200)] + [("few", 3.0, True), ("none", -1.0, True), ("none", None, True), ("all", 5.0, True), ("all", 5.0, True)]
    df = spark.createDataFrame(rows, "zone string, days double, ended boolean")
    got = {(r.zone, r.day): r.surviving for r in Z.survival(df, "zone").collect()}
    for zone in ("z0", "z1", "z2", "few", "all"):
        own, s = [(int(d), e) for z, d, e in rows if z == zone], 1.0
        for day in sorted({d for d, _ in own}):
            s *= 1 - sum(e for d, e in own if d == day) / sum(d >= day for d, _ in own)
            assert got[zone, day] == pytest.approx(s, abs=1e-12)
    shares = {r.zone: r for r in Z.hotness(Z.gone_shares(df, "zone", (0, 5, 30)), "zone", 5).collect()}
    assert set(shares) == {"z0", "z1", "z2"} and all(r.gone_30 is None for r in shares.values())
    assert sorted(r.heat for r in shares.values()) == [0.0, 0.5, 1.0] and max(shares.values(), key=lambda r: r.gone_5).heat == 1.0


def test_entities_without_members_count(spark):
    entities = spark.createDataFrame([("A", "active"), ("B", "merged"), ("C", "active")], "entity string, lifecycle_status string")
    members = spark.createDataFrame([("1", "A"), ("2", "A"), ("3", "C")], "listing string, entity string")
    state = spark.createDataFrame([("1", "active"), ("2", "active"), ("3", "active")], "id string, status string")
    counted = W.member_counts(entities, members)
    assert {r.entity: r.member_count for r in counted.collect()} == {"A": 2, "B": 0, "C": 1}
    assert {r.lifecycle_status: (r.entities, r.members) for r in W.life_cycles(counted).collect()} == {"active": (2, 3), "merged": (1, 0)}
    row = W.entity_stats(entities, members, state, spark.range(4), spark.range(0)).first()
    assert (row.entities, row.members, row.several_active, row.by_status, row.events, row.source_history) == (3, 3, 1, {"active": 2, "merged": 1}, 4, False)


def test_the_last_current_revision_of_a_pair(spark):
    rows = spark.createDataFrame([("a", "b", "r1", 1, True), ("a", "b", "r2", 3, False), ("a", "b", "r3", 2, True), ("a", "b", "r0", 2, True), ("c", "d", "r", 1, False)], "low string, high string, revision string, processed_at int, is_current boolean")
    assert [(r.low, r.revision) for r in V.current_revision(rows).collect()] == [("a", "r3")]


def test_labelled_cases_are_read_and_bad_ones_named(spark, tmp_path):
    path = tmp_path / "cases.json"
    cases = [
        {"name": "share", "expect": ["partial_property", "not_sale"], "text": "a share"}, {"name": "fine", "expect": "ok", "text": "whole\nflat", "fields": {"rooms": 3, "priv_dorm": "yes"}, "soft": True},
        {"name": "", "expect": "ok", "text": "x"}, {"name": "blank", "expect": "ok", "text": " "}, {"name": "open", "expect": [], "text": "x"}, {"name": "twice", "expect": "ok", "text": "x"}, {"name": "twice", "expect": "ok", "text": "y"}, {"name": "titled", "expect": "ok", "text": "t", "title": "Дом"},
    ]
    path.write_text(json.dumps(cases, ensure_ascii=False, indent=2))
    read = C.read(spark, str(path))
    assert [r.fault for r in read.orderBy("place").collect()] == [None, None, "no name", "no text", "no expected code", "repeated name", "repeated name", None]
    rows = {r.id: r for r in C.listings(read).collect()}
    assert (rows["C000"].rooms, rows["C001"].rooms, rows["C001"].priv_dorm, rows["C007"].title, rows["C000"].expected) == ("1", "3", "yes", "Дом", ["partial_property", "not_sale"])
    answers = spark.createDataFrame([("C000", "not_sale", False, 40), ("C001", "not_sale", False, 50)], "id string, reason_code string, usable boolean, tokens int")
    assert W.regression(C.listings(read).select("id", "expected", "soft"), answers).first().asDict() == {"cases": 3, "passed": 1, "hard": 1, "soft": 1, "tokens": 90}
    path.write_text("[{broken")
    assert [r.fault for r in C.read(spark, str(path)).collect()] == ["broken"]


def test_reports_are_replaced_in_one_step_and_old_artifacts_go(spark, tmp_path):
    root = f"file://{tmp_path}"
    for n in range(3):
        snapshot.write_report(spark, f"{root}/report.json", {"n": n})
        assert json.loads((tmp_path / "report.json").read_text()) == {"n": n}
    (tmp_path / ".clean.dead").mkdir()
    made = []
    for n in range(3):
        made.append(snapshot.write_csv(spark.range(3), root, str(n), "t").removeprefix("file://"))
        import os

        os.utime(made[-1], (n * 100 + 100, n * 100 + 100))
    left = sorted(str(p) for p in tmp_path.iterdir() if "clean" in p.name and not p.name.endswith(".crc"))
    assert left == sorted(made[1:])
    assert snapshot.write_csv(spark.range(3), root, "0", "t").removeprefix("file://") == made[0] and (tmp_path / made[0]).exists()  # built again


FRAME = "listing string, pos int, photo string, sha string, bits long, rgb array<long>"


def test_a_run_has_a_document_or_an_error_for_each_candidate(spark):
    from cadastra.operators import worker

    frames = spark.createDataFrame([("a", 1, "p1", "s1", 0, [1]), ("a", 2, "p2", "s1", 0, [1]), ("b", 1, "p3", "s3", 1, [1]), ("d", 1, "p4", "s4", -1, [200])], FRAME)
    failed = spark.createDataFrame([("a", "u", "404"), ("c", "u", "404")], "listing string, url_hash string, error string")
    shape = "low string, high string, revision string, low_hash string, high_hash string, stratum string"
    candidates = spark.createDataFrame([("a", "b", "r1", "x", "y", "two"), ("a", "c", "r2", "x", "y", "two"), ("b", "d", "r3", "x", "y", "one"), ("e", "f", "r4", "x", "y", "one")], shape)
    out = worker.run(candidates, frames, failed, {"matcher_version": "m1"}).cache()
    got = {r.revision: r for r in out.collect()}
    assert (got["r1"].error, got["r1"].matches, got["r1"].decision) == (None, 1, "uncertain")
    assert got["r1"].stats.asDict() == {"considered": 4, "decoded": 3, "unique": 2, "duplicates": 1, "errors": 1}
    assert got["r2"].error == "no usable photos of c" and got["r4"].error == "no usable photos of e, f" and got["r4"].document is None
    row = worker.overview(out).first()
    assert (row.selected, row.analyzed, row.failed, row.decoded, row.errors, row.scores, row.under_70) == (4, 2, 2, 5, 1, 2, 1)
    assert {r.stratum: (r.selected, r.analyzed) for r in worker.strata(out).collect()} == {"one": (2, 1), "two": (2, 1)}
    assert worker.overview(worker.run(candidates.limit(0), frames, failed, {})).first().selected == 0
    for limit, photos in ((0, 5), (501, 5), (1, 0), (1, 31)):
        with pytest.raises(ValueError):
            worker.checked(limit, photos)


def test_codes_that_are_near_share_a_piece(spark):
    from cadastra.operators.photos import near_codes

    chance = random.Random(6)
    codes = [chance.getrandbits(64) for _ in range(60)]
    for c in codes[:40]:  # neighbours at 1 to 6 places
        for _ in range(chance.randrange(1, 7)):
            c ^= 1 << chance.randrange(64)
        codes.append(c)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes] + [0, -1, 0]
    rows = [(chance.choice("xy"), c, i) for i, c in enumerate(signed)]
    links, members = near_codes(spark.createDataFrame(rows, "label string, code long, id int"), "label")
    want = {(k, min(a, b), max(a, b), bin((a ^ b) & (1 << 64) - 1).count("1")) for k, a, _ in rows for q, b, _ in rows if k == q and a != b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 4}
    assert {tuple(r) for r in links.collect()} == want and len(want) > 10
    assert sum(r.n for r in members.collect()) == len(rows)


@pytest.mark.parametrize("bits", [1, 4, 9])
def test_codes_of_few_places_meet_at_few_others(spark, monkeypatch, bits):
    from cadastra.operators import photos

    chance, keys = random.Random(bits), {"x": 0, "y": -1 << 63, "z": 0x5A}
    rows = [(k, base ^ chance.getrandbits(24) << 38) for k, base in keys.items() for _ in range(400)]
    rows += [("z", c ^ 1 << chance.randrange(62)) for k, c in rows if k == "z"] + [("x", -1), ("x", 1 << 62), ("x", None), (None, 5), (None, 7)]
    chosen, parts = [], photos._parts
    monkeypatch.setattr(photos, "_parts", lambda *stats: chosen.append((stats, parts(*stats))) or chosen[0][1])
    links, members = photos.near_codes(spark.createDataFrame([(k, c, i) for i, (k, c) in enumerate(rows)], "label string, code long, id int"), "label", bits)
    got = [tuple(r) for r in links.collect()]
    far = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1")
    known = sorted({(k, c) for k, c in rows if k and c is not None})
    of = {k: [c for q, c in known if q == k] for k in keys}
    assert len(got) == len(set(got)) and set(got) == {(k, a, b, far(a, b)) for k, cs in of.items() for a in cs for b in cs if a < b and far(a, b) <= bits}
    (_, found), pairs = chosen[0], sum(len(cs) ** 2 for cs in of.values())
    assert sum(near + 1 for _, near, _ in found) == bits + 1 and not any(a & b for i, (a, _, _) in enumerate(found) for b, _, _ in found[:i])
    assert members.count() == len(set(rows))
    # parts of equal length would leave places that never differ together, where all meet all
    met = sum(far(a & mask, b & mask) <= near for mask, near, _ in found for cs in of.values() for a in cs for b in cs)
    assert met < pairs * {1: 0.01, 4: 0.25, 9: 1.01}[bits]


def test_parts_of_many_codes_let_few_pairs_through():
    from cadastra.operators.photos import MAX_FLIPS, _parts

    n, even = 720_000, lambda pairs: {p: pairs / 2 if p >= 40 else 0 for p in range(64)}
    shares = []
    for rows in (2_000, 50_000, n):
        parts = _parts(rows, rows**2 / 10, even(rows**2 / 10), 4)
        places = [bin(mask & (1 << 64) - 1).count("1") for mask, _, _ in parts]
        assert all(len(flips) == len(set(flips)) == sum(math.comb(p, k) for k in range(near + 1)) for p, (_, near, flips) in zip(places, parts))
        shares.append(sum(len(flips) / 2**p for p, (_, _, flips) in zip(places, parts)))
        assert sum(len(flips) for _, _, flips in parts) <= MAX_FLIPS
    assert shares == sorted(shares, reverse=True) and shares[-1] < 0.02
    assert _parts(0, 0, {}, 4) == _parts(9, 81, {p: 0 for p in range(64)}, 4) == [(0, 4, [0])]


def test_photo_queues_are_sized_by_different_listings(spark):
    listings = spark.createDataFrame([("1", "active", "1", "8"), ("2", "active", "true", "3"), ("3", "active", "0", None), ("4", "missing", "1", "x")], "id string, status string, baseline_eligible string, photo_count string")
    wait, three, one = "awaiting_photo_analysis", ["a", "b", "c"], ["a"]
    pairs = spark.createDataFrame([("1", "2", wait, three), ("1", "3", wait, one), ("1", "4", wait, three), ("2", "3", "metadata_conflict", three)], "low string, high string, status string, reasons array<string>")
    got = {r.queue: (r.pairs, r.listings, r.photos, r.first_five) for r in W.queue_sizes(pairs, listings).collect()}
    assert got == {"all_waiting": (3, 4, 11, 8), "both_active": (2, 3, 11, 8), "both_active_3plus_both_eligible": (1, 2, 11, 8), "both_active_2plus_both_eligible": (1, 2, 11, 8), "active_missing_3plus_both_eligible": (1, 2, 8, 5)}
    assert {r.gib for r in W.queue_sizes(pairs, listings).collect()} == {None} and W.queue_sizes(pairs, listings, 2**30).filter("queue = 'all_waiting'").first().gib == 11.0
    assert W.queue_sizes(pairs.limit(0), listings).filter("pairs = 0 and listings = 0").count() == 5
