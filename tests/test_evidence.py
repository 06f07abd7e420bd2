"""Semantics of photo evidence, entities, model answers and assessments on small rows."""

import json

from pyspark.sql import functions as F

from cadastra.operators import assessments as A
from cadastra.operators import entities as E
from cadastra.operators import photos as P

FRAME = "listing string, pos int, photo string, sha string, bits long, rgb array<long>"


def test_greedy_dedupe_compares_with_kept_frames_only(spark):
    grey = [100] * 3
    rows = [
        ("a", 1, "p1", "s1", 0, grey), ("a", 2, "p2", "s1", -1, grey), ("a", 3, "p3", "s3", 0b1111, grey), ("a", 4, "p4", "s4", 0b11111111, grey),
        ("a", 5, "p5", "s5", 0, [200] * 3), ("b", 1, "p6", "s1", 0, grey),
    ]
    out = {r.listing: [f.photo for f in r.frames] for r in P.dedupe(spark.createDataFrame(rows, FRAME), max_photos=30).collect()}
    assert out == {"a": ["p1", "p4", "p5"], "b": ["p6"]}  # p4 is near the dropped p3, far from the kept p1


def test_matches_are_one_to_one_and_ties_go_left_first(spark):
    frame = "array<struct<photo string, bits long, rgb array<long>>>"
    rows = [("x", "y", [("l1", 0, [0]), ("l2", 0, [0]), ("l3", -1, [255])], [("r1", 0, [0]), ("r2", 0, [0])])]
    out = P.matched(spark.createDataFrame(rows, f"low string, high string, left {frame}, right {frame}")).orderBy("place").collect()
    assert [(r.left_photo, r.right_photo, r.similarity) for r in out] == [("l1", "r1", 1.0), ("l2", "r2", 1.0)]


def test_rgb_of_other_lengths_is_far(spark):
    row = spark.range(1).select(P.rgb_distance(F.array(F.lit(1)), F.array(F.lit(1), F.lit(2))).alias("d"), P.hamming(F.lit(0), F.lit(-1).cast("long")).alias("h")).first()
    assert (row.d, row.h) == (1.0, 64)


def test_aliases_of_a_split_are_redirected_kept_or_ambiguous(spark):
    moved = spark.createDataFrame([("1",), ("3",)], "listing string")
    history = spark.createDataFrame([("a", "1"), ("b", "1"), ("b", "2"), ("c", "2")], "alias string, listing string")
    assert {r.alias: r.outcome for r in E.redirect_aliases(history, moved).collect()} == {"a": "child", "b": "split_ambiguous", "c": "kept"}


def _line(group, content):
    return (json.dumps({"custom_id": group, "response": {"body": {"choices": [{"message": {"content": content}}]}}}),)


def test_bad_items_cost_only_themselves(spark):
    items = [
        {"id": "1", "usable": True, "reason_code": "ok", "confidence": "high", "reason": ""}, None, "text",
        {"id": 2, "usable": False, "reason_code": "not_sale", "confidence": "low", "reason": "rent"},
        {"id": "3", "usable": True, "reason_code": "not_sale", "confidence": "low", "reason": "no"},
        {"id": "4", "usable": "true", "reason_code": "ok", "confidence": "high", "reason": ""},
        {"id": "9", "usable": True, "reason_code": "ok", "confidence": "sure", "reason": ""},
    ]
    lines = [_line("g1", json.dumps({"verdicts": items})), _line("g2", "{broken"), ("not json",), (json.dumps({"custom_id": "g3", "response": {"body": {"choices": []}}}),)]
    groups = [("g1", str(i)) for i in range(1, 6)] + [("g2", "6"), ("g3", "7"), ("g4", "8")]
    out = A.parse_outputs(spark.createDataFrame(lines, "value string"), spark.createDataFrame(groups, "custom_id string, listing_id string"))
    found = {r.listing_id: (r.usable, r.reason_code) for r in out.collect()}
    failed = (None, "llm_failed")
    assert found == {"1": (True, "ok"), "2": (False, "not_sale"), "3": failed, "4": failed, "5": failed, "9": failed, "6": failed, "7": failed}


def test_assessments_are_reused_only_in_their_context(spark):
    rows = spark.createDataFrame([("1", "h", 5, None, "A  big\nRoom"), ("2", "h", 6, None, "a big room")], "id string, content_hash string, price int, furniture string, text string")
    old = [("1", "h", "v1", 5, None, "big room", True, "ok"), ("1", "h", "v0", 5, None, "big room", True, "ok"), ("2", "h", "v1", 5, None, "big room", True, "ok"), ("1", "h", "v1", 5, None, " ", True, "ok")]
    known = spark.createDataFrame(old, "id string, content_hash string, version string, price int, furniture string, evidence string, usable boolean, reason_code string")
    assert [(r.id, r.evidence) for r in A.reusable(rows, known, "v1", ["price", "furniture"]).collect()] == [("1", "big room")]


def test_evidence_is_invalid_before_it_is_stale(spark):
    rows = [(1, 2, "r", "uncertain", 0.5, "m"), (1, 2, "q", "uncertain", 0.5, "m"), (1, 2, "r", "uncertain", float("nan"), "m"), (1, 2, "r", None, 0.5, "m"), (1, 2, "q", "likely_same", 1.0, None), (3, 4, "r", "likely_same", 1.0, "m")]
    incoming = spark.createDataFrame(rows, "low int, high int, revision string, decision string, score double, matcher string")
    current = spark.createDataFrame([(1, 2, "r")], "low int, high int, revision string")
    out = A.judge_evidence(incoming, current, ["matcher"]).groupBy("state").count().collect()
    assert {r["state"]: r["count"] for r in out} == {"accepted": 1, "stale": 2, "invalid": 3}
