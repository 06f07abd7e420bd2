"""Semantics of the listing operators on small rows."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from cadastra.functions import text as X
from cadastra.operators import candidates as C
from cadastra.operators import history as H
from cadastra.operators import verdicts as V
from cadastra.plans import catalogue
from cadastra.sources import snapshot
from cadastra.streaming import ingest


def at(day):
    return dt.datetime(2024, 1, day)


def test_blocks_over_the_limit_give_no_pairs(spark):
    rows = spark.createDataFrame([(i, "big" if i < 5 else "small") for i in range(7)], "id long, k string")
    pairs = C.candidate_pairs(rows, {"k": F.col("k")}, max_block=4)
    assert [(r.low, r.high) for r in pairs.collect()] == [(5, 6)]
    assert "Cartesian" not in pairs._jdf.queryExecution().toString()


def test_quotas_by_largest_remainder():
    assert C.largest_remainder(500, [100, 70, 50, 80, 60, 40, 40, 35, 25]) == [100, 70, 50, 80, 60, 40, 40, 35, 25]
    assert sum(C.largest_remainder(7, [1, 1, 1])) == 7


def test_priority_of_three_reasons_both_active_and_near(spark):
    row = spark.range(1).select(C.priority(F.array(*map(F.lit, "abc")), F.lit(True), F.lit(True)).alias("p")).first()
    assert row.p == 87


def test_market_periods_merge_touching_intervals(spark):
    spans = spark.createDataFrame([("a", at(1), at(3)), ("a", at(3), at(4)), ("a", at(6), None), ("a", at(7), at(8)), ("b", at(1), at(2))], "k string, start timestamp_ntz, end timestamp_ntz")
    out = {(r.k, r.period): (r.start, r.end) for r in H.merged_intervals(spans, "k").collect()}
    assert out == {("a", 1): (at(1), at(4)), ("a", 2): (at(6), None), ("b", 1): (at(1), at(2))}


def test_interval_merge_of_unknown_dates_and_of_equal_spans(spark, tmp_path):
    orders = [(1, at(1)), (2, at(3)), (3, None), (4, None), (5, at(6)), (6, at(7))]
    lines = [(1, 1, at(5)), (2, 1, None), (3, 1, at(9)), (4, 2, None), (4, 2, None), (2, 3, at(2)), (4, 5, at(5)), (1, 5, at(2)), (2, None, at(4)), (6, 1, at(2))]
    lines += [(5, 4, dt.datetime(9999, 12, 31))] + [(o, 6, at(1)) for o in (1, 2, 2, 2, 5, 5, 6, 6, 6)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    got = [tuple(r) for r in catalogue.QUERIES["interval_merge"](spark, str(tmp_path)).collect()]
    duck = duckdb.connect(config={"threads": 1})  # with more, its windows may sort equal spans in two orders
    for name in ("lineitem", "orders"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert sorted(got, key=repr) == sorted(duck.execute(catalogue.ORACLES["interval_merge"]).fetchall(), key=repr)
    assert {r[1:] for r in got if r[0] == 6} == {(1, "2024-01-01", "2024-01-01"), (2, "2024-01-03", "2024-01-03"), (3, "2024-01-06", "2024-01-06"), (4, "2024-01-07", "2024-01-07")}


def test_canonical_prefers_active_then_cheapest_then_current(spark):
    rows = spark.createDataFrame([("e", 1, False, 1.0, False), ("e", 2, True, 9.0, False), ("e", 3, True, 5.0, False), ("e", 4, True, 5.0, True), ("f", 5, False, 3.0, False), ("g", 6, True, float("nan"), False), ("g", 7, True, 2.0, False)], "e string, id int, active boolean, price double, cur boolean")
    out = {r.e: r.id for r in H.canonical(rows, "e", F.col("active"), F.col("price"), F.col("cur"), [F.desc("id")]).collect()}
    assert out == {"e": 4, "f": 5, "g": 7}


def test_gate_and_changed(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id int, h string")
    known = spark.createDataFrame([(1, "x"), (2, "z"), (3, None)], "id int, h string")
    assert [(r.id, r.is_new) for r in V.changed(rows, known, "id", "h").collect()] == [(2, False)]
    states = spark.createDataFrame([(1, True), (0, True), (None, True), (1, False)], "usable int, current boolean")
    assert [r.g for r in states.select(V.gate(F.col("usable"), F.col("current")).alias("g")).collect()] == ["publish", "rejected", "waiting", "waiting"]


def test_set_hash_ignores_order_and_empty_is_null(spark):
    row = spark.range(1).select(X.set_hash(F.array(F.lit("b"), F.lit("a"))).alias("x"), X.set_hash(F.array(F.lit("a"), F.lit("b"))).alias("y"), X.set_hash(F.array().cast("array<string>")).alias("z")).first()
    assert row.x == row.y and row.z is None


def test_publish_moves_the_pointer_and_keeps_out_empty_versions(spark, tmp_path):
    root = f"file://{tmp_path}"
    assert snapshot.publish(spark.range(3), root, "v1")
    assert not snapshot.publish(spark.range(0), root, "v2")
    assert snapshot.read_current(spark, root).count() == 3
    with pytest.raises(snapshot.SnapshotError):
        snapshot.reject_if(spark.range(3), F.col("id") > 1, "id", "too large")


def test_ingest_is_idempotent_and_aborts_on_conflict(spark, tmp_path):
    events = spark.createDataFrame([(1, "a"), (2, "b")], "event_id long, payload string")
    store = str(tmp_path / "store")
    assert ingest.ingest_batch(events, store, ["event_id", "payload"]) == 2
    assert ingest.ingest_batch(events, store, ["event_id", "payload"]) == 0
    with pytest.raises(ingest.EventConflict):
        ingest.ingest_batch(events.withColumn("payload", F.lit("c")), store, ["event_id", "payload"])


def test_stream_ingests_files_once(spark, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    spark.createDataFrame([(1, "a"), (2, "b")], "event_id long, payload string").write.parquet(source)
    for _ in range(2):
        stream = spark.readStream.schema("event_id long, payload string").parquet(source)
        ingest.stream(stream, store, str(tmp_path / "offsets"), ["event_id", "payload"]).start().awaitTermination()
    assert spark.read.parquet(store).count() == 2
