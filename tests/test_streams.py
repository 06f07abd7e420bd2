"""The presence stream against the batch form, over shuffled files and a restart; paged and cursor sources."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cadastra.sources.pages import OutboxPages, PagedTable
from cadastra.streaming import presence

EVENT = "listing string, at timestamp, event_id long, type string"


def test_the_presence_stream_equals_the_batch_over_shuffled_files(spark, tmp_path):
    presence.use_rocksdb(spark)
    chance, start = random.Random(3), datetime(2024, 1, 1)
    events = [(f"l{chance.randrange(6)}", start + timedelta(hours=chance.randrange(400)), i, chance.choice(["missing", "reactivated", "seen"])) for i in range(150)]
    events.append((None, start, 900, "missing"))
    files = [events[i::5] for i in range(5)]
    last = [("end", start + timedelta(days=200 + i), 1000 + i, "missing") for i in range(3)]  # moves the watermark over all
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    put = lambda rows: spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(source)

    def run():
        rows = presence.stream(spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 2).parquet(source), "30 days")
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()

    for part in files[:3]:
        put(part)
    run()
    for part in (*files[3:], last[:1], last[1:]):
        put(part)
    run()  # begins anew from the checkpoint
    want = presence.history(spark.createDataFrame([e for e in events if e[0]], EVENT), start + timedelta(days=100))
    rows = lambda df: sorted((r.listing, r["at"], r.event) for r in df.filter("listing <> 'end'").collect())
    found = rows(spark.read.parquet(out))
    assert found == rows(want) and {e for _, _, e in found} == {"missing", "reactivated", "off_market"}


def test_grace_ends_strictly_after_a_day(spark):
    at = datetime(2024, 1, 1)
    rows = [("a", at, 1, "missing"), ("a", at + timedelta(hours=24), 2, "reactivated"), ("b", at, 1, "missing"), ("b", at + timedelta(hours=25), 2, "reactivated"), ("c", at, 1, "missing"), ("d", at, 1, "missing"), ("d", at, 2, "missing")]
    got = presence.history(spark.createDataFrame(rows, EVENT), at + timedelta(hours=30)).groupBy("listing").agg(F.count_if(F.col("event") == "off_market").alias("n"), F.count("*").alias("all"))
    assert {r.listing: (r.n, r["all"]) for r in got.collect()} == {"a": (0, 2), "b": (1, 3), "c": (1, 2), "d": (1, 2)}


def pages(folder, n, size, change=None, version="7"):
    folder.mkdir(parents=True, exist_ok=True)
    for start in range(0, n, size):
        rows = [{"id": str(i), "price": i * 1.5, "urls": ["u"]} for i in range(start, min(n, start + size))]
        (folder / f"{start}.json").write_text(json.dumps({"version": version, "total": n, "scope": "s", "scope_revision": 3, "rows": rows} | (change or {} if start else {})))
    return str(folder)


def test_a_pinned_version_is_read_by_pages_and_refuses_drift(spark, tmp_path):
    spark.dataSource.register(PagedTable)

    def load(path, total=25, **options):
        reader = spark.read.format("cadastra_pages").schema("id string, price double, urls string").option("path", path).option("version", "7").option("total", total).option("page", 10)
        return reader.options(**options).load()

    good = pages(tmp_path / "good", 25, 10)
    rows = load(good, scope="s", scopeRevision=3)
    assert rows.rdd.getNumPartitions() == 3 and rows.count() == 25 and rows.filter("id = '24'").first().urls == '["u"]'
    assert load(str(tmp_path / "nothing"), 0).count() == 0
    for name, change, options in (("version", {"version": "8"}, {}), ("total", {"total": 26}, {}), ("empty", {"rows": []}, {}), ("short", {"rows": [{"id": "1"}]}, {}), ("scope", {"scope_revision": 4}, {"scope": "s", "scopeRevision": 3}), ("form", {"rows": None}, {})):
        with pytest.raises(Exception, match="drifted|rows, not"):
            load(pages(tmp_path / name, 25, 10, change), **options).collect()
    with pytest.raises(Exception, match="no page at 20|drifted"):
        load(pages(tmp_path / "ended", 20, 10), 25).collect()


def test_an_outbox_is_read_on_from_its_cursor(spark, tmp_path):
    spark.dataSource.register(OutboxPages)
    folder = tmp_path / "box"
    folder.mkdir()

    def page(after, ids, more, **change):
        (folder / f"{after}.json").write_text(json.dumps({"results": [{"outbox_id": i, "result": {"x": i}} for i in ids], "count": len(ids), "has_more": more, "next_after_id": ids[-1] if ids else None} | change))

    def run():
        rows = spark.readStream.format("cadastra_outbox").schema("outbox_id long, result string").option("path", str(folder)).option("pages", 2).load()
        rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(once=True).start().awaitTermination()
        return sorted(r.outbox_id for r in spark.read.parquet(str(tmp_path / "out")).collect())

    page(0, [1, 2], True)
    page(2, [5], True)
    page(5, [6, 9], False)
    assert run() == [1, 2, 5]  # two pages a batch
    assert run() == [1, 2, 5, 6, 9]
    page(9, [9], False)
    with pytest.raises(Exception, match="ascend"):
        run()
    page(9, [10], True, next_after_id=11)
    with pytest.raises(Exception, match="cursor"):
        run()
    page(9, [10], False, count=2)
    with pytest.raises(Exception, match="not one"):
        run()
    page(9, [10], False)
    assert run()[-1] == 10 and spark.read.parquet(str(tmp_path / "out")).filter("outbox_id = 10").first().result == '{"x": 10}'
