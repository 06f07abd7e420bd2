"""Merges, aliases, splits and manual decisions in order, against a loop over the decisions."""

import random

import pytest
from pyspark.sql import functions as F

from cadastra.operators import decisions as D
from cadastra.operators import graph
from cadastra.operators import merging as M
from cadastra.operators import runlog
from cadastra.session import scratch, written

MEMBERS = "listing string, entity string, created_at string"
DECISIONS = "place long, a string, b string, revision string"
ALIASES = "old string, survivor string"


def keys(spark, *used):
    return spark.createDataFrame([(k,) for k in used], "key string")


def one_by_one(members, decisions, done):
    """Each decision after the one before it: (place, outcome, absorbed, survivor, moved, key), and where listings end."""
    where, since = {m[0]: m[1] for m in members}, {}
    for _, entity, created in members:
        since[entity] = min([t for t in (since.get(entity), created) if t is not None], default=None)
    used, out = set(done), []
    for place, a, b, revision in sorted(decisions):
        x, y = where.get(a), where.get(b)
        if x is None or y is None or x == y:
            out.append((place, "same" if x and y else "unknown", None, None, 0, None))
            continue
        size = {e: sum(v == e for v in where.values()) for e in (x, y)}
        survivor, absorbed = sorted((x, y), key=lambda e: (-size[e], since[e] is not None, since[e] or "", e))
        key = f"merge:{survivor}:{absorbed}:{revision}"
        if key in used:
            out.append((place, "repeated", None, None, 0, key))
            continue
        used.add(key)
        out.append((place, "merged", absorbed, survivor, size[absorbed], key))
        where |= {listing: survivor for listing, e in where.items() if e == absorbed}
    return out, where


def test_a_chain_leaves_one_entity_and_each_decision_keeps_its_revision(spark):
    members = spark.createDataFrame([("1", "A", "1"), ("2", "B", "2"), ("3", "C", "3")], MEMBERS)
    decisions = spark.createDataFrame([(1, "1", "2", "r1"), (2, "2", "3", "r9")], DECISIONS)
    steps = M.merge_steps(members, decisions, keys(spark))
    assert sorted(r.key for r in M.merged(steps).collect()) == ["merge:A:B:r1", "merge:A:C:r9"]
    assert {r.entity for r in M.members_after(members, steps).collect()} == {"A"}
    aliases = M.aliases_after(spark.createDataFrame([("Z", "B")], ALIASES), steps)
    assert {r.old: r.survivor for r in graph.resolved(aliases).collect()} == {"B": "A", "C": "A", "Z": "A"}
    # the same decisions again, and in another batch: nothing moves
    again = M.merge_steps(members, decisions.filter("place = 2"), M.merged(steps).select("key"))
    assert M.merged(again).filter("key = 'merge:A:C:r9'").isEmpty()


def test_batches_of_merges_equal_a_loop(spark):
    chance = random.Random(4)
    members = [(f"l{i}", f"e{chance.randrange(60)}", chance.choice([None, "2024-01-01", "2024-02-01"])) for i in range(140)]
    decisions = [(p, f"l{chance.randrange(143)}", f"l{chance.randrange(143)}", f"r{p % 4}") for p in chance.sample(range(1000), 40)]
    done = [s[5] for s in one_by_one(members, decisions, [])[0] if s[1] == "merged"][::9]
    want, where = one_by_one(members, decisions, done)
    held, asked = spark.createDataFrame(members, MEMBERS), spark.createDataFrame(decisions, DECISIONS)
    for bound in (10_000, 3):  # at 3 the larger components are taken in rounds
        steps = M.merge_steps(held, asked, keys(spark, *done), bound)
        assert sorted(map(str, (tuple(r) for r in steps.filter("outcome <> 'hop'").drop("hop").collect()))) == sorted(map(str, want))
        assert {r.listing: r.entity for r in M.members_after(held, steps).collect()} == where
    blank = F.lit(None).cast("string")
    history = held.select("listing", "entity", F.lit("t0").alias("valid_from"), blank.alias("valid_to"), F.lit("first").alias("reason"), blank.alias("key"))
    after = M.history_after(history, steps, "t1", "seen").cache()
    assert {r.listing: r.entity for r in after.filter("valid_to is null").collect()} == where
    moved = {r.key: r.moved for r in M.merge_events(held, steps).filter("seq = 1").collect()}
    assert {k: len(v) for k, v in moved.items()} == {s[5]: s[4] for s in want if s[1] == "merged"}


def test_empty_batches_change_nothing(spark):
    members = spark.createDataFrame([("1", "A", "1")], MEMBERS)
    steps = M.merge_steps(members, spark.createDataFrame([], DECISIONS), keys(spark))
    assert steps.isEmpty() and M.members_after(members, steps).first().entity == "A"
    assert graph.resolved(spark.createDataFrame([], ALIASES)).isEmpty()
    assert graph.components(spark.createDataFrame([], "x string, y string")).isEmpty()


def test_long_chains_end_and_cycles_are_named(spark):
    chain = spark.range(1000).select(F.col("id").cast("string").alias("old"), (F.col("id") + 1).cast("string").alias("survivor"))
    assert graph.resolved(chain).filter("survivor = '1000'").count() == 1000
    for length in (1, 2, 7):
        ring = spark.range(length).select(F.col("id").cast("string").alias("old"), ((F.col("id") + 1) % length).cast("string").alias("survivor"))
        with pytest.raises(graph.CycleError, match="cycle"):
            graph.resolved(ring.unionByName(spark.createDataFrame([("a", "b")], ALIASES)))


def test_components_of_a_star_a_chain_and_pairs(spark):
    links = [("hub", f"s{i:03d}") for i in range(150)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)] + [("x", "y"), ("y", "x"), ("q", "q")]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "x string, y string")).collect()}
    assert got == {"hub": "hub"} | {f"s{i:03d}": "hub" for i in range(150)} | {f"c{i:03d}": "c000" for i in range(61)} | {"x": "x", "y": "x"}


def test_splits_in_order_with_keys_aliases_and_events(spark):
    members = spark.createDataFrame([("1", "A"), ("2", "A"), ("3", "A"), ("4", "A"), ("9", "B")], "listing string, entity string")
    aliases = spark.createDataFrame([("old", "mid"), ("mid", "A"), ("other", "A"), ("apart", "A")], ALIASES)
    asked = spark.createDataFrame([
        (1, "old", ["2", "1"], "r"), (2, "A", ["1", "2"], "r"), (3, "A", ["1"], "r"), (4, "A", ["3"], "r"), (5, "A", ["4"], "r"), (6, "B", ["9"], "r"), (7, "A", [], "r"), (8, "A", ["1", "2"], "r2"),
    ], "place long, entity string, listings array<string>, revision string")
    none = spark.createDataFrame([], "key string, child string")
    steps = M.split_steps(members, aliases, asked, none)
    got = {r.place: r for r in steps.collect()}
    assert [got[i].outcome for i in range(1, 9)] == ["split", "repeated", "invalid", "split", "invalid", "invalid", "invalid", "invalid"]
    assert got[2].child == got[1].child != got[4].child and {got[i].parent for i in (1, 4)} == {"A"}
    after = {r.listing: r.entity for r in M.split_members(members, steps).collect()}
    assert after == {"1": got[1].child, "2": got[1].child, "3": got[4].child, "4": "A", "9": "B"}
    history = spark.createDataFrame([("1", "old"), ("2", "old"), ("2", "mid"), ("4", "mid"), ("4", "other"), ("1", "apart"), ("3", "apart")], "listing string, entity string")
    names = {r.old: (r.survivor, r.lifecycle) for r in M.split_aliases(aliases, history, steps).collect()}
    assert names == {"old": (got[1].child, "merged"), "mid": (None, "split_ambiguous"), "other": ("A", "merged"), "apart": (None, "split_ambiguous")}
    events = sorted((r.entity, r.event_type, r.seq) for r in M.split_events(steps).collect())
    assert events == sorted([("A", "entity_split", 1)] * 2 + [(got[i].child, "split_child_created", 2) for i in (1, 4)])
    # the same split after it was done: its key is known
    done = steps.filter("outcome = 'split'").select("key", "child")
    assert [r.outcome for r in M.split_steps(M.split_members(members, steps), aliases, asked.filter("place = 1"), done).collect()] == ["repeated"]


def test_manual_decisions_merge_and_set_the_pair(spark):
    members = spark.createDataFrame([("a", "E1", "2"), ("b", "E1", "1"), ("c", "E2", "0"), ("d", "E3", "0")], MEMBERS)
    asked = spark.createDataFrame([(1, "c", "a", "same_entity", "x", "me", "1"), (2, "d", "c", "same_entity", "x", "me", "2"), (3, "b", "d", "different_entity", "x", "me", "1"), (4, "a", "z", "same_entity", "x", "me", "1")], "place long, a string, b string, decision string, reason string, actor string, revision string")
    judged = D.manual(asked, members, keys(spark))
    old = spark.createDataFrame([("a", "c", "different_entity", "0"), ("q", "r", "same_entity", "0")], "low string, high string, decision string, revision string")
    pairs = spark.createDataFrame([("a", "c", "awaiting"), ("c", "d", "awaiting"), ("x", "y", "awaiting")], "low string, high string, status string")
    out = M.apply_manual(judged, members, keys(spark), old, pairs)
    assert {r.entity for r in out["members"].collect()} == {"E1"}
    assert sorted(r.key for r in M.merged(out["steps"]).collect()) == ["merge:E1:E2:manual:1", "merge:E1:E3:manual:2"]
    assert sorted(tuple(r) for r in out["overrides"].collect()) == [("a", "c", "same_entity", "1"), ("b", "d", "different_entity", "1"), ("c", "d", "same_entity", "2"), ("q", "r", "same_entity", "0")]
    assert {(r.low, r.high): r.status for r in out["candidates"].collect()} == {("a", "c"): "manual_linked", ("c", "d"): "manual_linked", ("x", "y"): "awaiting"}
    assert out["events"].count() == 3


def test_the_run_log_knows_what_is_left(spark):
    wanted = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "key string")
    begun = runlog.entries(wanted, "merge", "processing", "t1")
    log = begun.unionByName(runlog.entries(wanted.filter("key = 'a'"), "merge", "completed", "t2"))
    assert sorted(r.key for r in runlog.to_do(wanted, log, "merge").collect()) == ["b", "c"]
    marks = spark.createDataFrame([("b", "failed"), ("a", "processing"), ("z", "completed")], "key string, state string")
    log = log.unionByName(runlog.marked(marks, log, "merge", "t3"))
    now = {r.key: (r.state, r.begun_at) for r in runlog.current(log).collect()}
    assert now == {"a": ("completed", "t1"), "b": ("failed", "t1"), "c": ("processing", "t1")}
    assert [r.key for r in runlog.pending(log, "merge").collect()] == ["c"]
    # compaction changes nothing, nor does the log twice
    assert runlog.current(runlog.current(log.unionByName(log)).select("key", "kind", "state", "at", "detail")).count() == 3
    runs = runlog.entries(spark.createDataFrame([("cleaner/full/1",)], "key string"), "run", "failed", "t4")
    assert [tuple(r) for r in runlog.health_runs(log.unionByName(runs)).collect()] == [("cleaner", "full", "t4", True)]


def test_scratch_tables_go_at_the_end(spark):
    with scratch(spark) as folder:
        assert written(spark.range(3)).count() == 3
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        assert files.exists(place)
    assert not files.exists(place)
