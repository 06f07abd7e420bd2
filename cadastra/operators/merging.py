"""Merges, splits and manual decisions: whole batches, as if each decision were taken after the one before it.

A batch of merges falls into components of entities. What one component's decisions do depends on nothing else, so
components run side by side, each in its own order; a component of more than `BOUND` decisions is not one task's work:
its decisions are taken in rounds, each round all that are the next one of both their entities. Both ways give the same.
"""

from __future__ import annotations



import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.operators import graph
from cadastra.session import written

#: Decisions of a component that one task takes.
BOUND = 10_000

_STEP = "place long, outcome string, absorbed string, survivor string, moved long, key string, hop string"


def operation_key(kind: str, *parts: Column) -> Column:
    return F.concat_ws(":", F.lit(kind), *(p.cast("string") for p in parts))


def child_id(parent: Column, moved_hash: Column, revision: Column) -> Column:
    """A split's child: another one for another parent, set of listings or revision, however often it is computed."""
    return F.concat(F.lit("ent_"), F.sha2(F.concat_ws(":", parent, moved_hash, revision), 256))


def merge_steps(members: DataFrame, decisions: DataFrame, done: DataFrame, bound: int = BOUND, order: Column | None = None) -> DataFrame:
    """What each decision does: place, outcome, absorbed, survivor, moved (listings), key; and hops.

    members: listing, entity, created_at (of the entity, as text). order: text by which ids of one size and time are
    ordered, the id itself if none is given. decisions: place (their order, no two alike), a, b (listings),
    revision. done: key of operations that were done before. Of two entities the one of more listings survives, then the
    older (no time first), then the smaller id, as they are at that decision. outcome: merged; repeated (the key was
    used: nothing moves); same (already one entity); unknown (a listing belongs to no entity). A key holds the decision's
    own revision. hop: rows of outcome 'hop' say that the listings of entity `hop` moved at that place.
    """
    sizes = members.groupBy(F.col("entity").cast("string").alias("entity")).agg(F.count("*").alias("n"), F.min("created_at").cast("string").alias("since"), F.min(order if order is not None else F.col("entity").cast("string")).alias("by"))
    side = lambda listing, name: members.select(F.col("listing").cast("string").alias(listing), F.col("entity").cast("string").alias(name))
    asked = decisions.select(F.col("place").cast("long").alias("place"), F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), F.col("revision").cast("string").alias("revision"))
    links = written(asked.join(side("a", "x"), "a", "left").join(side("b", "y"), "b", "left").select("place", "revision", "x", "y"))
    nothing = F.when(F.col("x").isNull() | F.col("y").isNull(), "unknown").when(F.col("x") == F.col("y"), "same")
    idle = links.withColumn("outcome", nothing).filter("outcome is not null").select("place", "outcome", *(F.lit(None).cast("string").alias(c) for c in ("absorbed", "survivor")), F.lit(0).cast("long").alias("moved"), *(F.lit(None).cast("string").alias(c) for c in ("key", "hop")))
    open_ = links.filter("x <> y")
    of = written(graph.components(open_.select("x", "y")))
    dealt = written(open_.join(of.withColumnRenamed("node", "x"), "x"))
    big = dealt.groupBy("component").count().filter(F.col("count") > bound).select("component")
    sized = of.join(sizes, F.col("node") == F.col("entity")).select("component", "entity", "n", "since", "by")
    # a used key begins with its survivor, which belongs to the component
    used = done.select("key").filter(F.col("key").startswith("merge:")).withColumn("entity", F.split("key", ":")[1]).join(of.withColumnRenamed("node", "entity"), "entity").select("component", "key")
    blank = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    none = [F.lit(None).cast("long").alias("place")]
    rows = (
        sized.select("component", *none, "entity", "n", "since", "by", *blank("x", "y", "revision", "key"))
        .unionByName(dealt.select("component", "place", *blank("entity"), F.lit(None).cast("long").alias("n"), *blank("since", "by"), "x", "y", "revision", *blank("key")))
        .unionByName(used.select("component", *none, *blank("entity"), F.lit(None).cast("long").alias("n"), *blank("since", "by", "x", "y", "revision"), "key"))
    )
    small = rows.join(big, "component", "left_anti").groupBy("component").applyInPandas(_in_order, _STEP)
    out = idle.unionByName(small)
    if not big.isEmpty():
        out = out.unionByName(_in_rounds(dealt.join(big, "component", "left_semi"), sized.join(big, "component", "left_semi"), done))
    return written(out)


def _in_order(rows: pd.DataFrame) -> pd.DataFrame:
    """One component's decisions, one after another."""
    entities = rows[rows.entity.notna()]
    size = {e: (int(n), since if isinstance(since, str) else None, by) for e, n, since, by in zip(entities.entity, entities.n, entities.since, entities.by)}
    parts = {e: [e] for e in size}
    now = {e: e for e in size}
    used = set(rows.key.dropna())
    out: list = []
    for place, x, y, revision in rows[rows.place.notna()].sort_values("place")[["place", "x", "y", "revision"]].itertuples(index=False):
        x, y = now[x], now[y]
        if x == y:
            out.append((int(place), "same", None, None, 0, None, None))
            continue
        survivor, absorbed = sorted((x, y), key=lambda e: (-size[e][0], size[e][1] is not None, size[e][1] or "", *size[e][2:], e))
        key = f"merge:{survivor}:{absorbed}:{revision}"
        if key in used:
            out.append((int(place), "repeated", None, None, 0, key, None))
            continue
        used.add(key)
        out.append((int(place), "merged", absorbed, survivor, size[absorbed][0], key, None))
        # the smaller side moves, so an entity hops no more often than the logarithm of the listings
        for e in parts[absorbed]:
            now[e] = survivor
            out.append((int(place), "hop", absorbed, survivor, 0, key, e))
        parts[survivor] += parts.pop(absorbed)
        size[survivor] = (size[survivor][0] + size[absorbed][0], *size[survivor][1:])
    return pd.DataFrame(out, columns=["place", "outcome", "absorbed", "survivor", "moved", "key", "hop"])


def _in_rounds(links: DataFrame, sized: DataFrame, done: DataFrame) -> DataFrame:
    """The same for components of any size: in a round, each decision that is the next of both its entities."""
    pending = links.select("place", "x", "y", "revision")
    sizes = sized.select("entity", "n", "since", "by")
    now = sized.select(F.col("entity").alias("first"), F.col("entity").alias("last"))
    rank = lambda name: sizes.select(F.col("entity").alias(name), F.struct((-F.col("n")).alias("n"), F.col("since").isNotNull().alias("dated"), "since", "by", "entity").alias(f"{name}_rank"))
    out = None
    while not pending.isEmpty():
        ends = pending.select(F.explode(F.array("x", "y")).alias("e"), "place").groupBy("e").agg(F.min("place").alias("next"))
        next_ = lambda name: ends.select(F.col("e").alias(name), F.col("next").alias(f"{name}_next"))
        ready = pending.join(next_("x"), "x").join(next_("y"), "y").filter("place = x_next and place = y_next").join(rank("x"), "x").join(rank("y"), "y")
        first, last = F.least("x_rank", "y_rank"), F.greatest("x_rank", "y_rank")
        step = ready.select("place", "revision", last["entity"].alias("absorbed"), first["entity"].alias("survivor"), (-last["n"]).alias("moved"))
        step = step.withColumn("key", operation_key("merge", F.col("survivor"), F.col("absorbed"), F.col("revision")))
        step = written(step.join(done.select("key", F.lit(True).alias("used")).distinct(), "key", "left"))
        moves = step.filter("used is null")
        hops = written(now.join(moves.select(F.col("absorbed").alias("last"), "survivor", "place", "key"), "last"))
        blank = lambda c: F.lit(None).cast("string").alias(c)
        found = moves.select("place", F.lit("merged").alias("outcome"), "absorbed", "survivor", "moved", "key", blank("hop"))
        found = found.unionByName(step.filter("used").select("place", F.lit("repeated").alias("outcome"), blank("absorbed"), blank("survivor"), F.lit(0).cast("long").alias("moved"), "key", blank("hop")))
        found = found.unionByName(hops.select("place", F.lit("hop").alias("outcome"), F.col("last").alias("absorbed"), "survivor", F.lit(0).cast("long").alias("moved"), "key", F.col("first").alias("hop")))
        into = moves.select(F.col("absorbed").alias("e"), "survivor")
        renamed = lambda name: into.select(F.col("e").alias(name), F.col("survivor").alias(f"{name}_now"))
        left = pending.join(step.select("place"), "place", "left_anti").join(renamed("x"), "x", "left").join(renamed("y"), "y", "left")
        left = written(left.select("place", F.coalesce("x_now", "x").alias("x"), F.coalesce("y_now", "y").alias("y"), "revision"))
        found = found.unionByName(left.filter("x = y").select("place", F.lit("same").alias("outcome"), blank("absorbed"), blank("survivor"), F.lit(0).cast("long").alias("moved"), blank("key"), blank("hop")))
        pending = left.filter("x <> y")
        grown = moves.groupBy(F.col("survivor").alias("entity")).agg(F.sum("moved").alias("more"))
        gone = moves.select(F.col("absorbed").alias("entity"))
        sizes = written(sizes.join(gone, "entity", "left_anti").join(grown, "entity", "left").select("entity", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), "since", "by"))
        now = written(now.join(into.withColumnRenamed("e", "last"), "last", "left").select("first", F.coalesce("survivor", "last").alias("last")))
        done = written(done.select("key").unionByName(moves.select("key")))
        out = found if out is None else out.unionByName(found)
    return out


def merged(steps: DataFrame) -> DataFrame:
    """The decisions that merged: place, absorbed, survivor, moved, key."""
    return steps.filter("outcome = 'merged'").select("place", "absorbed", "survivor", "moved", "key")


def members_after(members: DataFrame, steps: DataFrame) -> DataFrame:
    """members with each listing in the last entity that it moved to."""
    last = steps.filter("outcome = 'hop'").groupBy(F.col("hop").alias("entity")).agg(F.max_by("survivor", "place").alias("survivor"))
    return members.withColumn("entity", F.col("entity").cast("string")).join(last, "entity", "left").withColumn("entity", F.coalesce("survivor", "entity")).select(*members.columns)


def history_after(history: DataFrame, steps: DataFrame, now: str, reason: str) -> DataFrame:
    """history (listing, entity, valid_from, valid_to, reason, key) after the merges: a row for each entity a listing was moved to."""
    hops = steps.filter("outcome = 'hop'").select(F.col("hop").alias("entity"), "place", "survivor", "key")
    moved = hops.select("entity").distinct().withColumn("gone", F.lit(True))
    marked = history.join(moved, "entity", "left").withColumn("gone", F.coalesce("gone", F.lit(False)) & F.col("valid_to").isNull())
    closed = marked.withColumn("valid_to", F.when(F.col("gone"), F.lit(now)).otherwise(F.col("valid_to"))).select(*history.columns)
    last = hops.groupBy("entity").agg(F.max("place").alias("last"))
    each = marked.filter("gone").select("listing", "entity").join(hops, "entity").join(last, "entity")
    open_ = F.when(F.col("place") < F.col("last"), F.lit(now))
    return closed.unionByName(each.select("listing", F.col("survivor").alias("entity"), F.lit(now).alias("valid_from"), open_.alias("valid_to"), F.lit(reason).alias("reason"), "key"))


def aliases_after(aliases: DataFrame, steps: DataFrame) -> DataFrame:
    """aliases (old, survivor) with those of the merges, each to the entity that took it in; `graph.resolved` follows them."""
    return aliases.unionByName(merged(steps).select(F.col("absorbed").alias("old"), "survivor"))


def merge_events(members: DataFrame, steps: DataFrame) -> DataFrame:
    """key, seq, event_type, entity, moved (sorted listings): two events of each merge."""
    hops = steps.filter("outcome = 'hop'").select(F.col("hop").alias("entity"), "survivor", "key")
    of = members.select(F.col("listing").cast("string").alias("listing"), F.col("entity").cast("string").alias("entity"))
    moved = of.join(hops, "entity").groupBy("key", "survivor").agg(F.array_sort(F.collect_list("listing")).alias("moved"))
    kinds = F.posexplode(F.array(F.lit("entities_merged"), F.lit("memberships_changed"))).alias("seq", "event_type")
    return moved.select("key", kinds, F.col("survivor").alias("entity"), "moved").withColumn("seq", F.col("seq") + 1)


# --- splits ------------------------------------------------------------------------------------------------------


def split_steps(members: DataFrame, aliases: DataFrame, requests: DataFrame, lineage: DataFrame) -> DataFrame:
    """What each split does: place, parent, child, moved_hash, key, outcome, listings.

    requests: place (order), entity (by any name it had), listings (array), revision. lineage: key, child of splits that
    were done. outcome: split; repeated (its key was used: its child is the one of then); invalid (no listing, all of
    them, or one that is not the entity's). Splits of one parent are taken in their order, each on what the earlier left.
    """
    known = graph.resolved(aliases)
    asked = requests.join(known.select(F.col("old").alias("entity"), "survivor"), "entity", "left")
    listings = F.array_sort(F.array_distinct(F.transform("listings", lambda x: x.cast("string"))))
    asked = asked.select("place", F.coalesce("survivor", F.col("entity").cast("string")).alias("parent"), listings.alias("listings"), F.col("revision").cast("string").alias("revision"))
    asked = asked.withColumn("moved_hash", F.sha2(F.to_json("listings"), 256))
    asked = asked.withColumns({"key": operation_key("split", F.col("parent"), F.col("moved_hash"), F.col("revision")), "child": child_id(F.col("parent"), F.col("moved_hash"), F.col("revision"))})
    asked = asked.join(lineage.select("key", F.col("child").alias("earlier")).dropDuplicates(["key"]), "key", "left")
    # a key that comes twice in one batch is done once
    first = asked.groupBy("key").agg(F.min("place").alias("first"))
    asked = written(asked.join(first, "key"))
    repeated = F.col("earlier").isNotNull() | (F.col("place") > F.col("first"))
    out = asked.filter(repeated).select("place", "parent", F.coalesce("earlier", "child").alias("child"), "moved_hash", "key", F.lit("repeated").alias("outcome"), "listings")
    pending = asked.filter(~repeated).drop("earlier", "first")
    held = members.select(F.col("listing").cast("string").alias("listing"), F.col("entity").cast("string").alias("entity"))
    while not pending.isEmpty():
        turn = pending.groupBy("parent").agg(F.min("place").alias("place"))
        now = pending.join(turn, ["parent", "place"])
        asked_for = now.select("parent", "place", F.explode("listings").alias("listing"))
        there = asked_for.join(held.select("listing", F.col("entity").alias("parent")), ["listing", "parent"]).groupBy("place").agg(F.count("*").alias("there"))
        sizes = held.groupBy(F.col("entity").alias("parent")).agg(F.count("*").alias("all"))
        valid = (F.size("listings") > 0) & (F.col("there") == F.size("listings")) & (F.col("there") < F.col("all"))
        judged = written(now.join(there, "place", "left").join(sizes, "parent", "left").withColumn("outcome", F.when(F.coalesce(valid, F.lit(False)), "split").otherwise("invalid")))
        gone = judged.filter("outcome = 'split'").select(F.explode("listings").alias("listing"), "child")
        held = written(held.join(gone, "listing", "left").select("listing", F.coalesce("child", "entity").alias("entity")))
        out = out.unionByName(judged.select(*out.columns))
        pending = written(pending.join(now.select("place"), "place", "left_anti"))
    return written(out)


def split_members(members: DataFrame, steps: DataFrame) -> DataFrame:
    """members after the splits; of a listing that moved twice, the last child."""
    gone = steps.filter("outcome = 'split'").select("place", F.explode("listings").alias("listing"), "child").groupBy("listing").agg(F.max_by("child", "place").alias("child"))
    return members.withColumn("listing", F.col("listing").cast("string")).join(gone, "listing", "left").withColumn("entity", F.coalesce("child", F.col("entity").cast("string"))).select(*members.columns)


def split_aliases(aliases: DataFrame, history: DataFrame, steps: DataFrame) -> DataFrame:
    """old, survivor, lifecycle after the splits: redirected, kept, or dropped as ambiguous.

    history: listing, entity of all times. An alias of a parent whose listings of old all moved to one child leads to the
    child from now on; one of which some moved is dropped (survivor null, lifecycle split_ambiguous); others stay.
    """
    ends = graph.resolved(aliases).select("old", F.col("survivor").alias("parent"))
    split = steps.filter("outcome = 'split'")
    past = history.select(F.col("listing").cast("string").alias("listing"), F.col("entity").cast("string").alias("old")).distinct().join(ends, "old")
    gone = split.select("parent", "place", "child", F.explode("listings").alias("listing"))
    marked = past.join(gone, ["parent", "listing"], "left").groupBy("old").agg(F.count_distinct("listing").alias("n"), F.count_distinct(F.when(F.col("child").isNotNull(), F.col("listing"))).alias("moved"), F.count_distinct("child").alias("children"), F.min("child").alias("child"))
    judged = aliases.select("old", "survivor").join(marked, "old", "left")
    moved = F.coalesce("moved", F.lit(0))
    whole = (F.col("moved") == F.col("n")) & (F.col("children") == 1)
    survivor = F.when(moved == 0, F.col("survivor")).when(whole, F.col("child"))
    lifecycle = F.when((moved > 0) & ~whole, "split_ambiguous").otherwise("merged")
    return judged.select("old", survivor.alias("survivor"), lifecycle.alias("lifecycle"))


def split_events(steps: DataFrame) -> DataFrame:
    """key, seq, event_type, entity, other, moved: two events of each split, the parent's and the child's."""
    done = steps.filter("outcome = 'split'")
    kinds = F.posexplode(F.array(F.lit("entity_split"), F.lit("split_child_created"))).alias("seq", "event_type")
    each = done.select("key", "parent", "child", "listings", kinds)
    own, other = F.when(F.col("seq") == 0, F.col("parent")).otherwise(F.col("child")), F.when(F.col("seq") == 0, F.col("child")).otherwise(F.col("parent"))
    return each.select("key", (F.col("seq") + 1).alias("seq"), "event_type", own.alias("entity"), other.alias("other"), F.col("listings").alias("moved"))


# --- manual decisions --------------------------------------------------------------------------------------------


def apply_manual(judged: DataFrame, members: DataFrame, done: DataFrame, overrides: DataFrame, candidates: DataFrame) -> dict[str, DataFrame]:
    """Applies judged decisions (`decisions.manual`, with place): merges, overrides, the pairs' status and events.

    Returns steps (of the merges), members, overrides (low, high, decision, revision), candidates (low, high, status, ...)
    and events (key, seq, event_type, entity). A pair's last decision counts; its merge is under `manual:` and its revision.
    """
    applied = judged.filter("outcome = 'applied'")
    same = applied.filter("decision = 'same_entity'")
    steps = merge_steps(members, same.select("place", F.col("low").alias("a"), F.col("high").alias("b"), F.concat(F.lit("manual:"), "revision").alias("revision")), done)
    after = members_after(members, steps)
    last = written(applied.groupBy("low", "high").agg(F.max_by(F.struct("decision", "revision", "status"), "place").alias("d")).select("low", "high", "d.*"))
    kept = overrides.join(last.select("low", "high"), ["low", "high"], "left_anti").select("low", "high", "decision", "revision")
    pairs = candidates.join(last.select("low", "high", F.col("status").alias("new")), ["low", "high"], "left")
    of = after.select(F.col("listing").cast("string").alias("low"), F.col("entity").cast("string").alias("entity"))
    events = applied.select("key", "low").join(of, "low", "left").select("key", F.lit(1).alias("seq"), F.lit("manual_match_decision").alias("event_type"), "entity")
    return {
        "steps": steps,
        "members": after,
        "overrides": kept.unionByName(last.select("low", "high", "decision", "revision")),
        "candidates": pairs.withColumn("status", F.coalesce("new", "status")).select(*candidates.columns),
        "events": events,
    }
