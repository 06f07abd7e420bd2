"""Links between ids, followed over written tables: chains to their ends, and connected components."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.session import written


class CycleError(ValueError):
    """Aliases lead back to where they began."""


def resolved(aliases: DataFrame) -> DataFrame:
    """old, survivor with every chain followed to its end. One row an old id; a cycle is an error that names ids of it.

    Pointers are doubled: after r rounds each has passed 2^r links, so chains of n aliases end after log2(n) rounds. What
    is then still on its way goes round. Each round is a table; only pointers that are on their way are joined again.
    """
    moving = written(aliases.select("old", "survivor"))
    rounds = math.ceil(math.log2(moving.count() + 1)) + 1
    ended = None
    for _ in range(rounds):
        on = moving.select(F.col("old").alias("survivor"), F.col("survivor").alias("further"))
        # what a pointer may land on has ended in an earlier round, or is on its way itself
        if ended is not None:
            on = on.unionByName(ended.select(F.col("old").alias("survivor"), F.col("survivor").alias("further")))
        step = written(moving.join(on, "survivor", "left"))
        state = step.agg(F.count("further").alias("moving"), F.min(F.when(F.col("further") == F.col("old"), F.col("old"))).alias("round")).first()
        if state["round"] is not None:
            raise CycleError(f"entity alias cycle through {state['round']}")
        done = step.filter("further is null").select("old", "survivor")
        ended = done if ended is None else ended.unionByName(done)
        if not state.moving:
            return ended
        moving = step.filter("further is not null").select("old", F.col("further").alias("survivor"))
    raise CycleError(f"entity alias cycle behind {sorted(str(r.old) for r in moving.select('old').limit(5).collect())}")


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of links (x, y).

    Alternates large and small stars until each component is one star: every node links its larger neighbours, then its
    smaller ones, to the smallest it knows. Rounds grow with the logarithm of the nodes; a star's centre is joined as a
    table of one row a node, which Spark may split where one centre has most of the rows.
    """
    edges = written(links.filter("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        if large:
            smallest = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
            out = both.filter("y > x").join(smallest, "x").select("m", "y")
        else:
            # in an edge x < y: y's smaller neighbours, and y itself, meet the smallest
            smallest = edges.groupBy("y").agg(F.min("x").alias("m"))
            out = edges.join(smallest, "y").select("m", F.col("x").alias("n")).unionByName(smallest.select("m", F.col("y").alias("n"))).select("m", F.col("n").alias("y"))
        return out.filter("m <> y").select(F.col("m").alias("x"), "y").distinct()

    def mark(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first())

    before = mark(edges)
    while True:
        edges = written(star(written(star(edges, True)), False))
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("y").alias("node"), F.col("x").alias("component")).unionByName(edges.select(F.col("x").alias("node"), F.col("x").alias("component")).distinct())
