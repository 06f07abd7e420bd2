"""Conversation prefix trie by truncation peeling: which conversations begin alike, and what sharing their turns would save.

Each conversation is a path of turns. Peeling begins at maximum depth: rows there are conversations that end, a row
each. Rows of one path merge into a node, which adds up its members, leaves and saved tokens; a node loses its last turn
and meets, one turn less deep, the conversations that end there and the other nodes of that path. So each node is found
and summed from its children at once, without a table of all prefixes of all conversations.

A round peels `LEVELS` turns, since a job a turn makes a thousand jobs of a thousand turns; of deeper tries it peels the
root of the depth. In a round, a row gives its truncations of these turns, rows of one path merge, and sums go to the
paths above within the round. Between rounds, only nodes of the uppermost turn go on, with what is left of their path.
Any number of levels gives the same nodes; 1 is the plain method.

An element of a path is 24 bytes: a chained hash of all turns so far, which names the node, and the turn's words. Hot
paths merge in the tasks that make them. The ids that end at a node are sorted by ranges, in tasks that share a hot node
between them and write pieces of bounded length; SHA-256 takes a node's pieces in order, one at a time.

Defined cases: rows without conv_id belong to no conversation. Null role or text is empty. Turns are ordered by number,
null first, then role, then text; repeated turns are turns. A very long text is hashed once and leaves its number of
words; a long conversation is one row of 24 bytes a turn. Other columns play no part, whatever their names. An empty table
has no root: the result is empty.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastra.llm.common import materialise

#: Bytes of an element: hash, words.
HASH, SIZE = 16, 24
#: Turns that a round peels, at least.
LEVELS = 64
#: Conversation ids of a piece of the text that is hashed.
PIECE = 8192

_WORDS = r"[^\x20\x09-\x0D]+"


def _cut(path: Column, start: Column | int, elements: Column | int) -> Column:
    """So many elements of a path, from the one at `start` (0 is the first)."""
    return F.substr(path, (F.lit(start) * SIZE + 1).cast("int"), (F.lit(elements) * SIZE).cast("int"))


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order: their hash and number of words."""
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    name = F.unhex(F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 2 * HASH))
    each = rows.select("conv_id", F.row_number().over(order).alias("at"), name.alias("name"), F.regexp_count("text", F.lit(_WORDS)).cast("long").alias("words"))
    return each.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "name", "words"))).alias("turns"))


def rebuild(own: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """Each conversation c with the first h turns of conversation c - c % every for its own first h; h = crc32(c) % heads."""
    bases = own.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    joined = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(bases, "base", "left")
    none = F.array().cast("array<struct<at int, name binary, words long>>")
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return joined.select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), h), rest).alias("turns"))


def paths(conversations: DataFrame) -> DataFrame:
    """conv_id, depth and path of each conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for names, words in zip(batch.column("names").to_pylist(), batch.column("words").to_pylist()):
                chain, parts = b"", []
                for name, n in zip(names, words):
                    chain = hashlib.blake2b(chain + name, digest_size=HASH).digest()
                    parts += (chain, n.to_bytes(SIZE - HASH, "big"))
                found.append(b"".join(parts))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array([len(p) // SIZE for p in found], pa.int64()), pa.array(found, pa.binary())], ["conv_id", "depth", "path"])

    split = conversations.select("conv_id", F.col("turns.name").alias("names"), F.col("turns.words").alias("words"))
    return split.mapInArrow(run, "conv_id long, depth long, path binary")


def _round(rows: DataFrame, low: int) -> tuple[DataFrame, DataFrame]:
    """Peels rows of more than `low` turns: their nodes, and the rows of `low` turns that go on."""
    level = F.explode(F.sequence(F.lit(low + 1).cast("long"), F.col("depth"))).alias("level")
    own = F.col("level") == F.col("depth")
    cut = rows.select("*", level).select(
        "level",
        _cut(F.col("path"), low, F.col("level") - low).alias("top"),
        F.when(F.col("level") == low + 1, _cut(F.col("path"), 0, low)).alias("stem"),
        "conv_id", "n_convs", *(F.when(own, F.col(c)).otherwise(0).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")),
    )
    merged = cut.groupBy("level", "top", "stem").agg(F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")))
    merged = materialise(merged)
    deep = F.col("level") - low
    above = merged.filter(F.col("level") > low + 1).select((F.col("level") - 1).alias("level"), _cut(F.col("top"), 0, deep - 1).alias("top"))
    children = above.groupBy("level", "top").agg(F.count("*").alias("more"))
    found = merged.join(children, ["level", "top"], "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    words = F.conv(F.hex(F.substr("top", ((deep - 1) * SIZE + HASH + 1).cast("int"), F.lit(SIZE - HASH))), 16, 10).cast("long")
    found = found.withColumns({
        "n_leaves": F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0),
        "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * words,
    })
    found = materialise(found.drop("more"))
    upward = found.select(F.explode(F.sequence(F.lit(low + 1).cast("long"), F.col("level"))).alias("to"), "level", "top", "n_leaves", "saved_tokens")
    sums = upward.groupBy(F.col("to").alias("level"), _cut(F.col("top"), 0, F.col("to") - low).alias("top")).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    nodes = found.drop("n_leaves", "saved_tokens").join(sums, ["level", "top"])
    last = lambda path, n: F.substr(path, ((n - 1) * SIZE + 1).cast("int"), F.lit(SIZE))
    parent = F.when(deep > 1, last(F.col("top"), deep - 1)).when(F.lit(low) > 0, last(F.col("stem"), F.lit(low))).otherwise(F.lit(b""))
    nodes = materialise(nodes.select(F.col("level").alias("depth"), last(F.col("top"), deep).alias("node"), parent.alias("parent"), "stem", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"))
    onward = nodes.filter(F.col("depth") == low + 1).select("conv_id", F.lit(low).cast("long").alias("depth"), F.col("stem").alias("path"), "n_convs", F.lit(1).alias("n_children"), "n_leaves", "saved_tokens")
    return nodes.drop("stem"), onward


def peel(conversations: DataFrame, levels: int | None = None) -> DataFrame:
    """The trie's nodes, by rounds from the greatest depth to the root: depth, node, parent and their counts."""
    depth = conversations.agg(F.max("depth")).first()[0]
    ended = conversations.select("conv_id", "depth", "path", F.lit(1).cast("long").alias("n_convs"), *(F.lit(0).cast("long").alias(c) for c in ("n_children", "n_leaves", "saved_tokens")))
    levels = levels or max(LEVELS, math.isqrt(depth or 0))
    nodes, onward, high = [], None, depth or 0
    while high > 0:
        low = (high - 1) // levels * levels
        rows = ended.filter((F.col("depth") > low) & (F.col("depth") <= high))
        found, onward = _round(rows.unionByName(onward) if onward is not None else rows, low)
        nodes.append(found)
        high = low
    rows = ended.filter("depth = 0")
    rows = rows.unionByName(onward) if onward is not None else rows
    root = rows.agg(F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"))).filter("n_convs > 0")
    root = root.withColumn("n_leaves", F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0))
    out = root.select(F.lit(0).cast("long").alias("depth"), F.lit(b"").alias("node"), F.lit(None).cast("binary").alias("parent"), "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    for found in nodes:
        out = out.unionByName(found)
    return out


def _digests(ends: DataFrame) -> DataFrame:
    """node and ends_sha256: SHA-256 of its conversations' ids in decimal, ascending, joined by commas."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, done = None, [], {"node": [], "first": [], "piece": []}

        def close() -> None:
            done["node"].append(node)
            done["first"].append(ids[0])
            done["piece"].append(",".join(map(str, ids)))
            ids.clear()

        for batch in batches:
            for key, conv_id in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist()):
                if ids and (key != node or len(ids) >= PIECE):
                    close()
                node = key
                ids.append(conv_id)
            if done["node"]:
                yield pa.RecordBatch.from_pydict(done)
                done = {k: [] for k in done}
        if ids:
            close()
            yield pa.RecordBatch.from_pydict(done)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest, done = None, None, {"node": [], "ends_sha256": []}
        for batch in batches:
            for key, piece in zip(batch.column("node").to_pylist(), batch.column("piece").to_pylist()):
                if digest is not None and key == node:
                    digest.update(b"," + piece.encode())
                    continue
                if digest is not None:
                    done["node"].append(node)
                    done["ends_sha256"].append(digest.hexdigest())
                node, digest = key, hashlib.sha256(piece.encode())
            if done["node"]:
                yield pa.RecordBatch.from_pydict(done)
                done = {k: [] for k in done}
        if digest is not None:
            yield pa.RecordBatch.from_pydict({"node": [node], "ends_sha256": [digest.hexdigest()]})

    sorted_ids = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(pieces, "node binary, first long, piece string")
    return sorted_ids.repartition("node").sortWithinPartitions("node", "first").select("node", "piece").mapInArrow(digests, "node binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, levels: int | None = None) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of each node of the rebuilt conversations."""
    found = materialise(paths(rebuild(materialise(turns(conversations)))))
    nodes = materialise(peel(found, levels))
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    ends = _digests(found.select(F.when(F.col("depth") > 0, _cut(F.col("path"), F.col("depth") - 1, 1)).otherwise(F.lit(b"")).alias("node"), "conv_id"))
    out = nodes.join(parents, "parent", "left").join(ends, "node", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
