"""N-gram Jaccard join: groups of documents whose word-shingle sets are similar, exactly.

A document's set holds its distinct five-word shingles (A-Z lower-cased, ASCII white space); with fewer words, its
whole word sequence. Two documents link when 100 * intersection >= 80 * union. Result: one row per document with its
set's size and the smallest doc_id that links reach from it.

1. Shingle counts: every task packs the hashes of its documents into sorted arrays by hash range; per range they are
   merged, and the base-2 logarithm of each count of four or more goes into a table of fixed size (`SKETCH_MAX` bytes
   at most). A global order by (that level, hash) puts shared passages last. Any order is exact.
2. Adaptive multi-match prefixes: overlap o is needed with any partner, so the first n - o + l shingles of two linked
   sets share l. Each document takes the l of least estimated cost (its prefix's expected postings against their
   number) and a pair must share the smaller of both l.
3. Equal texts become one vertex (their smallest doc_id). Two rounds of candidates: first each prefix shingle's documents against the one among
   them with the fewest rare shingles, which joins large groups of near copies without listing their pairs; then all
   pairs of different components so far. Positions in the order and parity signatures bound the overlap, exactly, and
   cut pairs in the join itself.
4. Candidates are verified on whole texts; components come from minimum labels with pointer jumping.

Shingles of about `HOT` documents or more are known from the counts; their documents are counted and compared by a
pre-aggregation and a join that Spark may split, those of others by one window.

Defined cases: null, empty and white-space texts have no shingles and link with nothing. Rows that repeat a doc_id are
texts of one document: whatever links to one of them links to all, and each row is returned. A row with a null doc_id
takes the component of an equal text, else null. Equally similar pairs all link, there are no ties to break. Other
columns of docs play no part. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadastra.llm.common import map_batches, materialise, sliced

WORDS = 5
PERCENT = 80
MAX_MATCH = 4
SKETCH_MAX = 1 << 26
#: Counted hashes in one merge group, about.
GROUP_HASHES = 4_000_000
CANDIDATE_BITS = 1 << 24
#: Shingles of so high a level (4,096 documents, about) are grouped in two steps.
HOT = 12
#: 64-bit words of a set's parity signature.
SIGNATURE = 8
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def words_of(text: str) -> list[bytes]:
    # bytes.lower() folds A-Z only, bytes.split() knows just the six ASCII spaces
    return text.encode().lower().split()


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the words' shingles."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64)
    w = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), np.uint64)
    n = len(w) - WORDS + 1
    h = w[:n] * _MULTIPLIERS[0]
    for i in range(1, WORDS):
        h = ((h << np.uint64(23)) | (h >> np.uint64(41))) + w[i : n + i] * _MULTIPLIERS[i]
    h ^= h >> np.uint64(32)
    h *= _MULTIPLIERS[1]
    h ^= h >> np.uint64(29)
    return np.unique(h)


def least_overlap(n: int) -> int:
    """Shingles that a set of n shares with any linked set, at least."""
    return -(-PERCENT * n // 100)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return bool(both) and 100 * both >= PERCENT * (len(a) + len(b) - both)


def _count_levels(texts: DataFrame, chars: int) -> tuple[np.ndarray, int]:
    """Levels (base-2 logarithms of document counts) by the hash's top bits; the number of those bits."""
    hashes = chars // 6
    bits = min(SKETCH_MAX.bit_length() - 1, max(20, (hashes // 8).bit_length()))
    group_bits = min(bits, max(4, (hashes // GROUP_HASHES).bit_length()))

    def pack(batch: dict) -> dict:
        sets = [s for s in (shingles(words_of(t)) for t in batch["text"].to_pylist()) if len(s)]
        every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        values, counts = np.unique(every, return_counts=True)
        group = (values >> np.uint64(64 - group_bits)).astype(np.int64)
        cuts = np.searchsorted(group, np.arange((1 << group_bits) + 1))
        kept = [g for g in range(1 << group_bits) if cuts[g + 1] > cuts[g]]
        rest = ((values << np.uint64(group_bits)) >> np.uint64(32)).astype("<u4")
        few = np.minimum(counts, 255).astype(np.uint8)
        return {
            "g": pa.array(kept, pa.int32()),
            "hashes": pa.array([rest[cuts[g] : cuts[g + 1]].tobytes() for g in kept], pa.binary()),
            "counts": pa.array([few[cuts[g] : cuts[g + 1]].tobytes() for g in kept], pa.binary()),
        }

    def merge(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rest = np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in rows.column("hashes")])
        counts = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in rows.column("counts")])
        order = np.argsort(rest)
        rest = rest[order]
        starts = np.flatnonzero(np.concatenate([[True], rest[1:] != rest[:-1]]))
        totals = np.add.reduceat(counts[order].astype(np.int64), starts)
        level = np.minimum(np.log2(totals), 30).astype(np.uint8)
        cells = np.zeros(1 << (bits - group_bits), np.uint8)
        np.maximum.at(cells, rest[starts] >> np.uint32(32 - (bits - group_bits)) if bits > group_bits else np.zeros(len(starts), np.int64), level)
        used = np.flatnonzero(cells >= 2)
        return pa.table({"g": pa.array([key[0].as_py()], pa.int32()), "used": [used.astype("<u4").tobytes()], "level": [cells[used].tobytes()]})

    table = np.zeros(1 << bits, np.uint8)
    packed = map_batches(texts.select("text"), pack, "g int, hashes binary, counts binary")
    for row in packed.groupBy("g").applyInArrow(merge, "g int, used binary, level binary").toLocalIterator():
        table[(row.g << (bits - group_bits)) + np.frombuffer(row.used, "<u4").astype(np.int64)] = np.frombuffer(row.level, np.uint8)
    return table, bits


def prefix(h: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, int, int, int]:
    """The set's prefix in the global order, its l, how many of its shingles are rare (level under 2), and where in the prefix the hot ones begin."""
    n, need = len(h), least_overlap(len(h))
    order = np.lexsort((h, levels))
    expected = np.cumsum((1 << levels[order].astype(np.int64)) - 1)
    best, matches = None, 1
    for candidate in range(1, min(MAX_MATCH, need) + 1):
        size = n - need + candidate
        cost = expected[size - 1] / candidate + size / 8
        if best is None or cost < best:
            best, matches = cost, candidate
    chosen = order[: n - need + matches]
    return h[chosen], matches, int((levels < 2).sum()), int((levels[chosen] < HOT).sum())


def _prefixes(texts: DataFrame, table: np.ndarray, bits: int) -> DataFrame:
    sent = texts.sparkSession.sparkContext.broadcast(table)  # SKETCH_MAX bytes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = sent.value
        for batch in sliced(batches):
            c1, c2, size, match, rare, hot, tokens, parity = [], [], [], [], [], [], [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                h = shingles(words)
                key = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words)), np.int64)
                first, m, r, from_ = prefix(h, levels[h >> np.uint64(64 - bits)]) if len(h) else (h, 0, 0, 0)
                c1.append(key[0])
                c2.append(key[1])
                size.append(len(h))
                match.append(m)
                rare.append(r)
                hot.append(from_)
                tokens.append(first.view(np.int64))
                odd = np.bincount((h & np.uint64(64 * SIGNATURE - 1)).astype(np.int64), minlength=64 * SIGNATURE) & 1
                parity.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(size, pa.int64()), pa.array(match, pa.int32()), pa.array(rare, pa.int32()), pa.array(hot, pa.int32()), pa.array(tokens, pa.list_(pa.int64())), pa.array(parity, pa.list_(pa.int64()))],
                ["doc_id", "c1", "c2", "n", "match", "rare", "hot", "tokens", "parity"],
            )

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id long, c1 long, c2 long, n long, match int, rare int, hot int, tokens array<bigint>, parity array<bigint>")


def _may_link(a: str, b: str):
    """Sizes are near enough, and the overlap can still be enough at these positions (from 0) in the order."""
    na, nb, pa_, pb, ma, mb = (F.col(f"{s}.{c}") for c in ("n", "at", "match") for s in (a, b))
    fewest = F.least(ma, mb)
    most = F.least(fewest + F.least(na - pa_, nb - pb) - 1, na, nb)
    return (100 * F.least(na, nb) >= PERCENT * F.greatest(na, nb)) & (100 * most >= PERCENT * (na + nb - most))


def _near_parity(a: str, b: str):
    """Bits in which the parity signatures differ are shingles of one set only; linked sets have a ninth of both at most."""
    words = [F.bit_count(F.col(f"{a}.parity")[i].bitwiseXOR(F.col(f"{b}.parity")[i])) for i in range(SIGNATURE)]
    return (100 + PERCENT) * sum(words[1:], words[0]) <= (100 - PERCENT) * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The linked ones among pairs (a, b)."""
    spark = pairs.sparkSession
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).select(F.pmod(F.xxhash64("id"), F.lit(CANDIDATE_BITS)).alias("bit"))
    rows = ids.groupBy(F.bitmap_bucket_number(F.col("bit") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit") + 1)).alias("bits")).collect()  # CANDIDATE_BITS at most
    bitmap = np.zeros(CANDIDATE_BITS // 8 + 8192, np.uint8)
    for row in rows:
        start = (row.bucket - 1) * 4096
        bitmap[start : start + 4096] = np.frombuffer(row.bits, np.uint8)
    sent = spark.sparkContext.broadcast(bitmap)

    def shrink(batch: dict) -> dict | None:
        bit = batch["bit"].to_numpy()
        # the functions count from 1: bucket b holds bits (b - 1) * 32768 + 0..32767
        at = np.flatnonzero((sent.value[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1)
        if not len(at):
            return None
        pack = zstandard.ZstdCompressor(level=1).compress
        return {"id": batch["doc_id"].take(pa.array(at)), "z": pa.array([pack(t.encode()) for t in batch["text"].take(pa.array(at)).to_pylist()], pa.binary())}

    keyed = texts.filter("doc_id is not null").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(CANDIDATE_BITS)).alias("bit"))
    packed = map_batches(keyed, shrink, "id long, z binary")

    def compare(batch: dict) -> dict:
        unpack = zstandard.ZstdDecompressor().decompress
        seen: dict[bytes, np.ndarray] = {}
        hits = []

        def of(z: bytes) -> np.ndarray:
            if z not in seen:
                if len(seen) > 256:
                    seen.clear()
                seen[z] = shingles(words_of(unpack(z).decode()))
            return seen[z]

        for i, (x, y) in enumerate(zip(batch["za"].to_pylist(), batch["zb"].to_pylist())):
            if linked(of(x), of(y)):
                hits.append(i)
        hit = pa.array(hits, pa.int64())
        return {"a": batch["a"].take(hit), "b": batch["b"].take(hit)}

    both = pairs.join(packed.select(F.col("id").alias("a"), F.col("z").alias("za")), "a").join(packed.select(F.col("id").alias("b"), F.col("z").alias("zb")), "b")
    return map_batches(both.select("a", "b", "za", "zb"), compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """id, label (the component's smallest id) of every vertex of edges (a, b)."""
    edges = materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = materialise(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low")).select("id", F.least("low", "id").alias("label")))
    while True:
        near = edges.join(labels, edges["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("low"))
        lower = labels.join(near, labels["id"] == near["a"]).select("id", F.least("label", "low").alias("next"), "label")
        # the label's own label: halves the way to the smallest id
        jump = lower.select(F.col("id").alias("at"), F.col("next").alias("further"))
        after = materialise(lower.join(jump, lower["next"] == jump["at"], "left").select("id", F.least("next", "further").alias("next"), "label"))
        changed = after.filter("next <> label").limit(1).count()
        labels = after.select("id", F.col("next").alias("label"))
        if not changed:
            return labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    table, bits = _count_levels(texts, chars)
    sets = materialise(_prefixes(texts, table, bits))
    whole = sets.filter("n > 0")
    classes = materialise(whole.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("members")))
    own = [F.col("doc_id").alias("copy"), F.col("c1").alias("k1"), F.col("c2").alias("k2")]
    again = materialise(whole.join(classes.filter("members > 1"), ["c1", "c2"]).groupBy(*own).agg(F.first(F.col("doc_id").eqNullSafe(F.col("rep"))).alias("is_rep"), F.count("*").alias("times")))
    repeated = not again.filter("is_rep and times > 1").isEmpty()

    def firsts(rows: DataFrame) -> DataFrame:
        """One row of each class: that of its smallest doc_id."""
        marked = rows.filter("doc_id is not null").join(again, (F.col("doc_id") == F.col("copy")) & (F.col("c1") == F.col("k1")) & (F.col("c2") == F.col("k2")), "left")
        once = marked.filter("copy is null or (is_rep and times = 1)").select(*rows.columns)
        return once.union(marked.filter("is_rep and times > 1").select(*rows.columns).dropDuplicates(["doc_id", "c1", "c2"])) if repeated else once

    # a doc_id with several texts joins their classes
    several = whole.filter("doc_id is not null").join(classes, ["c1", "c2"]).groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("high"), F.collect_set("rep").alias("reps"))
    several = several.filter("a <> high").select("a", F.explode("reps").alias("b")).filter("a <> b").distinct()
    # only shingles of several documents go on
    posting = [F.col("doc_id").alias("id"), "n", "match", "rare"]
    cold = firsts(whole).select(*posting, F.posexplode(F.slice("tokens", F.lit(1), F.col("hot"))).alias("at", "token"))
    hot = firsts(whole.filter(F.size("tokens") > F.col("hot"))).select(*posting, "hot", F.posexplode(F.slice("tokens", F.col("hot") + 1, F.size("tokens"))).alias("at", "token"))
    hot = materialise(hot.withColumn("at", F.col("at") + F.col("hot")).drop("hot"))
    by_token = Window.partitionBy("token")
    entry = F.struct("rare", "id", "n", "at", "match")
    in_window = cold.withColumns({"of_token": F.count("*").over(by_token), "hub": F.min(entry).over(by_token)}).filter("of_token > 1").drop("of_token", "rare")
    hubs = hot.groupBy("token").agg(F.count("*").alias("of_token"), F.min(entry).alias("hub")).filter("of_token > 1").drop("of_token")
    columns = ["token", "id", "n", "match", "at", "hub"]
    shared = materialise(in_window.select(columns).union(hot.join(hubs, "token").select(columns)))
    p = shared.select("token", F.struct("id", "n", "match", "at").alias("x"), "hub").filter(F.col("x.id") != F.col("hub.id")).filter(_may_link("x", "hub"))
    star = _enough(p.select(F.col("x").alias("x"), F.col("hub").alias("y")))
    star = materialise(star)
    links = materialise(_verify(star, texts).union(several))
    label = components(links)
    placed = shared.select("token", "id", "n", "match", "at").join(label.withColumnRenamed("label", "part"), "id", "left").withColumn("part", F.coalesce("part", "id"))
    mixed = placed.groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high").select("token")
    open_ = materialise(placed.join(mixed, "token").join(whole.select(F.col("doc_id").alias("id"), "parity").distinct(), "id"))
    x, y = (open_.select("token", F.struct("id", "n", "match", "at", "parity").alias(s), F.col("part").alias(f"part_{s}")) for s in "xy")
    crossing = x.join(y, "token").filter((F.col("part_x") != F.col("part_y")) & (F.col("x.id") < F.col("y.id")) & _may_link("x", "y") & _near_parity("x", "y"))
    cross = _enough(crossing.select("x", "y")).join(star, ["a", "b"], "left_anti")
    more = materialise(_verify(materialise(cross), texts))
    label = components(links.union(more))

    def placed_in(rows: DataFrame) -> DataFrame:
        of_class = rows.select("doc_id", "c1", "c2", "n").join(classes.select("c1", "c2", "rep"), ["c1", "c2"]).join(label, F.col("rep") == F.col("id"), "left")
        return of_class.select("doc_id", "n", F.coalesce("label", "rep").alias("component_id"))

    blank = sets.filter("n = 0").select("doc_id", "n")
    # other texts of the same doc_id
    beside = placed_in(whole.join(blank.select("doc_id").distinct(), "doc_id", "left_semi")).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    blank = blank.join(beside, "doc_id", "left").select("doc_id", "n", F.coalesce("component_id", "doc_id").alias("component_id"))
    return placed_in(whole).union(blank).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _enough(rows: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) that share as many prefix shingles as the less demanding one asks."""
    low, high = F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")
    return rows.groupBy(low, high).agg(F.count("*").alias("n_shared"), F.min(F.least("x.match", "y.match")).alias("need")).filter("n_shared >= need").select("a", "b")
