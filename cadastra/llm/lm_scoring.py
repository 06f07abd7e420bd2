"""Language-model scoring: prediction by partial matching over bytes, and a smoothed word model as base.

The byte model is a trie of contexts of up to `ORDER` bytes with the counts of what followed them in all training
texts (those outside the held-out tenth). An end of text is a symbol of its own, the 257th; it also stands before a text. A byte is coded in the longest context seen; where
it was never seen there, the model escapes (by the number of distinct followers) to the context that is one byte
shorter, and excludes from it all followers of the longer one. As the trie is fixed once it is trained, a follower's
code length depends on it and the `ORDER` bytes before it only (its code). All counts are kept, as tables of one row
for each code. The `NODES` commonest codes, with their final lengths, are sent to all tasks as a quick path; every
other code of a text is counted per text and joined with the whole table, or, where training lacks it, with the
lengths that the shorter orders give. `NODES` has no influence on the result.

The base model counts the words of all training texts. The commonest `HOT_WORDS` are sent to all tasks; every other
word of a text is joined with the counts, after it has been counted per text.

Defined cases: null text equals empty text: only an end is coded. Rows that repeat a doc_id are scored each. Without
training texts, symbols are uniform and the base's N and V are 0. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastra.llm.common import crc_mod, map_batches, materialise, sliced

ORDER = 4
#: The symbol of an end, and the bits of a symbol in a code.
END, BITS = 256, 9
NODES = 400_000
HOT_WORDS = 60_000
HELD_OUT_MODULUS = 10
BLOCK = 1 << 20
ALPHA = 0.1


def _codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For every byte and end of the texts: itself and the ORDER symbols before it (ends before the text) as a number of
    BITS bits each; and the number of codes of each text."""
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    starts = np.cumsum(lengths + ORDER) - (lengths + ORDER)
    joined = np.frombuffer(b"".join(b"\0" * ORDER + t + b"\0" for t in texts), np.uint8).astype(np.uint16)
    for i in range(ORDER):
        joined[starts + i] = END
    joined[starts + ORDER + lengths - 1] = END
    code = np.zeros(len(joined) - ORDER if len(joined) else 0, np.uint64)
    for i in range(ORDER + 1):
        code = (code << np.uint64(BITS)) | joined[i : len(joined) - ORDER + i]
    keep = np.ones(len(code), bool)
    for i in range(ORDER):
        # codes that end in the padding before a text
        past = starts[1:] - ORDER + i
        keep[past] = False
    return code[keep], lengths


class Table:
    """Positions of sorted distinct keys, by open addressing over whole arrays."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        size = 1 << self.bits
        self.keys, self.place = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        slot, pending = self._slot(keys), np.arange(len(keys))
        while len(pending):
            free = self.place[slot[pending]] < 0
            at, first = np.unique(slot[pending[free]], return_index=True)
            won = pending[free][first]
            self.place[at], self.keys[at] = won, keys[won]
            pending = pending[~np.isin(pending, won)]
            slot[pending] = (slot[pending] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = self.place[slot]
        open_ = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.place) - 1)
            out[open_] = self.place[slot[open_]]
            open_ = open_[(out[open_] >= 0) & (self.keys[slot[open_]] != keys[open_])]
        return out


def count_contexts(texts: DataFrame) -> DataFrame:
    """code, n: every context of ORDER bytes with its follower in texts (text)."""

    def run(batch: dict) -> dict:
        parts, part, size = [], [], 0
        for text in batch["text"].to_pylist() + [None]:
            if text is not None:
                part.append(text.encode())
                size += len(part[-1])
            if part and (text is None or size > 4 * BLOCK):
                parts.append(np.unique(_codes(part)[0], return_counts=True))
                part, size = [], 0
        codes = np.concatenate([p[0] for p in parts])
        order = np.argsort(codes, kind="stable")
        codes, n = codes[order], np.concatenate([p[1] for p in parts])[order]
        starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        return {"code": pa.array(codes[starts].astype(np.int64)), "n": pa.array(np.add.reduceat(n, starts).astype(np.int64))}

    return map_batches(texts, run, "code long, n long", rows=10_000).groupBy("code").agg(F.sum("n").alias("n"))


def _suffix(order: int) -> Column:
    """The code's follower and the last bytes of its context, for a shorter order."""
    return F.col("code").bitwiseAND(F.lit((1 << BITS * (order + 1)) - 1))


def train_trie(texts: DataFrame) -> list[DataFrame]:
    """For each order from 0, all nodes: code, n, and total and kinds of the code's context."""
    levels: list[DataFrame] = []
    counts = count_contexts(texts)
    # at most 257 followers
    context = Window.partitionBy(F.shiftrightunsigned("code", BITS))
    for _ in range(ORDER + 1):
        level = materialise(counts.select("code", "n", F.sum("n").over(context).alias("total"), F.count("*").over(context).alias("kinds")))
        levels.insert(0, level)
        counts = level.groupBy(_suffix(ORDER - len(levels)).alias("code")).agg(F.sum("n").alias("n"))
    return levels


def hot_codes(nodes: DataFrame) -> tuple[Table, np.ndarray]:
    """The commonest codes of the longest order and their log10 probabilities; NODES rows at most come to the driver."""
    size = F.floor(F.log2("n") * 4)
    by_size = {r.size: r.nodes for r in nodes.groupBy(size.alias("size")).agg(F.count("*").alias("nodes")).collect()}
    kept, least = 0, 0
    for found in sorted(by_size, reverse=True):
        kept += by_size[found]
        if kept > NODES:
            least = found + 1
            break
    rows = nodes.filter(size >= least).select("code", _stay().alias("p")).toArrow()
    codes, lengths = rows["code"].to_numpy().astype(np.uint64), rows["p"].to_numpy()
    del rows
    return Table(codes), lengths


def _stay() -> Column:
    return F.log10("n") - F.log10(F.col("total") + F.col("kinds"))


def escapes(codes: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """code, p: log10 probabilities of distinct codes (code) that the longest order lacks.

    For each order, `fresh` is the probability if the search starts there, `tail` the one of what follows once the
    order's context is left, and its followers are excluded. A row meets 257 others at most in each join.
    """
    first = levels[0].select("total", "kinds").first()
    total, kinds = (first.total, first.kinds) if first else (0, 0)
    # below order 0: all symbols that were never seen, alike
    bottom = -math.log10(max(1, END + 1 - kinds))
    leave = math.log10(kinds / (total + kinds)) if kinds else 0.0
    wanted = [codes]
    for j in range(ORDER - 1, -1, -1):
        wanted.insert(0, materialise(wanted[0].select(_suffix(j).alias("code")).distinct()))
    # each order is a table of its own, so that no plan grows with the orders
    below = wanted[0].join(levels[0], "code", "left").select("code", "n", F.coalesce(_stay(), F.lit(leave + bottom)).alias("fresh"), F.lit(bottom).alias("tail"))
    for j in range(1, ORDER + 1):
        shorter = levels[j - 1].select(F.col("code").alias("suffix"), F.col("n").alias("low_n"), F.col("total").alias("low_total"), F.col("kinds").alias("low_kinds"))
        contexts = (
            levels[j].withColumn("suffix", _suffix(j - 1)).join(shorter, "suffix")
            .groupBy(F.shiftrightunsigned("code", BITS).alias("context"))
            .agg(F.first("total").alias("total"), F.first("kinds").alias("kinds"), (F.first("low_total") - F.sum("low_n")).alias("rest"), (F.first("low_kinds") - F.count("*")).alias("new"))
        )
        held = wanted[j].join(levels[j].select("code", "n"), "code", "left")
        held = held.select("code", "n", F.shiftrightunsigned("code", BITS).alias("context"), _suffix(j - 1).alias("suffix")).join(contexts, "context", "left")
        held = held.join(below.select(F.col("code").alias("suffix"), F.col("n").alias("below_n"), F.col("fresh").alias("below_fresh"), F.col("tail").alias("below_tail")), "suffix")
        rest = F.log10(F.col("rest") + F.col("new"))
        tail = F.when(F.col("below_n").isNotNull(), F.log10("below_n") - rest).otherwise(F.when(F.col("new") > 0, F.log10("new") - rest).otherwise(0.0) + F.col("below_tail"))
        left = F.log10("kinds") - F.log10(F.col("total") + F.col("kinds")) + F.col("tail")
        below = materialise(held.withColumn("tail", tail).select("code", "n", F.when(F.col("n").isNotNull(), _stay()).when(F.col("total").isNull(), F.col("below_fresh")).otherwise(left).alias("fresh"), "tail"))
    return below.select("code", F.col("fresh").alias("p"))


def count_words(texts: DataFrame) -> DataFrame:
    """word, c of texts (text): words as bytes, A-Z lower-cased."""

    def run(batch: dict) -> dict:
        found: Counter = Counter()
        for text in batch["text"].to_pylist():
            found.update(text.encode().lower().split())
        return {"word": pa.array(found.keys(), pa.binary()), "c": pa.array(found.values(), pa.int64())}

    return map_batches(texts, run, "word binary, c long", rows=10_000).groupBy("word").agg(F.sum("c").alias("c"))


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of docs (doc_id, text)."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), (crc_mod(F.col("doc_id"), HELD_OUT_MODULUS) == 0).alias("held_out"), F.xxhash64("text").alias("row_key"))
    training = texts.filter("not held_out").select("text")
    ends = training.count()
    words = materialise(count_words(training))
    n_words, kinds = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, distinct = n_words + ends, kinds + (1 if ends else 0)
    divisor = total + ALPHA * (distinct + 1)
    commonest = words.orderBy(F.desc("c"), "word").limit(HOT_WORDS).toArrow()
    hot = dict(zip(commonest["word"].to_pylist(), commonest["c"].to_pylist()))
    del commonest
    levels = train_trie(training)
    sent_codes = spark.sparkContext.broadcast(hot_codes(levels[ORDER]))  # NODES at most
    sent_words = spark.sparkContext.broadcast({w: math.log10((c + ALPHA) / divisor) for w, c in hot.items()})  # HOT_WORDS at most
    end_score = math.log10((ends + ALPHA) / divisor)

    def hot_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (table, lengths_of), known = sent_codes.value, sent_words.value
        for batch in sliced(batches):
            n_tokens, n_known, base, bits, cold, times = [], [], [], [], [], []
            part, size = [], 0

            def flush() -> None:
                codes, lengths = _codes(part)
                at = np.concatenate([table.find(codes[i : i + BLOCK]) for i in range(0, len(codes), BLOCK)])
                p = np.where(at >= 0, lengths_of[np.maximum(at, 0)], 0.0) if len(lengths_of) else np.zeros(len(at))
                bits.extend(np.add.reduceat(p, np.cumsum(lengths) - lengths))
                # a code has 45 bits, and a slice 2,000 texts
                missed = np.flatnonzero(at < 0)
                owner = np.repeat(np.arange(len(part), dtype=np.uint64), lengths)[missed]
                found, n = np.unique((owner << np.uint64(BITS * (ORDER + 1))) | codes[missed], return_counts=True)
                ends_at = np.searchsorted(found, np.arange(1, len(part), dtype=np.uint64) << np.uint64(BITS * (ORDER + 1)))
                cold.extend(np.split((found & np.uint64((1 << BITS * (ORDER + 1)) - 1)).astype(np.int64), ends_at))
                times.extend(np.split(n, ends_at))
                part.clear()

            for text in batch.column("text").to_pylist():
                raw = text.encode()
                found = raw.lower().split()
                scores = [s for s in map(known.get, found) if s is not None]
                n_tokens.append(len(found) + 1)
                n_known.append(len(scores) + (ends > 0))
                base.append(math.fsum(scores) + end_score)
                part.append(raw)
                size += len(raw)
                if size > 2 * BLOCK:
                    flush()
                    size = 0
            if part:
                flush()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_key"), batch.column("held_out"), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(bits, pa.float64()), pa.array(cold, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))],
                ["doc_id", "row_key", "held_out", "n_tokens", "n_known", "base", "bits", "codes", "times"],
            )

    def cold_words(batch: dict) -> dict:
        known = sent_words.value
        ids, keys, found, times, first = [], [], [], [], []
        for doc_id, key, text in zip(batch["doc_id"].to_pylist(), batch["row_key"].to_pylist(), batch["text"].to_pylist()):
            counted = Counter(w for w in text.encode().lower().split() if w not in known)
            ids += [doc_id] * len(counted)
            keys += [key] * len(counted)
            found += counted.keys()
            times += counted.values()
            if counted:
                first += [1] + [0] * (len(counted) - 1)
        return {"id": pa.array(ids, pa.int64()), "key": pa.array(keys, pa.int64()), "word": pa.array(found, pa.binary()), "times": pa.array(times, pa.int32()), "first": pa.array(first, pa.int32())}

    scored = materialise(texts.mapInArrow(hot_part, "doc_id long, row_key long, held_out boolean, n_tokens long, n_known long, base double, bits double, codes array<long>, times array<long>"))
    # all codes of training texts are in the table
    lacking = materialise(scored.filter("held_out").select(F.explode("codes").alias("code")).distinct().join(levels[ORDER], "code", "left_anti"))
    lengths_of_codes = levels[ORDER].select("code", _stay().alias("p")).union(escapes(lacking, levels))
    rare_codes = scored.select("doc_id", "row_key", F.posexplode(F.arrays_zip("codes", "times")).alias("pos", "item")).select(
        F.col("doc_id").alias("code_id"), F.col("row_key").alias("code_key"), F.col("item.codes").alias("code"), F.col("item.times").alias("times"), (F.col("pos") == 0).cast("int").alias("first")
    )
    # rows that repeat id and text add up alike, as below
    cold_codes = materialise(rare_codes.join(lengths_of_codes, "code").groupBy("code_id", "code_key").agg((F.sum(F.col("times") * F.col("p")) / F.sum("first")).alias("more_bits")))
    rare = map_batches(texts.select("doc_id", "row_key", "text"), cold_words, "id long, key long, word binary, times int, first int")
    c = F.coalesce("c", F.lit(0))
    # rows that repeat id and text add up alike: their number is the sum of first
    cold = (
        rare.join(words, "word", "left")
        .groupBy("id", "key")
        .agg((F.sum(F.col("times") * F.log10((c + F.lit(ALPHA)) / F.lit(divisor))) / F.sum("first")).alias("more"), (F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)) / F.sum("first")).alias("known"))
    )
    joined = scored.join(cold, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("row_key") == F.col("key")), "left")
    joined = joined.join(cold_codes, F.col("doc_id").eqNullSafe(F.col("code_id")) & (F.col("row_key") == F.col("code_key")), "left")
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("bits") + F.coalesce("more_bits", F.lit(0.0))).alias("score"),
    )
