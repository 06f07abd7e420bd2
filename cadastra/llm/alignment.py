"""Cross-tokenizer alignment: where two tokenizers cut the same texts, and how often their tokens are linked.

Texts are shuffled by their full text; each distinct one is encoded and aligned once, with its number of copies. Byte
offsets where tokens of both end cut a text's tokens into groups; all A-B token occurrences of a group are links. An id
pair counts the documents that hold it linked: a text's distinct pairs, weighted by its copies, are summed in each task
first. Measures are joined to doc_ids by the texts' SHA-256.

Within a task, texts are cut into cells before blanks that follow no white space: neither tokenizer's tokens span such a
place (A's pattern begins a piece there, B has no entry with its blank behind another letter; both are checked, and whole
texts are one cell otherwise). So tokens, bytes and groups of a text are those of its cells, and a distinct cell is
encoded and aligned once for each task, in a cache of bounded size.

Counts come back to texts in two ways that give the same sums: the `KNOWN` commonest pairs, a table of fixed size, go to
all tasks; the other pairs of each text are rows that are joined with the table of all pairs.

Defined cases: a text that is null, empty, or whose joined tokens of A or B are not blank + text byte by byte has no
tokens: zeros and ''. Repeated ids return a row each and count each. Very long texts are aligned whole; a group of many
tokens gives its distinct pairs with their number, not all pairs. Other columns play no part, whatever their names. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.llm.common import materialise
from cadastra.llm.token_output import Cache, by_chars, cells, gathered

#: Id pairs whose counts all tasks get: 13 bytes each.
KNOWN = 1 << 20
#: Links of one group that are listed one by one; of more, distinct pairs are.
GROUP_LINKS = 4096
CACHE_CELLS = 200_000
#: Cells that are encoded and aligned at a time.
CELLS = 5_000
#: Pairs that a task gathers before it adds them up, and distinct ones that it holds.
GATHER, HELD = 2_000_000, 1_000_000

#: The settings of a byte-level file whose tokens never span a cell's border.
_BYTE_LEVEL = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}}


def byte_letters() -> dict[str, int]:
    """The bytes that a byte-level vocabulary's letters stand for: those that print as themselves, the others from U+0100 on."""
    printed = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    others = [b for b in range(256) if b not in printed]
    return {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(others)}


class Aligner:
    def __init__(self, a_file: str, b_file: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        with open(a_file, encoding="utf-8") as file:
            rules = json.load(file)
        self.b = SentencePieceProcessor(model_file=b_file)
        letters, self.size_b = byte_letters(), self.b.get_piece_size()
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.bytes_a = [bytes(letters[c] for c in n) if all(c in letters for c in n) else n.encode() for n in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.size_b)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if len(names) * self.size_b >= 1 << 32:
            raise ValueError("id pairs of these vocabularies don't fit 32 bits")
        self.len_a, self.len_b = (np.array([len(x) for x in xs], np.int64) for xs in (self.bytes_a, self.bytes_b))
        self.names = np.array([str(i) for i in range(max(len(names), self.size_b))], object)
        self.cells = {k: rules.get(k) for k in _BYTE_LEVEL} == _BYTE_LEVEL and not any("▁" in p.lstrip("▁") for p in pieces)
        self.cache = Cache(lambda new: [x for i in range(0, len(new), CELLS) for x in self.align(new[i : i + CELLS])], CACHE_CELLS)

    def align(self, texts: list[str]) -> list:
        """For each cell: n_a, n_b, n_groups, n_links, groups, codes, occurrences; None if the bytes differ. Codes: a * size_b + b."""
        found_a = [e.ids for e in self.a.encode_batch_fast([" " + c for c in texts], add_special_tokens=False)]
        found_b = self.b.encode(texts, num_threads=1)
        out: list = [None] * len(texts)
        good = []
        for k, (c, x, y) in enumerate(zip(texts, found_a, found_b)):
            raw = b" " + c.encode()
            if b"".join([self.bytes_b[i] for i in y]) == raw and b"".join([self.bytes_a[i] for i in x]) == raw:
                good.append(k)
        if not good:
            return out
        n_a, n_b = (np.array([len(f[k]) for k in good], np.int64) for f in (found_a, found_b))
        a, b = (np.array([i for k in good for i in f[k]], np.int64) for f in (found_a, found_b))
        end_a, end_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        at = np.minimum(np.searchsorted(end_b, end_a), len(end_b) - 1)
        cut = end_a[end_b[at] == end_a]
        if (np.diff(cut) == 0).any():  # an entry without bytes repeats an end
            cut = np.unique(cut)
        group_a, group_b = np.searchsorted(cut, end_a), np.searchsorted(cut, end_b)
        m, n = np.bincount(group_a, minlength=len(cut)), np.bincount(group_b, minlength=len(cut))
        first_a, first_b = np.cumsum(m) - m, np.cumsum(n) - n
        text = np.empty(len(a) + len(b), object)
        last_a, last_b = np.diff(group_a, append=-1) != 0, np.diff(group_b, append=-1) != 0
        cell_a, cell_b = np.cumsum(n_a), np.cumsum(n_b)
        closing = np.where(last_b, ";", ",").astype(object)
        closing[cell_b - 1] = ""
        text[np.arange(len(a)) + first_b[group_a]] = self.names[a] + np.where(last_a, "|", ",").astype(object)
        text[np.arange(len(b)) + (first_a + m)[group_b]] = self.names[b] + closing
        # cells' groups end with their last A token's group
        groups_end = group_a[cell_a - 1] + 1
        links = m * n
        plain = links <= GROUP_LINKS
        listed = np.where(plain, links, 0)
        total, starts = int(listed.sum()), np.cumsum(listed) - listed
        at = np.repeat(np.arange(len(cut)), listed)
        inner = np.arange(total) - starts[at]
        codes = (a[first_a[at] + inner // n[at]] * self.size_b + b[first_b[at] + inner % n[at]]).astype("<u4").tobytes()
        tokens = text.tolist()
        bounds = np.concatenate([[0], groups_end])
        linked, listing = (np.diff(np.concatenate([[0], np.cumsum(x)])[bounds]).tolist() for x in (links, listed))
        wide = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(~plain)])[bounds])).tolist()
        t0 = c0 = 0
        for k, x, y, g, total_links, own in zip(good, n_a.tolist(), n_b.tolist(), np.diff(bounds).tolist(), linked, listing):
            t1, c1 = t0 + x + y, c0 + 4 * own
            out[k] = (x, y, g, total_links, "".join(tokens[t0:t1]), codes[c0:c1], b"")
            t0, c0 = t1, c1
        for i in wide:
            known = out[good[i]]
            code, occ = [np.frombuffer(known[5], "<u4").astype(np.int64)], [np.ones(len(known[5]) // 4, np.int64)]
            for g in np.flatnonzero(~plain[bounds[i] : bounds[i + 1]]) + bounds[i]:
                ua, ca = np.unique(a[first_a[g] : first_a[g] + m[g]], return_counts=True)
                ub, cb = np.unique(b[first_b[g] : first_b[g] + n[g]], return_counts=True)
                code.append((ua[:, None] * self.size_b + ub).ravel())
                occ.append((ca[:, None] * cb).ravel())
            out[good[i]] = (*known[:5], np.concatenate(code).astype("<u4").tobytes(), np.concatenate(occ).astype("<i8").tobytes())
        return out

    def measure(self, texts: pa.Array) -> list[tuple]:
        """For each text: n_a, n_b, n_groups, n_links, groups_sha256, distinct codes in order, their occurrences. None without tokens."""
        found, place = cells(texts) if self.cells else (texts, np.arange(len(texts) + 1))
        coded = found.dictionary_encode()
        known = self.cache.get(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        wrong = np.array([k is None for k in known])
        known = [k or (0, 0, 0, 0, "", b"", b"") for k in known]
        counts = np.array([k[:4] for k in known], np.int64).reshape(-1, 4)
        summed = np.diff(np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(counts[at], 0)])[place], axis=0)
        spoilt = np.diff(np.concatenate([[0], np.cumsum(wrong[at])])[place]) > 0
        groups = [k[4] for k in known]
        sizes = np.array([len(k[5]) // 4 for k in known], np.int64)
        codes = np.frombuffer(b"".join(k[5] for k in known), "<u4")
        occurrences = np.concatenate([np.frombuffer(k[6], "<i8") if k[6] else np.ones(s, np.int64) for k, s in zip(known, sizes)]) if any(k[6] for k in known) else None
        starts, own = np.cumsum(sizes) - sizes, sizes[at]
        ends = np.concatenate([[0], np.cumsum(own)])[place]
        all_codes = gathered(codes, starts[at], own).astype(np.uint64) | np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(ends)) << np.uint64(32)
        if occurrences is None:
            keys, occ = np.unique(all_codes, return_counts=True)
        else:
            order = np.argsort(all_codes, kind="stable")
            ordered = all_codes[order]
            first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
            keys, occ = ordered[first], np.add.reduceat(gathered(occurrences, starts[at], own)[order], first) if len(first) else np.zeros(0, np.int64)
        bounds = np.searchsorted(keys, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(32))
        code = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        out: list = []
        for k in range(len(texts)):
            if spoilt[k]:
                out.append(None)
                continue
            digest = hashlib.sha256()
            for i in range(place[k], place[k + 1], 1_000_000):
                digest.update(((";" if i > place[k] else "") + ";".join(map(groups.__getitem__, at[i : min(place[k + 1], i + 1_000_000)].tolist()))).encode())
            out.append((*summed[k].tolist(), digest.hexdigest(), code[bounds[k] : bounds[k + 1]], occ[bounds[k] : bounds[k + 1]]))
        return out


@lru_cache(1)
def _aligner(a_file: str, b_file: str) -> Aligner:
    """One aligner a Python worker: its cache serves the tasks that follow."""
    return Aligner(a_file, b_file)


class _Pairs:
    """Codes in order, and their occurrences, as bytes of a column: four planes of the differences, then the occurrences."""

    def __init__(self):
        self.compressor, self.decompressor = zstandard.ZstdCompressor(level=1, write_content_size=True), zstandard.ZstdDecompressor()

    def pack(self, codes: np.ndarray, occ: np.ndarray) -> bytes:
        planes = np.ascontiguousarray(np.diff(codes.astype("<u4"), prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T)
        wide = occ > 254
        return self.compressor.compress(np.int64(len(codes)).tobytes() + planes.tobytes() + np.where(wide, 255, occ).astype(np.uint8).tobytes() + occ[wide].astype("<i8").tobytes())

    def unpack(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        raw = self.decompressor.decompress(raw)
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        codes = np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, 8).reshape(4, n).T).view("<u4").ravel(), dtype=np.uint32)
        occ = np.frombuffer(raw, np.uint8, n, 8 + 4 * n).astype(np.int64)
        occ[occ == 255] = np.frombuffer(raw, "<i8", -1, 8 + 5 * n)
        return codes, occ


def _added(codes: list[np.ndarray], weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every, weight = np.concatenate(codes), np.concatenate(weights)
    order = np.argsort(every, kind="stable")
    every, weight = every[order], weight[order]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    return every[first], np.add.reduceat(weight, first)


def align_texts(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """A row for each distinct text that has tokens: text_key, copies, n_a, n_b, n_groups, n_links, groups_sha256, packed pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, pairs = _aligner(a_file, b_file), _Pairs()
        for part in (p for batch in batches for p in by_chars(batch)):
            rows = [(k, c, *f[:5], pairs.pack(f[5], f[6])) for k, c, f in zip(part.column("text_key").to_pylist(), part.column("copies").to_pylist(), aligner.measure(part.column("text"))) if f]
            columns = list(zip(*rows)) if rows else [()] * 8
            types = [pa.string(), *[pa.int64()] * 5, pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["text_key", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"])

    texts = docs.filter("text <> ''").groupBy("text").agg(F.count("*").alias("copies"))
    keyed = texts.select("text", "copies", F.sha2("text", 256).alias("text_key"))
    return keyed.mapInArrow(run, "text_key string, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary")


def count_pairs(aligned: DataFrame, size_b: int) -> DataFrame:
    """code, a, b, n (documents that hold the pair linked) and best (n is the highest of its a)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, codes, weights, rows, least = _Pairs(), [], [], 0, 0
        for batch in batches:
            for copies, raw in zip(batch.column("copies").to_pylist(), batch.column("pairs")):
                found = pairs.unpack(raw.as_py())[0]
                codes.append(found)
                weights.append(np.full(len(found), copies, np.int64))
                rows += len(found)
                if rows >= least + GATHER:
                    code, weight = _added(codes, weights)
                    if len(code) > HELD:
                        yield pa.RecordBatch.from_pydict({"code": code.astype(np.int64), "n": weight})
                        code, weight = code[:0], weight[:0]
                    codes, weights, rows, least = [code], [weight], len(code), len(code)
        if rows:
            code, weight = _added(codes, weights)
            yield pa.RecordBatch.from_pydict({"code": code.astype(np.int64), "n": weight})

    counted = aligned.select("copies", "pairs").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    counted = materialise(counted.withColumns({"a": F.floor(F.col("code") / size_b).cast("long"), "b": F.col("code") % size_b}))
    highest = counted.groupBy("a").agg(F.max("n").alias("highest"))
    return counted.join(highest, "a").select("code", "a", "b", "n", (F.col("n") == F.col("highest")).alias("best"))


def _octave() -> Column:
    """A class of n, of some hundred ones at most."""
    return F.floor(F.log2("n") * 8).cast("int").alias("octave")


def align(docs: DataFrame, a_file: str, b_file: str, known: int = KNOWN) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each document."""
    from sentencepiece import SentencePieceProcessor

    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    aligned = materialise(align_texts(docs, a_file, b_file))
    counted = materialise(count_pairs(aligned, SentencePieceProcessor(model_file=b_file).get_piece_size()))
    # at most `known` rows of three columns: pairs from the eighth of an octave of n on, above which no more stand
    bins, least = [(r.octave, r["count"]) for r in counted.groupBy(_octave()).count().collect()], 1 << 20
    for octave, rows in sorted(bins, reverse=True):
        if (known := known - rows) < 0:
            break
        least = octave
    commonest = counted.filter(_octave() >= least).select("code", "n", "best").toArrow().sort_by("code")
    table = spark.sparkContext.broadcast((commonest["code"].to_numpy().astype(np.uint32), commonest["n"].to_numpy(), commonest["best"].to_numpy().astype(bool)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, (codes, n, best) = _Pairs(), table.value
        for batch in batches:
            n_best, count_sum, rest = [], [], []
            for raw in batch.column("pairs"):
                own, occ = pairs.unpack(raw.as_py())
                at = np.minimum(np.searchsorted(codes, own), len(codes) - 1) if len(codes) else np.zeros(len(own), np.int64)
                there = codes[at] == own if len(codes) else np.zeros(len(own), bool)
                hit, times = at[there], occ[there]
                n_best.append(int(times[best[hit]].sum()))
                count_sum.append(int((times * n[hit]).sum()))
                rest.append([{"code": c, "times": t} for c, t in zip(own[~there].tolist(), occ[~there].tolist())])
            kind = pa.list_(pa.struct([("code", pa.int64()), ("times", pa.int64())]))
            kept = [c for c in batch.schema.names if c not in ("pairs", "copies")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), pa.array(rest, kind)], [*kept, "n_best", "count_sum", "rest"])

    measured = materialise(aligned.mapInArrow(run, "text_key string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, rest array<struct<code long, times long>>"))
    rare = measured.select("text_key", F.explode("rest").alias("r")).select("text_key", "r.*").join(counted, "code").groupBy("text_key")
    rare = rare.agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("rare_best"), F.sum(F.col("times") * F.col("n")).alias("rare_sum"))
    sums = [(F.col(c) + F.coalesce(r, F.lit(0))).alias(c) for c, r in (("n_best", "rare_best"), ("count_sum", "rare_sum"))]
    whole = measured.join(rare, "text_key", "left").select("text_key", "n_a", "n_b", "n_groups", "n_links", *sums, "groups_sha256")
    keyed = docs.select("doc_id", F.when(F.col("text") != "", F.sha2("text", 256)).alias("text_key"))
    joined = keyed.join(whole, "text_key", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return joined.select("doc_id", *numbers, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
