"""Token-ID output: documents' ids in files of rANS blocks (static range asymmetric numeral system), written and read in parallel.

A folder of token files holds three Parquet tables. `table`: one frequency of 2^SCALE for each id, shared by all
blocks, from the counts of all ids of the corpus. `blocks`: a row a block, files in ascending order of documents; a block
holds whole documents (doc_ids, lens) and its bytes. `shards`: the ids of each file, and of all files before it.

A block's bytes are a header, checkpoints and a stream of 32-bit words. Its ids are cut into segments of SEGMENT ids, and
each segment is coded by LANES interleaved states: id i by lane i mod LANES. A checkpoint holds a segment's states, its
place in the stream and the crc32 of its ids, so that decoding begins at any segment, of any block, of any file, without
what stands before; all segments of a batch of blocks are decoded side by side. The block ends with a crc32 of all its
bytes. Decoding fails on a wrong checksum, on ids that don't match theirs, or if a state doesn't return to its start.

Documents go through a written table of ids, sorted by ranges of doc_id, so a task holds a batch of documents and not its
partition. A document longer than BLOCK ids is a block of its own, of as many segments as it needs.

Texts are encoded by the tokenizers library. Where the file's normalizer and pre-tokenizer are the ones of `_RULES`,
texts are cut at white space, which no word spans, and only distinct chunks are encoded: chunks of code points below
U+0300 are cut into words here, by the same rules after lower-casing, and distinct words are given to the library's model;
other chunks, and those that hold an apostrophe, an added token or a letter that lower-casing takes out of this range, are
given to the library as they are. With another file whole texts are given to it.

Defined cases: null text equals empty text (the end id only). Null ids come first. Rows of one doc_id each keep their
place, by number of ids, then crc32; equal rows may change places. Very long texts are coded whole. Other columns play no
part, whatever their names. An empty table gives empty tables.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadastra.llm.common import shared_folder

SCALE, LANES, SEGMENT, BLOCK = 20, 64, 16_384, 65_536
#: What a block begins with, and the smallest state.
MAGIC, LOW = b"RANS\x01\0\0\0", np.uint64(1 << 31)
#: Ids of the blocks that are coded or decoded side by side.
BATCH_IDS = 1 << 20
SLICE_CHARS = 8_000_000
CACHE_KEYS = 300_000
KNOWN_CHUNKS = 300_000
#: Those of the word encoder: what a slice asks for is found in a hash table that is made anew, so rows seen seldom cost more than they save.
WORD_CHARS, WORD_CHUNKS, WORD_WORDS = 16_000_000, 100_000, 150_000

#: The normalizer and pre-tokenizer whose words are found without the library.
_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}


_WHITE = "\t\n\x0b\x0c\r \x85\xa0"
#: Of the code points below U+0300: 0 white space, 1 letters, 2 numbers, 3 others.
_KINDS = np.array([0 if chr(i) in _WHITE else {"L": 1, "N": 2}.get(unicodedata.category(chr(i))[0], 3) for i in range(0x300)], np.uint8)
#: Those whose lower case is not one code point below U+0300, or not the same in Arrow.
_UNPLAIN = "".join(chr(i) for i in range(0x300) if chr(i).lower() != pc.utf8_lower(pa.scalar(chr(i))).as_py() or len(chr(i).lower()) > 1 or ord(chr(i).lower()) >= 0x300)


class Cache:
    """What was found for keys, in two generations: a full one becomes the old one, so memory is bounded at the cost of time only."""

    def __init__(self, find: Callable[[list[str]], list], size: int = CACHE_KEYS):
        self.find, self.size = find, size
        self.young: dict = {}
        self.old: dict = {}

    def get(self, keys: list[str]) -> list:
        """The values of distinct keys."""
        if len(self.young) > self.size:
            self.young, self.old = {}, self.young
        young = self.young
        out = list(map(young.get, keys))
        absent = [i for i, v in enumerate(out) if v is None]
        for i in absent:
            if (value := self.old.get(keys[i])) is not None:
                out[i] = young[keys[i]] = value
        new = [i for i in absent if out[i] is None]
        if new:
            for i, value in zip(new, self.find([keys[i] for i in new])):
                out[i] = young[keys[i]] = value
        return out


def gathered(values: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """values[start : start + len] of all pairs, one after another."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(values)) < 1 << 31 else np.int64
    return values.take(np.repeat((starts - (ends - lens)).astype(kind), lens) + np.arange(total, dtype=kind))


class Known:
    """Ids of the chunks seen most, in Arrow and numpy: a slice's chunks are found without Python, its new ones are encoded once."""

    def __init__(self, find: Callable[[list[str]], list[bytes]], size: int = KNOWN_CHUNKS):
        self.find, self.size = find, size
        self.chunks, self.seen, self.lens, self.ids = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def encode(self, chunks: pa.Array, places: np.ndarray) -> list[np.ndarray]:
        """Ids of texts whose chunks stand between the places."""
        own, ids = self.look(chunks)
        ends = np.concatenate([[0], np.cumsum(own)])[places]
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:])]

    def look(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each chunk has, and all ids."""
        at = self._at(chunks)
        own = self.lens[at]
        ids = gathered(self.ids, (np.cumsum(self.lens) - self.lens)[at], own)
        self._prune(at)
        return own, ids

    def found(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw = self.find(new.to_numpy(zero_copy_only=False).tolist())
        return np.array([len(r) // 4 for r in raw], np.int64), np.frombuffer(b"".join(raw), "<u4")

    def _at(self, chunks: pa.Array) -> np.ndarray:
        """The chunks' rows in the table, which gets those that it lacks."""
        at = pc.fill_null(pc.index_in(chunks, value_set=self.chunks), -1).to_numpy(zero_copy_only=False)
        absent = at < 0
        if absent.any():
            new = chunks.filter(pa.array(absent)).dictionary_encode()
            lens, ids = self.found(new.dictionary)
            at = at.copy()
            at[absent] = new.indices.to_numpy() + len(self.chunks)
            self.chunks = pa.concat_arrays([self.chunks, new.dictionary])
            self.lens, self.ids = np.concatenate([self.lens, lens]), np.concatenate([self.ids, ids])
            self.seen = np.concatenate([self.seen, np.zeros(len(lens), np.int64)])
        return at

    def _prune(self, at: np.ndarray) -> None:
        """Keeps the chunks seen most where the table is full: that costs time only."""
        self.seen += np.bincount(at, minlength=len(self.seen))
        if len(self.seen) > 2 * self.size:
            kept = np.sort(np.argpartition(-self.seen, self.size)[: self.size])
            self.ids = gathered(self.ids, (np.cumsum(self.lens) - self.lens)[kept], self.lens[kept])
            self.chunks, self.lens, self.seen = self.chunks.take(pa.array(kept)), self.lens[kept], self.seen[kept] // 2


class KnownArrays(Known):
    """The same, where `find` takes an Arrow array and returns how many ids each has, and all ids."""

    def found(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self.find(new)


def cut_words(chunks: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of chunks of plain letters, in lower case, and how many each chunk has: runs of letters or of others, and single numbers."""
    lower = pc.utf8_lower(chunks)
    offsets = np.concatenate([[0], np.cumsum(pc.binary_length(lower).to_numpy())])
    data = np.frombuffer("".join(lower.to_numpy(zero_copy_only=False).tolist()).encode(), np.uint8)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    first, second = data.take(at), np.append(data, np.uint8(0)).take(at + 1)
    kinds = _KINDS.take(np.where(first < 0x80, first, (first.astype(np.uint16) & 0x1F) << 6 | second & 0x3F))
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    begins = begins.take(at) | (kinds == 2) | (kinds != np.concatenate([kinds[:1], kinds[:-1]]))
    starts, kept = at[begins], kinds[begins] > 0
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data)).astype(np.int32)), pa.py_buffer(data))
    return words.filter(pa.array(kept)), np.diff(np.searchsorted(starts[kept], offsets))


class WordEncoder:
    """Ids of texts by the tokenizers library, without added tokens but those the text holds; distinct chunks are encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        self.plain = {k: rules.get(k) for k in _RULES} == _RULES
        self.odd = "|".join([f"[^\\x00-\\x{{2ff}}]|['{_UNPLAIN}]", *(re.escape(a["content"]) for a in rules["added_tokens"])])
        # bytes as the vocabulary writes them: those that print as themselves, the others from U+0100 on; ends of lines stay
        printed = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
        others = [b for b in range(256) if b not in printed]
        self.letters = np.arange(256, dtype="<u4")
        self.letters[others] = 256 + np.arange(len(others))
        self.letters[0x0A] = 0x0A
        self.words = KnownArrays(self._encode_words, WORD_WORDS)
        self.known = KnownArrays(self._encode_chunks, WORD_CHUNKS)

    def _encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        # no word holds a line's end
        joined = "\n".join(words.to_numpy(zero_copy_only=False).tolist()).encode()
        text = self.letters.take(np.frombuffer(joined, np.uint8)).tobytes().decode("utf-32-le")
        model, lens, ids = self.whole.model, [], []
        for word in text.split("\n"):
            tokens = model.tokenize(word)
            lens.append(len(tokens))
            ids += [t.id for t in tokens]
        return np.array(lens, np.int64), np.array(ids, "<u4")

    def _encode_chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.match_substring_regex(chunks, self.odd).to_numpy(zero_copy_only=False)
        words, n = cut_words(chunks.filter(pa.array(~odd)))
        of_words, ids = self.words.look(words)
        plain = np.diff(np.concatenate([[0], np.cumsum(of_words)])[np.concatenate([[0], np.cumsum(n)])])
        if not odd.any():
            return plain, ids
        whole = [e.ids for e in self.whole.encode_batch(chunks.filter(pa.array(odd)).to_numpy(zero_copy_only=False).tolist(), add_special_tokens=False)]
        lens = np.zeros(len(chunks), np.int64)
        lens[~odd], lens[odd] = plain, [len(w) for w in whole]
        out, of_odd = np.zeros(int(lens.sum()), "<u4"), np.repeat(odd, lens)
        out[~of_odd], out[of_odd] = ids, list(chain.from_iterable(whole))
        return lens, out

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Each text's ids. No text may be null."""
        if not self.plain:
            return [np.array(self.whole.encode(t, add_special_tokens=False).ids, "<u4") for t in texts.to_pylist()]
        lists = pc.ascii_split_whitespace(texts)
        return self.known.encode(lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py())


@lru_cache(1)
def word_encoder(path: str) -> WordEncoder:
    """One encoder a Python worker: its tables serve the tasks that follow."""
    return WordEncoder(path)


def _packed(compressor: zstandard.ZstdCompressor, ids: np.ndarray) -> bytes:
    """Ids of one document for the written table: in two bytes where they suffice, else four, compressed, and how many."""
    width = 2 if ids.max(initial=0) < 1 << 16 else 4
    return compressor.compress(ids.astype(f"<u{width}")) + bytes([width])


def _unpacked(decompressor: zstandard.ZstdDecompressor, raw: bytes) -> np.ndarray:
    return np.frombuffer(decompressor.decompress(raw, allow_extra_data=True), f"<u{raw[-1]}").astype("<u4")


_CUT = re.compile(r" (?<=\S )(?=.)", re.S)
#: Texts that a cut at each blank would cut elsewhere: blanks at an end or behind white space.
_UNEVEN = "^ | $|[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200b}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}] "


def cells(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The texts cut at each blank that follows no white space and is not the last letter, without these blanks, and the places where each text's cells begin and end."""
    if pc.any(pc.match_substring_regex(texts, _UNEVEN)).as_py():
        parts = [_CUT.split(t) for t in texts.to_pylist()]
        return pa.array([c for p in parts for c in p], pa.string()), np.cumsum([0, *map(len, parts)])
    lists = pc.split_pattern(texts, " ")
    return lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()


def by_chars(batch: pa.RecordBatch, chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of about so many bytes of text, a row at least."""
    ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + chars, "right")))
        yield batch.slice(first, last - first)
        first = last


def encode_ids(docs: DataFrame, tokenizer_file: str, end_id: int) -> DataFrame:
    """doc_id, n_tokens with the end id, ids_crc32 and the packed ids of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, compressor = word_encoder(tokenizer_file), zstandard.ZstdCompressor(level=1, write_content_size=True)
        end = np.array([end_id], "<u4")
        for part in (p for batch in batches for p in by_chars(batch, WORD_CHARS)):
            n, crc, packed = [], [], []
            for found in encoder.encode(part.column("text")):
                ids = np.concatenate([found, end])
                n.append(len(ids))
                crc.append(zlib.crc32(ids))
                packed.append(_packed(compressor, ids))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "n_tokens", "ids_crc32", "packed"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, packed binary")


def count_ids(encoded: DataFrame) -> DataFrame:
    """id and n: how often each id stands in the corpus. Tasks count their own ids first; the rows are those of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, decompressor = np.zeros(0, np.int64), zstandard.ZstdDecompressor()

        def count(parts: list[np.ndarray]) -> np.ndarray:
            found = np.bincount(np.concatenate(parts), minlength=len(counts))
            found[: len(counts)] += counts
            return found

        for batch in batches:
            parts, held = [], 0
            for raw in batch.column(0):
                parts.append(_unpacked(decompressor, raw.as_py()))
                held += len(parts[-1])
                if held >= BATCH_IDS:
                    counts, parts, held = count(parts), [], 0
            if parts:
                counts = count(parts)
        ids = np.flatnonzero(counts)
        if len(ids):
            yield pa.RecordBatch.from_pydict({"id": ids, "n": counts[ids]})

    return encoded.select("packed").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def frequencies(counts: list[tuple[int, int]], scale: int = SCALE) -> list[tuple[int, int]]:
    """(id, frequency): at least 1 for each id, 2^scale in all. What rounding leaves goes to the commonest id, the smallest of equals."""
    total, room = sum(n for _, n in counts), (1 << scale) - len(counts)
    if room < 0:
        raise ValueError(f"{len(counts)} ids don't fit a table of 2^{scale}")
    out = {i: 1 + n * room // total for i, n in counts}
    if out:
        out[min(counts, key=lambda c: (-c[1], c[0]))[0]] += (1 << scale) - sum(out.values())
    return sorted(out.items())


class Coder:
    """Codes and decodes blocks by one frequency table."""

    def __init__(self, table: list[tuple[int, int]], scale: int = SCALE):
        self.scale = np.uint64(scale)
        size = max((i for i, _ in table), default=-1) + 1
        self.freq = np.zeros(size, np.uint64)
        for i, f in table:
            self.freq[i] = f
        self.cum = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64) if size else np.zeros(0, np.uint64)
        self.symbol = np.repeat(np.arange(size, dtype=np.uint32), self.freq.astype(np.int64))

    @staticmethod
    def _by_size(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int], list[bool]]:
        """Places of the segments by falling size, each segment's place in that order, and of each row of LANES ids how many segments have it and if all of them have it whole."""
        order = np.argsort(-sizes, kind="stable")
        place = np.empty(len(sizes), np.int64)
        place[order] = np.arange(len(sizes))
        begins = np.arange(-(-int(sizes.max(initial=0)) // LANES)) * LANES
        having, whole = (len(sizes) - np.searchsorted(sizes[order[::-1]], begins + k) for k in (1, LANES))
        return order, place, having.tolist(), (having == whole).tolist()

    def encode(self, blocks: list[np.ndarray]) -> list[bytes]:
        parts = [b[i : i + SEGMENT] for b in blocks for i in range(0, len(b), SEGMENT)]
        sizes = np.array([len(p) for p in parts], np.int64)
        order, at, having, whole = self._by_size(sizes)
        sizes = sizes[order]
        ids = np.zeros((len(parts), len(having) * LANES), np.int64)
        for k, p in enumerate(parts):
            ids[at[k], : len(p)] = p
        ids = ids.reshape(len(parts), len(having), LANES)
        state = np.full((len(parts), LANES), LOW, np.uint64)
        words, emitted = np.zeros(ids.shape, "<u4"), np.zeros(ids.shape, bool)
        lane, top, rest = np.arange(LANES), np.uint64(63) - self.scale, (np.uint64(1) << self.scale) - self.freq
        for r in range(len(having) - 1, -1, -1):
            n = having[r]
            own, before = ids[:n, r], state[:n]
            f = self.freq.take(own)
            if not whole[r]:
                live = r * LANES + lane < sizes[:n, None]
                f = np.where(live, f, np.uint64(1))
            full = before >= f << top
            words[:n, r], emitted[:n, r] = before, full
            low = before >> (full.astype(np.uint64) << np.uint64(5))
            # quotient by f in the high bits, remainder and place below them
            after = low + low // f * rest.take(own) + self.cum.take(own)
            state[:n] = after if whole[r] else np.where(live, after, before)
        state = state[at]
        out, k = [], 0
        for b in blocks:
            n = -(-len(b) // SEGMENT)
            streams = [words[i][emitted[i]] for i in at[k : k + n]]
            places = np.cumsum([0, *map(len, streams)])
            body = MAGIC + struct.pack("<HHIQII", LANES, int(self.scale), SEGMENT, len(b), n, int(places[-1]))
            body += places[:-1].astype("<u4").tobytes() + np.array([zlib.crc32(p.astype("<u4").tobytes()) for p in parts[k : k + n]], "<u4").tobytes()
            body += state[k : k + n].astype("<u8").tobytes() + b"".join(s.tobytes() for s in streams)
            out.append(body + struct.pack("<I", zlib.crc32(body)))
            k += n
        return out

    def decode(self, blocks: list[bytes]) -> list[np.ndarray]:
        heads, sizes, sums, states, streams, places, base = [], [], [], [], [], [], 0
        for raw in blocks:
            if raw[:8] != MAGIC or struct.unpack("<I", raw[-4:])[0] != zlib.crc32(raw[:-4]):
                raise ValueError("a block's checksum is wrong")
            lanes, scale, segment, n_ids, n, n_words = struct.unpack_from("<HHIQII", raw, 8)
            if (lanes, scale, segment) != (LANES, int(self.scale), SEGMENT):
                raise ValueError("a block of other lanes, scale or segments")
            at = 8 + struct.calcsize("<HHIQII")
            places.append(np.frombuffer(raw, "<u4", n, at).astype(np.int64) + base)
            sums += np.frombuffer(raw, "<u4", n, at + 4 * n).tolist()
            states.append(np.frombuffer(raw, "<u8", n * LANES, at + 8 * n).reshape(n, LANES))
            streams.append(np.frombuffer(raw, "<u4", n_words, at + 8 * n + 8 * n * LANES))
            sizes += [min(SEGMENT, n_ids - i * SEGMENT) for i in range(n)]
            heads.append((n, n_ids))
            base += n_words
        if not sizes:
            return [np.zeros(0, np.uint32) for _ in blocks]
        size = np.array(sizes, np.int64)
        order, at, having, whole = self._by_size(size)
        size, state, place = size[order], np.concatenate(states).astype(np.uint64)[order], np.concatenate(places)[order]
        # a word behind the last: a spoilt stream may ask for more than it has
        stream = np.concatenate([*streams, np.zeros(1, "<u4")]).astype(np.uint64)
        lane, mask = np.arange(LANES), np.uint64((1 << int(self.scale)) - 1)
        ids = np.zeros((len(size), len(having), LANES), np.uint32)
        for r, n in enumerate(having):
            before = state[:n]
            slot = before & mask
            found = self.symbol.take(slot.view(np.int64))
            after = self.freq.take(found) * (before >> self.scale) + slot - self.cum.take(found)
            due = after < LOW
            if not whole[r]:
                live = r * LANES + lane < size[:n, None]
                due, after = due & live, np.where(live, after, before)
            taken = np.count_nonzero(due, 1)
            ends = np.cumsum(taken)
            asks = np.flatnonzero(due)
            words = stream.take(np.minimum(np.repeat(place[:n] - (ends - taken), taken) + np.arange(len(asks)), len(stream) - 1))
            flat = after.reshape(-1)
            flat[asks] = flat.take(asks) << np.uint64(32) | words
            state[:n] = after
            place[:n] += taken
            ids[:n, r] = found
        state, flat = state[at], ids.reshape(len(size), len(having) * LANES)[at]
        if (state != LOW).any() or any(zlib.crc32(flat[k, :s].astype("<u4").tobytes()) != c for k, (s, c) in enumerate(zip(sizes, sums))):
            raise ValueError("decoded ids don't match their checksum")
        out, k = [], 0
        for n, n_ids in heads:
            out.append(flat[k : k + n].reshape(-1)[:n_ids] if n == 1 else np.concatenate([flat[j, : sizes[j]] for j in range(k, k + n)]) if n else np.zeros(0, np.uint32))
            k += n
        return out


_BLOCKS = "shard int, block int, shard_start long, n_tokens long, doc_ids array<long>, lens array<long>, bytes binary"


def write_token_files(docs: DataFrame, tokenizer_file: str, end_id: int, folder: str | None = None) -> str:
    """Encodes all documents and writes the token files, in ascending order of doc_id. Returns their folder."""
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    encode_ids(docs, tokenizer_file, end_id).write.option("compression", "uncompressed").parquet(f"{folder}/ids")
    encoded = spark.read.parquet(f"{folder}/ids")
    # the rows are at most as many as the vocabulary has ids
    table = frequencies([(r.id, r.n) for r in count_ids(encoded).collect()])
    spark.createDataFrame(table, "id long, freq long").coalesce(1).write.parquet(f"{folder}/table")
    shared = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, decompressor = Coder(shared.value), zstandard.ZstdDecompressor()
        shard, number, before = TaskContext.get().partitionId(), 0, 0
        blocks: list[tuple[list, list, np.ndarray]] = []
        ids: list = []
        parts: list = []
        held = 0

        def closed() -> None:
            blocks.append((list(ids), [len(p) for p in parts], np.concatenate(parts)))
            ids.clear()
            parts.clear()

        def coded() -> pa.RecordBatch:
            nonlocal number, before
            raw = coder.encode([b[2] for b in blocks])
            sizes = [len(b[2]) for b in blocks]
            starts = [before + s for s in np.cumsum([0, *sizes]).tolist()]
            rows = [pa.array([shard] * len(raw), pa.int32()), pa.array(range(number, number + len(raw)), pa.int32()), pa.array(starts[:-1], pa.int64()), pa.array(sizes, pa.int64())]
            rows += [pa.array([b[0] for b in blocks], pa.list_(pa.int64())), pa.array([b[1] for b in blocks], pa.list_(pa.int64())), pa.array(raw, pa.binary())]
            number, before = number + len(raw), starts[-1]
            blocks.clear()
            return pa.RecordBatch.from_arrays(rows, ["shard", "block", "shard_start", "n_tokens", "doc_ids", "lens", "bytes"])

        for batch in batches:
            for doc_id, raw in zip(batch.column("doc_id"), batch.column("packed")):
                ids.append(doc_id.as_py())
                parts.append(_unpacked(decompressor, raw.as_py()))
                held += len(parts[-1])
                if held >= BLOCK:
                    closed()
                    held = 0
                if sum(len(b[2]) for b in blocks) >= BATCH_IDS:
                    yield coded()
        if parts:
            closed()
        if blocks:
            yield coded()

    order = ["doc_id", "n_tokens", "ids_crc32"]
    ranged = encoded.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order, "row").sortWithinPartitions(*order, "row")
    ranged.select("doc_id", "packed").mapInArrow(run, _BLOCKS).write.option("compression", "uncompressed").parquet(f"{folder}/blocks")
    # one row a file; the running total needs them in one order
    totals = spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks").groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    totals.select("shard", "n", before.alias("shard_base")).coalesce(1).write.parquet(f"{folder}/shards")
    return folder


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document, from the files; with_ids adds ids."""
    shared = spark.sparkContext.broadcast([(r.id, r.freq) for r in spark.read.schema("id long, freq long").parquet(f"{folder}/table").collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            coder = coder or Coder(shared.value)
            sizes = batch.column("n_tokens").to_pylist()
            first = 0
            while first < len(sizes):
                last, held = first, 0
                while last < len(sizes) and (last == first or held + sizes[last] <= BATCH_IDS):
                    held += sizes[last]
                    last += 1
                part = batch.slice(first, last - first)
                rows: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": [], "ids": []}
                for base, ids, lens, values in zip(part.column("base").to_pylist(), part.column("doc_ids").to_pylist(), part.column("lens").to_pylist(), coder.decode(part.column("bytes").to_pylist())):
                    places = np.cumsum([0, *lens])
                    rows["doc_id"] += ids
                    rows["start"] += (places[:-1] + base).tolist()
                    rows["n_tokens"] += lens
                    for a, b in zip(places[:-1], places[1:]):
                        own = values[a:b].astype("<u4")
                        rows["ids_crc32"].append(zlib.crc32(own.tobytes()))
                        if with_ids:
                            rows["ids"].append(own.astype(np.int64))
                columns = {k: pa.array(v, pa.int64()) for k, v in rows.items() if k != "ids"}
                if with_ids:
                    columns["ids"] = pa.array(rows["ids"], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(columns)
                first = last

    blocks = spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks")
    shards = spark.read.schema("shard int, n long, shard_base long").parquet(f"{folder}/shards")
    based = blocks.join(shards, "shard").select((F.col("shard_base") + F.col("shard_start")).alias("base"), "n_tokens", "doc_ids", "lens", "bytes")
    return based.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))
