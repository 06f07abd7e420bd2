"""Token output, alignment and the conversation trie against the libraries and brute force, on edge rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cadastra.llm import alignment, conversation_trie, token_output

public = pytest.importorskip("public_tokenizers")
WORDS, BYTES, PIECES = (public.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))


def odd_texts(n, longest=40):
    chance = random.Random(11)
    letters = list("abcXYZ'stredvml0139!?.,-  \n\t\x0b\x1c\x1f\x85\xa0²ª½İßÀéÉ") + ["́", "’", " ", "　", "Σ", "ς", "中", "🎉", "<|endoftext|>", "<|startoftext|>", "<s>", "<unk>", "<0x41>", "▁", "İ", "\x00", "'ll", "'S", "ʼ", "====", " the", " and"]
    return ["".join(chance.choice(letters) for _ in range(chance.randrange(longest))) for _ in range(n)]


@pytest.fixture(scope="module")
def documents(spark):
    texts = odd_texts(300)
    rows = [(i * 3 % 301, t) for i, t in enumerate(texts)] + [(400, None), (401, ""), (402, " "), (403, "x " * 40000), (404, "=" * 5000), (405, "ab" * 3000), (None, "no id"), (None, None)]
    rows += [(7, "again"), (7, "again"), (7, "other")] + [(500 + i, "one text of many copies, " * 3) for i in range(60)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("clash")).repartition(3).cache()


# --- token output ------------------------------------------------------------------------------------------------


def test_words_are_those_of_the_library():
    from tokenizers import Tokenizer

    library, encoder = Tokenizer.from_file(WORDS), token_output.WordEncoder(WORDS)
    texts = odd_texts(3000)
    assert encoder.plain
    for _ in range(2):  # new chunks, then known ones
        for text, ids in zip(texts, encoder.encode(pa.array(texts))):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    encoder.known.size = 50  # a table that is full all the time
    assert [i.tolist() for i in encoder.encode(pa.array(texts[:200]))] == [library.encode(t, add_special_tokens=False).ids for t in texts[:200]]
    encoder.plain = False  # a file of other rules: whole texts
    assert encoder.encode(pa.array(texts[:50]))[7].tolist() == library.encode(texts[7], add_special_tokens=False).ids


def test_words_of_every_plain_letter_are_those_of_the_library():
    """Ⱥ and Ⱦ stand below U+0300, their lower case does not; İ becomes two code points."""
    from tokenizers import Tokenizer

    library, encoder = Tokenizer.from_file(WORDS), token_output.WordEncoder(WORDS)
    chance = random.Random(12)
    texts = ["aȺb", "Ⱦb", "İx", "", " ", "it's", "a1é2²½", *(f"a{chr(i)}b{chr(i)}" for i in range(0x310))]
    texts += ["".join(chr(chance.randrange(0x310)) for _ in range(chance.randrange(12))) for _ in range(2000)]
    for text, ids in zip(texts, encoder.encode(pa.array(texts))):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text
    words, n = token_output.cut_words(pa.array(["Ab,", "", "1é2!?", "\xa0x\x85"]))
    assert (words.to_pylist(), n.tolist()) == (["ab", ",", "1", "é", "2", "!?", "x"], [2, 0, 4, 1])
    words, n = token_output.cut_words(pa.array([], pa.string()))
    assert (len(words), len(n)) == (0, 0)


def test_ids_of_the_written_table_come_back():
    import zstandard

    pack, unpack = zstandard.ZstdCompressor(level=1, write_content_size=True), zstandard.ZstdDecompressor()
    for ids in ([], [1], [65_535, 3], [65_536, 1], [2**32 - 1, 0, 7], list(range(1000))):
        found = token_output._unpacked(unpack, token_output._packed(pack, np.array(ids, "<u4")))
        assert found.tolist() == ids and found.dtype == np.dtype("<u4")
    assert len(token_output._packed(pack, np.random.default_rng(0).integers(0, 1 << 16, 10_000).astype("<u4"))) < 21_000


def test_blocks_come_back_and_faults_are_found():
    chance = np.random.default_rng(0)
    blocks = [np.minimum(chance.zipf(1.2, n), 49_000).astype(np.uint32) for n in (0, 1, 63, 64, 65, token_output.SEGMENT, token_output.SEGMENT + 1, 70_000, 200_001)]
    counts = np.bincount(np.concatenate(blocks))
    table = token_output.frequencies([(int(i), int(counts[i])) for i in np.flatnonzero(counts)])
    assert sum(f for _, f in table) == 1 << token_output.SCALE and min(f for _, f in table) >= 1
    coder = token_output.Coder(table)
    coded = coder.encode(blocks)
    for block, back in zip(blocks, coder.decode(coded)):
        assert np.array_equal(block, back)
    assert np.array_equal(coder.decode([coded[-1], coded[3]])[1], blocks[3])  # in any order, alone or together
    assert sum(map(len, coded)) * 8 < sum(map(len, blocks)) * 16  # below two bytes an id
    for at in (9, 60, len(coded[5]) - 2):
        spoilt = bytearray(coded[5])
        spoilt[at] ^= 1
        with pytest.raises(ValueError, match="checksum"):
            coder.decode([bytes(spoilt)])
    one = token_output.Coder(token_output.frequencies([(5, 9)]))
    assert np.array_equal(one.decode(one.encode([np.full(1000, 5)]))[0], np.full(1000, 5))
    assert token_output.frequencies([]) == []


def test_token_files_hold_all_documents_in_order(spark, documents):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    rows, frame = documents
    folder = token_output.write_token_files(frame, WORDS, 1)
    found = sorted(token_output.read_token_files(spark, folder, with_ids=True).collect(), key=lambda r: r.start)
    ids = {t: [*library.encode(t or "", add_special_tokens=False).ids, 1] for _, t in rows}
    crc = lambda values: zlib.crc32(np.array(values, "<u4").tobytes())
    want = sorted(((i is not None, i or 0, len(ids[t]), crc(ids[t]), ids[t]) for i, t in rows), key=lambda w: w[:4])
    assert [(r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32, r.ids) for r in found] == want
    assert [r.start for r in found] == [sum(w[2] for w in want[:k]) for k in range(len(want))]
    shards = spark.read.parquet(f"{folder}/shards").collect()
    assert sum(s.n for s in shards) == sum(w[2] for w in want)
    empty = token_output.write_token_files(frame.filter("false"), WORDS, 1)
    assert token_output.read_token_files(spark, empty).count() == 0


# --- alignment ---------------------------------------------------------------------------------------------------


def aligned_by_hand(rows):
    """Whole texts, token by token."""
    one = alignment.Aligner(BYTES, PIECES)
    assert one.cells
    texts = []
    for _, text in rows:
        a = one.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = one.b.encode(text) if text else []
        left, right = [one.bytes_a[i] for i in a], [one.bytes_b[i] for i in b]
        if not text or not (b"".join(left) == (" " + text).encode() == b"".join(right)):
            texts.append(None)
            continue
        ends = [np.cumsum([len(x) for x in side]).tolist() for side in (left, right)]
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            group: tuple = ([], [])
            while i < len(a) and ends[0][i] <= cut:
                group[0].append(a[i])
                i += 1
            while j < len(b) and ends[1][j] <= cut:
                group[1].append(b[j])
                j += 1
            groups.append(group)
        texts.append((a, b, groups))
    holds = Counter(pair for t in texts if t for pair in {(x, y) for g in t[2] for x in g[0] for y in g[1]})
    best: dict = defaultdict(int)
    for (x, _), n in holds.items():
        best[x] = max(best[x], n)
    out = []
    for (doc_id, _), t in zip(rows, texts):
        if t is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(x, y) for g in t[2] for x in g[0] for y in g[1]]
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in t[2])
        out.append((doc_id, len(t[0]), len(t[1]), len(t[2]), len(links), sum(holds[p] == best[p[0]] for p in links), sum(holds[p] for p in links), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("known", [alignment.KNOWN, 40])
def test_alignment_equals_whole_texts_by_hand(documents, known):
    rows, frame = documents
    got = sorted(str(tuple(r)) for r in alignment.align(frame, BYTES, PIECES, known).collect())
    assert got == aligned_by_hand(rows)


def test_large_groups_and_empty_tables(documents, monkeypatch):
    one = alignment.Aligner(BYTES, PIECES)
    plain = [one.align([t])[0] for t in ("=" * 40, "-*" * 30, "漢字")]
    monkeypatch.setattr(alignment, "GROUP_LINKS", 0)  # every group by its distinct pairs
    for before, text in zip(plain, ("=" * 40, "-*" * 30, "漢字")):
        after = one.align([text])[0]
        codes, times = np.frombuffer(after[5], "<u4").tolist(), np.frombuffer(after[6], "<i8").tolist()
        listed: Counter = Counter()
        for code, n in zip(codes, times):
            listed[code] += n
        assert after[:5] == before[:5] and listed == Counter(np.frombuffer(before[5], "<u4").tolist())
    assert alignment.align(documents[1].filter("false"), BYTES, PIECES).count() == 0
    packer = alignment._Pairs()
    codes, times = packer.unpack(packer.pack(np.array([0, 5, 4_000_000_000], np.uint32), np.array([1, 300, 254])))
    assert codes.tolist() == [0, 5, 4_000_000_000] and times.tolist() == [1, 300, 254]


# --- conversations -----------------------------------------------------------------------------------------------


def nodes_by_hand(rows):
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [v[2:] for v in sorted(vs)] for c, vs in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:])
    members, children = defaultdict(list), defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved, out = {}, {}, []
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[k] for k in children[path]) or 1
        saved[path] = (len(members[path]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0) + sum(saved[k] for k in children[path])
        ends = ",".join(str(c) for c in sorted(members[path]) if rebuilt[c] == path)
        out.append((min(members[path]), len(path), min(members[path[:-1]]) if path else None, len(members[path]), len(children[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


def test_the_trie_equals_brute_force_at_any_number_of_levels(spark, monkeypatch):
    chance = random.Random(3)
    rows = [(c, t if chance.random() > 0.02 else None, chance.choice(["u", "a", None]), chance.choice(["hi there", "yes no x", "", None, "a b"])) for c in chance.sample(range(-50, 900), 150) for t in range(chance.choice([1, 2, 3, 5, 8]) if c % 97 else 30)]
    rows += [(None, 1, "u", "x"), (5, 1, "u", "x"), (5, 1, "u", "x"), (2**62, 1, "u", "y " * 50000)]
    rows += [(1000 + i, t, "u", "same words") for i in range(100) for t in range(6)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("clash")).repartition(3)
    monkeypatch.setattr(conversation_trie, "PIECE", 7)
    for levels in (None, 9):
        assert sorted(str(tuple(r)) for r in conversation_trie.prefix_trie(frame, levels).collect()) == nodes_by_hand(rows)
    assert conversation_trie.prefix_trie(frame.filter("false")).count() == 0


def test_one_level_a_round_is_the_same(spark):
    rows = [(20, 0, "u", "a"), (20, 1, "u", "b"), (21, 0, "u", "a"), (22, 0, "u", "a"), (22, 1, "u", "c d"), (22, 2, "a", "e"), (40, 0, "u", "")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(str(tuple(r)) for r in conversation_trie.prefix_trie(frame, 1).collect()) == nodes_by_hand(rows)
