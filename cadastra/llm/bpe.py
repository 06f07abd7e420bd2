"""Byte-level BPE encoding and decoding by DuckDB recursive queries, one in-memory database per task.

Texts are split by the tokenizer's pattern. The distinct pieces of a slice of documents go to a recursive query: each
step unnests the pieces' token-position rows, joins neighbouring pairs with the merge table and contracts every piece's
leftmost pair of minimum rank; pieces without a pair leave, until none is left. A piece that is itself a vocabulary
entry is that entry, as in the tokenizer. Whole texts are encoded; a text's ids are the concatenation of its pieces' ids.
Decoding takes a document's ids alone: its token-position rows are joined with the vocabulary and put together in order.

Each distinct piece is contracted once for as long as it is in a task's cache, and each distinct cell (what stands
between blanks that no piece goes on over) is cut into pieces once; documents' ids are gathered by their cells.

A piece of more than `CHUNK` bytes would take a step for each of its contractions, each over all its positions. It is
cut into chunks instead, which are contracted side by side, and neighbouring chunks are joined, pair by pair, by
contracting only some tokens on both sides of a border anew. This is exact: contractions are local, so tokens are the
encoding of their bytes if and only if every two neighbours are the encoding of theirs. A border is settled once the
contracted window begins and ends with the tokens that it was cut from; until then the window is doubled.

Work is cut into slices of about `SLICE_CHARS` code points and into queries of bounded token-position rows, so a task's
memory does not grow with its partition. The cache of encoded pieces is emptied when it is full: that costs time only.

Defined cases: null text equals empty text (no tokens). Repeated ids return a row each. Ties of rank go to the leftmost
pair. Other columns play no part, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.llm.token_output import Known, by_chars, cells

SLICE_CHARS = 2_000_000
CACHE_PIECES = 220_000
#: Pieces of more tokens keep one row each while they are contracted; for others all steps' rows are quicker.
LONG_PIECE = 64
CHUNK = 512
#: Tokens on both sides of a border, at first.
WINDOW = 6
#: Token-position rows of a query, for long and (over all steps) for short pieces.
QUERY_ROWS, QUERY_STEP_ROWS = 250_000, 12_000_000

_ENCODE = """
WITH RECURSIVE encoding(piece, tokens) {keyed} AS (
    SELECT piece, tokens FROM {pieces}
    UNION {all}
    SELECT e.piece, e.tokens[:b.pos - 1] || [b.merged] || e.tokens[b.pos + 2:]
    FROM encoding e JOIN (
        SELECT piece, (best >> 32)::INTEGER AS merged, (best & 4294967295)::BIGINT AS pos FROM (
            SELECT p.piece, min((m.merged::BIGINT << 32) | p.pos) AS best
            FROM (
                SELECT piece, unnest(tokens[:-2]) AS l, unnest(tokens[2:]) AS r, unnest(range(1, len(tokens))) AS pos
                FROM encoding WHERE len(tokens) > 1
            ) p JOIN merges m ON m.pair = p.l::BIGINT * 1048576 + p.r
            GROUP BY p.piece
        )
    ) b ON b.piece = e.piece
)
SELECT piece, arg_min(tokens, len(tokens)) AS tokens FROM encoding GROUP BY piece
"""
_ENCODE_ALL = f"""
SELECT piece, tokens FROM ({_ENCODE.format(keyed="", all="ALL", pieces="(SELECT * FROM pieces WHERE len(tokens) <= {long})")})
UNION ALL
SELECT piece, tokens FROM ({_ENCODE.format(keyed="USING KEY (piece)", all="", pieces="(SELECT * FROM pieces WHERE len(tokens) > {long})")})
ORDER BY piece
""".format(long=LONG_PIECE)

#: One thread: rows come to the aggregate in the order of the subquery.
_DECODE = """
SELECT row, string_agg(bytes, '') AS bytes
FROM (SELECT s.row, v.bytes FROM sequences s JOIN vocabulary v ON v.token = s.token ORDER BY s.pos) GROUP BY row
"""
#: Fixed value: the pattern whose pieces never go on over a blank that follows no white space.
CELLED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Tokenizer:
    """Merge table and vocabulary in an in-memory DuckDB; one per task."""

    def __init__(self, rank_file: str, pattern: str):
        self.ranks = read_ranks(rank_file)
        self.pattern = regex.compile(pattern)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        pairs, merged = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs.append(left * 1048576 + right)
                    merged.append(rank)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "200MB", "temp_directory": ""})
        self._load("merges", pa.table({"pair": pa.array(pairs, pa.int64()), "merged": pa.array(merged, pa.int32())}))
        self._load("vocabulary", pa.table({"token": pa.array(self.ranks.values(), pa.int32()), "bytes": [t.decode("latin-1") for t in self.ranks]}))
        self.cache: dict[str, bytes] = {}
        self.celled, self.known = pattern == CELLED, Known(self._encode_cells)

    def _load(self, name: str, rows: pa.Table) -> None:
        self.db.register("incoming", rows)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def contract(self, raws: list[bytes]) -> list[np.ndarray]:
        """Ids of byte strings, contracted from single bytes, in queries of bounded rows."""
        out, part, rows = [], [], 0.0
        for raw in raws:
            cost = len(raw) / QUERY_ROWS if len(raw) > LONG_PIECE else len(raw) ** 2 / QUERY_STEP_ROWS
            if part and rows + cost > 1:
                out += self._contract(part)
                part, rows = [], 0.0
            part.append(raw)
            rows += cost
        return out + self._contract(part) if part else out

    def _contract(self, raws: list[bytes]) -> list[np.ndarray]:
        values = self.byte_ids[np.frombuffer(b"".join(raws), np.uint8)]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raws])]).astype(np.int32)
        tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
        self._load("pieces", pa.table({"piece": pa.array(range(len(raws)), pa.int32()), "tokens": tokens}))
        found = self.db.sql(_ENCODE_ALL).to_arrow_table().column("tokens").combine_chunks()
        ids, ends = found.flatten().to_numpy().astype("<u4"), found.offsets.to_numpy()
        ends = ends - ends[0]
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:])]

    def encode_pieces(self, pieces: list[str]) -> list[np.ndarray]:
        raws = [p.encode() for p in pieces]
        known = [np.array([self.ranks[r]], "<u4") if r in self.ranks else None for r in raws]
        short = iter(self.contract([r for r, k in zip(raws, known) if k is None and len(r) <= CHUNK]))
        return [k if k is not None else next(short) if len(r) <= CHUNK else self.encode_long(r) for r, k in zip(raws, known)]

    def encode_long(self, raw: bytes) -> list[np.ndarray]:
        """Ids of a long byte string: chunks side by side, then joined pair by pair."""
        parts = self.contract([raw[i : i + CHUNK] for i in range(0, len(raw), CHUNK)])
        while len(parts) > 1:
            pairs = list(zip(parts[::2], parts[1::2]))
            joined: list = [None] * len(pairs)
            open_, reach = list(range(len(pairs))), WINDOW
            while open_:
                windows = [np.concatenate([pairs[i][0][-reach:], pairs[i][1][:reach]]) for i in open_]
                for i, ids in zip(open_, self.contract([b"".join(self.bytes_of[t] for t in w.tolist()) for w in windows])):
                    left, right = pairs[i]
                    if (reach >= len(left) or ids[0] == left[-reach]) and (reach >= len(right) or ids[-1] == right[reach - 1]):
                        joined[i] = np.concatenate([left[:-reach], ids, right[reach:]])
                open_, reach = [i for i in open_ if joined[i] is None], 2 * reach
            parts = joined + parts[len(pairs) * 2 :]
        return parts[0]

    def _encode_cells(self, texts: list[str]) -> list[bytes]:
        if len(self.cache) > CACHE_PIECES:
            self.cache.clear()
        pieces = [self.pattern.findall(t) for t in texts]
        new = [p for p in {p for ps in pieces for p in ps} if p not in self.cache]
        if new:
            self.cache.update(zip(new, (ids.tobytes() for ids in self.encode_pieces(new))))
        return [b"".join(map(self.cache.__getitem__, ps)) for ps in pieces]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Each text's ids. No text may be null."""
        if not self.celled:
            return self.known.encode(texts, np.arange(len(texts) + 1))
        found, places = cells(texts)
        first = np.zeros(len(found), bool)
        first[places[:-1]] = True
        return self.known.encode(pc.if_else(pa.array(first), found, pc.binary_join_element_wise("", found, " ")), places)

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each sequence of ids: its token-position rows, joined with the vocabulary and put together in order."""
        tokens = np.concatenate(ids).astype(np.int32)
        rows = np.repeat(np.arange(len(ids), dtype=np.int32), [len(i) for i in ids])
        self.db.register("sequences", pa.table({"row": rows, "pos": np.arange(len(tokens), dtype=np.int64), "token": tokens}))
        found = self.db.sql(_DECODE).to_arrow_table()
        self.db.unregister("sequences")
        out = [b""] * len(ids)
        for row, text in zip(found.column("row").to_pylist(), found.column("bytes").to_pylist()):
            out[row] = text.encode("latin-1")
        return out


def encode(docs: DataFrame, rank_file: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian 32 bits), decoded_sha256; with_ids adds ids and decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Tokenizer(rank_file, pattern)
        try:
            for part in (p for batch in batches for p in by_chars(batch, SLICE_CHARS)):
                ids = own.encode(part.column("text"))
                back = own.decode(ids)
                columns = [pa.array([len(i) for i in ids], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()), pa.array([hashlib.sha256(b).hexdigest() for b in back], pa.string())]
                names = ["n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns += [pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())), pa.array([b.decode() for b in back], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", *names])
        finally:  # what a task has learned goes with it: other steps' workers need the memory
            own.db.close()
            del own
            pa.default_memory_pool().release_unused()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    extra = ", ids array<int>, decoded string" if with_ids else ""
    return texts.mapInArrow(run, f"doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")
