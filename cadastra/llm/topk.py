"""Exact top-k search by inner product with vector-approximation files.

Components become floor(1024 * x). Candidates are dealt by a hash of their id over groups, queries over blocks, both of
bounded bytes whatever the dimension; each (group, block) tile is one unit of work, so neither side is ever whole in one
task. In a tile every dimension is cut into 16 cells, two dimensions to a byte: the approximation file has half a byte
a component. It is scanned with one table of 256 bounds for each query and byte; the sums bound all scores from above.
Exact vectors are read in the order of these bounds until the k-th exact score is above the next one. The tiles'
winners are ranked per query by a window, whose rows Spark limits to k before the shuffle.

If queries are a share of all rows, as in the registered query, work grows with the square of the rows, by contract:
each vector is copied once for each `BLOCK_BYTES` of queries, and each query once for each `TILE_BYTES` of vectors.

Defined cases: vectors that are null or empty, or hold null or non-finite components, take no part; vectors of other
dimension than the query's are not its candidates. A row with the query's own id is not its candidate. Ties go to the
smaller id; rows that repeat an id are candidates each. An empty table gives an empty result. Scores that would pass
2^62 are computed with whole numbers of any size and held to 64 bits. Other columns play no part, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 1024
CELLS = 16
TILE_BYTES = 64 << 20
BLOCK_BYTES = 16 << 20
SCANNED = 16
READ_STEP = 64


def _matrix(rows: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray]:
    ids = rows.column("vec_id").to_numpy()
    vectors = rows.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)
    return ids, vectors


def approximate(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The approximation file (a row for each two dimensions, one byte a vector) and the cells' edges per dimension."""
    n, dim = vectors.shape
    edges = np.zeros((dim + dim % 2, CELLS + 1))
    file = np.zeros(((dim + 1) // 2, n), np.uint8)
    for d in range(dim):
        own = vectors[:, d]
        edges[d] = np.quantile(own, np.linspace(0, 1, CELLS + 1))
        cell = np.searchsorted(edges[d, 1:-1], own, side="right").astype(np.uint8)
        file[d // 2] |= cell << np.uint8(4 * (d % 2))
    return file, edges


def bounds(file: np.ndarray, edges: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """For each query and vector, what their inner product is at most."""
    q = np.pad(queries.astype(np.float64), ((0, 0), (0, edges.shape[0] - queries.shape[1])))
    most = np.maximum(q[:, :, None] * edges[None, :, :-1], q[:, :, None] * edges[None, :, 1:])
    upper, part = np.zeros((len(q), file.shape[1])), np.zeros((len(q), file.shape[1]))
    for at, codes in enumerate(file):
        table = (most[:, 2 * at + 1, :, None] + most[:, 2 * at, None, :]).reshape(len(q), CELLS * CELLS)
        np.take(table, codes, axis=1, out=part, mode="clip")
        upper += part
    return upper


def search_tile(query_ids, queries, ids, vectors, k: int) -> list[tuple[int, int, int]]:
    """The k best (query_id, vec_id, score) of each query in one tile."""
    file, edges = approximate(vectors)
    limit = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * vectors.shape[1]
    exact = np.int64 if limit < 2**62 else object
    out = []
    for start in range(0, len(queries), SCANNED):
        upper = bounds(file, edges, queries[start : start + SCANNED])
        upper += 1e-9 * (np.abs(upper) + limit + 1)
        for i, bound in enumerate(upper):
            query, own = query_ids[start + i], queries[start + i].astype(exact)
            # the k-th score of the best-looking ones rules most others out before they are ordered
            first = min(len(bound), max(4 * k, READ_STEP))
            order = np.argpartition(-bound, first - 1)[:first]
            best: list[tuple[int, int]] = []
            seen = np.zeros(0, np.int64)
            while len(order):
                for at in range(0, len(order), READ_STEP):
                    if len(best) == k and bound[order[at : at + READ_STEP]].max() < -best[-1][0]:
                        break
                    near = order[at : at + READ_STEP]
                    scores = vectors[near].astype(exact) @ own
                    best = sorted(best + [(-int(s), int(v)) for s, v in zip(scores, ids[near]) if v != query])[:k]
                if len(seen) or first == len(bound):
                    break
                seen = order
                rest = np.ones(len(bound), bool) if len(best) < k else bound >= -best[-1][0]
                rest[seen] = False
                order = np.flatnonzero(rest)
                order = order[np.argsort(-bound[order], kind="stable")]
            out += [(int(query), v, max(-(2**63), min(2**63 - 1, -s))) for s, v in best]
    return out


def top_k(vectors: DataFrame, is_query, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every row of vec_id, embedding for which is_query holds."""
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    usable = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite).select(
        "vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v"), F.size("embedding").alias("dim"), is_query.alias("is_query")
    )
    size = F.col("dim").cast("long") * 8
    n, n_bytes, query_bytes = usable.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.sum(F.when(F.col("is_query"), size)), F.lit(0))).first()
    groups = max(1, -(-n_bytes // TILE_BYTES), min(64, n // 1024))
    blocks = max(1, -(-query_bytes // BLOCK_BYTES))
    group, block = F.pmod(F.xxhash64("vec_id"), F.lit(groups)), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks))
    candidates = usable.select("vec_id", "v", "dim", group.alias("g"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("b"))
    asked = usable.filter("is_query").select("vec_id", "v", "dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"), block.alias("b"))

    def tile(key, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            dim = key[0].as_py()
            rows = search_tile(*_matrix(right, dim), *_matrix(left, dim), k)
        return pa.table({name: pa.array([r[j] for r in rows], pa.int64()) for j, name in enumerate(("query_id", "vec_id", "score"))})

    won = candidates.groupBy("dim", "g", "b").cogroup(asked.groupBy("dim", "g", "b")).applyInArrow(tile, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return won.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
