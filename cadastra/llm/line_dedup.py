"""Line dedup: lines that many documents share stay only in one of them.

A text is split at newlines (null or empty: one empty line). A line's key is the line stripped of ASCII white space
at both ends, with A-Z lower-cased. A key of at least `min_chars` code points found in at least `min_docs` distinct
documents loses all its lines except those of the largest doc_id that holds it. The others stay, in their places.

Keys are hashed to 128 bits where the text is read; only (hash, document, position) rows are shuffled. Distinct
documents are counted in two steps (hash and document, then hash), so that a line of a third of all documents is
pre-aggregated; the join with the shared lines spreads
each line over several keys, and adaptive execution can split it further.

Defined cases: null text equals empty text. Rows that repeat a doc_id count as one document; each row is returned. A
null doc_id never counts as a document and so keeps no shared line. Ties do not arise: the largest doc_id is one
document. An empty table gives an empty result. Columns of the input called n_lines or n_dropped are replaced by the
result's; all others are carried by `dedup_lines` untouched, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.llm.common import SPACE, map_batches, materialise

_SPACE = SPACE.encode()
#: Rows of a shared line are spread over so many keys.
SALTS = 8


def line_hashes(docs: DataFrame, min_chars: int = 40) -> DataFrame:
    """One row for each line whose key is long enough: doc_id, row_hash (of its text), pos (from 0), h1, h2."""

    def explode(batch: dict) -> dict:
        ids, row_hash, pos, digests = [], [], [], []
        for doc_id, text, th in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["row_hash"].to_pylist()):
            # bytes.lower() folds A-Z only
            for i, line in enumerate(text.encode().lower().split(b"\n")):
                key = line.strip(_SPACE)
                if len(key) >= min_chars and len(key.decode()) >= min_chars:
                    ids.append(doc_id)
                    row_hash.append(th)
                    pos.append(i)
                    digests.append(xxhash.xxh3_128_digest(key))
        h = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
        return {"doc_id": pa.array(ids, pa.int64()), "row_hash": pa.array(row_hash, pa.int64()), "pos": pa.array(pos, pa.int32()), "h1": pa.array(h[:, 0].copy()), "h2": pa.array(h[:, 1].copy())}

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("row_hash"))
    return map_batches(texts, explode, "doc_id long, row_hash long, pos int, h1 long, h2 long")


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs with text replaced by its kept lines, and n_lines, n_dropped (long) added; other columns stay."""
    lines = materialise(line_hashes(docs, min_chars))
    shared = lines.groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("in_docs"), F.max("doc_id").alias("keeper")).filter(F.col("in_docs") >= min_docs).drop("in_docs")
    shared = shared.withColumn("salt", F.explode(F.array([F.lit(i).cast("long") for i in range(SALTS)])))
    dropped = (
        lines.withColumn("salt", F.pmod(F.xxhash64("doc_id", "pos"), F.lit(SALTS))).join(shared, ["h1", "h2", "salt"])
        .filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("doc_id").alias("__line_id"), F.col("row_hash").alias("__line_row"))
        .agg(F.collect_set("pos").alias("__line_drop"))
    )
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumn("__line_key", F.xxhash64("text"))
    joined = keyed.join(dropped, F.col("doc_id").cast("long").eqNullSafe(F.col("__line_id")) & (F.col("__line_key") == F.col("__line_row")), "left")
    lines_of = F.split(text, "\n")
    # array_except works by a hash set, so a long text with many dropped lines stays linear
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines_of) - 1), F.col("__line_drop"))
    kept_text = F.transform(F.array(lines_of), lambda all_lines: F.array_join(F.transform(kept, lambda i: F.get(all_lines, i)), "\n"))[0]
    return joined.withColumns(
        {
            "n_lines": (F.length(text) - F.length(F.translate(text, "\n", "")) + 1).cast("long"),
            "n_dropped": F.coalesce(F.size("__line_drop"), F.lit(0)).cast("long"),
            "text": F.when(F.col("__line_drop").isNull(), text).otherwise(kept_text),
        }
    ).drop("__line_key", "__line_id", "__line_row", "__line_drop")
