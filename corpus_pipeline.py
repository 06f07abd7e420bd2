"""A corpus pipeline of five stages: toxicity, line dedup, n-gram Jaccard join, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of docs, and leave columns that they don't work on as they are, whatever their names. Rows that repeat a doc_id are one
document: toxicity, line dedup and mixing judge each of its rows by its own text, the n-gram join keeps or drops them
together. A row with a null doc_id is kept by the n-gram join. Null texts count as empty ones, which no stage drops but
for the mixture's budget. Ties go by doc_id: the largest keeps a shared line, the smallest of a group stays. Empty
tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.llm import bpe, line_dedup, mixing, ngram_join, toxicity
from cadastra.llm.common import materialise, shielded, table, unshielded


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that are judged toxic."""
    model = toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    needed = ("doc_id", "text")
    return unshielded(toxicity.score(shielded(docs, *needed), model).filter("predicted = 0"), docs.columns, *needed)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops shared lines from all documents but one; n_chars follows the text."""
    needed = ("doc_id", "text")
    kept = unshielded(line_dedup.dedup_lines(shielded(docs, *needed)), docs.columns, *needed)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near duplicates."""
    groups = ngram_join.near_duplicates(docs)
    others = groups.filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture holds it."""
    needed = ("doc_id", "text", "lang", "source")
    mixed = mixing.mix(shielded(docs, *needed)).filter("copies > 0")
    return unshielded(mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))), docs.columns, *needed)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded documents."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", ngram_join_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: A trained classifier decides the first stage: SQL cannot express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
