"""Shared helpers of the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that splits words and is stripped from lines.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where the setting is absent and Spark runs inside this process, a folder of this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "cadastra-checkpoints")


def materialise(df: DataFrame) -> DataFrame:
    """Writes df once as Parquet in the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cadastra-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shielded(docs: DataFrame, *needed: str) -> DataFrame:
    """docs with all columns but the needed ones under names that no operator uses; `unshielded` gives the names back."""
    return docs.select(*(F.col(f"`{c}`") if c in needed else F.col(f"`{c}`").alias(f"__in_{i}") for i, c in enumerate(docs.columns)))


def unshielded(df: DataFrame, columns: list[str], *needed: str) -> DataFrame:
    """The columns of docs, by their own names, from what an operator made of shielded(docs)."""
    return df.select(*(F.col(f"`{c}`") if c in needed else F.col(f"__in_{i}").alias(c) for i, c in enumerate(columns)))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many rows: a worker's Python objects stay small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def map_batches(df: DataFrame, batch_fn: Callable[[dict], dict | None], schema: str, rows: int = 2000) -> DataFrame:
    """mapInArrow over dicts of columns. Texts come as Arrow arrays; batch_fn returns arrays or lists by column name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, rows):
            out = batch_fn(dict(zip(batch.schema.names, batch.columns)))
            if out is not None:
                yield pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(run, schema)


def crc_mod(column, modulus: int):
    """crc32 of the id's decimal text, modulo modulus; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus
