"""Event ingest: idempotent by id over all history, aborting on an id whose payload changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from cadastra.functions.scalars import typed_hash
from cadastra.session import written


class EventConflict(ValueError):
    """A stored event id came again with another payload."""


#: The store is partitioned by a hash of the id, so that a batch reads only the parts that its ids fall into.
BUCKETS = 64


def with_hash(events: DataFrame, fields: list[str]) -> DataFrame:
    """events with event_hash over the fields, their types and borders."""
    return events.withColumn("event_hash", typed_hash(*map(F.col, fields)))


def conflicts(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Ids that have more than one payload in new and stored together."""
    both = new.select("event_id", "event_hash").unionByName(stored.select("event_id", "event_hash"))
    return both.groupBy("event_id").agg(F.count_distinct("event_hash").alias("payloads")).filter("payloads > 1")


def fresh(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Events not stored yet, each once."""
    return new.dropDuplicates(["event_id"]).join(stored.select("event_id"), "event_id", "left_anti")


def ingest_batch(batch: DataFrame, store: str, fields: list[str]) -> int:
    """Appends a batch's fresh events to the Parquet store and returns their number; replays add nothing.

    Check and append are two steps: a store has one writer.
    """
    spark: SparkSession = batch.sparkSession
    new = with_hash(batch, fields).withColumn("bucket", F.pmod(F.xxhash64("event_id"), F.lit(BUCKETS)).cast("int"))
    touched = [r.bucket for r in new.select("bucket").distinct().collect()]
    try:
        stored = spark.read.parquet(store).filter(F.col("bucket").isin(touched))
    except Exception as missing:  # noqa: BLE001  the store begins empty
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        stored = new.limit(0)
    if not conflicts(new, stored).isEmpty():
        raise EventConflict("an event id came with another payload")
    found = fresh(new, stored).cache()
    n = found.count()
    if n:
        found.write.mode("append").partitionBy("bucket").parquet(store)
    found.unpersist()
    return n


def stream(events: DataFrame, store: str, checkpoint: str, fields: list[str]) -> DataStreamWriter:
    """A stream that ingests each micro-batch; offsets are committed after the batch is stored."""
    return events.writeStream.foreachBatch(lambda df, _: ingest_batch(df, store, fields)).option("checkpointLocation", checkpoint).trigger(availableNow=True)


_INDEX = "folder string, file string, low long, high long"


def _class(value: Column) -> Column:
    """One of 4,096 classes of a hash, in its order: ids and files meet by it."""
    return F.shiftright(value, 52).cast("int")


def files_of(index: DataFrame, ids: DataFrame) -> list[str]:
    """The files that may hold the ids (h): those whose range of hashes has one of them. At most as many as there are files."""
    spread = index.withColumn("class", F.explode(F.sequence(_class(F.col("low")), _class(F.col("high")))))
    asked = ids.select("h", _class(F.col("h")).alias("class")).distinct()
    found = asked.join(spread, "class").filter("h between low and high").select("file").distinct()
    return sorted(r.file for r in found.collect())


def ingest_version(transaction, table: str, new: DataFrame, fields: list[str], version: str, totals: dict[str, int]) -> int:
    """Adds a version's fresh events to a ledger's table within a transaction; returns their number.

    An id that comes with another payload ends it, and so does a version that was taken before with other totals. Files
    are ranges of the ids' hashes, and an index holds each file's range, so only files that may hold an id are opened.
    """
    spark: SparkSession = new.sparkSession
    shape = "version string, tab string, " + ", ".join(f"{k} long" for k in sorted(totals))
    taken = transaction.read("ingests", spark.createDataFrame([], shape)).filter((F.col("version") == version) & (F.col("tab") == table)).drop("version", "tab").first()
    if taken is not None and taken.asDict() != totals:
        raise EventConflict(f"version {version} was taken with other totals")
    hashed = written(with_hash(new, fields).withColumn("h", F.xxhash64("event_id")))
    index = transaction.read(f"{table}_index", spark.createDataFrame([], _INDEX))
    opened = files_of(index, hashed)
    stored = spark.read.parquet(*opened) if opened else hashed.limit(0)
    if not conflicts(hashed, stored).isEmpty():
        raise EventConflict("an event id came with another payload")
    found = written(fresh(hashed, stored))
    folders = transaction.append(table, found, "h")
    ranges = lambda folder: spark.read.parquet(transaction.path(table, folder)).groupBy(F.input_file_name().alias("file")).agg(F.min("h").alias("low"), F.max("h").alias("high")).select(F.lit(folder).alias("folder"), "file", "low", "high")
    after = index.filter(F.col("folder").isin(transaction.tables[table]))
    for folder in folders:
        after = after.unionByName(ranges(folder))
    transaction.replace(f"{table}_index", after)
    if taken is None:
        transaction.append("ingests", spark.createDataFrame([(version, table, *(totals[k] for k in sorted(totals)))], shape))
    return found.count()
