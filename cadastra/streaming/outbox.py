"""The outbox of an outside evaluator: results are stored, then acknowledged; replays change nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from cadastra.operators import assessments as A
from cadastra.operators.verdicts import latest
from cadastra.sources.ledger import Ledger

KEYS = ["listing_id", "content_hash", "version"]


class OutboxError(ValueError):
    """A page does not go on from the last one."""


def store_page(page: DataFrame, ledger: Ledger, number: int) -> int:
    """Appends a page (outbox_id, listing_id, content_hash, version, result); returns its last id.

    A page is one transaction: its number is taken once, whatever dies in between. Ids of a page must lie behind those
    of all pages before it and not repeat. Results that cannot be stored are left out, as at any later try.
    """
    spark = page.sparkSession
    found = page.agg(F.min("outbox_id").alias("low"), F.max("outbox_id").alias("high"), F.count("*").alias("n"), F.count_distinct("outbox_id").alias("ids")).first()
    if found.high is None:
        return 0
    transaction = ledger.begin("page", number)
    if transaction is None:
        return found.high
    marks = transaction.before.read("cursor", spark.createDataFrame([(0,)], "after_id long"))
    if found.ids != found.n or found.low <= marks.first().after_id:
        raise OutboxError(f"page {number}: ids are not ascending behind the last page")
    right = page.filter(A.text_fault(*(F.col(c) for c in (*KEYS, "result"))).isNull())
    transaction.append("results", right.select("outbox_id", *KEYS, "result"))
    transaction.replace("cursor", spark.createDataFrame([(found.high,)], "after_id long"))
    transaction.commit()
    return found.high


def results(ledger: Ledger) -> DataFrame:
    """The last stored result of each listing, text and version."""
    empty = ledger.spark.createDataFrame([], "outbox_id long, listing_id string, content_hash string, version string, result string")
    return latest(ledger.snapshot().read("results", empty), KEYS, F.col("outbox_id"))


def stream(pages: DataFrame, root: str, checkpoint: str, acknowledge: Callable[[int], None], interval: str | None = None) -> DataStreamWriter:
    """A stream that stores each micro-batch and acknowledges it only then. acknowledge may come twice for one id.

    Without an interval it takes what is there and ends.
    """
    spark: SparkSession = pages.sparkSession

    def take(batch: DataFrame, number: int) -> None:
        last = store_page(batch, Ledger(spark, root), number)
        if last:
            acknowledge(last)

    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return pages.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**trigger)
