"""An append-only log of operations, batches and runs, reduced by key: what was begun, finished or failed, and once only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: States in the order in which they may follow each other; a later one wins, whatever the order of rows.
STATES = ["pending", "processing", "completed", "failed", "expired"]
LOG = "key string, kind string, state string, at string, detail string"


def rank(state) -> F.Column:
    return F.array_position(F.array(*map(F.lit, STATES)), state)


def entries(rows: DataFrame, kind: str, state: str, at: str) -> DataFrame:
    """Log rows of one state for rows (key, and detail if they have one)."""
    detail = F.col("detail").cast("string") if "detail" in rows.columns else F.lit(None).cast("string")
    return rows.select(F.col("key").cast("string").alias("key"), F.lit(kind).alias("kind"), F.lit(state).alias("state"), F.lit(at).alias("at"), detail.alias("detail"))


def current(log: DataFrame) -> DataFrame:
    """One row a key: its furthest state, the last of equal ones, with the time it was begun. Also what compaction keeps."""
    order = F.struct(rank(F.col("state")).alias("rank"), "at", "detail")
    last = log.groupBy("key", "kind").agg(F.max_by(F.struct("state", "at", "detail"), order).alias("last"), F.min("at").alias("begun_at"))
    return last.select("key", "kind", "last.*", "begun_at")


def to_do(wanted: DataFrame, log: DataFrame, kind: str) -> DataFrame:
    """Wanted rows (key, ...) whose key was not completed, each key once: new ones, and those whose worker died half-way."""
    done = current(log).filter((F.col("kind") == kind) & (F.col("state") == "completed")).select("key")
    return wanted.dropDuplicates(["key"]).join(done, "key", "left_anti")


def pending(log: DataFrame, kind: str) -> DataFrame:
    """Rows that are neither finished nor failed, the oldest first where that matters: key, state, at, detail, begun_at."""
    return current(log).filter((F.col("kind") == kind) & F.col("state").isin("pending", "processing")).drop("kind")


def marked(marks: DataFrame, log: DataFrame, kind: str, at: str) -> DataFrame:
    """Log rows that marks (key, state, detail) add: known keys only, and states that lie ahead of the present one."""
    now = current(log).filter(F.col("kind") == kind).select("key", rank(F.col("state")).alias("before"))
    ahead = marks.join(now, "key").filter(rank(F.col("state")) > F.col("before"))
    detail = F.col("detail").cast("string") if "detail" in marks.columns else F.lit(None).cast("string")
    return ahead.select(F.col("key").cast("string").alias("key"), F.lit(kind).alias("kind"), "state", F.lit(at).alias("at"), detail.alias("detail"))


def health_runs(log: DataFrame) -> DataFrame:
    """service, kind, at, failed of the log's runs, as `reports.last_runs` takes them. Keys of runs are service/kind/number."""
    parts = F.split("key", "/")
    runs = current(log).filter("kind = 'run'").filter(F.col("state").isin("completed", "failed"))
    return runs.select(parts[0].alias("service"), parts[1].alias("kind"), "at", (F.col("state") == "failed").alias("failed"))
