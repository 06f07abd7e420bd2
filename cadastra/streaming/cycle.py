"""A whole cycle in one call, and the light tick between cycles: each one transaction over all tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.operators import decisions as D
from cadastra.operators import observe as O
from cadastra.operators import publishing as G
from cadastra.operators import runlog
from cadastra.sources.ledger import Ledger, Transaction
from cadastra.streaming.ingest import ingest_version

PRICE_FIELDS = ["event_id", "listing", "observed_at", "price", "event_type", "history_complete"]
PRESENCE_FIELDS = ["event_id", "listing", "event_type", "status_after", "observed_at", "history_complete"]
_STATE = ", ".join(f"{c} {'double' if c.endswith('price') else 'string'}" for c in O.STATE)
_LOCAL = "id string, event_type string, status_after string, observed_at string, history_complete boolean"
_HISTORY = "entity string, listing string, valid_from string, valid_to string, version string"


def run(
    ledger: Ledger, number: int, version: str, rows: DataFrame, prices: DataFrame, presence: DataFrame, verdicts: DataFrame, outside: DataFrame, texts: DataFrame, photos: DataFrame,
    relabel: DataFrame, now: str, text_version: str, photo_version: str,
) -> dict:
    """Events, state, entities, gate, canonical rows, assessments, numbers: stored together, or not at all.

    rows: the snapshot's listings (`observe.merge_state`, `publishing.publish`); prices and presence: its source events
    (PRICE_FIELDS, PRESENCE_FIELDS); verdicts and outside as `publishing.gated` takes them; texts and photos as
    `publishing.enriched` does; relabel: listings that wait to be relabelled, while which nothing is published. An empty
    result is not published either: the clean table stays as it is. A number that was taken changes nothing.
    Returns what happened, and how many rows each table got.
    """
    spark = ledger.spark
    transaction = ledger.begin("cycle", number, f"{version} {now}")
    if transaction is None:
        return {"outcome": "repeated"}
    empty = lambda shape: spark.createDataFrame([], shape)
    # what is read before it is replaced is the last version's
    before = transaction.before
    old_state, old_members = before.read("state", empty(_STATE)), before.read("members", empty("listing string, entity string"))
    seen = transaction.replace("rows", rows)
    totals = {"listings": seen.count(), "prices": prices.count(), "presence": presence.count()}
    found = {"prices_new": ingest_version(transaction, "price_events", prices, PRICE_FIELDS, version, totals), "presence_new": ingest_version(transaction, "presence_events", presence, PRESENCE_FIELDS, version, totals)}
    state = transaction.replace("state", O.merge_state(old_state, seen))
    members = transaction.replace("members", O.attach_new(old_members, seen))
    transaction.append("local_presence", O.presence_events(old_state, seen, now))
    local = transaction.read("local_presence")
    transaction.append("local_prices", O.price_events(old_state, seen, now))
    own = local.select(F.col("id").alias("listing"), "event_type", "observed_at", F.concat_ws("/", "id", "observed_at", "event_type").alias("event_id"))
    source = transaction.read("presence_events").select("listing", "event_type", "observed_at", "event_id")
    if "entities" in before:
        touched = seen.select(F.col("id").alias("listing")).unionByName(presence.select("listing"))
        entities = O.recompute_touched(before.read("entities"), members, state, own, source, touched, now)
    else:
        entities = O.recompute_entities(members, state, own, source, now)
    entities = transaction.replace("entities", entities)
    found |= {"listings": totals["listings"], "entities": entities.count()}
    found |= _publish(transaction, version, seen, verdicts, outside, texts, photos, relabel, now, text_version, photo_version)
    transaction.append("log", runlog.entries(spark.createDataFrame([(f"cleaner/full/{number}", found["outcome"])], "key string, detail string"), "run", "completed", now))
    transaction.commit()
    return found


def light_tick(
    ledger: Ledger, number: int, version: str, verdicts: DataFrame, outside: DataFrame, texts: DataFrame, photos: DataFrame, relabel: DataFrame, now: str, text_version: str, photo_version: str
) -> dict:
    """Publishes again from the rows of the last full cycle, with the verdicts and assessments that came since."""
    transaction = ledger.begin("tick", number, f"{version} {now}")
    if transaction is None:
        return {"outcome": "repeated"}
    if "rows" not in transaction.before:
        return {"outcome": "no cycle yet"}
    found = _publish(transaction, version, transaction.before.read("rows"), verdicts, outside, texts, photos, relabel, now, text_version, photo_version)
    transaction.append("log", runlog.entries(ledger.spark.createDataFrame([(f"cleaner/tick/{number}", found["outcome"])], "key string, detail string"), "run", "completed", now))
    transaction.commit()
    return found


def _publish(transaction: Transaction, version: str, rows: DataFrame, verdicts: DataFrame, outside: DataFrame, texts: DataFrame, photos: DataFrame, relabel: DataFrame, now: str, text_version: str, photo_version: str) -> dict:
    if not relabel.isEmpty():
        return {"outcome": "relabelling", "waiting": relabel.count()}
    spark = rows.sparkSession
    gated = transaction.replace("gated", G.gated(rows.filter(G.comparable(F.col("baseline_eligible"), F.col("seller_type"))), verdicts, outside))
    counts = {r.gate: r["count"] for r in gated.groupBy("gate").count().collect()}
    found = {"rejected": counts.get("rejected", 0), "waiting": counts.get("waiting", 0), "rewritten": gated.filter("rewritten").count()}
    if not counts.get("publish"):
        return {"outcome": "empty", "published": 0, **found}
    history = transaction.before.read("canonical_history", spark.createDataFrame([], _HISTORY))
    current = history.filter("valid_to is null").select("entity", F.col("listing").alias("canonical"))
    chosen = G.canonical_rows(gated.filter("gate = 'publish'"), transaction.read("members"), transaction.read("entities"), current)
    clean = transaction.replace("clean", G.sequenced(G.enriched(chosen, texts, photos, text_version, photo_version), "id").withColumn("baseline_version", F.lit(version)))
    transaction.replace("canonical_history", D.canonical_history(history, clean.select("entity", F.col("id").alias("listing")), now, version))
    # a late outside verdict takes the place of the stored one
    transaction.replace("verdict_rewrites", gated.filter("rewritten").select("id", "content_hash", "usable", "reason_code"))
    n = clean.count()
    return {"outcome": "published", "published": n, "switched": clean.filter("switched").count(), "duplicates_removed": counts["publish"] - n, **found}
