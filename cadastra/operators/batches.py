"""Batches of listings for a model: what is in flight, what goes out, what comes back, relabelling and rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastra.functions import text as X

MIN_BATCH, BATCH, BATCHES, GROUP, ATTEMPTS = 1, 3000, 10, 20, 3


def in_flight(batches: DataFrame) -> DataFrame:
    """id of listings in pending batches (batch_id, status, listing_ids: JSON map of id to hash, or an old list of ids); what cannot be read counts as none."""
    pending = batches.filter("status = 'pending'")
    as_map = F.map_keys(F.from_json("listing_ids", "map<string,string>"))
    return pending.select(F.explode(F.coalesce(F.when(F.col("listing_ids").startswith("["), F.from_json("listing_ids", "array<string>")).otherwise(as_map), F.array().cast("array<string>"))).alias("id")).distinct()


def budget(waiting: int, spent: int, flying: int, pilot: int = 0, least: int = MIN_BATCH, size: int = BATCH, batches: int = BATCHES) -> int:
    """How many of the waiting listings go out now."""
    if waiting < least:
        return 0
    out = min(waiting, size * batches)
    return max(0, min(out, pilot - spent - flying)) if pilot else out


def planned(waiting: DataFrame, order: str, n: int, size: int = BATCH, group: int = GROUP) -> DataFrame:
    """The first n waiting listings with batch, group (both from 0) and place in the group. n is bounded by the budget."""
    first = waiting.orderBy(order).limit(n)
    at = F.row_number().over(Window.orderBy(order)) - 1
    batch, inside = F.floor(at / size), F.pmod(at, F.lit(size))
    return first.withColumns({"batch": batch.cast("long"), "group": F.floor(inside / group).cast("long"), "place": F.pmod(inside, F.lit(group)).cast("long")})


#: Beginnings of names of models that think before they answer, and what they get for it.
REASONING = ("gpt-5", "gpt-6", "o1", "o3", "o4")
REASONING_TOKENS = 4000
#: The lines of a listing as the model sees it, and what stands for fields that are not filled.
VIEW = ["### id: {id}", "Заголовок: {title}", "Комнат: {rooms}, площадь: {square_m2} м²", "Отделка (поле сайта): {rent_renovation}", "Тип дома (поле сайта) — приват. общежитие: {priv_dorm}", "Описание: {full_description}"]
UNFILLED = {"title": "", "rooms": "None", "square_m2": "None", "rent_renovation": "не указана", "priv_dorm": "не указано", "full_description": ""}


def reasons(model: str) -> bool:
    return model.lower().startswith(REASONING)


def token_parameter(model: str) -> str:
    """The name under which a model takes the limit of its answer."""
    return "max_completion_tokens" if reasons(model) else "max_tokens"


def token_budget(n: Column, per_item: int = 150, fixed: int = 300, reasoning: int = 0) -> Column:
    return n * per_item + fixed + reasoning


def model_view(rows: DataFrame) -> Column:
    """A listing as the model sees it: id, title, rooms and area, finish, dormitory, text cut in its middle; no price or floor.

    Rooms and area that are null read None, texts that are empty or null what stands for them.
    """
    kinds = dict(rows.dtypes)

    def field(name: str) -> Column:
        value = F.col(name)
        if name == "full_description":
            return X.head_tail(F.coalesce(value, F.lit("")))
        text = X.float_text(value.cast("double")) if kinds[name] in ("double", "float") else value.cast("string")
        empty = name not in ("id", "rooms", "square_m2")
        return F.coalesce(F.nullif(text, F.lit("")) if empty else text, F.lit(UNFILLED.get(name, "")))

    parts: list[Column] = []
    for piece in re.split(r"[{}]", "\n".join(VIEW)):
        parts.append(field(piece) if piece in UNFILLED or piece == "id" else F.lit(piece))
    return F.concat(*parts)


def request_lines(grouped: DataFrame, text: Column, model: str, prompt: str, reasoning: int = 0) -> DataFrame:
    """batch, group, value: one JSON line a group, texts in order of place. grouped: as `planned` gives it."""
    lists = grouped.groupBy("batch", "group").agg(F.array_sort(F.collect_list(F.struct("place", F.col("id").cast("string").alias("id"), text.alias("text")))).alias("items"))
    user = F.array_join(F.transform("items", lambda i: i["text"]), "\n\n")
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    limit = token_budget(F.size("items"), reasoning=reasoning or (REASONING_TOKENS if reasons(model) else 0)).alias(token_parameter(model))
    body = F.struct(F.lit(model).alias("model"), F.array(message("system", F.lit(prompt)), message("user", user)).alias("messages"), limit)
    line = F.struct(F.concat(F.lit("grp_"), F.col("items")[0]["id"]).alias("custom_id"), F.lit("POST").alias("method"), body.alias("body"))
    return lists.select("batch", "group", F.to_json(line).alias("value"))


def write_requests(lines: DataFrame, path: str) -> None:
    """The request lines as text files, a folder a batch."""
    lines.select("batch", "value").write.partitionBy("batch").text(path)


def batch_outcomes(batches: DataFrame, answers: DataFrame) -> DataFrame:
    """batch_id, outcome of pending batches by the provider's answers (batch_id, state, output_file, download_code).

    failed: completed without output, unreadable ids, or a 4xx at download; ended as the provider says; pending: still
    running, or a download that may be repeated; completed: its results are taken.
    """
    known = batches.filter("status = 'pending'").join(answers, "batch_id", "left")
    readable = F.from_json("listing_ids", "map<string,string>").isNotNull() | F.from_json("listing_ids", "array<string>").isNotNull()
    done = F.col("state") == "completed"
    outcome = (
        F.when(done & (F.col("output_file").isNull() | ~F.coalesce(readable, F.lit(False)) | F.col("download_code").between(400, 499)), "failed")
        .when(done & (F.coalesce("download_code", F.lit(200)) == 200), "completed")
        .when(F.col("state").isin("failed", "expired", "cancelled"), F.col("state"))
        .otherwise("pending")
    )
    return known.select("batch_id", outcome.alias("outcome"))


def stored_hash(failed: Column, attempts: Column, saved: Column, most: int = ATTEMPTS) -> Column:
    """A failed answer stores no hash, so that it is asked again, until the attempts are used up."""
    return F.when(failed & (attempts < most), "").otherwise(saved)


def ingested(results: DataFrame, verdicts: DataFrame, most: int = ATTEMPTS) -> DataFrame:
    """id, content_hash, usable, reason_code, source, attempts to store of results (id, saved_hash, usable, reason_code, source)."""
    before = verdicts.select("id", F.col("attempts").alias("tried"))
    failed = F.col("source") == "llm_failed"
    counted = results.join(before, "id", "left").withColumn("attempts", F.when(failed, F.coalesce("tried", F.lit(0)) + 1).otherwise(0))
    return counted.select("id", stored_hash(failed, F.col("attempts"), F.col("saved_hash"), most).alias("content_hash"), "usable", "reason_code", "source", "attempts")


def upserted(verdicts: DataFrame, new: DataFrame, relabel: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verdicts with the new ones in their place, the relabel set without those that came back with a hash)."""
    kept = verdicts.join(new.select("id"), "id", "left_anti").unionByName(new, allowMissingColumns=True)
    return kept, relabel.join(new.filter("content_hash <> ''").select("id"), "id", "left_anti")


def start_relabel(verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verdicts with the hashes of all model verdicts taken away, their ids)."""
    ours = F.col("source").isin("llm", "llm_failed")
    return verdicts.withColumn("content_hash", F.when(ours, "").otherwise(F.col("content_hash"))), verdicts.filter(ours).select("id")


def prune_relabel(relabel: DataFrame, rows: DataFrame) -> DataFrame:
    """The relabel set without listings that are gone. While it is not empty, nothing is published."""
    return relabel.join(rows.select("id").distinct(), "id", "left_semi")


def retroactive(verdicts: DataFrame, ruled: DataFrame) -> DataFrame:
    """verdicts after the rules were asked again: ruled has id, content_hash, rule (a code, or null) of all rows.

    A rule that fires and differs from what is stored (source, usable, code) takes its place; where the stored verdict was
    a rule's and none fires any more, its hash goes, so that the listing is judged anew. action says which.
    """
    both = verdicts.join(ruled.select("id", F.col("content_hash").alias("hash_now"), "rule", F.lit(True).alias("present")), "id", "left")
    same = (F.col("source") == "rule") & (F.col("usable") == 0) & (F.col("reason_code") == F.col("rule"))
    action = F.when(F.col("rule").isNotNull() & ~F.coalesce(same, F.lit(False)), "overridden").when(F.col("present") & F.col("rule").isNull() & (F.col("source") == "rule"), "reopened").otherwise("kept")
    over = F.col("action") == "overridden"
    return both.withColumn("action", action).select(
        "id", F.when(over, F.col("hash_now")).when(F.col("action") == "reopened", "").otherwise(F.col("content_hash")).alias("content_hash"), F.when(over, 0).otherwise(F.col("usable")).alias("usable"),
        F.when(over, F.col("rule")).otherwise(F.col("reason_code")).alias("reason_code"), F.when(over, "rule").otherwise(F.col("source")).alias("source"), "action",
    )


def judged_without_model(changed: DataFrame, rule: Column, decisions: DataFrame) -> DataFrame:
    """changed (id, content_hash) with layer: rule, else main (a reusable outside decision of id and content_hash), else llm."""
    own = decisions.select("id", "content_hash", F.lit(True).alias("decided")).distinct()
    ruled = changed.withColumn("rule", rule).join(own, ["id", "content_hash"], "left")
    return ruled.withColumn("layer", F.when(F.col("rule").isNotNull(), "rule").when(F.col("decided"), "main").otherwise("llm")).drop("decided")
