"""Versioned snapshots: a directory per version and one manifest that names the current one."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.functions import text

SCHEMA_VERSION = 1


class SnapshotError(ValueError):
    """The snapshot does not hold together."""


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def manifest(spark: SparkSession, root: str) -> dict | None:
    fs, place = _file_system(spark, f"{root}/manifest.json")
    if not fs.exists(place):
        return None
    content = json.loads("".join(r.value for r in spark.read.text(f"{root}/manifest.json").collect()))
    if content["schema_version"] > SCHEMA_VERSION:
        raise SnapshotError("the snapshot is newer than this reader")
    return {"versions": [content["version"]], **content}


def current_version(spark: SparkSession, root: str) -> str | None:
    content = manifest(spark, root)
    return content["version"] if content else None


def publish(df: DataFrame, root: str, version: str, keep: int = 2) -> bool:
    """Writes a new version and then moves the pointer in one rename; readers see the old or the new one.

    Empty results are not published, and their folder goes. A version that exists is refused: readers may be in it. The
    current and the versions before it, `keep` in all, stay for readers that began with them. One writer at a time.
    """
    spark = df.sparkSession
    fs, folder = _file_system(spark, f"{root}/version={version}")
    if fs.exists(folder):
        raise SnapshotError(f"version {version} exists")
    df.write.parquet(f"{root}/version={version}")
    if spark.read.schema(df.schema).parquet(f"{root}/version={version}").isEmpty():
        fs.delete(folder, True)
        return False
    before = manifest(spark, root)
    kept = [version, *(before["versions"] if before else [])][:keep]
    write_manifest(spark, root, {"schema_version": SCHEMA_VERSION, "version": version, "versions": kept})
    for status in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(root)):
        name = status.getPath().getName()
        if name.startswith("version=") and name.removeprefix("version=") not in kept:
            fs.delete(status.getPath(), True)
    return True


def write_manifest(spark: SparkSession, root: str, content: dict) -> None:
    """Replaces the manifest in one step."""
    _replace(spark, f"{root}/manifest.json", json.dumps(content))


def _replace(spark: SparkSession, path: str, text: str) -> None:
    """A small file that has the old content or the new one at any time."""
    fs, target = _file_system(spark, path)
    temporary = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}.tmp")
    out = fs.create(temporary, True)
    out.write(bytearray(text.encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration())
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context.rename(fs.makeQualified(temporary), fs.makeQualified(target), how)


def assemble(rows: DataFrame, prices: DataFrame, presence: DataFrame, totals: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables of one version, after all checks: totals as the manifest states them, ids, photos, events.

    totals: rows, prices, presence, photos (whole numbers from 0). rows: id, photo_urls, photo_count, photo_set_hash;
    events: source_event_id, listing_id.
    """
    for name in ("rows", "prices", "presence", "photos"):
        if not isinstance(totals.get(name), int) or totals[name] < 0:
            raise SnapshotError(f"the manifest has no total of {name}")
    found = rows.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.coalesce(F.sum("photo_count"), F.lit(0)).alias("photos")).first()
    for name, n, stated in (("rows", found.n, totals["rows"]), ("photos", found.photos, totals["photos"]), ("prices", prices.count(), totals["prices"]), ("presence", presence.count(), totals["presence"])):
        if n != stated:
            raise SnapshotError(f"{n} {name}, the manifest says {stated}")
    if found.ids != found.n:
        raise SnapshotError("listing ids repeat")
    reject_if(rows, photo_identity_wrong(F.col("photo_urls"), F.col("photo_count"), F.col("photo_set_hash")), "id", "photos don't fit their count or hash")
    for events in (prices, presence):
        bad = event_faults(events, rows)
        reject_if(bad, F.lit(True), "source_event_id", "events are not right")
    return rows, prices, presence


def event_faults(events: DataFrame, rows: DataFrame) -> DataFrame:
    """Events with fault: no id, an id that repeats, or a listing that is not in rows."""
    ids = events.groupBy("source_event_id").agg(F.count("*").alias("times"))
    known = rows.select(F.col("id").alias("listing_id"), F.lit(True).alias("known")).distinct()
    marked = events.join(ids.filter("times > 1"), "source_event_id", "left").join(known, "listing_id", "left")
    fault = F.when(F.coalesce(F.trim("source_event_id"), F.lit("")) == "", "no id").when(F.col("times") > 1, "repeated id").when(F.col("known").isNull(), "unknown listing")
    return marked.withColumn("fault", fault).filter("fault is not null").drop("times", "known")


def effective_version(content: dict) -> str:
    """The manifest's version, with scope and its revision where they are given."""
    scope = content.get("scope")
    return ":".join(map(str, [content["version"], scope, content.get("scope_revision", 0)])) if scope else str(content["version"])


def csv_rows(df: DataFrame) -> DataFrame:
    """df with arrays, structs and maps as JSON text, for a CSV."""
    nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "struct", "map")]
    return df.withColumns({c: F.to_json(c) for c in nested}) if nested else df


def write_csv(df: DataFrame, root: str, version: str, built_at: str, keep: int = 2) -> str:
    """A CSV artifact named by a hash of version and time; its folder is written whole before it has its name.

    The same version and time give the artifact that is there, or build it again if it is gone. Of others the newest
    stay, `keep` in all with this one; folders that dead writers left go.
    """
    spark = df.sparkSession
    token = hashlib.sha256(f"{version}\0{built_at}".encode()).hexdigest()[:16]
    fs, final = _file_system(spark, f"{root}/clean.{token}.csv")
    if not fs.exists(final):
        work = f"{root}/.clean.{token}.{uuid.uuid4().hex}"
        csv_rows(df).write.option("header", True).csv(work)
        if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(work), final):
            raise SnapshotError(f"{final} could not get its name")
    found = [s for s in fs.listStatus(final.getParent()) if s.getPath().getName().startswith((".clean.", "clean."))]
    whole = sorted((s for s in found if s.getPath().getName().startswith("clean.") and s.getPath().getName() != final.getName()), key=lambda s: -s.getModificationTime())
    for status in [*whole[keep - 1 :], *(s for s in found if s.getPath().getName().startswith(".clean."))]:
        fs.delete(status.getPath(), True)
    return f"{root}/clean.{token}.csv"


def write_report(spark: SparkSession, path: str, content: dict) -> None:
    """A small JSON report, under its name only when it is whole; the one before it stays until then."""
    _replace(spark, path, json.dumps(content, ensure_ascii=False, sort_keys=True))


def cache_misses(urls: DataFrame, assets: DataFrame, normalization: str, fingerprint: str) -> DataFrame:
    """Distinct urls whose fingerprint of these versions is not stored yet (assets: url_hash, normalization, fingerprint)."""
    wanted = urls.select("url").distinct().withColumn("url_hash", F.sha2("url", 256))
    have = assets.filter((F.col("normalization") == normalization) & (F.col("fingerprint") == fingerprint)).select("url_hash")
    return wanted.join(have, "url_hash", "left_anti").withColumn("shard", F.substring("url_hash", 1, 2))


def read_current(spark: SparkSession, root: str) -> DataFrame:
    version = current_version(spark, root)
    if version is None:
        raise SnapshotError("nothing is published")
    return spark.read.parquet(f"{root}/version={version}")


def reject_if(rows: DataFrame, bad: Column, key: str, what: str) -> None:
    """Raises with the number of bad rows and the first five keys."""
    found = rows.filter(F.coalesce(bad, F.lit(True)))
    n = found.count()
    if n:
        raise SnapshotError(f"{what}: {n} rows, first {[r[0] for r in found.select(key).orderBy(key).limit(5).collect()]}")


def orphans(events: DataFrame, rows: DataFrame, key: str, other: str) -> DataFrame:
    """Events whose key no row has."""
    return events.join(rows.select(F.col(other).alias(key)), key, "left_anti")


def photo_identity_wrong(urls: Column, count: Column, set_hash: Column) -> Column:
    """True where the number of photos or the order-free hash of their urls is not as stated; no photos have a null hash."""
    return ~(F.size(urls).eqNullSafe(count) & text.set_hash(urls).eqNullSafe(set_hash))
